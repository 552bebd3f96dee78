"""Reconstruction scorer: mean squared error of windows over time and channels, and by channel.

`Reconstruction` sends windows through a linear bottleneck (principal components), which needs no iterations and sees
every training window; autoencoder.ConvAutoencoder has the same contract with a convolutional net."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ReconstructionSettings
from ..operators.ordered import series
from ..schema import with_fields


def with_windows(df: DataFrame, channels: Sequence[str], length: int, by: Sequence[str]) -> DataFrame:
    """Adds w: the last `length` rows of all channels as one array (row-major); only full windows stay."""
    back = series(by).rowsBetween(-(length - 1), 0)
    df = df.withColumn("w", F.flatten(F.collect_list(F.array(*(F.col(c).cast("float") for c in channels))).over(back)))
    return df.where(F.size("w") == length * len(channels))


def validation_split(df: DataFrame, share: float, by: Sequence[str]) -> DataFrame:
    """Adds validation: the trailing round(n * share) rows of each series, at most n - 1."""
    n = F.count("*").over(Window.partitionBy(*by))
    k = F.row_number().over(series(by))
    tail = F.least(F.bround(n * share), n - 1)
    return df.withColumn("validation", k > n - tail)


class Reconstruction:
    def __init__(self, channels: Sequence[str], length: int, settings: ReconstructionSettings = ReconstructionSettings()):
        self.contributors, self.length, self.settings = list(channels), length, settings
        self.fitted = False

    def fit(self, train: DataFrame) -> Reconstruction:
        """train: rows with w. Only sums of the window's size squared reach the driver."""
        d = self.length * len(self.contributors)

        def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((d + 1, d + 1))
            for f in frames:
                if len(f):
                    x = np.hstack([np.stack(f["w"].to_numpy()).astype(float), np.ones((len(f), 1))])
                    total += x.T @ x
            yield pd.DataFrame({"cell": np.arange((d + 1) ** 2), "v": total.ravel()})

        rows = train.select("w").mapInPandas(moments, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas().sort_values("cell")
        m = rows["v"].to_numpy().reshape(d + 1, d + 1) if len(rows) else np.zeros((d + 1, d + 1))
        if m[d, d] == 0:
            raise ValueError("no training windows")
        self.mean = m[d, :d] / m[d, d]
        cov = m[:d, :d] / m[d, d] - np.outer(self.mean, self.mean)
        _, vectors = np.linalg.eigh(cov)
        self.basis, self.fitted = vectors[:, ::-1][:, : self.settings.bottleneck], True
        return self

    def _errors(self, w: pd.Series) -> np.ndarray:
        x = np.stack(w.to_numpy()).astype(float) - self.mean
        rest = x - (x @ self.basis) @ self.basis.T
        return (rest.reshape(len(x), self.length, len(self.contributors)) ** 2).mean(axis=1)

    def contributions(self, rows: DataFrame) -> DataFrame:
        """Adds c_<channel>: the channel's mean squared error over the window."""
        if not self.fitted:
            raise ValueError("the model is not fitted")
        names = [f"c_{c}" for c in self.contributors]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                e = self._errors(f["w"]) if len(f) else np.zeros((0, len(names)))
                yield f.assign(**{n: e[:, k] for k, n in enumerate(names)})

        return rows.mapInPandas(run, with_fields(rows, *names))

    def score(self, rows: DataFrame) -> DataFrame:
        names = [f"c_{c}" for c in self.contributors]
        out = self.contributions(rows)
        return out.withColumn("score", sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names)
