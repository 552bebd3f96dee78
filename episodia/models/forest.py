"""Isolation forest (Liu, Ting and Zhou, 2008): trees on small samples, scoring in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ForestSettings
from ..operators.episodes import rank_contributions
from ..schema import with_fields


def path_norm(n: int | np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    h = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (feature, threshold, left child, depth value) of one tree; feature -1 marks a leaf and right = left + 1."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    feature, threshold, left, value = [-1], [0.0], [-1], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        lo, hi = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) > 1 else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(hi > lo)
        if depth >= limit or not len(open_):
            value[node] = depth + float(path_norm(len(rows)))
            continue
        f = int(rng.choice(open_))
        t = float(rng.uniform(lo[f], hi[f]))
        below = x[rows, f] <= t
        feature[node], threshold[node], left[node] = f, t, len(feature)
        for side in (rows[below], rows[~below]):
            todo.append((len(feature), side, depth + 1))
            feature.append(-1)
            threshold.append(0.0)
            left.append(-1)
            value.append(0.0)
    return np.array(feature), np.array(threshold), np.array(left), np.array(value)


def depths(trees: list, x: np.ndarray) -> np.ndarray:
    """Mean path length of every row."""
    total = np.zeros(len(x))
    for feature, threshold, left, value in trees:
        node = np.zeros(len(x), dtype=np.int64)
        while (live := np.flatnonzero(feature[node] >= 0)).size:
            at = node[live]
            node[live] = left[at] + (x[live, feature[at]] > threshold[at])
        total += value[node]
    return total / max(len(trees), 1)


class IsolationForest:
    def __init__(self, features: Sequence[str], settings: ForestSettings = ForestSettings(), key: str = "us"):
        """key: a column that orders the samples' hash, so the same rows give the same trees."""
        self.contributors, self.settings, self.key = list(features), settings, key
        self.trees: list | None = None

    def fit(self, train: DataFrame) -> IsolationForest:
        """Medians over all training rows; one bounded, hash-ordered sample of rows for all trees."""
        s = self.settings
        medians = train.agg(*(F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(c) for c in self.contributors)).first()
        self.medians = np.array([0.0 if m is None else m for m in medians])
        rows = train.orderBy(F.xxhash64(F.lit(s.seed), self.key), self.key).limit(s.max_samples * s.trees)
        x = self._matrix(rows.select(*(F.col(c).cast("double").alias(c) for c in self.contributors)).toPandas())
        if not len(x):
            raise ValueError("no training rows")
        rng = np.random.default_rng(s.seed)
        self.size = min(s.max_samples, len(x))
        self.trees = [grow(x[rng.choice(len(x), self.size, replace=False)], rng) for _ in range(s.trees)]
        return self

    def _matrix(self, frame: pd.DataFrame) -> np.ndarray:
        x = frame[self.contributors].to_numpy(dtype=float)
        return np.where(np.isnan(x), self.medians, x)

    def _scores(self, x: np.ndarray) -> np.ndarray:
        return 2.0 ** (-depths(self.trees, x) / max(float(path_norm(self.size)), 1e-12))

    def score(self, rows: DataFrame) -> DataFrame:
        if self.trees is None:
            raise ValueError("the model is not fitted")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(score=self._scores(self._matrix(f)))

        return rows.mapInPandas(run, with_fields(rows, "score"))

    def contributions(self, rows: DataFrame, ablation: bool | None = None) -> DataFrame:
        """Adds c_<feature>: how much the score falls when the feature takes its training median (0 if ablation, or else
        the setting, is off)."""
        if self.trees is None:
            raise ValueError("the model is not fitted")
        names = [f"c_{c}" for c in self.contributors]
        if not (self.settings.ablation if ablation is None else ablation):
            return rows.select("*", *(F.lit(0.0).alias(n) for n in names))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                x = self._matrix(f)
                full = self._scores(x)
                for k, n in enumerate(names):
                    without = x.copy()
                    without[:, k] = self.medians[k]
                    f = f.assign(**{n: full - self._scores(without)})
                yield f

        return rows.mapInPandas(run, with_fields(rows, *names))

    def explain_episode(self, rows: DataFrame, start_us: int, end_us: int, method: str = "mean") -> DataFrame:
        """(place, contributor, value) by ablation over the rows of [start, end], whatever the setting; raises without any."""
        rows = rows.where(F.col("us").between(start_us, end_us))
        if rows.isEmpty():
            raise ValueError(f"no rows within [{start_us}, {end_us}]")
        found = self.contributions(rows, True).withColumn("episode", F.lit(1).cast("long"))
        named = found.select("episode", "us", *(F.col(f"c_{c}").alias(c) for c in self.contributors))
        return rank_contributions(named, self.contributors, [], method).select("place", "contributor", "value")
