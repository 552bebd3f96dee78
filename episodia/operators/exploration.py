"""Exploratory summaries: description, flag separation, mode shift, drift, smoothed run durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BY, run_table


def describe(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Per channel: count, mean, sample deviation, minimum, exact quartiles, maximum."""
    pairs = [x for c in channels for x in (F.lit(c), F.col(c))]
    long = df.select(F.stack(F.lit(len(channels)), *pairs).alias("channel", "x"))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy("channel").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("lo"), q.alias("q"), F.max("x").alias("hi"))
    return out.select("channel", "n", "mean", "std", "lo", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "hi")


def flag_separation(df: DataFrame, flags: Sequence[str], low: Column) -> DataFrame:
    """Per flag: the difference between its shares of 1 among low and other rows, largest first."""
    row = df.agg(*(x for f in flags for x in (F.avg(F.when(low, (F.col(f) == 1).cast("double"))).alias(f"{f}_low"), F.avg(F.when(~low, (F.col(f) == 1).cast("double"))).alias(f"{f}_high"))))
    pairs = [x for f in flags for x in (F.lit(f), F.abs(F.col(f"{f}_low") - F.col(f"{f}_high")))]
    return row.select(F.stack(F.lit(len(flags)), *pairs).alias("flag", "separation")).orderBy(F.desc("separation"), "flag")


def mode_shift(df: DataFrame, channel: str, low: Column, valley: tuple[float, float]) -> DataFrame:
    """Median and IQR of a channel among low and other rows, the shift of the median, and the share of all rows in the valley."""
    q = lambda c: F.percentile(F.when(c, F.col(channel)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    row = df.agg(q(low).alias("a"), q(~low).alias("b"), F.avg(F.col(channel).between(*valley).cast("double")).alias("valley_share"))
    part = lambda c, n: [F.col(c)[1].alias(f"{n}_median"), (F.col(c)[2] - F.col(c)[0]).alias(f"{n}_iqr")]
    return row.select(*part("a", "low"), *part("b", "high"), F.abs(F.col("a")[1] - F.col("b")[1]).alias("shift"), "valley_share")


def stats_drift(part: DataFrame, whole: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Per channel: median and IQR of a part and of the whole, and their differences in percent."""
    def stats(df: DataFrame, name: str) -> DataFrame:
        pairs = [x for c in channels for x in (F.lit(c), F.col(c))]
        q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        out = df.select(F.stack(F.lit(len(channels)), *pairs).alias("channel", "x")).groupBy("channel").agg(q.alias("q"))
        return out.select("channel", F.col("q")[1].alias(f"{name}_center"), (F.col("q")[2] - F.col("q")[0]).alias(f"{name}_iqr"))

    out = stats(part, "part").join(stats(whole, "whole"), "channel")
    change = lambda k: F.when(F.col(f"whole_{k}") != 0, (F.col(f"part_{k}") - F.col(f"whole_{k}")) / F.col(f"whole_{k}") * 100).alias(f"{k}_percent")
    return out.select("*", change("center"), change("iqr"))


def smoothed_durations(df: DataFrame, wanted: str, gap_us: int, runs: int = 20, by: Sequence[str] = BY) -> DataFrame:
    """Runs of the rows with a label, split where these rows are more than gap_us apart, and the median duration of the
    last `runs` of them (NULL before there are so many)."""
    found = run_table(df.where(F.col("regime") == wanted), "regime", gap_us, by)
    w = Window.partitionBy(*by).orderBy("run_id").rowsBetween(-(runs - 1), 0)
    smooth = F.when(F.count("*").over(w) >= runs, F.percentile("duration_s", F.lit(0.5)).over(w))
    return found.select(*by, "run_id", "start_us", "duration_s", smooth.alias("smoothed_s"))


def max_against_train(train: DataFrame, test: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    """Per key: the largest test score and the percentage of training scores below it."""
    top = test.groupBy(*keys).agg(F.max(score).alias("top"))
    return train.join(top, [*keys]).groupBy(*keys).agg(F.first("top").alias("top"), (F.avg((F.col(score) < F.col("top")).cast("double")) * 100).alias("percent_below"))
