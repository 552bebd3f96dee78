"""Sampling profile, gaps, resampling and row-count windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import WindowSettings, micros
from .ordered import BY, coming, series


def intervals(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, us, interval_us): the time since the row before; none for a first row."""
    return df.select(*by, "us", (F.col("us") - F.lag("us").over(series(by))).alias("interval_us")).where("interval_us is not null")


def profile(df: DataFrame, gap_us: int, by: Sequence[str] = BY) -> DataFrame:
    """Per series: rows, span, modal interval (the first met among equals), number and sum of gaps, largest gap."""
    d = intervals(df, by)
    counts = d.groupBy(*by, "interval_us").agg(F.count("*").alias("n"), F.min("us").alias("met"))
    mode = counts.groupBy(*by).agg(F.max_by("interval_us", F.struct("n", -F.col("met"))).alias("mode_us"))
    gap = F.col("interval_us") > gap_us
    stats = d.groupBy(*by).agg((F.count("*") + 1).alias("n_rows"), (F.sum("interval_us") / 1e6).alias("span_s"), F.count_if(gap).alias("n_gaps"), (F.coalesce(F.sum(F.when(gap, F.col("interval_us"))), F.lit(0)) / 1e6).alias("gap_s"), (F.max("interval_us") / 1e6).alias("largest_s"))
    return stats.join(mode, [*by])


def gaps(df: DataFrame, gap_us: int, by: Sequence[str] = BY) -> DataFrame:
    """(by, start_us, end_us) of every interval above gap_us."""
    d = intervals(df, by).where(F.col("interval_us") > gap_us)
    return d.select(*by, (F.col("us") - F.col("interval_us")).alias("start_us"), F.col("us").alias("end_us"))


def near_gap(df: DataFrame, gap_us: int, near_us: int, by: Sequence[str] = BY, keep: Sequence[str] = ()) -> DataFrame:
    """Adds gap_adjacent: within near_us (closed) of either edge of a gap. Two fills, no join."""
    w = series(by)
    before, after = F.lag("us").over(w), F.lead("us").over(w)
    at_edge = (F.col("us") - before > gap_us) | (after - F.col("us") > gap_us)
    df = df.withColumn("__edge", F.when(F.coalesce(at_edge, F.lit(False)), F.col("us")))
    past = F.last("__edge", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__past", past).withColumn("__next", coming("__edge", by))
    close = F.coalesce(F.col("us") - F.col("__past") <= near_us, F.lit(False)) | F.coalesce(F.col("__next") - F.col("us") <= near_us, F.lit(False))
    return df.withColumn("gap_adjacent", close).drop("__edge", "__past", "__next")


def resample(df: DataFrame, step_us: int, means: Sequence[str], maxima: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """A regular grid from each series' first midnight: mean of analog, maximum of digital channels; empty bins are NULL rows."""
    day = 86_400_000_000
    first = Window.partitionBy(*by)
    origin = F.floor(F.min("us").over(first) / day) * day
    rows = df.withColumn("__o", origin).withColumn("bin_us", (F.col("__o") + F.floor((F.col("us") - F.col("__o")) / step_us) * step_us).cast("long"))
    filled = rows.groupBy(*by, "bin_us").agg(*(F.avg(c).alias(c) for c in means), *(F.max(c).alias(c) for c in maxima))
    grid = filled.groupBy(*by).agg(F.min("bin_us").alias("lo"), F.max("bin_us").alias("hi"))
    grid = grid.select(*by, F.explode(F.sequence("lo", "hi", F.lit(step_us))).alias("bin_us"))
    return grid.join(filled, [*by, "bin_us"], "left")


def window_rows(s: WindowSettings, interval_us: int, mode: str = "train") -> tuple[int, int]:
    """Window length and stride in rows: nearest (half to even), at least one."""
    if mode not in ("train", "score"):
        raise ValueError(f"unknown stride mode {mode!r}")
    stride = s.stride_train if mode == "train" else s.stride_score
    return max(1, round(micros(s.window) / interval_us)), max(1, round(micros(stride) / interval_us))


def check_embargo(s: WindowSettings, embargo: str) -> None:
    if micros(s.window) > micros(embargo):
        raise ValueError(f"the window {s.window} is longer than the embargo {embargo}")


def windows(df: DataFrame, length: int, stride: int, interval_us: int, tolerance: float, channels: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """Rows at which a window of `length` rows ends: every stride-th from the first full one, less those whose time span
    is above length * interval * (1 + tolerance) or which hold a missing value. Adds start_us and span_us."""
    if not channels:
        raise ValueError("no channels")
    w = series(by)
    back = w.rowsBetween(-(length - 1), 0)
    whole = F.lit(True)
    for c in channels:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    df = df.withColumn("__rn", F.row_number().over(w) - 1).withColumn("start_us", F.first("us").over(back))
    df = df.withColumn("__whole", F.min(whole.cast("int")).over(back)).withColumn("span_us", F.col("us") - F.col("start_us"))
    ends = (F.col("__rn") >= length - 1) & ((F.col("__rn") - (length - 1)) % stride == 0)
    fits = F.col("span_us") <= length * interval_us * (1 + tolerance)
    return df.where(ends & fits & (F.col("__whole") == 1)).drop("__rn", "__whole")


def window_stats(df: DataFrame, length: int, channels: Sequence[str], by: Sequence[str] = BY, stats: Sequence[str] = ("mean", "std", "min", "max", "slope")) -> DataFrame:
    """Adds <channel>_<stat> over the last `length` rows: float32 inputs, population deviation, slope (last - first) / length."""
    back = series(by).rowsBetween(-(length - 1), 0)
    kinds: dict[str, object] = {
        "mean": lambda c: F.avg(c).over(back),
        "std": lambda c: F.stddev_pop(c).over(back),
        "min": lambda c: F.min(c).over(back),
        "max": lambda c: F.max(c).over(back),
        "slope": lambda c: (c - F.first(c).over(back)) / length,
    }
    if unknown := [s for s in stats if s not in kinds]:
        raise ValueError(f"unknown statistics {unknown}")
    out: list[Column] = [kinds[k](F.col(c).cast("float").cast("double")).alias(f"{c}_{k}") for c in channels for k in stats]
    return df.select("*", *out)
