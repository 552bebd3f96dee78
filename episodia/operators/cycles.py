"""Cycle features: what the last finished runs and the running one tell, and drift-aware ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FeatureSettings, micros
from .ordered import BY, last_completed, ratio, rolling_medians, run_table, series, so_far, with_last_runs, with_runs

LOADED, OFFLOAD, STOPPED = "LOADED", "OFFLOAD", "STOPPED"


def attach_to_rows(df: DataFrame, runs: DataFrame, columns: Sequence[str], gap_us: int | None, by: Sequence[str] = BY) -> DataFrame:
    """Adds run-level columns to the rows of each run: features are computed on runs, which are far fewer."""
    return with_runs(df, "regime", gap_us, by).join(runs.select(*by, "run_id", *columns), [*by, "run_id"])


def run_slope(channel: str) -> Column:
    """Least-squares slope per second within a run; NULL with fewer than two points or times."""
    x = F.col("us") / 1e6 - F.lit(0)
    return F.regr_slope(F.col(channel), x).alias("slope")


def slopes(df: DataFrame, channel: str, gap_us: int | None, by: Sequence[str] = BY) -> DataFrame:
    """run_table plus `slope` of the channel over elapsed seconds."""
    begin = F.first("us").over(Window.partitionBy(*by, "run_id").orderBy("us"))
    rows = with_runs(df, "regime", gap_us, by).withColumn("__x", (F.col("us") - begin) / 1e6)
    slope = rows.groupBy(*by, "run_id").agg(F.regr_slope(channel, "__x").alias("slope"))
    return run_table(df, "regime", gap_us, by).join(slope, [*by, "run_id"])


def running(df: DataFrame, wanted: str, channel: str, min_samples: int, gap_us: int | None, by: Sequence[str] = BY) -> DataFrame:
    """Adds running_elapsed_s and running_slope (expanding within the run) for rows whose label is `wanted`."""
    return _running(with_runs(df, "regime", gap_us, by), wanted, channel, min_samples, by)


def _running(rows: DataFrame, wanted: str, channel: str, min_samples: int, by: Sequence[str]) -> DataFrame:
    inside = Window.partitionBy(*by, "run_id").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__x", (F.col("us") - F.first("us").over(inside)) / 1e6)
    mine = F.col("regime") == wanted
    n = F.count(channel).over(inside)
    slope = F.regr_slope(channel, "__x").over(inside)
    rows = rows.withColumn("running_elapsed_s", F.when(mine, F.col("__x"))).withColumn("__n", n).withColumn("__s", slope)
    return rows.withColumn("running_slope", F.when(mine & (F.col("__n") >= max(min_samples, 2)), F.col("__s"))).drop("__x", "__n", "__s")


def cycle_period(runs: DataFrame, wanted: str = STOPPED, by: Sequence[str] = BY) -> DataFrame:
    """Adds cycle_period_s to runs: start to start of the two latest genuine runs of the label, seen from the newer one's first row."""
    w = Window.partitionBy(*by).orderBy("run_id")
    genuine = (F.col("regime") == wanted) & ~F.col("start_is_gap_continuation")
    runs = runs.withColumn("__start", F.when(genuine, F.col("start_us")))
    earlier = F.last("__start", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__period", F.when(genuine, (F.col("start_us") - earlier) / 1e6))
    return runs.withColumn("cycle_period_s", F.last("__period", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start", "__period")


def duty_ratio(width_us: int, by: Sequence[str] = BY, wanted: str = LOADED) -> Column:
    """Share of rows in (t - width, t] whose label is `wanted`: counts up to t less counts up to t - width, as Spark sums a
    moving frame anew for every row."""
    now, before = (series(by).rangeBetween(Window.unboundedPreceding, end) for end in (0, -width_us))
    mine = F.count(F.when(F.col("regime") == wanted, 1))
    n = F.count("regime").over(now) - F.count("regime").over(before)
    return F.when(n > 0, (mine.over(now) - mine.over(before)) / n)


def baseline_trailing(df: DataFrame, column: str, width_us: int, out: str, by: Sequence[str] = BY) -> DataFrame:
    """Adds value / median over (t - width, t]."""
    return baselines(df, {column: out}, width_us, None, by)


def baseline_lagged(df: DataFrame, column: str, width_us: int, lag_us: int, out: str, by: Sequence[str] = BY) -> DataFrame:
    """Adds value / the trailing median as it stood at the last row no later than `lag` before. A median counts once the
    series is a full width old, so the first width + lag are NULL."""
    return baselines(df, {column: out}, width_us, lag_us, by)


def baselines(df: DataFrame, columns: dict[str, str], width_us: int, lag_us: int | None, by: Sequence[str] = BY) -> DataFrame:
    """baseline_trailing() (without a lag) or baseline_lagged() of several columns, with one pass for all medians."""
    bases = {c: f"__base_{k}" for k, c in enumerate(columns)}
    df = rolling_medians(df, bases, width_us, by)
    if lag_us is not None:
        df = df.withColumn("__first", F.min("us").over(Window.partitionBy(*by)))
        kept = F.struct(*(F.when(F.col("us") - F.col("__first") >= width_us, F.col(b)).alias(b) for b in bases.values()))
        df = df.withColumn("__then", F.last(kept).over(series(by).rangeBetween(Window.unboundedPreceding, -lag_us)))
        df = df.withColumns({b: F.col("__then")[b] for b in bases.values()}).drop("__first", "__then")
    return df.withColumns({out: ratio(c, bases[c]) for c, out in columns.items()}).drop(*bases.values())


def cycle_features(df: DataFrame, s: FeatureSettings, by: Sequence[str] = BY) -> DataFrame:
    """Adds the twelve cycle features to rows (by, us, regime, decay channel)."""
    gap = micros(s.gap)
    wanted = {f"{name}_duration_last": (label, "duration_s", True) for name, label in (("stopped", STOPPED), ("offload", OFFLOAD), ("loaded", LOADED))}
    rows = with_last_runs(df, s.decay_channel, wanted | {"decay_rate_last": (STOPPED, "slope", False)}, gap, by)
    rows = rows.withColumnRenamed("stopped_duration_last_gap", "run_gap_truncated").drop("offload_duration_last_gap", "loaded_duration_last_gap", "decay_rate_last_gap")
    rows = _row_periods(_running(rows, STOPPED, s.decay_channel, s.min_samples, by), STOPPED, gap, by)
    rows = rows.withColumnRenamed("running_elapsed_s", "stopped_elapsed").withColumnRenamed("running_slope", "decay_rate_running")
    rows = rows.withColumn("duty_ratio_trailing", duty_ratio(micros(s.duty), by))
    return baselines(rows, {c: f"{c}_rel_baseline" for c in ("stopped_duration_last", "cycle_period_last", "decay_rate_last")}, micros(s.baseline), None, by)


def _row_periods(rows: DataFrame, wanted: str, gap_us: int, by: Sequence[str]) -> DataFrame:
    """Adds cycle_period_last, cycle_period() on rows with run_id: a genuine run starts at its first row."""
    w = series(by)
    before, label, t = F.lag("run_id").over(w), F.lag("regime").over(w), F.lag("us").over(w)
    first = F.coalesce(before != F.col("run_id"), F.lit(True))
    carried_on = F.coalesce((F.col("us") - t > gap_us) & (label == F.col("regime")), F.lit(False))
    rows = rows.withColumn("__start", F.when(first & (F.col("regime") == wanted) & ~carried_on, F.col("us")))
    earlier = F.last("__start", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__period", F.when(F.col("__start").isNotNull(), (F.col("us") - earlier) / 1e6))
    return rows.withColumn("cycle_period_last", F.last("__period", True).over(so_far(by))).drop("__start", "__period")


def last_peak(df: DataFrame, channel: str, wanted: str, gap_us: int | None, by: Sequence[str] = BY) -> DataFrame:
    """Adds last_peak: the channel's maximum over the last finished run with the label; NULL if that was truncated."""
    runs = run_table(df, "regime", gap_us, by, [F.max(channel).alias("peak")])
    runs = last_completed(runs, "regime", wanted, F.col("peak"), "last_peak", by)
    return attach_to_rows(df, runs, ["last_peak"], gap_us, by)
