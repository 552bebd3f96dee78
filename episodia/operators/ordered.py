"""Operators on rows in time order: change flags, fills, runs, as-of, chunked rolling medians.

All are causal: a row sees itself and earlier rows only (run_table's
gap_truncated looks one row ahead, as a fact about a run that has ended).
`by` names the partition of a series; times are microseconds in `us`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import with_fields

BY = ("asset_id",)


def series(by: Sequence[str] = BY) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("us")


def so_far(by: Sequence[str] = BY) -> WindowSpec:
    return series(by).rowsBetween(Window.unboundedPreceding, 0)


def coming(column: str, by: Sequence[str] = BY, order: Sequence[str] = ("us",)) -> Column:
    """The first value at or after a row: a fill over the reversed order, as Spark's frames that end at the last row are quadratic."""
    return F.last(column, True).over(Window.partitionBy(*by).orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, 0))


def changed(label: str, by: Sequence[str] = BY) -> Column:
    """True where the label differs from the row before, and on the first row."""
    before = F.lag(label).over(series(by))
    return before.isNull() | (before != F.col(label))


def since_change(df: DataFrame, label: str, out: str, by: Sequence[str] = BY) -> DataFrame:
    """Adds the microseconds since the label last changed."""
    df = df.withColumn("__changed", F.when(changed(label, by), F.col("us")))
    return df.withColumn(out, F.col("us") - F.last("__changed", True).over(so_far(by))).drop("__changed")


def with_runs(df: DataFrame, label: str = "regime", gap_us: int | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Adds run_id: it grows where the label changes or, if gap_us is given, after a larger gap."""
    w = series(by)
    new = changed(label, by)
    if gap_us is not None:
        new = new | F.coalesce(F.col("us") - F.lag("us").over(w) > gap_us, F.lit(False))
    df = df.withColumn("__new", new.cast("long"))
    return df.withColumn("run_id", F.sum("__new").over(so_far(by))).drop("__new")


def run_table(df: DataFrame, label: str = "regime", gap_us: int | None = None, by: Sequence[str] = BY, values: Sequence[Column] = ()) -> DataFrame:
    """One row per run: run_id, label, start_us, end_us, n, duration_s, gap_truncated, start_is_gap_continuation, and `values`."""
    runs = with_runs(df, label, gap_us, by).groupBy(*by, "run_id").agg(F.first(label).alias(label), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"), *values)
    runs = runs.withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / 1e6)
    w = Window.partitionBy(*by).orderBy("run_id")
    if gap_us is None:
        return runs.withColumn("gap_truncated", F.lit(False)).withColumn("start_is_gap_continuation", F.lit(False))
    after = F.lead("start_us").over(w) - F.col("end_us") > gap_us
    before = (F.col("start_us") - F.lag("end_us").over(w) > gap_us) & (F.lag(label).over(w) == F.col(label))
    return runs.withColumn("gap_truncated", F.coalesce(after, F.lit(False))).withColumn("start_is_gap_continuation", F.coalesce(before, F.lit(False)))


def last_completed(runs: DataFrame, label: str, wanted: str, value: Column, out: str, by: Sequence[str] = BY, void_if_truncated: bool = True) -> DataFrame:
    """Adds, to every run, the value of the last finished run with the wanted label; a truncated one hides older values.

    The struct keeps a legitimate NULL from being skipped. `<out>_gap` tells whether that run was truncated."""
    w = Window.partitionBy(*by).orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    got = F.when(F.col("gap_truncated"), F.lit(None)).otherwise(value) if void_if_truncated else value
    found = F.last(F.when(F.col(label) == wanted, F.struct(got.cast("double").alias("v"), F.col("gap_truncated").alias("g"))), True).over(w)
    return runs.withColumn("__found", found).withColumn(out, F.col("__found.v")).withColumn(f"{out}_gap", F.coalesce("__found.g", F.lit(False))).drop("__found")


def with_last_runs(df: DataFrame, channel: str, wanted: dict[str, tuple[str, str, bool]], gap_us: int, by: Sequence[str] = BY) -> DataFrame:
    """last_completed() on rows, without a run table or a join: adds run_id and, for each out: (label, fact, void_if_truncated),
    `out` and `<out>_gap`. fact: duration_s, slope, abs_slope or peak (maximum) of the channel over the run.

    A run's facts are known at all its rows; the next run's first row takes them over and they are filled on from there."""
    w = series(by)
    rows = with_runs(df, "regime", gap_us, by).withColumn("__cut", F.coalesce(F.lead("us").over(w) - F.col("us") > gap_us, F.lit(False)))
    run = Window.partitionBy(*by, "run_id").orderBy("us").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("__x", (F.col("us") - F.first("us").over(run)) / 1e6)
    slope = F.regr_slope(channel, "__x").over(run)
    rows = rows.withColumns({"__duration_s": F.max("__x").over(run), "__slope": slope, "__peak": F.max(channel).over(run), "__cut": F.max("__cut").over(run)})
    facts = F.struct("run_id", "regime", F.col("__cut").alias("cut"), F.col("__duration_s").alias("duration_s"), F.col("__slope").alias("slope"), F.abs("__slope").alias("abs_slope"), F.col("__peak").alias("peak"))
    rows = rows.withColumn("__before", F.lag(facts).over(w)).drop("__x", "__duration_s", "__slope", "__peak", "__cut")
    first = F.col("__before.run_id") != F.col("run_id")
    found = {}
    for out, (label, fact, void) in wanted.items():
        value = F.col(f"__before.{fact}").cast("double")
        got = F.struct((F.when(~F.col("__before.cut"), value) if void else value).alias("v"), F.col("__before.cut").alias("g"))
        found[f"__{out}"] = F.last(F.when(first & (F.col("__before.regime") == label), got), True).over(so_far(by))
    rows = rows.withColumns(found)
    rows = rows.withColumns({out: F.col(f"__{out}.v") for out in wanted} | {f"{out}_gap": F.coalesce(F.col(f"__{out}.g"), F.lit(False)) for out in wanted})
    return rows.drop("__before", *found)


def as_of(column: str, lag_us: int, by: Sequence[str] = BY) -> Column:
    """The value at the last row no later than lag_us before; its NULL is kept."""
    return F.last(column).over(series(by).rangeBetween(Window.unboundedPreceding, -lag_us))


def rolling_median(df: DataFrame, column: str, width_us: int, out: str, by: Sequence[str] = BY, chunk_us: int | None = None) -> DataFrame:
    return rolling_medians(df, {column: out}, width_us, by, chunk_us)


def rolling_medians(df: DataFrame, columns: dict[str, str], width_us: int, by: Sequence[str] = BY, chunk_us: int | None = None) -> DataFrame:
    """Adds, for each column: out, the median over (t - width, t], NULLs skipped. Every series is cut into time chunks that
    carry a halo of `width`, so one long series is still worked on by many tasks and each row goes to at most a few of them.
    Rows of one time share its whole frame."""
    chunk_us = chunk_us or 4 * width_us
    own = F.floor(F.col("us") / chunk_us)
    reach = F.floor((F.col("us") + (width_us - 1)) / chunk_us)
    sent = df.withColumn("__own", own).withColumn("__chunk", F.explode(F.sequence(own, reach)))
    schema = with_fields(df, *columns.values())
    names = df.columns

    def roll(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("us", kind="stable").reset_index(drop=True)
        us = part["us"].to_numpy()
        index, last = pd.to_datetime(us, unit="us"), np.searchsorted(us, us, "right") - 1
        for column, out in columns.items():
            value = pd.Series(part[column].to_numpy(dtype="float64"), index=index)
            part[out] = value.rolling(pd.Timedelta(width_us, unit="us"), min_periods=1).median().to_numpy()[last]
        return part.loc[part["__own"] == part["__chunk"], [*names, *columns.values()]]

    # without a repartition the partitioning by series would do, and all chunks of a series would stay in its task
    rolled = sent.repartition(*by, "__chunk").groupBy(*by, "__chunk").applyInPandas(roll, schema)
    return rolled.withColumns({out: F.when(~F.isnan(out), F.col(out)) for out in columns.values()})


def ratio(value: str | Column, base: str | Column) -> Column:
    """value / base; x / 0 is infinite, 0 / 0 and anything over a missing base are missing."""
    v, b = (F.col(x) if isinstance(x, str) else x for x in (value, base))
    return F.when(b != 0, v / b).when((b == 0) & (v > 0), F.lit(float("inf"))).when((b == 0) & (v < 0), F.lit(float("-inf")))
