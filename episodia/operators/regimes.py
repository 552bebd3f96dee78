"""Operating regimes: first-match states, causal debounce, settling; and their description."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RegimeSettings, micros
from .ordered import BY, run_table, series, since_change, so_far


def state_names(s: RegimeSettings) -> list[str]:
    return [*s.states, s.above, s.below]


def raw_state(s: RegimeSettings, name_of: Callable[[str], Column] = F.lit) -> Column:
    """The first state whose flags all hold, else by the split channel; a missing flag or channel fails its comparison."""
    out = None
    for name, flags in s.states.items():
        holds = F.lit(True)
        for flag, value in flags.items():
            holds = holds & F.coalesce(F.col(flag) == value, F.lit(False))
        out = F.when(holds, name_of(name)) if out is None else out.when(holds, name_of(name))
    above = F.coalesce(F.col(s.split_channel) >= s.split_at, F.lit(False)) & ~F.coalesce(F.isnan(s.split_channel), F.lit(False))
    rest = F.when(above, name_of(s.above)).otherwise(name_of(s.below))
    return rest if out is None else out.otherwise(rest)


def assign_regimes(df: DataFrame, s: RegimeSettings, by: Sequence[str] = BY) -> DataFrame:
    """Adds `regime`. A raw state counts once it has lasted min_duration (before the first, the series' first state does);
    for `settle` after a change of the committed state, and at the start, the label is the transition's."""
    df = since_change(df.withColumn("__raw", raw_state(s)), "__raw", "__held", by)
    lasting = F.last(F.when(F.col("__held") >= micros(s.min_duration), F.col("__raw")), True).over(so_far(by))
    df = df.withColumn("__committed", F.coalesce(lasting, F.first("__raw").over(so_far(by))))
    df = since_change(df, "__committed", "__settling", by)
    label = F.when(F.col("__settling") <= micros(s.settle), F.lit(s.transition)).otherwise(F.col("__committed"))
    return df.withColumn("regime", label).drop("__raw", "__held", "__committed", "__settling")


def occupancy(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per regime: rows, percent, and number and duration quartiles of its runs (split by label change only)."""
    if df.isEmpty():
        raise ValueError("no rows to describe")
    rows = df.groupBy("regime").agg(F.count("*").alias("n_rows"))
    total = rows.agg(F.sum("n_rows").alias("n_total"))
    runs = run_table(df, "regime", None, by).groupBy("regime").agg(F.count("*").alias("n_runs"), F.percentile("duration_s", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))).alias("q"))
    out = rows.crossJoin(F.broadcast(total)).join(runs, "regime")  # one row
    return out.select("regime", "n_rows", (F.col("n_rows") * 100.0 / F.col("n_total")).alias("percent"), "n_runs", F.col("q")[0].alias("median_s"), F.col("q")[1].alias("q25_s"), F.col("q")[2].alias("q75_s"))


def channel_stats(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Median and IQR of each channel, over all rows (regime NULL) and by regime."""
    long = df.select("regime", F.stack(F.lit(len(channels)), *(x for c in channels for x in (F.lit(c), F.col(c)))).alias("channel", "x"))
    sets = long.groupingSets([["channel"], ["channel", "regime"]], "channel", "regime")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return sets.agg(q.alias("q")).select("regime", "channel", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def flag_levels(df: DataFrame, flags: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Per control flag and level: rows, and mean and median of every analog channel."""
    pairs = [x for f in flags for x in (F.lit(f), F.col(f))]
    long = df.select(F.stack(F.lit(len(flags)), *pairs).alias("flag", "level"), *channels)
    stats = [s for c in channels for s in (F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{c}_median"))]
    return long.groupBy("flag", "level").agg(F.count("*").alias("n"), *stats)


def flag_agreement(df: DataFrame, polarity: dict[str, dict[int, str]]) -> DataFrame:
    """Share of rows on which each pair of flags says the same after its polarity map; unmapped never agrees."""

    def said(flag: str) -> Column:
        table = F.create_map(*(F.lit(x) for k, v in polarity[flag].items() for x in (k, v)))
        return F.try_element_at(table, F.col(flag).cast("int"))

    names = sorted(polarity)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = df.agg(*(F.avg(F.coalesce((said(a) == said(b)).cast("double"), F.lit(0.0))).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.stack(F.lit(len(pairs)), *(x for a, b in pairs for x in (F.lit(a), F.lit(b), F.col(f"{a}|{b}")))).alias("flag_a", "flag_b", "agreement"))


def monthly_summary(df: DataFrame, gap_us: int, stopped: str = "STOPPED", by: Sequence[str] = BY) -> DataFrame:
    """Per month: gaps (by their start) and the stopped label's runs (by their start), outer-joined."""
    month = lambda c: F.date_format(F.timestamp_micros(F.col(c)), "yyyy-MM")
    ahead = F.lead("us").over(series(by))
    gaps = df.select("us", (ahead - F.col("us")).alias("g")).where(F.col("g") > gap_us).groupBy(month("us").alias("month")).agg(F.count("*").alias("n_gaps"), (F.sum("g") / 1e6).alias("gap_s"))
    runs = run_table(df, "regime", gap_us, by).where(F.col("regime") == stopped).groupBy(month("start_us").alias("month")).agg(F.count("*").alias("n_runs"), F.percentile("duration_s", F.lit(0.5)).alias("median_run_s"))
    out = gaps.join(runs, "month", "full")
    return out.select("month", F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), F.coalesce("gap_s", F.lit(0.0)).alias("gap_s"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "median_run_s")
