"""Alert episodes: hysteresis grouping of scores, categories, rankings and fold results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EvaluationSettings, Event, SplitSettings, micros
from ..schema import US_PER_DAY, plan_table
from .folds import HOUR, at, masked_regions
from .intervals import clip, overlaps, total_us
from .ordered import coming
from .rank import weight

EARLY, CONCURRENT, MASKED, FALSE_ALARM = "early_warning", "concurrent", "masked", "false_alarm"


def _times(rows: DataFrame) -> tuple[list[str], str]:
    """The columns that order rows, and the one with the last time that a row stands for."""
    return (["us", "__until"], "__until") if "__until" in rows.columns else (["us"], "us")


def flag_episodes(scores: DataFrame, threshold: Column, hold_us: int, gap_us: int, by: Sequence[str]) -> DataFrame:
    """Adds `episode` to the rows of every episode, the dips inside it included; other rows get NULL.

    A row is above at score >= threshold (a missing score never is). Above rows begin a new episode after a coverage
    gap, or after at least one row below and more than `hold` since the last above row. A row may stand for a stretch of
    rows with one score and no coverage gap, from us to __until."""
    order, until = _times(scores)
    w = Window.partitionBy(*by).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    above = F.coalesce((F.col("score") >= threshold) & ~F.isnan("score"), F.lit(False))
    df = scores.withColumn("__above", above)
    df = df.withColumn("__cut", F.coalesce(F.col("us") - F.lag(until).over(w) > gap_us, F.lit(True)).cast("int"))
    df = df.withColumn("__segment", F.sum("__cut").over(up_to))
    inside = Window.partitionBy(*by, "__segment").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__last", F.last(F.when(F.col("__above"), F.col(until)), True).over(earlier)).withColumn("__before", F.lag("__above").over(inside))
    new = F.col("__last").isNull() | (~F.col("__before") & (F.col("us") - F.col("__last") > hold_us))
    df = df.withColumn("__new", F.when(F.col("__above") & new, 1).otherwise(0))
    df = df.withColumn("__id", F.when(F.col("__above"), F.sum("__new").over(up_to)))
    begun = F.last("__id", True).over(up_to)
    df = df.withColumn("__begun", begun).withColumn("__ending", coming("__id", by, order))
    df = df.withColumn("episode", F.when(F.col("__begun") == F.col("__ending"), F.col("__begun")))
    return df.drop("__above", "__cut", "__segment", "__last", "__before", "__new", "__id", "__begun", "__ending")


def episodes(flagged: DataFrame, by: Sequence[str], min_duration_us: int = 0) -> DataFrame:
    """(by, episode, start_us, end_us, peak, n_rows); shorter ones than min_duration go."""
    out = flagged.where("episode is not null").groupBy(*by, "episode").agg(F.min("us").alias("start_us"), F.max(_times(flagged)[1]).alias("end_us"), F.max("score").alias("peak"), F.sum(weight(flagged).cast("long")).alias("n_rows"))
    return out.where(F.col("end_us") - F.col("start_us") >= min_duration_us) if min_duration_us > 0 else out


def rank_contributions(flagged: DataFrame, names: Sequence[str], by: Sequence[str], method: str = "mean") -> DataFrame:
    """(by, episode, place, contributor, value): contributions over all rows of each episode, largest first; ties by name, missing last.

    Means are summed in time order: the last bits of a sum depend on its order, and with them places and rounded halves."""
    if not names:
        raise ValueError("no contributors")
    if method not in ("mean", "max"):
        raise ValueError(f"unknown aggregation {method!r}")
    rows, keys = flagged.where("episode is not null"), [*by, "episode"]
    cells = [f"__{k}" for k in range(len(names))]
    if method == "mean":
        timed = Window.partitionBy(*keys).orderBy("us")
        whole = timed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        wide = rows.select(*keys, *(F.avg(n).over(whole).alias(c) for n, c in zip(names, cells)), F.row_number().over(timed).alias("__row")).where("__row = 1")
    else:
        wide = rows.groupBy(*keys).agg(*(F.max(n).alias(c) for n, c in zip(names, cells)))
    pairs = [x for n, c in zip(names, cells) for x in (F.lit(n), F.col(c))]
    out = wide.select(*keys, F.stack(F.lit(len(names)), *pairs).alias("contributor", "value"))
    w = Window.partitionBy(*by, "episode").orderBy(F.col("value").desc_nulls_last(), "contributor")
    return out.withColumn("place", F.row_number().over(w))


def categorise(eps: DataFrame, events: DataFrame, masks: DataFrame, width_h: Column) -> DataFrame:
    """Adds category by event_id: early_warning before concurrent before masked before false_alarm; overlaps are closed.
    events: (event_id, event_start_us, event_end_us); masks: (start_us, end_us). Both have a row per event or region."""
    e = eps.join(F.broadcast(events), "event_id")
    regions = masks.agg(F.collect_list(F.struct("start_us", "end_us")).alias("__masks"))  # configured regions only
    e = e.crossJoin(F.broadcast(regions))
    warn = overlaps(F.col("start_us"), F.col("end_us"), F.col("event_start_us") - (width_h * HOUR).cast("long"), F.col("event_start_us"))
    during = overlaps(F.col("start_us"), F.col("end_us"), F.col("event_start_us"), F.col("event_end_us"))
    masked = F.exists("__masks", lambda m: overlaps(F.col("start_us"), F.col("end_us"), m["start_us"], m["end_us"]))
    return e.withColumn("category", F.when(warn, EARLY).when(during, CONCURRENT).when(masked, MASKED).otherwise(FALSE_ALARM)).drop("__masks")


def event_table(spark, events: Sequence[Event]) -> DataFrame:
    return plan_table(spark, [(e.id, at(e.start), at(e.end)) for e in events], "event_id int, event_start_us long, event_end_us long")


def mask_table(spark, events: Sequence[Event], s: SplitSettings) -> DataFrame:
    return plan_table(spark, [(a, b, i) for a, b, i in masked_regions(events, s)], "start_us long, end_us long, event_id int")


def evaluated_days(scores: DataFrame, periods: DataFrame, masks: DataFrame, gap_us: int, by: Sequence[str]) -> DataFrame:
    """(by, days): each period less the union of masks and of the holes between its scored rows.
    periods: (by, lo, hi), one row per fold or stretch; leading and trailing holes are not subtracted."""
    order, until = _times(scores)
    w = Window.partitionBy(*by).orderBy(*order)
    holes = scores.select(*by, F.lag(until).over(w).alias("start_us"), F.col("us").alias("end_us")).where(F.col("end_us") - F.col("start_us") > gap_us)
    m = periods.crossJoin(F.broadcast(masks.select("start_us", "end_us")))  # periods x configured regions
    m = clip(m, F.col("lo"), F.col("hi")).select(*by, "start_us", "end_us")
    h = clip(holes.join(periods, [*by]), F.col("lo"), F.col("hi")).select(*by, "start_us", "end_us")
    gone = total_us(m.unionByName(h), by)
    left = F.col("hi") - F.col("lo") - F.coalesce("total_us", F.lit(0))
    return periods.join(gone, [*by], "left").select(*by, (F.greatest(left, F.lit(0)) / US_PER_DAY).alias("days"))


def fold_results(categorised: DataFrame, days: DataFrame, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """Per fold: detection, lead time, counts by category and false alarms a day. days has a row for every fold."""
    early = F.col("category") == EARLY
    g = categorised.groupBy(*keys).agg(
        F.count("*").alias("n_episodes"),
        F.count_if(F.col("category") == FALSE_ALARM).alias("n_false_alarms"),
        F.count_if(F.col("category") == MASKED).alias("n_masked"),
        F.bool_or(early).alias("detected"),
        F.bool_or(F.col("category") == CONCURRENT).alias("any_concurrent"),
        F.min(F.when(early, F.col("start_us"))).alias("first_us"),
        F.first("event_start_us").alias("event_start_us"),
    )
    out = days.join(g, [*keys], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = F.coalesce("detected", F.lit(False))
    rate = F.when(F.col("days") > 0, F.coalesce("n_false_alarms", F.lit(0)) / F.col("days")).otherwise(0.0)
    return out.select(*keys, zero("n_episodes"), zero("n_false_alarms"), zero("n_masked"), found.alias("detected"), (~found & F.coalesce("any_concurrent", F.lit(False))).alias("concurrent_only"), ((F.col("event_start_us") - F.col("first_us")) / 3.6e9).alias("lead_h"), "days", rate.alias("false_alarms_per_day"))


def pooled_rate(eps: DataFrame, days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All stretches together: episodes (every one a false alarm), days and rate."""
    n = eps.groupBy(*keys).agg(F.count("*").alias("n_episodes"))
    d = days.groupBy(*keys).agg(F.sum("days").alias("days"))
    out = d.join(n, [*keys], "left") if keys else d.crossJoin(n)
    return out.select(*keys, F.coalesce("n_episodes", F.lit(0)).alias("n_episodes"), "days", F.when(F.col("days") > 0, F.coalesce("n_episodes", F.lit(0)) / F.col("days")).otherwise(0.0).alias("rate"))


def episode_settings(v: EvaluationSettings) -> tuple[int, int, int]:
    return micros(v.hold), micros(v.score_gap), micros(v.min_duration)
