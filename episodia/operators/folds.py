"""Walk-forward folds around documented events. The plan has one row per event, so it is made on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EvaluationSettings, Event, SplitSettings, micros
from ..schema import US_PER_DAY, plan_table
from .intervals import without

HOUR = 3_600_000_000


def at(t: datetime) -> int:
    """Microseconds since the epoch of a naive UTC time."""
    return round((t.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


@dataclass(frozen=True)
class Fold:
    event_id: int
    train_start: int
    train_end: int
    test_start: int
    test_end: int
    exclusions: tuple[tuple[int, int], ...]
    width_h: float


def merge(intervals: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def exclusion(e: Event, s: SplitSettings) -> tuple[int, int]:
    """From the pre-margin to settling after maintenance, or to the fallback after the end."""
    end = at(e.maintenance) + micros(s.post_settle) if e.maintenance else at(e.end) + micros(s.fallback_post)
    return at(e.start) - micros(s.pre_margin), end


def mask_end(e: Event, s: SplitSettings) -> int:
    """When scores count again: settling after the later of end and maintenance, or the fallback after the end."""
    return max(at(e.end), at(e.maintenance)) + micros(s.post_settle) if e.maintenance else at(e.end) + micros(s.fallback_post)


def masked_regions(events: Sequence[Event], s: SplitSettings) -> list[tuple[int, int, int | None]]:
    """(start, end, event id or None), by start."""
    own = [(at(e.start), mask_end(e, s), e.id) for e in events]
    return sorted([*own, *((at(r.start), at(r.end), None) for r in s.regions)], key=lambda x: x[:2])


def training_periods(f: Fold) -> tuple[tuple[int, int], ...]:
    """What is left of [train_start, train_end) outside every exclusion, half-open."""
    edge, out = f.train_start, []
    for a, b in merge(f.exclusions):
        out.append((edge, min(a, f.train_end)))
        edge = max(edge, b)
    return tuple((a, b) for a, b in [*out, (edge, f.train_end)] if a < b)


def training_days(f: Fold) -> float:
    return max(0, f.train_end - f.train_start - sum(b - a for a, b in f.exclusions)) / US_PER_DAY


def make_folds(events: Sequence[Event], widths_h: Sequence[float], s: SplitSettings, data_start: int, data_end: int, width_by_event: dict[int, float] | None = None) -> list[Fold]:
    """One fold per event, by start. Raises where windows reach into an earlier event's exclusion or training is too short."""
    if not widths_h and not width_by_event:
        raise ValueError("no widths given")
    events = sorted(events, key=lambda e: e.start)
    width = {e.id: width_by_event[e.id] if width_by_event else max(widths_h) for e in events}
    embargo = micros(s.embargo)
    for i, later in enumerate(events):
        for earlier in events[:i]:
            start, end = at(later.start) - int(width[later.id] * HOUR), exclusion(earlier, s)[1]
            if start < end:
                raise ValueError(f"the window of event {later.id} reaches into the exclusion of event {earlier.id}")
            if start - embargo < end:
                raise ValueError(f"the test start of event {later.id} reaches into the exclusion of event {earlier.id}")
    out = []
    for e in events:
        test_start = at(e.start) - int(width[e.id] * HOUR) - embargo
        train_end = test_start - embargo
        test_end = max(at(e.end), at(e.maintenance)) if e.maintenance else at(e.end)
        if test_end > data_end:
            raise ValueError(f"event {e.id} ends after the data")
        if train_end <= data_start:
            raise ValueError(f"no training data before event {e.id}")
        holes = [exclusion(x, s) for x in events] + [(at(r.start), at(r.end)) for r in s.regions]
        holes = [(max(a, data_start), min(b, train_end)) for a, b in holes if b > data_start and a < train_end]
        fold = Fold(e.id, data_start, train_end, test_start, test_end, tuple(merge(holes)), width[e.id])
        if training_days(fold) < s.min_train_days:
            raise ValueError(f"fold {e.id} keeps {training_days(fold):.1f} training days")
        out.append(fold)
    return out


def max_width_h(events: Sequence[Event], s: SplitSettings, data_start: int) -> dict[int, float]:
    """The largest feasible window width of each event, in hours."""
    events, embargo, out = sorted(events, key=lambda e: e.start), micros(s.embargo), {}
    for i, e in enumerate(events):
        room = [at(e.start) - 2 * embargo - data_start - 1_000_000]
        room += [at(e.start) - embargo - exclusion(x, s)[1] for x in events[:i]]
        out[e.id] = max(0, min(room)) / HOUR
    return out


def extended(f: Fold, events: Sequence[Event], s: SplitSettings, data_end: int) -> Fold:
    """The fold with its test period drawn out to the next event's exclusion (or the data's end), for counting false alarms."""
    events = sorted(events, key=lambda e: e.start)
    start = next(at(e.start) for e in events if e.id == f.event_id)
    later = [e for e in events if at(e.start) > start]
    return replace(f, test_end=max(f.test_end, exclusion(later[0], s)[0] if later else data_end))


def normal_stretches(events: Sequence[Event], s: SplitSettings, v: EvaluationSettings, data_start: int, data_end: int) -> list[tuple[int, int]]:
    """What is left of the data between events, masks, windows and buffers."""
    buffer, width = micros(v.pooled_buffer), int(max(v.widths_h) * HOUR)
    holes = [(at(e.start) - width - buffer, mask_end(e, s) + buffer) for e in events]
    holes += [(at(r.start) - buffer, at(r.end) + buffer) for r in s.regions]
    edge, out = data_start, []
    for a, b in merge(holes):
        if min(a, data_end) > edge:
            out.append((edge, min(a, data_end)))
        edge = max(edge, b)
    if data_end > edge:
        out.append((edge, data_end))
    return out


FOLDS = "event_id int, train_start long, train_end long, test_start long, test_end long, width_h double, exclusions array<struct<start_us:long,end_us:long>>"


def fold_table(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    return plan_table(spark, [(f.event_id, f.train_start, f.train_end, f.test_start, f.test_end, float(f.width_h), list(f.exclusions)) for f in folds], FOLDS)


def train_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of [train_start, train_end) outside every exclusion [s, e), keyed by event_id. folds: one row per event."""
    f = F.broadcast(folds.select("event_id", "train_start", "train_end"))
    rows = df.join(f, (F.col("us") >= F.col("train_start")) & (F.col("us") < F.col("train_end"))).drop("train_start", "train_end")
    holes = folds.select("event_id", F.explode("exclusions").alias("x")).select("event_id", "x.start_us", "x.end_us")
    return without(rows, holes, ["event_id"])


def test_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of [test_start, test_end], keyed by event_id."""
    f = F.broadcast(folds.select("event_id", "test_start", "test_end"))
    return df.join(f, F.col("us").between(F.col("test_start"), F.col("test_end"))).drop("test_start", "test_end")


def fold_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of [train_start, test_end], exclusions included, keyed by event_id: the history that scoring sees."""
    f = F.broadcast(folds.select("event_id", "train_start", "test_end"))
    return df.join(f, F.col("us").between(F.col("train_start"), F.col("test_end"))).drop("train_start", "test_end")


def scoped(df: DataFrame, stretches: DataFrame) -> DataFrame:
    """Rows of each closed stretch (scope_id, start_us, end_us), keyed by scope_id. stretches: a plan-sized table."""
    s = F.broadcast(stretches.select("scope_id", F.col("start_us").alias("__s"), F.col("end_us").alias("__e")))
    return df.join(s, F.col("us").between(F.col("__s"), F.col("__e"))).drop("__s", "__e")


def window_coverage(df: DataFrame, events: Sequence[Event], widths_h: Sequence[float], interval_us: int, by: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Share of the expected rows that each pre-failure window [start - width, start) holds, by series."""
    params = [(e.id, float(w), at(e.start) - int(w * HOUR), at(e.start)) for e in events for w in widths_h]
    p = F.broadcast(df.sparkSession.createDataFrame(params, "event_id int, width_h double, lo long, hi long"))
    keys = df.select(*by).distinct().crossJoin(p)  # series x windows: a plan-sized table
    found = df.join(p, (F.col("us") >= F.col("lo")) & (F.col("us") < F.col("hi"))).groupBy(*by, "event_id", "width_h").count()
    out = keys.join(found, [*by, "event_id", "width_h"], "left")
    expected = (F.col("hi") - F.col("lo")) / float(interval_us)
    share = F.when(expected > 0, F.least(F.lit(1.0), F.coalesce("count", F.lit(0)) / expected)).otherwise(0.0)
    return out.select(*by, "event_id", "width_h", share.alias("coverage"))
