"""Experiments: arms and profiles of the forest, restartable runs by fold, a time budget, and a text report."""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Region, Settings
from ..operators import chance
from ..sources.files import restartable

# fixed values: the evaluation grid, the sweep's size, and the region that arm b keeps out of training
QUANTILES = (0.995, 0.999, 0.9995, 0.9999)
SWEEP_TREES, SWEEP_STRIDE = 100, "5min"
ARM_B = Region(datetime(2020, 3, 3), datetime(2020, 3, 12))


def experiment(s: Settings, profile: str = "sweep", arm: str = "a", widths: Sequence[float] | None = None, quantiles: Sequence[float] | None = None, regions: Sequence[Region] = (ARM_B,)) -> Settings:
    """Settings of a run. Profile sweep has fewer trees and a coarser scoring stride than final; arm b also excludes regions."""
    if profile not in ("sweep", "final"):
        raise ValueError(f"unknown profile {profile!r}")
    if arm not in ("a", "b"):
        raise ValueError(f"unknown arm {arm!r}")
    v = replace(s.evaluation, quantiles=tuple(quantiles or QUANTILES), widths_h=tuple(widths or s.evaluation.widths_h))
    out = replace(s, evaluation=v)
    if profile == "sweep":
        out = replace(out, forest=replace(s.forest, trees=SWEEP_TREES), windows=replace(s.windows, stride_score=SWEEP_STRIDE))
    return replace(out, split=replace(s.split, regions=(*s.split.regions, *regions))) if arm == "b" else out


class BudgetExceeded(RuntimeError):
    pass


@contextmanager
def budget(minutes: float) -> Iterator[None]:
    """Raises BudgetExceeded in the main thread when the block takes longer; jobs of Spark end with the driver's call."""

    def stop(signum: int, frame: Any) -> None:
        raise BudgetExceeded(f"the run took more than {minutes} minutes")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, minutes * 60)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def by_fold(spark, path: str, events: Sequence[int], run: Callable[[int], DataFrame]) -> tuple[DataFrame, dict[int, float]]:
    """run(event) of every fold, kept below path, so that a run that was stopped goes on where it was; and the seconds taken."""
    took: dict[int, float] = {}

    def timed(event: int) -> DataFrame:
        took[event] = time.monotonic()
        return run(event)

    out = restartable(spark, path, events, timed)
    ends = [*list(took.values())[1:], time.monotonic()]
    return out, {e: end - began for (e, began), end in zip(took.items(), ends, strict=True)}


def summary(results: DataFrame) -> DataFrame:
    """Observed and expected detections by width and quantile, and the probability of so many by chance."""
    return chance.skill(results, ["width_h", "quantile"])


def report(results: DataFrame, pooled: DataFrame, explanations: DataFrame | None = None, took: dict[int, float] | None = None) -> list[str]:
    """Lines of text: skill, each detection with its explanation, pooled false alarms, seconds. Reads one row a fold, width and quantile."""
    out = [f"width={r['width_h']:g}h q={r['quantile']:g} observed={r['observed']} expected={r['expected']:.3f} p(X>=observed)={r['p_skill']:.3f}" for r in summary(results).orderBy("width_h", "quantile").collect()]
    tops: dict[tuple, list[str]] = {}
    if explanations is not None:
        for r in explanations.orderBy("event_id", "asset_id", "quantile", "episode", "place").collect():
            tops.setdefault((r["event_id"], r["asset_id"], r["quantile"]), []).append(f"episode {r['episode']}: {r['contributor']}={r['value']:.4f}")
    for r in results.where("detected").orderBy("event_id", "asset_id", "width_h", "quantile").collect():
        out.append(f"event={r['event_id']} asset={r['asset_id']} width={r['width_h']:g}h q={r['quantile']:g} lead={r['lead_h']:.2f}h fa/day={r['false_alarms_per_day']:.3f} false={r['n_false_alarms']} days={r['days']:.2f} p_poisson={r['p_poisson']:.3f} p_perm={r['p_permutation']:.3f} by_chance={r['explained_by_chance']}")
        out += [f"    {x}" for x in tops.get((r["event_id"], r["asset_id"], r["quantile"]), [])]
    for r in pooled.orderBy("event_id", "asset_id", "quantile").collect():
        out.append(f"event={r['event_id']} asset={r['asset_id']} q={r['quantile']:g} pooled: false={r['n_episodes']} days={r['days']:.2f} fa/day={r['rate']:.4f}")
    return out + [f"event={e} seconds={s:.1f}" for e, s in (took or {}).items()]


def gap_diagnostic(shares: DataFrame) -> DataFrame:
    """gap_share() as one row a series: the overall share of gap-adjacent rows and the largest among its episodes."""
    by = [c for c in shares.columns if c not in ("episode", "share")]
    return shares.groupBy(*by).agg(F.max(F.when(F.col("episode").isNull(), F.col("share"))).alias("overall"), F.max(F.when(F.col("episode").isNotNull(), F.col("share"))).alias("worst_episode"), F.count("episode").alias("n_episodes"))
