"""Online forms of the causal operators: the same labels, row by row, with the state of a series carried between batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RegimeSettings, micros

STATE = "raw string, raw_us long, committed string, changed_us long, last_us long"
OUT = "asset_id string, us long, regime string"


def raw_label(row: Any, s: RegimeSettings) -> str:
    for name, flags in s.states.items():
        if all(getattr(row, f) == v for f, v in flags.items()):
            return name
    x = getattr(row, s.split_channel)
    return s.above if x is not None and x >= s.split_at else s.below


def step(state: tuple | None, us: int, raw: str, s: RegimeSettings) -> tuple[tuple, str]:
    """The state after one row, and the row's regime. state: (raw, since, committed, changed, last time)."""
    before, since, committed, changed, _ = state or (None, us, None, us, us)
    if raw != before:
        since = us
    now = committed
    if now is None:
        now = raw
    if us - since >= micros(s.min_duration):
        now = raw
    if now != committed:
        changed = us
    label = s.transition if us - changed <= micros(s.settle) else now
    return (raw, since, now, changed, us), label


def online_regimes(stream: DataFrame, s: RegimeSettings, watermark: str = "1 hour") -> DataFrame:
    """Regime labels of a stream of (asset_id, ts, us, flags, channel) rows. Rows of a batch are ordered by time within
    their series; a row earlier than what its series has already seen is dropped, as is one behind the watermark."""

    def label(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("us", kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            if now is not None and row.us <= now[4]:
                continue
            now, regime = step(now, int(row.us), raw_label(row, s), s)
            out.append((key[0], int(row.us), regime))
        if now is not None:
            state.update(now)
        yield pd.DataFrame(out, columns=["asset_id", "us", "regime"])

    return stream.withWatermark("ts", watermark).groupBy("asset_id").applyInPandasWithState(label, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, width: str = "1 hour", watermark: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling or (with a slide) sliding windows of a stream: mean of value and rows by series, emitted when the watermark has passed."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", width, slide), "asset_id").agg(F.avg("value").alias("value"), F.count("*").alias("n")).select("asset_id", F.col("window.start").alias("start"), "value", "n")


def session_counts(stream: DataFrame, gap: str, watermark: str = "1 hour") -> DataFrame:
    """Stretches of a stream's series without a hole of `gap` or more: start, end of the last row's window, rows."""
    return stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "asset_id").agg(F.count("*").alias("n")).select("asset_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


ALERT_STATE = "start_us long, last_us long, seen_us long, below boolean, peak double"
ALERT_OUT = "asset_id string, start_us long, end_us long, peak double"


def alert_step(state: tuple | None, us: int, score: float | None, threshold: float, hold_us: int, gap_us: int) -> tuple[tuple, tuple | None]:
    """The state after one row, and the episode (start, end, peak) that the row proves ended. state: (start of the open
    episode or None, its last row above, last row seen, whether a row below has followed, peak)."""
    start, last, seen, below, peak = state or (None, None, us, False, None)
    done, above = None, score is not None and score >= threshold
    ended = start is not None and (us - seen > gap_us or (us - last > hold_us and (below or not above)))
    if ended:
        done, start = (start, last, peak), None
    if above:
        start, last, below, peak = (us, us, False, score) if start is None else (start, us, False, max(peak, score))
    elif start is not None:
        below = True
    return (start, last, us, below, peak), done


def online_alerts(stream: DataFrame, threshold: float, hold_us: int, gap_us: int, watermark: str = "1 hour") -> DataFrame:
    """Alert episodes of a stream of (asset_id, ts, us, score), each emitted once a later row of its series shows that it has
    ended; the same as the batch's, whose last episode may still be open here."""

    def alerts(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = tuple(state.get) if state.exists else None, []
        for row in pd.concat(list(frames)).sort_values("us", kind="stable").itertuples(index=False):
            if now is not None and row.us <= now[2]:
                continue
            now, done = alert_step(now, int(row.us), None if pd.isna(row.score) else float(row.score), threshold, hold_us, gap_us)
            if done:
                out.append((key[0], *done))
        if now is not None:
            state.update(now)
        yield pd.DataFrame(out, columns=["asset_id", "start_us", "end_us", "peak"])

    return stream.withWatermark("ts", watermark).groupBy("asset_id").applyInPandasWithState(alerts, ALERT_OUT, ALERT_STATE, "append", GroupStateTimeout.NoTimeout)
