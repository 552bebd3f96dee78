"""Scalers fitted on training rows and applied to any rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScalingSettings

METHODS = ("robust", "standard", "minmax")


def _long(df: DataFrame, channels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    pairs = [x for c in channels for x in (F.lit(c), F.col(c))]
    return df.select(*keys, F.stack(F.lit(len(channels)), *pairs).alias("channel", "x"))


def fit(df: DataFrame, channels: Sequence[str], method: str = "robust", keys: Sequence[str] = (), epsilon: float = 1e-8) -> DataFrame:
    """(keys, channel, center, scale, n) of each channel; a scale below epsilon becomes 1."""
    if method not in METHODS:
        raise ValueError(f"unknown scaling {method!r}")
    x = F.col("x")
    grouped = _long(df, channels, keys).groupBy(*keys, "channel")
    if method == "robust":
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        out = grouped.agg(q.alias("q"), F.count("*").alias("n")).select(*keys, "channel", F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("scale"), "n")
    elif method == "standard":
        out = grouped.agg(F.avg(x).alias("center"), F.stddev_pop(x).alias("scale"), F.count("*").alias("n"))
    else:
        out = grouped.agg(F.min(x).alias("center"), (F.max(x) - F.min(x)).alias("scale"), F.count("*").alias("n"))
    return out.withColumn("scale", F.when(F.abs("scale") < epsilon, F.lit(1.0)).otherwise(F.col("scale")))


def fit_by_regime(df: DataFrame, s: ScalingSettings, keys: Sequence[str] = ("scope_id",)) -> DataFrame:
    """fit() by regime; raises for a regime without active channels or with too few rows."""
    out = fit(df, s.channels, s.method, [*keys, "regime"], s.zero_epsilon)
    for r in out.groupBy(*keys, "regime").agg(F.max("n").alias("n")).collect():  # scopes x regimes
        if s.active and r["regime"] not in s.active:
            raise ValueError(f"regime {r['regime']} has no list of active channels")
        if r["n"] < s.min_samples:
            raise ValueError(f"{r.asDict()}: fewer than {s.min_samples} rows")
    return out


def amplifying(scalers: DataFrame, s: ScalingSettings) -> DataFrame:
    """Active channels whose values a scaler multiplies by more than warn_factor."""
    active = F.lit(not s.active)
    for regime, names in s.active.items():
        active = active | ((F.col("regime") == regime) & F.col("channel").isin(list(names)))
    return scalers.where(active & (1 / F.col("scale") > s.warn_factor))


def transform(df: DataFrame, scaler: DataFrame, channels: Sequence[str], passthrough: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """(x - center) / scale of the channels; the other columns unchanged. scaler: a few rows per key."""
    known = {r[0] for r in scaler.select("channel").distinct().collect()}
    if missing := [c for c in channels if c not in known]:
        raise ValueError(f"no scaler for {missing}")
    wide = scaler.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("center", "scale")))).alias("__s"))
    joined = df.join(wide, [*keys]) if keys else df.crossJoin(F.broadcast(wide))  # one row
    scaled: list[Column] = [((F.col(c) - F.col("__s")[c]["center"]) / F.col("__s")[c]["scale"]).alias(c) if c in channels else F.col(c) for c in df.columns]
    return joined.select(*scaled)


def transform_by_regime(df: DataFrame, scaler: DataFrame, s: ScalingSettings, keys: Sequence[str] = ()) -> DataFrame:
    """Each row by its own regime's scaler; an inactive channel becomes 0. Raises for a regime without scaler."""
    wide = scaler.groupBy(*keys, "regime").agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("center", "scale")))).alias("__s"))
    joined = df.join(wide, [*keys, "regime"], "left")
    joined = joined.withColumn("__s", F.coalesce("__s", F.raise_error(F.concat(F.lit("no scaler for regime "), "regime")).cast("map<string,struct<center:double,scale:double>>")))
    out: list[Column] = []
    for c in df.columns:
        if c not in s.channels:
            out.append(F.col(c))
            continue
        active = F.lit(not s.active)
        for regime, names in s.active.items():
            if c in names:
                active = active | (F.col("regime") == regime)
        out.append(F.when(active, (F.col(c) - F.col("__s")[c]["center"]) / F.col("__s")[c]["scale"]).otherwise(F.lit(0.0)).alias(c))
    return joined.select(*out)
