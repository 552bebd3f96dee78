"""Thresholds and ranks against a training distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weight(df: DataFrame) -> Column:
    """How many rows a row stands for: __n, or itself."""
    return F.col("__n") if "__n" in df.columns else F.lit(1)


def thresholds(train: DataFrame, score: str, quantiles: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, quantile, threshold): linear quantiles of the training scores, NULLs skipped. Rows may be packed (__n)."""
    qs = F.array(*(F.lit(float(q)) for q in quantiles))
    out = train.groupBy(*keys).agg(F.percentile(score, qs, weight(train)).alias("t"))
    return out.select(*keys, F.explode(F.arrays_zip(qs.alias("q"), F.col("t").alias("t"))).alias("z")).select(*keys, F.col("z.q").alias("quantile"), F.col("z.t").alias("threshold"))


def percentile_rank(train: DataFrame, rows: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds (count below + count at or below) / 2n of `value` among the training values; 0.5 without training values,
    NULL for a missing value. Both sets are reduced to counts by distinct value first; the cumulative counts are one
    window per key over distinct values, and rows get theirs by an equi-join."""
    named = [*keys]
    t = train.where(F.col(value).isNotNull()).groupBy(*named, value).agg(F.count("*").alias("__t"))
    r = rows.where(F.col(value).isNotNull()).select(*named, value).distinct().withColumn("__t", F.lit(0).cast("long"))
    points = t.unionByName(r).groupBy(*named, value).agg(F.sum("__t").alias("__t"))
    w = Window.partitionBy(*named).orderBy(value)
    upto = F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("__t").over(Window.partitionBy(*named))
    ranks = points.select(*named, value, F.when(n == 0, F.lit(0.5)).otherwise((2 * upto - F.col("__t")) / (2.0 * n)).alias(out))
    return rows.join(ranks, [*named, value], "left")


def percentile_ranks(df: DataFrame, in_train: str, values: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """percentile_rank() of several values at once, where one frame holds training and other rows (in_train: true or false):
    adds value: out for each to all rows. A value costs a sort within the keys; nothing is joined."""
    t = {v: F.when(F.col(v).isNotNull(), F.col(in_train).cast("long")).otherwise(F.lit(0)) for v in values}
    df = df.withColumns({f"__n_{v}": F.sum(t[v]).over(Window.partitionBy(*keys)) for v in values})
    for value, out in values.items():
        upto = F.sum(t[value]).over(Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
        equal = F.sum(t[value]).over(Window.partitionBy(*keys, value))  # the same sort; a frame of equal rows would be kept in memory
        df = df.withColumn("__upto", upto).withColumn("__equal", equal)
        n = F.col(f"__n_{value}")
        share = F.when(n == 0, F.lit(0.5)).otherwise((2 * F.col("__upto") - F.col("__equal")) / (2.0 * n))
        df = df.withColumn(out, F.when(F.col(value).isNotNull(), share)).drop("__upto", "__equal", f"__n_{value}")
    return df


def score_shift(train: DataFrame, test: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median, 99th percentile and maximum of both score sets, and the share of test scores above the training p99.
    Rows may be packed (__n)."""
    stats = lambda df, p: df.groupBy(*keys).agg(F.percentile(score, F.array(F.lit(0.5), F.lit(0.99)), weight(df)).alias(f"{p}_q"), F.max(score).alias(f"{p}_max"))
    tr = stats(train, "train")
    joined = test.join(tr, [*keys]) if keys else test.crossJoin(F.broadcast(tr))
    over, n = F.col(score) > F.col("train_q")[1], weight(test)
    above = joined.groupBy(*keys).agg((F.sum(F.when(over, n).when(~over, 0)) / F.sum(F.when(over.isNotNull(), n))).alias("share_above_p99"))
    te = stats(test, "test")
    out = tr.join(te, [*keys], "left").join(above, [*keys], "left") if keys else tr.crossJoin(te).crossJoin(above)
    return out.select(*keys, F.col("train_q")[0].alias("train_median"), F.col("train_q")[1].alias("train_p99"), "train_max", F.col("test_q")[0].alias("test_median"), F.col("test_q")[1].alias("test_p99"), "test_max", "share_above_p99")
