"""What detection by chance would look like, and the choice of an operating point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def poisson(rate_per_day: Column, width_h: Column) -> Column:
    """Probability of at least one false alarm within the window."""
    return 1 - F.exp(-rate_per_day * width_h / 24)


def permutation(eps: DataFrame, periods: DataFrame, samples: int, by: Sequence[str]) -> DataFrame:
    """(by, p_permutation, n_valid): share of evenly spaced window ends (both period ends included) whose window [t - width, t]
    fits the period and overlaps an episode. periods: (by, lo, hi, width_us), one row per fold and width."""
    if samples < 2:
        raise ValueError("at least two placements are needed")
    p = periods.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    t = F.col("lo") + F.floor(F.col("i") * (F.col("hi") - F.col("lo")) / (samples - 1)).cast("long")
    p = p.withColumn("t", t).where(F.col("t") - F.col("width_us") >= F.col("lo"))
    # an episode overlaps [t - width, t] if one that has begun by t ends at t - width or later: one ordered pass, no pairs
    e = eps.select(*by, F.col("start_us").alias("t"), F.col("end_us").alias("__end"), F.lit(None).cast("long").alias("width_us"))
    both = p.select(*by, "t", F.lit(None).cast("long").alias("__end"), "width_us").unionByName(e)
    so_far = Window.partitionBy(*by).orderBy("t", F.col("width_us").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__last", F.max("__end").over(so_far)).where("width_us is not null")
    hit = F.coalesce(F.col("__last") >= F.col("t") - F.col("width_us"), F.lit(False)).cast("double")
    return both.groupBy(*by).agg(F.avg(hit).alias("p_permutation"), F.count("*").alias("n_valid"))


def compare(results: DataFrame, threshold: float) -> DataFrame:
    """Adds explained_by_chance: detected, and either probability above the threshold."""
    return results.withColumn("explained_by_chance", F.col("detected") & ((F.col("p_poisson") > threshold) | (F.col("p_permutation") > threshold)))


def survival(ps: Column, observed: Column) -> Column:
    """P(X >= observed) of a sum of independent trials with probabilities ps (an array), by dynamic programming."""
    start = F.array(F.lit(1.0))
    step = lambda acc, p: F.zip_with(F.concat(acc, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), acc), lambda a, b: a * (1 - p) + b * p)
    law = F.aggregate(ps, start, step)
    return F.aggregate(F.slice(law, observed + 1, F.size(law)), F.lit(0.0), lambda a, b: a + b)


def skill(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: expected and observed detections, and the probability of at least as many by chance."""
    g = results.groupBy(*keys).agg(F.sum("p_permutation").alias("expected"), F.count_if("detected").cast("int").alias("observed"), F.array_sort(F.collect_list("p_permutation")).alias("ps"))
    return g.select(*keys, "expected", "observed", survival(F.col("ps"), F.col("observed")).alias("p_skill"))


def operating_point(pooled: DataFrame, ceiling: float) -> DataFrame:
    """One row: the loosest quantile whose worst pooled rate over the folds is within the ceiling, and all worst rates."""
    worst = pooled.groupBy("quantile").agg(F.max("rate").alias("worst"))
    out = worst.agg(F.min(F.when(F.col("worst") <= ceiling, F.col("quantile"))).alias("quantile"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("quantile", "worst")))).alias("worst_rates"))
    return out.select(F.col("quantile").isNotNull().alias("found"), "quantile", "worst_rates")
