"""Interval algebra on (start_us, end_us) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals that share a point."""
    return (a_start <= b_end) & (b_start <= a_end)


def union(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Coalesced intervals; touching ones merge."""
    w = Window.partitionBy(*by).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(reach.isNull() | (F.col("start_us") > reach), 1).otherwise(0))
    grouped = marked.withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "__group").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("__group")


def clip(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The parts within [lo, hi]; empty parts go."""
    out = df.withColumn("start_us", F.greatest("start_us", lo)).withColumn("end_us", F.least("end_us", hi))
    return out.where("end_us > start_us")


def complement(df: DataFrame, lo_us: int, hi_us: int) -> DataFrame:
    """The holes of positive length that the intervals leave in [lo, hi]."""
    merged = union(clip(df, F.lit(lo_us), F.lit(hi_us)).select("start_us", "end_us"))
    edges = merged.unionByName(df.sparkSession.createDataFrame([(hi_us, hi_us)], "start_us long, end_us long"))
    w = Window.partitionBy().orderBy("start_us", "end_us")
    begin = F.coalesce(F.lag("end_us").over(w), F.lit(lo_us))
    return edges.select(begin.alias("a"), F.col("start_us").alias("b")).where("b > a").select(F.col("a").alias("start_us"), F.col("b").alias("end_us"))


def total_us(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Length of the union, by key."""
    return union(df, by).groupBy(*by).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"))


def without(rows: DataFrame, holes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose `us` lies in no hole [start, end). holes: a plan-sized table (one row per event or region)."""
    h = F.broadcast(holes.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("start_us").alias("__s"), F.col("end_us").alias("__e")))
    on = (F.col("us") >= F.col("__s")) & (F.col("us") < F.col("__e"))
    for c in by:
        on = on & (rows[c] == F.col(f"__{c}"))
    return rows.join(h, on, "left_anti")
