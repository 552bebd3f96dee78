"""Operator 10, sharding by minimax contiguous partition (law `bytes`).

Equal texts form one atomic group; groups are ordered by the MD5 of their text.
The smallest capacity C for which the ordered groups can be cut into at most
`SHARDS` runs of at most C bytes is found by binary search with a greedy check.
The groups never come to the driver. It sees the groups that hold a 16**-DIGITS
share of the bytes or more (so at most 16**DIGITS of them) one by one, and all
others as sums over ranges of keys, which begin at leading hex digits of the key
or behind such a large group. It asks for more digits in ranges above a small
share of a shard, then in those where a cut may still fall: some tens of ranges,
each of which becomes 16**MORE_DIGITS at most. So what it holds does not grow
with the corpus, and a hot group does not widen the search.
Among the cuts that keep every shard within C, the one nearest to an equal
share of the rest is taken, so a group above the mean leaves no shard needlessly
empty.

Slots number the rows of a shard from 0 without gaps: rows are dealt into
`SLOT_PARTS` parts by a hash of id and key (so no group gathers), numbered
there, and shifted by the counts of the earlier parts.

Defined results: a null text counts as empty (size 1, CRC 0) and shares the
empty text's group; null ids and repeated rows get slots of their own; a text
longer than a mean shard is a group of its own that sets the capacity; among
cuts equally near to the wanted place the earlier is taken; fewer groups than
shards leave shards empty; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard_tables, table, written

SHARDS = 8
DIGITS, MORE_DIGITS = 3, 2
SLOT_PARTS = 2048


def sized_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))


class Ordered:
    """Items in key order: single groups, and ranges of groups that are known by their sum and largest group only."""

    def __init__(self, items: dict[str, tuple[int, int, int]]):
        """items: key prefix -> (bytes, bytes of the largest group, groups)."""
        self.items = dict(sorted(items.items()))
        self.names = list(self.items)
        self.edges = [0, *np.cumsum([v[0] for v in self.items.values()], dtype=object)]
        self.single = [v[2] == 1 for v in self.items.values()]

    @property
    def total(self) -> int:
        return int(self.edges[-1])

    @property
    def largest(self) -> int:
        return max((v[1] for v in self.items.values()), default=0)

    def reach(self, capacity: int, shards: int, begin: int = 0) -> list[tuple[int, int]]:
        """After each shard, the least and most bytes that greedy filling with this capacity covers."""
        low = high = begin
        out = []
        for _ in range(shards):
            i = bisect_right(self.edges, low + capacity) - 1
            low = self.edges[i]
            j = bisect_right(self.edges, high + capacity) - 1
            inside = j < len(self.names) and not self.single[j]
            high = min(high + capacity, self.edges[j + 1]) if inside else self.edges[j]
            out.append((int(low), int(high)))
        return out

    def bounds(self, shards: int) -> tuple[int, int]:
        """Capacities: the least that may be feasible, and the least that surely is."""
        found = []
        for side in (1, 0):
            lo, hi = max(-(-self.total // shards), self.largest), self.total
            while lo < hi:
                mid = (lo + hi) // 2
                if self.reach(mid, shards)[-1][side] >= self.total:
                    hi = mid
                else:
                    lo = mid + 1
            found.append(lo)
        return found[0], found[1]

    def open_ranges(self, shards: int) -> list[str]:
        """The ranges to see more of: those above an eighth of a mean shard (fewer than 8 * shards), else those in which a cut may fall."""
        wide = [k for k, (n, _, _) in self.items.items() if n * 8 * shards > self.total]
        if wide := [k for k in wide if self.items[k][2] > 1]:
            return wide
        least, most = self.bounds(shards)
        out: set[str] = set()
        for (low, _), (_, high) in zip(self.reach(least, shards - 1), self.reach(most, shards - 1), strict=True):
            i, j = bisect_right(self.edges, low) - 1, bisect_right(self.edges, high)
            out |= {self.names[k] for k in range(max(i, 0), min(j, len(self.names))) if not self.single[k]}
        return sorted(out)

    def cuts(self, shards: int) -> list[str]:
        """The first item of every shard but the first (a name past all keys for shards that stay empty)."""
        _, capacity = self.bounds(shards)
        at, out = 0, []
        for left in range(shards, 1, -1):
            last = bisect_right(self.edges, at + capacity) - 1
            ideal = at + (self.total - at) / left
            first = bisect_right(self.edges, at) - 1
            # later cuts leave less to the rest: the earliest cut whose rest still fits
            lo, hi = first, last
            while lo < hi:
                mid = (lo + hi) // 2
                if self.reach(capacity, left - 1, self.edges[mid])[-1][0] >= self.total:
                    hi = mid
                else:
                    lo = mid + 1
            k = min(max(bisect_right(self.edges, ideal) - 1, lo), last)
            if k < last and abs(self.edges[k + 1] - ideal) < abs(self.edges[k] - ideal):
                k += 1
            at = self.edges[k]
            out.append(self.names[k] if k < len(self.names) else "~")
        return out


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> list[str]:
    """Where to cut the groups (key, bytes), ordered by key: shards - 1 first keys."""
    digits = DIGITS
    total = groups.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    large = [r["key"] for r in groups.where(F.col("bytes") * F.lit(16**DIGITS) >= F.lit(total)).select("key").collect()]
    by_prefix: dict[str, list[str]] = {}
    for k in large:
        by_prefix.setdefault(k[:DIGITS], []).append(k)
    # at most 16**DIGITS keys in all
    known = groups.sparkSession.createDataFrame(list(by_prefix.items()), "prefix string, large array<string>")
    groups = groups.withColumn("prefix", F.substring("key", 1, DIGITS)).join(F.broadcast(known), "prefix", "left")

    def start(digits: int) -> Column:
        """The range of a key, by the least name that it may hold: `+` comes before all digits and after the end of a key."""
        behind = F.concat(F.array_max(F.filter("large", lambda k: k < F.col("key"))), F.lit("+"))
        return F.when(F.array_contains("large", F.col("key")), F.col("key")).otherwise(F.greatest(F.substring("key", 1, digits), behind))

    def summed(df: DataFrame, digits: int) -> dict[str, tuple[int, int, int]]:
        rows = df.groupBy(start(digits).alias("p")).agg(F.sum("bytes").alias("b"), F.max("bytes").alias("m"), F.count("*").alias("n")).collect()
        return {r["p"]: (r["b"], r["m"], r["n"]) for r in rows}

    items = summed(groups, digits)
    depth = dict.fromkeys(items, digits)
    while wanted := Ordered(items).open_ranges(shards):
        for digits in sorted({depth[p] for p in wanted}):
            own = [p for p in wanted if depth[p] == digits]
            finer = summed(groups.where(start(digits).isin(own)), more := min(digits + MORE_DIGITS, 32))
            items = {k: v for k, v in items.items() if k not in set(own)} | finer
            depth |= dict.fromkeys(finer, more)
    return Ordered(items).cuts(shards)


def shard_of(key: Column, cuts: list[str]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + (key >= c).cast("int")
    return out


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    rows = written(sized_rows(docs), "sized-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "sized-groups")
    cuts = minimax_cuts(groups, shards)
    discard_tables(groups)
    rows = rows.withColumn("shard", shard_of(F.col("key"), cuts)).withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_PARTS)).cast("int"))
    # at most shards x SLOT_PARTS counts
    counts = rows.groupBy("shard", "part").count()
    before = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "doc_id"))
    out = rows.withColumn("place", place).join(F.broadcast(before), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
