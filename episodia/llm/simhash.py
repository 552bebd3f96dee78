"""Operator 8, SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints: 64 majority bits over the XXH64 of all 3-word shingles. Two
fingerprints link at `RADIUS` or fewer differing bits. The 64 bits are grouped
by correlation into blocks of 16; parts are one or two blocks. Each fingerprint
gets its own thresholds t_i >= -1 with sum RADIUS - parts + 1, chosen by dynamic
programming on the candidate counts that the block histograms estimate: any two
fingerprints within RADIUS then agree within t_i on some part i, so probing the
index with every value within t_i finds every link. Candidates meet in a bucket
(part, value), are verified there, and leave it as one spanning forest for each
bucket, so a dense bucket never emits all its pairs; one that the histograms say
may be large is split by the bits outside its part. Components come from
alternating large-star and small-star rounds.

Defined results: a null or empty text, or one without words, has fingerprint
zero and links like any other; copies share a fingerprint and are expanded by a
join only at the end; a null doc_id never names a component unless all ids in
it are null; repeated rows give repeated results; of a component's rows of the
smallest id `keep_one` keeps the one of the smallest text hash; a very long text is
hashed whole, in a slice of its own; an empty table gives none; other columns are ignored by the search and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import anti_joined, id_and_text, settled, table, written

RADIUS = 3
SHINGLE = 3
BLOCKS, BLOCK_BITS = 4, 16
#: Cost of a probe row against that of one verified candidate.
PROBE_COST, CANDIDATE_COST = 8.0, 1.0
#: A bucket that may hold more rows is split: two fingerprints that differ in RADIUS bits at most agree on one of
#: RADIUS + 1 pieces of the bits outside the bucket's part, so its rows go to a bucket for each piece instead.
HOT_ROWS = 50_000
SALTS = 32


def shingle_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of lower-cased texts, and the n + 1 shingle offsets."""
    data = tk.LOWER[data]
    starts, ends, first = tk.words(data, at, tk.SPACE_WORDS)
    counts = np.diff(first)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), offsets
    lengths = ends - starts + 1
    new_ends = np.cumsum(lengths)
    joined = data[np.minimum(np.repeat(starts - (new_ends - lengths), lengths) + np.arange(int(new_ends[-1])), len(data) - 1)]
    joined[new_ends - 1] = 0x20
    begin = np.repeat(first[:-1], sizes) + np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], sizes)
    finish = np.minimum(begin + SHINGLE, np.repeat(first[1:], sizes)) - 1
    body, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(body[i:j], 42) for i, j in zip((new_ends - lengths)[begin].tolist(), (new_ends - 1)[finish].tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64), offsets


def fingerprints_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    hashes, offsets = shingle_hashes(data, at)
    sizes = np.diff(offsets)
    out, some = np.zeros(len(sizes), dtype=np.uint64), np.flatnonzero(sizes)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, offsets[:-1][some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > sizes[some, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole):
                fps = fingerprints_of(*tk.buffers(batch.column(1)))
                yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def bit_groups(nodes: DataFrame) -> list[list[int]]:
    """BLOCKS lists of bits; correlated bits share a list. Gathers 64 x 64 sums, whatever the input's size."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65))
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for k in range(0, len(fps), 50_000):
                x = _bits(fps[k : k + 50_000].view(np.uint64)).astype(np.float32)
                x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
                total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.record_batch([pa.array(i * 65 + j, pa.int32()), pa.array(total[i, j])], names=["cell", "n"])

    rows = nodes.select("fp").mapInArrow(products, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(65 * 65)
    sums[rows["cell"]] = rows["n"]
    sums = sums.reshape(65, 65)
    n = max(sums[64, 64], 1.0)
    mean = sums[64, :64] / n
    cov = sums[:64, :64] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    like = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(like, 0)
    left, groups = set(range(64)), []
    while left:
        group = [max(sorted(left), key=lambda b: like[b, list(left)].sum())]
        left.remove(group[0])
        while len(group) < BLOCK_BITS:
            group.append(max(sorted(left), key=lambda b: like[b, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _bits(fps: np.ndarray) -> np.ndarray:
    """Bit 0 is the lowest."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def block_values(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The value of each fingerprint in each block: shape (n, BLOCKS)."""
    out = np.zeros((len(fps), len(groups)), dtype=np.int64)
    for b, bits in enumerate(groups):
        for k, bit in enumerate(bits):
            out[:, b] |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def distance_tables(nodes: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """shares[b, d, v]: the share of fingerprints whose block b differs from v in exactly d <= RADIUS bits; 2**16 values a block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BLOCKS << BLOCK_BITS, dtype=np.int64)
        for batch in batches:
            values = block_values(batch.column(0).to_numpy().view(np.uint64), groups)
            seen += np.bincount((values + (np.arange(BLOCKS) << BLOCK_BITS)).ravel(), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(seen[at])], names=["cell", "n"])

    rows = nodes.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    shares = np.zeros((BLOCKS, RADIUS + 1, 1 << BLOCK_BITS))
    cell = rows["cell"].to_numpy()
    shares[cell >> BLOCK_BITS, 0, cell & ((1 << BLOCK_BITS) - 1)] = rows["n"]
    shares /= max(shares[0, 0].sum(), 1)
    flip = np.arange(1 << BLOCK_BITS)
    for b in range(BLOCKS):
        for k in range(BLOCK_BITS):
            other = shares[b][:, flip ^ (1 << k)].copy()
            for d in range(RADIUS, 0, -1):
                shares[b, d] += other[d - 1]
    return shares


def part_counts(values: np.ndarray, shares: np.ndarray, parts: int, n: int) -> np.ndarray:
    """Estimated candidates within t = 0..RADIUS of each fingerprint on each part: shape (rows, parts, RADIUS + 1)."""
    exact = np.stack([shares[b][:, values[:, b]].T for b in range(BLOCKS)], axis=1)
    each = BLOCKS // parts
    out = np.empty((len(values), parts, RADIUS + 1))
    for p in range(parts):
        got = exact[:, p * each]
        for b in range(p * each + 1, (p + 1) * each):
            got = np.stack([sum(got[:, i] * exact[:, b, d - i] for i in range(d + 1)) for d in range(RADIUS + 1)], axis=1)
        out[:, p] = np.cumsum(got, axis=1) * n
    return out


def probe_sizes(bits: int) -> np.ndarray:
    sizes, term = [1.0], 1.0
    for d in range(RADIUS):
        term = term * (bits - d) / (d + 1)
        sizes.append(sizes[-1] + term)
    return np.array(sizes)


def allocate(counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of each row (-1: not probed) that cost least, with sum RADIUS - parts + 1; and that cost."""
    rows, parts, _ = counts.shape
    cost = np.concatenate([np.zeros((rows, parts, 1)), counts * CANDIDATE_COST + probe_sizes(bits) * PROBE_COST], axis=2)
    budget = RADIUS + 1  # the sum of t_i + 1
    best = np.full((rows, budget + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for p in range(parts):
        now, pick = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int64)
        for u in range(budget + 1):
            moved = np.full_like(best, np.inf)
            moved[:, u:] = best[:, : budget + 1 - u] + cost[:, p, u][:, None]
            less = moved < now
            now[less], pick[less] = moved[less], u
        best = now
        picks.append(pick)
    left, out = np.full(rows, budget), np.zeros((rows, parts), dtype=np.int64)
    for p in reversed(range(parts)):
        out[:, p] = picks[p][np.arange(rows), left]
        left = left - out[:, p]
    return out - 1, best[:, budget]


def pieces_outside(fps: np.ndarray, groups: list[list[int]], part: int, parts: int) -> list[np.ndarray]:
    """The values of the RADIUS + 1 pieces of the bits that are not in the part."""
    each = BLOCKS // parts
    bits = [bit for b, own in enumerate(groups) if not part * each <= b < (part + 1) * each for bit in own]
    out = []
    for k in range(RADIUS + 1):
        value = np.zeros(len(fps), dtype=np.int64)
        for i, bit in enumerate(bits[k :: RADIUS + 1]):
            value |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
        out.append(value)
    return out


def masks(bits: int, within: int) -> np.ndarray:
    return np.array([sum(1 << k for k in c) for d in range(within + 1) for c in combinations(range(bits), d)], dtype=np.int64)


def probes(nodes: DataFrame, groups: list[list[int]], shares: np.ndarray, parts: int, n: int) -> DataFrame:
    """(part, key, fp): each fingerprint under its own value of each part, and under the values within its thresholds."""
    bits = 64 // parts
    each = BLOCKS // parts
    # by value of each block, whether its buckets may hold more than HOT_ROWS (at most all rows within RADIUS of it)
    crowded = [shares[b].sum(axis=0) * n > HOT_ROWS for b in range(BLOCKS)]
    piece_bits = (64 - bits) // (RADIUS + 1)

    def dealt(p: int, keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        """Rows of part p. Its whole buckets are part p * (RADIUS + 2); the pieces of split ones are numbered from there on."""
        hot = np.ones(len(keys), dtype=bool)
        for b in range(each):
            hot &= crowded[p * each + b][(keys >> (BLOCK_BITS * b)) & ((1 << BLOCK_BITS) - 1)]
        number, key, fp = [np.full(len(keys) - int(hot.sum()), p * (RADIUS + 2))], [keys[~hot]], [fps[~hot]]
        if hot.any():
            for k, value in enumerate(pieces_outside(fps[hot], groups, p, parts)):
                number.append(np.full(len(value), p * (RADIUS + 2) + 1 + k))
                key.append((keys[hot] << piece_bits) | value)
                fp.append(fps[hot])
        return pa.record_batch([pa.array(np.concatenate(number), pa.int32()), pa.array(np.concatenate(key)), pa.array(np.concatenate(fp).view(np.int64))], names=["part", "key", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                fps = batch.column(0).to_numpy()[k : k + 20_000].view(np.uint64)
                values = block_values(fps, groups)
                limits, _ = allocate(part_counts(values, shares, parts, n), bits)
                for p in range(parts):
                    own = sum(values[:, p * each + b] << (BLOCK_BITS * b) for b in range(each))
                    for t in range(RADIUS + 1):
                        at = np.flatnonzero(np.maximum(limits[:, p], 0) == t)
                        flips = masks(bits, t)
                        for part in np.array_split(at, max(1, len(at) * len(flips) // 500_000)):
                            yield dealt(p, (own[part][:, None] ^ flips[None, :]).ravel(), np.repeat(fps[part], len(flips)))

    return nodes.select("fp").mapInArrow(run, "part int, key long, fp long")


def local_components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of n items reaches by the links a-b."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def bucket_forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, root) that span the link graph of one bucket's distinct fingerprints. Memory is bounded by tiles.

    Neighbours in a few rotated orders are linked first; items then stand by component, and two tiles that lie in one
    component are not compared, so a dense bucket costs little more than its sorts."""
    fps = np.unique(fps)
    label, step = np.arange(len(fps)), 1024
    if len(fps) > step:
        for turn in range(0, 64, 8):
            turned = (fps << np.uint64(turn)) | (fps >> np.uint64(64 - turn)) if turn else fps
            order = np.argsort(turned)
            for d in (1, 2, 3):
                a, b = order[:-d], order[d:]
                near = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
                label = local_components(len(fps), a[near], b[near], label)
        order = np.argsort(label, kind="stable")
        fps, label = fps[order], label[order]
        label = np.searchsorted(label, label)
    for i in range(0, len(fps), step):
        for j in range(i, len(fps), step):
            if (label[i : i + step] == label[i]).all() and (label[j : j + step] == label[i]).all():
                continue
            near = np.bitwise_count(fps[i : i + step, None] ^ fps[None, j : j + step]) <= RADIUS
            a, b = np.nonzero(near)
            keep = label[a + i] != label[b + j]
            if keep.any():
                label = local_components(len(fps), a[keep] + i, b[keep] + j, label)
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[at], fps[label[at]]


def _linked(part: np.ndarray, key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets that lie one after another."""
    edge = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (key[1:] != key[:-1]), [True]]))
    sizes, group = np.diff(edge), np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    low, high = [], []
    for g in np.flatnonzero(sizes > 48):
        a, b = bucket_forest(fps[edge[g] : edge[g + 1]])
        low.append(b)
        high.append(a)
    small = sizes[group] <= 48
    fps, group = fps[small], group[small]
    for d in range(1, 48):
        if len(fps) <= d or not (same := group[d:] == group[:-d]).any():
            break
        a, b = fps[:-d][same], fps[d:][same]
        near = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
        low.append(np.minimum(a, b)[near])
        high.append(np.maximum(a, b)[near])
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *high]), np.concatenate([none, *low])


def links(candidates: DataFrame) -> DataFrame:
    """(u, v) with u != v: verified links that connect what each bucket links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in range(3)))
            rows += batch.num_rows
            part, key, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.flatnonzero((part != part[-1]) | (key != key[-1]))[-1]) + 1 if (part[0], key[0]) != (part[-1], key[-1]) else 0
            if last:
                yield _pairs(part[:last], key[:last], fps[:last])
            held = [(part[last:], key[last:], fps[last:])]
        if rows:
            yield _pairs(*held[0])

    def _pairs(part, key, fps) -> pa.RecordBatch:
        u, v = _linked(part, key, fps.view(np.uint64))
        return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    # sort order brings the members of a bucket together; only one bucket at a time is held
    dealt = candidates.repartition("part", "key").sortWithinPartitions("part", "key", "fp")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches."""
    edges = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        out = joined.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = settled(out.distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): every document with the smallest doc_id that it reaches by links."""
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    n = nodes.count()
    groups = bit_groups(nodes)
    shares = distance_tables(nodes, groups)
    parts = cheapest_parts(shares, n)
    roots = components(links(probes(nodes, groups, shares, parts, n)))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "fingerprint-roots")
    best = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(best, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def cheapest_parts(shares: np.ndarray, n: int) -> int:
    """4 parts of one block or 2 of two blocks: whichever costs less for n fingerprints spread like the histograms."""
    rng, drawn = np.random.default_rng(8), 2000
    values = np.stack([rng.choice(1 << BLOCK_BITS, drawn, p=shares[b, 0] / max(shares[b, 0].sum(), 1e-12)) if n else np.zeros(drawn, dtype=np.int64) for b in range(BLOCKS)], axis=1)
    return min((4, 2), key=lambda parts: allocate(part_counts(values, shares, parts, n), 64 // parts)[1].mean())


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest id (a null id last), with all columns; of repeated rows one."""
    found = written(near_duplicates(docs), "components")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    kept = found.groupBy("root").agg(first.alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # the members of a large component meet its first one in SALTS places
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    others = members.join(kept, ["root", "salt"]).where(~(F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_hash") == F.col("k.text_hash"))))
    out = anti_joined(docs, id_and_text(), written(others.select(F.col("doc_id").alias("k0"), F.col("text_hash").alias("k1")).distinct(), "near-copies"))
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
