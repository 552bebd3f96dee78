"""Operator 7, suffix-array dedup over bytes with hash-compared suffix sorting.

The suffix array is sparse: of the suffixes inside each 100-byte string, the one
at the smallest hash of a `SEED`-byte prefix is an anchor, so equal strings have
their anchor at the same offset and every repeat shows at anchors. Anchors whose
prefix occurs once are dropped by a first packed exchange. For the others the
bytes around the anchor (at most 100 to the right, what a 100-byte string can
reach to the left) go to the bucket of the prefix, where the suffixes to the
right, and likewise the reversed ones to the left, are sorted by mergesort. Two
suffixes are compared by their prefix polynomial hashes: binary search finds the
common extension in logarithmic steps. Afterwards all neighbours are compared
byte by byte, and a bucket in which a hash has collided is sorted by its bytes.
The common-prefix arrays then say, for each split a + b = 100, which strings are
equal; all but the one at the earliest place are removed.

Defined results: documents count in the order of doc_id (a null id last), rows
that share an id in the order of a hash of the text, and identical rows one
after another, so a repeated row is an earlier one's copy; a null text is empty;
matches never cross documents and may overlap themselves; what remains need not
be valid UTF-8 and is returned as binary; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as ex
from . import textkit as tk
from .common import discard_tables, pieces, table, text_bytes, written

LENGTH = 100
SEED = 24
#: Seeds in a string, and so the furthest that a string reaches left of its anchor, plus one.
SEEDS = LENGTH - SEED + 1
LEFT, RIGHT = SEEDS - 1, LENGTH
#: Contexts sorted at once (whole groups).
SORT_AT_ONCE = 20_000
#: Text bytes hashed at once; every byte needs some ten 8-byte temporaries.
SLICE = 1_000_000
_PLACE_BITS = 27


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte places of the anchors, the hashes of their seeds, and the prefix sums of the bytes."""
    sums = tk.byte_sums(data)
    if len(data) < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), sums
    n = len(data) - SEED + 1
    hashes = tk.mix((sums[SEED : SEED + n] - sums[:n]) * tk.powers(len(sums))[1][:n])
    low = np.uint64((1 << max(_PLACE_BITS, len(data).bit_length())) - 1)
    least = _window_min((hashes & ~low) | np.arange(n, dtype=np.uint64), SEEDS)
    inside = np.zeros(len(least), dtype=bool)
    inside[tk.window_starts(at, LENGTH)] = True
    chosen = np.zeros(n, dtype=bool)
    chosen[(least[inside] & low).astype(np.int64)] = True
    places = np.flatnonzero(chosen)
    return places, hashes[places], sums


def seed_blobs(docs: DataFrame, buckets: int) -> DataFrame:
    """The seeds of all anchors, dealt to buckets."""

    def flush(chunk: ex.Chunk) -> pa.RecordBatch:
        keys, places = (np.concatenate(x) for x in zip(*chunk.kept, strict=True)) if chunk.kept else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        _, seen, back, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        hits = places[counts[back] > 1]
        chunk.local.append(np.stack([hits, hits + 1], axis=1))
        seen = np.sort(seen)
        keys, places = keys[seen], places[seen]
        order, cuts, to = ex.dealt(keys, buckets)
        low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        return chunk.rows([(int(b), ex.pack(low[order[i:j]], ex.deltas(places[order[i:j]]))) for i, j, b in zip(cuts[:-1], cuts[1:], to, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = ex.Chunk(TaskContext.get().partitionId() << 24)
        for whole in batches:
            for batch in tk.slices(whole, limit=SLICE):
                data, at = tk.buffers(batch.column(1))
                places, hashes, _ = anchors(data, at)
                begin = chunk.add(batch.column(0), batch.column(2).to_numpy(), np.zeros(batch.num_rows, dtype=np.int64), at, int(at[-1]))
                chunk.kept.append((hashes, places + begin))
                if chunk.bytes >= ex.CHUNK_BYTES:
                    yield flush(chunk)
                    chunk = ex.Chunk(chunk.number + 1)
        yield flush(chunk)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, ex.BLOBS)


def shared_seeds(chunks: np.ndarray, blobs: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Anchors whose seed other chunks have too."""
    parts = [ex.unpack(b) for b in blobs]
    _, back, counts = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
    shared = counts[back] > 1
    ends = np.cumsum([len(p[0]) for p in parts])
    for chunk, (k, d), end in zip(chunks, parts, ends, strict=True):
        places = ex.undelta(d)[shared[end - len(k) : end]]
        yield int(chunk), places, places + 1


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the contexts at a and b (of equal extents) are equal, byte by byte."""
    same = np.ones(len(a), dtype=bool)
    for o in range(-LEFT, RIGHT):
        live = (o >= -left) & (o < right) & same
        same[live] = data[a[live] + o] == data[b[live] + o]
    return same


def context_blobs(stream: DataFrame, buckets: int) -> DataFrame:
    """The bytes around anchors that are hits, dealt to the seeds' buckets; equal contexts of a slice are sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, state = ex.Chunk(TaskContext.get().partitionId() << 24), {"all": True}
        for whole in batches:
            texts, spans, numbers = ex.attached(whole, state)
            done = 0
            for batch in tk.slices(texts, "text", SLICE):
                data, at = tk.buffers(batch.column(2))
                mine = spans[done : done + batch.num_rows]
                begin = chunk.add(batch.column(0), batch.column(1).to_numpy(), numbers[done : done + batch.num_rows], at, int(at[-1]))
                done += batch.num_rows
                hits = [s + at[d] for d, of in enumerate(mine) for s in of.values() if len(s)]
                if hits:
                    hits = np.concatenate(hits)
                    places, hashes, sums = anchors(data, at)
                    wanted = tk.cover(len(data), hits[:, 0], hits[:, 1])[places]
                    places, hashes = places[wanted], hashes[wanted]
                    doc = np.searchsorted(at, places, side="right") - 1
                    left, right = np.minimum(LEFT, places - at[doc]), np.minimum(RIGHT, at[doc + 1] - places)
                    whole_key = tk.mix(tk.byte_hash(sums, places - left, places + right) + left.astype(np.uint64))
                    _, seen, back = np.unique(whole_key, return_index=True, return_inverse=True)
                    first = seen[back]
                    again = np.flatnonzero(first != np.arange(len(places)))
                    fits = (left[again] == left[first[again]]) & (right[again] == right[first[again]])
                    again = again[fits]
                    again = again[_same_bytes(data, places[again], places[first[again]], left[again], right[again])]
                    long = again[left[again] + right[again] >= LENGTH]
                    chunk.local.append(np.stack([places[long] - left[long], places[long] + right[long]], axis=1) + begin)
                    new = np.ones(len(places), dtype=bool)
                    new[again] = False
                    places, hashes, left, right = places[new], hashes[new], left[new], right[new]
                    sizes = left + right
                    order = np.cumsum(sizes) - sizes
                    body = data[np.repeat(places - left - order, sizes) + np.arange(int(sizes.sum()))]
                    chunk.kept.append((hashes, places + begin, left.astype(np.uint8), right.astype(np.uint8), body))
                if chunk.bytes >= ex.CHUNK_BYTES:
                    yield flush(chunk)
                    chunk = ex.Chunk(chunk.number + 1)
        yield flush(chunk)

    def flush(chunk: ex.Chunk) -> pa.RecordBatch:
        if not chunk.kept:
            return chunk.rows([])
        keys, places, left, right, body = (np.concatenate(x) for x in zip(*chunk.kept, strict=True))
        order, cuts, to = ex.dealt(keys, buckets)
        sizes = left.astype(np.int64) + right
        at = np.cumsum(sizes) - sizes
        blobs = []
        for i, j, b in zip(cuts[:-1], cuts[1:], to, strict=True):
            m = order[i:j]
            n = sizes[m]
            bytes_ = body[np.repeat(at[m] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            blobs.append((int(b), ex.pack(keys[m], ex.deltas(places[m]), left[m], right[m], bytes_)))
        return chunk.rows(blobs)

    return stream.mapInArrow(run, ex.BLOBS)


class Suffixes:
    """Equally placed byte strings (rows of a matrix, zero-padded), compared by prefix polynomial hashes."""

    def __init__(self, body: np.ndarray, sizes: np.ndarray):
        self.body, self.sizes = body, sizes
        powers = tk.powers(body.shape[1] + 1)[0][: body.shape[1]]
        self.sums = np.zeros((len(body), body.shape[1] + 1), dtype=np.uint64)
        np.cumsum(tk._BYTE_VALUE[body] * powers, axis=1, out=self.sums[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over the prefix hashes."""
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.sizes[a], self.sizes[b])
        for _ in range(int(self.body.shape[1]).bit_length()):
            mid = (low + high + 1) // 2
            same = self.sums[a, mid] == self.sums[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        last = self.body.shape[1] - 1
        x = np.where(n < self.sizes[a], self.body[a, np.minimum(n, last)].astype(np.int16), -1)
        y = np.where(n < self.sizes[b], self.body[b, np.minimum(n, last)].astype(np.int16), -1)
        return x < y

    def sorted_groups(self, group: np.ndarray) -> np.ndarray:
        """Row numbers ordered by (group, suffix), by bottom-up mergesort inside groups. group: ascending."""
        order = np.arange(len(group))
        begin = np.searchsorted(group, group)
        size = np.searchsorted(group, group, side="right") - begin
        width = 1
        while len(size) and width < size.max():
            spot = np.flatnonzero(size > width)
            inside = spot - begin[spot]
            pair = inside // (2 * width) * (2 * width)
            right = inside - pair >= width
            # the other run of the pair, as [low, high) of places
            low = begin[spot] + pair + np.where(right, 0, width)
            high = np.minimum(low + width, begin[spot] + size[spot])
            start = low = np.minimum(low, high)
            me = order[spot]
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                other = order[mid]
                # a right run's items follow equal items of the left run
                go = np.where(right[open_], ~self.less(me[open_], other), self.less(other, me[open_]))
                low, high = low.copy(), high.copy()
                low[open_], high[open_] = np.where(go, mid + 1, low[open_]), np.where(go, high[open_], mid)
            own = inside - pair - np.where(right, width, 0)
            new = order.copy()
            new[begin[spot] + pair + own + (low - start)] = me
            order, width = new, 2 * width
        return order

    def array(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array and the common lengths with the item before (-1 at the start of a group), verified on the bytes."""
        order = self.sorted_groups(group)
        a, b = order[:-1], order[1:]
        same = group[a] == group[b]
        limit = np.minimum(self.sizes[a], self.sizes[b])
        differ = (self.body[a] != self.body[b]) | (np.arange(self.body.shape[1])[None, :] >= limit[:, None])
        exact = np.where(differ.any(axis=1), differ.argmax(axis=1), limit)
        if not np.array_equal(exact[same], self.common(a[same], b[same])) or self.less(b[same], a[same]).any():
            order = np.lexsort((self.sizes, *self.body.T[::-1], group))
            a, b = order[:-1], order[1:]
            same = group[a] == group[b]
            limit = np.minimum(self.sizes[a], self.sizes[b])
            differ = (self.body[a] != self.body[b]) | (np.arange(self.body.shape[1])[None, :] >= limit[:, None])
            exact = np.where(differ.any(axis=1), differ.argmax(axis=1), limit)
        return order, np.concatenate([[-1] * bool(len(order)), np.where(same, exact, -1)]).astype(np.int64)


def repeated_extents(group: np.ndarray, left: np.ndarray, right: np.ndarray, left_body: np.ndarray, right_body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest offset a at which the string [x - a, x + LENGTH - a) around each anchor x has an earlier
    equal one in the group (least > largest: none). Items are in place order within groups; group: ascending."""
    classes = []
    for body, sizes in ((left_body, left), (right_body, right)):
        order, common = Suffixes(body, sizes).array(group)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        classes.append((common, back))
    least, largest = np.full(len(group), LENGTH), np.full(len(group), -1)
    (cl, bl), (cr, br) = classes
    for a in range(SEEDS):
        some = np.flatnonzero((left >= a) & (right >= LENGTH - a))
        if len(some) < 2:
            continue
        key = np.cumsum(cl < a)[bl[some]] * (len(group) + 1) + np.cumsum(cr < LENGTH - a)[br[some]]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(some), dtype=bool)
        again[first] = False
        again = some[again]
        least[again] = np.minimum(least[again], a)
        largest[again] = a
    return least, largest


def later_strings(chunks: np.ndarray, blobs: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Byte ranges of a bucket's strings that have an earlier place."""
    parts = [ex.unpack(b) for b in blobs]
    keys, left, right, body = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3, 4))
    places = np.concatenate([ex.undelta(p[1]) for p in parts])
    source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    left, right = left.astype(np.int64), right.astype(np.int64)
    start = np.cumsum(left + right) - left - right
    order = np.argsort(keys, kind="stable")
    _, group, counts = np.unique(keys[order], return_inverse=True, return_counts=True)
    order = order[counts[group] > 1]
    group = group[counts[group] > 1]
    starts, ends, owner = [], [], []
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, dtype=np.int64)
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + SORT_AT_ONCE, side="right")) - 1)
        m = order[edges[at] : edges[to]]
        g, at = group[edges[at] : edges[to]], to
        steps = np.arange(RIGHT)
        x = start[m] + left[m]
        rb = np.where(steps < right[m][:, None], body[np.minimum(x[:, None] + steps, len(body) - 1)], 0)
        steps = np.arange(LEFT)
        lb = np.where(steps < left[m][:, None], body[np.maximum(x[:, None] - 1 - steps, 0)], 0)
        least, largest = repeated_extents(g, left[m], right[m], lb, rb)
        some = largest >= least
        starts.append(places[m][some] - largest[some])
        ends.append(places[m][some] + LENGTH - least[some])
        owner.append(source[m][some])
    if starts:
        starts, ends, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
        for k in np.unique(owner):
            yield int(chunks[k]), starts[owner == k], ends[owner == k]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, occurrence and spans: the byte ranges that repeat an earlier place, packed as int32 pairs."""
    size = text_bytes(docs)
    buckets = pieces(size, ex.BUCKET_BYTES)
    hits = written(ex.resolve(seed_blobs(docs, buckets), shared_seeds), "seed-hits")
    stream = ex.with_spans(docs, hits, pieces(size, ex.CHUNK_BYTES))
    out = written(ex.resolve(context_blobs(stream, buckets), later_strings), "repeat-spans")
    discard_tables(hits)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and spans of every document."""
    spans = repeated_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for whole in batches:
            texts, marks, _ = ex.attached(whole, state)
            done = 0
            for batch in tk.slices(texts, "text", SLICE):
                data, at = tk.buffers(batch.column(2))
                mine = marks[done : done + batch.num_rows]
                done += batch.num_rows
                gone = [s + at[d] for d, s in enumerate(mine) if len(s)]
                gone = np.concatenate(gone) if gone else np.zeros((0, 2), dtype=np.int64)
                removed = tk.cover(len(data), gone[:, 0], gone[:, 1])
                n_removed = tk.per_text(removed, at)
                rest = data[~removed].tobytes()
                cuts = np.concatenate([[0], np.cumsum(np.diff(at) - n_removed)]).tolist()
                kept = [rest[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch([batch.column(0), pa.array(np.diff(at)), pa.array(n_removed), pa.array([len(s) for s in mine], pa.int64()), pa.array(kept, pa.binary()), pa.array([s.ravel().tolist() for s in mine], pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return ex.with_spans(docs, spans, None).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[tuple[int, str | None]]) -> list[tuple[int, int, int, int, str]]:
    """The result by comparing all strings: for tests. texts: distinct ids."""
    seen, out = set(), []
    for doc_id, text in sorted(texts, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=np.int64)
        for i in range(len(data) - LENGTH + 1):
            key = data[i : i + LENGTH]
            if key in seen:
                gone[i] += 1
                gone[i + LENGTH] -= 1
            seen.add(key)
        mask = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(data, dtype=np.uint8)[~mask].tobytes()
        out.append((doc_id, len(data), int(mask.sum()), len(tk.runs(mask)[0]), hashlib.sha256(kept).hexdigest()))
    return out
