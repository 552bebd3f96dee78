"""Operator 1, substring dedup with fixed-block anchors.

Every 20-word window holds a whole block of 10 words at a word number divisible
by 10. The non-overlapping blocks of all documents are indexed and probed with
every rolling 10-word window: a window that meets a block elsewhere is a hit, and
the hits bound where a repeat of 20 words can lie. Around the hits, every window
is then compared by its 96-bit content key and its place: two keys of the words'
64-bit keys, so that no two of even 10^13 different windows are likely to be equal.
The windows that also start earlier are merged into maximal exact repeats and
their words removed.

Both steps use the packed exchange (exchange.py). Probes carry 32 key bits
beyond the bucket's; a chance hit only costs a comparison in the second step.

Defined results: documents count in the order of doc_id (a null id last), rows
that share an id in the order of a hash of the text, and identical rows one
after another, so a repeated row is an earlier one's copy; a null or empty text
has no words and keeps nothing; a very long text is a slice of its own; windows
never cross documents; an empty table gives none; other columns are ignored.
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
from .common import discard_tables, few_files, pieces, table, text_bytes, written

WINDOW = 20
BLOCK = 10


def word_hashes(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, the word offsets of the texts, and the byte offsets."""
    data, at = tk.buffers(batch.column(column))
    starts, ends, first = tk.words(data, at, tk.SPACE_WORDS)
    return tk.string_hash(data, tk.byte_sums(data), starts, ends), first, at


def probe_blobs(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks and rolling windows of all texts, dealt to buckets."""

    def flush(chunk: ex.Chunk) -> pa.RecordBatch:
        keys, places, aligned = (np.concatenate(x) for x in zip(*chunk.kept, strict=True)) if chunk.kept else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))
        # equal keys of the chunk that include a block are hits already; one of them, a block, is sent
        order = np.lexsort((places, ~aligned, keys))
        k = keys[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        sizes = np.diff(np.append(np.flatnonzero(new), len(k)))
        group = np.cumsum(new) - 1
        repeated = (sizes > 1) & aligned[order][new]
        hits = np.sort(places[order[repeated[group]]])
        chunk.local.append(np.stack([hits, hits + 1], axis=1))
        send = np.sort(order[~repeated[group] | new])
        keys, places, aligned = keys[send], places[send], aligned[send]
        order, cuts, to = ex.dealt(keys, buckets)
        low, blobs = (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), []
        for i, j, b in zip(cuts[:-1], cuts[1:], to, strict=True):
            mine = order[i:j]
            block = aligned[mine]
            blobs.append((int(b), ex.pack(low[mine[block]], ex.deltas(places[mine[block]]), low[mine[~block]], ex.deltas(places[mine[~block]]))))
        return chunk.rows(blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = ex.Chunk(TaskContext.get().partitionId() << 24)
        for whole in batches:
            for batch in tk.slices(whole):
                hashes, first, at = word_hashes(batch, 1)
                begin = chunk.add(batch.column(0), batch.column(2).to_numpy(), np.zeros(batch.num_rows, dtype=np.int64), first, int(at[-1]))
                places = tk.window_starts(first, BLOCK)
                keys = tk.word_window_hash(hashes, places, BLOCK)
                number = places - np.repeat(first[:-1], np.diff(first))[places]
                chunk.kept.append((keys, places + begin, number % BLOCK == 0))
                if chunk.bytes >= ex.CHUNK_BYTES:
                    yield flush(chunk)
                    chunk = ex.Chunk(chunk.number + 1)
        yield flush(chunk)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, ex.BLOBS)


def block_hits(chunks: np.ndarray, blobs: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Places whose key is a block's and occurs at least twice in the bucket."""
    parts = [ex.unpack(b) for b in blobs]
    blocks, others = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    index, counts = np.unique(blocks, return_counts=True)
    spot = lambda x: np.minimum(np.searchsorted(index, x), max(len(index) - 1, 0))
    found = index[spot(others)] == others if len(index) else np.zeros(len(others), bool)
    shared = counts > 1
    shared[np.unique(spot(others[found]))] = True
    for chunk, (a, da, b, db) in zip(chunks, parts, strict=True):
        places = [ex.undelta(da)[shared[spot(a)]] if len(a) else np.zeros(0, np.int64)]
        if len(b) and len(index):
            places.append(ex.undelta(db)[index[spot(b)] == b])
        places = np.sort(np.concatenate(places))
        yield int(chunk), places, places + 1


def later_equals(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Which items equal an earlier one in both keys."""
    _, seen, back = np.unique(keys, return_index=True, return_inverse=True)
    first = seen[back]
    if (more == more[first]).all():
        return first != np.arange(len(keys))
    order = np.lexsort((more, keys))  # a collision of the first key
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
    return again


def window_blobs(stream: DataFrame, buckets: int) -> DataFrame:
    """The windows around hits, dealt to buckets; chunk numbers follow the order of documents."""

    def flush(chunk: ex.Chunk) -> pa.RecordBatch:
        keys, more, places = (np.concatenate(x) for x in zip(*chunk.kept, strict=True)) if chunk.kept else (np.zeros(0, np.uint64), np.zeros(0, "<u4"), np.zeros(0, np.int64))
        again = later_equals(keys, more)
        chunk.local.append(np.stack([places[again], places[again] + WINDOW], axis=1))
        keys, more, places = keys[~again], more[~again], places[~again]
        order, cuts, to = ex.dealt(keys, buckets)
        return chunk.rows([(int(b), ex.pack(keys[order[i:j]], ex.deltas(places[order[i:j]]), more[order[i:j]])) for i, j, b in zip(cuts[:-1], cuts[1:], to, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, state = ex.Chunk(TaskContext.get().partitionId() << 24), {"all": True}
        for whole in batches:
            texts, spans, numbers = ex.attached(whole, state)
            done = 0
            for batch in tk.slices(texts, "text"):
                hashes, first, at = word_hashes(batch, 2)
                mine = spans[done : done + batch.num_rows]
                begin = chunk.add(batch.column(0), batch.column(1).to_numpy(), numbers[done : done + batch.num_rows], first, int(at[-1]))
                done += batch.num_rows
                hits = [s + first[d] for d, of in enumerate(mine) for s in of.values() if len(s)]
                if hits:
                    hits = np.concatenate(hits)
                    near = tk.cover(int(first[-1]), np.maximum(hits[:, 0] - (WINDOW - BLOCK), 0), hits[:, 1])
                    places = tk.window_starts(first, WINDOW)
                    places = places[near[places]]
                    more = tk.word_window_hash(tk.mix(~hashes), places, WINDOW).astype("<u4")
                    chunk.kept.append((tk.word_window_hash(hashes, places, WINDOW), more, places + begin))
                if chunk.bytes >= ex.CHUNK_BYTES:
                    yield flush(chunk)
                    chunk = ex.Chunk(chunk.number + 1)
        yield flush(chunk)

    return stream.mapInArrow(run, ex.BLOBS)


def later_windows(chunks: np.ndarray, blobs: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Windows whose key has an earlier place."""
    parts = [ex.unpack(b) for b in blobs]
    again = later_equals(np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts]))
    ends = np.cumsum([len(p[0]) for p in parts])
    for chunk, (k, d, _), end in zip(chunks, parts, ends, strict=True):
        places = ex.undelta(d)[again[end - len(k) : end]]
        yield int(chunk), places, places + WINDOW


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, occurrence and spans: the word ranges that repeat an earlier place, packed as int32 pairs."""
    size = text_bytes(docs)
    buckets = pieces(size, ex.BUCKET_BYTES)
    hits = written(few_files(ex.resolve(probe_blobs(docs, buckets), block_hits), docs), "block-hits")
    stream = ex.with_spans(docs, hits, pieces(size, ex.CHUNK_BYTES))
    out = written(few_files(ex.resolve(window_blobs(stream, buckets), later_windows), docs), "repeat-spans")
    discard_tables(hits)
    return out


def kept_words(data: np.ndarray, at: np.ndarray, spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word counts, removed counts and kept words (joined by one space) of each text."""
    starts, ends, first = tk.words(data, at, tk.SPACE_WORDS)
    gone = [s + first[d] for d, s in enumerate(spans) if len(s)]
    gone = np.concatenate(gone) if gone else np.zeros((0, 2), dtype=np.int64)
    removed = tk.cover(len(starts), gone[:, 0], gone[:, 1])
    n_removed = tk.per_text(removed, first)
    starts, ends = starts[~removed], ends[~removed]
    counts = np.diff(first) - n_removed
    lengths = ends - starts + 1
    new_ends = np.cumsum(lengths)
    if len(starts):
        joined = data[np.minimum(np.repeat(starts - (new_ends - lengths), lengths) + np.arange(int(new_ends[-1])), len(data) - 1)]
        joined[new_ends - 1] = 0x20
        joined = joined.tobytes()
    out, word = [], 0
    cuts = np.concatenate([[0], new_ends])
    for n in counts.tolist():
        out.append(joined[cuts[word] : cuts[word + n] - 1] if n else b"")
        word += n
    return np.diff(first), n_removed, out


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining text) and spans of every document."""
    spans = repeated_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for whole in batches:
            texts, marks, _ = ex.attached(whole, state)
            done = 0
            for batch in tk.slices(texts, "text"):
                mine = marks[done : done + batch.num_rows]
                done += batch.num_rows
                n, removed, kept = kept_words(*tk.buffers(batch.column(2)), mine)
                yield pa.record_batch([batch.column(0), pa.array(n), pa.array(removed), pa.array([k.decode() for k in kept], pa.string()), pa.array([m.ravel().tolist() for m in mine], pa.list_(pa.int64()))], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return ex.with_spans(docs, spans, None).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<long>")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return few_files(deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), docs)


def brute(texts: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str]]:
    """The result by comparing all windows: for tests. texts: distinct ids."""
    seen, out = set(), []
    for doc_id, text in sorted(texts):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
        gone = [False] * len(words)
        for i in range(len(words) - WINDOW + 1):
            key = tuple(words[i : i + WINDOW])
            if key in seen:
                gone[i : i + WINDOW] = [True] * WINDOW
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
