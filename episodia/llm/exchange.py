"""Packed exchange of content keys: the frame that both exact-repeat operators share.

A pass over the texts cuts them into chunks of about CHUNK_BYTES. A chunk deals
its keys to buckets by key bits and sends each bucket one packed blob: the keys
and the places (item numbers in the chunk, as small deltas). A bucket is about
BUCKET_BYTES of text and sees all equal keys at once; what it finds goes back to
the chunks as places, where the chunk's manifest, which came out of the very
same task, turns them into ranges by document. So a row is a packed blob, a key
costs a few bytes, and neither the driver nor one task ever holds all keys.
Equal keys within a chunk are reduced to one before they are sent, so a hot
group costs a bucket one entry a chunk.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

CHUNK_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000

BLOBS = "kind int, at long, chunk long, blob binary"
SPANS = "doc_id long, text_hash long, occurrence int, spans binary"
#: kind of a row: a bucket's blob, a chunk's manifest, places found for a chunk.
TO_BUCKET, MANIFEST, FOUND = 0, 1, 2


def pack(*arrays: np.ndarray) -> bytes:
    out = [struct.pack("<i", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [struct.pack("<3sq", a.dtype.str.encode(), len(a)), a.tobytes()]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<i", blob), 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<3sq", blob, at)
        dtype = np.dtype(kind.decode())
        out.append(np.frombuffer(blob, dtype, size, at + 11))
        at += 11 + size * dtype.itemsize
    return out


def deltas(places: np.ndarray) -> np.ndarray:
    """Increasing places as differences, 2 bytes each where they fit."""
    d = np.diff(places, prepend=0)
    return d.astype("<u2") if not len(d) or d.max() < 1 << 16 else d.astype("<u4")


def undelta(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.int64)


class Chunk:
    """The documents of one chunk and the item offsets of each, gathered slice by slice."""

    def __init__(self, number: int):
        self.number, self.items, self.bytes = number, 0, 0
        self.ids: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
        self.kept: list[tuple] = []
        self.local: list[np.ndarray] = []

    def add(self, doc_id: pa.Array, text_hash: np.ndarray, occurrence: np.ndarray, offsets: np.ndarray, size: int) -> int:
        """Adds documents; returns the number of their first item."""
        doc_id = doc_id.cast(pa.int64())
        self.ids.append(np.stack([doc_id.fill_null(0).to_numpy(), np.asarray(doc_id.is_valid()).astype(np.int64), text_hash, occurrence], axis=1).astype(np.int64))
        begin = self.items
        self.offsets.append(offsets[1:] + begin)
        self.items += int(offsets[-1])
        self.bytes += size
        return begin

    def rows(self, blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids = np.concatenate(self.ids) if self.ids else np.zeros((0, 4), dtype=np.int64)
        local = np.concatenate(self.local) if self.local else np.zeros((0, 2), dtype=np.int64)
        head = pack(ids.ravel(), np.concatenate(self.offsets), local.ravel())
        kinds = [TO_BUCKET] * len(blobs) + [MANIFEST]
        return pa.record_batch(
            [pa.array(kinds, pa.int32()), pa.array([b for b, _ in blobs] + [-1 - self.number], pa.int64()), pa.array([self.number] * len(kinds), pa.int64()), pa.array([b for _, b in blobs] + [head], pa.binary())],
            names=["kind", "at", "chunk", "blob"],
        )


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, cuts, bucket of each piece): a stable order of the keys by bucket."""
    to = (keys >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(to.astype(np.uint32), kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, dtype=np.int64)
    return order, cuts, to[cuts[:-1]].astype(np.int64)


def resolve(blobs: DataFrame, bucket: Callable[[np.ndarray, list[bytes]], Iterator[tuple[int, np.ndarray, np.ndarray]]], starts_unit: int = 1) -> DataFrame:
    """Ranges by document (SPANS): bucket(chunks, blobs), both in chunk order, yields (chunk, starts, ends) in items."""

    def settle(rows: pa.Table) -> pa.Table:
        if rows.column("kind")[0].as_py() == MANIFEST:
            return rows.select(["kind", "chunk", "blob"])
        chunks = rows.column("chunk").to_numpy()
        order = np.argsort(chunks, kind="stable")
        texts = rows.column("blob").to_pylist()
        out = [(int(c), pack(s.astype("<u4"), (e - s).astype("<u4"))) for c, s, e in bucket(chunks[order], [texts[i] for i in order]) if len(s)]
        return pa.table({"kind": pa.array([FOUND] * len(out), pa.int32()), "chunk": pa.array([c for c, _ in out], pa.int64()), "blob": pa.array([b for _, b in out], pa.binary())})

    def home(rows: pa.Table) -> pa.Table:
        kinds, texts = rows.column("kind").to_pylist(), rows.column("blob").to_pylist()
        ids, offsets, local = unpack(texts[kinds.index(MANIFEST)])
        ids, local = ids.reshape(-1, 4), local.reshape(-1, 2)
        starts, ends = [local[:, 0]], [local[:, 1]]
        for kind, text in zip(kinds, texts, strict=True):
            if kind == FOUND:
                s, n = (x.astype(np.int64) for x in unpack(text))
                starts.append(s)
                ends.append(s + n)
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        # one spare place after each document keeps the runs of neighbours apart
        a, b = tk.runs(tk.cover(int(offsets[-1]) + len(ids), starts + doc, ends + doc))
        doc = np.searchsorted(offsets[1:] + np.arange(len(ids)) + 1, a, side="right")
        pairs = np.stack([a - offsets[doc] - doc, b - offsets[doc] - doc], axis=1).astype("<i4")
        which, first = np.unique(doc, return_index=True)
        cuts = [*first.tolist(), len(pairs)]
        return pa.table({
            "doc_id": pa.array(ids[which, 0], mask=ids[which, 1] == 0),
            "text_hash": pa.array(ids[which, 2]),
            "occurrence": pa.array(ids[which, 3], pa.int32()),
            "spans": pa.array([pairs[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        })

    found = blobs.groupBy("at").applyInArrow(settle, "kind int, chunk long, blob binary")
    return found.groupBy("chunk").applyInArrow(home, SPANS)


def spans_of(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", "<i4").reshape(-1, 2).astype(np.int64)


def with_spans(docs: DataFrame, spans: DataFrame, ranges: int | None) -> DataFrame:
    """Documents and spans in one stream: (doc_id, text_hash, text, occurrence, spans), where the spans of a
    (doc_id, text_hash) stand before its documents. Ordered by doc_id over all partitions if `ranges` is given
    (a null id last), else only dealt out by (doc_id, text_hash). One shuffle of the texts, no join."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("int").alias("occurrence"), F.lit(None).cast("binary").alias("spans"))
    marks = spans.select("doc_id", "text_hash", F.lit(None).cast("string").alias("text"), "occurrence", "spans")
    both = texts.unionByName(marks)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()]
    both = both.repartitionByRange(ranges, *order) if ranges else both.repartition("doc_id", "text_hash")
    return both.sortWithinPartitions(*order, F.col("text").isNotNull(), "occurrence")


def attached(batch: pa.RecordBatch, state: dict) -> tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]:
    """The documents of a batch of with_spans(), the spans of each (of its occurrence, or of all), and their occurrence numbers.

    state carries the current key, its spans and the count of its documents so far from batch to batch."""
    ids, hashes, have = batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.asarray(batch.column(2).is_valid())
    spans, numbers = [], []
    occurrences, blobs = batch.column(3).to_pylist(), batch.column(4)
    for i, key in enumerate(zip(ids, hashes, strict=True)):
        if state.get("key") != key:
            state.update(key=key, spans={}, count=0)
        if not have[i]:
            before = state["spans"].get(occurrences[i])
            new = spans_of(blobs[i].as_py())
            state["spans"][occurrences[i]] = new if before is None else np.concatenate([before, new])
        else:
            spans.append(state["spans"] if state.get("all") else state["spans"].get(state["count"], np.zeros((0, 2), dtype=np.int64)))
            numbers.append(state["count"])
            state["count"] += 1
    return batch.filter(pa.array(have)), spans, np.array(numbers, dtype=np.int64)
