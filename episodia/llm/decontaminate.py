"""Operator 5, benchmark decontamination with a distributed positional inverted index.

The corpus index is partitioned by document: a shard is `SHARD_BYTES` of texts
and one row, which stores every term of these texts with the sorted word
positions at which it occurs, and the shard's document table. The index does not
depend on what is searched. A search takes a phrase's terms from the rarest (by
corpus-wide counts) on: the rarest list gives candidate starts, and each further
list, shifted by the term's offset in the phrase, is intersected with them by
binary search. `phrase_matches` are exact up to 64-bit term keys (a false hit
needs a window whose every differing term collides; textkit.string_hash);
`proximity_matches` finds documents where all terms stand within a span of words.

The benchmark is the stated query set: it is read in blocks of bounded size and
every block is searched in all shards, where they lie: no postings are moved, and
no list of a frequent term is ever gathered in one place.

Defined results: a null text has no words; a document without words is clean;
an item without words has no window; items that share an id count once, a null
item_id counts as the string 'null'; terms of equal count are taken in the order
of the phrase; a text longer than a shard is a shard of its own; repeated rows
and null doc_ids are judged row by row; empty tables give clean documents or no
rows; other columns are ignored by the search and kept by `clean_documents`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import anti_joined, id_and_text, pieces, table, written

WINDOW = 13
SHARD_BYTES = 2_000_000
#: Benchmark text searched at once, in bytes; more is searched block after block.
BLOCK_BYTES = 1_000_000
#: Windows, and candidate places, that a search looks at together.
AT_ONCE = 1 << 17
#: Share of a document's words, in percent, from which hits count as contamination.
PERCENT = 5

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: head: the shard's document table; terms: sorted keys; sizes: of their lists; places: all lists, one after another.
INDEX = "shard long, head binary, terms binary, sizes binary, places binary"


def item_terms(texts: list[str | None]) -> list[list[bytes]]:
    """The words of each text, A-Z lower-cased."""
    return [_WORD.findall(bytes(tk.LOWER[np.frombuffer((t or "").encode(), dtype=np.uint8)])) for t in texts]


def term_keys(terms: list[bytes]) -> np.ndarray:
    """The 64-bit key that stands for each term."""
    data = np.frombuffer(b" ".join(terms), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in terms]) - 1 if terms else np.zeros(0, dtype=np.int64)
    starts = ends - np.array([len(t) for t in terms], dtype=np.int64) if terms else ends
    return tk.string_hash(data, tk.byte_sums(data), starts, ends)


def positional_index(docs: DataFrame) -> DataFrame:
    """The postings of all terms of (doc_id, text): INDEX, a row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, words, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def packed() -> pa.RecordBatch:
            keys, counts, ids, hashes, known = (np.concatenate(x) for x in zip(*held, strict=True))
            places = np.argsort(keys, kind="stable").astype("<i4")
            keys = keys[places]
            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, dtype=np.int64)
            head = b"".join(x.astype("<i8").tobytes() for x in (np.concatenate([[0], np.cumsum(counts)]), ids, hashes, known))
            blobs = [head, keys[cut[:-1]].astype("<u8").tobytes(), np.diff(cut).astype("<i4").tobytes(), places.tobytes()]
            return pa.record_batch([pa.array([shard]), *(pa.array([x], pa.binary()) for x in blobs)], names=["shard", "head", "terms", "sizes", "places"])

        for whole in batches:
            for batch in tk.slices(whole):
                data, at = tk.buffers(batch.column(1))
                data = tk.LOWER[data]
                starts, ends, first = tk.words(data, at, tk.ALNUM_WORDS)
                ids = batch.column(0).cast(pa.int64())
                held.append((tk.string_hash(data, tk.byte_sums(data), starts, ends), np.diff(first), ids.fill_null(0).to_numpy(), batch.column(2).to_numpy(), np.asarray(ids.is_valid())))
                size += int(at[-1])
                if size >= SHARD_BYTES:
                    yield packed()
                    shard, size, held = shard + 1, 0, []
        if held:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, INDEX)


def stored_index(docs: DataFrame) -> DataFrame:
    """positional_index, written. Row groups are bounded by bytes, as a row is large."""
    return written(positional_index(docs), "postings", {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 2, "parquet.page.size.row.check.min": 1, "compression": "zstd"})


def document_arrays(head: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word offsets, ids, text hashes and which ids are not null, from a shard's document table."""
    n = (len(head) // 8 - 1) // 4
    whole = np.frombuffer(head, "<i8")
    first, ids, hashes, known = np.split(whole, [n + 1, 2 * n + 1, 3 * n + 1])
    return first, ids, hashes, known.astype(bool)


class Shard:
    """The postings of one shard, ready to be searched."""

    def __init__(self, head: bytes, terms: bytes, sizes: bytes, places: bytes):
        self.first, self.ids, _, self.known = document_arrays(head)
        self.terms = np.frombuffer(terms, "<u8")
        counts = np.frombuffer(sizes, "<i4")
        self.ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.places = np.frombuffer(places, "<i4")
        #: All lists in one sorted array: the list's number, then the place.
        self.joint = self.places + (np.repeat(np.arange(len(counts)), counts) << 32)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The list of each term key, or -1."""
        at = np.minimum(np.searchsorted(self.terms, keys), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == keys, at, -1) if len(self.terms) else np.full(keys.shape, -1)

    def has(self, lists: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = (lists << 32) + places
        at = np.minimum(np.searchsorted(self.joint, wanted), max(len(self.joint) - 1, 0))
        return self.joint[at] == wanted

    def phrases(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence."""
        numbers, out = self.number(block.terms), []
        there = np.append(numbers >= 0, True)  # the last stands for the places behind a short window
        for low in range(0, len(block.windows), AT_ONCE):
            live = low + np.flatnonzero(there[block.windows[low : low + AT_ONCE]].all(axis=1))
            rarest = numbers[block.windows[live, block.ranks[live, 0]]]
            counts = self.ends[rarest + 1] - self.ends[rarest]
            part = np.cumsum(counts) // AT_ONCE
            for k in np.unique(part):
                mine = part == k
                out.append(self._intersected(block, numbers, live[mine], rarest[mine], counts[mine]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 2

    def _intersected(self, block: Block, numbers: np.ndarray, live: np.ndarray, rarest: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which = np.repeat(live, counts)
        begin = np.repeat(self.ends[rarest] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        start = self.places[begin].astype(np.int64) - block.ranks[which, 0]
        for k in range(1, block.windows.shape[1]):
            more = k < block.sizes[which]
            if not more.any():
                break
            offset = block.ranks[which, k]
            ok = ~more | ((start >= 0) & self.has(numbers[np.where(more, block.windows[which, offset], 0)], start + offset))
            which, start = which[ok], start[ok]
        doc = np.searchsorted(self.first, start, side="right") - 1
        ok = (start >= 0) & (doc < len(self.ids))
        which, start, doc = which[ok], start[ok], doc[ok]
        ok = start + block.sizes[which] <= self.first[doc + 1]
        return which[ok], start[ok]


class Block:
    """The windows of a block of items: as numbers of its distinct terms, filled up with one number more where a window is short."""

    def __init__(self, items: list, window: int):
        self.names = [r["item_id"] for r in items]
        words = [term_keys(t) for t in item_terms([r["text"] for r in items])]
        self.terms, codes = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *words]), return_inverse=True)
        bounds = np.cumsum([0, *map(len, words)])
        self.sizes = np.concatenate([np.zeros(0, dtype=np.int64), *(np.full(max(len(w) - window + 1, min(len(w), 1)), min(len(w), window)) for w in words)]).astype(np.int64)
        counts = [max(len(w) - window + 1, min(len(w), 1)) for w in words]
        self.owner = np.repeat(np.arange(len(words)), counts)
        starts = bounds[self.owner] + np.arange(len(self.owner)) - (np.cumsum(counts) - counts)[self.owner] if len(words) else np.zeros(0, dtype=np.int64)
        steps = np.arange(window)
        at = np.minimum(starts[:, None] + steps, max(len(codes) - 1, 0))
        self.windows = np.where(steps < self.sizes[:, None], codes[at] if len(codes) else 0, len(self.terms)).astype(np.int32)
        self.ranks = np.zeros(self.windows.shape, dtype=np.int8)

    def rank(self, counts: np.ndarray) -> None:
        """Orders each window's offsets, rarest term first. counts: of each term in the corpus."""
        often = np.append(counts, np.iinfo(np.int64).max)
        for low in range(0, len(self.windows), AT_ONCE):
            self.ranks[low : low + AT_ONCE] = np.argsort(often[self.windows[low : low + AT_ONCE]], axis=1, kind="stable")


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the given sorted term keys occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for own, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(own, "<u8")
                at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
                hit = terms[at] == own
                total[at[hit]] += np.frombuffer(sizes, "<i4")[hit]
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(terms), dtype=np.int64)
    if len(terms):
        for r in index.select("terms", "sizes").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[r["term"]] = r["n"]
    return out


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list]:
    """The benchmark's rows (item_id as string, text), in blocks of about BLOCK_BYTES."""
    count = pieces(benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0, BLOCK_BYTES, 1)
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    for k in range(count):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect() if count > 1 else rows.collect()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), Shard(*(batch.column(k)[i].as_py() for k in range(1, 5)))


def phrase_matches(index: DataFrame, items: list, window: int = WINDOW) -> DataFrame:
    """(shard, doc_no, spans, items): hit word ranges of every document with a window of an item."""
    block = Block(items, window)
    block.rank(term_counts(index, block.terms))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, shard in _shards(batches):
            which, start = shard.phrases(block)
            doc = np.searchsorted(shard.first, start, side="right") - 1
            order = np.argsort(doc, kind="stable")
            which, start, doc = which[order], start[order], doc[order]
            hit = tk.cover(int(shard.first[-1]), start, start + block.sizes[which])
            docs, begin = np.unique(doc, return_index=True)
            spans, names = [], []
            for d, i, j in zip(docs, begin, np.append(begin, len(doc))[1:], strict=True):
                a, b = tk.runs(hit[shard.first[d] : shard.first[d + 1]])
                spans.append(np.stack([a, b], axis=1).ravel())
                names.append(sorted({block.names[k] for k in np.unique(block.owner[which[i:j]])}))
            yield pa.record_batch([pa.array([key] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], names=["shard", "doc_no", "spans", "items"])

    return index.mapInArrow(search, "shard long, doc_no long, spans array<long>, items array<string>")


def proximity_matches(index: DataFrame, terms: list[bytes], span: int) -> DataFrame:
    """(doc_id, place): where all terms stand within `span` words of one document; place is the rarest term's, counted in the document."""
    keys = term_keys(terms)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard in _shards(batches):
            lists = shard.number(keys)
            ids, at = [], []
            if len(lists) and (lists >= 0).all():
                each = sorted((shard.places[shard.ends[k] : shard.ends[k + 1]] for k in lists), key=len)
                for p in each[0].tolist():
                    d = int(np.searchsorted(shard.first, p, side="right")) - 1
                    lo, hi = shard.first[d], shard.first[d + 1]
                    near = [x[np.searchsorted(x, max(lo, p - span + 1)) : np.searchsorted(x, min(hi, p + span))] for x in each[1:]]
                    starts = {p, *(int(v) for x in near for v in x if v <= p)}
                    if any(all(((x >= s) & (x < s + span)).any() for x in near) for s in starts if s > p - span):
                        ids.append(int(shard.ids[d]) if shard.known[d] else None)
                        at.append(int(p - lo))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(at, pa.int64())], names=["doc_id", "place"])

    return index.mapInArrow(search, "doc_id long, place long")


def _document_table(index: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first, ids, hashes, known = document_arrays(head)
                n = len(ids)
                yield pa.record_batch([pa.array(np.full(n, key)), pa.array(np.arange(n)), pa.array(ids, mask=~known), pa.array(hashes), pa.array(np.diff(first))], names=["shard", "doc_no", "doc_id", "text_hash", "n_words"])

    return index.select("shard", "head").mapInArrow(run, "shard long, doc_no long, doc_id long, text_hash long, n_words long")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids of items with occurring windows) and contaminated."""
    index = stored_index(docs)
    found = None
    for block in benchmark_blocks(benchmark):
        part = phrase_matches(index, block)
        found = part if found is None else found.unionByName(part)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, names = [], []
            for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = (np.concatenate([np.asarray(s[k::2], dtype=np.int64) for s in spans]) for k in (0, 1))
                hits.append(int(tk.cover(int(b.max()), a, b).sum()))
                names.append(sorted({i for x in items for i in x}))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string()))], names=["shard", "doc_no", "n_hit", "items"])

    hit = found.groupBy("shard", "doc_no").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    hit = hit.mapInArrow(measure, "shard long, doc_no long, n_hit long, items array<string>")
    out = _document_table(index).join(hit, ["shard", "doc_no"], "left")
    out = out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * PERCENT))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("k0"), F.col("text_hash").alias("k1")).distinct()
    return anti_joined(docs, id_and_text(), written(bad, "contaminated"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def brute_contamination(texts: list[str | None], items: list[tuple[str, str | None]]) -> list[tuple[int, int, list[str]]]:
    """(n_words, n_hit, items) of each text, by comparing every window: for tests."""
    out = []
    for words in item_terms(texts):
        hit, names = [False] * len(words), set()
        for name, terms in zip((n for n, _ in items), item_terms([t for _, t in items]), strict=True):
            for i in range(max(len(terms) - WINDOW + 1, min(len(terms), 1))):
                win = terms[i : i + WINDOW]
                for s in range(len(words) - len(win) + 1):
                    if words[s : s + len(win)] == win:
                        hit[s : s + len(win)] = [True] * len(win)
                        names.add(name)
        out.append((len(words), sum(hit), sorted(names)))
    return out


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
