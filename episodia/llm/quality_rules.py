"""Operator 6, quality rules: base rules and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are estimated: one from trusted
documents (labelled good and not toxic), one from the whole raw corpus. A
document's score is the mean over its n-grams of log p_trusted - log p_raw, so
it does not depend on length; a document is kept if no base rule fails and its
score is at least the threshold. Every document is scored and thresholded, with
no random part.

Defined results: a null or empty text has no words, so base_failed; a text
shorter than an n-gram scores 0; without trusted documents all scores are 0;
repeated rows and null ids are judged one by one, on their own text; a score
equal to the threshold passes; a very long text is read whole, in a slice of its
own; an id with several labels is trusted if one of them is; an empty table gives
an empty result; other columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import semi_joined, table
from .textstats import base_counts

N_GRAM = 4
N_BUCKETS = 1 << 16
#: Nats per n-gram below which a document is rejected.
THRESHOLD = -0.6
SMOOTHING = 1.0

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def gram_buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram within a text, and the n + 1 n-gram offsets of the texts."""
    sizes = np.maximum(np.diff(at) - N_GRAM + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if len(data) < N_GRAM:
        return np.zeros(0, dtype=np.int64), offsets
    packed = np.zeros(len(data) - N_GRAM + 1, dtype=np.uint32)
    for k in range(N_GRAM):
        packed |= data[k : k + len(packed)].astype(np.uint32) << np.uint32(8 * k)
    inside = np.ones(len(packed) + 1, dtype=np.int32)
    inside[:] = 0
    ends = at[1:]
    np.add.at(inside, np.clip(np.maximum(ends - N_GRAM + 1, at[:-1]), 0, len(packed)), 1)
    np.add.at(inside, np.clip(ends, 0, len(packed)), -1)
    packed = packed[np.cumsum(inside[:-1]) == 0]
    return ((packed * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) & (N_BUCKETS - 1), offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(N_BUCKETS, dtype=np.int64)
    for whole in batches:
        for batch in tk.slices(whole):
            n += np.bincount(gram_buckets(*tk.buffers(batch.column(0)))[0], minlength=N_BUCKETS)
    at = np.flatnonzero(n)
    yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "n": n[at]})


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """The n-grams of all texts by bucket."""
    rows = docs.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(N_BUCKETS)
    out[rows["bucket"]] = rows["n"]
    return out


def fit_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_trusted - log p_raw of every bucket: N_BUCKETS numbers, counted over all rows and all trusted rows."""
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("k0"))
    good = bucket_counts(semi_joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), [F.col("doc_id")], trusted))
    if not good.sum():
        return np.zeros(N_BUCKETS)
    raw = bucket_counts(docs)
    p = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * N_BUCKETS))
    return p(good) - p(raw)


def judge(data: np.ndarray, at: np.ndarray, ratios: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The counts, base_failed, kept and llr of each text of one slice."""
    out = base_counts(data, at)
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    grams, offsets = gram_buckets(data, at)
    out["llr"] = tk.per_text(ratios[grams], offsets) / np.maximum(np.diff(offsets), 1)
    out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold)
    return out


def quality_verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with its counts, score and verdict."""
    ratios = fit_ratios(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole):
                got = judge(*tk.buffers(batch.column(1)), ratios, threshold)
                cols = [batch.column(0).cast(pa.int64()), *(pa.array(got[c].astype(np.int64)) for c in COUNTS), pa.array(got["base_failed"]), pa.array(got["kept"]), pa.array(got["llr"])]
                yield pa.record_batch(cols, names=["doc_id", *COUNTS, "base_failed", "kept", "llr"])

    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with all their columns; rows are filtered where they are read."""
    ratios = fit_ratios(docs, labels)
    at_text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            named = pa.record_batch(whole.columns, names=[f"c{i}" for i in range(whole.num_columns)])
            for batch in tk.slices(named, f"c{at_text}"):
                got = judge(*tk.buffers(batch.column(at_text)), ratios, threshold)
                yield pa.record_batch(batch.filter(pa.array(got["kept"])).columns, names=whole.schema.names)

    return docs.mapInArrow(keep, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
