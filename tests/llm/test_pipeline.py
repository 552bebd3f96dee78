"""The pipeline against its stages' definitions, and the entry points."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_llm import SCHEMA, brute_components, brute_fingerprint, brute_minimax, labelled, prose

import __spark_entry__
from episodia.llm import decontaminate, mixing
from episodia.llm.common import table


def write(spark, path, texts, labels, items):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    texts, _, labels, n = labelled(spark, 80)
    rng = random.Random(20)
    item = prose(rng, 30)
    texts = [*texts, None, "", texts[0], texts[1], f"The {item} end of it all here."]
    write(spark, str(tmp_path), texts, labels, [(1, item), (2, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    good = [i for i in [*range(n), len(texts) - 3, len(texts) - 2, len(texts) - 1]]
    parts = brute_components(good, [brute_fingerprint(texts[i]) for i in good])
    want = {i for i in set(parts) if not _dirty(texts[i], item)}
    assert {r["doc_id"] for r in docs.collect()} == want
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # mixing: each document as often as its rate and its hash say
    scored = mixing.rates(docs, labels).select("doc_id", "rate")
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) / float(1 << 32)
    copies = {r["doc_id"]: math.floor(r["rate"] + r["u"]) for r in docs.join(scored, "doc_id").select("doc_id", "rate", unit.alias("u")).collect()}
    assert Counter(r["doc_id"] for r in got) == Counter(copies)
    # sharding: whole groups of equal texts, the least capacity, slots without gaps
    groups, totals, slots = Counter(), Counter(), defaultdict(list)
    for r in got:
        size = len(texts[r["doc_id"]].encode()) + 1
        assert r["size"] == size and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        groups[hashlib.md5(texts[r["doc_id"]].encode()).hexdigest()] += size
        totals[r["shard"]] += size
        slots[r["shard"]].append(r["slot"])
    assert max(totals.values()) == brute_minimax([v for _, v in sorted(groups.items())], 8)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(got[0].asDict()) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}


def test_pipeline_of_nothing(spark, tmp_path):
    write(spark, str(tmp_path), [], spark.createDataFrame([], "doc_id long, quality int, toxic int"), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    texts, _, labels, n = labelled(spark, 40)
    rows = [(i, t, "en", "s", len(t or ""), i, i, i) for i, t in enumerate([*texts, texts[0], None])]
    spark.createDataFrame(rows + [(None, texts[3], None, None, None, 0, 0, 0)], f"{SCHEMA}, shard int, score int, root int").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "none of these words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/s{k}")
        docs = spark.read.parquet(f"{tmp_path}/s{k}")
        assert docs.columns == names
    assert docs.where("doc_id <> shard or shard <> score or score <> root").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def _dirty(text, item):
    ((n, h, _),) = decontaminate.brute_contamination([text], [("1", item)])
    return bool(h) and 20 * h >= n


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert all(sum(x.startswith(f"op{k}_") for x in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_digest_of_no_items():
    assert decontaminate.items_digest([]) == hashlib.sha256(b"").hexdigest()


def test_copies_and_batches_stay_small(spark, tmp_path):
    batch = pa.record_batch({"doc_id": [1, 2, 3, 4], "text": ["a" * 900_000, None, "b" * 300_000, "c"]})
    parts = list(mixing.repeated(batch, np.array([40, 2, 0, 3]), 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == [1] * 40 + [2] * 2 + [4] * 3
    assert all(p.nbytes < 2_500_000 for p in parts)
    assert [p.num_rows for p in mixing.repeated(batch, np.zeros(4, dtype=np.int64), 1)] == [0]
    spark.range(0, 8000, 1, 1).selectExpr("id doc_id", "repeat('word ', 600) text").write.parquet(f"{tmp_path}/documents.parquet")
    sizes = table(spark, str(tmp_path), "documents").mapInArrow(lambda it: (pa.record_batch({"n": [b.nbytes]}) for b in it), "n long").collect()
    assert max(r["n"] for r in sizes) < 3_000_000
