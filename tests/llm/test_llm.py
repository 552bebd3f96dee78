"""The training-data operators against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from episodia.llm import common, decontaminate, exchange, language_id, mixing, quality_classifier, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, textkit, textstats, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def table(spark, texts, start=0, lang="en"):
    rows = [(start + i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, self-repeats, null, empty and long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    passage = prose(rng, 60)
    texts += [texts[3], texts[3], texts[5] + " tail", "head " + texts[5]]
    texts += [prose(rng, rng.randint(0, 30)) + " " + passage + " " + prose(rng, 10) for _ in range(5)]
    texts += [" ".join(["loop"] * 70), "aé " * 150, None, "", "   \n\t ", prose(rng, 19), prose(rng, 20)]
    texts += [passage[k:] for k in (1, 2, 3)] + [prose(rng, 3000)]
    return texts


def doubled(spark, texts):
    """With repeated rows, null ids and clashing extra columns."""
    df = table(spark, texts)
    more = spark.createDataFrame([(None, texts[0], None, None, None), (None, None, None, None, None), (2, texts[2], None, None, None)], SCHEMA)
    return df.unionByName(more).withColumn("fp", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("shard", F.lit(7)).withColumn("score", F.lit(0))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- kernels ----------------------------------------------------------------


def test_words_and_hashes():
    texts = ["ab c  d", None, "", "é x\n", "c ab"]
    data, at = textkit.buffers(pa.array(texts))
    s, e, first = textkit.words(data, at, textkit.SPACE_WORDS)
    assert [data[i:j].tobytes().decode() for i, j in zip(s, e)] == ["ab", "c", "d", "é", "x", "c", "ab"]
    assert first.tolist() == [0, 3, 3, 3, 5, 7]
    h = textkit.byte_hash(textkit.byte_sums(data), s, e)
    assert h[0] == h[6] and h[1] == h[5] and len(set(h.tolist())) == 5


def test_slices_cover_all_rows():
    batch = pa.record_batch({"text": pa.array(["a" * n for n in (5, 50, 1, 1, 200, 3)])})
    parts = list(textkit.slices(batch, limit=20))
    assert len(parts) > 2
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()


def test_pack_round_trip():
    a, b = np.array([3, 70_000, 70_001]), np.array([1, 2], dtype=np.uint8)
    x, y = exchange.unpack(exchange.pack(exchange.deltas(a), b))
    assert exchange.undelta(x).tolist() == a.tolist() and y.tolist() == [1, 2]


# --- op1 and op7 ------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 4000)
    texts = corpus(seed)
    got = substring_dedup.deduplicated(table(spark, texts).repartition(5)).collect()
    want = {r[0]: r[1:] for r in substring_dedup.brute(list(enumerate(texts)))}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 4000)
    texts = corpus(seed)
    got = suffix_dedup.deduplicated(table(spark, texts).repartition(5)).collect()
    want = {r[0]: r[1:] for r in suffix_dedup.brute(list(enumerate(texts)))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got} == want


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 99, (300, 12)).astype(np.uint8)
    sizes = rng.integers(0, 13, 300)
    body[np.arange(12)[None, :] >= sizes[:, None]] = 0
    group = np.sort(rng.integers(0, 9, 300))
    order, common = suffix_dedup.Suffixes(body, sizes).array(group)
    text = [(group[i], body[i, : sizes[i]].tobytes()) for i in order]
    assert text == sorted(text)
    for k in range(1, 300):
        if group[order[k]] == group[order[k - 1]]:
            a, b = text[k - 1][1], text[k][1]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == n


def test_a_hash_collision_is_caught(monkeypatch):
    body = np.array([[3, 1], [1, 2], [2, 9], [1, 1]], dtype=np.uint8)
    s = suffix_dedup.Suffixes(body, np.full(4, 2))
    s.sums[:] = 0  # every prefix seems equal
    order, common = s.array(np.zeros(4, dtype=np.int64))
    assert [body[i].tolist() for i in order] == [[1, 1], [1, 2], [2, 9], [3, 1]] and common.tolist() == [-1, 1, 0, 0]


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_dedup_edges(spark, op):
    texts = corpus(3, 20)
    df = doubled(spark, texts)
    got = op.deduplicated(df).collect()
    assert len(got) == len(texts) + 3
    two = sorted(r["n_removed"] for r in got if r["doc_id"] == 2)
    assert two[0] < two[1] or len(texts[2].split()) < 20
    assert op.deduplicated(empty(spark)).count() == 0


@pytest.fixture
def many_tasks(spark):
    """A file a task, and a task for each shuffle partition."""
    new = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "128m"}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def files_of(monkeypatch, module):
    """Gets the numbers of files of the tables that the module writes from now on."""
    counts = []

    def written(df, *more):
        out = common.written(df, *more)
        counts.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(module, "written", written)
    return counts


def test_substring_dedup_writes_few_files(spark, monkeypatch, tmp_path, many_tasks):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 3000)
    texts = corpus(1)
    table(spark, texts).repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    counts = files_of(monkeypatch, substring_dedup)
    substring_dedup.op1_substring_dedup(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert len(counts) == 2 and max(*counts, len(out.inputFiles())) <= 4
    assert sorted(map(tuple, out.collect())) == substring_dedup.brute(list(enumerate(texts)))


# --- op8 --------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    low = defaultdict(lambda: 1 << 64)
    for i in range(len(fps)):
        low[find(i)] = min(low[find(i)], ids[i])
    return [low[find(i)] for i in range(len(fps))]


def near_copies(seed=4):
    rng = random.Random(seed)
    texts = corpus(seed, 40)
    long = prose(rng, 600).split()
    for k in range(12):
        other = list(long)
        other[(7 * k) % 600] = f"new{k}"
        texts.append(" ".join(other))
    return texts + ["One TWO three", "one two THREE", "One two", "Ä Ö"]


def test_simhash_equals_brute_force(spark):
    texts = near_copies()
    got = simhash.near_duplicates(table(spark, texts)).collect()
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(list(range(len(texts))), fps)
    assert {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in got} == {i: (fps[i], want[i]) for i in range(len(texts))}
    kept = sorted(r["doc_id"] for r in simhash.keep_one(table(spark, texts)).collect())
    assert kept == sorted(set(want))


@pytest.mark.parametrize(("parts", "hot"), [(4, 50_000), (2, 50_000), (4, 20), (2, 3)])
def test_probing_misses_no_link(spark, monkeypatch, parts, hot):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, d, replace=False)) for b in base for d in (0, 1, 2, 3, 4)]
    nodes = spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp long")
    groups = simhash.bit_groups(nodes)
    assert sorted(b for g in groups for b in g) == list(range(64))
    shares = simhash.distance_tables(nodes, groups)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(simhash.probes(nodes, groups, shares, parts, len(fps)))).collect()}
    flat = sorted(set(fps))
    want = brute_components(flat, [f & (2**64 - 1) for f in flat])
    for f, w in zip(flat, want):
        assert got.get(f, f) == w


def test_thresholds_add_up():
    counts = np.random.default_rng(1).random((50, 4, 4)).cumsum(axis=2) * 100
    limits, _ = simhash.allocate(counts, 16)
    assert (limits.sum(axis=1) == simhash.RADIUS - 4 + 1).all() and limits.min() >= -1


def test_bucket_forest_spans(spark):
    rng = np.random.default_rng(2)
    fps = np.unique(np.array([1 << int(a) | 1 << int(b) for a, b in rng.integers(0, 20, (200, 2))], dtype=np.uint64))
    a, b = simhash.bucket_forest(fps)
    label = simhash.local_components(len(fps), np.searchsorted(fps, a), np.searchsorted(fps, b))
    assert len(a) < len(fps) and len(set(label.tolist())) == len(set(brute_components(list(range(len(fps))), fps.tolist())))


def test_dense_buckets_are_linked_whole():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 6).astype(np.uint64)
    fps = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (700, 3)).astype(np.uint64), axis=1) for b in base]))
    assert len(fps) > 3 * 1024
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.RADIUS
    a, b = np.nonzero(np.triu(near, 1))
    want = simhash.local_components(len(fps), a, b)
    u, v = simhash.bucket_forest(fps)
    got = simhash.local_components(len(fps), np.searchsorted(fps, u), np.searchsorted(fps, v))
    assert got.tolist() == want.tolist() and (np.bitwise_count(u ^ v) > 64).sum() == 0


def test_simhash_edges(spark):
    texts = near_copies()
    df = doubled(spark, texts)
    assert simhash.near_duplicates(df).count() == df.count()
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.where("doc_id = 2").count() == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


# --- op5 --------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    texts = corpus(6)
    items = [("a", texts[0][:30]), ("b", prose(rng, 40)), ("c", None), ("d", "..."), ("e", texts[7].upper()), ("e", "w1 w2"), ("f", texts[-1][100:400]), ("10", texts[5])]
    texts += [f"pre {items[1][1]} post", "W1, w2!", "w1 w2 " * 30]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.contamination(table(spark, texts).repartition(4), bench).collect()
    want = decontaminate.brute_contamination(texts, items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == dict(enumerate(want))
    bad = {i for i, (n, h, _) in enumerate(want) if h and 20 * h >= n}
    assert {r["doc_id"] for r in got if r["contaminated"]} == bad
    assert {r["doc_id"] for r in decontaminate.clean_documents(table(spark, texts), bench).collect()} == set(range(len(texts))) - bad


def test_benchmark_blocks_change_nothing(spark, monkeypatch):
    texts = corpus(7)
    bench = spark.createDataFrame([(i, texts[i]) for i in range(0, 40, 3)], "item_id long, text string")
    one = decontaminate.contamination(table(spark, texts), bench).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)
    assert [(r["n_hit"], r["items"]) for r in decontaminate.contamination(table(spark, texts), bench).orderBy("doc_id").collect()] == [(r["n_hit"], r["items"]) for r in one]


def test_decontamination_edges(spark):
    df = doubled(spark, corpus(8, 10))
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(df, none)
    assert got.count() == df.count() and got.where("contaminated").count() == 0
    assert decontaminate.clean_documents(df, none).columns == df.columns
    assert decontaminate.contamination(empty(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_proximity(spark):
    df = table(spark, ["x a y b z", "a 1 2 3 4 5 b", "b a"])
    terms = [b"a", b"b"]
    index = decontaminate.positional_index(df)
    got = sorted(r["doc_id"] for r in decontaminate.proximity_matches(index, terms, 3).collect())
    assert got == [0, 2]


def thue_morse(n, a="a", b="b"):
    """Two different strings of 2**n symbols whose polynomial hashes modulo 2**64 are equal for every odd base."""
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_strings_that_collide_modulo_a_power_of_two(spark):
    for n in (9, 10, 11, 12):
        x, y = thue_morse(n)
        data, at = textkit.buffers(pa.array([x, y]))
        if n >= 11:
            sums = textkit.byte_sums(data)
            assert len(set(textkit.byte_hash(sums, at[:-1], at[1:]).tolist())) == 1
        assert len(set(textkit.string_hash(data, textkit.byte_sums(data), at[:-1], at[1:]).tolist())) == 2
    rng = random.Random(21)
    twenty = prose(rng, 19)
    texts = [f"{x} {twenty}", f"{y} {twenty}", f"{x}\n{y}\n", f"{x} {twenty} {x} {twenty} {y}"]
    assert [r["n_removed"] for r in sorted(substring_dedup.deduplicated(table(spark, texts)).collect(), key=lambda r: r["doc_id"])] == [r[2] for r in substring_dedup.brute(list(enumerate(texts)))] == [0, 0, 0, 40]
    counts = textstats.base_counts(*textkit.buffers(pa.array(texts)))
    assert list(zip(*(counts[c].tolist() for c in quality_rules.COUNTS))) == [brute_counts(t) for t in texts]
    items = [("x", f"{x} {twenty}")]
    got = sorted(decontaminate.contamination(table(spark, texts), spark.createDataFrame(items, "item_id string, text string")).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == decontaminate.brute_contamination(texts, items)


# --- op6 and op4 ------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, hit = Counter(windows), [False] * len(words)
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit[i : i + 8] = [True] * 8
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(hit)


def test_base_counts_equal_brute_force():
    texts = [*corpus(9), "a\nb\na\n\n \n \na \n", "#<>|x * é&\n#<>|x * é&", " ".join("abcdefgh") * 3 + " " + " ".join("abcdefgh")]
    got = textstats.base_counts(*textkit.buffers(pa.array(texts)))
    assert list(zip(*(got[c].tolist() for c in quality_rules.COUNTS))) == [brute_counts(t) for t in texts]


def labelled(spark, n=300):
    rng = random.Random(10)
    good = ["The " + prose(rng, 60) + "." for _ in range(n)]
    bad = [" ".join(f"{w}%%%" for w in prose(rng, 60).split()) for _ in range(n // 4)]
    texts = good + bad
    labels = spark.createDataFrame([(i, int(i < n), 0) for i in range(0, len(texts))], "doc_id long, quality int, toxic int")
    return texts, table(spark, texts), labels, n


def test_quality_rules_reject_junk_only(spark):
    texts, df, labels, n = labelled(spark)
    got = {r["doc_id"]: r for r in quality_rules.quality_verdicts(df, labels).collect()}
    assert all(got[i]["kept"] == (i < n) for i in got)
    kept = quality_rules.keep_good(df, labels)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(n)) and kept.columns == df.columns
    none = labels.limit(0)
    assert quality_rules.quality_verdicts(df, none).where("not kept").count() == 0


def brute_ratio(texts, good):
    """The log-likelihood ratios by plain counting."""
    grams = lambda t: [t.encode()[i : i + 4] for i in range(len(t.encode()) - 3)]
    bucket = lambda g: (int.from_bytes(g, "little") * 0x9E3779B1 % 2**32) >> 16
    raw, trusted = Counter(bucket(g) for t in texts for g in grams(t)), Counter(bucket(g) for i in good for g in grams(texts[i]))
    p = lambda c, b: np.log((c[b] + 1) / (c.total() + 65536))
    return [np.mean([p(trusted, bucket(g)) - p(raw, bucket(g)) for g in grams(t)]) for t in texts]


def test_ratio_equals_brute_force(spark):
    texts, df, labels, n = labelled(spark, 40)
    got = {r["doc_id"]: r["llr"] for r in quality_rules.quality_verdicts(df, labels).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], brute_ratio(texts, range(n)))


def test_quality_edges(spark):
    df = doubled(spark, corpus(11, 10))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_verdicts(df, labels).count() == df.count()
    assert quality_rules.quality_verdicts(df, labels).where("n_words = 0 and not base_failed").count() == 0
    assert quality_rules.keep_good(df, labels).columns == df.columns
    assert quality_rules.quality_verdicts(empty(spark), labels).count() == 0
    assert quality_classifier.scored(df, labels).count() == df.count()
    assert quality_classifier.scored(empty(spark), labels).count() == 0


def test_rule_ensemble(spark):
    texts, df, labels, n = labelled(spark)
    train = labels.where("doc_id % 4 <> 2")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.scored(df, train).collect()}
    held = [i for i in got if i % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == (i < n) for i in held]) > 0.97
    one = quality_classifier.scored(df, train.where("quality = 1")).collect()
    assert all(r["score"] > 0.99 for r in one)


def test_compiled_rules_equal_their_truth(spark):
    x = np.random.default_rng(3).random((50, len(quality_classifier.FEATURES)))
    rules = [((("words", True, 0.5), ("digit_share", False, 0.7)), 1.5), ((("upper_share", True, 0.2),), -2.0)]
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, " + ", ".join(f"{f} double" for f in quality_classifier.FEATURES))
    got = [r["s"] for r in rows.withColumn("s", quality_classifier.RuleEnsemble(0.25, rules).column()).orderBy("i").collect()]
    want = 0.25 + sum(w * quality_classifier.truth(r, x) for r, w in rules)
    assert np.allclose(got, 1 / (1 + np.exp(-want)))


def test_lasso_equals_a_plain_solver():
    rng = np.random.default_rng(4)
    z = (rng.random((200, 12)) < 0.4).astype(float)
    y = (z[:, 0] + z[:, 1] - z[:, 2] + rng.normal(size=200) > 0.5).astype(float)
    penalty = 0.02
    b, w = 0.0, np.zeros(12)
    for _ in range(3000):  # cyclic coordinate steps on a quadratic bound of the loss
        p = 1 / (1 + np.exp(-(b + z @ w)))
        b -= 4 * (p - y).mean()
        for k in range(12):
            p = 1 / (1 + np.exp(-(b + z @ w)))
            curve = max((z[:, k] ** 2).mean() / 4, 1e-9)
            u = w[k] - (z[:, k] * (p - y)).mean() / curve
            w[k] = np.sign(u) * max(abs(u) - penalty / curve, 0)
    got_b, got_w = quality_classifier.lasso_logistic(z, y, penalty)
    assert abs(got_b - b) < 1e-3 and np.allclose(got_w, w, atol=1e-3) and (np.abs(w) < 1e-9).any()


def test_texts_longer_than_a_slice(spark):
    rng = random.Random(40)
    passage, item = prose(rng, 400), prose(rng, 30)
    long = " ".join([passage] * 700) + f" {item} " + prose(rng, 1000)
    assert len(long) > 1.1 * textkit.SLICE_BYTES
    texts = ["short one", long, None, passage + " end"]
    df = table(spark, texts)
    counts = textstats.base_counts(*textkit.buffers(pa.array(texts)))
    assert list(zip(*(counts[c].tolist() for c in quality_rules.COUNTS)))[1] == brute_counts(long)
    assert [r["fp"] & (2**64 - 1) for r in simhash.fingerprints(df).orderBy("doc_id").collect()] == [brute_fingerprint(t) for t in texts]
    got = decontaminate.contamination(df, spark.createDataFrame([("a", item)], "item_id string, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == decontaminate.brute_contamination(texts, [("a", item)])
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.quality_verdicts(df, labels).collect()}[1] == len(long.split())
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.rates(df, labels).collect()}[1] == len(long.split())
    assert quality_classifier.scored(df, labels).count() == 4 and {r["size"] for r in sharding.sharded(df).collect()} == {len(t or "") + 1 for t in texts}
    model = language_id.learn(df)
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identified(df, model).collect()} == {0: "en", 1: "en", 2: "und", 3: "en"}


@pytest.mark.parametrize("bits", [25, 8])
def test_joins_pick_exactly_what_matches(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "BITMAP_BITS", bits)
    df = doubled(spark, corpus(22, 300)).withColumn("k0", F.lit(5)).withColumn("__bitmapword", F.lit(6))
    gone = df.where("doc_id % 3 = 0 or doc_id is null").select(F.col("doc_id").alias("k0"), F.xxhash64("text").alias("k1")).distinct()
    for join, want in ((common.anti_joined, "doc_id % 3 <> 0"), (common.semi_joined, "doc_id % 3 = 0 or doc_id is null")):
        got = join(df, common.id_and_text(), gone)
        assert got.columns == df.columns and got.where("k0 <> 5 or __bitmapword <> 6").count() == 0
        rows = lambda x: Counter((r["doc_id"], r["text"]) for r in x.collect())
        assert rows(got) == rows(df.where(want))
    ids = spark.range(7).select(F.col("id").alias("k0"))
    assert sorted(r["doc_id"] for r in common.semi_joined(df.drop("k0"), [F.col("doc_id")], ids).collect()) == sorted(r["doc_id"] for r in df.where("doc_id < 7").collect())


def test_every_trusted_document_counts(spark):
    rng = random.Random(15)
    texts = [f"{rng.choice(WORDS)} {i}" for i in range(25_000)]
    labels = spark.createDataFrame([(i, 1, None) for i in range(24_000)] + [(3, 1, 0), (None, 1, 0), (24_500, 0, 0), (24_600, 1, 1)], "doc_id long, quality int, toxic int")
    counts = [np.bincount(quality_rules.gram_buckets(*textkit.buffers(pa.array(t)))[0], minlength=quality_rules.N_BUCKETS) for t in (texts[:24_000], texts)]
    good, raw = (np.log((n + 1) / (n.sum() + quality_rules.N_BUCKETS)) for n in counts)
    assert np.allclose(quality_rules.fit_ratios(table(spark, texts), labels), good - raw)


# --- op3 --------------------------------------------------------------------


def test_kneser_ney_sums_to_one():
    text = "the cat sat on the mat and the rat ran"
    data, at = textkit.buffers(pa.array([text]))
    keys, _ = language_id.gram_keys(*language_id.letters(data, at)[:2])
    grams, n = np.unique(keys, return_counts=True)
    alphabet = sorted({int(k) & 0xFFFF for k in grams})
    m = language_id.Model(grams, n, len(alphabet))
    for context in ("the", "   ", "xyz", " ma"):
        prefix = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context))
        total = np.exp(m.log_p(np.array([prefix | c for c in alphabet], dtype=np.uint64))).sum()
        assert abs(total - 1) < 1e-3


def test_languages(spark):
    rng = random.Random(12)
    a = ["der und die nicht " + " ".join(rng.choice(["schön", "haus", "weg", "straße"]) for _ in range(9)) for _ in range(40)]
    b = ["the and of not " + " ".join(rng.choice(["fine", "house", "way", "street"]) for _ in range(9)) for _ in range(40)]
    train = table(spark, a, 0, "de").unionByName(table(spark, b, 100, "en"))
    model = language_id.learn(train)
    odd = table(spark, [None, "", "123 !?", "x", "STRASSE und haus", "the house", "漢字漢字漢字"])
    got = {r["doc_id"]: r for r in language_id.identified(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and [got[i]["score"] for i in range(3)] == [0.0] * 3
    assert got[3]["lang_pred"] in ("de", "en") and got[4]["lang_pred"] == "de" and got[5]["lang_pred"] == "en"
    assert got[6]["rejected"] and all(0 <= r["score"] <= 1 for r in got.values())
    right = language_id.identified(train, model).join(train.select("doc_id", "lang"), "doc_id").where("lang = lang_pred").count()
    assert right == 80
    assert language_id.identified(empty(spark), model).count() == 0
    assert {r["lang_pred"] for r in language_id.identified(odd, language_id.learn(train.limit(0))).collect()} == {"und"}


def test_language_tables_hold_every_gram(spark):
    rng = random.Random(14)
    a = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèêëàâîïôûùçñ ") for _ in range(4000)) for _ in range(600)]
    b = ["straße und haus", "die nacht war kühl"]
    train = table(spark, a, 0, "en").unionByName(table(spark, b, 1000, "de"))
    model, texts = language_id.learn(train), [*a[:3], *b, "die straße", "漢字 haus", None]
    got = {r["key"]: r for r in language_id.entropies(table(spark, texts).select("doc_id", "text"), model).collect()}
    counts = {}
    for lang, own in (("de", b), ("en", a)):
        counts[lang] = np.unique(language_id.gram_keys(*language_id.letters(*textkit.buffers(pa.array(own)))[:2])[0], return_counts=True)
    assert [model.tables[-1].where(f"lang = '{x}'").count() for x in ("de", "en")] == [len(counts[x][0]) for x in ("de", "en")]
    alphabet = len(np.unique(np.concatenate([k for k, _ in counts.values()]) & np.uint64(0xFFFF))) + 1
    for k, lang in enumerate(("de", "en")):
        m = language_id.Model(*counts[lang], alphabet)
        for i, text in enumerate(texts):
            keys, _ = language_id.gram_keys(*language_id.letters(*textkit.buffers(pa.array([text])))[:2])
            assert abs(got[i]["entropy"][k] + m.log_p(keys).mean()) < 1e-4
    rare = {r["doc_id"]: r["lang_pred"] for r in language_id.identified(table(spark, texts), model).collect()}
    assert rare[3] == rare[4] == rare[5] == "de" and rare[0] == "en"


def counted_kneser_ney(texts):
    """log p(last character | the three before) by the textbook's counts."""
    plain = [" ".join(re.sub(r"[^a-z]+", " ", t.lower()).split()) for t in texts]
    levels = {4: Counter(x[i : i + 4] for t in plain for x in [f"   {t} "] for i in range(len(x) - 3))}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount = {}
    for n, level in levels.items():
        ones, twos = (sum(v == k for v in level.values()) for k in (1, 2))
        discount[n] = ones / (ones + 2 * twos) if ones and twos else 0.5
    after = {n: defaultdict(list) for n in levels}
    for n, level in levels.items():
        for g, v in level.items():
            after[n][g[:-1]].append(v)
    alphabet = len(levels[1]) + 1

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / alphabet
        seen = after[n].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        return max(levels[n].get(gram, 0) - discount[n], 0) / sum(seen) + discount[n] * len(seen) / sum(seen) * p(gram[1:])

    return lambda gram: np.log(p(gram))


def test_models_equal_counted_kneser_ney(spark):
    rng = random.Random(31)
    words = ["the", "then", "than", "cat", "cart", "rat", "ran", "mat", "on", "one"]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    log_p = counted_kneser_ney(texts)
    model = language_id.learn(table(spark, texts))
    probes = ["the cat ran on a mat", "xyz the qrt", "one", "Cart-cart!"]
    got = {r["key"]: r for r in language_id.entropies(table(spark, probes).select("doc_id", "text"), model).collect()}
    for i, t in enumerate(probes):
        x = f"   {' '.join(re.sub(r'[^a-z]+', ' ', t.lower()).split())} "
        want = -np.mean([log_p(x[k : k + 4]) for k in range(len(x) - 3)])
        assert abs(got[i]["entropy"][0] - want) < 1e-5


def test_letters_beyond_the_basic_plane(spark):
    train = table(spark, ["𐐨𐐩𐐪 𐐫𐐬𐐭 " * 20], 0, "aa").unionByName(table(spark, ["𐒰𐒱𐒲 𐒳𐒴𐒵 " * 20], 10, "bb"))
    model = language_id.learn(train)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identified(table(spark, ["𐐨𐐩𐐪 𐐫𐐬𐐭", "𐒰𐒱𐒲 𐒳𐒴𐒵"]).withColumn("score", F.lit(1)).withColumn("key", F.lit(2)), model).collect()}
    assert got == {0: "aa", 1: "bb"}


# --- op2 --------------------------------------------------------------------


def test_rates_meet_the_targets(spark):
    texts, df, labels, n = labelled(spark)
    want = {"quality1-toxic0": 0.9, "quality0-toxic0": 0.1}
    rows = mixing.rates(df, labels, want).collect()
    p, t, r = (np.array([x[c] for x in rows], dtype=float) for c in ("posterior", "n_tokens", "rate"))
    totals = (t * r) @ p
    assert (r >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert np.allclose(totals / totals.sum(), [0.1, 0.9], atol=1e-3) and abs(totals.sum() / t.sum() - 1) < 1e-3
    assert rows[0]["domains"] == ["quality0-toxic0", "quality1-toxic0"] and np.allclose(rows[0]["reached_shares"], totals / totals.sum())


def dense_rates(n, p, wanted, ridge):
    """The same least squares by cyclic exact coordinate minimisation."""
    r, size = np.ones(len(n)), n.sum()
    error = n @ p - wanted
    for _ in range(4000):
        for d in range(len(n)):
            best = max(0.0, (ridge - p[d] @ error / size + n[d] * r[d] / size * (p[d] @ p[d])) / (ridge + n[d] / size * (p[d] @ p[d])))
            error += n[d] * (best - r[d]) * p[d]
            r[d] = best
    return r


@pytest.mark.parametrize("k", [2, 4])
def test_rates_equal_a_dense_solver(spark, k):
    rng = np.random.default_rng(k)
    p = rng.dirichlet(np.full(k, 0.3), 40)
    n = rng.integers(0, 300, 40).astype(float)
    names = [f"d{i}" for i in range(k)]
    rows = spark.createDataFrame([(int(a), list(map(float, b))) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    for targets in ({"d0": 0.7, "d1": 0.2}, {"d0": 0.999}, {}):
        g, totals, wanted = mixing.fit_rates(rows, names, targets, ridge=0.02)
        r = dense_rates(n, p, wanted, 0.02)
        used = n > 0
        assert np.allclose(mixing.rates_at(p, g, 0.02)[used], r[used], atol=1e-5) and np.allclose((n * r) @ p, totals, rtol=1e-5)


def test_mixing_edges(spark):
    df = doubled(spark, corpus(13, 10))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mixing.rates(df, none).collect()
    assert len(got) == df.count() and all(abs(r["rate"] - 1) < 1e-9 for r in got)
    assert mixing.mixed(df, none).columns == df.columns and mixing.mixed(df, none).count() == df.count()
    assert mixing.rates(empty(spark), none).count() == 0


def test_posteriors_are_few_files(spark, monkeypatch, tmp_path, many_tasks):
    texts, df, labels, _ = labelled(spark)
    df.repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    counts = files_of(monkeypatch, mixing)
    mixing.op2_mixing(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.mixed(docs, labels).count() > 0
    assert len(counts) == 2 and max(*counts, len(out.inputFiles())) <= 4
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in df.collect())


# --- op9 --------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    bodies = ["<p>é</p>\r\n\r\nWARC/1.0\r\n", "", None, "same", "same", "x" * 70_000, "same", "a\n\nb\r\n"]
    pages = spark.createDataFrame([(10 - i, f"http://www.b{i % 3}.example.com/p{i}?q=1\n", b) for i, b in enumerate(bodies)] + [(99, None, "last")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archived(pages.withColumn("digest", F.lit("clash")), str(tmp_path / "w")).collect()}
    assert len(got) == 9 and all(r["intact"] for r in got.values())
    import base64

    first = {}
    for i, b in sorted(enumerate(bodies), key=lambda x: 10 - x[0]):
        first.setdefault(b or "", 10 - i)
    for i, b in enumerate(bodies):
        r, body = got[10 - i], (b or "").encode()
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        own = first[b or ""] == 10 - i
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own else ("revisit", first[b or ""]))
    assert warc.archived(pages.limit(0), str(tmp_path / "e")).count() == 0
    small = {r["page_id"]: r for r in warc.archived(pages, str(tmp_path / "s"), revisit_from=10).collect()}
    assert all(r["record_type"] == "response" for r in small.values())


def test_captures_are_fetched_by_offset(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "MEMBER_BYTES", 20_000)
    rng = random.Random(3)
    bodies = [prose(rng, rng.randint(0, 300)) for _ in range(60)] + [prose(rng, 20_000), "é" * 50_000]
    ids = [*range(len(bodies) - 4), 10**12, -(10**12), 2**63 - 1, -(2**63)]
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", b) for i, b in zip(ids, bodies)], "page_id long, url string, html string")
    rows = warc.archived(pages.repartition(3), str(tmp_path / "w")).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(ids) and all(r["intact"] for r in rows)
    text, files = dict(zip(ids, bodies)), {}
    for r in rows:
        content = files.setdefault(r["archive"], open(r["archive"].removeprefix("file:"), "rb").read())
        fields, block = warc.record_at(content, r["offset"], r["length"])
        assert block.split(b"\r\n\r\n", 1)[1].decode() == text[r["page_id"]] and fields["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>"
    import gzip

    assert len(files) > 5 and sum(gzip.decompress(x).count(b"WARC/1.0\r\n") for x in files.values()) == len(rows)


def test_null_and_repeated_pages(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "x"), (3, "u", "x"), (3, "u", "x"), (None, "v", "y"), (None, "v", "y")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in warc.archived(pages, str(tmp_path / "w")).collect())
    assert got == [(-1, "response", None), (-1, "response", None), (-1, "revisit", 3), (3, "response", None), (3, "response", None)]


def test_loser_tree():
    rng = random.Random(14)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 50), j) for _ in range(rng.randint(0, 20))) for j in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_global_order(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i * 37 % 100}", f"b{i}") for i in range(200)], "page_id long, url string, html string")
    keys = [(r["url_key"], r["captured"]) for r in warc.archived(pages.repartition(6), str(tmp_path / "w")).collect()]
    assert keys == sorted(keys) and len(keys) == 200


# --- op10 -------------------------------------------------------------------


def brute_minimax(sizes, k):
    def fits(c):
        used, left = 0, k
        for s in sizes:
            if s > c:
                return False
            if used + s > c:
                left, used = left - 1, 0
            used += s
        return left >= 1

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


@pytest.mark.parametrize(("seed", "hot"), [(1, 0), (2, 0), (3, 4000), (4, 40_000)])
def test_shards_reach_the_least_capacity(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(sharding, "DIGITS", 1)
    rng = random.Random(seed)
    texts = ["x" * rng.randint(0, 300) + str(rng.random()) for _ in range(150)] + [prose(rng, 20)] * 7 + ([("y" * hot)] if hot else [])
    rows = sharding.sharded(table(spark, texts)).collect()
    groups = defaultdict(int)
    for t in texts:
        groups[hashlib.md5(t.encode()).hexdigest()] += len(t.encode()) + 1
    totals, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        totals[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(totals.values()) == brute_minimax([v for _, v in sorted(groups.items())], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(totals) <= set(range(8))
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())


@pytest.mark.parametrize("hot", [[], [0.25], [0.3, 0.2, 0.001]])
def test_a_hot_group_opens_few_ranges(spark, monkeypatch, hot):
    n, seen = 40_000, []
    plain = sharding.Ordered.open_ranges
    monkeypatch.setattr(sharding.Ordered, "open_ranges", lambda self, shards: seen.append(plain(self, shards)) or seen[-1])
    groups = spark.range(n).select(F.md5(F.col("id").cast("string").cast("binary")).alias("key"), (F.col("id") % 300 + 1).alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0]
    for k, share in enumerate(hot):
        groups = groups.withColumn("bytes", F.when(F.col("key") == hashlib.md5(str(99 + k).encode()).hexdigest(), int(total * share)).otherwise(F.col("bytes")))
    cuts = sharding.minimax_cuts(groups.cache())
    rows = sorted((r["key"], r["bytes"]) for r in groups.collect())
    totals = Counter()
    for key, size in rows:
        totals[sum(key >= c for c in cuts)] += size
    assert max(totals.values()) == brute_minimax([v for _, v in rows], 8)
    assert max(map(len, seen)) < 100


def test_sharding_edges(spark):
    df = doubled(spark, ["a", None, ""])
    got = sharding.sharded(df).collect()
    assert len(got) == 6 and {r["size"] for r in got if r["doc_id"] == 1} == {1}
    import zlib

    assert {(r["text_crc32"], r["law"], r["grown_shard"]) for r in got if r["doc_id"] == 0} == {(zlib.crc32(b"a"), "bytes", None)}
    assert sharding.sharded(empty(spark)).count() == 0
