import os

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame
from pyspark.sql import functions as F

from episodia.config import FeatureSettings, RegimeSettings, RuleSettings
from episodia.models.rules import RuleModel
from episodia.operators import episodes, rank, regimes, stretches
from episodia.plans import catalogue, evaluation
from episodia.plans import params as P
from episodia.schema import plan_table

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
MIN = 60_000_000


def rows_of(rng, n):
    """Times with ties and holes, labels in runs, values with missing ones and constant stretches."""
    us = np.cumsum(rng.choice([0, 1, 2, 3, 200], n, p=[0.3, 0.3, 0.2, 0.19, 0.01])) * MIN
    label = np.repeat(rng.choice(["LOADED", "OFFLOAD", "STOPPED", "TRANSITION"], n), rng.integers(1, 9, n))[:n]
    value = [None if x < 0.1 else round(float(x) * 4) / 4 for x in rng.random(n)]
    return us, label, value


def test_moving_medians_equal_numpy():
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=300), rng.integers(0, 4, 300).astype(float), np.full(5, np.nan), np.zeros(1)):
        values[rng.random(len(values)) < 0.2] = np.nan
        lo = rng.integers(0, len(values), 200)
        hi = np.minimum(len(values), lo + rng.integers(0, 60, 200))
        want = [np.median(x) if len(x := values[a:b][np.isfinite(values[a:b])]) else np.nan for a, b in zip(lo, hi, strict=True)]
        assert np.array_equal(stretches.medians(values, lo, hi), want, equal_nan=True)


@pytest.mark.parametrize("lag", [None, 90 * MIN])
def test_blocks_do_not_show(monkeypatch, lag):
    facts = {"a": ("STOPPED", "duration_s", True), "b": ("STOPPED", "abs_slope", False), "c": ("OFFLOAD", "peak", True)}
    wanted = stretches.Wanted(facts, {"d": ("LOADED", 30 * MIN)}, 100 * MIN, 120 * MIN, lag)
    us, label, value = rows_of(np.random.default_rng(1), 600)
    keys = ["A"] * 250 + ["B"] * 350
    us[250:] -= us[250]

    def all_rows(block, batch):
        monkeypatch.setattr(stretches, "BLOCK_ROWS", block)
        whole = pa.table([keys, us, label, pa.array(value, pa.float64())], names=["k", "us", "regime", "__y"])
        out, codes, state = [], {}, None
        for key, end, part in stretches._series(iter(whole.to_batches(batch)), 1, lambda: len(state.us) if state else 0):
            state = state or stretches.Series(wanted, codes)
            named = np.array([codes.setdefault(t, len(codes)) for t in part.column("regime").to_pylist()])
            y = part.column("__y").combine_chunks()
            start, got, has = state.block(part.column("us").to_numpy(), named, y.fill_null(0.0).to_numpy(), np.asarray(y.is_valid()))
            assert start[0] and len(start) == part.num_rows
            out += [(*key, t, *(round(float(got[n][i]), 9) if has[n][i] else None for n in "abcd")) for i, t in enumerate(part.column("us").to_pylist())]
            state = None if end else state
        return out

    want = all_rows(1 << 18, 1000)
    assert len(want) == 600 and len({r[2:] for r in want}) > 50
    for block, batch in ((1, 1), (7, 3), (100, 40)):
        assert all_rows(block, batch) == want


@pytest.mark.parametrize("mode", ["trailing", "lagged"])
def test_packed_quantities_equal_those_of_rows(spark, mode):
    us, label, value = rows_of(np.random.default_rng(2), 500)
    us = us + np.arange(500) * 1_000_000  # no ties, whose order is open
    df = frame(spark, [(float(t) / 1e6, str(s), v) for t, s, v in zip(us, label, value, strict=True)], "regime string, value double")
    m = RuleModel(FeatureSettings(decay_channel="value", gap="100min", duty="30min"), RuleSettings(baseline="3h", mode=mode, lag="1h"), ["asset_id"])
    names = [f"q_{r}" for r in m.contributors]
    packed = m.quantities(df, None, True).selectExpr("explode(__us) us", *names)
    got, want = ([tuple(None if x is None else f"{x:.9g}" for x in r) for r in x.select(*names, "us").orderBy("us").collect()] for x in (packed, m.quantities(df)))
    assert got == want and len({r[:-1] for r in got}) > 50


def test_packed_rows_give_the_episodes_and_thresholds_of_rows(spark):
    rng = np.random.default_rng(3)
    at, score = np.cumsum(rng.choice([1, 2, 50, 500], 400, p=[0.6, 0.3, 0.08, 0.02])), np.repeat(rng.choice([0.1, 0.5, 0.9], 400), rng.integers(1, 6, 400))[:400]
    rows = frame(spark, [(float(t), float(s)) for t, s in zip(at, score, strict=True)], "score double")
    new = np.concatenate([[True], (np.diff(score) != 0) | (np.diff(at) > 100)])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], 400) - 1
    packed = frame(spark, [(float(at[a]), float(score[a]), int(b - a + 1), int(at[b] - at[a])) for a, b in zip(starts, ends, strict=True)], "score double, __n int, d long")
    packed = packed.selectExpr("asset_id", "us", "score", "__n", "us + d * 1000000 __until")
    flagged = [episodes.flag_episodes(x, catalogue.F.lit(0.5), 5_000_000, 100_000_000, ["asset_id"]) for x in (rows, packed)]
    want, got = (sorted(episodes.episodes(x, ["asset_id"]).collect()) for x in flagged)
    assert got == want and len(got) > 5
    want, got = (sorted(rank.thresholds(x, "score", [0.3, 0.5, 0.95], ["asset_id"]).collect()) for x in (rows, packed))
    assert got == want
    want, got = (rank.score_shift(x, x, "score", ["asset_id"]).collect() for x in (rows, packed))
    assert got == want


REGIMES = RegimeSettings(states={"LOADED": {"on": 1.0}}, split_channel="value", split_at=0.5, min_duration="3min", settle="2min")


def raw_rows(spark, n=600, missing=False):
    """Rows of two series without regimes at distinct times, in no order; with one row each that has no time, if wanted."""
    rng, rows = np.random.default_rng(4), []
    for asset in "AB":
        us = np.cumsum(rng.choice([1, 2, 3, 200], n, p=[0.5, 0.3, 0.19, 0.01])) * MIN
        on = np.repeat(rng.choice([0.0, 1.0], n), rng.integers(1, 9, n))[:n]
        value = np.repeat(rng.choice([0.0, 0.25, 0.5, 1.0], n), rng.integers(1, 9, n))[:n]
        rows += [(asset, int(t), float(a), None if k % 17 == 0 else float(v)) for k, (t, a, v) in enumerate(zip(us, on, value, strict=True))]
        rows += [(asset, None, 1.0, 0.0)] * missing
    return spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "asset_id string, us long, on double, value double")


@pytest.mark.parametrize("missing", [False, True])
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_labels_equal_those_of_rows(spark, block, missing):
    df, names = raw_rows(spark, 300, missing).cache(), [*regimes.state_names(REGIMES), REGIMES.transition]
    for asset in "AB":
        rows = regimes.assign_regimes(df.where(F.col("asset_id") == asset), REGIMES).withColumn("raw", regimes.raw_state(REGIMES)).orderBy("us").collect()
        us = np.array([stretches.NEVER if r.us is None else r.us for r in rows])
        raw, labels = np.array([names.index(r.raw) for r in rows]), stretches.Labels(3 * MIN, 2 * MIN, 3)
        got = np.concatenate([labels.block(us[a : a + block], raw[a : a + block]) for a in range(0, len(us), block)])
        assert [names[k] for k in got] == [r.regime for r in rows] and len(set(got.tolist())) == 4


@pytest.mark.parametrize("pack,batch,block", [(1, 1, 1), (50, 20, 30), (1 << 18, 1000, 1 << 18)])
def test_packed_rows_come_back_whole_and_in_order(monkeypatch, pack, batch, block):
    monkeypatch.setattr(stretches, "PACK_ROWS", pack)
    monkeypatch.setattr(stretches, "PACKED_ROWS", 3)
    monkeypatch.setattr(stretches, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    rows = [(k, int(t), int(r), v) for k, t, r, v in zip(rng.choice(["A", "B", None], 400), rng.integers(-5, 300, 400) * 10 * MIN, rng.integers(0, 4, 400), [None, 1.5, float("nan"), 0.0] * 100, strict=True)] + [("A", None, 1, 2.0)]
    table = pa.table(list(zip(*rows)), schema=pa.schema([("k", pa.string()), ("us", pa.int64()), ("__raw", pa.int8()), ("__y", pa.float64())]))
    packed = pa.Table.from_batches(stretches._pack(iter(table.to_batches(batch)), 1)).sort_by([("k", "ascending"), ("__hour", "ascending")])
    got, ended = [], []
    for key, end, part in stretches._unpack(iter(packed.combine_chunks().to_batches(batch)), 1, lambda: 0):
        got += [(*key, None if r["us"] == stretches.NEVER else int(r["us"]), int(r["raw"]), float(r["y"]) if r["there"] else None) for r in part]
        ended += [key] * end
    assert sorted(map(repr, got)) == sorted(map(repr, rows)) and len(ended) == len(set(ended)) == 3
    for k in ("A", "B", None):
        times = [stretches.NEVER if t is None else t for x, t, _, _ in got if x == k]
        assert times == sorted(times)


@pytest.mark.parametrize("missing", [False, True])
def test_scopes_of_raw_rows_equal_series_of_labelled_rows(spark, missing):
    df = raw_rows(spark, missing=missing)
    periods = {0: ((0, 300 * MIN), (420 * MIN, 900 * MIN)), 1: ((200 * MIN, 1000 * MIN),), 2: ((10**15, 10**15 + 1),)}
    m = RuleModel(FeatureSettings(decay_channel="value", gap="100min", duty="30min"), RuleSettings(baseline="3h", mode="trailing"), ["asset_id"], (), REGIMES)
    names = [f"q_{r}" for r in m.contributors]
    by_scope = m.scoped_quantities(df, [[stretches.Scope(0, periods[0])], [stretches.Scope(k, periods[k]) for k in (1, 2)]], times=True)
    summed = m.scoped_quantities(df, [[stretches.Scope(k, periods[k]) for k in periods]])
    text = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows.collect())
    labelled, all_rows = regimes.assign_regimes(df, REGIMES), 0
    for k in periods:
        inside = F.lit(False)
        for a, b in periods[k]:
            inside = inside | ((F.col("us") >= a) & (F.col("us") < b))
        want = text(m.quantities(labelled.where(inside)).select("asset_id", "us", *names))
        assert text(by_scope.where(F.col("__scope") == k).select("asset_id", F.explode("__us").alias("us"), *names)) == want
        packed = by_scope.where(F.col("__scope") == k).select("asset_id", *names, F.get("__us", F.lit(0)), F.element_at("__us", -1), F.size("__us"))
        assert text(summed.where(F.col("__scope") == k).select("asset_id", *names, "us", "__until", "__n")) == text(packed)
        all_rows += len(want)
    assert all_rows > 300


def test_rows_without_a_time_are_not_dropped_in_silence(spark):
    m = RuleModel(FeatureSettings(decay_channel="value"), RuleSettings(), ["asset_id"], ["asset_id"], REGIMES).fit_until(100 * MIN)
    with pytest.raises(Exception, match="a row has no time"):
        m.score(raw_rows(spark, 20, True)).collect()


def test_unpacked_scores_spread_over_all_tasks(spark):
    """Adaptive execution put the few packed rows, and with them all that they stand for, into one task."""
    m = RuleModel(FeatureSettings(decay_channel="value"), RuleSettings(), ["asset_id"], ["asset_id"], REGIMES).fit_until(100 * MIN)
    assert m.score(raw_rows(spark)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_plan_tables_equal_created_ones(spark):
    ddl = "a int, b double, c string, d array<struct<x:long,y:long>>"
    for rows in ([(1, 0.1 + 0.2, "x'\"", [(2**62, -1)]), (None, 1e300, None, []), (2, None, "ü", None)], []):
        got, want = plan_table(spark, rows, ddl), spark.createDataFrame(rows, ddl)
        assert got.collect() == want.collect() and got.schema.simpleString() == want.schema.simpleString()


@needs_data
@pytest.mark.parametrize("name", ["rule_shift", "rule_score", "rule_evaluation", "rule_pooled"])
def test_rule_queries_move_packed_rows_and_keep_no_labelled_ones(spark, name):
    text = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "__rows" in text and "__held" not in text


@needs_data
def test_scores_stay_packed_and_whole(spark):
    p = catalogue._plan(spark, SF)
    f = evaluation.folds.fold_table(spark, p.folds)
    want = evaluation.folds.train_rows(p.rows, f).count(), evaluation.in_test(p, evaluation.folds.fold_rows(p.rows, evaluation.folds.fold_table(spark, p.extended))).count()
    test, train = evaluation.rule_scores(p)
    assert (train.agg({"__n": "sum"}).first()[0], test.agg({"__n": "sum"}).first()[0]) == want
    assert train.count() < want[0] and test.count() < want[1]
    p.release()


@needs_data
@pytest.mark.parametrize("name", ["rule_episodes", "rule_shift", "rule_score", "rule_evaluation", "rule_pooled"])
def test_rule_queries_take_one_pass_for_all_quantities(spark, name):
    text = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "FlatMapGroupsInPandas" not in text
