import numpy as np
import pytest
from helpers import T0, frame

from episodia.config import FeatureSettings, ForestSettings, ReconstructionSettings, RuleSettings
from episodia.models import autoencoder, forest
from episodia.models.forest import IsolationForest
from episodia.models.reconstruct import Reconstruction, validation_split, with_windows
from episodia.models.rules import RuleModel


def cloud(spark, n=300, odd=()):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(n)] + [(n + k, *map(float, v)) for k, v in enumerate(odd)]
    return frame(spark, rows, "a double, b double")


def test_forest_direction_and_determinism(spark):
    train, rows = cloud(spark), cloud(spark, 300, [(8.0, 8.0)])
    scores = lambda: [r["score"] for r in IsolationForest(["a", "b"], ForestSettings(trees=30)).fit(train).score(rows).orderBy("us").collect()]
    one = scores()
    assert one[-1] == max(one) and one == scores()


def test_forest_ablation_names_the_odd_feature(spark):
    m = IsolationForest(["a", "b"], ForestSettings(trees=50, ablation=True)).fit(cloud(spark))
    got = m.contributions(frame(spark, [(0, 9.0, 0.0)], "a double, b double")).first()
    assert got["c_a"] > got["c_b"]
    off = IsolationForest(["a", "b"], ForestSettings(trees=5)).fit(cloud(spark))
    assert off.contributions(cloud(spark, 3)).first()["c_a"] == 0.0


def test_one_episode_is_explained(spark):
    m = IsolationForest(["a", "b"], ForestSettings(trees=50)).fit(cloud(spark))
    rows = frame(spark, [(0, 0.0, 0.0), (1, 9.0, 0.0), (2, 9.0, 0.1), (3, 0.0, 0.0)], "a double, b double")
    got = m.explain_episode(rows, T0 + 1_000_000, T0 + 2_000_000).orderBy("place").collect()
    assert [r["contributor"] for r in got] == ["a", "b"] and got[0]["value"] > got[1]["value"]
    with pytest.raises(ValueError, match="no rows"):
        m.explain_episode(rows, T0 + 10_000_000, T0 + 20_000_000)


def test_forest_fills_missing_with_training_medians(spark):
    m = IsolationForest(["a", "b"], ForestSettings(trees=10)).fit(cloud(spark))
    assert 0 < m.score(frame(spark, [(0, None, None)], "a double, b double")).first()["score"] < 0.6


def test_forest_scores_equal_plain_recursion(spark):
    m = IsolationForest(["a", "b"], ForestSettings(trees=70, max_samples=64)).fit(cloud(spark))

    def depth(tree, x, node=0):
        feature, threshold, left, value = tree
        return value[node] if feature[node] < 0 else depth(tree, x, left[node] + int(x[feature[node]] > threshold[node]))

    h = np.log(63) + np.euler_gamma
    for r in m.score(cloud(spark, 20, [(9.0, 9.0)])).collect():
        want = 2 ** (-np.mean([depth(t, (r["a"], r["b"])) for t in m.trees]) / (2 * h - 2 * 63 / 64))
        assert abs(r["score"] - want) < 1e-9
    assert len(m.trees) == 70 and abs(forest.path_norm(64) - (2 * h - 2 * 63 / 64)) < 1e-12


def test_unfitted_raises(spark):
    for m in (IsolationForest(["a"]), Reconstruction(["a"], 3)):
        with pytest.raises(ValueError):
            m.score(cloud(spark, 3))


def waves(spark, n=200, spike=None):
    rows = [(i, float(np.sin(i / 5)), 5.0 if i == spike else float(np.cos(i / 5))) for i in range(n)]
    return with_windows(frame(spark, rows, "a double, b double"), ["a", "b"], 8, ["asset_id"])


def test_reconstruction_finds_the_channel(spark):
    m = Reconstruction(["a", "b"], 8, ReconstructionSettings(bottleneck=3)).fit(waves(spark))
    got = m.contributions(waves(spark, spike=100)).where(f"us = {T0 + 103 * 1_000_000}").first()
    assert got["c_b"] > 10 * got["c_a"]
    scores = [r["score"] for r in m.score(waves(spark, spike=100)).orderBy("us").collect()]
    assert len(scores) == 193 and max(scores[:90]) < 1e-6 < max(scores)


def test_validation_is_the_tail(spark):
    got = validation_split(cloud(spark, 10), 0.15, ["asset_id"]).orderBy("us").collect()
    assert [r["validation"] for r in got] == [False] * 8 + [True] * 2


@pytest.mark.parametrize("activation", sorted(autoencoder.ACTIVATIONS))
def test_gradients_equal_differences(activation):
    rng = np.random.default_rng(1)
    net = autoencoder.ConvNet(3, 11, ReconstructionSettings(widths=(4, 5), kernel=3, bottleneck=2, activation=activation))
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, weight, trace = rng.normal(size=(2, 11, 3)), rng.normal(size=(2, 11, 3)), []
    assert net.forward(x, trace=trace).shape == x.shape
    for name, g in net.backward(trace, weight).items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        two = []
        for h in (1e-6, -1e-6):
            net.p[name][at] += h
            two.append((net.forward(x) * weight).sum())
            net.p[name][at] -= h
        assert abs((two[0] - two[1]) / 2e-6 - g[at]) < 1e-4


@pytest.mark.parametrize(("length", "widths", "kernel"), [(7, (4,), 3), (8, (4, 3), 5), (33, (4, 3, 2), 5), (10, (2, 2), 3)])
def test_windows_come_back_at_their_length(length, widths, kernel):
    net = autoencoder.ConvNet(2, length, ReconstructionSettings(widths=widths, kernel=kernel))
    assert net.forward(np.zeros((3, length, 2), dtype=np.float32)).shape == (3, length, 2)
    y = np.random.default_rng(0).normal(size=(1, net.lengths[1], widths[0]))
    x = np.random.default_rng(1).normal(size=(1, length, 2))
    w = net.p["down0"].astype(float)
    assert np.isclose((autoencoder.gather(x, w) * y).sum(), (x * autoencoder.spread(y, w, length)).sum())


def test_autoencoder_settings_are_checked():
    for wrong in ({"kernel": 4}, {"widths": ()}, {"activation": "none"}):
        with pytest.raises(ValueError):
            autoencoder.ConvNet(2, 10, ReconstructionSettings(**wrong))


def test_autoencoder_learns_and_attributes(spark):
    s = ReconstructionSettings(widths=(8, 8), kernel=3, bottleneck=4, epochs=60, patience=60, learning_rate=0.01, batch=16)
    m = autoencoder.ConvAutoencoder(["a", "b"], 8, s)
    with pytest.raises(ValueError):
        m.score(waves(spark))
    m.fit(waves(spark))
    assert m.epochs_run == 60 and m.validation_loss < 0.1 and m.elapsed_s > 0
    got = m.contributions(waves(spark, spike=100)).where(f"us = {T0 + 103 * 1_000_000}").first()
    assert got["c_b"] > 3 * got["c_a"]
    again = autoencoder.ConvAutoencoder(["a", "b"], 8, s).fit(waves(spark))
    one, two = ([r["score"] for r in x.score(waves(spark)).orderBy("us").collect()] for x in (m, again))
    assert one == two and len(one) == 193
    assert m.score(waves(spark).limit(0)).count() == 0


def test_autoencoder_stops_early_and_keeps_the_best(spark):
    x = np.random.default_rng(0).normal(size=(40, 8, 2)).astype(np.float32)
    s = ReconstructionSettings(widths=(4,), kernel=3, bottleneck=2, epochs=500, patience=2, learning_rate=0.05, batch=8)
    m = autoencoder.ConvAutoencoder(["a", "b"], 8, s)
    m._train(x[:32], x[32:])
    assert m.epochs_run < 500 and np.isclose(m._squares(m.net, x[32:]).mean(), m.validation_loss)
    m = autoencoder.ConvAutoencoder(["a", "b"], 8, ReconstructionSettings(widths=(4,), kernel=3, minutes=0.0))
    m._train(x, x[:0])
    assert m.epochs_run == 0 and m.validation_loss is None


def rule_frame(spark, cycles, short=()):
    rows, t = [], 0
    for c in range(cycles):
        for label, n in (("LOADED", 3), ("OFFLOAD", 6), ("STOPPED", 4 if c in short else 12)):
            for k in range(n):
                rows.append((t, label, 9.0 - (0.1 * k if label == "STOPPED" else 0.0)))
                t += 60
    return frame(spark, rows, "regime string, value double")


def test_rules(spark):
    f = FeatureSettings(decay_channel="value", gap="5min", duty="10min")
    m = RuleModel(f, RuleSettings(baseline="3h"), ["asset_id"]).fit(rule_frame(spark, 20))
    assert m.contributors == ["short_stopped_duration", "fast_pressure_decay", "low_peak_pressure", "high_duty_ratio"]
    got = m.score(rule_frame(spark, 20, short=(18,))).orderBy("us").collect()
    assert got[-1]["short_stopped_duration"] > 0.7 and got[-1]["score"] >= got[-1]["short_stopped_duration"]
    assert max(r["short_stopped_duration"] for r in got[60:300]) < 0.3
    with pytest.raises(ValueError):
        RuleModel(f, RuleSettings(enabled=("other",)))


def test_rule_plan_is_linear(spark):
    f = FeatureSettings(decay_channel="value", gap="5min", duty="10min")
    m = RuleModel(f, RuleSettings(baseline="3h"), ["asset_id"], ["asset_id"]).fit(rule_frame(spark, 3))
    text = m.score(rule_frame(spark, 3))._jdf.queryExecution().executedPlan().toString()
    assert text.count("FlatMapGroupsInPandas") == 1 and text.count("Scan ExistingRDD") == 2 and text.count("Join") == 0


def test_calibration_quantile(spark):
    f = FeatureSettings(decay_channel="value", gap="5min", duty="10min")
    m = RuleModel(f, RuleSettings(baseline="3h"), ["asset_id"], ["asset_id"])
    with pytest.raises(ValueError):
        m.calibration_quantile("high_duty_ratio", 0.5)
    m.fit(rule_frame(spark, 20))
    got = [m.calibration_quantile("high_duty_ratio", q).first()["value"] for q in (0.0, 0.5, 1.0)]
    assert got[0] == 0.0 and got[0] <= got[1] <= got[2] <= 1.0
    with pytest.raises(KeyError):
        m.calibration_quantile("other", 0.5)


def test_lagged_warm_up_is_unknown(spark):
    f = FeatureSettings(decay_channel="value", gap="5min", duty="10min")
    m = RuleModel(f, RuleSettings(baseline="1h", mode="lagged", lag="2h", enabled=("short_stopped_duration", "high_duty_ratio")), ["asset_id"])
    got = m.fit(rule_frame(spark, 20)).score(rule_frame(spark, 20)).orderBy("us").collect()
    assert got[10]["short_stopped_duration"] is None and got[10]["score"] == got[10]["high_duty_ratio"]
    assert got[-1]["short_stopped_duration"] is not None


@pytest.mark.parametrize("mode", ["trailing", "lagged"])
def test_rules_judge_by_the_past_of_the_same_series(spark, mode):
    f, df = FeatureSettings(decay_channel="value", gap="1h", duty="1h"), rule_frame(spark, 20)
    cut = df.selectExpr("percentile_approx(us, 0.5)").first()[0]
    m = lambda: RuleModel(f, RuleSettings(baseline="3h", mode=mode, lag="1h"), ["asset_id"], ["asset_id"])
    two, one = m().fit(df.where(f"us < {cut}")), m().fit_until(cut)
    got, want = (sorted(x.score(df).select("us", *two.contributors, "score").collect(), key=repr) for x in (one, two))
    assert got == want and len({r["score"] for r in got}) > 2
