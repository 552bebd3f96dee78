import pytest
from helpers import MIN, T0, column, frame

from episodia.config import ScalingSettings, WindowSettings
from episodia.operators import sampling, scaling


def minutes(spark, skip=()):
    return frame(spark, [(60 * i, float(i), float(i % 7)) for i in range(200) if i not in skip], "a double, b double")


@pytest.mark.parametrize(("stride", "skip", "n"), [(2, (), 96), (1, (), 191), (2, range(100, 120), 82)])
def test_window_counts(spark, stride, skip, n):
    assert sampling.windows(minutes(spark, skip), 10, stride, MIN, 0.1, ["a", "b"]).count() == n


def test_missing_values_drop_windows(spark):
    df = frame(spark, [(60 * i, None if i == 15 else float(i)) for i in range(30)], "a double")
    assert sampling.windows(df, 10, 1, MIN, 0.1, ["a"]).count() == 21 - 10


def test_window_rows_and_guards():
    s = WindowSettings(window="10min", stride_train="2min", stride_score="1min")
    assert sampling.window_rows(s, MIN) == (10, 2) and sampling.window_rows(s, MIN, "score") == (10, 1)
    with pytest.raises(ValueError):
        sampling.window_rows(s, MIN, "other")
    with pytest.raises(ValueError, match="embargo"):
        sampling.check_embargo(WindowSettings(window="2h"), "1h")


def test_window_stats(spark):
    got = sampling.window_stats(minutes(spark), 10, ["a"]).orderBy("us").collect()[9]
    assert (got["a_mean"], got["a_min"], got["a_max"], got["a_slope"]) == (4.5, 0.0, 9.0, 0.9)
    with pytest.raises(ValueError):
        sampling.window_stats(minutes(spark), 10, ["a"], stats=["median"])


def test_resample(spark):
    df = frame(spark, [(10, 2.0, 0.0), (40, 4.0, 1.0), (300, 9.0, 1.0)], "a double, d double")
    got = sampling.resample(df, MIN, ["a"], ["d"]).orderBy("bin_us").collect()
    assert [(r["a"], r["d"]) for r in got] == [(3.0, 1.0), *[(None, None)] * 4, (9.0, 1.0)]


def test_gaps_and_neighbours(spark):
    df = spark.createDataFrame([("A", T0 + s * 1_000_000) for s in (0, 10, 610, 620)], "asset_id string, us long")
    assert [(r["start_us"] - T0, r["end_us"] - T0) for r in sampling.gaps(df, 5 * MIN).collect()] == [(10_000_000, 610_000_000)]
    assert column(sampling.near_gap(df, 5 * MIN, 9_000_000), "gap_adjacent") == [False, True, True, False]


def test_mode_takes_the_first_among_equals(spark):
    df = spark.createDataFrame([("A", T0 + s * 1_000_000) for s in (0, 20, 30, 50, 60)], "asset_id string, us long")
    got = sampling.profile(df, MIN).first()
    assert got["mode_us"] == 20_000_000 and got["n_rows"] == 5 and got["span_s"] == 60


def test_scalers(spark):
    df = frame(spark, [(i, float(v), 5.0) for i, v in enumerate([1, 2, 3, 4, 100])], "x double, y double")
    got = {r["channel"]: (r["center"], r["scale"]) for r in scaling.fit(df, ["x", "y"]).collect()}
    assert got == {"x": (3.0, 2.0), "y": (5.0, 1.0)}
    assert column(scaling.transform(df, scaling.fit(df, ["x"]), ["x"]), "x")[3] == 0.5
    with pytest.raises(ValueError):
        scaling.fit(df, ["x"], "other")
    with pytest.raises(ValueError):
        scaling.transform(df, scaling.fit(df, ["x"]), ["x", "y"])


def test_regime_scalers(spark):
    rows = [(i, "LOADED" if i < 10 else "STOPPED", float(i), 1.0) for i in range(20)]
    df = frame(spark, rows, "regime string, x double, flag double")
    s = ScalingSettings(channels=("x",), passthrough=("flag",), min_samples=5, active={"LOADED": ("x",), "STOPPED": ()})
    fit = scaling.fit_by_regime(df, s, ["asset_id"])
    got = column(scaling.transform_by_regime(df, fit, s, ["asset_id"]), "x")
    assert got[10:] == [0.0] * 10 and got[0] == -1.0
    with pytest.raises(ValueError, match="fewer"):
        scaling.fit_by_regime(df, ScalingSettings(channels=("x",), min_samples=11), ["asset_id"])
    with pytest.raises(ValueError, match="active"):
        scaling.fit_by_regime(df, ScalingSettings(channels=("x",), min_samples=1, active={"LOADED": ("x",)}), ["asset_id"])
