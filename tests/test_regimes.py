import pytest
from helpers import column, frame

from episodia.config import RegimeSettings
from episodia.operators import ordered, regimes

S = RegimeSettings(states={"LOADED": {"COMP": 0.0}}, min_duration="30s", settle="60s")


def labels(spark, comp, motor=None):
    motor = motor or [1.0] * len(comp)
    df = frame(spark, [(10 * i, float(c) if c is not None else None, m) for i, (c, m) in enumerate(zip(comp, motor))], "COMP double, Motor_current double")
    return column(regimes.assign_regimes(df, S), "regime")


def test_debounce_and_settle(spark):
    got = labels(spark, [1] * 50 + [0] * 50)
    assert got[52] == "STOPPED"
    assert set(got[53:60]) == {"TRANSITION"}
    assert got[60] == "LOADED"


def test_short_blip_never_shows(spark):
    assert "LOADED" not in labels(spark, [1] * 10 + [0] * 2 + [1] * 8)


def test_split_channel(spark):
    got = labels(spark, [1] * 120, [1.9] * 60 + [2.1] * 60)
    assert set(got[10:60]) == {"STOPPED"} and set(got[80:]) == {"OFFLOAD"}


def test_missing_values_are_stopped(spark):
    df = frame(spark, [(0, None, None), (10, None, float("nan"))], "COMP double, Motor_current double")
    assert [r[0] for r in df.select(regimes.raw_state(S)).collect()] == ["STOPPED"] * 2


@pytest.mark.parametrize("cut", [10, 15, 39, 52, 75, 105])
def test_prefix_invariance(spark, cut):
    comp = [1] * 40 + [0] * 2 + [1] * 10 + [0] * 30 + [1] * 38
    assert labels(spark, comp)[cut] == labels(spark, comp[: cut + 1])[cut]


def test_occupancy_counts_every_row(spark):
    df = frame(spark, [(10 * i, 1.0 if i < 50 else 0.0, 1.0) for i in range(100)], "COMP double, Motor_current double")
    got = {r["regime"]: r for r in regimes.occupancy(regimes.assign_regimes(df, S)).collect()}
    assert sum(r["n_rows"] for r in got.values()) == 100
    assert abs(sum(r["percent"] for r in got.values()) - 100) < 1e-9


def test_occupancy_of_nothing_raises(spark):
    with pytest.raises(ValueError):
        regimes.occupancy(spark.createDataFrame([], "asset_id string, us long, regime string"))


def test_flag_agreement_unmapped_never_agrees(spark):
    df = frame(spark, [(0, 0.0, 2.0), (1, 1.0, 1.0)], "a double, b double")
    got = regimes.flag_agreement(df, {"a": {0: "x", 1: "y"}, "b": {1: "y"}}).first()
    assert got["agreement"] == 0.5


def test_monthly_summary(spark):
    rows = [(10 * i, "STOPPED") for i in range(6)] + [(50 + 300 + 10 * i, "STOPPED") for i in range(6)]
    got = regimes.monthly_summary(frame(spark, rows, "regime string"), 60_000_000).collect()
    assert [(r["n_gaps"], r["gap_s"], r["n_runs"], r["median_run_s"]) for r in got] == [(1, 300.0, 2, 50.0)]


def test_runs_split_at_gaps(spark):
    df = frame(spark, [(0, "S"), (10, "S"), (400, "S"), (410, "L")], "regime string")
    got = ordered.run_table(df, "regime", 60_000_000).orderBy("run_id").collect()
    assert [(r["n"], r["gap_truncated"], r["start_is_gap_continuation"]) for r in got] == [(2, True, False), (1, False, True), (1, False, False)]
