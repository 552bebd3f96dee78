import time
from datetime import datetime

import pytest
from helpers import MIN, T0, frame, micro
from pyspark.sql import functions as F

from episodia.config import Event, SplitSettings
from episodia.operators import chance, episodes, folds, rank, sampling

BY = ["asset_id"]


def scores(spark, values, minutes=None, start=T0):
    minutes = minutes or range(len(values))
    return spark.createDataFrame([("A", start + m * MIN, v) for m, v in zip(minutes, values)], "asset_id string, us long, score double")


def found(df, hold=10, gap=30):
    flagged = episodes.flag_episodes(df, F.lit(0.5), hold * MIN, gap * MIN, BY)
    return [((r["start_us"] - T0) // MIN, (r["end_us"] - T0) // MIN) for r in episodes.episodes(flagged, BY).orderBy("start_us").collect()]


def test_basic(spark):
    assert found(scores(spark, [0.0] * 5 + [1.0] * 5 + [0.0] * 10)) == [(5, 9)]


@pytest.mark.parametrize(("dip", "n"), [(5, 1), (15, 2)])
def test_hysteresis(spark, dip, n):
    assert len(found(scores(spark, [1.0] * 3 + [0.0] * dip + [1.0] * 3))) == n


def test_score_gap_splits(spark):
    assert len(found(scores(spark, [1.0] * 10, [*range(5), *range(45, 50)]))) == 2


def test_neighbours_above_never_split(spark):
    assert len(found(scores(spark, [1.0, 1.0], [0, 20]))) == 1
    assert len(found(scores(spark, [1.0, 0.0, 1.0], [0, 10, 20]))) == 2


def test_missing_scores_never_alert(spark):
    assert found(scores(spark, [None, float("nan"), 0.1])) == []


def test_peak_and_ranking_cover_dips(spark):
    df = scores(spark, [1.0, 0.0, 1.0]).withColumn("a", F.lit(1.0)).withColumn("b", F.col("score") * 2)
    flagged = episodes.flag_episodes(df, F.lit(0.5), 10 * MIN, 30 * MIN, BY)
    got = episodes.rank_contributions(flagged, ["a", "b"], BY).orderBy("place").collect()
    assert [(r["contributor"], round(r["value"], 6)) for r in got] == [("b", 1.333333), ("a", 1.0)]
    top = episodes.rank_contributions(flagged, ["a", "b"], BY, "max").orderBy("place").first()
    assert (top["contributor"], top["value"]) == ("b", 2.0)
    with pytest.raises(ValueError):
        episodes.rank_contributions(flagged, ["a"], BY, "median")


def test_contributions_are_summed_in_time_order(spark):
    df = scores(spark, [1.0, 1e17, -1e17], [2, 0, 1])
    flagged = episodes.flag_episodes(df.withColumn("x", F.col("score")).withColumn("score", F.lit(1.0)), F.lit(0.5), 10 * MIN, 30 * MIN, BY)
    assert episodes.rank_contributions(flagged, ["x"], BY).first()["value"] == 1 / 3
    assert episodes.rank_contributions(flagged.orderBy(F.desc("us")), ["x"], BY).first()["value"] == 1 / 3


EVENT = Event(1, datetime(2020, 1, 10), datetime(2020, 1, 10, 4), datetime(2020, 1, 10, 8))
SPLIT = SplitSettings(post_settle="2h")


@pytest.mark.parametrize(
    ("a", "b", "category"),
    [((9, 20, 0), (9, 20, 10), "early_warning"), ((10, 2, 0), (10, 2, 10), "concurrent"), ((10, 6, 0), (10, 6, 10), "masked"), ((10, 0, 0), (10, 1, 0), "early_warning"), ((12, 0, 0), (12, 1, 0), "false_alarm")],
)
def test_categories_and_lead(spark, a, b, category):
    s, e = (micro(datetime(2020, 1, *x)) for x in (a, b))
    eps = spark.createDataFrame([(1, s, e)], "event_id int, start_us long, end_us long")
    got = episodes.categorise(eps, episodes.event_table(spark, [EVENT]), episodes.mask_table(spark, [EVENT], SPLIT), F.lit(6.0))
    assert got.first()["category"] == category
    days = spark.createDataFrame([(1, 2.0)], "event_id int, days double")
    result = episodes.fold_results(got, days).first()
    if category == "early_warning":
        assert result["detected"] and result["lead_h"] == (micro(EVENT.start) - s) / 3.6e9
    assert result["false_alarms_per_day"] == (0.5 if category == "false_alarm" else 0.0)
    assert result["concurrent_only"] == (category == "concurrent")


def test_evaluated_days(spark):
    day = 24 * 60
    df = scores(spark, [0.0] * 3, [0, day // 2, day], T0)
    df = scores(spark, [0.0] * (day // 20 + day // 20 // 2 + 1), [*range(0, day // 2, 20), *range(day, 2 * day + 1, 20)])
    periods = spark.createDataFrame([("A", T0, T0 + 2 * day * MIN)], "asset_id string, lo long, hi long")
    none = spark.createDataFrame([], "start_us long, end_us long")
    got = episodes.evaluated_days(df, periods, none, 30 * MIN, BY).first()["days"]
    assert abs(got - (2 - 0.5 - 20 / 1440)) < 1e-9


def test_percentile_rank_ties(spark):
    train = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 5.0)], "v double")
    rows = spark.createDataFrame([(v,) for v in (0.0, 2.0, 3.0, 9.0, None)], "v double")
    got = {r["v"]: r["p"] for r in rank.percentile_rank(train, rows, "v", "p").collect()}
    assert got == {0.0: 0.0, 2.0: 0.5, 3.0: 0.75, 9.0: 1.0, None: None}


def test_poisson(spark):
    got = spark.range(1).select(chance.poisson(F.lit(0.5), F.lit(48.0)).alias("p")).first()["p"]
    assert abs(got - (1 - 2.718281828459045**-1)) < 1e-12


def test_permutation(spark):
    hour = 60 * MIN
    eps = spark.createDataFrame([("A", T0 + 1170 * MIN, T0 + 1170 * MIN)], "asset_id string, start_us long, end_us long")
    periods = spark.createDataFrame([("A", T0, T0 + 24 * hour, 20 * hour)], "asset_id string, lo long, hi long, width_us long")
    assert chance.permutation(eps, periods, 25, BY).first()["p_permutation"] == 1.0
    with pytest.raises(ValueError):
        chance.permutation(eps, periods, 1, BY)


def test_operating_point(spark):
    one = spark.createDataFrame([(0.99, 5.0), (0.99, 4.0), (0.999, 2.0), (0.999, 1.5)], "quantile double, rate double")
    got = chance.operating_point(one, 0.3).first()
    assert not got["found"] and got["worst_rates"] == {0.99: 5.0, 0.999: 2.0}
    two = spark.createDataFrame([(0.999, 0.1), (0.999, 0.2)], "quantile double, rate double")
    assert chance.operating_point(two, 0.3).first()["quantile"] == 0.999


def test_survival(spark):
    got = spark.range(1).select(chance.survival(F.array(F.lit(0.5), F.lit(0.5)), F.lit(1)).alias("p")).first()["p"]
    assert abs(got - 0.75) < 1e-12


def test_score_shift(spark):
    mk = lambda v: spark.createDataFrame([(float(x),) for x in v], "score double")
    got = rank.score_shift(mk([1, 2, 3, 4, 100]), mk([1, 2, 200]), "score").first()
    assert (got["train_median"], got["test_median"], got["train_max"], got["test_max"]) == (3.0, 2.0, 100.0, 200.0)
    assert abs(got["share_above_p99"] - 1 / 3) < 1e-12


def test_folds_at():
    assert folds.at(datetime(1970, 1, 1, 0, 0, 1)) == 1_000_000


def test_fills_towards_later_rows_are_not_quadratic(spark):
    rows = [(i, 1.0 if i % 20_000 == 0 else 0.0) for i in range(60_000)]
    df = frame(spark, rows, "score double")
    began = time.time()
    flags = episodes.flag_episodes(df, F.lit(0.5), 40_000 * 1_000_000, 10 * 1_000_000, ["asset_id"])
    assert flags.where("episode is not null").count() == 40_001
    assert sampling.near_gap(df, 2_000_000, 1_000_000).where("gap_adjacent").count() == 0
    assert time.time() - began < 30
