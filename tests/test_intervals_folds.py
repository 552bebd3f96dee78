from datetime import datetime

import pytest

from episodia.config import EvaluationSettings, Event, SplitSettings
from episodia.operators import folds, intervals

H = folds.HOUR
E1 = Event(1, datetime(2020, 1, 10), datetime(2020, 1, 10, 4), datetime(2020, 1, 10, 8))
S = SplitSettings(embargo="1h", pre_margin="2h", post_settle="2h", fallback_post="4h", min_train_days=1)
DS, DE = folds.at(datetime(2020, 1, 1)), folds.at(datetime(2020, 1, 20))


def spans(df):
    return sorted((r["start_us"], r["end_us"]) for r in df.collect())


def test_union_merges_touching(spark):
    df = spark.createDataFrame([(0, 5), (5, 7), (9, 10), (1, 2)], "start_us long, end_us long")
    assert spans(intervals.union(df)) == [(0, 7), (9, 10)]


def test_complement(spark):
    df = spark.createDataFrame([(2, 4), (3, 6), (9, 30)], "start_us long, end_us long")
    assert spans(intervals.complement(df, 0, 20)) == [(0, 2), (6, 9)]


def test_normal_stretches():
    v = EvaluationSettings(widths_h=(6,), pooled_buffer="1h")
    got = folds.normal_stretches([E1], S, v, DS, DE)
    assert got == [(DS, folds.at(datetime(2020, 1, 9, 17))), (folds.at(datetime(2020, 1, 10, 11)), DE)]


def test_fold_bounds():
    (f,) = folds.make_folds([E1], [6.0], S, DS, DE)
    assert f.test_start == folds.at(datetime(2020, 1, 9, 17)) and f.train_end == folds.at(datetime(2020, 1, 9, 16))
    assert f.test_end == folds.at(datetime(2020, 1, 10, 8))


def test_guards():
    e2 = Event(2, datetime(2020, 1, 10, 12), datetime(2020, 1, 10, 13))
    with pytest.raises(ValueError, match="reaches into"):
        folds.make_folds([E1, e2], [6.0], S, DS, DE)
    with pytest.raises(ValueError, match="no training data"):
        folds.make_folds([E1], [400.0], S, DS, DE)
    with pytest.raises(ValueError, match="ends after"):
        folds.make_folds([E1], [6.0], S, DS, folds.at(datetime(2020, 1, 10, 5)))
    with pytest.raises(ValueError, match="widths"):
        folds.make_folds([E1], [], S, DS, DE)


def test_extended_ends_before_the_next_exclusion():
    e2 = Event(2, datetime(2020, 1, 15), datetime(2020, 1, 15, 2))
    a, b = folds.make_folds([E1, e2], [6.0], S, DS, DE)
    assert folds.extended(a, [E1, e2], S, DE).test_end == folds.at(datetime(2020, 1, 14, 22))
    assert folds.extended(b, [E1, e2], S, DE).test_end == DE


def test_train_rows_leave_out_exclusions(spark):
    (f,) = folds.make_folds([E1], [6.0], S, DS, DE)
    f = folds.replace(f, exclusions=((DS + 2 * H, DS + 4 * H),))
    df = spark.createDataFrame([("A", DS + k * H) for k in range(8)], "asset_id string, us long")
    got = sorted((r["us"] - DS) // H for r in folds.train_rows(df, folds.fold_table(spark, [f])).collect())
    assert got == [0, 1, 4, 5, 6, 7]


def test_coverage(spark):
    e = Event(1, datetime(2020, 1, 2), datetime(2020, 1, 3))
    df = spark.createDataFrame([("A", folds.at(e.start) - 6 * H + k * H // 6) for k in range(18)], "asset_id string, us long")
    assert folds.window_coverage(df, [e], [6.0], H // 6).first()["coverage"] == 0.5
