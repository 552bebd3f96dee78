import math
import time

from helpers import T0, column, frame
from pyspark.sql import functions as F

from episodia.config import FeatureSettings
from episodia.operators import cycles, ordered

GAP = 60_000_000
S = FeatureSettings(decay_channel="value", min_samples=3, gap="1min", baseline="7D", duty="1h")


def two_cycles(spark):
    rows, t = [], 0
    for slope in (-0.01, -0.02):
        for label, n in (("LOADED", 20), ("OFFLOAD", 10), ("STOPPED", 30)):
            for k in range(n):
                rows.append((t, label, 9.0 + (slope * 10 * k if label == "STOPPED" else 0.0)))
                t += 10
    return frame(spark, rows + [(t, "LOADED", 9.0)], "regime string, value double")


def gapped(spark):
    rows = [(10 * i, "LOADED", 9.0) for i in range(10)] + [(100 + 10 * i, "STOPPED", 9 - 0.05 * i) for i in range(15)]
    t = 240 + 300
    rows += [(t + 10 * i, "STOPPED", 8.0) for i in range(10)] + [(t + 100 + 10 * i, "LOADED", 9.0) for i in range(10)]
    return frame(spark, rows, "regime string, value double")


def test_durations_and_period(spark):
    got = cycles.cycle_features(two_cycles(spark), S).orderBy("us").collect()
    assert got[60]["loaded_duration_last"] == 190.0 and got[60]["offload_duration_last"] == 90.0
    assert got[90]["stopped_duration_last"] == 290.0 and got[90]["cycle_period_last"] == 600.0
    assert got[35]["stopped_duration_last"] is None and got[35]["stopped_elapsed"] == 50.0
    assert got[95]["stopped_elapsed"] == 50.0


def test_slopes(spark):
    got = cycles.cycle_features(two_cycles(spark), S).orderBy("us").collect()
    assert abs(got[35]["decay_rate_running"] + 0.01) < 1e-6
    assert abs(got[95]["decay_rate_running"] + 0.02) < 1e-6
    assert abs(got[90]["decay_rate_last"] + 0.01) < 1e-6


def test_gap_truncation_hides_older_durations(spark):
    got = cycles.cycle_features(gapped(spark), S).orderBy("us").collect()
    assert got[25]["stopped_duration_last"] is None and got[25]["run_gap_truncated"]
    assert abs(got[25]["decay_rate_last"] + 0.005) < 1e-6
    assert got[35]["stopped_duration_last"] == 90.0 and not got[35]["run_gap_truncated"]


def test_prefix_invariance(spark):
    df = two_cycles(spark)
    whole = cycles.cycle_features(df, S).orderBy("us").collect()
    for cut in (25, 61, 95):
        part = cycles.cycle_features(df.where(f"us <= {T0 + cut * 10_000_000}"), S).orderBy("us").collect()
        assert part[-1].asDict() | {"run_id": 0} == whole[cut].asDict() | {"run_id": 0}


def days(spark, values):
    return frame(spark, [(86400 * i, float(v)) for i, v in enumerate(values)], "value double")


def test_trailing_baseline(spark):
    got = column(cycles.baseline_trailing(days(spark, [10, 10, 10, 10, 100]), "value", 3 * 86_400_000_000, "r"), "r")
    assert got[0] == 1.0 and got[-1] == 10.0


def test_trailing_frame_is_left_open(spark):
    got = column(ordered.rolling_median(days(spark, [1, 2, 3, 4]), "value", 2 * 86_400_000_000, "m"), "m")
    assert got == [1.0, 1.5, 2.5, 3.5]


def test_rolling_median_is_the_same_for_any_chunk(spark):
    df = days(spark, [(i * 37) % 11 for i in range(60)])
    width = 5 * 86_400_000_000
    assert column(ordered.rolling_median(df, "value", width, "m", chunk_us=width), "m") == column(ordered.rolling_median(df, "value", width, "m", chunk_us=100 * width), "m")


def test_lagged_baseline(spark):
    day = 86_400_000_000
    got = column(cycles.baseline_lagged(days(spark, [1200] * 20 + [300] * 40), "value", 7 * day, 14 * day, "r"), "r")
    assert got[33] < 0.3
    warm = column(cycles.baseline_lagged(days(spark, [1000] * 40), "value", 7 * day, 14 * day, "r"), "r")
    assert all(v is None for v in warm[:21]) and all(v is not None for v in warm[21:])


def test_division_by_zero(spark):
    got = column(frame(spark, [(0, 1.0, 0.0), (1, 0.0, 0.0), (2, 4.0, 2.0)], "a double, b double").withColumn("r", ordered.ratio("a", "b")), "r")
    assert math.isinf(got[0]) and got[1] is None and got[2] == 2.0


def test_peak(spark):
    assert column(cycles.last_peak(two_cycles(spark), "value", "OFFLOAD", GAP), "last_peak")[40] == 9.0


def test_rows_of_one_time_share_their_median(spark):
    df = frame(spark, [(0, 1.0), (0, 3.0), (1, 8.0)], "value double")
    assert column(ordered.rolling_median(df, "value", 2_000_000, "m"), "m") == [2.0, 2.0, 3.0]


def test_duty_ratio_is_not_quadratic(spark):
    df = spark.range(150_000).select(F.lit("A").alias("asset_id"), (F.col("id") * 1_000_000).alias("us"), F.when(F.col("id") % 4 == 0, "LOADED").otherwise("STOPPED").alias("regime"))
    began = time.time()
    got = df.select("us", cycles.duty_ratio(100_000 * 1_000_000).alias("d")).agg(F.max("us"), F.max_by("d", "us")).first()
    assert tuple(got) == (149_999 * 1_000_000, 0.25)
    assert time.time() - began < 30
