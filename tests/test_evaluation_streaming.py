import os
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from episodia.plans import evaluation as ev
from episodia.plans import params as P
from episodia.sources.telemetry import telemetry
from episodia.streaming.online import alert_step, online_alerts, online_regimes, session_counts, windowed_counts
from episodia.operators import episodes
from episodia.plans import experiment as ex
from episodia.operators.regimes import assign_regimes

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@needs_data
def test_rule_evaluation(spark):
    settings = replace(P.SETTINGS, rules=replace(P.RULES, enabled=("high_duty_ratio",)))
    p = ev.plan(telemetry(spark, SF).where("asset_id = '0'"), settings, P.US_START, P.US_END)
    out = ev.run_rules(p, [0.99])
    rows = out["results"].collect()
    assert len(rows) == 4 * 3
    assert all(r["days"] > 0 and r["false_alarms_per_day"] >= 0 and 0 <= r["p_poisson"] <= 1 for r in rows)
    assert out["pooled"].count() == 4


@needs_data
def test_online_regimes_equal_the_batch(spark, tmp_path):
    t = telemetry(spark, SF)
    rows = t.orderBy("us").collect()
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, t.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = online_regimes(stream, P.REGIMES, "60 days").writeStream.format("memory").queryName("labels").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["asset_id"], r["us"]): r["regime"] for r in spark.table("labels").collect()}
    want = {(r["asset_id"], r["us"]): r["regime"] for r in assign_regimes(t, P.REGIMES).collect()}
    assert got == want


@needs_data
def test_windowed_counts(spark, tmp_path):
    t = telemetry(spark, SF)
    t.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")
    q = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg({"n": "sum"}).first()[0] == t.count()


@needs_data
def test_online_alerts_equal_the_batch(spark, tmp_path):
    t = telemetry(spark, SF).withColumn("score", F.col("value") / 100).select("asset_id", "ts", "us", "score")
    rows = t.orderBy("us").collect()
    for k in range(3):
        spark.createDataFrame(rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3], t.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    hold, gap = 40 * P.MIN, 10 * P.HOUR
    q = online_alerts(stream, 0.5, hold, gap, "60 days").writeStream.format("memory").queryName("alerts").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["asset_id"], r["start_us"], r["end_us"], r["peak"]) for r in spark.table("alerts").collect()}
    batch = episodes.episodes(episodes.flag_episodes(t, F.lit(0.5), hold, gap, ["asset_id"]), ["asset_id"]).collect()
    want = {(r["asset_id"], r["start_us"], r["end_us"], r["peak"]) for r in batch}
    assert got <= want and len(want - got) <= 4 and len(got) > 10


def test_alert_steps():
    state, out = None, []
    for us, score in [(0, 1.0), (10, 0.0), (20, 1.0), (45, None), (50, 0.0), (60, 1.0), (200, 1.0), (300, 0.0), (305, 0.0)]:
        state, done = alert_step(state, us, score, 0.5, 25, 90)
        out += [done] if done else []
    assert out == [(0, 20, 1.0), (60, 60, 1.0), (200, 200, 1.0)] and state[0] is None


@needs_data
def test_sliding_and_session_windows(spark, tmp_path):
    t = telemetry(spark, SF)
    t.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")
    for name, df in (("sliding", windowed_counts(stream(), "2 hours", "1 hour", "1 hour")), ("sessions", session_counts(stream(), "5 hours"))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("sliding").agg({"n": "sum"}).first()[0] == 2 * t.count()
    assert spark.table("sessions").agg({"n": "sum"}).first()[0] == t.count()


def test_experiments():
    s = ex.experiment(P.SETTINGS, "sweep", "b")
    assert s.forest.trees == 100 and s.windows.stride_score == "5min" and len(s.split.regions) == len(P.SPLIT.regions) + 1
    assert ex.experiment(P.SETTINGS, "final").forest == P.SETTINGS.forest and ex.experiment(P.SETTINGS).evaluation.quantiles[-1] == 0.9999
    for wrong in ({"profile": "fast"}, {"arm": "c"}):
        with pytest.raises(ValueError):
            ex.experiment(P.SETTINGS, **wrong)
    with pytest.raises(ex.BudgetExceeded), ex.budget(0.001):
        time.sleep(5)


@needs_data
def test_forest_evaluation_explains_and_reports(spark):
    settings = replace(P.SETTINGS, evaluation=replace(P.EVALUATION, chance_threshold=1.1, permutation_samples=20), forest=replace(P.SETTINGS.forest, trees=5, max_samples=32, cycle_features=False))
    p = ev.plan(telemetry(spark, "/root/testdata/sf0.01").where("asset_id = '0'"), settings, P.US_START, P.US_END)
    out = ev.run_forest(p, P.INTERVAL_US, [0.9])
    found = out["explanations"].collect()
    detected = out["results"].where("detected").count()
    assert (detected > 0) == (len(found) > 0) and all(1 <= r["place"] <= 5 for r in found)
    lines = ex.report(out["results"], out["pooled"], out["explanations"], {1: 2.0})
    assert sum("lead=" in x for x in lines) == detected and lines[-1] == "event=1 seconds=2.0"
    assert ex.gap_diagnostic(out["gap_share"]).where("overall between 0 and 1").count() > 0
    p.release()
    assert not p.kept
