import os

import duckdb
import pytest

import __spark_entry__
from episodia.models.rules import RuleModel
from episodia.plans import catalogue

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4


def test_every_sql_query_has_an_oracle():
    free = {"iforest_scores", "iforest_ablation", "reconstruction_scores", "autoencoder_scores"}
    assert set(catalogue.QUERIES) - free == set(catalogue.ORACLE_SQL)


@needs_data
@pytest.mark.parametrize("name", ["run_lengths", "gap_adjacent", "baseline_lagged", "alert_episodes", "fold_evaluation", "max_width"])
def test_spark_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    rows = catalogue.QUERIES[name](spark, SF)
    names = sorted(rows.columns)
    got = sorted((tuple(r[c] for c in names) for r in rows.collect()), key=repr)
    want = con.sql(catalogue.ORACLE_SQL[name]).select(*names).fetchall()
    assert got == sorted(want, key=repr)


@needs_data
def test_means_on_a_rounding_edge_equal_sql(spark, monkeypatch):
    monkeypatch.setitem(globals(), "SF", "/root/testdata/sf0.01")
    test_spark_equals_sql(spark, "episode_ranking")


@needs_data
@pytest.mark.parametrize(
    ("name", "times"),
    [("rule_severity", 1), ("rule_calibration", 1), ("rule_score", 1), ("rule_shift", 2), ("rule_episodes", 2), ("rule_pooled", 2), ("rule_evaluation", 2)],
)
def test_rules_measure_a_row_once_for_all_folds(spark, monkeypatch, name, times):
    seen, quantities = [], RuleModel.quantities
    monkeypatch.setattr(RuleModel, "quantities", lambda self, df, *by: seen.append(df.count()) or quantities(self, df, *by))
    catalogue.QUERIES[name](spark, SF)
    assert 0 < sum(seen) <= times * spark.read.parquet(f"{SF}/events.parquet").count()


@needs_data
def test_ablation_covers_every_scored_row(spark):
    got, want = (catalogue.QUERIES[q](spark, "/root/testdata/sf0.01").select("asset_id", "us").collect() for q in ("iforest_ablation", "iforest_scores"))
    assert want and sorted(got) == sorted(want)


@needs_data
def test_plans_stay_in_the_jvm(spark):
    text = catalogue.QUERIES["alert_episodes"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
