import zipfile

import pytest
from pyspark.sql import functions as F

from episodia import config
from episodia.schema import duplicate_times, guard_columns, need_columns
from episodia.sources import files


def test_durations():
    assert config.micros("10min") == 600_000_000 and config.micros("7D") == 7 * 86_400_000_000 and config.micros(1.5) == 1_500_000
    with pytest.raises(ValueError):
        config.micros("soon")


def test_layers_and_strictness(tmp_path, monkeypatch):
    (tmp_path / "base.yaml").write_text("split: {embargo: 24h, min_train_days: 30}\nevaluation: {widths_h: [6, 12]}\n")
    (tmp_path / "local.yaml").write_text("split: {min_train_days: 3}\n")
    (tmp_path / "big.yaml").write_text("evaluation: {widths_h: [72]}\n")
    got = config.load(tmp_path)
    assert (got.split.embargo, got.split.min_train_days, got.evaluation.widths_h) == ("24h", 3, (6, 12))
    monkeypatch.setenv("CONFIG", "big")
    assert config.load(tmp_path).evaluation.widths_h == (72,)
    (tmp_path / "bad.yaml").write_text("split: {embargos: 1h}\n")
    with pytest.raises(ValueError, match="embargos"):
        config.load(tmp_path, "bad")
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path, "none")


def test_checksums_and_acquire(tmp_path):
    packed = tmp_path / "data.zip"
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("data.csv", "a\n" * 10_000)
    to = tmp_path / "raw"
    got = files.acquire(to, packed.as_uri(), "data.csv", None)
    assert files.verify(got, files.sha256(got)) == files.sha256(got)
    with pytest.raises(files.ChecksumError):
        files.acquire(to, packed.as_uri(), "data.csv", "0" * 64)
    with pytest.raises(ValueError, match="archive"):
        files.acquire(tmp_path / "x", (tmp_path / "raw" / "data.csv").as_uri(), "data.tar", None)


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Unnamed: 0,timestamp,TP2\n0,2020-01-01 00:00:00,1.5\n1,2020-01-01 00:02:00,2\n2,2020-01-01 00:01:00,\n")
    df = files.read_csv(spark, str(path), ["TP2"])
    assert df.columns == ["ts", "TP2"] and df.count() == 3
    assert files.disorder(df.withColumn("k", F.monotonically_increasing_id()), "k").first()["n_disordered"] == 1
    with pytest.raises(ValueError):
        files.read_csv(spark, str(path), ["TP2"], "when")
    assert files.file_hashes(spark, str(path)).first()["sha256"] == files.sha256(path)


def test_loading_sorts_and_warns(spark, tmp_path, caplog):
    path = tmp_path / "x.csv"
    path.write_text("Unnamed: 0,timestamp,TP2,H1\n0,2020-01-01 00:00:00,1.5,\n1,2020-01-01 00:02:00,2,\n2,2020-01-01 00:01:00,3,\n")
    with caplog.at_level("INFO"):
        got = files.load_csv(spark, str(path), ["TP2", "H1"])
    assert [r["TP2"] for r in got.collect()] == [1.5, 3.0, 2.0] and got.columns == ["ts", "TP2", "H1"]
    text = caplog.text
    assert "1 rows are earlier" in text and "no value in H1" in text and "3 rows, 3 columns" in text
    files.save_interim(got, str(tmp_path / "i"))
    assert files.load_interim(spark, str(tmp_path / "i")).count() == 3


def test_restartable(spark, tmp_path):
    made = []

    def compute(k):
        made.append(k)
        if k == 3 and made.count(3) == 1:
            raise RuntimeError("stopped")
        return spark.createDataFrame([(k, float(k))], "event_id int, x double")

    with pytest.raises(RuntimeError):
        files.restartable(spark, str(tmp_path / "r"), [1, 2, 3], compute)
    got = files.restartable(spark, str(tmp_path / "r"), [1, 2, 3], compute)
    assert made == [1, 2, 3, 3] and sorted((r["event_id"], r["x"]) for r in got.collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_checkpoints(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "event_id int, x double")
    files.save_checkpoint(df, str(tmp_path / "c"))
    assert files.load_checkpoint(spark, str(tmp_path / "c"), [1, 2]).count() == 2
    with pytest.raises(ValueError, match="missing"):
        files.load_checkpoint(spark, str(tmp_path / "c"), [1, 2, 3])


def test_guards(spark):
    df = spark.createDataFrame([("A", 1, 1.0)], "asset_id string, us long, x double")
    guard_columns(df, ["x"])
    with pytest.raises(ValueError):
        guard_columns(df, [])
    with pytest.raises(ValueError):
        need_columns(df, ["y"])
    assert duplicate_times(df.union(df).withColumn("ts", F.col("us"))).count() == 1
    assert files.null_columns(df.withColumn("z", F.lit(None).cast("double"))) == ["z"]
