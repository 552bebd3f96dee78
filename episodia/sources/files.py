"""Files: checksums, acquisition, CSV and Parquet scans, checkpoints."""

from __future__ import annotations

import hashlib
import logging
import shutil
import urllib.request
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)
SMALL_FILE = 10_000


class ChecksumError(ValueError):
    pass


def sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def verify(path: str | Path, expected: str) -> str:
    """The file's SHA-256; raises ChecksumError if it is another one."""
    got = sha256(path)
    if got != expected.lower():
        raise ChecksumError(f"{path}: expected {expected}, found {got}")
    return got


def fetch(url: str, to: str | Path) -> None:
    with urllib.request.urlopen(url) as source, open(to, "wb") as out:  # noqa: S310
        shutil.copyfileobj(source, out, 1 << 20)


def acquire(folder: str | Path, url: str, name: str, checksum: str | None, force: bool = False) -> Path:
    """The dataset's file in `folder`: fetched unless it is there, unpacked from a zip, checked if a checksum is known."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / name
    if force or not target.exists():
        packed = folder / Path(url).name
        fetch(url, packed)
        if packed.suffix == ".zip":
            with zipfile.ZipFile(packed) as archive, archive.open(name) as source, open(target, "wb") as out:
                shutil.copyfileobj(source, out)
        elif packed.suffix == target.suffix:
            if packed != target:
                packed.replace(target)
        else:
            raise ValueError(f"unknown archive type {packed.suffix}")
    if target.stat().st_size < SMALL_FILE:
        log.warning("%s has only %d bytes", target, target.stat().st_size)
    if checksum:
        verify(target, checksum)
    else:
        log.warning("no checksum is known; %s has %s", target, sha256(target))
    return target


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files below a path that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_csv(spark: SparkSession, path: str, doubles: Sequence[str], time: str = "timestamp") -> DataFrame:
    """Telemetry rows (ts, channels) of a CSV file with a header, with the index artefact dropped."""
    header = spark.read.option("header", True).csv(path).columns
    if time not in header:
        raise ValueError(f"{path} has no column {time}")
    if dropped := [c for c in header if c.startswith("Unnamed") or c == "_c0"]:
        log.warning("dropping %s", ", ".join(dropped))
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in doubles else T.StringType()) for c in header])
    rows = spark.read.option("header", True).schema(schema).csv(path)
    return rows.select(F.col(time).cast("timestamp").alias("ts"), *(c for c in header if c != time and c not in dropped))


def disorder(df: DataFrame, position: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_disordered): rows earlier than the row before them in file order, given by `position`."""
    w = Window.partitionBy(*by).orderBy(position)
    late = (F.lag("ts").over(w) > F.col("ts")).cast("long")
    marked = df.select(*by, F.coalesce(late, F.lit(0)).alias("late"))
    return marked.groupBy(*by).agg(F.sum("late").alias("n_disordered"))


def in_file_order(spark: SparkSession, path: str, doubles: Sequence[str], time: str = "timestamp") -> DataFrame:
    """read_csv() with `file` and `place`, which orders the rows of each file as they stand in it."""
    rows = read_csv(spark, path, doubles, time)
    # a split is read in order by one task, and splits of a file are ordered by where they begin
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", F.col("_metadata.file_path").alias("file"), place.alias("place"))


def load_csv(spark: SparkSession, path: str, doubles: Sequence[str], time: str = "timestamp") -> DataFrame:
    """The rows of CSV files in time order. Warns of rows that are earlier than the one before them in their file, names
    the columns without any value, and logs the number of rows and the time span."""
    rows = in_file_order(spark, path, doubles, time)
    late = disorder(rows, "place", ["file"]).agg(F.sum("n_disordered").alias("n")).first()["n"] or 0
    rows = rows.drop("file", "place")
    if late:
        log.warning("%s: %d rows are earlier than the row before them", path, late)
    if rows.isEmpty():
        log.warning("%s has no rows", path)
        return rows
    if empty := null_columns(rows):
        log.warning("%s: no value in %s", path, ", ".join(empty))
    span = rows.agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    log.info("%s: %d rows, %d columns, %s to %s", path, span["n"], len(rows.columns), span["a"], span["b"])
    return rows.orderBy("ts")


def save_interim(df: DataFrame, path: str) -> None:
    """Rows with their regimes, for runs that need not label them again."""
    df.write.mode("overwrite").parquet(path)


def load_interim(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def null_columns(df: DataFrame) -> list[str]:
    """Columns without any value."""
    row = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return [c for c in df.columns if row[c] == 0]


def save_checkpoint(df: DataFrame, path: str, key: str = "event_id") -> None:
    """Write results by key; the committer makes each write whole or absent."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a write to path has been committed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def restartable(spark: SparkSession, path: str, keys: Sequence, compute: Callable[[Any], DataFrame], key: str = "event_id") -> DataFrame:
    """compute(k) of every key, each written below path on its own; a key that is there already is not computed again."""
    for k in keys:
        if not is_done(spark, f"{path}/{key}={k}"):
            compute(k).drop(key).write.mode("overwrite").parquet(f"{path}/{key}={k}")
    return load_checkpoint(spark, path, keys, key)


def load_checkpoint(spark: SparkSession, path: str, keys: Sequence, key: str = "event_id") -> DataFrame:
    """Read results of all keys; raises if one is missing."""
    out = spark.read.parquet(path)
    have = {r[0] for r in out.select(key).distinct().limit(len(keys) + 1).collect()}
    if missing := [k for k in keys if k not in have]:
        raise ValueError(f"checkpoints are missing for {missing}")
    return out
