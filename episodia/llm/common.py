"""Session, path and id helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Arrow batches to and from Python workers are bounded by bytes.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a folder of this machine if Spark runs
    on this machine alone (tests); on a cluster that is an error, as executors would write where others cannot read."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if got:
        return got
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"episodia-{os.getpid()}")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


_MARKED: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """This application's folder for intermediate tables; Hadoop deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/episodia-{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        system, where = _file_system(spark, path)
        system.mkdirs(where)
        system.deleteOnExit(where)
        _MARKED.add(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing will read again."""
    for path in paths:
        system, where = _file_system(spark, path)
        system.delete(where, True)


def discard_tables(*tables: DataFrame) -> None:
    """Delete what written() has written, once nothing that is not computed yet reads it."""
    for df in tables:
        discard(df.sparkSession, df.written_path)


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder: later reads do not depend on any executor."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Lets Spark delete a query's shuffle files as soon as the query has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str, options: dict | None = None) -> DataFrame:
    """df, written as Parquet into the shared folder and read again (columnar, so small). Its shuffle files go at once."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


#: Rows of a file of a small table.
FILE_ROWS = 250_000


def few_files(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df, which has short rows and about one for each of docs, shuffled into a number of partitions that follows the rows.

    A task that reads texts then writes no file. On a local disk without Hadoop's native library, each file and folder that a
    task makes starts a chmod, and until that runs, its process shows all memory of the executor as its own once more."""
    return df.repartition(pieces(docs.count(), FILE_ROWS, 4))


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels no model may see; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """All of df, or about `rows` of it by a hash of the key (which should be distinct). No row is moved."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int((1 << 30) * (rows / total)))


#: Bits of a bitmap of hashed keys that _marked() sends to all tasks: at most 2**BITMAP_BITS / 64 rows, however many keys there are.
BITMAP_BITS = 25


def _unused(df: DataFrame, name: str) -> str:
    """The name, drawn out until no column begins with it."""
    while any(c.startswith(name) for c in df.columns):
        name += "_"
    return name


def _marked(docs: DataFrame, key: list[Column], others: DataFrame, other_key: list[Column]) -> tuple[DataFrame, str]:
    """docs with a further column, and its name: false where no row of others can have the same key. Equal keys share a bit
    of a bitmap, which is broadcast."""
    tag = _unused(docs, "__bitmap")
    spot = lambda k: F.pmod(F.xxhash64(*k), F.lit(1 << BITMAP_BITS))
    bits = others.select(spot(other_key).alias("s")).groupBy(F.shiftright("s", 6).alias(f"{tag}word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias(f"{tag}bits"))
    marked = docs.withColumn(f"{tag}spot", spot(key)).withColumn(f"{tag}word", F.shiftright(f"{tag}spot", 6)).join(F.broadcast(bits), f"{tag}word", "left")
    found = F.expr(f"coalesce(shiftrightunsigned({tag}bits, cast({tag}spot & 63 AS int)) & 1, 0) = 1")
    return marked.withColumn(tag, found).select(*docs.columns, tag), tag


def _parted(docs: DataFrame, key: list[Column], ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs in three parts by their key's place in ids (k0, k1, ..): surely in, to be looked up, surely not in.

    A first bitmap holds the ids; the keys of docs that it lets through wrongly are found by a join of keys alone and make a
    second one. To be looked up is only what both let through, so texts are hardly shuffled while the ids are few against
    the bitmap's size, and all of them are looked up, as in a plain join, when they are very many."""
    names = [f"k{i}" for i in range(len(key))]
    own = [F.col(n) for n in names]
    keys, maybe = _marked(docs.select(*(k.alias(n) for k, n in zip(key, names, strict=True))), own, ids, own)
    wrong = _joined(keys.where(maybe).drop(maybe), own, ids, "left_anti")
    marked, one = _marked(docs, key, ids, own)
    marked, two = _marked(marked, key, wrong, own)
    part = lambda x: marked.where(x).select(*docs.columns)
    return part(F.col(one) & ~F.col(two)), part(F.col(one) & F.col(two)), part(~F.col(one))


def _joined(docs: DataFrame, key: list[Column], ids: DataFrame, how: str) -> DataFrame:
    name = _unused(docs, "__id")
    ids = ids.select(*(F.col(f"k{i}").alias(f"{name}{i}") for i in range(len(key))))
    return docs.join(ids, [k.eqNullSafe(F.col(f"{name}{i}")) for i, k in enumerate(key)], how)


def semi_joined(docs: DataFrame, key: list[Column], ids: DataFrame) -> DataFrame:
    """The rows of docs whose key, which may have nulls, is in ids (k0, k1, ..)."""
    sure, doubtful, _ = _parted(docs, key, ids)
    return sure.unionByName(_joined(doubtful, key, ids, "left_semi"))


def anti_joined(docs: DataFrame, key: list[Column], ids: DataFrame) -> DataFrame:
    """The rows of docs whose key, which may have nulls, is not in ids (k0, k1, ..)."""
    _, doubtful, clear = _parted(docs, key, ids)
    return clear.unionByName(_joined(doubtful, key, ids, "left_anti"))


def id_and_text() -> list[Column]:
    """What tells documents apart: the id and a hash of the text."""
    return [F.col("doc_id").cast("long"), F.xxhash64("text")]


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def pieces(total_bytes: int, each: int, least: int = 8) -> int:
    """How many parts of about `each` bytes the input makes."""
    return max(least, -(-total_bytes // each))
