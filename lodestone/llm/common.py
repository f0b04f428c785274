"""Helpers shared by the training-data operators: shared scratch tables, word splitting and distributed prefix sums."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Regex classes of the white space that separates words, and of words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Narrow rows are written in a file a core, or one for so many shuffle partitions if these are more.
PARTITIONS_PER_FILE = 16

#: A value in more rows than HOT_ROWS, and than one in HOT_VALUES of all rows, is hot: its rows are split. So at most HOT_VALUES values are hot.
HOT_ROWS, HOT_VALUES = 1024, 65_536

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's checkpoint folder, else a temporary one (local runs and tests only)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder. What is written there goes at the end of the Python process, or earlier with release()."""
    path = f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written[path] = spark
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back. This cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_count(spark: SparkSession) -> int:
    """Files for a table of narrow rows. Hadoop without its native library starts processes (chmod) for each local file that an executor makes, and for each task's folder."""
    return max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_PER_FILE)


def materialize_merged(df: DataFrame) -> DataFrame:
    """materialize() in file_count() files at most: for narrow rows. Partitions are merged without a shuffle and still computed one by one."""
    return materialize(df.coalesce(file_count(df.sparkSession)))


def materialize_dealt(df: DataFrame) -> DataFrame:
    """materialize() in file_count() files: for narrow rows of many and long tasks, which stay as they are. Rows are dealt out evenly by a shuffle."""
    return materialize(df.repartition(file_count(df.sparkSession)))


def release(paths: set[str] | None = None) -> None:
    """Delete scratch files: those of these paths, or all."""
    for path in list(_written) if paths is None else paths:
        spark = _written.pop(path, None)
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the shared folder's owner clears it
            continue


def materialize_stage(make: Callable[[], DataFrame]) -> DataFrame:
    """materialize(make()), and then delete what else make() has written to the shared folder on the way."""
    before = set(_written)
    out = make()
    made = set(_written) - before
    out = materialize(out)
    release(made)
    return out


def column(df: DataFrame, name: str, kind: str) -> Column:
    """df's column of that name, cast; null where df has no such column. Case counts only if it does for Spark."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    found = next((c for c in df.columns if c == name or not exact and c.lower() == name.lower()), None)
    return F.col(f"`{found}`").cast(kind) if found else F.lit(None).cast(kind)


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's values, to break ties by; columns that Spark can't hash are left out."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def low32(*cols: Column) -> Column:
    """32 hashed bits as a long from 0 to 2^32 - 1."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0xFFFFFFFF))


def bucket_count(rows: int) -> int:
    """Buckets for prefix_sums: as many as a bucket has rows, so neither level gathers more than about sqrt(rows) rows of a key."""
    return max(1, math.isqrt(max(rows, 1)))


def prefix_sums(df: DataFrame, keys: list[str], order: str, ties: list[Column], weight: Column, buckets: int, out: str, narrow: DataFrame | None = None) -> DataFrame:
    """Add `out`: the sum of `weight` over the rows of the same keys that come before in (order, ties).

    order holds evenly spread longs from 0 to 2^32 - 1. Each key's rows are dealt over `buckets` ranges of order, so that a
    key with most of the rows is spread over as many tasks: sums by (key, bucket) give the offsets, and each bucket adds its own
    running sum. keys must not be null. narrow: the same rows with fewer columns, to sum from.
    """
    bucket = F.shiftright(F.col(order) * F.lit(buckets), 32).alias("_bucket")
    sums = (df if narrow is None else narrow).select(*keys, bucket, weight.alias("_w")).groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy(*keys, "_bucket").orderBy(F.col(order), *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_bucket", bucket)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_offset") + F.coalesce(F.sum(weight).over(own), F.lit(0))).cast("long"))
        .drop("_bucket", "_offset")
    )


def hot_limit(rows: int) -> int:
    """A value in more than so many of these rows is hot."""
    return max(HOT_ROWS, -(-rows // HOT_VALUES))


def hot_values(rows: DataFrame, key: str) -> DataFrame | None:
    """(key): the hot values of a column, HOT_VALUES at most, counted with a map-side sum; None if there is none."""
    hot = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_limit(rows.count())).select(key))
    return hot if hot.head(1) else None


def join_split(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None = None, look: bool = True) -> DataFrame:
    """Inner join of rows to a table that has each key once. Rows of hot keys meet a broadcast of the table's few rows for these, the others are shuffled.

    hot: the hot keys, if they are known; look: else find them.
    """
    hot = hot_values(rows, key) if hot is None and look else hot
    if hot is None:
        return rows.join(table, key)
    few = table.join(F.broadcast(hot), key, "left_semi")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


def copy_numbers(rows: DataFrame, key: str) -> DataFrame:
    """Add `_copy`: 0, but numbers from 0, in any order, to rows of a hot value of key. rows are written ones and have a column `_id` that differs from row to row.

    Rows alike in all that counts are interchangeable, so that an order by (key, _copy) is the same in each run, and no value holds many rows of it.
    """
    hot = hot_values(rows, key)
    if hot is None:
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    many = rows.join(F.broadcast(hot), key, "left_semi").withColumn("_spread", low32("_id"))
    many = prefix_sums(many, [key], "_spread", [F.col("_id")], F.lit(1), bucket_count(rows.count()), "_copy").drop("_spread")
    return rows.join(F.broadcast(hot), key, "left_anti").withColumn("_copy", F.lit(0).cast("long")).unionByName(many)
