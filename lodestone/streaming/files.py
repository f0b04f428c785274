"""Queries over files as they arrive, with Structured Streaming; an extension of the language's one-shot queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, folder: str, pattern: str = "*", max_files: int = 1000) -> DataFrame:
    """A stream of the files of a folder: abspath, path, name, size, modified and content, each file once."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    plain = F.regexp_replace("path", r"^[a-z]+:/{0,2}(?=/)", "")
    return files.select(
        plain.alias("abspath"), F.regexp_extract(plain, r"([^/]*)\z", 1).alias("path"), F.regexp_extract(plain, r"([^/]*)\z", 1).alias("name"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), F.col("content"),
    )


def counts(events: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Rows by tumbling window and keys of a stream; rows later than `late` behind the newest are left out, which bounds the state."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))
