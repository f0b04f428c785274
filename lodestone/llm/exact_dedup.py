"""Operator 2: exact duplicates by a sort of the normalised contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import SPACE, column, materialize

#: Splitters are sampled from (first characters, digest, salt), which stays short for any text.
PREFIX = 32


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one space; null counts as empty. Range partitioning by sampled
    splitters of the normalised text (its start, then its digest) and an external sort put equal texts side by side, and the window
    compares neighbours in full. Of equal texts the row with the smallest doc_id stays (null ids last, so keep_id is null only if all ids are); of rows with
    that same doc_id, one. Rows of hot texts are sorted by (text, salt), and the heads of these runs, with their texts, once more.
    An empty table gives an empty one; other columns are ignored.
    """
    text = F.regexp_replace(F.coalesce(column(docs, "text", "string"), F.lit("")), f"{SPACE}+", " ")
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), text.alias("_text"), F.xxhash64(column(docs, "text", "string")).alias("_raw")).withColumn("text_sha256", F.sha2("_text", 256))
    rows = materialize(rows)  # normalised and hashed once; counts, splitters and the sort read this
    most = common.hot_limit(rows.count())
    counts = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > most).select("text_sha256", F.ceil(F.col("_n") / most).alias("_salts"))  # at most common.HOT_VALUES rows
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("doc_id", "_raw"), F.col("_salts"))).otherwise(0)
    rows = rows.join(F.broadcast(hot), "text_sha256", "left").withColumn("_salt", salt).withColumn("_start", F.substring("_text", 1, PREFIX))
    dealt = rows.repartitionByRange("_start", "text_sha256", "_salt")
    run = Window.partitionBy("_start", "text_sha256", "_salt", "_text")
    first = run.orderBy(F.col("doc_id").asc_nulls_last(), "_raw")
    head = F.col("_nth") == 1
    found = dealt.select(
        "doc_id", "text_sha256", "_salt", F.col("_salts").isNotNull().alias("_hot"), "_text", F.min("doc_id").over(run).alias("keep_id"),
        F.count(F.lit(1)).over(run).alias("group_size"), F.row_number().over(first).alias("_nth"),
    )
    found = materialize(found.select("doc_id", "text_sha256", "_salt", "_hot", "keep_id", "group_size", head.alias("_head"), F.when(F.col("_hot"), F.xxhash64("_text")).alias("_hash"), F.when(F.col("_hot") & head, F.col("_text")).alias("_text")))
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    cold = found.filter(~F.col("_hot")).withColumn("kept", F.col("_head"))
    # Runs of one hot text: their heads meet by digest and compare their texts in full.
    same = Window.partitionBy("text_sha256", "_text")
    runs = found.filter(F.col("_hot") & F.col("_head")).select(
        "text_sha256", "_salt", "_hash", F.min("keep_id").over(same).alias("keep_id"), F.sum("group_size").over(same).alias("group_size"),
        (F.row_number().over(same.orderBy(F.col("keep_id").asc_nulls_last(), "_salt")) == 1).alias("_owner"),
    )
    salted = found.filter("_hot").select("doc_id", "text_sha256", "_salt", "_hash", "_head").join(runs, ["text_sha256", "_salt", "_hash"]).withColumn("kept", F.col("_head") & F.col("_owner"))
    return cold.select(*out).unionByName(salted.select(*out))
