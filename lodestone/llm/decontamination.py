"""Operator 7: short benchmark items inside long documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, hot_values, materialize

#: Words in a shingle, and the share of an item's distinct shingles that a document must hold.
SHINGLE, CONTAINED = 5, 0.8
#: A table of at most so many rows (40 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words of the lower-cased text; a word is a run of letters and digits."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.xxhash64(x))


def shingle_count(words: Column) -> Column:
    """Shingles of a text, repeats included; one if it has fewer words than a shingle."""
    return F.greatest(F.least(F.size(words), F.lit(1)), F.size(words) - (SHINGLE - 1))


def shingles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shingle): hashes of every SHINGLE consecutive words of rows' column words, repeats included; with fewer words, of all of them.

    The words' hashes are read from their array by position while the explode runs, so no shingle is spelled out.
    """
    at = lambda k: F.get(F.col("words"), F.col("_at") + k)
    one = F.when(F.size("words") >= SHINGLE, F.xxhash64(*[at(k) for k in range(SHINGLE)])).otherwise(F.xxhash64("words"))
    exploded = rows.select(*keys, "words", F.posexplode("words").alias("_at", "_word"))
    return exploded.filter((F.col("_at") == 0) | (F.col("_at") <= F.size("words") - SHINGLE)).select(*keys, one.alias("shingle"))


def item_index(items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(item_id, shingle, n_shingles, size_class, sketched) of the distinct shingles of every item.

    Items are partitioned by the power of 2 of their size, size_class. A class's MinHash sketch is the k least of an item's shingle hashes, where k is one more
    than an item of the class can lack: a document that holds the share `contained` of an item holds a shingle of its sketch, so no find is lost.
    """
    rows = items.select(column(items, "item_id", "long").alias("item_id"), word_hashes(column(items, "text", "string")).alias("words"))
    distinct = shingles(rows, ["item_id"]).distinct()
    of = Window.partitionBy("item_id")
    sized = distinct.withColumn("n_shingles", F.count(F.lit(1)).over(of)).withColumn("size_class", F.floor(F.log2("n_shingles")).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    return sized.withColumn("sketched", F.row_number().over(of.orderBy("shingle")) <= F.floor(largest * (1 - contained) + 1e-9) + 1)


def _texts(docs: DataFrame) -> DataFrame:
    text = column(docs, "text", "string")
    return docs.select(F.coalesce(column(docs, "doc_id", "long"), F.lit(0)).alias("_id"), column(docs, "doc_id", "long").isNull().alias("_no_id"), F.xxhash64(text).alias("raw"), text.alias("text"))


KEYS = ["_id", "_no_id", "raw"]


def _held(found: DataFrame, index: DataFrame) -> DataFrame:
    """found joined to index by shingle. A large index is shuffled; then rows of a hot shingle are dealt over as many copies of its index rows as it is hot."""
    if index.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(index), "shingle")
    found = materialize(found.join(index.select("shingle").distinct(), "shingle", "left_semi").withColumn("_id_", F.monotonically_increasing_id()))
    hot = hot_values(found, "shingle")
    if hot is None:
        return found.drop("_id_").join(index, "shingle")
    few = index.join(F.broadcast(hot), "shingle")
    return found.join(F.broadcast(hot), "shingle", "left_anti").drop("_id_").join(index, "shingle").unionByName(_salted(found.join(F.broadcast(hot), "shingle", "left_semi"), few))


#: Copies of the index rows of a hot shingle, over which its documents are dealt.
SALTS = 64


def _salted(found: DataFrame, few: DataFrame) -> DataFrame:
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("_salt", F.pmod(F.col("_id_"), F.lit(SALTS)).cast("int")).drop("_id_").join(few, ["shingle", "_salt"]).drop("_salt")


def candidates(docs: DataFrame, index: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(_id, _no_id, raw, item_id): texts that hold a shingle of an item's sketch and, by their size, can hold enough of an item of its size class. Only sketch rows are joined."""
    sketch = index.filter("sketched").select("shingle", "item_id", F.ceil(F.pow(F.lit(2.0), "size_class") * contained - 1e-9).alias("_least"))
    rows = _texts(docs).withColumn("words", word_hashes(F.col("text"))).withColumn("_size", shingle_count(F.col("words")))
    return _held(shingles(rows, [*KEYS, "_size"]), materialize(sketch)).filter("_size >= _least").select(*KEYS, "item_id").distinct()


def search(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, raw, item_id, n_shared, n_shingles) for every text and item of which it holds the share `contained` of the distinct shingles at least.

    A text is a candidate for an item if it holds a shingle of the item's sketch. Only the texts of candidates are cut into shingles again and verified, by their exact number
    of the item's shingles. Items and documents of fewer than SHINGLE words have one shingle, all their words, and so match each other only whole. Texts and items that are
    null or without words match nothing. Items with the same id are one item, with the shingles of all. Null ids are kept as they are. Repeated rows are one.
    """
    index = materialize(item_index(items, contained))
    pairs = materialize(candidates(docs, index, contained))
    few = materialize(pairs.select(*KEYS).distinct())
    small = few.count() <= BROADCAST_ROWS
    texts = _texts(docs).join(F.broadcast(few) if small else few, KEYS, "left_semi").select(*KEYS, word_hashes(F.col("text")).alias("words"))
    held = _held(shingles(texts, KEYS).distinct(), index.select("shingle", "item_id", "n_shingles"))
    same = [F.col(f"h.{k}") == F.col(f"c.{k}") for k in KEYS] + [F.col("h.item_id").eqNullSafe(F.col("c.item_id"))]
    held = held.alias("h").join(pairs.alias("c"), same, "left_semi")
    shared = held.groupBy(*KEYS, "item_id").agg(F.count(F.lit(1)).alias("n_shared"), F.max("n_shingles").alias("n_shingles"))
    enough = shared.filter(F.col("n_shared") >= F.col("n_shingles") * contained - 1e-9)
    return enough.select(F.when(~F.col("_no_id"), F.col("_id")).alias("doc_id"), "raw", "item_id", "n_shared", "n_shingles")


def leaks(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of contaminated documents only; of rows with one id, the most contained."""
    best = search(docs, items, contained).groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n_shingles"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_leaks(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """docs' columns, without the rows that hold an item. An empty table gives an empty one."""
    leaked = materialize(search(docs, items, contained).select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_no_id"), F.col("raw").alias("_raw")).distinct())
    own = column(docs, "doc_id", "long")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(own, F.lit(0)).alias("_id"), own.isNull().alias("_no_id"), F.xxhash64(column(docs, "text", "string")).alias("_raw"))
    return wide.join(F.broadcast(leaked) if leaked.count() <= BROADCAST_ROWS else leaked, ["_id", "_no_id", "_raw"], "left_anti").select("_row.*")
