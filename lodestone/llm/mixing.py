"""Operator 1: mix sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, column, copy_numbers, materialize, prefix_sums, row_hash, word_count

#: Phases of training: the share of training time, and the weights that sources get by rank, repeating. Integrated: 3, 1, 2.
CURRICULUM = ((0.5, (2, 1, 3)), (0.5, (4, 1, 1)))
#: Tokens of the mix for each token of the input, and the most that a source or document is repeated.
BUDGET, REPEAT = 1.5, 2
#: A per-source table of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def _cycle(values: list[float]) -> Column:
    """The value of a source's rank (_rank, from 0), repeating."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("_rank") % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, curriculum=CURRICULUM, budget: float = BUDGET, repeat: float = REPEAT) -> DataFrame:
    """One row per source (_null, _source, _size): its rank, weight integrated over the curriculum, and target.

    Targets share budget x all sizes by weight. A target stops at repeat x the source's size, and the excess goes to the others by
    weight until none is above: min(repeat x size, level x weight), where the level leaves no excess. Sources in the order of
    repeat x size / weight show how many are full at it. The one-task windows see one row per source.
    """
    width = len(curriculum[0][1])
    weights = [sum(share * w[i] for share, w in curriculum) for i in range(width)]
    everything = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.partitionBy().orderBy("_null", "_source")) - 1).withColumn("_weight", _cycle(weights))
    full = F.col("_size") * float(repeat)
    by_fill = Window.partitionBy().orderBy(F.col("_full") / F.col("_weight"), "_rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("_size").over(everything) * float(budget) - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / F.sum("_weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("_full", full).withColumn("_level", level)
    # The first source, in this order, that its level does not fill sets the level of all.
    final = F.min(F.when(F.col("_full") >= F.col("_level") * F.col("_weight"), F.struct(F.col("_full") / F.col("_weight"), "_rank", "_level"))).over(everything)["_level"]
    return filled.withColumn("_target", F.least(F.col("_full"), F.coalesce(final * F.col("_weight"), F.col("_full")))).drop("_level")


def _position(demand: Column, curriculum) -> Column:
    """Invert a source's cumulative demand: the training time, 0 to 1, at which this share of its target has been asked for."""
    totals = [sum(share * w[i] for share, w in curriculum) for i in range(len(curriculum[0][1]))]
    out, start, asked = F.lit(0.0), 0.0, [0.0] * len(totals)
    for share, w in curriculum:
        part = [share * x / total if total else 0.0 for x, total in zip(w, totals, strict=True)]
        out = F.when((demand >= _cycle(asked)) & (_cycle(part) > 0), F.lit(start) + (demand - _cycle(asked)) / _cycle(part) * share).otherwise(out)
        asked, start = [a + b for a, b in zip(asked, part, strict=True)], start + share
    return F.least(F.lit(1.0), out)


def plan_mix(docs: DataFrame, carry: list[str], curriculum=CURRICULUM, budget: float = BUDGET, repeat: float = REPEAT) -> DataFrame:
    """Every row of docs with how often the mix takes it and when.

    Columns: _row (struct of the columns named in carry), size (words), source_size, target (its source's), copies, taken (words
    taken, repeats counted), position (of the first copy, null if none) and _positions (of all copies). A source streams its documents in
    the order of a digest of id and text until its target is met, again from the start if need be; a document is whole or left out, and the last one is taken
    if that comes nearer to the target. Null text has size 0; null sources are one source, the last; null ids count as ''. A source without
    words has target 0 and keeps each row once. An empty table gives an empty one. Reruns agree, as order depends on values alone: rows of one id and text are
    ordered by their other values, and hot ones (a third of the rows may be) are numbered, so that none holds a window of its own.
    """
    text = column(docs, "text", "string")
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"),
        column(docs, "source", "string").isNull().alias("_null"),
        F.coalesce(column(docs, "source", "string"), F.lit("")).alias("_source"),
        word_count(text).alias("size"),
        F.concat_ws("|", F.coalesce(column(docs, "doc_id", "string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))).alias("_same"),
        row_hash(docs.select(*[F.col(f"`{c}`") for c in carry])).alias("_rest"),
        F.monotonically_increasing_id().alias("_id"),
    )
    # Words and digests of the texts are worked out once; all that follows reads them.
    wide = copy_numbers(materialize(wide), "_same")
    wide = wide.withColumn("_md5", F.md5(F.when(F.col("_copy") > 0, F.concat_ws("|", "_same", "_copy")).otherwise(F.col("_same")))).drop("_same", "_copy", "_id")
    wide = wide.withColumn("_order", F.conv(F.substring("_md5", 1, 8), 16, 10).cast("long"))
    keys, narrow = ["_null", "_source"], wide.drop("_row")
    sizes = narrow.groupBy(*keys).agg(F.sum("size").alias("_size"))
    targets = materialize(source_targets(sizes, curriculum, budget, repeat))
    rows = prefix_sums(wide, keys, "_order", [F.col("_md5"), F.col("_rest")], F.col("size"), bucket_count(narrow.count()), "_before", narrow)
    passes = F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(1)
    rest = F.col("_target") - passes * F.col("_size")
    rows = rows.join(F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets, keys)
    rows = rows.withColumn("copies", (passes + F.when((rest > 0) & (F.col("_before") * 2 + F.col("size") <= rest * 2), 1).otherwise(0)).cast("int"))
    share = lambda k: (k * F.col("_size") + F.col("_before") + F.col("size") / 2) / F.col("_target")
    at = lambda k: F.when(F.col("_target") > 0, _position(share(k), curriculum)).otherwise(F.lit(0.0))
    positions = F.array(*[F.when(F.col("copies") > k, at(F.lit(k))) for k in range(int(repeat))])
    return rows.select(
        "_row", "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        positions[0].alias("position"), F.filter(positions, lambda x: x.isNotNull()).alias("_positions"), "_md5", "_rest", "_rest",
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, each row as often as it is taken, range-sorted by training position."""
    taken = plan_mix(docs, docs.columns, **options).select("_row", "_md5", "_rest", F.explode("_positions").alias("_at"))
    return taken.orderBy("_at", "_md5", "_rest").select("_row.*")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and position of every row, range-sorted by position; rows not taken come last."""
    planned = plan_mix(docs, ["doc_id"], **options)
    return planned.orderBy(F.col("position").asc_nulls_last(), "_md5", "_rest").select("_row.doc_id", "size", "source_size", "target", "taken", "copies", "position")
