"""Operator 3: shards of even row counts that keep equal texts together, by balanced label propagation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, column, copy_numbers, join_split, low32, materialize, prefix_sums

#: Shards, and the share of the cut that a round has to mend for another one to follow.
SHARDS, TOLERANCE = 24, 0.001
#: A table of so many files at most is broadcast.
FILES = 100_000


def _of(values: list, at: Column) -> Column:
    """The value for a shard number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def _spread(linked: DataFrame, shards: int) -> DataFrame:
    """First labels, even and balanced: linked documents are numbered group by group and dealt round the shards.

    A row (_group, _order, shard, n) stands for n documents of one group, which are alike, so no document is looked at.
    """
    at = prefix_sums(linked, [], "_order", [F.col("_group")], F.col("_n"), bucket_count(linked.count()), "_at")
    turn = lambda s: F.pmod(s - F.col("_at"), F.lit(shards))
    share = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(s.alias("shard"), (F.floor(F.col("_n") / shards) + F.when(turn(s) < F.col("_n") % shards, 1).otherwise(0)).alias("n")))
    return at.select("_group", "_order", F.inline(F.filter(share, lambda x: x["n"] > 0)))


def _quotas(asked: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many may move from shard a to b: as many as move back, and a share of b's room."""
    k = range(len(room))
    quota = [[min(asked[a][b], asked[b][a]) for b in k] for a in k]
    for b in k:
        left, wanting = max(0, room[b]), sum(asked[a][b] - quota[a][b] for a in k)
        for a in k:
            if wanting and left:
                extra = min(left, -(-left * (asked[a][b] - quota[a][b]) // wanting), asked[a][b] - quota[a][b])
                wanting -= asked[a][b] - quota[a][b]
                quota[a][b] += extra
                left -= extra
    return quota


def row_numbers(docs: DataFrame) -> DataFrame:
    """docs with `_nth`: its rows numbered from 0 in the order of its files and of the rows in each. What is not read from files is written first.

    One row a file is summed by one task; the files' offsets are broadcast if there are FILES of them at most.
    """
    files = lambda df: df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    try:
        rows = files(docs)
    except AnalysisException:
        rows = files(materialize(docs))
    counts = materialize(rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")))
    part = F.coalesce(F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    before = Window.partitionBy().orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    rows = rows.join(F.broadcast(offsets) if counts.count() <= FILES else offsets, "_file")
    return rows.withColumn("_nth", F.col("_offset") + F.col("_index")).drop("_file", "_index", "_offset")


def cut_links(state: DataFrame) -> float:
    """Links between shards: pairs of documents of one group that are not in one shard. state: (_group, shard, n) says that n documents of a group are in a shard."""
    n = F.col("n").cast("double")
    groups = state.groupBy("_group", "shard").agg(F.sum(n).alias("n")).groupBy("_group").agg(F.sum(n).alias("all"), F.sum(n * n).alias("within"))
    return groups.agg(F.sum(F.col("all") * F.col("all") - F.col("within")) / 2).first()[0] or 0.0


def propagate(state: DataFrame, capacity: list[int], tolerance: float = TOLERANCE) -> DataFrame:
    """Move linked documents towards their neighbours' shards, under quotas that never overfill a shard, until rounds no longer mend the cut.

    state: (_group, _order, shard, n). All documents of a group are each other's neighbours; the edges are kept as a star, from each part of a group to its hub, so no pair is
    listed. In each round the hub gathers its parts' labels and the join along the edges brings them to every part: a part asks for a shard where its neighbours are, first one
    that has room for all, then one with room, then the one with most of them. A group too large for one shard asks for as many as it needs. Its documents elsewhere ask to
    move there, but out of a fuller part of the group only to where all fits. Moves between two shards that balance are granted, and more as far as the target has room. A
    round that doesn't lessen the cut is undone and ends it, and so does one that mends less than `tolerance` of it. Only loads (one number a shard), demands (one a pair of
    shards) and the cut reach the driver.
    """
    k, cut = len(capacity), cut_links(state)
    while cut:
        load = dict(state.groupBy("shard").agg(F.sum("n")).collect())
        room = [capacity[s] - load.get(s, 0) for s in range(k)]
        open_ = F.when(_of(room, F.col("shard")) + F.col("n") >= F.col("_size"), 2).when(_of(room, F.col("shard")) > 0, 1).otherwise(0)
        tie = lambda s: F.xxhash64("_group", s)
        sized = state.join(state.groupBy("_group").agg(F.sum("n").alias("_size")), "_group").select("_group", "_size", F.struct(open_.alias("_open"), F.col("n").alias("n"), tie("shard").alias("t"), F.col("shard").alias("s")).alias("_label"))
        hubs = sized.groupBy("_group", "_size").agg(F.sort_array(F.collect_list("_label"), asc=False).alias("_best"))  # as many labels as shards at most
        asking = state.join(hubs, "_group").withColumn("_needed", F.ceil(F.col("_size") / max(1, *capacity)).cast("int"))
        nth = F.array_position(F.transform("_best", lambda x: x["s"]), F.col("shard")).cast("int") - 1
        asking = asking.withColumn("_aim", F.get("_best", nth % F.col("_needed")))
        lesser = F.struct(F.col("n"), tie("shard"), F.col("shard")) < F.struct(F.col("_aim.n"), F.col("_aim.t"), F.col("_aim.s"))
        asking = asking.withColumn("_to", F.when((F.col("_aim._open") == 2) | lesser, F.col("_aim.s")).otherwise(F.col("shard"))).select("_group", "_order", "shard", "n", "_to")
        asking = materialize(asking)
        moving = asking.filter(F.col("_to") != F.col("shard"))
        asked = [[0] * k for _ in range(k)]
        movers = 0
        for a, b, n, m in moving.groupBy("shard", "_to").agg(F.sum("n"), F.count(F.lit(1))).collect():
            asked[a][b], movers = n, movers + m
        quota = [x for row in _quotas(asked, room) for x in row]
        if not sum(quota):
            break
        ranked = prefix_sums(moving, ["shard", "_to"], "_order", [F.col("_group")], F.col("n"), bucket_count(movers // k), "_before")
        granted = F.greatest(F.lit(0), F.least(F.col("n"), _of(quota, F.col("shard") * k + F.col("_to")) - F.col("_before")))
        moved = ranked.withColumn("_go", granted).select("_group", "_order", F.inline(F.array(F.struct(F.col("_to").alias("shard"), F.col("_go").alias("n")), F.struct("shard", (F.col("n") - F.col("_go")).alias("n")))))
        stay = asking.filter(F.col("_to") == F.col("shard")).select("_group", "_order", "shard", "n")
        after = materialize(stay.unionByName(moved.filter("n > 0")).groupBy("_group", "_order", "shard").agg(F.sum("n").alias("n")))
        before, now = cut, cut_links(after)
        if now >= before:
            break
        state, cut = after, now
        if before - now < tolerance * before:
            break
    return state


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Row counts of any two shards differ by one at most. Documents of equal text are linked; groups are moved whole into a shard by label propagation as
    far as the shards' capacity allows, and documents without a link fill the shards up. size: UTF-8 bytes of the text plus 8 (null text: 8, and equal to the
    empty text). slot counts from 0 in each shard without gaps. Null and repeated ids are rows like any others. An empty table gives an empty one.
    """
    return place(docs, [], shards, tolerance).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def place(docs: DataFrame, keep: list[str], shards: int = SHARDS, tolerance: float = TOLERANCE, position: str | None = None) -> DataFrame:
    """shard()'s columns but the last, and those columns of docs named in keep. position: a column of longs from 0 to 2^32 - 1, not null and evenly spread, by which slots are given;
    else rows come in the order of a hash."""
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    group = F.unhex(F.sha2(text, 256))
    rows = docs.select(
        column(docs, "doc_id", "long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), group.alias("_group"),
        F.xxhash64("doc_id", group).alias("_same"), F.monotonically_increasing_id().alias("_id"), (F.col(position) if position else F.lit(None).cast("long")).alias("_at_position"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("_kept"),
    )
    rows = copy_numbers(materialize(rows), "_same")
    rows = rows.withColumn("_order", F.coalesce("_at_position", low32("_same", "_copy"))).drop("_same", "_copy", "_at_position")
    rows = materialize(rows)
    total = rows.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    linked = materialize(sizes.filter("_n > 1").withColumn("_order", low32("_group")))
    state = propagate(materialize(_spread(linked, shards)), capacity, tolerance)
    load = dict(state.groupBy("shard").agg(F.sum("n")).collect())
    room = [capacity[s] - load.get(s, 0) for s in range(shards)]

    # A group's documents, in order, fill its shares one after the other; documents without a link fill what room the shards have.
    shares = materialize(state.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("_shares")).unionByName(sizes.filter("_n = 1").select("_group", F.lit(None).cast("array<struct<shard:int,n:bigint>>").alias("_shares"))))
    rows = materialize(join_split(rows, shares, "_group"))
    buckets = bucket_count(total)
    whole = rows.filter(F.size("_shares") == 1).withColumn("shard", F.col("_shares")[0]["shard"])
    split = prefix_sums(rows.filter(F.size("_shares") > 1), ["_group"], "_order", [F.col("doc_id"), F.col("_id")], F.lit(1), buckets, "_at")
    ends = F.transform("_shares", lambda x, i: F.struct(F.aggregate(F.slice("_shares", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("end"), x["shard"].alias("shard")))
    split = split.withColumn("shard", F.filter(ends, lambda x: x["end"] > F.col("_at"))[0]["shard"])
    alone = prefix_sums(rows.filter(F.col("_shares").isNull()), [], "_order", [F.col("doc_id"), F.col("_group"), F.col("_id")], F.lit(1), buckets, "_at")
    ends, end = [], 0
    for s in range(shards):
        end += room[s]
        ends.append(F.struct(F.lit(end).cast("long").alias("end"), F.lit(s).alias("shard")))
    alone = alone.withColumn("shard", F.filter(F.array(*ends), lambda x: x["end"] > F.col("_at"))[0]["shard"])
    columns = ["doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "_order", "_group", "_id", "_kept"]
    placed = materialize(whole.select(*columns).unionByName(split.select(*columns)).unionByName(alone.select(*columns)))
    numbered = prefix_sums(placed, ["shard"], "_order", [F.col("doc_id"), F.col("_group"), F.col("_id")], F.lit(1), buckets, "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", *[F.col(f"_kept.`{c}`") for c in keep])


def shard_in_order(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs' columns, and position (a row's number in docs, from 0), size, text_crc32, law, shard and slot. A shard's slots follow the positions, so that an order made before (as that of a
    curriculum) holds in each shard. position, and (shard, slot), tell rows apart that docs repeats. An empty table gives an empty one."""
    rows = row_numbers(docs)
    total = max(1, docs.count())
    narrow = rows.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"), "_nth", F.floor(F.col("_nth").cast("decimal(20,0)") * F.lit(1 << 32) / total).cast("long").alias("_at"))
    placed = place(narrow, ["_nth"], shards, position="_at").drop("doc_id")
    names = [c for c in docs.columns if c.lower() not in ("position", "size", "text_crc32", "law", "shard", "slot")]
    return rows.select("_nth", *[F.col(f"`{c}`") for c in names]).join(placed, "_nth").withColumnRenamed("_nth", "position")
