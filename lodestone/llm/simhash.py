"""Operator 4: near duplicates by SimHash; a popcount embedding of the fingerprints finds the candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import column, join_split, materialize_dealt, materialize_merged
from .components import connected_components

#: Words in a shingle, hash seed, and differing bits up to which fingerprints link.
SHINGLE, SEED, BITS = 4, 42, 4
#: Bits in a segment of the embedding, and the parts into which it is cut: with BITS differing bits, one of 2 parts has BITS // 2 at most. The finest
#: segments make the finest grid: with 1 bit a part has 2^32 cells, with 2 bits about 2^24, and fingerprints meet 256 times as often by chance.
SEGMENT, PARTS = 1, 2
#: Fingerprints of a cell that are compared by one call; larger cells get a grid of their own. Cells up to SMALL are first searched all at once.
BLOCK, SMALL = 2048, 48
#: A list of so many hot cells at most is broadcast.
BROADCAST_CELLS = 100_000
#: Shingles whose bits are counted at once, and fingerprints whose cells are listed at once.
CHUNK, LISTED = 1 << 16, 1 << 13


def fingerprint(text: str | None) -> int:
    """SimHash of the whole text: A-Z lowered, shingles of SHINGLE words with repeats; bit set if set in over half the hashes. 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK], strict=True)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(marks.view(np.int64))], ["doc_id", "raw", "mark"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, raw, mark) of every row: its id, a hash of its raw text and its fingerprint as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"), F.xxhash64(column(docs, "text", "string")).alias("raw"))
    return rows.mapInArrow(_fingerprints, "doc_id long, raw long, mark long")


def embed(marks: np.ndarray) -> np.ndarray:
    """Segment popcounts of uint64 fingerprints: one row each, one column a segment. Their Manhattan distance never exceeds the Hamming distance."""
    bits = np.unpackbits(marks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(marks), 64 // SEGMENT, SEGMENT).sum(axis=2, dtype=np.uint8)


def grid(marks: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, which): the grid points within Manhattan distance 1 of `width` segments of the embedding from `first` on, as numbers, and the index of the fingerprint of each.

    Fingerprints that differ in 2 bits there at most have a point in common: one between them.
    """
    places = np.uint64(SEGMENT + 1) ** np.arange(width, dtype=np.uint64)
    own = embed(marks)[:, first : first + width].astype(np.uint64)
    base, index = (own * places).sum(axis=1, dtype=np.uint64), np.arange(len(marks))
    points, which = [base], [index]
    for j in range(width):
        for rows, moved in ((own[:, j] < SEGMENT, base + places[j]), (own[:, j] > 0, base - places[j])):
            points.append(moved[rows])
            which.append(index[rows])
    return np.concatenate(points), np.concatenate(which)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, mark): the cells of each of the PARTS of a fingerprint's embedding. Of BITS = 4 differing bits, one of 2 parts has 2 at most, so two linked fingerprints share a cell."""
    width = 64 // SEGMENT // PARTS
    for batch in batches:
        marks = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(marks), LISTED):
            some = marks[i : i + LISTED]
            for part in range(PARTS):
                points, which = grid(some, part * width, width)
                cells = points * np.uint64(PARTS) + np.uint64(part)
                yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(some[which].view(np.int64))], ["cell", "mark"])


def _subcells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, block, mark): the second grid, over the other part of the embedding, in halves. Of the 4 bits that may differ there, one half has 2 at most."""
    half = 64 // SEGMENT // PARTS // 2
    for batch in batches:
        cells, marks = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
        for i in range(0, len(marks), LISTED):
            cell, some = cells[i : i + LISTED], marks[i : i + LISTED]
            for part in range(PARTS):
                mine = np.flatnonzero(cell % np.uint64(PARTS) == part)
                for h in range(2):
                    points, which = grid(some[mine], (1 - part) * 2 * half + h * half, half)
                    columns = (cell[mine][which], points * np.uint64(2) + np.uint64(h), some[mine][which])
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], ["cell", "block", "mark"])


def spanning_links(marks: np.ndarray, limit: int = BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among these fingerprints: fewer links than fingerprints, the same components as all links."""
    links, rest = [], marks
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= limit
            if near.any():
                found = rest[near]
                links += [(one, x) for x in found]
                queue += list(found)
                rest = rest[~near]
    return links


def _run_links(keys: np.ndarray, marks: np.ndarray, limit: int) -> tuple[list[tuple], np.ndarray]:
    """Links within each run of equal keys, and the keys of runs that are longer than limit (these give no links)."""
    ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys))
    starts = np.append(0, ends[:-1])
    sizes = ends - starts
    stop, linked = np.repeat(ends, sizes), np.zeros(len(ends), bool)
    run, at = np.repeat(np.arange(len(ends)), sizes), np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for step in range(1, SMALL):  # most small cells hold no link: look for one in all of them at once
        at = at[at + step < stop[at]]
        if not len(at):
            break
        linked[run[at[np.bitwise_count(marks[at] ^ marks[at + step]) <= BITS]]] = True
    found = [x for i in np.flatnonzero(linked | ((sizes > SMALL) & (sizes <= limit))) for x in spanning_links(marks[starts[i] : ends[i]])]
    return found, keys[starts[sizes > limit]]


def _links(limit: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, cell, block) of rows (cell, block, piece, mark) sorted by these. A run longer than limit gives its cell and block instead of links; no more of it is kept."""
        keys, marks = np.empty((0, 3), np.int64), np.empty(0, np.uint64)

        def out(found, hot):
            a, b = (np.array([x[k] for x in found], np.uint64).view(np.int64).tolist() + [None] * len(hot) for k in (0, 1))
            cell, block = ([None] * len(found) + hot[:, k].tolist() for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, cell, block)], ["a", "b", "cell", "block"])

        for batch in batches:
            keys = np.concatenate([keys, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2)], axis=1)])
            marks = np.concatenate([marks, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(marks):
                changes = np.flatnonzero((keys != keys[-1]).any(axis=1))
                last = changes[-1] + 1 if len(changes) else 0  # the last run may go on
                if last:
                    yield out(*_run_links(keys[:last], marks[:last], limit))
                keys, marks = keys[last : last + limit + 1], marks[last : last + limit + 1]
        if len(marks):
            yield out(*_run_links(keys, marks, limit))

    return linked


def _compared(rows: DataFrame, limit: int) -> DataFrame:
    """Compare the fingerprints of each (cell, block, piece)."""
    key = ["cell", "block", "piece"]
    return rows.select(*key, "mark").repartition(*key).sortWithinPartitions(*key).mapInArrow(_links(limit), "a long, b long, cell long, block long")


def _of_hot(rows: DataFrame, hot: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_CELLS else hot, key)


def links(marks: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column mark) that connect whatever is within BITS bits.

    The grid join brings the fingerprints of a cell together, and each cell gives a spanning forest of its verified links instead of all pairs. In a cell of over BLOCK
    fingerprints these are joined once more, by the grid of the other part's popcounts. A cell of this second grid that is still as large is cut into blocks by
    hash, and each pair of blocks is compared as a cell of its own, so no task keeps a whole hot cell and nothing is left out.
    """
    none = F.lit(0).cast("long")
    cells = marks.select("mark").mapInArrow(_cells, "cell long, mark long")
    found = materialize_dealt(_compared(cells.withColumns({"block": none, "piece": none}), BLOCK))
    out = found.filter("cell is null").select("a", "b")
    hot = found.filter("cell is not null").select("cell").distinct()
    if hot.head(1):
        sub = _of_hot(cells, hot, ["cell"]).select("cell", "mark").mapInArrow(_subcells, "cell long, block long, mark long").distinct()
        again = materialize_dealt(_compared(sub.withColumn("piece", none), BLOCK))
        out = out.unionByName(again.filter("cell is null").select("a", "b"))
        hot = again.filter("cell is not null").select("cell", "block").distinct()
        if hot.head(1):
            rows = _of_hot(sub, hot, ["cell", "block"])
            blocks = rows.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
            own = F.pmod(F.xxhash64("mark"), F.col("_blocks"))
            other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda x: x != F.col("_own"))
            rows = _of_hot(rows, blocks, ["cell", "block"]).withColumn("_own", own).withColumn("_other", F.explode(other))
            rows = rows.withColumn("piece", F.least("_own", "_other") * F.col("_blocks") + F.greatest("_own", "_other"))
            out = out.unionByName(_compared(rows, 1 << 40).select("a", "b"))
    return out.distinct()


def comparisons(marks: DataFrame) -> int:
    """Pairs of fingerprints that share a cell: what a search of all cells would compare at most."""
    cells = marks.select("mark").mapInArrow(_cells, "cell long, mark long").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long")).first()[0] or 0


def components(marks: DataFrame) -> DataFrame:
    """(mark, label, component_id) of distinct fingerprints with their smallest doc_id (mark, least): the least fingerprint and smallest doc_id that each is connected to."""
    labels = connected_components(links(marks))
    labelled = materialize_merged(marks.join(labels, marks["mark"] == labels["node"], "left").select("mark", "least", F.coalesce("label", "mark").alias("label")))
    return join_split(labelled, labelled.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("mark", "label", "component_id")


def _labelled(docs: DataFrame) -> DataFrame:
    rows = materialize_dealt(fingerprints(docs))
    marks = materialize_merged(rows.groupBy("mark").agg(F.min("doc_id").alias("least")))
    return join_split(rows, materialize_merged(components(marks)), "mark")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and blank texts have fingerprint zero and link like any other. Null ids are never a component's id, unless all its ids are null. Repeated rows each
    give a row. An empty table gives an empty one. Other columns are ignored.
    """
    return _labelled(docs).select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs' columns, one row of each component: the one of its smallest id (null last; of rows with this id, the least text hash and one of repeated rows)."""
    kept = _labelled(docs).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw")).alias("_keep"))
    kept = kept.select(F.coalesce(F.col("_keep.doc_id"), F.lit(0)).alias("_id"), F.col("_keep.no_id").alias("_no_id"), F.col("_keep.raw").alias("_raw")).distinct()
    own = column(docs, "doc_id", "long")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(own, F.lit(0)).alias("_id"), own.isNull().alias("_no_id"), F.xxhash64(column(docs, "text", "string")).alias("_raw"))
    keys = ["_id", "_no_id", "_raw"]
    return wide.join(kept, keys, "left_semi").withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("_raw"))).filter("_nth = 1").select("_row.*")
