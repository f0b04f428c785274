"""Operator 5: secret scans; parts of multipart credentials are linked within a scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize

# Fixed patterns of the base kinds; (?i:) is ASCII only here.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, KEY_LEAST = 6, 20, 24, 20
#: Base kinds in the order in which spans at one start are listed; then what the linking adds.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
# Weak parts of a credential; none is reported alone. An identifier and an endpoint are named by their context, a key by its length and its mixture of characters, over the whole of it.
WEAK_ID = r"""(?i:access_?key_?id|client_?id|user_?name|account|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
WEAK_KEY, MIXTURE = r"[A-Za-z0-9+/_=-]+", ("[0-9]", "[a-z]", "[A-Z]")
ENDPOINT = r"""(?i:https?|wss?|postgres|mysql|mongodb|redis|amqp|ftp)://[^\x20\x09-\x0D"'<>]+"""
#: Parts are complementary if the gap between their starts is at most so many code points.
SCOPE = 256


def _matches(text: Column, kind: int, pattern: str, group: int = 0, mixture: tuple[str, ...] = ()) -> Column:
    """Array of a pattern's leftmost matches that do not overlap: kind, nth, gap (length of the text since the last match), own (length), part (length of the group; 0 if
    it lacks any of `mixture`).

    Offsets are running sums of these lengths, taken later by a window over the few rows of matches, which is linear for any text.
    """
    whole, part = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (0, group))
    gaps = F.split(text, pattern, -1)
    mixed = lambda x: F.when(reduce(lambda a, m: a & x.rlike(m), mixture, F.lit(True)), F.length(x)).otherwise(F.when(x.isNotNull(), 0)) if mixture else F.length(x)
    found = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("own"), part.alias("part")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["own"]).alias("own"), mixed(x["part"]).alias("part")))
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x["own"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,own:int,part:int>>"))


def _near(left: DataFrame, right: DataFrame) -> DataFrame:
    """Interval semi-join: the spans of left that start within SCOPE of a span of right in the same text. Bins hold at most SCOPE starts of a kind."""
    right = right.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "raw", "start")]).withColumn("_bin", F.floor(F.col("_start") / SCOPE))
    left = left.withColumn("bin", F.explode(F.array(*[F.floor(F.col("start") / SCOPE) + d for d in (-1, 0, 1)])))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("raw") == F.col("_raw")) & (F.col("bin") == F.col("_bin"))
    return left.join(right, same & (F.abs(F.col("start") - F.col("_start")) <= SCOPE), "left_semi").drop("bin").distinct()


def _free(left: DataFrame, right: DataFrame) -> DataFrame:
    """The spans of left that no span of right overlaps. Spans of one kind don't overlap, so each is compared by its start with the last of right before its end."""
    both = left.withColumn("_own", F.lit(True)).unionByName(right.withColumn("_own", F.lit(False)))
    before = Window.partitionBy("doc_id", "raw").orderBy("start", "_own").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id", "raw").orderBy(F.col("start").desc(), F.col("_own").desc()).rowsBetween(Window.unboundedPreceding, -1)
    other = lambda c: F.when(~F.col("_own"), F.col(c))
    both = both.withColumn("_reach", F.max(other("end")).over(before)).withColumn("_next", F.min(other("start")).over(after))
    return both.filter(F.col("_own") & (F.coalesce(F.col("_reach"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("_next"), F.col("end")) >= F.col("end"))).select(*left.columns)


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, raw (hash of its text) and spans, an array of (start, kind, end) by start, kind and end; kind counts along KINDS.

    Base kinds (assign, access, hex) are all reported. Weak identifiers, keys and endpoints are reported only with a complementary part within SCOPE:
    an identifier or endpoint with a secret (assign, hex or weak key), a weak key with an identifier or endpoint; a weak key that overlaps a base span is that span.
    Null counts as empty. Repeated rows each give a row, null ids too. An empty table gives an empty one.
    """
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    patterns = ((ASSIGN, 1, ()), (rf"{ACCESS[:4]}[A-Z0-9]{{{ACCESS_LEAST - 4},}}", 0, ()), (rf"(?<![0-9a-f]){HEX[:-1]}{{{HEX_LEAST},}}", 0, ()), (WEAK_ID, 1, ()), (rf"{WEAK_KEY[:-1]}{{{KEY_LEAST},}}", 0, MIXTURE), (ENDPOINT, 0, ()))
    found = F.concat(*[_matches(text, k, *p) for k, p in enumerate(patterns)])
    rows = materialize(docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.xxhash64(text).alias("raw"), found.alias("found")))
    parts = rows.filter(F.size("found") > 0).dropDuplicates(["doc_id", "raw"]).select("doc_id", "raw", F.inline("found"))
    so_far = Window.partitionBy("doc_id", "raw", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("own")).over(so_far)
    parts = parts.withColumn("end", end).filter(F.when(F.col("kind") == 0, F.col("part") >= ASSIGN_LEAST).when(F.col("kind") == 4, F.col("part") >= KEY_LEAST).otherwise(True)).select("doc_id", "raw", "kind", (F.col("end") - F.col("own")).alias("start"), "end")
    parts = materialize(parts)
    base, kind = parts.filter("kind < 3"), lambda *k: parts.filter(F.col("kind").isin(*k))
    keys = materialize(_free(kind(4), base))
    secrets = kind(0, 2).unionByName(keys)
    spans = base.unionByName(_near(kind(3, 5), secrets)).unionByName(_near(keys, kind(1, 3, 5)))
    listed = spans.groupBy("doc_id", "raw").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    listed = listed.select(F.col("doc_id").alias("_doc_id"), F.col("raw").alias("_raw"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("raw") == F.col("_raw"))
    return rows.select("doc_id", "raw").join(listed, same, "left").select("doc_id", "raw", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def scan_report(docs: DataFrame) -> DataFrame:
    """The digest of scan(): doc_id, n_assign, n_access, n_hex, base_sha256 and spans as kind:start:end, comma-joined."""
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return scan(docs).select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(listed(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
