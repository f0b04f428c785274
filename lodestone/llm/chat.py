"""Operator 10: chat formatting; a fingerprint of a record's nested fields selects the mapping that makes canonical turns of it."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column

#: The template: control strings around a turn. A turn is START role \n text END \n.
START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are under the loss mask.
LOSS = "assistant"
#: Layouts of records, and how each is mapped to canonical turns. row: a row is a turn, with these fields for role, text and number. list: each element of a list is a turn, with
#: these fields of it. turns: each turn has a role and the fields whose texts it says, blank ones left out.
LAYOUTS = {
    "rows": {"row": ("role", "text", "turn")},
    "messages": {"list": "messages", "role": "role", "text": "content"},
    "conversations": {"list": "conversations", "role": "from", "text": "value"},
    "prompt": {"turns": (("user", ("prompt",)), ("assistant", ("response",)))},
    "completion": {"turns": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "instruction": {"turns": (("user", ("instruction",)), ("assistant", ("output",)))},
    "instruction_input": {"turns": (("user", ("instruction", "input")), ("assistant", ("output",)))},
}
#: Canonical names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Fields that say which record it is, not what it holds.
IDENTITY = ("conv_id", "id")


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves of a type, sorted."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(p for p in paths if p not in IDENTITY)).encode()).hexdigest()[:16]


def paths_of(layout: str) -> list[str]:
    """The nested field paths that a layout's mapping reads, sorted. A path's list elements are marked []."""
    mapping = LAYOUTS[layout]
    if "list" in mapping:
        return sorted(f"{mapping['list']}[].{mapping[k]}" for k in ("role", "text"))
    return sorted(mapping["row"]) if "row" in mapping else sorted({f for _, fields in mapping["turns"] for f in fields})


#: The layout of each fingerprint, and for each layout those that read all of its fields and more.
BY_FINGERPRINT = {fingerprint(paths_of(name)): name for name in LAYOUTS}
WIDER = {n: [q for q in LAYOUTS if set(paths_of(n)) < set(paths_of(q))] for n in LAYOUTS}


def escape(text: Column) -> Column:
    """Make control strings harmless: a backslash goes into every "<", backslashes, "|". Other texts stay as they are."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Undo escape(), exactly: of each "<", backslashes, "|" one backslash goes."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    """A role on one line: % and line ends as %25 and %0A, control strings escaped."""
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _turn(role, text) -> Column:
    role = role if isinstance(role, Column) else F.lit(role)
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _renamed(role: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(role)), role)


def read_turns(layout: str, field) -> Column:
    """Array of canonical turns of a record, by the layout's mapping; field gives a field of the record."""
    mapping = LAYOUTS[layout]
    if "list" in mapping:
        return F.transform(field(mapping["list"]), lambda m: _turn(_renamed(m[mapping["role"]]), m[mapping["text"]]))
    said = lambda fields: F.array_join(F.filter(F.array(*[F.coalesce(field(f).cast("string"), F.lit("")) for f in fields]), lambda x: x != ""), "\n\n")
    return F.array(*[_turn(role, said(fields)) for role, fields in mapping["turns"]])


def layout_of(records: DataFrame) -> str:
    """The layout of a table, by the fingerprint of its field paths; extra columns are ignored if just one layout fits without them."""
    paths = field_paths(records.schema)
    fitting = [n for n in LAYOUTS if set(paths_of(n)) <= set(paths) and not any(set(paths_of(q)) <= set(paths) for q in WIDER[n])]
    found = BY_FINGERPRINT.get(fingerprint(paths)) or (fitting[0] if len(fitting) == 1 else None)
    if not found:
        raise ValueError(f"no single layout fits the fields {paths}")
    return found


def canonical(records: DataFrame) -> DataFrame:
    """(conv_id, record, role, text, turn): a row per turn, from a table of any layout of LAYOUTS. Null roles and texts are empty. Where conv_id is null or missing, each record (of
    a table of turns: each row) is a conversation of its own, and record tells it from others; else record is null."""
    layout = layout_of(records)
    conv_id = column(records, "conv_id", "long")
    own = F.when(conv_id.isNull(), F.monotonically_increasing_id()).alias("record")
    if layout == "rows":
        role, text, turn = (F.col(f"`{c}`") for c in LAYOUTS[layout]["row"])
        return records.select(conv_id.alias("conv_id"), own, F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), turn.cast("long").alias("turn"))
    turns = records.select(conv_id.alias("conv_id"), own, read_turns(layout, lambda name: F.col(f"`{name}`")).alias("_turns"))
    return turns.select("conv_id", "record", F.posexplode("_turns").alias("turn", "_turn")).select("conv_id", "record", "_turn.role", "_turn.text", F.col("turn").cast("long").alias("turn"))


def canonical_json(records: DataFrame, record: str = "record") -> DataFrame:
    """(conv_id, layout, turns) of JSON records of mixed layouts: each record's own fingerprint selects its mapping, and extra fields are ignored if just one layout fits without
    them, as in layout_of(). layout and turns are null where none fits, the JSON is broken or null. An empty table gives an empty one."""
    lists = [LAYOUTS[n]["list"] for n in LAYOUTS if "list" in LAYOUTS[n]]
    value = F.from_json(column(records, record, "string"), "map<string,string>")
    rows = records.select(column(records, "conv_id", "long").alias("conv_id"), value.alias("_value"))
    rows = rows.withColumns({f"_list_{name}": F.from_json(F.col("_value")[name], "array<map<string,string>>") for name in lists})
    listed = lambda name: F.coalesce(F.array_distinct(F.flatten(F.transform(f"_list_{name}", lambda x: F.transform(F.map_keys(x), lambda k: F.concat(F.lit(f"{name}[]."), k))))), F.array().cast("array<string>"))
    plain = F.filter(F.map_keys("_value"), lambda k: ~k.isin(*IDENTITY, *lists))
    rows = rows.withColumn("_paths", F.array_sort(F.concat(plain, *[listed(name) for name in lists])))
    known = [n for n in LAYOUTS if n != "rows"]
    table = F.create_map(*[F.lit(x) for n in known for x in (fingerprint(paths_of(n)), n)])
    fits = {n: F.forall(F.array(*[F.lit(p) for p in paths_of(n)]), lambda p: F.array_contains("_paths", p)) for n in known}
    best = lambda n: reduce(lambda a, q: a & ~fits[q], [q for q in WIDER[n] if q in fits], fits[n])
    fitting = F.filter(F.array(*[F.when(best(n), F.lit(n)) for n in known]), lambda x: x.isNotNull())
    found = F.coalesce(F.element_at(table, F.substring(F.sha2(F.array_join("_paths", "\n"), 256), 1, 16)), F.when(F.size(fitting) == 1, F.get(fitting, F.lit(0))))
    field = lambda name: F.col(f"_list_{name}") if name in lists else F.col("_value")[name]
    turns = reduce(lambda out, n: F.when(F.col("layout") == n, read_turns(n, field)).otherwise(out), known, F.lit(None))
    return rows.withColumn("layout", found).select("conv_id", "layout", turns.alias("turns"))


def format_chats(*tables: DataFrame) -> DataFrame:
    """One row per conversation of these tables, of any layouts: conv_id, formatted, and loss_spans, an array of (start, end) in code points of formatted, end exclusive.

    Turns come by turn number, then role and text. Texts are escaped so that control strings in them are not control strings. The loss spans cover the escaped
    texts of LOSS turns. Repeated rows are turns like any others; a record with a null id is a conversation of its own, so that no conversation gathers them all. An empty table
    gives an empty one. Offsets are running sums over a conversation's turns; the one string of a conversation is all that is gathered.
    """
    turns = [canonical(t).withColumn("table", F.when(F.col("conv_id").isNull(), F.lit(i))) for i, t in enumerate(tables)]
    key = ["conv_id", "table", "record"]
    pieces = reduce(DataFrame.unionByName, turns).select(*key, "turn", "role", "text", F.concat(F.lit(START), _role(F.col("role")), F.lit("\n")).alias("_head"), escape(F.col("text")).alias("_body"))
    pieces = pieces.withColumn("_piece", F.concat("_head", "_body", F.lit(END + "\n")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    of = Window.partitionBy(*key).orderBy(*order)
    start = F.sum(F.length("_piece").cast("long")).over(of.rowsBetween(Window.unboundedPreceding, 0)) - F.length("_piece") + F.length("_head")
    pieces = pieces.withColumn("_nth", F.row_number().over(of)).withColumn("_start", start)
    span = F.when(F.col("role") == LOSS, F.struct(F.col("_start").alias("start"), (F.col("_start") + F.length("_body")).alias("end")))
    listed = pieces.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_nth", "_piece", span.alias("_span")))).alias("_all"))
    return listed.select(
        "conv_id", F.array_join(F.col("_all._piece"), "").alias("formatted"),
        F.filter(F.col("_all._span"), lambda x: x.isNotNull()).alias("loss_spans"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted): turns (role, text) parsed from the formatted strings, and the unescaped texts under the loss spans, in order.

    The i-th span lies at the start of the i-th LOSS turn's text, so each text is cut from its own turn, which takes linear time.
    """
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    cut = lambda p: p.substr(F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(END) - 1)
    parsed = chats.withColumn("_turns", F.transform(pieces, lambda p: F.struct(_unrole(F.substring_index(p, "\n", 1)).alias("role"), cut(p).alias("body"))))
    lost = F.arrays_zip(F.filter("_turns", lambda t: t["role"] == LOSS).alias("turn"), F.col("loss_spans").alias("span"))
    return parsed.select(
        "conv_id", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), unescape(t["body"]).alias("text"))).alias("turns"),
        F.transform(lost, lambda x: unescape(x["turn"]["body"].substr(F.lit(1), (x["span"]["end"] - x["span"]["start"]).cast("int")))).alias("loss_texts"), "formatted",
    )


def chat_report(*tables: DataFrame) -> DataFrame:
    """The digest of read_back(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = read_back(format_chats(*tables)).withColumn("_loss", F.array_join("loss_texts", ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
