"""Comparisons. The type of the left operand decides how both sides compare; every predicate is two-valued."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.parser import QueryError
from .values import BOOL, FLOAT, INT, STRING, TIME, Value, boolean, number, parse_date, parse_size, span, text

_ORDER = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "eeq": lambda a, b: a == b, "ene": lambda a, b: a != b}
_SPECIAL = r"[\\.^$|()\[\]{}+]"


def is_glob(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def glob_regex(pattern: str) -> str:
    """An anchored pattern for a glob: * and ? are wild, anything else is itself, in either case; line ends are matched by neither."""
    return r"(?iud)\A" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + r"\z"


def like_regex(pattern: str) -> str:
    return r"(?iud)\A" + "".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in pattern) + r"\z"


def _dynamic(pattern: Column, many: str, one: str) -> Column:
    """The same for a pattern that is a column."""
    escaped = F.regexp_replace(pattern, _SPECIAL, r"\\$0")
    if many == "%":
        escaped = F.regexp_replace(F.regexp_replace(escaped, r"\*", r"\\*"), r"\?", r"\\?")
    out = F.replace(F.replace(escaped, F.lit(many), F.lit(".*")), F.lit(one), F.lit("."))
    return F.concat(F.lit(r"(?iud)\A"), out, F.lit(r"\z"))


def user_regex(pattern: str) -> str:
    """A search pattern with Unicode classes and only \\n as line end; look-around and back-references are refused."""
    if re.search(r"\(\?(=|!|<=|<!|>)|\\[1-9]", pattern):
        raise QueryError(f"look-around and back-references are not supported: {pattern}")
    try:
        re.compile(pattern)
    except re.error as e:
        if not re.search(r"\\[pPxz]|\(\?", pattern):
            raise QueryError(f"bad pattern {pattern}: {e}") from e
    return "(?Ud)" + re.sub(r"(?<!\\)((?:\\\\)*)\$", r"\1\\z", pattern)


def _equal_text(left: Column, right: Value) -> Column:
    if right.literal is not None:
        return left.rlike(glob_regex(right.literal)) if is_glob(right.literal) else left == right.literal
    other = F.coalesce(text(right), F.lit(""))
    wild = other.rlike(r"[*?]")
    return F.when(wild, F.regexp_like(left, _dynamic(other, "*", "?"))).otherwise(left == other)


def _number_literal(left: Value, right: Value) -> Column:
    """The right side of a comparison of numbers. A whole constant beside a whole column stays whole, so that the condition reaches the scan."""
    if left.kind == INT and right.literal is not None:
        value = parse_size(right.literal)
        if value is not None and value == int(value) and abs(value) < 1 << 53:
            return F.lit(int(value)).cast("bigint")
    return right.col if left.kind == INT and right.kind == INT else number(right)


def compare(op: str, left: Value, right: Value, across: bool = False) -> Column:
    """A condition that is never null: a missing text is empty, a missing number or time matches nothing.

    across: the sides are columns of two roots. Then = and != compare texts as they are, without globs, so that a join can be planned by key.

    Comparisons with constants keep the bare column on one side, beside a test for null, and so are pushed down to the scan.
    """
    if left.kind == STRING:
        own = F.coalesce(left.col, F.lit(""))
        other = F.lit(right.literal) if right.literal is not None else F.coalesce(text(right), F.lit(""))
        if op in ("eq", "ne") and not across and (right.literal is None or is_glob(right.literal)):
            same = _equal_text(own, right)
            return same if op == "eq" else ~same
        if op in ("rx", "notrx"):
            found = own.rlike(user_regex(right.literal)) if right.literal is not None else F.regexp_like(own, F.concat(F.lit("(?Ud)"), other))
            return found if op == "rx" else ~found
        if op in ("like", "notlike"):
            found = own.rlike(like_regex(right.literal)) if right.literal is not None else F.regexp_like(own, _dynamic(other, "%", "_"))
            return found if op == "like" else ~found
        if right.literal:  # for an empty text too, as that is less than any other
            found = left.col.isNotNull() & _ORDER[op](left.col, other)
            return found if op in ("eq", "eeq", "gt", "gte") else left.col.isNull() | _ORDER[op](left.col, other)
        return _ORDER[op](own, other)
    if op not in _ORDER:
        return F.lit(False)
    if left.kind in (INT, FLOAT):
        other = _number_literal(left, right)
        own = left.col if left.kind == FLOAT or right.kind == INT or right.literal is not None and parse_size(right.literal) is not None and parse_size(right.literal) == int(parse_size(right.literal)) else number(left)
        out = _ORDER[op](own, other)
    elif left.kind == BOOL:
        a, b = left.col, boolean(right)
        out = {"eq": a == b, "eeq": a == b, "ne": a != b, "ene": a != b, "gt": a & ~b, "gte": a | ~b, "lt": ~a & b, "lte": ~a | b}[op]
    else:
        first, last = span(right)
        at = left.col
        if right.literal is not None:
            second = timedelta(seconds=1)
            known = parse_date(right.literal)
            first, after, next_ = (F.lit(t).cast("timestamp_ntz") for t in ((known[0], known[1] + second, known[0] + second) if known else (None, None, None)))
            out = {
                "eq": (at >= first) & (at < after), "ne": (at < first) | (at >= after), "eeq": (at >= first) & (at < next_), "ene": (at < first) | (at >= next_), "gt": at >= after, "gte": at >= first, "lt": at < first, "lte": at < after,
            }[op]
        else:
            at = F.date_trunc("second", at).cast("timestamp_ntz")
            out = {
                "eq": (at >= first) & (at <= last), "ne": (at < first) | (at > last), "eeq": at == first, "ene": at != first, "gt": at > last, "gte": at >= first, "lt": at < first, "lte": at <= last,
            }[op]
    if right.literal is not None:
        return left.col.isNotNull() & out if left.kind != TIME or parse_date(right.literal) else F.lit(False)
    return left.col.isNotNull() & right.col.isNotNull() & out if right.kind != STRING or left.kind == BOOL else F.coalesce(out, F.lit(False))


def same_value(left: Value, right: Value) -> Column:
    """Equality as IN has it: texts exactly, numbers as numbers, times to the second."""
    if left.kind == STRING:
        return F.coalesce(left.col, F.lit("")) == F.coalesce(text(right), F.lit(""))
    return compare("eeq" if left.kind != TIME else "eq", left, right)
