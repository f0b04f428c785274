"""Typed columns, their conversions, and literals of sizes and dates."""

from __future__ import annotations

import re
from contextvars import ContextVar
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, INT, FLOAT, BOOL, TIME = "string", "int", "float", "bool", "time"

# Bytes of a size unit, and texts of truth values.
UNITS = {"b": 1, "k": 1 << 10, "kib": 1 << 10, "kb": 10**3, "m": 1 << 20, "mib": 1 << 20, "mb": 10**6, "g": 1 << 30, "gib": 1 << 30, "gb": 10**9, "t": 1 << 40, "tib": 1 << 40, "tb": 10**12}
TRUE, FALSE = ("true", "t", "1", "yes", "y", "on"), ("false", "f", "0", "no", "n", "off")

NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass
class Value:
    """A column with its type. literal: the text of a constant. error: rows for which the value can't be had. weight: what a row costs."""

    col: Column
    kind: str
    literal: str | None = None
    error: Column | None = None
    weight: int = 0


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    return STRING


def typed(col: Column, t: T.DataType) -> Value:
    """A table's column as one of the five types."""
    kind = kind_of(t)
    cast = {INT: "bigint", FLOAT: "double", TIME: "timestamp_ntz"}.get(kind)
    if kind == STRING and not isinstance(t, T.StringType):
        return Value(F.decode(col, F.lit("UTF-8")) if isinstance(t, T.BinaryType) else F.to_json(col) if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else col.cast("string"), kind)
    return Value(col.cast(cast) if cast else col, kind)


def parse_size(text: str) -> float | None:
    """A number, or one with a unit, as bytes."""
    if re.match(NUMERIC, text):
        return float(text)
    m = re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", text.strip().lower())
    return float(m[1]) * UNITS[m[2]] if m and m[2] in UNITS else None


_WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


#: Is the month first in dates like 1/2/2020?
US_DATES: ContextVar[bool] = ContextVar("us_dates", default=False)


def parse_date(text: str, now: datetime | None = None, us: bool | None = None) -> tuple[datetime, datetime] | None:
    """The first and the last second that a date literal means: ISO dates to any precision, days (today, yesterday, +N, -N, N days ago, last friday, apr 1, 1 apr 2020, d/m/y)."""
    text = text.strip().lower()
    now, us = now or datetime.now(), US_DATES.get() if us is None else us
    day = lambda d: (datetime(d.year, d.month, d.day), datetime(d.year, d.month, d.day, 23, 59, 59))
    try:
        if m := re.fullmatch(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[t ]+(\d{1,2})(?::(\d{1,2}))?(?::(\d{1,2}))?(?:\.\d+)?)?", text):
            y, mo, d, h, mi, s = (int(x) if x else None for x in m.groups())
            start = datetime(y, mo, d, h or 0, mi or 0, s or 0)
            return start, start + timedelta(seconds=0 if s is not None else 59 if mi is not None else 3599 if h is not None else 86_399)
        if m := re.fullmatch(r"(\d{4})-(\d{1,2})", text):
            start = datetime(int(m[1]), int(m[2]), 1)
            return start, (start + timedelta(days=32)).replace(day=1) - timedelta(seconds=1)
        if text in ("today", "now"):
            return day(now)
        if text == "yesterday":
            return day(now - timedelta(days=1))
        if text == "tomorrow":
            return day(now + timedelta(days=1))
        if m := re.fullmatch(r"([+-]\d+)", text):
            return day(now + timedelta(days=int(m[1])))
        if m := re.fullmatch(r"(\d+) (day|week|hour|minute)s? ago", text):
            then = now - timedelta(**{m[2] + "s": int(m[1])})
            return day(then) if m[2] in ("day", "week") else (then.replace(microsecond=0), then.replace(microsecond=0))
        if m := re.fullmatch(r"(last|next) ([a-z]{3,9})", text):
            want = next(i for i, w in enumerate(_WEEKDAYS) if w.startswith(m[2]))
            ahead = (want - now.weekday()) % 7 or 7
            return day(now + timedelta(days=ahead if m[1] == "next" else ahead - 7 if ahead < 7 else -7))
        if m := re.fullmatch(r"(?:([a-z]{3,9}) (\d{1,2})|(\d{1,2}) ([a-z]{3,9}))(?:,? (\d{4}))?", text):
            name, d = (m[1], m[2]) if m[1] else (m[4], m[3])
            month = next(i for i, w in enumerate(_MONTHS, 1) if w.startswith(name))
            return day(datetime(int(m[5] or now.year), month, int(d)))
        if m := re.fullmatch(r"(\d{1,2})[/.](\d{1,2})[/.](\d{4})", text):
            a, b = (int(m[1]), int(m[2])) if not us else (int(m[2]), int(m[1]))
            return day(datetime(int(m[3]), b, a))
    except (ValueError, StopIteration, OverflowError):
        return None
    return None


def literal(text: str, quoted: bool = False) -> Value:
    if not quoted and re.fullmatch(r"\d+", text) and int(text) < 1 << 63:
        return Value(F.lit(int(text)).cast("bigint"), INT, text)
    if not quoted and re.fullmatch(r"\d+\.\d+(e[+-]?\d+)?", text.lower()):
        return Value(F.lit(float(text)), FLOAT, text)
    return Value(F.lit(text), STRING, text)


def double_text(x: Column) -> Column:
    """A double's shortest digits: no exponent and no trailing .0; no text for NaN and infinity."""
    plain = x.cast("string")
    spelled = F.when(plain.contains("E"), plain.cast("decimal(38,10)").cast("string")).otherwise(plain)
    spelled = F.when(spelled.contains("."), F.regexp_replace(spelled, r"\.?0+$", "")).otherwise(spelled)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(F.when(spelled == "-0", "0").otherwise(spelled))


def text(v: Value) -> Column:
    if v.kind == STRING:
        return v.col
    if v.kind == FLOAT:
        return double_text(v.col)
    if v.kind == TIME:
        return F.date_format(v.col.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return v.col.cast("string")


def number(v: Value) -> Column:
    """As a double: a text that is no number (or size) is 0, a missing one stays missing."""
    if v.literal is not None and v.kind == STRING:
        return F.lit(parse_size(v.literal) or 0.0)
    if v.kind == STRING:
        s = F.lower(v.col)
        unit = F.regexp_extract(s, r"^[+-]?\d+(?:\.\d+)?\s*([a-z]+)$", 1)
        scale = F.element_at(F.create_map(*[F.lit(x) for k, n in UNITS.items() for x in (k, float(n))]), unit)
        sized = F.regexp_extract(s, r"^([+-]?\d+(?:\.\d+)?)\s*[a-z]+$", 1).try_cast("double") * scale
        return F.when(v.col.isNull() | (v.col == ""), F.lit(None)).otherwise(F.coalesce(strict_number(v.col), sized, F.lit(0.0)))
    if v.kind == TIME:
        return F.lit(0.0)
    return v.col.cast("double")


def strict_number(s: Column) -> Column:
    """A text's number, or null if all of it isn't one."""
    found = F.when(s.rlike(NUMERIC), s.try_cast("double"))
    return F.when(F.abs(found) < float("inf"), found)


def parsed_number(v: Value) -> Column:
    """As a double, null for what is no finite number."""
    if v.kind == STRING:
        return strict_number(v.col)
    if v.kind == TIME:
        return F.lit(None).cast("double")
    x = v.col.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def integer(v: Value) -> Column:
    """As a long, null for what is none."""
    if v.kind == INT:
        return v.col
    if v.kind == STRING:
        return F.when(v.col.rlike(r"^[+-]?\d+$"), v.col.try_cast("bigint"))
    if v.kind == FLOAT:
        return F.when(v.col == F.floor(v.col), v.col.try_cast("bigint"))
    return v.col.cast("int").cast("bigint") if v.kind == BOOL else F.lit(None).cast("bigint")


def boolean(v: Value) -> Column:
    if v.kind == BOOL:
        return v.col
    if v.kind == STRING:
        s = F.lower(v.col)
        return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False).otherwise(F.coalesce(strict_number(v.col), F.lit(0.0)) != 0)
    return F.lit(False) if v.kind == TIME else v.col != 0


def moment(v: Value) -> Column:
    """As a timestamp without zone: the start of what a text means; null if it means none."""
    if v.kind == TIME:
        return v.col
    if v.literal is not None and v.kind == STRING:
        found = parse_date(v.literal)
        return F.lit(found[0] if found else None).cast("timestamp_ntz")
    s = text(v)
    return F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)?$"), s.try_cast("timestamp_ntz"))


def span(v: Value) -> tuple[Column, Column]:
    """First and last second of a time."""
    if v.literal is not None and v.kind in (STRING, INT):
        found = parse_date(v.literal) or (None, None)
        return F.lit(found[0]).cast("timestamp_ntz"), F.lit(found[1]).cast("timestamp_ntz")
    start = F.date_trunc("second", moment(v)).cast("timestamp_ntz")
    if v.kind == TIME:
        return start, start
    length = F.length(F.trim(text(v)))
    return start, start + F.when(length <= 10, F.expr("INTERVAL '86399' SECOND")).when(length <= 16, F.expr("INTERVAL '59' SECOND")).otherwise(F.expr("INTERVAL '0' SECOND"))
