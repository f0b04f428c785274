"""The nine aggregates, over typed values; a missing value is skipped, a text counts as a number if all of it is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.registry import AGGREGATES
from ..lang.parser import QueryError
from ..lang.tree import Expr, Func, show, walk
from ..plans.values import FLOAT, INT, STRING, TIME, Value, double_text, parsed_number, text


def calls(exprs: list[Expr]) -> list[Func]:
    """The distinct aggregate calls in expressions."""
    found: dict[str, Func] = {}
    for x in exprs:
        for y in walk(x):
            if isinstance(y, Func) and y.name in AGGREGATES:
                found.setdefault(show(y).lower(), y)
    return list(found.values())


def aggregate(call: Func, v: Value | None) -> Value:
    """v: the argument, or None for count(*)."""
    kind = AGGREGATES[call.name]
    if kind == "count":
        return Value(F.count(F.lit(1) if v is None else F.nullif(text(v), F.lit(""))), INT)
    if v is None:
        raise QueryError(f"{call.name} needs an argument")
    if kind in ("min", "max"):
        pick = F.min if kind == "min" else F.max
        if v.kind in (INT, TIME):
            return Value(pick(v.col), v.kind)
        if v.kind == FLOAT:
            return Value(pick(parsed_number(v)), FLOAT)
        return Value(F.coalesce(double_text(pick(parsed_number(v))), pick(F.nullif(text(v), F.lit("")))), STRING)
    by = {"sum": F.sum, "avg": F.avg, "stddev_pop": F.stddev_pop, "stddev_samp": F.stddev_samp, "var_pop": F.var_pop, "var_samp": F.var_samp}[kind]
    return Value(by(parsed_number(v)), FLOAT)
