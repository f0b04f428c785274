"""Syntax tree of a query."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    """Any expression. alias is its name in the output."""


@dataclass(eq=False)
class Lit(Expr):
    text: str
    quoted: bool = False


@dataclass(eq=False)
class Col(Expr):
    name: str
    root: str | None = None
    shown: str | None = None


@dataclass(eq=False)
class Star(Expr):
    pass


@dataclass(eq=False)
class Func(Expr):
    name: str
    args: list[Expr]


@dataclass(eq=False)
class Arith(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(eq=False)
class Neg(Expr):
    of: Expr


@dataclass(eq=False)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(eq=False)
class And(Expr):
    left: Expr
    right: Expr


@dataclass(eq=False)
class Or(Expr):
    left: Expr
    right: Expr


@dataclass(eq=False)
class Not(Expr):
    of: Expr


@dataclass(eq=False)
class In(Expr):
    of: Expr
    items: list[Expr] | None
    query: Query | None
    negated: bool = False


@dataclass(eq=False)
class Exists(Expr):
    items: list[Expr] | None
    query: Query | None
    negated: bool = False


@dataclass(eq=False)
class Scalar(Expr):
    query: Query


@dataclass(eq=False)
class Item:
    """An output column."""

    expr: Expr
    alias: str | None = None


@dataclass(eq=False)
class Root:
    path: str | None = None
    query: Query | None = None
    alias: str | None = None
    options: dict = field(default_factory=dict)


@dataclass(eq=False)
class Query:
    items: list[Item] = field(default_factory=list)
    roots: list[Root] = field(default_factory=list)
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int = 0
    offset: int = 0
    into: str = "tabs"
    text: str = ""


def children(x: Expr) -> list[Expr]:
    """Direct subexpressions, without those of subqueries."""
    if isinstance(x, (Arith, Compare, And, Or)):
        return [x.left, x.right]
    if isinstance(x, (Neg, Not)):
        return [x.of]
    if isinstance(x, Func):
        return x.args
    if isinstance(x, In):
        return [x.of, *(x.items or [])]
    if isinstance(x, Exists):
        return x.items or []
    return []


def walk(x: Expr):
    yield x
    for y in children(x):
        yield from walk(y)


def subquery(x: Expr) -> Query | None:
    return getattr(x, "query", None) if isinstance(x, (In, Exists, Scalar)) else None


def queries_below(q: Query):
    """Subqueries of a query's expressions, at any depth."""
    parts = [i.expr for i in q.items] + q.group + [e for e, _ in q.order] + ([q.where] if q.where else [])
    for part in parts:
        for x in walk(part):
            if inner := subquery(x):
                yield inner
                yield from queries_below(inner)


_SIGNS = {"eq": "=", "ne": "!=", "eeq": "===", "ene": "!==", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "rx": "=~", "notrx": "!=~", "like": "like", "notlike": "not like"}


def show(x: Expr) -> str:
    """How an output column without an alias is called."""
    if isinstance(x, Lit):
        return x.text
    if isinstance(x, Col):
        return x.shown or x.name
    if isinstance(x, Star):
        return "*"
    if isinstance(x, Func):
        return f"{x.name.capitalize()}({', '.join(map(show, x.args))})"
    if isinstance(x, Arith):
        return f"{show(x.left)} {x.op} {show(x.right)}"
    if isinstance(x, Neg):
        return f"-{show(x.of)}"
    if isinstance(x, Compare):
        return f"{show(x.left)} {_SIGNS[x.op]} {show(x.right)}"
    return type(x).__name__.lower()
