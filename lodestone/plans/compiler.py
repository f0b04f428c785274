"""Syntax tree to DataFrame. Only declarative operations come out; Catalyst plans them.

Subqueries become joins. One that refers to outer rows is evaluated over the distinct values of the outer columns that it reads (or, where it is a plain
condition, as a semi- or anti-join), so no outer row is looked at alone, at any depth of nesting.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registry
from ..lang.parser import QueryError, is_constant
from ..lang.tree import And, Arith, Col, Compare, Exists, Expr, Func, In, Lit, Neg, Not, Or, Query, Root, Scalar, Star, children, queries_below, show, subquery, walk
from ..operators import aggregation, sorting
from ..sources.fields import FIELDS
from . import values as V
from .predicates import compare, same_value
from .scope import Scope, framed
from .values import BOOL, FLOAT, INT, STRING, TIME, Value


#: Orders of numbers; what reads `greater than` of some inner value holds of the greatest one.
GREATER, LESS = ("gt", "gte"), ("lt", "lte")
#: Nearest matches are looked for in the square of this many ranges.
RANGES = 32


@dataclass
class Env:
    """How names and subqueries resolve: scopes from the innermost out, values of subqueries already joined, and of grouped expressions by their text."""

    scopes: list[Scope]
    joined: dict[int, Value] = field(default_factory=dict)
    grouped: dict[str, Value] | None = None
    errors: list[Column] = field(default_factory=list)


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def conjuncts(x: Expr | None) -> list[Expr]:
    if x is None:
        return []
    return [*conjuncts(x.left), *conjuncts(x.right)] if isinstance(x, And) else [x]


def aliases_of(q: Query) -> set[str]:
    return {r.alias.lower() for r in q.roots if r.alias}


def outer_columns(q: Query, known: frozenset = frozenset()) -> list[Col]:
    """Columns that a query reads from roots around it."""
    own = known | aliases_of(q)
    parts = [i.expr for i in q.items] + q.group + [e for e, _ in q.order] + ([q.where] if q.where else [])
    out = []
    for part in parts:
        for x in walk(part):
            if isinstance(x, Col) and x.root and x.root.lower() not in own:
                out.append(x)
            if inner := subquery(x):
                out += outer_columns(inner, frozenset(own))
    return out


def roots_of(x: Expr, q: Query) -> set[bool]:
    """Whose columns an expression reads: True for those of a subquery's own root, False for those of roots around it."""
    return {x.root is None or x.root.lower() in aliases_of(q) for x in walk(x) if isinstance(x, Col)}


def nearest_sides(q: Query) -> tuple[Expr, Expr, list[tuple[Col, Col]]] | None:
    """The inner and outer number and the (inner, outer) key columns of a subquery that takes the row of the least abs(inner - outer) among rows of equal keys; None for any other."""
    if len(q.roots) != 1 or len(q.order) != 1 or q.offset or is_grouped(q) or any(True for _ in queries_below(q)) or roots_of(q.items[0].expr, q) - {True}:
        return None
    by, rising = q.order[0]
    if not (rising and isinstance(by, Func) and by.name == "abs" and len(by.args) == 1 and isinstance(by.args[0], Arith) and by.args[0].op == "-"):
        return None
    sides = {frozenset(roots_of(x, q)): x for x in (by.args[0].left, by.args[0].right)}
    if sides.keys() != {frozenset({True}), frozenset({False})}:
        return None
    pairs = []
    for c in conjuncts(q.where):
        if roots_of(c, q) <= {True}:
            continue
        if not (isinstance(c, Compare) and c.op in ("eq", "eeq") and isinstance(c.left, Col) and isinstance(c.right, Col) and len(roots_of(c, q)) == 2):
            return None
        pairs.append((c.left, c.right) if roots_of(c.left, q) == {True} else (c.right, c.left))
    return sides[frozenset({True})], sides[frozenset({False})], pairs


def join_key(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Columns that are equal where `a = b` holds between columns of two roots."""
    if a.kind == b.kind == STRING:
        return F.coalesce(a.col, F.lit("")), F.coalesce(b.col, F.lit(""))
    if a.kind == b.kind == INT:
        return a.col.cast("bigint"), b.col.cast("bigint")
    if {a.kind, b.kind} <= {INT, FLOAT}:
        return V.number(a), V.number(b)
    return None


def is_aggregate(x: Expr) -> bool:
    return any(isinstance(y, Func) and y.name in registry.AGGREGATES for y in walk(x))


def is_grouped(q: Query) -> bool:
    return bool(q.group) or any(is_aggregate(i.expr) for i in q.items)


class Compiler:
    def __init__(self, engine):
        self.engine, self.known = engine, engine.columns()
        self.number = count()

    # Values

    def value(self, x: Expr, env: Env) -> Value:
        if env.grouped is not None and (known := env.grouped.get(show(x).lower())) is not None and not isinstance(x, Lit):
            return known
        if id(x) in env.joined:
            return env.joined[id(x)]
        out = self._value(x, env)
        if out.error is not None:
            env.errors.append(F.coalesce(out.error, F.lit(False)))
            out.error = None
        return out

    def _value(self, x: Expr, env: Env) -> Value:
        if isinstance(x, Lit):
            return V.literal(x.text, x.quoted)
        if isinstance(x, Col):
            return self.column(x, env)
        if isinstance(x, Neg):
            return Value(-V.number(self.value(x.of, env)), FLOAT) if not (isinstance(x.of, Lit) and not x.of.quoted and x.of.text.isdigit()) else Value(F.lit(-int(x.of.text)).cast("bigint"), INT, "-" + x.of.text)
        if isinstance(x, Arith):
            a, b = (V.number(self.value(y, env)) for y in (x.left, x.right))
            if x.op in "/%":
                bad = b == 0
                out = F.try_divide(a, b) if x.op == "/" else F.try_mod(a, b)
            else:
                bad = F.lit(False)
                out = a + b if x.op == "+" else a - b if x.op == "-" else a * b
            return Value(F.when(~bad, out), FLOAT, error=bad | F.isnan(out) | (F.abs(out) == float("inf")))
        if isinstance(x, Func):
            if x.name in registry.AGGREGATES:
                raise QueryError(f"{x.name} can't be used here")
            f = registry.FUNCTIONS[x.name]
            args = [self.value(a, env) for a in x.args]
            if f.on_file:
                file = env.scopes[0].file() if env.scopes else None
                if file is None:
                    return Value(F.lit(None), f.kind)
                args = [file, *args]
            return registry.call(x.name, args)
        if isinstance(x, (And, Or, Not, Compare, In, Exists)):
            return Value(self.condition(x, env), BOOL)
        raise QueryError(f"{show(x)} can't be used here")

    def column(self, x: Col, env: Env) -> Value:
        if env.grouped is not None:
            return Value(F.lit(""), STRING)
        if x.root is None:
            found = env.scopes[0].resolve(x.name) if env.scopes else None
            return found or (self.missing(x.name) if x.name in self.known else V.literal(x.name))
        for scope in env.scopes:
            if scope.alias and scope.alias.lower() == x.root.lower():
                return scope.resolve(x.name) or self.missing(x.name)
        raise QueryError(f"unknown alias {x.root}")

    @staticmethod
    def missing(name: str) -> Value:
        """A column that this root hasn't."""
        kind = FIELDS[name].kind if name in FIELDS else STRING
        return Value(F.lit(None).cast({INT: "bigint", TIME: "timestamp_ntz", BOOL: "boolean"}.get(kind, "string")), kind)

    def condition(self, x: Expr, env: Env) -> Column:
        if id(x) in env.joined:
            return F.coalesce(env.joined[id(x)].col, F.lit(False))
        if isinstance(x, And):
            return self.condition(x.left, env) & self.condition(x.right, env)
        if isinstance(x, Or):
            return self.condition(x.left, env) | self.condition(x.right, env)
        if isinstance(x, Not):
            return ~self.condition(x.of, env)
        if isinstance(x, Compare):
            left, right = self.value(x.left, env), self.value(x.right, env)
            if isinstance(x.left, Lit) and left.kind == STRING and right.kind in (INT, FLOAT) and V.parse_size(x.left.text) is not None:
                left = Value(F.lit(V.parse_size(x.left.text)), FLOAT)
            if left.kind == TIME and isinstance(x.right, Lit) and V.parse_date(x.right.text) is None:
                if isinstance(x.left, Col):
                    raise QueryError(f"{x.right.text} is no date")
                return F.lit(False)
            across = isinstance(x.left, Col) and isinstance(x.right, Col) and (x.left.root or "").lower() != (x.right.root or "").lower()
            return compare(x.op, left, right, across)
        if isinstance(x, In) and x.items is not None:
            left = self.value(x.of, env)
            found = reduce(lambda a, b: a | b, [same_value(left, self.value(i, env)) for i in x.items], F.lit(False))
            return ~found if x.negated else found
        if isinstance(x, Exists) and x.items is not None:
            return F.lit(bool(x.items) != x.negated)
        out = self.value(x, env)
        return F.coalesce(out.col, F.lit(False)) if out.kind == BOOL else F.lit(False)

    def weight(self, x: Expr) -> int:
        """What a condition costs per row; subqueries come last."""
        own = 1 << 20 if subquery(x) else 0
        if isinstance(x, Col) and x.name in FIELDS:
            own = FIELDS[x.name].weight
        elif isinstance(x, Func) and x.name in registry.FUNCTIONS:
            own = registry.FUNCTIONS[x.name].weight
        return own + sum(map(self.weight, children(x)))

    # Roots and filters

    def frame(self, root: Root) -> tuple[DataFrame, Scope]:
        if root.query is not None:
            df, is_file, bindings = self.derived(root.query)
        else:
            df, is_file, bindings = self.engine.table(root)
        return framed(df, root.alias, next(self.number), is_file, bindings)

    def derived(self, q: Query) -> tuple[DataFrame, bool, dict]:
        """A query as a root: its rows with all columns of theirs; of a grouped one, its result."""
        if is_grouped(q):
            return self.result(q), False, {}
        parts = [self.filtered(root, q.where, []) for root in q.roots]
        out, files = None, all(scope.is_file for _, scope, _ in parts)
        for df, scope, env in parts:
            keys = [sorting.sort_value(self.value(e, env)) for e, _ in q.order]
            plain = df.select(*[v.col.alias(n) for n, v in scope.values.items()], *[k.alias(f"_key{i}") for i, k in enumerate(keys)])
            out = plain if out is None else out.unionByName(plain, allowMissingColumns=True)
        out = sorting.limited(out, [(F.col(f"_key{i}"), up) for i, (_, up) in enumerate(q.order)], q.limit, q.offset).drop(*[f"_key{i}" for i in range(len(q.order))])
        return out, files, parts[0][1].bindings

    def filtered(self, root: Root, where: Expr | None, outer: list[Scope]) -> tuple[DataFrame, Scope, Env]:
        df, scope = self.frame(root)
        env = Env([scope, *outer])
        return self.filter(df, where, env), scope, env

    def filter(self, df: DataFrame, where: Expr | None, env: Env) -> DataFrame:
        """Cheap conditions first, each as its own filter; subqueries last."""
        for part in sorted(conjuncts(where), key=self.weight):
            negated, inner = False, part
            while isinstance(inner, Not):
                negated, inner = not negated, inner.of
            if subquery(inner) and isinstance(inner, (In, Exists)):
                df = self.semi(df, inner, env, negated)
                continue
            df, env = self.attach(df, [part], env)
            own = Env(env.scopes, env.joined, env.grouped)
            condition = self.condition(part, own)
            df = df.filter(both([condition, *[~e for e in own.errors]]))
        return df

    # Subqueries

    def attach(self, df: DataFrame, exprs: list[Expr], env: Env) -> tuple[DataFrame, Env]:
        """Join the values of all subqueries of these expressions to df."""
        for x in [y for e in exprs for y in walk(e)]:
            if not subquery(x) or id(x) in env.joined:
                continue
            name = f"_sub{next(self.number)}"
            if isinstance(x, Scalar):
                df, v = self.scalar(df, x.query, env, name)
            else:
                df, v = self.marked(df, x, env, name), Value(F.col(name), BOOL)
            env = Env(env.scopes, {**env.joined, id(x): v}, env.grouped, env.errors)
        return df, env

    def domain(self, df: DataFrame, exprs: list[Col], env: Env) -> tuple[DataFrame, list[Column], list[str], list[Scope]]:
        """The distinct values of outer columns, under new names; these columns in df; their names; and scopes that resolve them there."""
        found: dict[tuple[str | None, str], tuple[Value, str]] = {}
        for x in exprs:
            key = (x.root.lower() if x.root else None, x.name)
            if key not in found:
                found[key] = (self.column(x, Env(env.scopes)), f"_outer{next(self.number)}")
        names = [n for _, n in found.values()]
        rows = df.select(*[v.col.alias(n) for v, n in found.values()]).distinct()
        scopes: dict[str | None, Scope] = {}
        for (root, name), (v, n) in found.items():
            scopes.setdefault(root, Scope(root, {})).values[name] = Value(F.col(n), v.kind)
        return rows, [v.col for v, _ in found.values()], names, list(scopes.values())

    def over(self, rows: DataFrame, scopes: list[Scope], q: Query, more: list | None = None) -> tuple[DataFrame, Env]:
        """Rows of the outer domain joined to those rows of a subquery's roots that satisfy its condition. more: further conditions, functions of the inner Env."""
        out, last = None, None
        for root in q.roots:
            df, scope = self.frame(root)
            env = Env([scope, *scopes])
            simple = [c for c in conjuncts(q.where) if not any(subquery(x) for x in walk(c))]
            nested = [c for c in conjuncts(q.where) if any(subquery(x) for x in walk(c))]
            local = [c for c in simple if not any(isinstance(x, Col) and x.root and x.root.lower() not in aliases_of(q) for x in walk(c))]
            df = self.filter(df, reduce(And, local) if local else None, Env([scope]))
            conditions = [self.condition(c, env) for c in simple if c not in local] + [f(env) for f in more or []]
            joined = rows.join(df, both([*conditions, *[~e for e in env.errors]]), "inner")
            env.errors = []
            joined = self.filter(joined, reduce(And, nested) if nested else None, env)
            if out is not None:
                raise QueryError("a subquery that refers to outer rows has one root")
            out, last = joined, env
        return out, last

    def semi(self, df: DataFrame, x: In | Exists, env: Env, negated: bool) -> DataFrame:
        """Keep the rows of df for which a subquery finds something (or, negated, nothing)."""
        how = "left_anti" if negated != x.negated else "left_semi"
        q = x.query
        self.check_width(q, isinstance(x, In))
        plain = not is_grouped(q) and not q.limit and len(q.roots) == 1 and not any(True for _ in queries_below(q))
        outer = outer_columns(q)
        if plain and (outer or isinstance(x, In)):
            inner, scope = self.frame(q.roots[0])
            own = Env([scope, *env.scopes])
            local = [c for c in conjuncts(q.where) if not any(isinstance(y, Col) and y.root and y.root.lower() not in aliases_of(q) for y in walk(c))]
            inner = self.filter(inner, reduce(And, local) if local else None, Env([scope]))
            if isinstance(x, Exists) and (found := self.extreme(df, inner, scope, q, [c for c in conjuncts(q.where) if c not in local], env, how)) is not None:
                return found
            conditions = [self.condition(c, own) for c in conjuncts(q.where) if c not in local]
            if isinstance(x, In):
                df, env = self.attach(df, [x.of], env)
                conditions.append(same_value(self.value(x.of, env), self.value(q.items[0].expr, own)))
            return df.join(inner, both([*conditions, *[~e for e in own.errors]]), how)
        name = f"_mark{next(self.number)}"
        return self.marked(df, x, env, name).filter(F.col(name) != negated).drop(name)

    def extreme(self, df: DataFrame, inner: DataFrame, scope: Scope, q: Query, conditions: list[Expr], env: Env, how: str) -> DataFrame | None:
        """EXISTS by equal keys and one order of numbers: some inner number is above (below) the outer one if the greatest (least) of its key is, so one row a key is joined, whatever the keys' sizes. None for other conditions."""
        name, keys, bound = f"_best{next(self.number)}", [], None
        own, around = Env([scope]), Env(env.scopes)
        for c in conditions:
            if not isinstance(c, Compare) or {frozenset(roots_of(s, q)) for s in (c.left, c.right)} != {frozenset({True}), frozenset({False})}:
                return None
            first = roots_of(c.left, q) == {True}
            mine, theirs = (c.left, c.right) if first else (c.right, c.left)
            a, b = self.value(mine, own), self.value(theirs, around)
            key = join_key(a, b) if c.op in ("eq", "eeq") and isinstance(mine, Col) and isinstance(theirs, Col) else None
            if key:
                keys.append(key)
            elif c.op in GREATER + LESS and {a.kind, b.kind} <= {INT, FLOAT} and bound is None:
                bound = c.op, first, a, b
            else:
                return None
        if bound is None:
            return None
        op, first, a, b = bound
        names = [f"{name}_{i}" for i in range(len(keys))]
        pick = F.max if (op in GREATER) == first else F.min
        best = inner.filter(both([~e for e in own.errors])).groupBy(*[k.alias(n) for (k, _), n in zip(keys, names, strict=True)]).agg(pick(a.col).alias(name))
        m = Value(F.col(name), a.kind)
        matched = [k == F.col(n) for (_, k), n in zip(keys, names, strict=True)] + [compare(op, m, b) if first else compare(op, b, m)]
        return df.join(best if keys else F.broadcast(best), both([*matched, *[~e for e in around.errors]]), how)

    def marked(self, df: DataFrame, x: In | Exists, env: Env, name: str) -> DataFrame:
        """df with a column that says whether IN or EXISTS holds."""
        q = x.query
        self.check_width(q, isinstance(x, In))
        outer = outer_columns(q)
        if not outer:
            found = self.result(q)
            if isinstance(x, Exists):
                one = found.limit(1).agg((F.count(F.lit(1)) > 0).alias(name))
                return df.join(F.broadcast(one), F.lit(True), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)) != x.negated)
            df, env = self.attach(df, [x.of], env)
            left = self.value(x.of, env)
            inner = V.typed(F.col(f"`{found.columns[0]}`"), found.schema[0].dataType)
            key = f"_key{next(self.number)}"
            inner_value = {INT: V.number, FLOAT: V.number, TIME: lambda v: V.span(v)[0], BOOL: V.boolean}.get(left.kind, lambda v: F.coalesce(V.text(v), F.lit("")))
            listed = found.select(inner_value(inner).alias(key)).distinct().withColumn(name, F.lit(True))
            return df.join(listed, inner_value(left) == F.col(key), "left").drop(key).withColumn(name, F.coalesce(F.col(name), F.lit(False)) != x.negated)
        of = [y for y in walk(x.of) if isinstance(y, Col)] if isinstance(x, In) else []
        rows, columns, names, scopes = self.domain(df, [*outer, *of], env)
        more = [lambda own: same_value(self.value(x.of, Env(scopes)), self.value(q.items[0].expr, own))] if isinstance(x, In) else []
        found, _ = self.over(rows, scopes, q, more)
        found = found.select(*names).distinct().withColumn(name, F.lit(True))
        same = both([a.eqNullSafe(F.col(n)) for a, n in zip(columns, names, strict=True)])
        return df.join(found, same, "left").drop(*names).withColumn(name, F.coalesce(F.col(name), F.lit(False)) != x.negated)

    def scalar(self, df: DataFrame, q: Query, env: Env, name: str) -> tuple[DataFrame, Value]:
        """df with a subquery's first value: by its order, or its aggregate. Without rows there is no value."""
        self.check_width(q, True)
        item, outer = q.items[0].expr, outer_columns(q)
        if not outer:
            found = self.result(q).limit(1)
            kind = V.kind_of(found.schema[0].dataType)
            return df.join(F.broadcast(found.toDF(name)), F.lit(True), "left"), Value(F.col(name), kind)
        if sides := nearest_sides(q):
            near = self.nearest(df, q, sides, outer, env, name)
            if near is not None:
                return near
        rows, columns, names, scopes = self.domain(df, outer, env)
        found, own = self.over(rows, scopes, q)
        if is_aggregate(item):
            calls = aggregation.calls([item])
            args = [self.value(c.args[0], own) if c.args and not isinstance(c.args[0], Star) else None for c in calls]
            found = found.groupBy(*names).agg(*[aggregation.aggregate(c, a).col.alias(f"{name}_{i}") for i, (c, a) in enumerate(zip(calls, args, strict=True))])
            known = {show(c).lower(): Value(F.col(f"{name}_{i}"), aggregation.aggregate(c, a).kind) for i, (c, a) in enumerate(zip(calls, args, strict=True))}
            v = self.value(item, Env([], {}, known))
            found = found.select(*names, v.col.alias(name))
            empty = F.lit(0) if isinstance(item, Func) and item.name == "count" else None
        else:
            v = self.value(item, own)
            keys = [(sorting.sort_value(self.value(e, own)), up) for e, up in q.order]
            kept = [~e for e in own.errors]
            found = found.filter(both(kept)) if kept else found
            if len(keys) == 1:
                pick = F.min if keys[0][1] else F.max
                found = found.groupBy(*names).agg(pick(F.when(keys[0][0].isNotNull(), F.struct(keys[0][0].alias("k"), v.col.alias("v"))))["v"].alias(name))
            elif keys:
                first = Window.partitionBy(*names).orderBy(*[sorting.direction(k, up) for k, up in keys], v.col)
                found = found.select(*names, v.col.alias(name), F.row_number().over(first).alias("_nth")).filter("_nth = 1").drop("_nth")
            else:
                found = found.groupBy(*names).agg(F.min(v.col).alias(name))
            empty = None
        same = both([a.eqNullSafe(F.col(n)) for a, n in zip(columns, names, strict=True)])
        df = df.join(found, same, "left").drop(*names)
        if empty is not None:
            df = df.withColumn(name, F.coalesce(F.col(name), empty))
        return df, Value(F.col(name), v.kind)

    def nearest(self, df: DataFrame, q: Query, sides: tuple[Expr, Expr, list[tuple[Col, Col]]], outer: list[Col], env: Env, name: str) -> tuple[DataFrame, Value] | None:
        """df with the value of the inner row whose number is nearest to one of the outer row; of rows as near the least value. None if the keys are of kinds that don't join by equality.

        Both sides are sorted together within ranges of the number, so no outer value meets every inner row: the nearest are the last inner number at or below and the first at or above.
        What earlier and later ranges hold is carried over from a table of one row a key and range. Ranges have equal shares of the distinct (key, number) pairs.
        """
        near, to, pairs = sides
        inner, scope = self.frame(q.roots[0])
        equal = {id(c) for c in conjuncts(q.where) if len(roots_of(c, q)) == 2}
        local = [c for c in conjuncts(q.where) if id(c) not in equal]
        inner = self.filter(inner, reduce(And, local) if local else None, Env([scope]))
        rows, columns, names, scopes = self.domain(df, outer, env)
        own, around = Env([scope]), Env(scopes)
        keys = [join_key(self.value(a, own), self.value(b, around)) for a, b in pairs]
        if None in keys:
            return None
        item, a, b = self.value(q.items[0].expr, own), V.number(self.value(near, own)), V.number(self.value(to, around))
        k, finite = [f"_k{i}" for i in range(len(keys))], F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf"))
        usable = both([finite, *[F.col(c).isNotNull() for c in k]])
        inner = inner.filter(both([~e for e in own.errors])).select(*[x.alias(c) for (x, _), c in zip(keys, k, strict=True)], a.alias("_v"), item.col.alias("_p")).filter(usable)
        rows = rows.filter(both([~e for e in around.errors])).select(*[x.alias(c) for (_, x), c in zip(keys, k, strict=True)], b.alias("_v"), F.struct(*names).alias("_o")).filter(usable)
        inner = inner.groupBy(*k, "_v").agg(F.min(F.struct("_p"))["_p"].alias("_p")).select(*k, "_v", F.struct("_v", "_p").alias("_c"))
        both_sides = inner.unionByName(rows, allowMissingColumns=True)
        parts = [i / RANGES**2 for i in range(1, RANGES**2)]
        cuts = both_sides.agg(F.percentile_approx("_v", parts).alias("c")).select(F.struct(
            F.expr(f"transform(sequence(1, {RANGES - 1}), i -> c[i * {RANGES} - 1])").alias("coarse"), F.expr(f"transform(sequence(0, {RANGES - 1}), i -> slice(c, i * {RANGES} + 1, {RANGES}))").alias("fine"),
        ))
        both_sides = both_sides.withColumn("_cuts", cuts.scalar()).withColumn("_coarse", F.expr("size(filter(_cuts.coarse, x -> x <= _v))"))
        both_sides = both_sides.withColumn("_range", F.expr(f"_coarse * {RANGES + 1} + size(filter(_cuts.fine[_coarse], x -> x <= _v))")).drop("_cuts", "_coarse")
        ends = both_sides.groupBy(*k, "_range").agg(F.min("_c").alias("_least"), F.max("_c").alias("_most"))
        along = Window.partitionBy(*k).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*k, "_range", F.max("_most").over(along.orderBy("_range")).alias("_before"), F.min("_least").over(along.orderBy(F.desc("_range"))).alias("_after"))
        within = Window.partitionBy(*k, "_range").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        found = both_sides.withColumn("_below", F.max("_c").over(within.orderBy("_v"))).withColumn("_above", F.min("_c").over(within.orderBy(F.desc("_v")))).filter(F.col("_o").isNotNull())
        found = found.join(ends, [*k, "_range"], "left")
        best = F.least(*[F.when(c.isNotNull(), F.struct(F.abs(c["_v"] - F.col("_v")).alias("d"), c["_p"].alias("p"))) for c in (F.coalesce("_below", "_before"), F.coalesce("_above", "_after"))])
        found = found.select("_o.*", F.when(best["d"] < float("inf"), best["p"]).alias(name))
        same = both([x.eqNullSafe(F.col(n)) for x, n in zip(columns, names, strict=True)])
        return df.join(found, same, "left").drop(*names), Value(F.col(name), item.kind)

    @staticmethod
    def check_width(q: Query, narrow: bool) -> None:
        if narrow and (len(q.items) != 1 or isinstance(q.items[0].expr, Star)):
            raise QueryError("a subquery used as a value has one column")

    # Results

    def result(self, q: Query) -> DataFrame:
        """The output of a query that refers to no outer rows."""
        for x in outer_columns(q):
            raise QueryError(f"unknown alias {x.root}")
        return self.grouped(q) if is_grouped(q) else self.plain(q)

    def names(self, q: Query, shown: list[tuple[Expr, str | None]]) -> list[str]:
        """Output names; repeated ones get _2, _3 and so on."""
        used: dict[str, int] = {}
        out = []
        for x, alias in shown:
            name = alias or (show(x).lower() if is_grouped(q) else show(x))
            used[name.lower()] = n = used.get(name.lower(), 0) + 1
            out.append(name if n == 1 else f"{name}_{n}")
        return out

    @staticmethod
    def united(frames: list[tuple[DataFrame, list[Value]]], extra: list[str]) -> tuple[DataFrame, list[str]]:
        """One frame of columns c0, c1, ...: of kinds that differ between roots numbers become floats, and else texts."""
        kinds = []
        for i in range(len(frames[0][1])):
            own = {vs[i].kind for _, vs in frames}
            kinds.append(own.pop() if len(own) == 1 else FLOAT if own <= {INT, FLOAT} else STRING)
        convert = {FLOAT: V.number, STRING: V.text}
        out = None
        for df, vs in frames:
            one = df.select(*[(v.col if v.kind == k else convert[k](v)).alias(f"c{i}") for i, (v, k) in enumerate(zip(vs, kinds, strict=True))], *extra)
            out = one if out is None else out.unionByName(one)
        return out, kinds

    def plain(self, q: Query) -> DataFrame:
        frames, shown = [], None
        for root in q.roots:
            df, scope, env = self.filtered(root, q.where, [])
            own = [(Col(n, None, n.capitalize() if scope.is_file else n), None) for n in scope.star()]
            items = [p for i in q.items for p in (own if isinstance(i.expr, Star) else [(i.expr, i.alias)])]
            aliases = {a.lower(): x for x, a in items if a}
            order = [aliases.get(x.name, x) if isinstance(x, Col) and scope.resolve(x.name) is None else aliases.get(x.text.lower(), x) if isinstance(x, Lit) and not x.quoted else x for x, _ in q.order]
            df, env = self.attach(df, [x for x, _ in items] + order, env)
            env = Env(env.scopes, env.joined)
            vs = [self.value(x, env) for x, _ in items] + [self.value(x, env) for x in order]
            if env.errors:
                df = df.filter(both([~e for e in env.errors]))
            seq = scope.values["_seq"].col if scope.is_file and "_seq" in scope.values else F.lit("")
            df = df.withColumn("_tie", seq)
            frames.append((df, vs))
            shown = shown or items
        df, kinds = self.united(frames, ["_tie"])
        n = len(shown)
        keys = [(sorting.sort_value(Value(F.col(f"c{n + i}"), kinds[n + i])), up) for i, (_, up) in enumerate(q.order)]
        if keys and frames and any(True for r in q.roots if r.path is not None):
            keys.append((F.col("_tie"), True))
        limit = q.limit or (1 if is_constant(q) else 0)
        df = sorting.limited(df, keys, limit, q.offset)
        return df.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(self.names(q, shown))])

    def grouped(self, q: Query) -> DataFrame:
        if any(isinstance(i.expr, Star) for i in q.items):
            raise QueryError("* can't be grouped")
        aliases = {i.alias.lower(): i.expr for i in q.items if i.alias}
        known = lambda x: aliases.get((x.name if isinstance(x, Col) else x.text).lower(), x) if isinstance(x, (Col, Lit)) else x
        group = [known(x) if isinstance(x, Lit) else x for x in q.group]
        order = [(known(x), up) for x, up in q.order]
        calls = aggregation.calls([i.expr for i in q.items] + [x for x, _ in order])
        frames = []
        for root in q.roots:
            df, _, env = self.filtered(root, q.where, [])
            args = [c.args[0] if c.args and not isinstance(c.args[0], Star) else None for c in calls]
            df, env = self.attach(df, [*group, *[a for a in args if a]], env)
            env = Env(env.scopes, env.joined)
            vs = [self.value(x, env) for x in group] + [self.value(a, env) if a else Value(F.lit(1).cast("bigint"), INT) for a in args]
            if env.errors:
                df = df.filter(both([~e for e in env.errors]))
            frames.append((df, vs))
        df, kinds = self.united(frames, [])
        k = len(group)
        keys = [(F.coalesce(F.col(f"c{i}"), F.lit("")) if kinds[i] == STRING else F.col(f"c{i}")).alias(f"g{i}") for i in range(k)]
        found = [aggregation.aggregate(c, Value(F.col(f"c{k + i}"), kinds[k + i]) if c.args and not isinstance(c.args[0], Star) else None) for i, c in enumerate(calls)]
        measures = [a.col.alias(f"a{i}") for i, a in enumerate(found)]
        if keys and measures:
            df = df.groupBy(*keys).agg(*measures)
        elif keys:
            df = df.select(*keys).distinct()
        else:
            df = df.agg(*measures)
        table = {show(x).lower(): Value(F.col(f"g{i}"), kinds[i]) for i, x in enumerate(group)} | {show(c).lower(): Value(F.col(f"a{i}"), a.kind) for i, (c, a) in enumerate(zip(calls, found, strict=True))}
        for x, _ in order:
            if not is_aggregate(x) and show(x).lower() not in table and any(isinstance(y, Col) and show(y).lower() not in table for y in walk(x)):
                raise QueryError(f"can't order groups by {show(x)}")
        env = Env([], {}, table)
        outs = [self.value(i.expr, env) for i in q.items]
        sorts = [(sorting.sort_value(self.value(x, env)), up) for x, up in order]
        rows = df.select(*[v.col.alias(f"o{i}") for i, v in enumerate(outs)], *[s.alias(f"s{i}") for i, (s, _) in enumerate(sorts)])
        if keys:
            rows = sorting.limited(rows, [(F.col(f"s{i}"), up) for i, (_, up) in enumerate(sorts)], q.limit, q.offset)
        return rows.select(*[F.col(f"o{i}").alias(n) for i, n in enumerate(self.names(q, [(i.expr, i.alias) for i in q.items]))])


def scan_columns(q: Query) -> set[str]:
    """Names that a query reads anywhere; a scan of files that needs no stat can leave it out."""
    parts = [q, *queries_below(q), *[r.query for r in q.roots if r.query]]
    out: set[str] = set()
    for p in parts:
        for x in [i.expr for i in p.items] + p.group + [e for e, _ in p.order] + ([p.where] if p.where else []):
            out |= {y.name if isinstance(y, (Col, Func)) else "*" for y in walk(x) if isinstance(y, (Col, Star, Func))}
        for r in p.roots:
            out |= scan_columns(r.query) if r.query and p is not q else set()
    return out
