"""Values, functions, predicates, sorting, grouping, subqueries and sinks, on small tables; the catalogue against DuckDB."""

import json
import math
import random

import pytest
from lodestone import catalogue
from lodestone.engine import Engine, QueryError
from lodestone.functions import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    rows = [(1, "a.TXT", 10, 1.5, True, "2020-01-01 10:00:00", "x"), (2, "b.txt", 2000, None, False, "2020-01-01 23:59:59", ""), (3, "c.md", None, -2.0, None, None, None), (4, None, 3, 0.0, True, "2021-06-05 00:00:00", "9"), (5, "line\nbreak.txt", 3, 1e20, True, "2021-06-05 01:02:03", "10")]
    e.register("t", spark.createDataFrame(rows, "id long, name string, n long, f double, flag boolean, ts string, s string").withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    e.register("one", spark.range(1).withColumnRenamed("id", "k"))
    e.register("none", spark.createDataFrame([], "id long, name string"))
    return e


def rows(engine, query):
    return [tuple(r) for r in engine.sql(query).collect()]


def ids(engine, condition):
    return sorted(r[0] for r in rows(engine, f"id from t where {condition}"))


@pytest.mark.parametrize(("condition", "want"), [
    ("name = '*.txt'", [1, 2]), ("name != '*.txt'", [3, 4, 5]), ("name === '*.txt'", []), ("name === 'c.md'", [3]), ("name !== c.md", [1, 2, 4, 5]), ("name = ''", [4]),
    ("name like '%.txt'", [1, 2]), ("name notlike '%.txt'", [3, 4, 5]), ("name like 'LINE%'", []), ("name =~ 'txt$'", [2, 5]), ("name !=~ 'txt$'", [1, 3, 4]), ("name =~ '^[a-c]\\.'", [1, 2, 3]),
    ("name > b", [2, 3, 5]), ("name < b", [1, 4]), ("n > 5", [1, 2]), ("n != 3", [1, 2]), ("not n != 3", [3, 4, 5]), ("n > 1k", [2]), ("n like '%'", []), ("n = 1.95k", []), ("f > 0", [1, 5]), ("f <= 0", [3, 4]), ("n > f", [1, 4]),
    ("flag", [1, 4, 5]), ("not flag", [2, 3]), ("flag = yes", [1, 4, 5]), ("flag != true", [2]), ("flag > false", [1, 4, 5]), ("not flag != true", [1, 3, 4, 5]), ("name <= c", [1, 2, 4]), ("s != 9", [1, 2, 3, 5]), ("s === ''", [2, 3]), ("n > 2.5", [1, 2, 4, 5]), ("not ts > 2020-01-01", [1, 2, 3]), ("ts = 2020-01-01", [1, 2]), ("ts != 2020-01-01", [4, 5]), ("ts > 2020-01-01", [4, 5]), ("ts >= '2021-06-05 01:00'", [5]),
    ("ts < '2020-01-01 12'", [1]), ("ts === 2021-06-05", [4]), ("ts between 2020-01 and 2021-01", [1, 2]), ("n in (3, 10)", [1, 4, 5]), ("n not in (3, 10)", [2, 3]), ("name in (c.md, '')", [3, 4]), ("f in (1.5)", [1]),
    ("n", []), ("name", []), ("n = 3 and f = 0 or id = 1", [1, 4]), ("not (n = 3 or n = 10)", [2, 3]), ("length(name) > 5", [5]), ("upper(name) = A.TXT", [1]), ("sqrt(f) >= 0", [1, 4, 5]), ("1 / f > 0", [1, 5]), ("10 > n", [4, 5]),
    ("exists (1)", [1, 2, 3, 4, 5]), ("n in (select n from t where id = 4)", [4, 5]), ("n not in (select n from t where id = 4)", [1, 2, 3]), ("exists (select * from none)", []), ("not exists (select * from none)", [1, 2, 3, 4, 5]),
    ("n = (select max(n) from t)", [2]), ("n > (select id from none)", []), ("name not in (select name from t where id > 1)", [1]),
])
def test_predicates(engine, condition, want):
    assert ids(engine, condition) == want


@pytest.mark.parametrize(("expr", "want"), [
    ("initcap('foo-bar baz_QUX')", "Foo-Bar Baz_Qux"), ("length('é😀')", 2), ("to_base64('hi')", "aGk="), ("from_base64('aGk=')", "hi"), ("from_base64('?')", ""), ("concat('a', 1, '')", "a1"), ("concat_ws('-', 'a', '', 'b')", "a--b"),
    ("locate('hello', 'l')", 3), ("locate('hello', 'l', 4)", 4), ("locate('hello', 'z')", 0), ("locate('hello', '', 0)", 1), ("locate('hello', '', 9)", 0), ("substr('abcdef', 2, 3)", "bcd"), ("substr('abc', -10, 2)", "ab"), ("substr('abc', 0)", "abc"), ("substr('abc', -2)", "bc"),
    ("replace('aXbX', 'X', 'y')", "ayby"), ("replace('a', '', 'y')", "a"), ("trim('  a\t ')", "a"), ("bin(5)", "101"), ("bin(-1)", "1" * 64), ("hex(255)", "ff"), ("oct(8)", "10"), ("hex('x')", None), ("abs(-5)", 5.0), ("pow(2, 3)", 8.0), ("pow(2)", 1.0),
    ("log(1000)", 3.0), ("log(8, 2)", 3.0), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("round(1.005, 2)", 1.0), ("round(1234, -2)", 1200.0), ("floor(-2.5)", -3.0), ("least(3, 1, 2)", 1.0), ("greatest('x', 1)", None), ("greatest(1, 'x', 7)", 7.0),
    ("year('2020-05-06')", 2020), ("year('nope')", None), ("dayname('2024-05-15')", "Wednesday"), ("date_add('2024-01-31 10:00:00', 1)", "2024-02-01 10:00:00"), ("date_sub('2024-01-01', 1)", "2023-12-31 00:00:00"), ("date_diff('2024-01-03', '2024-01-01 12:00:00')", 1),
    ("from_unixtime(0)", "1970-01-01 00:00:00"), ("last_day('2024-02-03')", "2024-02-29"), ("extract('isodow', '2024-05-19')", 7), ("extract(epoch, '1970-01-02')", 86400), ("date_trunc('week', '2024-05-15')", "2024-05-13 00:00:00"), ("dow('2024-05-19')", 1),
    ("format_time(146)", "2min 26s"), ("format_time(0)", "0s"), ("format_time('x')", None), ("coalesce('', 'b')", "b"), ("contains_greek('αβγ')", True), ("contains_kanji('日本')", True), ("contains_hiragana('か')", True), ("contains_katakana('か')", False), ("contains_japanese('abc')", False),
    ("1 + 2 * 3", 7.0), ("7 % 4", 3.0), ("'1k' + 1", 1025.0), ("'x' + 1", 1.0), ("-5", -5), ("lower('ÀB')", "àb"), ("upper('ß')", "SS"), ("rand(7, 7)", 7), ("pi()", math.pi),
])
def test_functions(engine, expr, want):
    ((found,),) = rows(engine, f"{expr} as v from one")
    assert found == want or isinstance(want, float) and math.isclose(found, want, rel_tol=1e-12)


def test_format_time_of_long_times(engine, spark):
    """Days are the greatest unit and no digit is lost, up to the largest number; the catalogue's query agrees with its SQL beyond a year."""
    import duckdb

    for seconds, want in ((31_557_600, "365d 6h"), (54_899_939, "635d 9h 58min 59s"), (2**53 + 1, "104249991374d 7h 36min 33s"), (8_640_000_000_000_086_399, "100000000000000d 23h 59min 59s"), (8_694_594_802_680_191_916, "100631884290279d 23h 58min 36s"), (2**63 - 1, "106751991167300d 15h 30min 7s"), (-1, None)):
        assert rows(engine, f"format_time({seconds}) from one") == [(want,)]
    query, sql = catalogue.QUERIES["format_time"]
    con = duckdb.connect()
    con.execute("CREATE VIEW customer AS SELECT range AS c_custkey FROM range(0, 900000, 997)")
    found = Engine(spark, {"customer": spark.range(0, 900000, 997).withColumnRenamed("id", "c_custkey")}).sql(query)
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(sql).fetchall())


@pytest.mark.parametrize(("modifier", "want"), [("", "1.60MiB"), (" ", "1.60 MiB"), ("%.0", "2MiB"), ("%.1", "1.6MiB"), ("%.2 ", "1.60 MiB"), ("%.2 d", "1.68 MB"), ("%.2 c", "1.60 MB"), ("%.2 k", "1638.79 KiB"), ("%.2 ck", "1638.79 KB"), ("%.0 ck", "1639 KB"), ("%.0 kb", "1678 KB"), ("%.0kb", "1678KB"), ("%.0s", "2M"), ("%.0 s", "2 M")])
def test_format_size(engine, modifier, want):
    assert rows(engine, f"format_size(1678123, '{modifier}') from one") == [(want,)]


@pytest.mark.parametrize("expr", ["1 / 0", "1 % 0", "sqrt(-1)", "ln(0)", "log(-1)", "log(2, 1)", "exp(1000)", "pow(10, 400)", "date_add('2020-01-01', 'x')", "substr('abc', 1, -1)"])
def test_row_errors(engine, expr):
    assert rows(engine, f"{expr} from one") == []


def test_aggregates(engine):
    assert rows(engine, "count(*), count(s), count(n), sum(n), avg(f), min(n), max(name), min(s) from t") == [(5, 3, 4, 2016.0, 2.5e19, 3, "line\nbreak.txt", "9")]
    assert rows(engine, "count(*), sum(id), var_samp(id) from none") == [(0, None, None)]
    assert rows(engine, "n, count(*) as c from t group by n order by c desc, n limit 2") == [(3, 2), (10, 1)]
    assert rows(engine, "n, count(*) from t group by n order by 1") == [(3, 2), (10, 1), (2000, 1), (None, 1)]
    assert sorted(rows(engine, "s from t group by s")) == [("",), ("10",), ("9",), ("x",)]
    assert rows(engine, "upper(flag), round(avg(n * 2), 1) from t where n > 0 group by upper(flag) order by 1") == [("FALSE", 4000.0), ("TRUE", 10.7)]
    assert rows(engine, "count(*), name from t") == [(5, "")]
    with pytest.raises(QueryError):
        engine.sql("flag, count(*) from t group by flag order by name").collect()


def test_sorting(engine):
    assert [r[0] for r in rows(engine, "id from t order by n, id")] == [4, 5, 1, 2, 3]
    assert [r[0] for r in rows(engine, "id from t order by n desc, id")] == [3, 2, 1, 4, 5]
    assert [r[0] for r in rows(engine, "id from t order by s, id desc")] == [3, 2, 5, 4, 1]
    assert [r[0] for r in rows(engine, "id from t order by ts desc limit 2")] == [5, 4]
    assert [r[0] for r in rows(engine, "id, n * 2 as d from t order by d desc limit 1 offset 1")] == [2]
    assert len(rows(engine, "id from t limit 0")) == 5 and rows(engine, "1 + 1 from t") == [(2.0,)] and rows(engine, "1 from none") == []


def test_correlated_subqueries(engine):
    near = rows(engine, "a.id, (select b.id from t as b where b.id != a.id and b.n > 0 order by abs(b.n - a.n) limit 1) as near from t as a where n > 0 order by id")
    assert near == [(1, 4), (2, 1), (4, 5), (5, 4)]
    assert rows(engine, "a.id, (select count(*) from t as b where b.n = a.n) as c from t as a order by 1") == [(1, 1), (2, 1), (3, 0), (4, 2), (5, 2)]
    assert rows(engine, "id from t as a where exists (select * from t as b where b.id = 4 and not exists (select * from t as c where c.id = a.id and c.n > b.n)) order by id") == [(3,), (4,), (5,)]
    assert rows(engine, "id from t as a where n in (select b.n from t as b where b.id > a.id)") == [(4,)]
    for bad in ("id from t where x.id = 1", "id from t where id in (select id, n from t)", "id from t where ts = 'not a date'", "* from t group by id", "id from nowhere", "extract('era', '2020-01-01') from one"):
        with pytest.raises(QueryError):
            engine.sql(bad).collect()


def test_sinks(engine):
    q = "id, name, f from t where id < 3 or id = 5 order by id"
    assert engine.text(q) == "1\ta.TXT\t1.5\n2\tb.txt\t\n5\tline\nbreak.txt\t100000000000000000000\n"
    assert engine.text(q + " into lines").startswith("1\na.TXT\n1.5\n") and engine.text("id from t where id = 1 into list") == "1\0"
    assert engine.text("id, 'a,\"b' from t where id = 1 into csv") == '1,"a,""b"\n'
    assert json.loads(engine.text("id, id, flag from t where id = 1 into json")) == [{"id": "1", "id_2": "1", "flag": "true"}]
    page = engine.text("'<&>' from t where id = 1 into html")
    assert "<td>&lt;&amp;&gt;</td>" in page and "<title>" in page


def test_own_functions(engine):
    registry.register_function("twice", "int", lambda c: c * 2, 1)
    try:
        assert rows(engine, "twice(n) from t where id = 1") == [(20,)]
    finally:
        del registry.FUNCTIONS["twice"]


def test_plans(spark):
    """Filters and columns reach the scan; a limited sort is a top-k; EXISTS is a semi-join."""
    e = Engine.over(spark, SF, ["orders", "customer"])
    plan = lambda q: e.sql(q)._jdf.queryExecution().executedPlan().toString()
    p = plan("o_orderkey from orders where o_totalprice > 1000 order by o_totalprice limit 3")
    assert "GreaterThan(o_totalprice,1000.0)" in p and "EqualTo(o_custkey,7)" in plan("o_orderkey from orders where o_custkey = 7") and "EqualTo(o_orderstatus,F)" in plan("o_orderkey from orders where o_orderstatus = F")
    assert "LessThan(o_orderdate,1" in plan("o_orderkey from orders where o_orderdate = 1996-01") and "TakeOrderedAndProject" in p and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p
    for q in ("c_custkey, (select count(*) from orders as o where o.o_custkey = c.c_custkey) as n from customer as c", "c_name from customer as c where exists (select * from orders as o where o.o_custkey = c.c_custkey and o.o_totalprice > c.c_acctbal)", "c_name from customer as c where c_custkey in (select o_custkey from orders)", "c_name from customer as c where c_acctbal > 1 or c_name in (select o_orderstatus from orders)", "c_name from customer as c where exists (select * from customer as d where d.c_name = c.c_name)"):
        assert "NestedLoop" not in plan(q) and "Cartesian" not in plan(q), q
    assert "LeftSemi" in plan("c_name from customer as c where exists (select * from orders as o where o.o_custkey = c.c_custkey)")


def test_exists_by_extremes(spark):
    """EXISTS by keys and one order of numbers joins one row a key, and finds what comparing all pairs finds: nulls, not-a-numbers, missing keys and mixed kinds too."""
    rng = random.Random(3)
    number = lambda: rng.choice([None, float("nan"), rng.randint(-5, 5) / 2, 1e300, float("-inf")])
    key = lambda: rng.choice([None, "", "a", "b", "c", "d"])
    left = [(i, key(), number(), rng.choice([None, rng.randint(-3, 3)])) for i in range(60)]
    right = [(rng.choice(["", "a", "b", None]), number(), rng.choice([None, rng.randint(-3, 3)])) for _ in range(12)]
    e = Engine(spark)
    e.register("l", spark.createDataFrame(left, "i long, k string, f double, n long"))
    e.register("r", spark.createDataFrame(right, "k string, f double, n long"))
    above = lambda a, b: a == a and b == b and a > b or a != a and b == b  # noqa: E731  not-a-number is the greatest
    orders = {">": above, ">=": lambda a, b: not above(b, a), "<": lambda a, b: above(b, a), "<=": lambda a, b: not above(a, b)}
    for keyed, (op, holds), (own, other, a, b) in [(k, o, c) for k in (True, False) for o in orders.items() for c in (("f", "f", 2, 1), ("n", "f", 3, 1), ("f", "n", 2, 2), ("n", "n", 3, 2))]:
        for shape, want_ in ((f"r.{other} {op} l.{own}", lambda x, y: holds(y, x)), (f"l.{own} {op} r.{other}", holds)):
            where = shape + (" and r.k = l.k" if keyed else "")
            want = {x[0] for x in left if any(x[a] is not None and y[b] is not None and want_(x[a], y[b]) and (not keyed or (x[1] or "") == (y[0] or "")) for y in right)}
            q = f"i from l as l where exists (select * from r as r where {where})"
            assert {r[0] for r in rows(e, q)} == want, q
            if own == other:
                assert {r[0] for r in rows(e, q.replace("exists", "not exists"))} == {x[0] for x in left} - want, q
    plan = e.sql("i from l as l where exists (select * from r as r where r.f > l.f and r.k = l.k)")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "LeftSemi" in plan


def test_catalogue(spark):
    """Every query with SQL gives what the SQL gives, on the smallest tables."""
    from concurrent.futures import ThreadPoolExecutor

    import duckdb

    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    clean = lambda rows: sorted(repr([round(v, 8) + 0.0 if isinstance(v, float) and v == v else None if v != v else v for v in r]) for r in rows)
    sql = catalogue.oracle_sql()

    def check(item):
        name, query = item
        found = query(spark, SF)
        got = found.collect()
        if name in sql:
            want = con.cursor().execute(sql[name])
            names = [d[0] for d in want.description]
            assert sorted(names) == sorted(found.columns), name
            assert clean([[r[n] for n in names] for r in got]) == clean(want.fetchall()), name

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(check, catalogue.queries().items()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("key", "inner"), [(False, "inner_rows"), (True, "inner_rows"), (False, "no_rows")])
def test_nearest(spark, key, inner):
    """Ties, repeated, missing, endless and no numbers, missing keys; against every pair."""
    draw = random.Random(3)
    schema = "id long, k string, x double"
    sides = {"outer_rows": 300, "inner_rows": 400, "no_rows": 0}
    data = {n: [(i, draw.choice([None, "a", "b", ""]), draw.choice([None, 1.5, math.nan, math.inf, *[draw.randint(-250, 250) / 2 for _ in range(20)]])) for i in range(size)] for n, size in sides.items()}
    e = Engine(spark, {n: spark.createDataFrame(d, schema) for n, d in data.items()})
    df = e.sql(f"id, (select t.id from {inner} as t {'where t.k = u.k' if key else ''} order by abs(u.x - t.x) limit 1) as near from outer_rows as u")
    want = []
    for i, k, x in data["outer_rows"]:
        apart = [(abs(y - x), j) for j, other, y in data[inner] if (not key or (other or "") == (k or "")) and None not in (x, y) and math.isfinite(abs(y - x))]
        want.append((i, min(apart)[1] if apart else None))
    assert sorted(tuple(r) for r in df.collect()) == want
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
