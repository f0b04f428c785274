"""Registered queries, one or more for every operator of the language, and the DuckDB SQL that each must agree with.

All run over whole tables. Sums and means are rounded, as their last digits depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fixture_tree
from .engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")

#: name: (query, SQL)
QUERIES: dict[str, tuple[str, str | None]] = {}


def q(name: str, query: str, sql: str | None = None) -> None:
    QUERIES[name] = (query, sql)


def value(name: str, table: str, key: str, expr: str, sql: str) -> None:
    """A query of one expression by key."""
    q(name, f"{key}, {expr} as v from {table}", f"SELECT {key}, {sql} AS v FROM {table}")


def keep(name: str, table: str, key: str, condition: str, sql: str) -> None:
    """A query of the keys that a condition keeps."""
    q(name, f"{key} from {table} where {condition}", f"SELECT {key} FROM {table} WHERE {sql}")


# Projection
q("select_star", "select * from nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
q("select_alias", "c_custkey as id, c_name as customer from customer", "SELECT c_custkey AS id, c_name AS customer FROM customer")
q("constant_select_limit1", "1 + 2 as three, 'x' as x from region", "SELECT CAST(3 AS DOUBLE) AS three, 'x' AS x")
q("arithmetic_all", "l_orderkey as k, l_linenumber as l, l_quantity + l_tax * 2 - l_discount / 4 as v, l_quantity % 7 as m, l_linenumber minus 1 as w from lineitem", "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS l, l_quantity + l_tax * 2 - l_discount / 4 AS v, l_quantity % 7 AS m, CAST(l_linenumber - 1 AS DOUBLE) AS w FROM lineitem")
q("unary_minus", "c_custkey as k, -c_acctbal as v from customer", "SELECT c_custkey AS k, -c_acctbal AS v FROM customer")
q("row_errors_drop_rows", "o_orderkey as k, sqrt(o_totalprice - 100000) as v from orders", "SELECT o_orderkey AS k, sqrt(o_totalprice - 100000) AS v FROM orders WHERE o_totalprice >= 100000")
q("division_by_zero_drops_rows", "l_orderkey as k, l_linenumber as l, 1 / l_discount as v from lineitem", "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS l, 1 / l_discount AS v FROM lineitem WHERE l_discount <> 0")

# Predicates
for _op, _sql in (("=", "="), ("!=", "<>"), ("===", "="), ("!==", "<>"), (">", ">"), (">=", ">="), ("<", "<"), ("<=", "<=")):
    _name = {"=": "eq", "!=": "ne", "===": "eeq", "!==": "ene", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[_op]
    keep(f"cmp_int_{_name}", "orders", "o_orderkey", f"o_custkey {_op} 100", f"o_custkey {_sql} 100")
    keep(f"cmp_string_{_name}", "orders", "o_orderkey", f"o_orderpriority {_name} '2-HIGH'", f"o_orderpriority {_sql} '2-HIGH'")
    keep(f"cmp_float_{_name}", "part", "p_partkey", f"p_retailprice {_op} 1000.5", f"p_retailprice {_sql} 1000.5")
keep("glob_eq", "part", "p_partkey", "p_name = '*1?'", "regexp_matches(p_name, '(?i)^.*1.$')")
keep("glob_ne", "part", "p_partkey", "p_name != '*1?'", "NOT regexp_matches(p_name, '(?i)^.*1.$')")
keep("regex", "part", "p_partkey", "p_type =~ '^[A-M].*E'", "regexp_matches(p_type, '^[A-M].*E')")
keep("not_regex", "part", "p_partkey", "p_type !=~ '^[A-M].*E'", "NOT regexp_matches(p_type, '^[A-M].*E')")
keep("like", "customer", "c_custkey", "c_name like '%00_1'", "c_name ILIKE '%00_1'")
keep("like_stops_at_line_ends", "documents", "doc_id", "text like '%the%'", "regexp_matches(text, '(?i)\\A.*the.*\\z')")
keep("not_like", "customer", "c_custkey", "c_mktsegment not like 'b%'", "c_mktsegment NOT ILIKE 'b%'")
keep("between", "lineitem", "l_orderkey", "l_quantity between 10 and 12", "l_quantity BETWEEN 10 AND 12")
keep("not_between", "lineitem", "l_orderkey", "l_quantity notbetween 3 and 48", "l_quantity NOT BETWEEN 3 AND 48")
keep("in_list", "orders", "o_orderkey", "o_orderstatus in ('F', 'P')", "o_orderstatus IN ('F', 'P')")
keep("not_in_list", "orders", "o_orderkey", "o_custkey not in (1, 2, 3)", "o_custkey NOT IN (1, 2, 3)")
keep("exists_list", "region", "r_name", "exists (1, 2)", "true")
keep("bare_non_boolean", "region", "r_name", "r_regionkey", "false")
keep("boolean_function", "documents", "doc_id", "contains('the')", "contains(text, 'the')")
keep("and_or", "lineitem", "l_orderkey", "(l_quantity > 49 or l_discount > 0.09) and l_returnflag = R", "(l_quantity > 49 OR l_discount > 0.09) AND l_returnflag = 'R'")
keep("not_demorgan", "lineitem", "l_orderkey", "not (l_quantity > 2 or l_returnflag = 'A')", "NOT (l_quantity > 2 OR l_returnflag = 'A')")
keep("size_suffix", "documents", "doc_id", "size > 2k", "n_chars > 2048")
keep("size_suffix_decimal", "documents", "doc_id", "size <= 1.5kb", "n_chars <= 1500")
keep("date_eq_day", "events", "event_id", "ts = 2024-01-05", "date_trunc('day', ts) = TIMESTAMP '2024-01-05'")
keep("date_eq_hour", "events", "event_id", "ts = '2024-01-05 07'", "date_trunc('hour', ts) = TIMESTAMP '2024-01-05 07:00:00'")
keep("date_ne_day", "events", "event_id", "ts != 2024-01-05", "date_trunc('day', ts) <> TIMESTAMP '2024-01-05'")
keep("date_gt_day", "events", "event_id", "ts > 2024-01-05", "ts >= TIMESTAMP '2024-01-06'")
keep("date_gte_day", "events", "event_id", "ts >= 2024-01-05", "ts >= TIMESTAMP '2024-01-05'")
keep("date_lt_day", "events", "event_id", "ts < 2024-01-05", "ts < TIMESTAMP '2024-01-05'")
keep("date_lte_day", "events", "event_id", "ts <= 2024-01-05", "ts < TIMESTAMP '2024-01-06'")
keep("date_between_months", "orders", "o_orderkey", "o_orderdate between 1996-02 and 1996-03", "o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-04-01'")
keep("date_in_list", "orders", "o_orderkey", "o_orderdate in (1996-02-03, 1996-02-05)", "CAST(o_orderdate AS DATE) IN (DATE '1996-02-03', DATE '1996-02-05')")

# Aggregates
q("count_star", "count(*) as n from lineitem", "SELECT count(*) AS n FROM lineitem")
q("count_nonempty", "count(replace(lang, 'en', '')) as n, count(*) as everything from documents", "SELECT count(nullif(replace(lang, 'en', ''), '')) AS n, count(*) AS everything FROM documents")
q("sum_avg", "round(sum(l_extendedprice), 2) as s, round(avg(l_extendedprice), 4) as a from lineitem", "SELECT round(sum(l_extendedprice) * 100) / 100 AS s, round(avg(l_extendedprice) * 10000) / 10000 AS a FROM lineitem")
q("min_max_number", "min(l_quantity) as a, max(l_extendedprice) as b, min(l_orderkey) as c from lineitem", "SELECT min(l_quantity) AS a, max(l_extendedprice) AS b, min(l_orderkey) AS c FROM lineitem")
q("min_max_text", "min(c_name) as a, max(c_mktsegment) as b from customer", "SELECT min(c_name) AS a, max(c_mktsegment) AS b FROM customer")
q("min_max_time", "min(ts) as a, max(ts) as b from events", "SELECT min(ts) AS a, max(ts) AS b FROM events")
for _f in ("var_pop", "var_samp", "stddev_pop", "stddev_samp", "variance", "std"):
    _s = {"variance": "var_pop", "std": "stddev_pop"}.get(_f, _f)
    q(_f, f"l_returnflag as k, round({_f}(l_quantity), 6) as v from lineitem group by l_returnflag", f"SELECT l_returnflag AS k, round({_s}(l_quantity) * 1000000) / 1000000 AS v FROM lineitem GROUP BY 1")
q("aggregate_of_expression", "o_orderstatus as k, min(year(o_orderdate)) as a, round(sum(o_totalprice * 2), 2) as b from orders group by o_orderstatus", "SELECT o_orderstatus AS k, CAST(min(year(o_orderdate)) AS BIGINT) AS a, round(sum(o_totalprice * 2) * 100) / 100 AS b FROM orders GROUP BY 1")
q("scalar_of_aggregate", "lang as k, concat(count(*), '/', max(n_chars)) as v from documents group by lang", "SELECT lang AS k, concat(count(*), '/', max(n_chars)) AS v FROM documents GROUP BY 1")
q("global_aggregate_of_nothing", "count(*) as n, sum(l_quantity) as s from lineitem where l_quantity > 1000", "SELECT count(*) AS n, sum(l_quantity) AS s FROM lineitem WHERE l_quantity > 1000")
q("group_single", "o_orderpriority as k, count(*) as n from orders group by o_orderpriority", "SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1")
q("group_multi", "l_returnflag as flag, l_linestatus as status, round(sum(l_quantity), 2) as sum_qty, round(avg(l_extendedprice), 4) as avg_price, count(*) as n from lineitem where l_quantity > 10 group by 1, 2 order by 1, 2", "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity) * 100) / 100 AS sum_qty, round(avg(l_extendedprice) * 10000) / 10000 AS avg_price, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2 ORDER BY 1, 2")
q("group_expression", "year(o_orderdate) as y, count(*) as n from orders group by year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1")
q("group_without_aggregate", "p_brand as brand, p_size as size from part group by p_brand, p_size", "SELECT DISTINCT p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part")
q("order_by_unselected_aggregate", "p_brand as brand from part group by p_brand order by count(*) desc, p_brand limit 5", "SELECT p_brand AS brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5")
q("group_limit_offset", "c_nationkey as k, count(*) as n from customer group by c_nationkey order by 1 limit 5 offset 3", "SELECT CAST(c_nationkey AS BIGINT) AS k, count(*) AS n FROM customer GROUP BY 1 ORDER BY 1 LIMIT 5 OFFSET 3")
q("ungrouped_column_is_empty", "count(*) as n, r_name as r from region", "SELECT count(*) AS n, '' AS r FROM region")

# Sorting and limits
q("order_multiple", "o_orderkey as k, o_orderstatus as s from orders order by o_orderstatus desc, o_orderkey", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders ORDER BY 2 DESC, 1")
q("order_positional", "c_custkey as k, c_acctbal as v from customer order by 2 desc, 1 limit 20", "SELECT c_custkey AS k, c_acctbal AS v FROM customer ORDER BY 2 DESC, 1 LIMIT 20")
q("top_k", "o_orderkey as k, o_totalprice as v from orders order by o_totalprice desc, o_orderkey limit 10", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders ORDER BY 2 DESC, 1 LIMIT 10")
q("limit_offset", "p_partkey as k from part order by p_partkey limit 7 offset 11", "SELECT p_partkey AS k FROM part ORDER BY 1 LIMIT 7 OFFSET 11")
q("limit_comma", "p_partkey as k from part order by p_partkey limit 11, 7", "SELECT p_partkey AS k FROM part ORDER BY 1 LIMIT 7 OFFSET 11")
q("limit_zero_takes_all", "n_name as n from nation limit 0", "SELECT n_name AS n FROM nation")
q("order_missing_numbers_last", "doc_id as k from documents order by greatest(replace(lang, 'en', 'x')), doc_id limit 20", "SELECT doc_id AS k FROM documents ORDER BY doc_id LIMIT 20")

# Text functions
value("lower", "customer", "c_custkey", "lower(c_mktsegment)", "lower(c_mktsegment)")
value("upper", "customer", "c_custkey", "ucase(c_name)", "upper(c_name)")
value("initcap", "part", "p_partkey", "initcap(concat(p_type, '-of_', p_brand))", "array_to_string(list_transform(regexp_extract_all(lower(concat(p_type, '-of_', p_brand)), '[a-z0-9]+|[^a-z0-9]+'), lambda w: upper(w[1]) || w[2:]), '')")
value("length", "documents", "doc_id", "length(text)", "length(text)")
value("to_base64", "documents", "doc_id", "to_base64(text)", "to_base64(encode(text))")
value("from_base64", "customer", "c_custkey", "from_base64(base64(c_name))", "c_name")
value("from_base64_invalid", "region", "r_name", "from_base64('%%%')", "''")
value("concat", "orders", "o_orderkey", "concat(o_orderstatus, '-', o_custkey)", "concat(o_orderstatus, '-', o_custkey)")
value("concat_ws", "customer", "c_custkey", "concat_ws('|', c_name, replace(c_mktsegment, c_mktsegment, ''), c_nationkey)", "c_name || '||' || c_nationkey")
value("locate", "documents", "doc_id", "locate(text, 'the')", "strpos(text, 'the')")
value("locate_from", "part", "p_partkey", "position(p_name, 'a', 4)", "CASE WHEN strpos(substr(p_name, 4), 'a') > 0 THEN strpos(substr(p_name, 4), 'a') + 3 ELSE 0 END")
value("substr", "documents", "doc_id", "substr(text, 3, 10)", "substr(text, 3, 10)")
value("substr_negative", "customer", "c_custkey", "substring(c_name, -4, 2)", "substr(c_name, -4, 2)")
value("substr_zero", "customer", "c_custkey", "substr(c_name, 0, 2)", "substr(c_name, 1, 2)")
value("replace", "documents", "doc_id", "replace(text, 'the', 'THE')", "replace(text, 'the', 'THE')")
value("trim", "customer", "c_custkey", "trim(concat('\t ', c_name, ' '))", "c_name")
value("ltrim", "customer", "c_custkey", "ltrim(concat('  ', c_name, ' '))", "c_name || ' '")
value("rtrim", "customer", "c_custkey", "rtrim(concat('  ', c_name, ' '))", "'  ' || c_name")
for _f, _r in (("contains_greek", "[\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}]"), ("contains_kanji", "[\\x{4E00}-\\x{9FAF}\\x{3400}-\\x{4DBF}]"), ("contains_hiragana", "[\\x{3041}-\\x{309F}]"), ("contains_katakana", "[\\x{30A1}-\\x{30FF}]"), ("contains_kana", "[\\x{3041}-\\x{30FF}]"), ("contains_japanese", "[\\x{3000}-\\x{30FF}\\x{4E00}-\\x{9FAF}]")):
    value(_f, "documents", "doc_id", f"{_f}(text)", f"regexp_matches(text, '{_r}')")

# Number functions
for _f, _e, _s in (
    ("abs", "abs(c_acctbal)", "abs(c_acctbal)"), ("floor", "floor(c_acctbal)", "CAST(floor(c_acctbal) AS DOUBLE)"), ("ceil", "ceiling(c_acctbal)", "CAST(ceil(c_acctbal) AS DOUBLE)"), ("round0", "round(c_acctbal)", "CAST(round(c_acctbal) AS DOUBLE)"),
    ("round2", "round(c_acctbal / 3, 2)", "round(c_acctbal / 3 * 100) / 100"), ("round_negative", "round(c_acctbal, -2)", "round(c_acctbal * 0.01::DOUBLE) / 0.01::DOUBLE"), ("least", "least(c_acctbal, 1000, c_custkey)", "least(c_acctbal, 1000, c_custkey)"),
    ("greatest", "greatest(c_acctbal, 1000, c_custkey)", "greatest(c_acctbal, 1000, c_custkey)"), ("pow", "pow(c_nationkey, 2)", "CAST(pow(c_nationkey, 2) AS DOUBLE)"), ("exp", "round(exp(c_nationkey / 10), 9)", "round(exp(c_nationkey / 10) * 1000000000) / 1000000000"),
    ("pi", "pi() * 1", "pi()"), ("bin", "bin(c_custkey)", "bin(c_custkey)"), ("hex", "hex(c_custkey)", "lower(to_hex(c_custkey))"), ("oct", "oct(c_custkey)", "CASE WHEN c_custkey = 0 THEN '0' ELSE ltrim(concat(c_custkey // 32768 % 8, c_custkey // 4096 % 8, c_custkey // 512 % 8, c_custkey // 64 % 8, c_custkey // 8 % 8, c_custkey % 8), '0') END"),
):
    value(_f, "customer", "c_custkey", _e, _s)
q("sqrt", "c_custkey as k, sqrt(c_acctbal) as v from customer", "SELECT c_custkey AS k, sqrt(c_acctbal) AS v FROM customer WHERE c_acctbal >= 0")
q("log10", "c_custkey as k, round(log(c_acctbal), 9) as v from customer", "SELECT c_custkey AS k, round(log10(c_acctbal) * 1000000000) / 1000000000 AS v FROM customer WHERE c_acctbal > 0")
q("log_base", "c_custkey as k, round(log(c_acctbal, 2), 9) as v from customer", "SELECT c_custkey AS k, round(ln(c_acctbal) / ln(2) * 1000000000) / 1000000000 AS v FROM customer WHERE c_acctbal > 0")
q("ln", "c_custkey as k, round(ln(c_acctbal), 9) as v from customer", "SELECT c_custkey AS k, round(ln(c_acctbal) * 1000000000) / 1000000000 AS v FROM customer WHERE c_acctbal > 0")
q("random", "c_custkey as k, rand(5, 9) as v from customer where random(1) < 2")

# Dates
for _f in ("year", "month", "day"):
    value(_f, "orders", "o_orderkey", f"{_f}(o_orderdate)", f"CAST({_f}(o_orderdate) AS BIGINT)")
value("dayofweek", "orders", "o_orderkey", "dow(o_orderdate)", "CAST(dayofweek(o_orderdate) + 1 AS BIGINT)")
value("dayname", "orders", "o_orderkey", "dayname(o_orderdate)", "dayname(o_orderdate)")
value("dayofyear", "orders", "o_orderkey", "doy(o_orderdate)", "CAST(dayofyear(o_orderdate) AS BIGINT)")
value("date_add", "events", "event_id", "date_add(ts, 40)", "strftime(ts + INTERVAL 40 DAY, '%Y-%m-%d %H:%M:%S')")
value("date_sub", "events", "event_id", "datesub(ts, 40)", "strftime(ts - INTERVAL 40 DAY, '%Y-%m-%d %H:%M:%S')")
value("date_diff", "events", "event_id", "date_diff(ts, '2024-01-10 12:00:00')", "date_sub('day', TIMESTAMP '2024-01-10 12:00:00', ts)")
value("from_unixtime", "orders", "o_orderkey", "from_unixtime(o_orderkey * 1000)", "strftime(make_timestamp(o_orderkey * 1000000000), '%Y-%m-%d %H:%M:%S')")
value("last_day", "orders", "o_orderkey", "last_day(o_orderdate)", "strftime(last_day(o_orderdate), '%Y-%m-%d')")
value("year_of_text", "region", "r_name", "year('2021-05-06')", "CAST(2021 AS BIGINT)")
for _u, _s in (("year", "year(ts)"), ("quarter", "quarter(ts)"), ("month", "month(ts)"), ("week", "week(ts)"), ("day", "day(ts)"), ("hour", "hour(ts)"), ("minute", "minute(ts)"), ("second", "second(ts)"), ("dow", "dayofweek(ts) + 1"), ("isodow", "isodow(ts)"), ("doy", "dayofyear(ts)"), ("epoch", "floor(epoch(ts))")):
    value(f"extract_{_u}", "events", "event_id", f"extract('{_u}', ts)", f"CAST({_s} AS BIGINT)")
for _u in ("year", "quarter", "month", "week", "day", "hour", "minute", "second"):
    value(f"date_trunc_{_u}", "events", "event_id", f"date_trunc('{_u}', ts)", f"strftime(date_trunc('{_u}', ts), '%Y-%m-%d %H:%M:%S')")
q("current_date_time", "count(*) as n from region where current_date = substr(now, 1, 10) and length(current_time) = 8", None)
q("current_ids", "current_uid as u, current_gid as g, current_user as name, current_group as of from region limit 1", None)

# Formats
for _i, (_m, _u, _base, _power, _places) in enumerate((("%.2 k", " KiB", 1024, 1, 2), ("%.1kb", "KB", 1000, 1, 1), ("%.2 ck", " KB", 1024, 1, 2), ("%.3 m", " MiB", 1024, 2, 3))):
    q(f"format_size_fixed_{_i}", f"c_custkey as k, format_size(c_custkey * 1001, '{_m}') as v from customer", f"SELECT c_custkey AS k, printf('%.{_places}f', round_even(c_custkey * 1001 / CAST({_base ** _power} AS DOUBLE), {_places})) || '{_u}' AS v FROM customer")
q("format_size_units", "c_custkey as k, format_size(c_custkey * 1000000) as v from customer")
q("format_time", "c_custkey as k, format_time(c_custkey * 61) as v from customer", "SELECT c_custkey AS k, CASE WHEN c_custkey = 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN c_custkey * 61 // 86400 > 0 THEN (c_custkey * 61 // 86400) || 'd' END, CASE WHEN c_custkey * 61 // 3600 % 24 > 0 THEN (c_custkey * 61 // 3600 % 24) || 'h' END, CASE WHEN c_custkey * 61 // 60 % 60 > 0 THEN (c_custkey * 61 // 60 % 60) || 'min' END, CASE WHEN c_custkey * 61 % 60 > 0 THEN (c_custkey * 61 % 60) || 's' END) END AS v FROM customer")
value("coalesce", "documents", "doc_id", "coalesce(replace(lang, 'en', ''), source)", "coalesce(nullif(replace(lang, 'en', ''), ''), source)")

# Contents of a text column
value("line_count", "documents", "doc_id", "line_count", "CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT)")
value("word_count", "documents", "doc_id", "words", "len(regexp_extract_all(text, '\\S+'))")
value("char_count", "documents", "doc_id", "chars", "length(text)")
value("sha1", "documents", "doc_id", "sha1", "sha1(text)")
value("sha256", "documents", "doc_id", "sha256", "sha256(text)")
q("sha512", "doc_id as k, sha512 as v from documents")
q("sha3", "doc_id as k, sha3 as v from documents")
value("encoding", "documents", "doc_id", "encoding", "CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'UTF-8' ELSE 'ASCII' END")
value("has_bom", "documents", "doc_id", "has_bom", "starts_with(text, chr(65279))")
value("line_ending", "documents", "doc_id", "eol", "CASE WHEN contains(text, chr(10)) THEN 'LF' END")
value("is_shebang", "documents", "doc_id", "is_shebang", "starts_with(text, '#!')")
value("is_text", "documents", "doc_id", "is_text", "NOT contains(text, chr(0))")
value("contains_text", "pages", "page_id", "contains('<p>')", "contains(html, '<p>')")
value("formatted_size_field", "documents", "doc_id", "fsize", "n_chars")

# Parts of paths
value("field_name", "pages", "page_id", "name", "url")
value("field_filename", "pages", "page_id", "filename", "regexp_replace(url, '\\.[^.]*$', '')")
value("field_ext", "pages", "page_id", "ext", "regexp_extract(url, '\\A.+\\.([^.]*)\\z', 1)")
value("field_dir", "pages", "page_id", "dir", "regexp_replace(url, '/?[^/]*$', '')")
value("field_is_source", "pages", "page_id", "is_source", "regexp_matches(lower(url), '\\.(c|cc|cpp|js|php|py|rs|java|go|ts)$')")
value("field_is_archive", "pages", "page_id", "is_archive", "regexp_matches(lower(url), '\\.(zip|gz|tar|7z|xz|rar|bz2|lz)$')")
value("field_is_hidden", "pages", "page_id", "is_hidden", "starts_with(url, '.')")

# Subqueries
keep("in_subquery", "nation", "n_name", "n_regionkey in (select r_regionkey from region where r_name like 'A%')", "n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
keep("not_in_subquery", "customer", "c_custkey", "c_custkey not in (select o_custkey from orders where o_totalprice > 100000)", "c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
keep("not_in_is_two_valued", "documents", "doc_id", "lang not in (select replace(lang, 'de', '') from documents)", "lang = 'de'")
q("exists_correlated", "c_custkey as k from customer as c where exists (select * from orders as o where o.o_custkey = c.c_custkey and o.o_totalprice > 300000)", "SELECT c_custkey AS k FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
q("not_exists_correlated", "c_custkey as k from customer as c where not exists (select * from orders as o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F')", "SELECT c_custkey AS k FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
q("exists_uncorrelated", "r_name as r from region where exists (select * from nation where n_regionkey = 3)", "SELECT r_name AS r FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 3)")
q("exists_theta", "s_suppkey as k from supplier as s where not exists (select * from customer as c where c.c_acctbal > s.s_acctbal and c.c_nationkey = s.s_nationkey)", "SELECT s_suppkey AS k FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal > s.s_acctbal AND c.c_nationkey = s.s_nationkey)")
q("exists_or_condition", "c_custkey as k from customer as c where c_acctbal > 9000 or exists (select * from orders as o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000)", "SELECT c_custkey AS k FROM customer c WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
q("in_correlated", "c_custkey as k from customer as c where 'F' in (select o.o_orderstatus from orders as o where o.o_custkey = c.c_custkey)", "SELECT c_custkey AS k FROM customer c WHERE 'F' IN (SELECT o.o_orderstatus FROM orders o WHERE o.o_custkey = c.c_custkey)")
q("in_or_in", "n_name as n from nation where n_nationkey in (select s_nationkey from supplier where s_acctbal > 9000) or n_regionkey in (select r_regionkey from region where r_regionkey > 3)", "SELECT n_name AS n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) OR n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 3)")
q("nested_in_three_levels", "r_name as r from region where r_regionkey in (select n_regionkey from nation where n_nationkey in (select c_nationkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)))", "SELECT r_name AS r FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)))")
q("exists_two_levels", "n_name as n from nation as n where exists (select * from customer as c where c.c_nationkey = n.n_nationkey and exists (select * from supplier as s where s.s_nationkey = n.n_nationkey and s.s_acctbal > c.c_acctbal and c.c_acctbal > 5000))", "SELECT n_name AS n FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > c.c_acctbal AND c.c_acctbal > 5000))")
q("not_exists_two_levels", "n_name as n from nation as n where exists (select * from supplier as s where s.s_nationkey = n.n_nationkey and not exists (select * from customer as c where c.c_nationkey = n.n_nationkey and c.c_acctbal > s.s_acctbal))", "SELECT n_name AS n FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > s.s_acctbal))")
q("scalar_uncorrelated", "p_partkey as k from part where p_retailprice = (select max(p_retailprice) from part)", "SELECT p_partkey AS k FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)")
q("scalar_correlated_aggregate", "c_custkey as k, (select count(*) from orders as o where o.o_custkey = c.c_custkey) as n, (select max(o.o_totalprice) from orders as o where o.o_custkey = c.c_custkey) as top from customer as c", "SELECT c_custkey AS k, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c")
q("scalar_nearest", "s_suppkey as k, (select c.c_custkey from customer as c where c.c_nationkey = s.s_nationkey order by abs(c.c_acctbal - s.s_acctbal) limit 1) as near from supplier as s", "SELECT s_suppkey AS k, (SELECT arg_min(c_custkey, (abs(c_acctbal - s_acctbal), c_custkey)) FROM customer c WHERE c.c_nationkey = s.s_nationkey) AS near FROM supplier s")
q("scalar_nearest_of_all", "s_suppkey as k, (select c.c_custkey from customer as c order by abs(c.c_acctbal - s.s_acctbal) limit 1) as near from supplier as s", "SELECT s_suppkey AS k, (SELECT arg_min(c_custkey, (abs(c_acctbal - s_acctbal), c_custkey)) FROM customer c) AS near FROM supplier s")
q("scalar_nearest_in_where", "s_suppkey as k from supplier as s where 50 > abs(s_acctbal - (select c.c_acctbal from customer as c where c.c_mktsegment = 'BUILDING' order by abs(s.s_acctbal - c.c_acctbal) limit 1))", "SELECT s_suppkey AS k FROM supplier s WHERE 50 > abs(s_acctbal - (SELECT arg_min(c_acctbal, (abs(s_acctbal - c_acctbal), c_acctbal)) FROM customer c WHERE c_mktsegment = 'BUILDING'))")
q("scalar_in_where_and_order", "c_custkey as k from customer as c where c.c_acctbal > (select avg(s.s_acctbal) from supplier as s where s.s_nationkey = c.c_nationkey) order by (select count(*) from orders as o where o.o_custkey = c.c_custkey) desc, c_custkey limit 15", "SELECT c_custkey AS k FROM customer c WHERE c.c_acctbal > (SELECT avg(s.s_acctbal) FROM supplier s WHERE s.s_nationkey = c.c_nationkey) ORDER BY (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) DESC, c_custkey LIMIT 15")
q("scalar_in_group", "(select r.r_name from region as r where r.r_regionkey = n.n_regionkey) as r, count(*) as n from nation as n group by 1", "SELECT (SELECT r_name FROM region r WHERE r.r_regionkey = n.n_regionkey) AS r, count(*) AS n FROM nation n GROUP BY 1")
q("from_subquery", "o_orderkey as k from (select * from orders where o_totalprice > 200000) where o_orderstatus = 'P'", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'P'")
q("from_subquery_limit", "p_partkey as k from (select * from part order by p_retailprice desc, p_partkey limit 50) where p_size > 20", "SELECT p_partkey AS k FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50) WHERE p_size > 20")
q("from_subquery_nested", "count(*) as n from (select * from (select * from lineitem where l_quantity > 10) where l_quantity < 20)", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20")
q("from_grouped", "k, n from (select o_custkey as k, count(*) as n from orders group by o_custkey) where n > 15", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")

# Several roots
q("multi_root", "n_name as n from (select * from nation where n_regionkey = 1), (select * from nation where n_regionkey = 2)", "SELECT n_name AS n FROM nation WHERE n_regionkey IN (1, 2)")
q("multi_root_group", "c_nationkey as k, count(*) as n from (select * from customer where c_acctbal < 0), (select * from customer where c_acctbal > 5000) group by c_nationkey", "SELECT CAST(c_nationkey AS BIGINT) AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000 GROUP BY 1")
q("braces", "round{avg{c_acctbal}, 3} as v from customer", "SELECT round(avg(c_acctbal) * 1000) / 1000 AS v FROM customer")
q("where_before_from", "c_custkey as k where c_acctbal > 9900 from customer", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9900")


def _run(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine.over(spark, sf_dir, [t for t in TABLES if t in query]).sql(query)

    return run


def _files(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).sql(query.replace("{}", fixture_tree.fixture(spark)))

    return run


def queries() -> dict:
    return {n: _run(query) for n, (query, _) in QUERIES.items()} | {n: _files(query) for n, (query, _) in fixture_tree.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in (QUERIES | fixture_tree.QUERIES).items() if sql}
