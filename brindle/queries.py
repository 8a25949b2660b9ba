"""Registered queries: each runs on whole tables, most beside the same question in the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as fn
from .operators import cn2, compare, discretize, distributions, encode, entropy, explain, foreign_keys, keys, search, similarity
from .plans import sqlgen
from .session import Session
from .streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]

#: Statements that the session runs as they are, and so does the oracle.
SQL: dict[str, str] = {
    "revenue_by_segment": "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY c_mktsegment ORDER BY revenue DESC LIMIT 10",
    # scan, project, filter
    "filter_range": "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1996-06-01' AND l_quantity BETWEEN 10 AND 20",
    "like_ilike": "SELECT p_partkey, p_brand, p_type FROM part WHERE p_type ILIKE '%E%' AND p_brand LIKE 'Brand#%' AND NOT p_name LIKE 'z%'",
    "in_list": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT')",
    "in_subquery": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "distinct_on_first": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "exclude_cols": "SELECT * EXCLUDE (c_acctbal, c_nationkey) FROM customer",
    "replace_cols": "SELECT * REPLACE (upper(n_name) AS n_name) FROM nation",
    "columns_regex": "SELECT COLUMNS('^c_(custkey|name|mkt.*)$') FROM customer WHERE c_acctbal > 0",
    "cte_query": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 500000) SELECT c_name, round(total, 2) AS total FROM big JOIN customer ON c_custkey = o_custkey",
    "recursive_cte": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT CAST(n AS BIGINT) AS n, CAST(n * n AS BIGINT) AS square FROM t",
    "quoted_names": "SELECT n_name AS \"Nation Name\", n_regionkey AS \"Region Key\" FROM nation WHERE n_name <> 'it''s'",
    "sample_rows": "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey FROM orders USING SAMPLE 100 ROWS)",
    # joins
    "inner_join": "SELECT o_orderkey, c_name, o_totalprice FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000",
    "left_join": "SELECT c.c_custkey, CAST(count(o.o_orderkey) AS BIGINT) AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey",
    "right_join": "SELECT n.n_name, CAST(count(s.s_suppkey) AS BIGINT) AS suppliers FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name",
    "full_join": "SELECT c.c_nationkey, s.s_suppkey, c.c_custkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey",
    "cross_join": "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b",
    "natural_join": "SELECT a.n_name, n_regionkey, total FROM nation a NATURAL JOIN (SELECT n_regionkey, CAST(count(*) AS BIGINT) AS total FROM nation GROUP BY n_regionkey) b",
    "semi_exists": "SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
    "anti_not_exists": "SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
    "theta_range_join": "SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    "asof_sql": "SELECT a.event_id, b.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF JOIN (SELECT user_id, min(event_id) AS event_id, ts FROM events WHERE event_type <> 'purchase' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts",
    "star_join_5": "SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    # aggregation
    "groupby_basic": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS least, max(l_tax) AS most FROM lineitem GROUP BY ALL",
    "having": "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "count_distinct": "SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "cube": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rollup": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "median_stddev": "SELECT l_returnflag, median(l_quantity) AS mid, round(stddev(l_quantity), 6) AS sd, round(variance(l_quantity), 6) AS var, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag",
    "mode_value": "SELECT mode(flag) AS flag FROM (SELECT CASE WHEN l_quantity > 10 THEN 'many' ELSE 'few' END AS flag FROM lineitem)",
    "arg_min_max": "SELECT c_nationkey, arg_max(c_custkey, c_acctbal) AS richest, arg_min(c_custkey, c_acctbal) AS poorest FROM customer GROUP BY c_nationkey",
    "string_agg_ordered": "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "array_agg_ordered": "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name), '|') AS names FROM nation GROUP BY n_regionkey",
    "first_last_ordered": "SELECT o_custkey, first(o_orderkey ORDER BY o_orderkey) AS first_key, last(o_orderkey ORDER BY o_orderkey) AS last_key FROM orders GROUP BY o_custkey",
    "filtered_aggregate": "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS finished, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority",
    "pivot_statement": "PIVOT orders ON o_orderstatus IN ('F', 'O', 'P') USING count(*) GROUP BY o_orderpriority",
    "unpivot_statement": "UNPIVOT lineitem ON l_discount, l_tax INTO NAME measure VALUE amount",
    # windows
    "rank_family": "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr FROM customer",
    "lead_lag": "SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders",
    "first_last_frame": "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders",
    "ntile_pct": "SELECT s_suppkey, CAST(ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS INTEGER) AS quarter, round(percent_rank() OVER (ORDER BY s_acctbal, s_suppkey), 9) AS pr, round(cume_dist() OVER (ORDER BY s_acctbal, s_suppkey), 9) AS cd FROM supplier",
    "running_sum_rows": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running FROM orders",
    "range_frame": "SELECT s_suppkey, CAST(count(*) OVER (ORDER BY s_acctbal RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS BIGINT) AS near FROM supplier",
    "qualify_top1": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "qualify_alias": "SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 3",
    # sort and limit
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 30",
    "nulls_last": "SELECT c_custkey, NULLIF(c_nationkey, 3) AS nation FROM customer ORDER BY nation, c_custkey",
    # set operations
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey AS k FROM orders",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    # functions
    "regex_fns": "SELECT c_custkey, regexp_matches(c_name, '[0-9]+1$') AS m, regexp_extract(c_name, '([0-9])([0-9])', 2) AS e, regexp_extract(c_name, '[0-9]+') AS e0, regexp_replace(c_name, '0', 'x') AS r1, regexp_replace(c_name, '0', 'x', 'g') AS rg, regexp_replace(c_name, '(0)([1-9])', '\\2\\1') AS rs, CAST(len(regexp_extract_all(c_name, '[1-9]')) AS BIGINT) AS n, array_to_string(regexp_split_to_array(c_name, '0+'), '|') AS parts FROM customer",
    "string_fns": "SELECT c_custkey, concat(c_name, NULL, '-', c_mktsegment) AS c, concat_ws('/', c_name, c_mktsegment) AS w, CAST(length(c_name) AS BIGINT) AS n, lower(c_name) AS lo, upper(c_name) AS up, trim('  a ') AS t, ltrim('xxa', 'x') AS lt, rtrim('axx', 'x') AS rt, trim('xaxx', 'x') AS tx, substring(c_name, 2, 3) AS s, substring(c_name, -3, 2) AS sn, replace(c_name, '0', '') AS r, split_part(c_mktsegment, 'I', 1) AS sp, string_split(c_mktsegment, 'I')[1] AS ss, reverse(c_mktsegment) AS rev, left(c_name, 3) AS l, left(c_name, -2) AS ln, right(c_name, 2) AS ri, right(c_name, -2) AS rn, repeat('ab', 2) AS rep, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rp, CAST(position('I' IN c_mktsegment) AS BIGINT) AS p, CAST(strpos(c_mktsegment, 'E') AS BIGINT) AS sx, contains(c_mktsegment, 'BU') AS co, starts_with(c_mktsegment, 'A') AS st, ends_with(c_mktsegment, 'E') AS en FROM customer",
    "date_fns": "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, date_part('year', o_orderdate) AS y, date_part('dow', o_orderdate) AS dow, extract(month FROM o_orderdate) AS mo, date_diff('day', DATE '1995-01-15', CAST(o_orderdate AS DATE)) AS dd, date_diff('month', DATE '1995-01-15', CAST(o_orderdate AS DATE)) AS dm, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS nx, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS f, CAST(strptime('2024-02-03', '%Y-%m-%d') AS DATE) AS sp, CAST(epoch(o_orderdate) AS BIGINT) AS ep, CAST(epoch_ms(o_orderdate) AS BIGINT) AS em, make_date(2024, 2, 29) AS md, CAST(year(o_orderdate) AS BIGINT) AS yy, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(week(o_orderdate) AS BIGINT) AS wk FROM orders",
    "math_fns": "SELECT l_orderkey, l_extendedprice, round(l_extendedprice, 1) AS r, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, abs(l_discount - 0.05) AS a, round(power(l_quantity, 2), 4) AS p, round(sqrt(l_quantity), 9) AS s, round(log(l_quantity), 9) AS lg, round(ln(l_quantity), 9) AS ln, round(log2(l_quantity), 9) AS l2, CAST(l_orderkey % 7 AS BIGINT) AS m, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax, NULL) AS le, l_orderkey // 3 AS d, round(l_linenumber / 2, 3) AS h FROM lineitem WHERE l_quantity > 0",
    "conditional_fns": "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'low' ELSE 'debt' END AS k, if(c_nationkey > 10, 1, 0) AS i, coalesce(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS c, ifnull(NULLIF(c_nationkey, 5), -1) AS n FROM customer",
    "cast_fns": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t, o_orderkey::DOUBLE AS d, TRY_CAST(o_orderpriority AS INTEGER) AS bad, TRY_CAST(left(o_orderpriority, 1) AS INTEGER) AS good, CAST(o_orderdate AS DATE) AS dt, CAST('2.5' AS DOUBLE) AS x FROM orders",
    "list_fns": "SELECT l_orderkey, l_linenumber, CAST(len([l_linenumber, 2, 3]) AS BIGINT) AS n, [l_linenumber, 20, 30][2] AS second, list_contains([1, 2, 3], l_linenumber) AS has, CAST(len(list_concat([1, 2], [l_linenumber])) AS BIGINT) AS m, list_element(list_value(l_linenumber, 7), 1) AS e FROM lineitem",
    "unnest_list": "SELECT n_nationkey, unnest([1, 2, n_regionkey]) AS x FROM nation",
    "json_fns": "SELECT event_id, json_extract_string(props, '$.k') AS k, props->>'k' AS k2, CAST(props->>'$.k' AS BIGINT) * 2 AS twice, CAST(json_array_length('[1, 2, 3]') AS BIGINT) AS n FROM events",
    "replace_in_place": "SELECT * REPLACE (upper(n_name) AS n_name, n_nationkey + 1 AS n_nationkey) FROM nation UNION ALL SELECT * FROM nation",
    "array_agg_nulls": "SELECT n_regionkey, CAST(len(array_agg(nullif(n_name, 'CHINA'))) AS BIGINT) AS n, array_to_string(list_transform(list(nullif(n_nationkey, 3) ORDER BY n_name DESC), lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',') AS keys FROM nation GROUP BY n_regionkey",
    "json_types": "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CAST('{\"s\": \"x\", \"a\": [1, \"y\"]}'->'s' AS VARCHAR) AS s, CAST(json_extract('{\"s\": \"x\", \"a\": [1, \"y\"]}', '$.a') AS VARCHAR) AS a FROM events",
    "len_of_text": "SELECT c_custkey, CAST(len(c_mktsegment) AS BIGINT) AS n, CAST(len([c_custkey, 1]) AS BIGINT) AS m FROM customer WHERE len(c_name) > 5",
    "columns_of_join": "SELECT COLUMNS('name$') FROM nation JOIN region ON n_regionkey = r_regionkey",
    "union_by_name_sql": "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL BY NAME SELECT r_name AS name, 'region' AS kind FROM region",
    "typeof_names": "SELECT typeof(o_orderkey) AS k, typeof(o_orderstatus) AS s, typeof(o_totalprice) AS p, typeof([o_orderkey]) AS l, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL",
    "list_lambdas": "SELECT n_nationkey, array_to_string(list_filter([1, 2, 3, 4], lambda x: x > n_regionkey), ',') AS f, array_to_string(list_transform([1, 2], lambda x: x * n_nationkey), ',') AS t FROM nation",
    "json_build": "SELECT n_nationkey, CAST(json_object('key', n_nationkey, 'name', n_name) AS VARCHAR) AS o, CAST(json_array(n_nationkey, n_regionkey) AS VARCHAR) AS a FROM nation",
    "quantile_disc_group": "SELECT o_orderstatus, quantile_disc(o_orderkey, 0.5) AS q, group_concat(DISTINCT left(o_orderpriority, 1), '|' ORDER BY left(o_orderpriority, 1)) AS g FROM orders GROUP BY o_orderstatus",
    "date_adds": "SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), INTERVAL 1 MONTH) AS m FROM orders",
    "asof_left": "SELECT a.event_id, a.ts, b.n FROM events a ASOF LEFT JOIN (SELECT user_id, ts, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts > b.ts",
    "struct_fns": "SELECT l_orderkey, l_linenumber, struct_extract(struct_pack(q := l_quantity, t := l_tax), 'q') AS q, struct_pack(a := l_linenumber, b := 2).b AS b FROM lineitem",
    "series": "SELECT CAST(generate_series AS BIGINT) AS n FROM generate_series(1, 99, 7)",
    "range_fn": "SELECT CAST(\"range\" AS BIGINT) AS n FROM range(3, 40, 4)",
}


def _sql(name: str) -> Query:
    return lambda spark, d: Session.over(spark, d).sql(SQL[name])


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


QUERIES: dict[str, Query] = {name: _sql(name) for name in SQL}
ORACLE_SQL: dict[str, str] = dict(SQL)


def query(oracle: str | None = None):
    """Register a function under its name, with the oracle's SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# -- sources, statements ------------------------------------------------------------
@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def read_parquet_fn(spark, d):
    return Session(spark).sql(f"SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM read_parquet('{d}/orders.parquet') GROUP BY o_orderstatus")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'x' || n_name ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 10 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100, 'NEW', 9 UNION ALL SELECT n_nationkey + 200, n_name, n_regionkey FROM nation WHERE n_regionkey = 3")
def dml_statements(spark, d):
    s = Session.over(spark, d)
    script = """CREATE TABLE mine AS SELECT * FROM nation; DELETE FROM mine WHERE n_regionkey = 2;
    UPDATE mine SET n_regionkey = 10, n_name = concat('x', n_name) WHERE n_regionkey = 1;
    INSERT INTO mine VALUES (100, 'NEW', 9); INSERT INTO mine (n_nationkey, n_name, n_regionkey) SELECT n_nationkey + 200, n_name, n_regionkey FROM nation WHERE n_regionkey = 3"""
    for r in s.run_all(script):
        if r.error:
            raise r.error
    return s.sql("SELECT * FROM mine")


@query("SELECT n_nationkey AS nation_key, n_regionkey, 1 AS weight FROM nation")
def ddl_statements(spark, d):
    s = Session.over(spark, d)
    for text in ("CREATE OR REPLACE TABLE shape AS SELECT * FROM nation", "ALTER TABLE shape RENAME COLUMN n_nationkey TO nation_key", "ALTER TABLE shape DROP COLUMN n_name", "ALTER TABLE shape ADD COLUMN weight INTEGER DEFAULT 1"):
        s.sql(text)
    return s.sql("SELECT * FROM shape")


@query("SELECT 'customer' AS table_name, CAST(count(*) AS BIGINT) AS n FROM customer")
def run_script(spark, d):
    s = Session.over(spark, d)
    return s.run_all("-- a comment; with a semicolon\nSELECT ';' AS x; /* another; */ SELECT 'customer' AS table_name, CAST(count(*) AS BIGINT) AS n FROM customer;")[-1].df


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND regexp_matches(lower(c_name), '9$')")
def value_filter(spark, d):
    df = _t(spark, d, "customer")
    return search.text_filters(search.value_filter(df, {"c_mktsegment": ["BUILDING", "MACHINERY"]}), {"c_name": "9$"}).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(CAST(c_custkey AS VARCHAR)), 'build') OR contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')")
def search_rows(spark, d):
    return search.search(_t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "BuilD")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE regexp_matches(CAST(o_orderkey AS VARCHAR), '(?i)^[0-9]-h') OR regexp_matches(o_orderstatus, '(?i)^[0-9]-h') OR regexp_matches(o_orderpriority, '(?i)^[0-9]-h')")
def search_regex(spark, d):
    return search.search(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), r"^\d-H", regex=True)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE contains(lower(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus)), '7|f')")
def search_joined(spark, d):
    return search.search_joined(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "7|F")


@query("SELECT s_suppkey, round((s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / (SELECT max(s_acctbal) - min(s_acctbal) FROM supplier), 9) AS bar FROM supplier")
def bar_scale(spark, d):
    return search.normalise(_t(spark, d, "supplier"), "s_acctbal").select("s_suppkey", F.round("bar", 9).alias("bar"))


# -- generators -----------------------------------------------------------------------
_NAMED = {"customers": ("customer", "c_custkey AS id, c_name AS name, c_nationkey AS nation_id"), "nations": ("nation", "n_nationkey AS id, n_name AS name"), "purchases": ("orders", "o_orderkey AS purchase, o_custkey AS customer_id, o_totalprice AS total")}


def _named(spark, d):
    return {n: _t(spark, d, t).selectExpr(*e.split(", ")) for n, (t, e) in _NAMED.items()}


@query("SELECT o.o_orderkey AS purchases_purchase, o.o_custkey AS purchases_customer_id, o.o_totalprice AS purchases_total, c.c_custkey AS customers_id, c.c_name AS customers_name, c.c_nationkey AS customers_nation_id, n.n_nationkey AS nations_id, n.n_name AS nations_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
def inner_join_gen(spark, d):
    t = _named(spark, d)
    return sqlgen.join_tables({k: t[k] for k in ("purchases", "customers", "nations")})


@query("SELECT c.c_custkey AS customers_id, c.c_name AS customers_name, c.c_nationkey AS customers_nation_id, o.o_orderkey AS purchases_purchase, o.o_custkey AS purchases_customer_id, o.o_totalprice AS purchases_total FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey")
def left_join_gen(spark, d):
    t = _named(spark, d)
    s = Session(spark)
    names = {k: s.catalog.register(t[k], k) for k in ("customers", "purchases")}
    return s.sql(sqlgen.join_sql({n: t[k].columns for k, n in names.items()}, "LEFT"))


@query("SELECT c_nationkey AS nation, c_custkey AS id FROM customer UNION SELECT s_nationkey AS nation, s_suppkey AS id FROM supplier")
def set_op_gen(spark, d):
    a = _t(spark, d, "customer").selectExpr("c_nationkey AS nation", "c_custkey AS id", "c_name")
    b = _t(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS nation", "s_acctbal")
    return sqlgen.set_tables({"a": a, "b": b}, "UNION")


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS count FROM customer WHERE c_nationkey = 3 GROUP BY c_mktsegment")
def column_snippet(spark, d):
    s = Session.over(spark, d)
    return s.sql(sqlgen.where_equals("c_nationkey", 3, sqlgen.value_counts("c_mktsegment", "customer")))


@query("SELECT event_id, user_id, before_id FROM (SELECT a.event_id, a.user_id, b.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, min(event_id) AS event_id, ts FROM events WHERE event_type <> 'purchase' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts)")
def asof_events(spark, d):
    e = _t(spark, d, "events")
    right = e.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.min("event_id").alias("before_id"))
    return sqlgen.asof_join(e.where("event_type = 'purchase'"), right, "ts", ["user_id"]).select("event_id", "user_id", "before_id")


# -- profiling ------------------------------------------------------------------------
def _entropy_sql(table: str, binned: list[str], plain: list[str]) -> str:
    parts = [f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS b FROM {table} WHERE {c} IS NOT NULL" for c in plain]
    parts += [f"SELECT '{c}' AS c, CAST(greatest(1, least(10, ceil(({c} - lo) * 10 / (hi - lo)))) AS VARCHAR) AS b FROM {table}, (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM {table}) WHERE {c} IS NOT NULL" for c in binned]
    return f"WITH cells AS ({' UNION ALL '.join(parts)}), n AS (SELECT c, b, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY c, b), e AS (SELECT c, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM n GROUP BY c) SELECT c AS \"column\", round(h, 6) AS entropy, round(h / (SELECT max(h) FROM e), 6) AS normalized_entropy, CASE WHEN h / (SELECT max(h) FROM e) >= 0.8 THEN 'High' WHEN h / (SELECT max(h) FROM e) >= 0.5 THEN 'Medium' WHEN h / (SELECT max(h) FROM e) >= 0.3 THEN 'Low' ELSE 'Very Low' END AS importance FROM e"


@query(_entropy_sql("lineitem", ["l_partkey", "l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus", "l_linenumber"]))
def entropy_profile(spark, d):
    df = _t(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_linenumber")
    return entropy.profile(df).withColumns({c: F.round(c, 6) for c in ("entropy", "normalized_entropy")})


def _stats_sql(table: str, cols: list[str]) -> str:
    one = lambda c: f"SELECT '{c}' AS \"column\", 'numeric' AS type, CAST(count(*) AS BIGINT) AS \"rows\", CAST(count(*) - count({c}) AS BIGINT) AS missing, CAST(count(DISTINCT {c}) AS BIGINT) AS \"distinct\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, median(CAST({c} AS DOUBLE)) AS median, round(stddev({c}), 4) AS std, round(avg(power({c} - m, 3)) / power(stddev_pop({c}), 3), 4) AS skewness, round(avg(power({c} - m, 4)) / power(stddev_pop({c}), 4) - 3, 4) AS kurtosis FROM {table}, (SELECT avg({c}) AS m FROM {table})"
    return " UNION ALL ".join(map(one, cols))


@query(_stats_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def distribution_stats(spark, d):
    df = distributions.column_stats(_t(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"))
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "std", "skewness", "kurtosis")})


@query("SELECT c_mktsegment AS value, CAST(count(*) AS BIGINT) AS count FROM customer GROUP BY c_mktsegment ORDER BY count DESC, value LIMIT 3")
def top_values(spark, d):
    return distributions.top_values(_t(spark, d, "customer"), "c_mktsegment", 3)


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 12)), 11) AS INTEGER) AS bin FROM lineitem, e) SELECT bin, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY bin")
def histogram(spark, d):
    return distributions.histogram(_t(spark, d, "lineitem"), "l_extendedprice", 12).where("count > 0").select("bin", "count")


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) SELECT round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3, CAST(count(*) FILTER (WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers FROM orders, q")
def box_plot(spark, d):
    return distributions.box_plot(_t(spark, d, "orders"), "o_totalprice").select(*(F.round(c, 4).alias(c) for c in ("q1", "median", "q3")), "outliers")


@query("SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS value, round(cume_dist() OVER (ORDER BY l_quantity), 9) AS share FROM lineitem")
def ecdf(spark, d):
    return distributions.ecdf(_t(spark, d, "lineitem"), "l_quantity").select("value", F.round("share", 9).alias("share"))


@query()
def distribution_fit(spark, d):
    return distributions.fit_distributions(_t(spark, d, "lineitem"), "l_extendedprice")


def _keys_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"columns\", CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, round(100.0 * count(DISTINCT {c}) / count(*), 4) AS uniqueness, CASE WHEN count(DISTINCT {c}) = count(*) THEN 'Candidate Key' ELSE '' END AS key_type FROM {table}" for c in cols)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.array_join("columns", ",").alias("columns"), "unique_count", F.round("uniqueness", 4).alias("uniqueness"), "key_type")


@query(_keys_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def keys_single(spark, d):
    return _flat(keys.candidate_keys(_t(spark, d, "customer"), 1))


@query("SELECT 'l_orderkey' AS \"columns\", CAST(count(DISTINCT l_orderkey) AS BIGINT) AS unique_count FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(count(DISTINCT l_linenumber) AS BIGINT) FROM lineitem UNION ALL SELECT 'l_partkey', CAST(count(DISTINCT l_partkey) AS BIGINT) FROM lineitem UNION ALL SELECT 'l_orderkey,l_linenumber', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) UNION ALL SELECT 'l_orderkey,l_partkey', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'l_linenumber,l_partkey', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT l_linenumber, l_partkey FROM lineitem)")
def keys_pair(spark, d):
    return _flat(keys.candidate_keys(_t(spark, d, "lineitem"), 2, ["l_orderkey", "l_linenumber", "l_partkey"])).select("columns", "unique_count")


def _superkeys_sql(table: str, cols: list[str]) -> str:
    """Sets of one and two columns without repeated rows; those that hold a smaller one are superkeys."""
    unique = lambda cs: f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(cs)} FROM {table})) = (SELECT count(*) FROM {table})"
    parts = [f"SELECT '{c}' AS \"columns\", 'Candidate Key' AS key_type WHERE {unique([c])}" for c in cols]
    parts += [f"SELECT '{a},{b}', CASE WHEN ({unique([a])}) OR ({unique([b])}) THEN 'Superkey' ELSE 'Candidate Key' END WHERE {unique([a, b])}" for a, b in combinations(cols, 2)]
    return " UNION ALL ".join(parts)


@query(_superkeys_sql("nation", ["n_nationkey", "n_name", "n_regionkey"]))
def superkeys(spark, d):
    found = _flat(keys.candidate_keys(_t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), 2, superkeys=True))
    return found.where("key_type <> ''").select("columns", "key_type")


_GEO = "(SELECT c_custkey, c_nationkey, n_name, n_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_GEO_COLUMNS = ["c_nationkey", "n_name", "n_regionkey", "r_name"]


def _geo(spark, d):
    c, n, r = (_t(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", *_GEO_COLUMNS)


@query(" UNION ALL ".join(f"SELECT '{a}' AS determinant, '{b}' AS dependent WHERE (SELECT max(k) FROM (SELECT count(DISTINCT {b}) AS k FROM {_GEO} GROUP BY {a})) <= 1" for a, b in permutations(_GEO_COLUMNS, 2)))
def fds_lhs1(spark, d):
    fds = keys.functional_dependencies(_geo(spark, d), 1)
    return fds.where("determinant[0] <> 'c_custkey'").select(F.col("determinant")[0].alias("determinant"), "dependent")


@query("SELECT 1 AS position, 'c_nationkey,n_name,n_regionkey,r_name' AS \"columns\" UNION ALL SELECT 2, 'n_name,c_nationkey,n_regionkey,r_name' UNION ALL SELECT 3, 'n_regionkey,r_name' UNION ALL SELECT 4, 'r_name,n_regionkey' UNION ALL SELECT 5, 'c_custkey'")
def normalize_3nf(spark, d):
    found = keys.profile(_geo(spark, d), 1, 1)["tables"]
    return spark.createDataFrame([(i, ",".join(t["columns"])) for i, t in enumerate(found, 1)], "position int, columns string")


#: Columns of the tables under names that meet every rule for names.
_FK_COLUMNS = {
    "customer": {"customer_id": "c_custkey", "nation_id": "c_nationkey"},
    "nation": {"nation_key": "n_nationkey", "sub_region_id": "n_regionkey"},
    "orders": {"order_id": "o_orderkey", "customer_id": "o_custkey"},
    "region": {"region_code": "r_regionkey"},
    "supplier": {"supplier_id": "s_suppkey", "nation": "s_nationkey"},
}
#: What the rules say of these names, typed in: similarities (other pairs 0; those of 0.5 and less add nothing), and which look like identifiers.
_FK_SIMILAR = {("customer_id", "customer_id"): 1.0, ("nation_id", "nation_key"): 0.9, ("nation_key", "nation_id"): 0.9, ("nation", "nation_key"): 0.8, ("nation", "nation_id"): 0.8, ("sub_region_id", "region_code"): 0.6, ("region_code", "sub_region_id"): 0.6}
_FK_ID_LIKE = {"customer_id", "nation_id", "nation_key", "sub_region_id", "order_id", "region_code", "supplier_id"}


def _fk_sql(threshold: float, least: float, unique: bool, penalty: float) -> str:
    """Each pair of columns as one SELECT. No name holds a word that rules it out."""
    parts = []
    for ft, pt in permutations(_FK_COLUMNS, 2):
        for f, fk in _FK_COLUMNS[ft].items():
            for p, pk in _FK_COLUMNS[pt].items():
                if p not in _FK_ID_LIKE:
                    continue
                bonus = 0.3 * _FK_SIMILAR.get((f, p), 0.0) + 0.1 * (f in _FK_ID_LIKE)
                must = "AND pd = pn AND pv = pn" if unique else ""
                score = f"m / fd + {bonus} - CASE WHEN fd / fn > 0.5 THEN {penalty} ELSE 0 END"
                parts.append(f"SELECT '{ft}' AS fk_table, '{f}' AS fk_column, '{pt}' AS pk_table, '{p}' AS pk_column, round(m / fd, 6) AS match_ratio, round({score}, 6) AS score, CAST(fd AS BIGINT) AS distinct_values FROM (SELECT CAST(count(DISTINCT {fk}) AS DOUBLE) AS fd, count(*) AS fn FROM {ft}), (SELECT count(DISTINCT {pk}) AS pd, count({pk}) AS pv, count(*) AS pn FROM {pt}), (SELECT count(*) AS m FROM (SELECT DISTINCT {fk} AS v FROM {ft}) WHERE v IN (SELECT {pk} FROM {pt})) WHERE fd > 0 AND fd <= pd {must} AND m / fd >= {least} AND {score} >= {threshold}")
    return " UNION ALL ".join(parts)


def _fk_input(spark, d):
    return {t: _t(spark, d, t).select(*(F.col(old).alias(new) for new, old in names.items())) for t, names in _FK_COLUMNS.items()}


@query(_fk_sql(0.95, 0.9, True, 0.2))
def fk_candidates(spark, d):
    return foreign_keys.find_foreign_keys(_fk_input(spark, d)).select("fk_table", "fk_column", "pk_table", "pk_column", F.round("match_ratio", 6).alias("match_ratio"), F.round("score", 6).alias("score"), "distinct_values")


@query(_fk_sql(0.76, 0.85, False, 0.0))
def inclusion_deps(spark, d):
    return foreign_keys.find_inclusion_dependencies(_fk_input(spark, d), 0.76).select("fk_table", "fk_column", "pk_table", "pk_column", F.round("match_ratio", 6).alias("match_ratio"), F.round("score", 6).alias("score"), "distinct_values")


@query("SELECT CAST(count(*) AS BIGINT) AS fk_rows, CAST(count(DISTINCT o_custkey) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)) AS BIGINT) AS violations, CAST(count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)) AS BIGINT) AS violating_rows FROM orders")
def ref_integrity(spark, d):
    parent = _t(spark, d, "customer").where("c_custkey % 3 <> 0")
    return foreign_keys.referential_integrity(_t(spark, d, "orders"), "o_custkey", parent, "c_custkey").select("fk_rows", "violations", "violating_rows")


# -- comparison -----------------------------------------------------------------------
_LEFT = "(SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 3)"
_RIGHT = "(SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 25 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 7)"


def _compared(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    left = c.where("c_custkey % 10 <> 3")
    right = c.where("c_custkey % 10 <> 7").selectExpr("c_custkey", "IF(c_custkey % 4 = 0, c_acctbal + 1, c_acctbal) AS c_acctbal", "IF(c_custkey % 25 = 0, NULL, c_mktsegment) AS c_mktsegment")
    return compare.compare([left, right], ["a", "b"], ["c_custkey"])


@query(f"SELECT CASE WHEN a.c_custkey IS NULL THEN 'b_only' WHEN b.c_custkey IS NULL THEN 'a_only' ELSE 'all' END AS indicator, CAST(count(*) AS BIGINT) AS \"rows\" FROM {_LEFT} a FULL JOIN {_RIGHT} b ON a.c_custkey = b.c_custkey GROUP BY 1")
def compare_indicator(spark, d):
    return _compared(spark, d).summary().select("indicator", "rows")


@query(f"SELECT 'c_acctbal' AS \"column\", CAST(count(*) FILTER (WHERE abs(a.c_acctbal - b.c_acctbal) > 1e-10) AS BIGINT) AS different FROM {_LEFT} a JOIN {_RIGHT} b ON a.c_custkey = b.c_custkey UNION ALL SELECT 'c_mktsegment', CAST(count(*) FILTER (WHERE a.c_mktsegment IS DISTINCT FROM b.c_mktsegment) AS BIGINT) FROM {_LEFT} a JOIN {_RIGHT} b ON a.c_custkey = b.c_custkey")
def compare_cell_diff(spark, d):
    return _compared(spark, d).cell_differences()


@query(f"SELECT a.c_custkey, CAST(CAST(abs(a.c_acctbal - b.c_acctbal) > 1e-10 AS INTEGER) + CAST(a.c_mktsegment IS DISTINCT FROM b.c_mktsegment AS INTEGER) AS INTEGER) AS cells FROM {_LEFT} a JOIN {_RIGHT} b ON a.c_custkey = b.c_custkey WHERE abs(a.c_acctbal - b.c_acctbal) > 1e-10 OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment")
def compare_row_diff(spark, d):
    return _compared(spark, d).row_differences().select("c_custkey", F.size("differences").alias("cells"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(a) AS BIGINT) AS left_rows, CAST(count(b) AS BIGINT) AS right_rows FROM (SELECT NULLIF(n_regionkey, 2) AS k, 1 AS a FROM nation) x FULL JOIN (SELECT NULLIF(r_regionkey, 2) AS k, 1 AS b FROM region WHERE r_regionkey <> 4) y ON x.k IS NOT DISTINCT FROM y.k")
def full_outer_nullsafe(spark, d):
    a = _t(spark, d, "nation").selectExpr("NULLIF(n_regionkey, 2) AS k", "1 AS a")
    b = _t(spark, d, "region").where("r_regionkey <> 4").selectExpr("NULLIF(r_regionkey, 2) AS k", "1 AS b")
    return compare.compare([a, b], ["x", "y"], ["k"]).merged.agg(F.count("*").alias("n"), F.count("a_x").alias("left_rows"), F.count("b_y").alias("right_rows"))


# -- similarity, association -------------------------------------------------------------
@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal, round((c_nationkey - mn) / sn, 6) AS c_nationkey FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn FROM customer)")
def zscores(spark, d):
    return similarity.zscores(_t(spark, d, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"), F.round("c_nationkey", 6).alias("c_nationkey"))


@query("WITH r AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, (l_quantity + l_discount + l_tax) / 3 AS m FROM lineitem), s AS (SELECT a, b, c, m, sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 3) AS s FROM r) SELECT 'l_quantity' AS column_1, 'l_discount' AS column_2, round(sqrt(sum(power((a - b) / s, 2))), 4) AS distance FROM s WHERE s > 0 UNION ALL SELECT 'l_quantity', 'l_tax', round(sqrt(sum(power((a - c) / s, 2))), 4) FROM s WHERE s > 0 UNION ALL SELECT 'l_discount', 'l_tax', round(sqrt(sum(power((b - c) / s, 2))), 4) FROM s WHERE s > 0")
def col_distance(spark, d):
    return similarity.column_distances(_t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("distance", F.round("distance", 4))


_Z = "(SELECT s_suppkey AS k, (s_acctbal - m) / s AS a, (s_nationkey - mn) / sn AS b FROM supplier, (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s, avg(s_nationkey) AS mn, stddev_pop(s_nationkey) AS sn FROM supplier))"


@query(f"SELECT x.k AS row_1, y.k AS row_2, round(sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2)), 6) AS distance FROM {_Z} x JOIN {_Z} y ON x.k < y.k ORDER BY sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2)) DESC, 1, 2 LIMIT 5")
def row_distance_far5(spark, d):
    return similarity.row_pairs(_t(spark, d, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"], farthest=True).withColumn("distance", F.round("distance", 6))


@query(f"SELECT x.k AS row_1, y.k AS row_2, round(sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2)), 6) AS distance FROM {_Z} x JOIN {_Z} y ON x.k < y.k ORDER BY sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2)), 1, 2 LIMIT 5")
def row_distance_top5(spark, d):
    return similarity.row_pairs(_t(spark, d, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"]).withColumn("distance", F.round("distance", 6))


@query(f"SELECT k AS s_suppkey, round(abs(a) + abs(b), 6) AS score FROM {_Z}")
def unusual_rows(spark, d):
    return similarity.unusual_rows(_t(spark, d, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"]).select("s_suppkey", F.round("score", 6).alias("score"))


@query("SELECT 1 AS component, round((1 + abs(r)) / 2, 6) AS explained FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) UNION ALL SELECT 2, round((1 - abs(r)) / 2, 6) FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)")
def pca_variance(spark, d):
    return similarity.pca(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 2)["variance"].select("component", F.round("explained", 6).alias("explained"))


@query()
def embedding_clusters(spark, d):
    return similarity.embedding_clusters(_t(spark, d, "embeddings"), "vec_id", "embedding", 4)


@query("SELECT round(abs(corr(l_quantity, l_extendedprice)), 6) AS association FROM lineitem")
def pearson_assoc(spark, d):
    return explain.association(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("association", 6).alias("association"))


@query("WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS o FROM lineitem GROUP BY 1, 2), m AS (SELECT a, b, o, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS rb, sum(o) OVER () AS n FROM c) SELECT round(sqrt(greatest(sum(o * o / (ra * rb)) - 1, 0) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS association FROM m")
def cramers_v(spark, d):
    return explain.association(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("association", 6).alias("association"))


@query("SELECT round(abs(corr(code, l_quantity)), 6) AS association FROM (SELECT dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code, l_quantity FROM lineitem)")
def mixed_assoc(spark, d):
    return explain.association(_t(spark, d, "lineitem"), "l_returnflag", "l_quantity").select(F.round("association", 6).alias("association"))


@query()
def rf_importance(spark, d):
    return explain.explain(_t(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"), "l_extendedprice")


@query("SELECT c_mktsegment AS value, CAST(count(*) AS BIGINT) AS count, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment")
def explain_drill_down(spark, d):
    return explain.drill_down(_t(spark, d, "customer"), "c_mktsegment", "c_acctbal").select("value", "count", F.round("mean", 4).alias("mean"))


# -- encoding ---------------------------------------------------------------------------
@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS is_f, CAST(o_orderstatus = 'O' AS INTEGER) AS is_o, CAST(o_orderstatus = 'P' AS INTEGER) AS is_p FROM orders")
def onehot_categorical(spark, d):
    return encode.one_hot(_t(spark, d, "orders"), "o_orderstatus").select("o_orderkey", "is_f", "is_o", "is_p")


_STOP = ", ".join(f"'{w}'" for w in encode.STOPWORDS)


@query(f"SELECT word, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE word NOT IN ({_STOP}) GROUP BY word ORDER BY count DESC, word LIMIT 10")
def text_top_words(spark, d):
    return encode.top_words(_t(spark, d, "documents"), "text")


@query(f"WITH w AS (SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE word NOT IN ({_STOP}) GROUP BY word ORDER BY count(*) DESC, word LIMIT 10) SELECT 'has_' || word AS feature, round(100.0 * (SELECT count(*) FROM documents WHERE contains(lower(text), word)) / (SELECT count(*) FROM documents), 6) AS coverage FROM w")
def text_top10_flags(spark, d):
    flags = encode.text_flags(_t(spark, d, "documents"), "text")
    return encode.coverage(flags, [c for c in flags.columns if c.startswith("has_")]).withColumn("coverage", F.round("coverage", 6))


@query("SELECT 'is_f' AS feature, round(corr(o_totalprice, CAST(o_orderstatus = 'F' AS DOUBLE)), 6) AS correlation FROM (SELECT CAST(o_custkey % 5 AS DOUBLE) AS o_totalprice, o_orderstatus FROM orders) UNION ALL SELECT 'is_o', round(corr(o_totalprice, CAST(o_orderstatus = 'O' AS DOUBLE)), 6) FROM (SELECT CAST(o_custkey % 5 AS DOUBLE) AS o_totalprice, o_orderstatus FROM orders) UNION ALL SELECT 'is_p', round(corr(o_totalprice, CAST(o_orderstatus = 'P' AS DOUBLE)), 6) FROM (SELECT CAST(o_custkey % 5 AS DOUBLE) AS o_totalprice, o_orderstatus FROM orders)")
def related_onehot(spark, d):
    df = _t(spark, d, "orders").selectExpr("o_custkey % 5 AS target", "o_orderstatus")
    return encode.related(df, "target").select("feature", F.round("correlation", 6).alias("correlation"))


@query("SELECT CASE WHEN c_mktsegment IN (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_mktsegment LIMIT 2) THEN c_mktsegment ELSE 'Other' END AS c_mktsegment_grouped, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def group_top_n(spark, d):
    return discretize.group_categories(_t(spark, d, "customer"), "c_mktsegment", top_n=2).groupBy("c_mktsegment_grouped").agg(F.count("*").alias("n"))


def _bins(spark, d, method: str, n: int | None) -> DataFrame:
    df = _t(spark, d, "lineitem")
    m = discretize.Discretizer(method, n).fit(df, "l_extendedprice")
    at = F.lit(0)
    for e in m.edges:
        at = at + (F.col("l_extendedprice") >= F.lit(e)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def _width_sql(k: str) -> str:
    return f"WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, {k} AS k FROM lineitem), c AS (SELECT i, lo + (hi - lo) * i / k AS edge FROM e, (SELECT unnest(range(1, 10)) AS i) WHERE i < k) SELECT CAST(b AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT (SELECT count(*) FROM c WHERE l_extendedprice >= edge) AS b FROM lineitem) GROUP BY b"


@query(_width_sql("4"))
def bin_equal_width(spark, d):
    return _bins(spark, d, "equal_width", 4)


@query(_width_sql("least(10, ceil(1 + log2(count(*))))"))
def bin_sturges(spark, d):
    return _bins(spark, d, "sturges", None)


@query(_width_sql("least(10, ceil((max(l_extendedprice) - min(l_extendedprice)) / (2 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) * power(count(*), -1.0 / 3))))"))
def bin_freedman_diaconis(spark, d):
    return _bins(spark, d, "freedman_diaconis", None)


@query("WITH c AS (SELECT unnest(quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8])) AS edge FROM lineitem) SELECT CAST(b AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT (SELECT count(*) FROM c WHERE l_extendedprice >= edge) AS b FROM lineitem) GROUP BY b")
def bin_quantile(spark, d):
    return _bins(spark, d, "quantile", 5)


@query()
def bin_jenks(spark, d):
    return _bins(spark, d, "jenks", 4)


@query()
def lda_topics(spark, d):
    topics = encode.topics_lda(_t(spark, d, "documents"), "text", 4)
    return spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(topics)], "topic int, words string")


def _domain_sql(domain: str) -> str:
    r"""\b of the operator knows letters beyond ASCII, that of the oracle's engine does not."""
    return f"SELECT '{domain}' AS domain, CAST(count(*) FILTER (WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(encode.DOMAINS[domain])})([^\\p{{L}}\\p{{N}}_]|$)')) AS BIGINT) AS \"rows\" FROM documents"


@query(" UNION ALL ".join(map(_domain_sql, encode.DOMAINS)))
def domain_flags(spark, d):
    return encode.domain_counts(_t(spark, d, "documents"), "text")


_NGRAMS_SQL = f"""WITH d AS (SELECT list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: len(x) >= 3 AND NOT list_contains([{', '.join(f"'{w}'" for w in encode.STOPWORDS)}], x)) AS w FROM benchmark),
r AS (SELECT row_number() OVER () AS r, w FROM d),
g AS (SELECT r, unnest(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS ngram FROM r),
s AS (SELECT ngram, count(*) AS tf, count(DISTINCT r) AS df FROM g GROUP BY ngram HAVING count(DISTINCT r) >= 2)
SELECT ngram, round(tf * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1), 6) AS score FROM s ORDER BY tf * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) DESC, ngram LIMIT 15"""


@query(_NGRAMS_SQL)
def key_ngrams(spark, d):
    return encode.key_ngrams(_t(spark, d, "benchmark"), "text").withColumn("score", F.round("score", 6))


# -- rules --------------------------------------------------------------------------------
@query("SELECT CASE WHEN l_quantity > 25.0 AND l_returnflag = 'R' THEN 'big return' WHEN l_discount <= 0.03 THEN 'list price' ELSE 'other' END AS prediction, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def cn2_predict(spark, d):
    C, R = cn2.Condition, cn2.Rule
    model = cn2.CN2(rules=[R([C("l_quantity", ">", 25.0), C("l_returnflag", "==", "R")], "big return", 1, 1.0, 1.0, {}), R([C("l_discount", "<=", 0.03)], "list price", 1, 1.0, 1.0, {})], classes=["big return", "list price", "other"], default="other")
    return model.predict(_t(spark, d, "lineitem")).groupBy("prediction").agg(F.count("*").alias("n"))


@query("SELECT 'IF flag == R THEN returned' AS rule, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS coverage, 1.0::DOUBLE AS accuracy FROM lineitem")
def cn2_first_rule(spark, d):
    df = _t(spark, d, "lineitem").selectExpr("l_returnflag AS flag", "l_linestatus AS status", "IF(l_returnflag = 'R', 'returned', 'kept') AS target")
    model = cn2.CN2(max_rules=3, max_length=1).fit(df, "target")
    return model.rules_table(spark).where("prediction = 'returned'").select("rule", "coverage", "accuracy")


@query()
def cn2_discover(spark, d):
    df = _t(spark, d, "orders").selectExpr("o_totalprice", "o_orderpriority", "o_custkey % 3 AS third", "IF(o_totalprice > 150000 AND o_orderpriority < '3', 'rush', 'wait') AS speed")
    return cn2.discover_rules(df, "speed", max_rules=4, max_length=2).rules_table(spark)


# -- functions as columns, streams -----------------------------------------------------------
@query("SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS whole, date_diff('month', TIMESTAMP '1995-01-31', o_orderdate) AS months, CAST(date_part('dow', o_orderdate) AS INTEGER) AS dow, left(o_orderpriority, -2) AS l, regexp_replace(o_orderpriority, '[A-Z]', '*') AS r, strftime(o_orderdate, '%Y-%m') AS f FROM orders")
def dialect_functions(spark, d):
    df = _t(spark, d, "orders")
    return df.select("o_orderkey", fn.to_int("o_totalprice", "long").alias("whole"), fn.date_diff("month", F.lit("1995-01-31").cast("timestamp_ntz"), "o_orderdate").alias("months"), fn.day_of_week("o_orderdate").alias("dow"), fn.left("o_orderpriority", -2).alias("l"), fn.regexp_replace("o_orderpriority", "[A-Z]", "*").alias("r"), fn.strftime("o_orderdate", "%Y-%m").alias("f"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return stream.windowed(_t(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, CAST(count(*) AS BIGINT) AS events FROM s GROUP BY user_id, k")
def event_sessions(spark, d):
    return stream.sessions(_t(spark, d, "events"), "6 hours").select("user_id", "session_start", "events")
