"""Statements beside the oracle's engine: columns in order, rows in order."""

import duckdb
import pytest
from brindle.plans.dialect import Unsupported
from brindle.session import Session

TABLES = [
    "CREATE TABLE t AS SELECT * FROM (VALUES (1, 'a', 2.5, NULL), (2, NULL, 1.5, 'x'), (2, 'ccc', NULL, 'yy')) v(k, s, d, e)",
    "CREATE TABLE u AS SELECT * FROM (VALUES (1, 10), (2, 20)) v(k, w)",
    """CREATE TABLE j AS SELECT * FROM (VALUES (1, '{"a": "x", "b": [1, "q"], "c": {"z": 1, "y": 2.50}, "n": null, "t": true}')) v(i, p)""",
]
STATEMENTS = [
    "SELECT * REPLACE (k + 1 AS k) FROM t ORDER BY 1, 2",
    "SELECT * EXCLUDE (e) REPLACE (upper(s) AS s) FROM t ORDER BY 1, 2",
    "SELECT t.* REPLACE (k * 2 AS k), w FROM t JOIN u USING (k) ORDER BY 1, 2",
    "WITH q AS (SELECT k, s FROM t) SELECT * REPLACE (coalesce(s, '-') AS s) FROM q ORDER BY 1, 2",
    "SELECT k, array_agg(s ORDER BY d DESC) AS l FROM t GROUP BY k ORDER BY k",
    "SELECT k, list(s ORDER BY s) AS l FROM t GROUP BY k ORDER BY k",
    "SELECT list(DISTINCT k ORDER BY k DESC) AS l FROM t",
    "SELECT array_agg(s) FILTER (WHERE k = 1) AS l, list(k) FILTER (WHERE k > 9) AS m FROM t",
    "SELECT len(s) AS a, len([1, 2, k]) AS b, len('abc') AS c FROM t ORDER BY 1, 2",
    "SELECT k FROM t WHERE len(s) > 1",
    "SELECT json_extract(p, '$.a') AS a, p->'b' AS b, p->>'a' AS c, json_extract(p, 'c') AS d, p->'$.b[1]' AS e, json_extract(p, '$.n') AS n, json_extract(p, '$.no') AS o, p->'t' AS t, json_extract_string(p, '$.b[1]') AS f FROM j",
    "SELECT COLUMNS('^[kw]$') FROM t JOIN u USING (k) ORDER BY 1, 2",
    "SELECT COLUMNS('s|w') FROM t, u WHERE t.k = u.k ORDER BY 1, 2",
    "SELECT k, s FROM t UNION ALL BY NAME SELECT w, k FROM u ORDER BY 1, 2, 3",
    "SELECT k FROM t UNION BY NAME SELECT k FROM u ORDER BY 1",
    "SELECT typeof(k) AS a, typeof(s) AS b, typeof([k]) AS c, typeof(k = 1) AS d, typeof(DATE '2020-01-01') AS f FROM t LIMIT 1",
    "SELECT a.k, b.w FROM t a ASOF JOIN u b ON a.k = b.k AND a.d * 10 >= b.w ORDER BY 1, 2",
    "SELECT a.k, a.s, b.w FROM t a ASOF LEFT JOIN u b ON a.k = b.k AND a.d >= b.w ORDER BY 1, 2",
    "SELECT * FROM t a ASOF JOIN u b ON a.k = b.k AND a.k <= b.w ORDER BY 1, 2",
    "SELECT t.k, u.w FROM t ASOF JOIN u ON t.k = u.k AND u.w >= t.k ORDER BY 1, 2",
    "SELECT list_filter([1, 2, 3], lambda x: x > k) AS f, list_transform([1, 2], lambda x: x * k) AS g FROM t ORDER BY k, s",
    "SELECT CAST(quantile_disc(d, 0.5) AS DOUBLE) AS q, group_concat(s, '|' ORDER BY s) AS g, json_object('a', 1) AS o, json_array(1, 2) AS r, date_add(DATE '2020-01-31', INTERVAL 1 DAY) AS dd FROM t",
]


@pytest.fixture(scope="module")
def engines(spark):
    s, c = Session(spark), duckdb.connect()
    for t in TABLES:
        s.sql(t)
        c.execute(t)
    return s, c


@pytest.mark.parametrize("sql", STATEMENTS)
def test_statement(engines, sql):
    s, c = engines
    got = s.sql(sql)
    want = c.execute(sql)
    assert got.columns == [x[0] for x in want.description]
    assert [tuple(r) for r in got.collect()] == want.fetchall()


def test_value_at_the_extreme_of_another(engines):
    """Rows with a null on either side don't count; ties go to the least value, as in a table that is ordered by it, in any order of rows."""
    s, c = engines
    rows = [(i, f"n{i:03}" + "x" * (i % 2), i / 4, i % 3 == 1, i % 7 if i % 5 else None) for i in range(400)] + [(None, None, None, None, 99), (None, None, None, None, -99)]
    text = ", ".join(f"({', '.join('NULL' if v is None else repr(v) for v in r)})" for r in rows)
    c.execute(f"CREATE TABLE x AS SELECT * FROM (VALUES {text}) v(i, s, f, b, y)")
    c.execute("SET threads = 1")
    s.catalog.spark.createDataFrame(sorted(rows, key=lambda r: -(r[0] or 0)), "i int, s string, f double, b boolean, y int").repartition(3).createOrReplaceTempView("x")
    for sql in (
        "SELECT arg_max(i, y) AS a, arg_min(i, y) AS b, arg_max(s, y) AS c, arg_min(s, y) AS d, max_by(f, y) AS e, min_by(f, y) AS g, argmax(i, s) AS h, arg_max(s, f) AS j FROM x",
        "SELECT arg_max(i, y) FILTER (WHERE i > 50) AS a, argmin(s, y) FILTER (WHERE i > 900) AS b FROM x",
        "SELECT b, arg_max(i, y) AS v, arg_max(DISTINCT s, y) AS w, arg_min(DATE '2020-01-01' + i, y) AS d, arg_max(DATE '2020-01-01' + i, y) AS e FROM x WHERE b IS NOT NULL GROUP BY b ORDER BY b",
    ):
        assert [tuple(r) for r in s.sql(sql).collect()] == c.execute(sql).fetchall()
    for sql in ("SELECT arg_max(i, y, 2) FROM x", "SELECT arg_max(i, y ORDER BY i) FROM x"):
        with pytest.raises(Unsupported):
            s.sql(sql)


def test_asof_plan_has_no_pairs(engines):
    """One union and one window; rows of a key never meet pairwise."""
    s, _ = engines
    plan = s.sql("SELECT a.k, b.w FROM t a ASOF JOIN u b ON a.k = b.k AND a.d >= b.w")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Join" not in plan
    pairs = s.sql("SELECT a.k, b.w FROM t a ASOF JOIN u b ON a.k = b.k AND a.k <> 7 AND a.d >= b.w")  # another condition: row by row
    assert pairs.count() == 0
