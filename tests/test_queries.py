import oracle
import pytest
from brindle import queries


@pytest.fixture(scope="module")
def connection():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, connection, name):
    df = queries.QUERIES[name](spark, oracle.SF)
    if name in queries.ORACLE_SQL:
        oracle.same(df, connection, queries.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_domain_flags_counts_every_subject(spark, tmp_path):
    rows = [("A neural model",), ("the Python server",), ("Sales and revenue",), ("a study of the market",), ("nothing here",), (None,)]
    spark.createDataFrame(rows, "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.domain: r.rows for r in queries.QUERIES["domain_flags"](spark, str(tmp_path)).collect()}
    assert got == {"ai_ml": 1, "tech": 1, "business": 2, "academic": 1}


def test_whole_tables_take_part(spark):
    """On tables large enough that a filter or limit shows."""
    d = "/root/testdata/sf0.01"
    t = lambda name: spark.read.parquet(f"{d}/{name}.parquet").collect()
    customers, suppliers, events = t("customer"), t("supplier"), t("events")

    joined = queries.QUERIES["full_join"](spark, d).collect()
    assert {r.c_custkey for r in joined} - {None} == {r.c_custkey for r in customers} and {r.s_suppkey for r in joined} - {None} == {r.s_suppkey for r in suppliers}
    assert any(r.c_custkey is None for r in joined) and any(r.s_suppkey is None for r in joined)

    nations = [r.nation for r in queries.QUERIES["nulls_last"](spark, d).collect()]
    nulls = sum(r.c_nationkey == 3 for r in customers)
    assert nulls and len(nations) == len(customers) and nations[-nulls:] == [None] * nulls and None not in nations[:-nulls]

    first = {}
    for r in events:
        if r.event_type != "purchase":
            first[r.user_id] = min(first.get(r.user_id, r.ts), r.ts)
    matched = {r.event_id for r in events if r.event_type == "purchase" and r.user_id in first and first[r.user_id] <= r.ts}
    assert {r.event_id for r in queries.QUERIES["asof_sql"](spark, d).collect()} == matched


def test_every_oracle_has_a_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_entry_without_the_optional_parts():
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    code = "import sys; sys.modules['brindle.llm'] = None; sys.modules['corpus_pipeline'] = None; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; from brindle import queries as q; assert set(e.queries()) == set(q.QUERIES) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code, root], check=True, cwd="/")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
