import json
import os
import sqlite3

import duckdb
import pytest
from brindle.catalog import friendly_names, sanitize
from brindle.session import Session
from brindle.sources import databases, delta, sinks, text, xlsx


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(1, "Ann", 30, 10.5, "IT"), (2, "Bo, the 2nd", 41, None, "HR"), (3, None, 25, 7.0, 'x "y"')], "id long, name string, age long, salary double, department string")


def test_csv(spark, tmp_path):
    p = tmp_path / "My Data.csv"
    p.write_text("id;name;joined;score\n1;\"a;b\";2024-01-02;1.5\n2;NA;2024-01-03;\n3;c;2024-01-04;2\n")
    s = Session(spark)
    name = s.catalog.load(str(p))
    df = s.catalog[name]
    assert name == "my_data" and dict(df.dtypes) == {"id": "bigint", "name": "string", "joined": "string", "score": "double"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a;b", "2024-01-02", 1.5), (2, None, "2024-01-03", None), (3, "c", "2024-01-04", 2.0)]
    assert s.catalog.load(str(p)) == "my_data_1"
    latin = tmp_path / "l.txt"
    latin.write_bytes("k\tv\n1\tcafé\n2\tß\n".encode("latin-1"))
    assert [r.v for r in s.catalog.read(str(latin)).orderBy("k").collect()] == ["café", "ß"]


def test_sniffing():
    assert text.detect_separator("a,b\n1,2\n3,4\n") == "," and text.detect_separator("a\tb\n1\t2\n") == "\t" and text.detect_separator('"a";"b"\n"1,5";"2"\n') == ";"
    assert text.is_table_text("a\tb\n1\t2") and not text.is_table_text("just a line") and text.paste_delimiter("a|b\n1|2") == "|"
    assert text.has_header([["id", "x"], ["1", "2"]]) and not text.has_header([["1", "2"], ["3", "4"]])


def test_paste(spark):
    df, message = text.parse_pasted(spark, "name\tage\tcity\nAnn\t30\tX\nBo\tn/a\t\nCy\t1,000\tZ\n")
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "city": "string"} and "3 rows" in message
    assert [r.age for r in df.collect()] == [30, None, 1000]
    assert text.to_tsv(df).splitlines()[0] == "name\tage\tcity"


def test_files_round_trip(spark, users, tmp_path):
    s = Session(spark)
    want = sorted(map(tuple, users.collect()))
    for ext in ("parquet", "csv", "json", "xlsx", "orc", "tsv"):
        name = s.export(users, str(tmp_path / f"u_{ext}.{ext}"), f"t_{ext}")
        got = s.catalog[name].select(*users.columns)
        assert sorted(map(tuple, got.collect())) == want, ext


def test_xlsx_types(spark, tmp_path):
    df = spark.sql("SELECT 1L AS a, 2.5D AS b, true AS c, TIMESTAMP_NTZ '2024-02-03 04:05:06' AS d, 'x<&>' AS e UNION ALL SELECT 2L, NULL, NULL, NULL, NULL")
    p = str(tmp_path / "t.xlsx")
    assert xlsx.write_xlsx(df, p) == 2
    back = xlsx.read_xlsx(spark, p)
    assert dict(back.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "timestamp_ntz", "e": "string"}
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match=".xls"):
        xlsx.read_xlsx(spark, "old.xls")
    with pytest.raises(ValueError):
        sinks.export(df, "x.unknown")


def test_databases(spark, tmp_path):
    lite, duck = str(tmp_path / "a.db"), str(tmp_path / "b.duckdb")
    c = sqlite3.connect(lite)
    c.execute("CREATE TABLE users (id INTEGER, name TEXT, score REAL)")
    c.executemany("INSERT INTO users VALUES (?, ?, ?)", [(1, "a", 1.5), (2, None, None)])
    c.commit()
    c.close()
    d = duckdb.connect(duck)
    d.execute("CREATE TABLE sales AS SELECT i AS id, i * 1.5::DOUBLE AS v, DATE '2024-01-01' AS day FROM range(5) t(i)")
    d.close()
    s = Session(spark)
    assert s.catalog.attach(lite) == ["db_users"] and databases.kind_of(lite) == "sqlite"
    assert s.sql("SELECT u.id, o.v FROM users u JOIN (VALUES (1, 'x'), (2, 'y')) o(k, v) ON u.id = o.k").count() == 2
    with pytest.raises(ValueError, match="read-only"):
        s.sql("DELETE FROM db_users")
    assert s.catalog.load(duck) == "db" and "db_users" not in s.catalog
    assert s.sql("SELECT sum(v) AS v FROM sales").first().v == 15.0
    s.catalog.detach()
    assert "db_sales" not in s.catalog


def test_delta_replay(spark, tmp_path):
    root = tmp_path / "t"
    os.makedirs(root / "_delta_log")
    df = spark.createDataFrame([(1, 1.5), (2, 2.5)], "id long, v double")
    names = []
    for part in ("a", "b", "c"):
        df.withColumn("id", df.id + len(names) * 10).coalesce(1).write.parquet(str(tmp_path / part))
        f = next(x for x in os.listdir(tmp_path / part) if x.endswith(".parquet"))
        os.rename(tmp_path / part / f, root / f"{part}.parquet")
        names.append(f"{part}.parquet")
    schema = json.dumps({"type": "struct", "fields": [{"name": "id", "type": "long", "nullable": True, "metadata": {}}, {"name": "v", "type": "double", "nullable": True, "metadata": {}}, {"name": "p", "type": "string", "nullable": True, "metadata": {}}]})
    add = lambda n, p: json.dumps({"add": {"path": n, "partitionValues": {"p": p}, "dataChange": True}})
    log = root / "_delta_log"
    (log / f"{0:020d}.json").write_text("\n".join([json.dumps({"protocol": {"minReaderVersion": 1}}), json.dumps({"metaData": {"schemaString": schema, "partitionColumns": ["p"]}}), add(names[0], "x"), add(names[1], "x")]))
    (log / f"{1:020d}.json").write_text("\n".join([json.dumps({"remove": {"path": names[0]}}), add(names[2], None)]))
    s = Session(spark)
    t = s.catalog.load(str(root))
    assert sorted(map(tuple, s.catalog[t].collect())) == [(11, 1.5, "x"), (12, 2.5, "x"), (21, 1.5, None), (22, 2.5, None)]
    assert delta.read_delta(spark, str(root), version=0).count() == 4
    assert delta.find_delta(spark, str(tmp_path)) == [str(root)]


def test_names():
    assert sanitize("My File-2") == "my_file_2" and sanitize("2024 x") == "table_2024_x"
    assert friendly_names(["First Name", "first-name", "!!", "A__b"]) == ["first_name", "first_name_1", "column", "a_b"]


def test_catalog(spark, users, tmp_path):
    s = Session(spark)
    t = s.catalog.register(users, "People!")
    assert t == "people_" and s.catalog.rename(t, "staff") == "staff"
    s.catalog.rename_column("staff", "name", "full_name")
    assert s.sql("SELECT full_name FROM staff").count() == 3
    with pytest.raises(ValueError):
        s.catalog.rename_column("staff", "full_name", "id")
    s.catalog.delete_column("staff", "salary")
    assert "salary" not in s.catalog.columns("staff")
    f = str(tmp_path / "f.parquet")
    users.write.parquet(f)
    s.catalog.load(f)
    s.catalog.rename_column("f", "age", "years")
    s.catalog.save_project(str(tmp_path / "p.json"), [{"sql": "SELECT 1"}])
    other = Session(spark)
    assert other.catalog.open_project(str(tmp_path / "p.json")) == [{"sql": "SELECT 1"}]
    assert other.sql("SELECT years FROM f").count() == 3
    assert other.catalog.preview("f", 2).count() == 2
    assert other.catalog.remove("f", "nothing") == 1
    assert s.catalog.to_friendly_names("staff").startswith("staff_transformed_")


def test_scripts_and_errors(spark, users):
    s = Session(spark)
    s.catalog.register(users, "u")
    results = s.run_all("SELECT count(*) AS n FROM u; SELEC 1; SELECT nope FROM u; SELECT * FROM missing; SELECT max(age) AS m FROM u")
    assert [type(r.error) for r in results] == [type(None), SyntaxError, ValueError, ValueError, type(None)]
    assert results[-1].df.first().m == 41 and s.current.tables == ["u"]
    assert s.run_at("SELECT 1 AS a; SELECT 2 AS a", 20).first().a == 2
    with pytest.raises(SyntaxError):
        s.sql("  ")


def test_statements(spark, users, tmp_path):
    s = Session(spark)
    s.catalog.register(users, "u")
    assert [r.column_name for r in s.sql("DESCRIBE u").collect()] == users.columns
    assert s.sql("SHOW TABLES").first().name == "u"
    s.sql("CREATE TABLE e (id INTEGER PRIMARY KEY, name VARCHAR NOT NULL)")
    s.sql("INSERT INTO e VALUES (1, 'a'), (2, 'b')")
    s.sql("UPDATE e SET name = upper(name) WHERE id = 2")
    s.sql("DELETE FROM e WHERE id = 1")
    assert [tuple(r) for r in s.sql("SELECT * FROM e").collect()] == [(2, "B")]
    s.sql(f"COPY (SELECT * FROM u) TO '{tmp_path}/o.csv' (FORMAT csv, HEADER)")
    assert s.sql(f"SELECT count(*) AS n FROM read_csv('{tmp_path}/o.csv')").first().n == 3
    s.sql("ALTER TABLE e RENAME TO e2")
    s.sql("DROP TABLE e2")
    s.sql("DROP TABLE IF EXISTS e2")
    with pytest.raises(ValueError):
        s.sql("DROP TABLE e2")
    assert s.sql("SELECT * REPLACE (age + 1 AS age) FROM u QUALIFY row_number() OVER (ORDER BY age DESC) = 1").first().age == 42


def test_long_scripts_keep_short_plans(spark):
    """After some changes a table's rows are written, so its plan doesn't grow with the script."""
    from brindle import catalog

    s = Session(spark)
    s.sql("CREATE TABLE grow AS SELECT 0 AS k")
    sizes = []
    for i in range(1, 3 * catalog.CHANGES):
        s.sql(f"INSERT INTO grow VALUES ({i})")
        sizes.append(len(s.table("grow")._jdf.queryExecution().optimizedPlan().toString()))
    assert s.table("grow").count() == 3 * catalog.CHANGES and max(sizes) < 2 * max(sizes[: catalog.CHANGES])


def test_partitioned_lakehouse_is_one_scan(spark, tmp_path):
    import json
    import os

    root = tmp_path / "parts"
    spark.createDataFrame([(i, f"p {i % 3}") for i in range(30)], "v long, p string").repartition(1).write.partitionBy("p").parquet(str(root))
    files = [os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")]
    schema = {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("v", "long"), ("p", "string"))]}
    (root / "_delta_log").mkdir()
    from urllib.parse import quote

    lines = [{"metaData": {"schemaString": json.dumps(schema), "partitionColumns": ["p"]}}, *({"add": {"path": quote(f), "partitionValues": {"p": "x"}}} for f in files)]
    (root / "_delta_log" / f"{0:020}.json").write_text("\n".join(map(json.dumps, lines)))
    (root / "_delta_log" / f"{1:020}.json").write_text(json.dumps({"remove": {"path": quote(files[0])}}))
    df = Session(spark).catalog.read(str(root))
    assert df.columns == ["v", "p"] and df.count() == 20 and df.select("p").distinct().count() == 2
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
