import math
import random
import time

import numpy as np
import pytest
from brindle.functions import columns as fn
from brindle.functions import reference
from brindle.operators import cn2, compare, discretize, distributions, encode, entropy, explain, foreign_keys, keys, search, similarity
from brindle.plans import sqlgen
from brindle.streaming import events as stream
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "John Doe", "john@x.org", "IT", "a; b"), (2, "Jane", None, "HR", "50% off"), (3, "Bob.Smith", "bob@x.org", "IT", None)]
    return spark.createDataFrame(rows, "id long, name string, email string, department string, notes string")


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_search(people):
    assert ids(search.search(people, "JOHN")) == [1] and ids(search.search(people, "JOHN", case_sensitive=True)) == []
    assert ids(search.search(people, "o.s")) == [] and ids(search.search(people, "O.S", regex=True)) == []
    assert ids(search.search(people, r"\D\.s", regex=True)) == [3] and ids(search.search(people, "[", regex=True)) == []
    assert ids(search.search(people, "50%")) == [2] and ids(search.search(people, "")) == [1, 2, 3] and ids(search.search(people, "nan")) == []
    assert ids(search.search_joined(people, "doe|john@")) == [1]
    assert ids(search.value_filter(people, {"department": ["IT"], "notes": ["NULL"]})) == [3]


def test_search_is_fast(spark):
    df = spark.range(50_000).selectExpr("id", "concat('User', id) AS name", "concat(id, '@x.org') AS email", "CASE id % 4 WHEN 0 THEN 'Engineering' ELSE 'Sales' END AS department", "'ok' AS status").cache()
    df.count()
    begin = time.time()
    assert search.search(df, "User").count() == 50_000 and search.search_joined(df, "Engineering").count() == 12_500
    assert time.time() - begin < 5


def test_display(spark):
    df = spark.sql("SELECT 1234567L AS i, 2.0D AS w, 0.5D AS f, 12345678.25D AS b, CAST(NULL AS INT) AS n, X'0AFF' AS x, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS t")
    assert list(df.select(*(search.display(df, c) for c in df.columns)).first()) == ["1,234,567", "2", "0.500000", "12,345,678.25", "NULL", "0aff", "2024-01-02 03:04:05"]


def test_entropy(spark):
    df = spark.range(8).selectExpr("id % 2 AS two", "id % 8 AS eight", "1 AS one", "CAST(NULL AS STRING) AS none")
    got = {r.column: (round(r.entropy, 9), r.importance) for r in entropy.profile(df).collect()}
    assert got == {"eight": (3.0, "High"), "two": (1.0, "Low"), "one": (0.0, "Very Low"), "none": (0.0, "Very Low")}
    assert entropy.profile(df.limit(0)).agg(F.max("entropy")).first()[0] == 0


def test_distributions(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.gauss(50, 8), rng.expovariate(0.1), rng.uniform(0, 1), 5.0, float(i % 3)) for i in range(4000)], "n double, e double, u double, c double, d double")
    best = {c: distributions.fit_distributions(df, c).first() for c in df.columns}
    assert best["n"].distribution in ("normal", "gamma", "lognormal", "beta") and best["u"].distribution in ("uniform", "beta")
    assert best["e"].distribution in ("exponential", "gamma") and best["c"].distribution == "constant" and best["d"].distribution == "discrete"
    fits = {r.distribution: r for r in distributions.fit_distributions(df, "n").collect()}
    assert abs(fits["normal"].parameters[0] - 50) < 1 and fits["normal"].p_value > 0.01 > fits["uniform"].p_value
    assert abs(distributions._gamma_cdf(2.0, [1.0])[0] - (1 - 2 / math.e)) < 1e-10 and abs(distributions._beta_cdf(2, 3, [0.5])[0] - 0.6875) < 1e-8
    stats = {r.column: r for r in distributions.column_stats(df.withColumn("m", F.when(F.col("d") > 0, F.lit("x")))).collect()}
    assert stats["m"].missing == 1334 and stats["m"].type == "categorical" and stats["c"].distinct == 1
    assert len(distributions.qq_normal(df, "n", 9).collect()) == 9


def test_keys(spark):
    df = spark.createDataFrame([(1, "a", 1, None), (1, "b", 1, 2), (2, "a", 2, 3), (2, "b", 2, 3)], "x int, y string, z int, w int")
    found = keys.candidate_keys(df, 2)
    assert sorted(r["columns"] for r in found.where("key_type <> ''").collect()) == [["x", "y"], ["y", "w"], ["y", "z"]]
    fds = {(tuple(r.determinant), r.dependent) for r in keys.functional_dependencies(df, 1).collect()}
    assert fds == {(("x",), "z"), (("z",), "x"), (("x",), "w"), (("z",), "w"), (("w",), "x"), (("w",), "z")}
    strict = {(tuple(r.determinant), r.dependent) for r in keys.functional_dependencies(df, 1, nulls_are_values=True).collect()}
    assert strict == {(("x",), "z"), (("z",), "x"), (("w",), "x"), (("w",), "z")}
    assert keys.candidate_keys(df, 2, ["x", "z"], report_all=False).count() == 3
    assert keys.propose_tables(["a", "b", "c"], [["a", "c"]], [(["a"], "b")]) == [{"columns": ["a", "b"], "key": ["a"]}, {"columns": ["a", "c"], "key": ["a", "c"]}]
    assert keys.propose_tables(["a"], [], [])[0]["key"] == ["id (suggested)"]
    assert keys.candidate_keys(df.limit(0), 1).where("key_type <> ''").count() == 0


def test_foreign_keys(spark):
    c = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string")
    o = spark.createDataFrame([(i, i % 20 if i < 95 else None) for i in range(100)], "order_no long, customer_id long")
    got = foreign_keys.find_foreign_keys({"customers": c, "orders": o}).collect()
    assert [(r.fk_table, r.fk_column, r.pk_table, r.pk_column, r.match_ratio) for r in got] == [("orders", "customer_id", "customers", "id", 1.0)]
    broken = foreign_keys.referential_integrity(o, "customer_id", c.where("id <> 3"), "id").first()
    assert (broken.fk_rows, broken.violations, broken.examples) == (95, 1, ["3"])
    similar = {("Customer_ID", "customer_id"): 1.0, ("customer_id", "customer"): 0.8, ("customer_id", "customer_key"): 0.9, ("main_customer_id", "customer_key"): 0.6, ("order_id", "customer_id"): 0.0, ("id", "key"): 0.6}
    assert {p: foreign_keys.name_similarity(*p) for p in similar} == similar
    assert all(map(foreign_keys.id_like, ("id_x", "key_x", "a_ref", "number", "code", "OrderNum"))) and not foreign_keys.id_like("order_no")
    assert not any(map(foreign_keys.may_refer, ("weight", "ratio", "country", "unitprice"))) and all(map(foreign_keys.may_refer, ("type", "value_id", "flag")))
    edge = got[0]
    assert foreign_keys.join_sql(edge) == "SELECT * FROM orders JOIN customers ON orders.customer_id = customers.id"
    assert foreign_keys.join_sql(edge, keep_all=True) == "SELECT * FROM orders LEFT JOIN customers ON orders.customer_id = customers.id"
    assert foreign_keys.join_reference({"customers": c, "orders": o}, edge).count() == 95 and foreign_keys.join_reference({"customers": c, "orders": o}, edge, keep_all=True).count() == 100
    assert "foreign_keys" in foreign_keys.profile({"c": c, "o": o, "empty": c.limit(0)})


def test_compare(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (None, 3.0, "z")], "id int, v double, s string")
    b = spark.createDataFrame([(1, 1.0, "x"), (2, 2.5, None), (3, 4.0, "w"), (None, 3.0, "z")], "id int, v double, s string")
    got = compare.compare([a, b], ["a", "b"], ["id"])
    assert {r.indicator: r.rows for r in got.summary().collect()} == {"all": 3, "b_only": 1}
    assert {r.column: r.different for r in got.cell_differences().collect()} == {"v": 1, "s": 1}
    (row,) = got.row_differences().collect()
    assert row.id == 2 and [tuple(x) for x in row.differences] == [("v", "2.0", "2.5"), ("s", "y", None)]
    three = compare.compare([a, b, b.where("id = 3")], ["a", "b", "c"], ["id"])
    assert {r.indicator for r in three.summary().collect()} == {"a,b", "b,c"}
    assert compare.infer_keys([a, b]) == ["id"]
    with pytest.raises(ValueError):
        compare.compare([a])


def test_similarity(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 2.0, None), (3, 3.0, 30.0), (4, 50.0, 20.0)], "k int, a double, b double")
    z = similarity.zscores(df, ["a", "b"]).collect()
    assert abs(sum(r.a for r in z)) < 1e-9 and abs(sum(r.b**2 for r in z) / 4 - 1) < 1e-9 and z[1].b == 0
    assert similarity.unusual_rows(df, "k").first().k == 1
    p = similarity.pca(df, ["a", "b"])
    assert abs(sum(r.explained for r in p["variance"].collect()) - 1) < 1e-9
    assert p["scores"](["k"]).columns == ["k", "pc1", "pc2"]
    near = similarity.row_pairs(df, "k", ["a", "b"], exact_rows=1)
    assert near.columns == ["row_1", "row_2", "distance"]
    with pytest.raises(ValueError):
        similarity.row_pairs(df, "k", farthest=True, exact_rows=1)


def test_row_pairs_are_exact_at_every_size(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), *map(float, v)) for k, v in enumerate(np.round(rng.standard_t(2, (5200, 3)), 3))]
    rows += [(9000 + k, 0.5, 0.5, 0.5) for k in range(4)] + [(None, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double").repartition(5)
    x = np.array([r[1:] for r in rows])
    x = ((x - x.mean(axis=0)) / x.std(axis=0))[:-1]
    keys = [r[0] for r in rows[:-1]]
    d = np.sqrt(sum((x[:, j, None] - x[None, :, j]) ** 2 for j in range(3)))
    a, b = np.triu_indices(len(keys), 1)
    for far in (False, True):
        score = np.round(-d[a, b] if far else d[a, b], 9)
        first = np.lexsort((b, a, score))[:12]
        got = similarity.row_pairs(df, "k", n=12, farthest=far, block_rows=300).collect()
        assert [(r.row_1, r.row_2) for r in got] == [(keys[a[i]], keys[b[i]]) for i in first]
        assert all(abs(r.distance - d[a[i], b[i]]) < 1e-9 for r, i in zip(got, first))
    same = spark.createDataFrame([(f"k{k:04}", 1.0) for k in range(900)], "k string, a double")
    assert [tuple(r) for r in similarity.row_pairs(same, "k", n=3, block_rows=50).collect()] == [("k0000", f"k000{k}", 0.0) for k in (1, 2, 3)]
    apart = spark.createDataFrame([(1, 0.0), (2, 100.0), (3, 1000.0)], "k int, a double")
    assert similarity.row_pairs(apart, "k").count() == 3 and similarity.row_pairs(apart.limit(0), "k").count() == 0


def test_explain(spark):
    rng = random.Random(1)
    rows = [(i, x := rng.random(), 2 * x + 0.01 * rng.random(), rng.choice("ab"), "p" if x > 0.5 else "q", None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y double, noise string, side string, none double")
    got = explain.explain(df, "y").collect()
    assert got[0].feature == "x" and got[0].correlation > 0.99 and "none" not in {r.feature for r in got}
    assert abs(sum(r.importance_value for r in got) - 1) < 1e-9
    same = explain.explain(df.withColumn("one", F.lit(1.0)).drop("none"), "one").collect()  # nothing to explain: by distinct values
    assert abs(sum(r.importance_value for r in same) - 1) < 1e-9 and all(r.correlation == 0 for r in same)
    assert explain.association(df, "side", "side").first()[0] > 0.99 and explain.association(df.limit(3), "x", "y").first()[0] == 0
    for f, t in (("x", "y"), ("side", "y"), ("x", "side"), ("noise", "side")):
        assert explain.drill_down(df, f, t).count() > 0


def test_encode(spark):
    df = spark.createDataFrame([(1, "python and data", "a b", 1.0), (2, "data science with java", "C", 2.0), (3, None, "a b", 3.0), (4, "java code, java code", None, 4.0)], "id int, text string, cat string, v double")
    flags = encode.one_hot(df, "cat", binary_format="text")
    assert flags.columns[-2:] == ["is_c", "is_a_b"] and [r.is_c for r in flags.orderBy("id").collect()] == ["No", "Yes", "No", "No"]
    assert encode.is_text(df, "text") and df.columns == ["id", "text", "cat", "v"]
    got = encode.encode(df, "text")
    assert "has_java" in got.columns and [r.has_java for r in got.orderBy("id").collect()] == [0, 1, 0, 1]
    assert {r.feature: r.coverage for r in encode.coverage(got, ["has_java"]).collect()} == {"has_java": 50.0}
    more = encode.encode(df, "text", algorithm="advanced", topics=2)
    assert any(c.startswith("has_topic_") for c in more.columns) and any(c.startswith("has_domain_") for c in more.columns)
    assert encode.related(df, "v").count() > 0
    assert encode.correlations(got, ["has_java", "has_data"]).first().together == 1
    assert encode.compare_flag(got, F.col("has_java"), "v").count() == 2
    with pytest.raises(ValueError):
        encode.encode(df, "text", algorithm="other")


def test_discretize(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.gauss(m, 2),) for m in (10, 50, 100) for _ in range(50)] + [(None,)], "v double")
    # Peaks are sought inside: the lone values at both ends make the outer clusters two of them.
    d = discretize.Discretizer().fit(df.union(spark.createDataFrame([(-60.0,), (170.0,)], "v double")), "v")
    assert d.chosen == "jenks" and 3 <= len(d.labels) <= 10
    three = discretize.Discretizer("jenks", 3).fit(df, "v")
    assert len(three.edges) == 2 and 15 < three.edges[0] < 45 < 55 < three.edges[1] < 95
    exp = spark.createDataFrame([(rng.expovariate(0.01),) for _ in range(400)], "v double")
    q = discretize.Discretizer("quantile", 4).fit(exp, "v")
    assert all(90 <= r["count"] <= 110 for r in q.summary(exp, "v").collect())
    binned = discretize.bin_numeric(df, "v")
    assert {r.v_binned for r in binned.where("v is null").collect()} == {"Missing"}
    assert discretize.bin_numeric(spark.createDataFrame([(2.0,)] * 3, "v double"), "v").first().v_binned == "All values: 2"
    assert discretize.bin_numeric(spark.createDataFrame([(None,)], "v double"), "v").first().v_binned == "Missing"
    countries = spark.createDataFrame([(c,) for c, n in (("USA", 30), ("UK", 20), ("Spain", 5), (None, 2)) for _ in range(n)], "country string")
    assert {r.country_grouped for r in discretize.group_categories(countries, "country", top_n=2).collect()} == {"USA", "UK", "Other", "Missing"}
    assert discretize.auto_categorize(countries, "country")[1] == "grouped" and discretize.auto_categorize(exp, "v")[1] == "binned"
    with pytest.raises(ValueError):
        discretize.Discretizer("nope")


def test_cn2(spark):
    rng = random.Random(3)
    rows = [(float(rng.randrange(100)), rng.choice(["red", "blue"]), None if i % 9 == 0 else i % 2) for i in range(200)]
    df = spark.createDataFrame([(x, c, b, "hi" if x > 60 and c == "red" else "lo") for x, c, b in rows], "x double, colour string, bit int, y string")
    for measure in cn2.MEASURES:
        m = cn2.CN2(measure=measure).fit(df, "y")
        assert 1 <= len(m.rules) <= 10 and all(r.coverage >= 5 and r.accuracy >= 0.5 and len(r.conditions) <= 3 for r in m.rules)
        assert m.score(df, "y") >= 0.85
    p = m.predict_proba(df).select(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(p[0] - 1) < 1e-9 and abs(p[1] - 1) < 1e-9
    assert m.rules_table(spark).count() == len(m.rules)
    assert cn2.discover_rules(df.select("x", "colour", "bit"), "x", max_rules=2).classes
    with pytest.raises(ValueError):
        cn2.discover_rules(df.where("y = 'hi'"), "y")


def test_generators(spark):
    columns = {"customers": ["id", "name"], "orders": ["order_id", "customer_id", "amount"]}
    (r,) = sqlgen.infer_relationships(columns)
    assert (r.from_table, r.from_column, r.to_table, r.to_column, r.confidence) == ("orders", "customer_id", "customers", "id", 0.9)
    sql = sqlgen.join_sql(columns, "left outer")
    assert "LEFT JOIN orders ON customers.id = orders.customer_id" in sql and '"orders_amount"' in sql
    assert sqlgen.infer_relationships({"t1": ["alpha"], "t2": ["gamma"]}) == []
    for bad in (lambda: sqlgen.join_sql(columns, "SIDEWAYS"), lambda: sqlgen.join_sql({"a": ["x"]}), lambda: sqlgen.join_sql({"a": ["x"], "b": ["y"]}), lambda: sqlgen.set_sql({"a": ["x"], "b": ["y"]}), lambda: sqlgen.set_sql(columns, "PLUS")):
        with pytest.raises(ValueError):
            bad()
    assert sqlgen.set_sql({"a": ["id", "x"], "b": ["y", "id"], "c": ["id"]}, "INTERSECT").count("INTERSECT") == 2
    assert sqlgen.add_column("SELECT a FROM t WHERE b = 1", "c d") == 'SELECT a, "c d" FROM t WHERE b = 1'
    assert sqlgen.where_equals("x", "it's", "SELECT a FROM t WHERE b = 1 ORDER BY a") == "SELECT a FROM t WHERE b = 1 AND x = 'it''s' ORDER BY a"
    assert sqlgen.drill_down("t", "c", "has_it's").endswith("contains(lower(c), 'it''s')") and sqlgen.table_of(sql="SELECT 1 FROM x") == "x"
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 4, "a"), (1, 10, "b")], "k int, t int, v string")
    assert sorted(map(tuple, sqlgen.asof_join(left, right, "t", ["k"]).select("k", "t", "v").collect()), key=str) == [(1, 10, "b"), (1, 5, "a"), (2, 1, None)]
    assert {r.v for r in sqlgen.asof_join(left, right, "t", ["k"], allow_exact=False).where("k = 1").collect()} == {"a"}


def test_functions(spark):
    df = spark.sql("SELECT 'hello' AS s, 2.5D AS x, DATE '2024-03-31' AS d, DATE '2024-01-30' AS e, '{\"a\": {\"b\": 1}}' AS j")
    got = df.select(fn.concat("s", F.lit(None), F.lit("!")), fn.left("s", -2), fn.right("s", -2), fn.to_int("x"), fn.date_diff("month", "e", "d"), fn.date_diff("day", "e", "d"), fn.age("d", "e"), fn.json_string("j", "a.b"), fn.divide("x", F.lit(0)), fn.string_split(F.lit("a.b"), "."), fn.day_of_week("d")).first()
    assert list(got) == ["hello!", "hel", "llo", 3, 2, 61, (2, 1), "1", None, ["a", "b"], 0]
    assert spark.createDataFrame([(None,), (1,)], "v int").agg(fn.array_agg("v").alias("l")).first().l in ([None, 1], [1, None])


def test_reference(spark):
    assert reference.search(spark, "median").first().name == "median" and reference.search(spark, "zzz").count() == 0
    assert reference.catalogue(spark).count() >= 115
    assert reference.completions("co", ["count", "discount", "concat", "x"]) == ["concat", "count", "discount"]


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 4:02d}:{15 * (i % 4):02d}:00", i % 2, "a" if i % 3 else "b", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    live = stream.windowed(stream.read_events(spark, str(tmp_path / "e"), files_per_trigger=10), "2 hours", late="1 hour")
    q = live.writeStream.outputMode("complete").format("memory").queryName("live_windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("live_windows").collect())) == sorted(map(tuple, stream.windowed(df, "2 hours").collect()))
    assert stream.sessions(df, "40 minutes").count() == 2 and stream.distinct_events(df.union(df)).count() == 40
