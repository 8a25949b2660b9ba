from brindle.functions import completion as c

TABLES = {
    "customers": {"id": "bigint", "name": "string", "joined": "date"},
    "orders": {"order_id": "bigint", "customer_id": "bigint", "total": "double", "note": "string"},
    "log": {"order_id": "bigint", "at": "timestamp"},
}


def names(sql, **options):
    at = sql.index("|")
    return [x for x, _ in c.suggest(sql.replace("|", ""), at, TABLES, **options)]


def test_places():
    assert names("SELECT * FROM |")[:3] == ["customers", "orders", "log"]
    assert names("SELECT * FROM o|")[0] == "orders"
    assert "customers ON orders.customer_id = customers.id" in names("SELECT * FROM orders JOIN |") and "log ON orders.order_id = log.order_id" in names("SELECT * FROM orders JOIN |")
    assert names("SELECT | FROM orders")[:4] == ["order_id", "customer_id", "total", "note"]
    assert names("SELECT * FROM orders WHERE t|")[0] == "total"
    assert names("SELECT * FROM orders o WHERE o.|") == ["order_id", "customer_id", "total", "note"]
    assert names("SELECT sum(|) FROM orders")[:3] == ["order_id", "customer_id", "total"]
    assert names("SELECT lower(| FROM orders")[0] == "note" and names("SELECT year(|) FROM log")[0] == "at"
    assert names("|")[0] == "SELECT" and names("SELECT * FROM orders GROUP BY c|")[0] == "customer_id"
    assert "a.total" in names("SELECT | FROM orders a, customers b", limit=100)


def test_points():
    scored = dict(c.suggest("SELECT t", None, TABLES))
    assert scored["total"] == 28 and "note" in scored  # a column, in the same case; inside a word
    assert dict(c.suggest("SELECT T", None, TABLES))["total"] == 23
    assert names("SELECT | FROM orders", usage=c.terms("select note, note, total"))[0] == "note"
    assert ("orders", "customer_id", "customers", "id") in c.relations(TABLES)
    assert c.suggest("SELECT zzz", None, TABLES) == []


def test_session_completions(spark):
    from brindle.session import Session

    s = Session(spark)
    s.sql("CREATE TABLE shops AS SELECT 1 AS shop_no, 'x' AS town")
    assert s.completions("SELECT * FROM sh")[0] == "shops" and s.completions("SELECT sh FROM shops", 9)[0] == "shop_no"
    s.sql("SELECT town FROM shops")
    s.sql("SELECT town FROM shops")
    assert s.completions("SELECT  FROM shops", 7)[0] == "town"
