"""Embedded database files, read-only: SQLite (standard library) and DuckDB (where installed)."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"SQLite format 3\0"
#: Rows of a SQLite table that one task reads, about.
ROWS = 250_000


def kind_of(path: str) -> str:
    """sqlite or duckdb, by the file's first bytes."""
    with open(path, "rb") as f:
        return "sqlite" if f.read(len(MAGIC)) == MAGIC else "duckdb"


def _duckdb():
    try:
        import duckdb
    except ImportError as e:
        raise RuntimeError("reading DuckDB files needs the duckdb package") from e
    return duckdb


def _sqlite(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> dict[str, list[tuple[str, str]]]:
    """(column, declared type) of each table and view."""
    if kind_of(path) == "sqlite":
        c = _sqlite(path)
        try:
            names = [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
            return {n: [(r[1], r[2] or "") for r in c.execute(f"PRAGMA table_info({_q(n)})")] for n in names}
        finally:
            c.close()
    c = _duckdb().connect(path, read_only=True)
    try:
        out: dict[str, list[tuple[str, str]]] = {}
        for t, col, kind in c.execute("SELECT table_name, column_name, data_type FROM duckdb_columns() WHERE NOT internal ORDER BY table_name, column_index").fetchall():
            out.setdefault(t, []).append((col, kind))
        return out
    finally:
        c.close()


def _sqlite_type(declared: str) -> T.DataType:
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return T.StringType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    if "BOOL" in d:
        return T.BooleanType()
    return T.BinaryType() if "BLOB" in d else T.StringType()


class DatabaseSource(DataSource):
    """format("brindle_db") with options path and table."""

    @classmethod
    def name(cls) -> str:
        return "brindle_db"

    def schema(self):
        path, table = self.options["path"], self.options["table"]
        if kind_of(path) == "sqlite":
            return T.StructType([T.StructField(n, _sqlite_type(k)) for n, k in tables(path)[table]])
        from pyspark.sql.pandas.types import from_arrow_schema

        c = _duckdb().connect(path, read_only=True)
        try:
            got = c.execute(f"SELECT * FROM {_q(table)} LIMIT 0")
            found = (got.to_arrow_table if hasattr(got, "to_arrow_table") else got.fetch_arrow_table)().schema
            return from_arrow_schema(found, prefer_timestamp_ntz=True)
        finally:
            c.close()

    def reader(self, schema):
        return _Reader(self.options["path"], self.options["table"], schema)


class _Rows(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    """SQLite tables are read in ranges of row ids, one task each; the file must be visible to the executors."""

    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.schema = path, table, schema

    def partitions(self):
        if kind_of(self.path) != "sqlite":
            return [_Rows(None, None)]
        c = _sqlite(self.path)
        try:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_q(self.table)}").fetchone()
        except sqlite3.Error:  # a view, or a table without row ids
            return [_Rows(None, None)]
        finally:
            c.close()
        if low is None:
            return [_Rows(None, None)]
        return [_Rows(a, min(a + ROWS, high + 1)) for a in range(low, high + 1, ROWS)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        if kind_of(self.path) == "sqlite":
            c = _sqlite(self.path)
            try:
                where = "" if partition.low is None else f" WHERE rowid >= {partition.low} AND rowid < {partition.high}"
                fix = [self._fix(f.dataType) for f in self.schema.fields]
                for r in c.execute(f"SELECT * FROM {_q(self.table)}{where}"):
                    yield tuple(None if v is None else f(v) for f, v in zip(fix, r))
            finally:
                c.close()
            return
        c = _duckdb().connect(self.path, read_only=True)
        try:
            got = c.execute(f"SELECT * FROM {_q(self.table)}")
            while batch := got.fetchmany(10_000):
                yield from batch
        finally:
            c.close()

    @staticmethod
    def _fix(kind: T.DataType):
        """SQLite columns may hold any type: what doesn't convert is null."""

        def convert(f):
            def one(v):
                try:
                    return f(v)
                except (TypeError, ValueError):
                    return None

            return one

        return convert({"long": int, "double": float, "boolean": bool, "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}.get(kind.typeName(), lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)))


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(DatabaseSource)
    return spark.read.format("brindle_db").options(path=path, table=table).load()
