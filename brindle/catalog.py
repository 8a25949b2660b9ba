"""The session's tables: names, sources, renames; loading, reloading and saved projects."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators.search import quoted
from .sources import databases, delta, text, xlsx
from .sources.files import is_folder

FILE, DATABASE, QUERY, TRANSFORMED, PASTED = "file", "database", "query_result", "transformed", "clipboard"
EXTENSIONS = (".csv", ".txt", ".tsv", ".json", ".jsonl", ".parquet", ".orc", ".xlsx", ".xls", ".delta", ".sqlite", ".db", ".duckdb")
ALIAS = "db"
#: Changes of a table (INSERT, UPDATE, DELETE and the like) after which its rows are written.
CHANGES = 8


# Names of tables and columns follow these rules, so that saved statements find them.
def sanitize(name: str) -> str:
    """A table name: other characters become _, a leading non-letter gets the prefix table_, lower case."""
    out = re.sub(r"[^a-zA-Z0-9_]", "_", name)
    if not out or not out[0].isalpha():
        out = f"table_{out}"
    return out.lower()


def friendly(name: str) -> str:
    """A column name that needs no quotes."""
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", name.strip().lower())).strip("_") or "column"


def friendly_names(names: Iterable[str]) -> list[str]:
    """Friendly names, made unique by _1, _2 and so on."""
    out: list[str] = []
    for n in names:
        base = f = friendly(n)
        k = 1
        while f in out:
            f, k = f"{base}_{k}", k + 1
        out.append(f)
    return out


@dataclass
class Entry:
    name: str
    kind: str
    source: str = ""
    columns: list[str] = field(default_factory=list)
    renames: dict[str, str] = field(default_factory=dict)
    folder: str = ""
    df: DataFrame | None = None
    steps: int = 0  # changes since the rows were last written or read


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder (``spark.checkpoint.dir``; a temporary one only on a local master), so that plans don't grow with every change."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
        base = "file://" + tempfile.mkdtemp(prefix="brindle-")
    path = f"{base.rstrip('/')}/brindle-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Catalog:
    """Tables are temporary views over lazy plans; nothing is read until an action needs it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Entry] = {}
        self.attached: str | None = None

    # -- names ---------------------------------------------------------------
    def unique(self, name: str) -> str:
        base = out = sanitize(name)
        k = 1
        while out in self.tables:
            out, k = f"{base}_{k}", k + 1
        return out

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"no table {name}")
        return self.tables[name].df

    def columns(self, name: str) -> list[str]:
        entry = self.tables.get(name) or self.tables.get(name.lower())
        return list(entry.columns) if entry else self.spark.table(name).columns

    # -- registration --------------------------------------------------------
    def _put(self, entry: Entry, df: DataFrame) -> str:
        entry.df, entry.columns = df, df.columns
        df.createOrReplaceTempView(entry.name)
        self.tables[entry.name] = entry
        return entry.name

    def register(self, df: DataFrame, name: str, source: str = QUERY) -> str:
        """Under a sanitized, unique name."""
        return self._put(Entry(self.unique(name), source, source), df)

    def overwrite(self, name: str, df: DataFrame, source: str = TRANSFORMED) -> str:
        old = self.tables.get(name)
        steps = old.steps + 1 if old and old.df is not None else 0
        if steps >= CHANGES:
            df, steps = written(df), 0
        return self._put(Entry(name, source, old.source if old else source, renames=dict(old.renames) if old else {}, folder=old.folder if old else "", steps=steps), df)

    def read(self, path: str, **options) -> DataFrame:
        """A file, folder or pattern by its extension (in any case)."""
        low = path.lower().rstrip("/")
        folder = os.path.splitext(low)[1] in ("", ".parquet") and is_folder(self.spark, path)
        if low.endswith(".delta") or (folder and delta.is_delta(self.spark, path)):
            return delta.read_delta(self.spark, path, **options)
        ext = os.path.splitext(low)[1]
        if ext in (".csv", ".txt", ".tsv"):
            return text.read_delimited(self.spark, path, **options)
        if ext in (".xlsx", ".xls"):
            return xlsx.read_xlsx(self.spark, path, **options)
        if ext in (".json", ".jsonl"):
            first = text.head(self.spark, path).lstrip()[:1]
            return self.spark.read.option("multiLine", first == b"[").json(path)
        if ext == ".orc":
            return self.spark.read.orc(path)
        if ext == ".parquet" or folder or "*" in path:
            return self.spark.read.parquet(path)
        raise ValueError(f"unsupported file {path}; one of {', '.join(EXTENSIONS)}")

    def load(self, path: str, prefix: str = "", name: str | None = None, **options) -> str:
        """Register a file; an embedded database is attached with all its tables."""
        if os.path.splitext(path.lower())[1] in (".sqlite", ".db", ".duckdb"):
            self.attach(path)
            return ALIAS
        df = self.read(path, **options)
        base = name or os.path.splitext(os.path.basename(path.rstrip("/")))[0]
        return self._put(Entry(self.unique(f"{prefix}_{base}" if prefix else base), FILE, path), df)

    def load_many(self, paths: Iterable[str], prefix: str = "") -> list[str]:
        return [self.load(p, prefix) for p in paths]

    def load_lazily(self, name: str, path: str, renames: Mapping[str, str] | None = None) -> None:
        """Known by name and path; read when first used."""
        self.tables[name] = Entry(name, FILE, path, renames=dict(renames or {}))

    def ensure(self, names: Iterable[str]) -> None:
        """Read the tables among ``names`` that were registered lazily."""
        for n in names:
            e = self.tables.get(n) or self.tables.get(n.lower())
            if e is not None and e.df is None:
                self.reload(e.name)

    def from_text(self, pasted: str, name: str = "pasted_data") -> str:
        return self.register(text.parse_pasted(self.spark, pasted)[0], name, PASTED)

    # -- attached databases ---------------------------------------------------
    def attach(self, path: str) -> list[str]:
        """Tables of a database file, read-only, as <table> (if free) and db_<table>; one database at a time."""
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        if self.attached:
            self.detach()
        out = []
        for t in databases.tables(path):
            df = databases.read_table(self.spark, path, t)
            full = f"{ALIAS}_{sanitize(t)}"
            self._put(Entry(full, DATABASE, f"{path}::{t}"), df)
            if sanitize(t) not in self.tables:
                df.createOrReplaceTempView(sanitize(t))
            out.append(full)
        self.attached = path
        return out

    def detach(self) -> None:
        for name in [n for n, e in self.tables.items() if e.kind == DATABASE]:
            bare = name[len(ALIAS) + 1 :]
            if bare not in self.tables:
                self.spark.catalog.dropTempView(bare)
            self.remove(name)
        self.attached = None

    # -- upkeep -----------------------------------------------------------------
    def reload(self, name: str) -> str:
        """Read the source anew and replay renames; the old table stays if that fails."""
        e = self.tables[name]
        if e.kind == DATABASE:
            path, t = e.source.rsplit("::", 1)
            df = databases.read_table(self.spark, path, t)
        elif e.kind == FILE:
            if e.df is not None:
                self.spark.catalog.refreshByPath(e.source)
            df = self.read(e.source)
        else:
            raise ValueError(f"{name} has no file to reload from")
        for old, new in e.renames.items():
            if old in df.columns:
                df = df.withColumnRenamed(old, new)
        return self._put(e, df)

    def set_source(self, name: str, path: str) -> str:
        e = self.tables[name]
        df = self.read(path)
        e.kind, e.source = FILE, path
        return self._put(e, df)

    def rename(self, old: str, new: str) -> str:
        if old not in self.tables:
            raise ValueError(f"no table {old}")
        target = sanitize(new)
        if target in self.tables and target != old:
            raise ValueError(f"there is a table {target} already")
        e = self.tables.pop(old)
        self.spark.catalog.dropTempView(old)
        e.name = target
        return self._put(e, e.df) if e.df is not None else self.tables.setdefault(target, e).name

    def remove(self, *names: str) -> int:
        n = 0
        for name in names:
            if self.tables.pop(name, None) is not None:
                self.spark.catalog.dropTempView(name)
                n += 1
        return n

    def preview(self, name: str, limit: int = 5) -> DataFrame:
        self.ensure([name])
        return self[name].limit(limit)

    def types(self) -> dict[str, dict[str, str]]:
        """Columns of each table and their types; no type for tables that are not loaded yet."""
        return {n: {f.name: f.dataType.simpleString() for f in e.df.schema} if e.df is not None else dict.fromkeys(e.columns, "") for n, e in self.tables.items()}

    # -- columns ----------------------------------------------------------------
    def rename_column(self, table: str, old: str, new: str) -> None:
        df = self[table]
        if old not in df.columns:
            raise ValueError(f"no column {old}")
        if new in df.columns:
            raise ValueError(f"there is a column {new} already")
        e = self.tables[table]
        original = next((k for k, v in e.renames.items() if v == old), old)
        e.renames[original] = new
        self._put(e, df.withColumnRenamed(old, new))

    def delete_column(self, table: str, column: str) -> None:
        df = self[table]
        if column not in df.columns:
            raise ValueError(f"no column {column}")
        self._put(self.tables[table], df.select(*(quoted(c) for c in df.columns if c != column)))

    def to_friendly_names(self, table: str) -> str:
        """A transformed copy <table>_transformed_<hash> with friendly column names."""
        df = self[table]
        names = friendly_names(df.columns)
        mark = hashlib.md5(json.dumps([table, sorted(names)]).encode()).hexdigest()[:8]
        return self.register(df.toDF(*names), f"{table}_transformed_{mark}", TRANSFORMED)

    # -- projects ---------------------------------------------------------------
    def save_project(self, path: str, tabs: list[dict] | None = None) -> None:
        state = {
            "version": 1,
            "tabs": tabs or [],
            "tables": {n: {"kind": e.kind, "source": e.source, "columns": e.columns, "folder": e.folder, "renames": e.renames} for n, e in self.tables.items() if e.kind in (FILE, DATABASE)},
            "database": self.attached,
        }
        aside = f"{path}.part"
        with open(aside, "w", encoding="utf-8") as f:
            json.dump(state, f, indent=2, sort_keys=True)
        os.replace(aside, path)

    def open_project(self, path: str) -> list[dict]:
        """Replaces the tables; files are registered without being read. Returns the tabs."""
        with open(path, encoding="utf-8") as f:
            state = json.load(f)
        self.remove(*list(self.tables))
        if state.get("database") and os.path.exists(state["database"]):
            self.attach(state["database"])
        for n, t in state["tables"].items():
            if t["kind"] == FILE:
                self.load_lazily(n, t["source"], t.get("renames"))
                self.tables[n].columns, self.tables[n].folder = t.get("columns", []), t.get("folder", "")
        return state.get("tabs", [])
