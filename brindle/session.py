"""A session: SQL scripts in the workbench's dialect over the catalog's tables, lazily."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, friendly_names, sanitize
from .functions import completion, reference
from .operators.search import quoted
from .plans import dialect
from .plans.statements import Token, significant, split_statements, statement_at, table_names
from .sources import sinks

HISTORY = 100
#: Tables of the sample folders.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass
class Result:
    """One statement's outcome: a lazy DataFrame (None for statements without rows), lineage, or an error."""

    statement: str
    df: DataFrame | None = None
    tables: list[str] = field(default_factory=list)
    error: Exception | None = None


class Session:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.catalog = Catalog(spark)
        self.current: Result | None = None
        self.history: list[str] = []
        self._context = dialect.Context(self.catalog.columns, self._files, self._typed_columns)

    @classmethod
    def over(cls, spark: SparkSession, folder: str) -> Session:
        """Every <name>.parquet of a folder as a table <name>, read when first used."""
        s = cls(spark)
        for name in TABLES:
            s.catalog.load_lazily(name, f"{folder}/{name}.parquet")
        return s

    def table(self, name: str) -> DataFrame:
        self.catalog.ensure([name])
        return self.catalog[name]

    def _typed_columns(self, sql: str) -> list[tuple[str, str]]:
        """Names and types of a query's columns; analysed, not run."""
        return [(f.name, f.dataType.simpleString()) for f in self.spark.sql(sql).schema]

    def _files(self, kind: str, paths: list[str]) -> str:
        dfs = [self.catalog.read(p) if kind == "csv" else (self.spark.read.json(p) if kind == "json" else self.spark.read.parquet(p)) for p in paths]
        df = dfs[0]
        for d in dfs[1:]:
            df = df.unionByName(d, allowMissingColumns=True)
        return self.catalog.register(df, f"read_{kind}")

    # -- scripts -----------------------------------------------------------------
    def sql(self, statement: str) -> DataFrame | None:
        """Run one statement; queries come back lazy. Syntax errors raise SyntaxError, unknown tables and columns ValueError."""
        statement = statement.strip().rstrip(";").strip()
        self.history = [*self.history[-HISTORY + 1 :], statement]
        names = table_names(statement)
        try:
            self.catalog.ensure(n.split(".")[-1] for n in names)
            df = self._run(statement)
        except ParseException as e:
            raise SyntaxError(str(e).split("\n\n")[0]) from e
        except AnalysisException as e:
            raise ValueError(str(e).split("\n\n")[0]) from e
        self.current = Result(statement, df, names)
        return df

    def run_all(self, script: str) -> list[Result]:
        """Every statement in order; an error doesn't stop those after it."""
        out = []
        for s in split_statements(script):
            try:
                out.append(Result(s.text, self.sql(s.text), table_names(s.text)))
            except Exception as e:
                out.append(Result(s.text, None, table_names(s.text), e))
        return out

    def run_at(self, script: str, position: int) -> DataFrame | None:
        s = statement_at(script, position)
        if s is None:
            raise ValueError("no statement there")
        return self.sql(s.text)

    def _query(self, sql: str) -> DataFrame:
        return self.spark.sql(dialect.to_spark(sql, self._context))

    def _condition(self, text: str):
        return F.expr(dialect.expression_to_spark(text, self._context))

    # -- statements that aren't queries ---------------------------------------------
    def _run(self, sql: str) -> DataFrame | None:
        ts = significant(sql)
        if not ts:
            raise SyntaxError("empty statement")
        handler = {"INSERT": self._insert, "UPDATE": self._update, "DELETE": self._delete, "CREATE": self._create, "ALTER": self._alter, "DROP": self._drop, "COPY": self._copy, "PIVOT": self._pivot, "UNPIVOT": self._unpivot, "DESCRIBE": self._describe, "SHOW": self._show}.get(ts[0].word)
        return handler(sql, ts) if handler else self._query(sql)

    def _own(self, t: Token) -> str:
        name = t.text.strip('"`')
        name = name if name in self.catalog else name.lower()
        if name not in self.catalog:
            raise ValueError(f"no table {t.text}")
        self.catalog.ensure([name])
        if self.catalog.tables[name].kind == "database":
            raise ValueError("attached databases are read-only")
        return name

    @staticmethod
    def _at(ts: list[Token], *words: str) -> int | None:
        depth = 0
        for i, t in enumerate(ts):
            depth += (t.text in "([") - (t.text in ")]") if t.kind == "op" else 0
            if depth == 0 and t.word in words:
                return i
        return None

    def _insert(self, sql: str, ts: list[Token]) -> None:
        name = self._own(ts[2])
        old, i, cols = self.catalog[name], 3, None
        if ts[3].text == "(":
            j = dialect._close(ts, 3)
            cols, i = [t.text.strip('"') for t in ts[4:j] if t.text != ","], j + 1
        new = self._query(sql[ts[i].start :])
        cols = cols or old.columns[: len(new.columns)]
        if len(cols) != len(new.columns):
            raise ValueError(f"{len(cols)} columns are named, {len(new.columns)} given")
        new = new.toDF(*cols)
        rows = new.select(*((quoted(f.name) if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema.fields))
        self.catalog.overwrite(name, old.unionByName(rows))

    def _update(self, sql: str, ts: list[Token]) -> None:
        name, set_, where = self._own(ts[1]), self._at(ts, "SET"), self._at(ts, "WHERE")
        df = self.catalog[name]
        hit = self._condition(sql[ts[where + 1].start :]) if where else F.lit(True)
        changes = {}
        for item in dialect._commas(ts[set_ + 1 : where]):
            column = item[0].text.strip('"')
            value = sql[item[2].start : item[-1].start + len(item[-1].text)]
            match = next((c for c in df.columns if c.lower() == column.lower()), None)
            if match is None:
                raise ValueError(f"no column {column}")
            changes[match] = F.when(F.coalesce(hit, F.lit(False)), self._condition(value)).otherwise(quoted(match)).cast(df.schema[match].dataType)
        self.catalog.overwrite(name, df.select(*(changes[c].alias(c) if c in changes else quoted(c) for c in df.columns)))

    def _delete(self, sql: str, ts: list[Token]) -> None:
        name, where = self._own(ts[2]), self._at(ts, "WHERE")
        df = self.catalog[name]
        hit = self._condition(sql[ts[where + 1].start :]) if where else F.lit(True)
        self.catalog.overwrite(name, df.where(~F.coalesce(hit, F.lit(False))))

    def _create(self, sql: str, ts: list[Token]) -> None:
        words = [t.word for t in ts]
        i = next(k for k, w in enumerate(words) if w in ("TABLE", "VIEW"))
        replace = "REPLACE" in words[:i]
        i += 1
        quiet = words[i : i + 3] == ["IF", "NOT", "EXISTS"]
        i += 3 * quiet
        name = sanitize(ts[i].text.strip('"'))
        if name in self.catalog and not replace:
            if quiet:
                return
            raise ValueError(f"there is a table {name} already")
        as_ = self._at(ts, "AS")
        if as_ is not None:
            df = self._query(sql[ts[as_ + 1].start :])
        else:
            j = dialect._close(ts, i + 1)
            columns = []
            for item in dialect._commas(ts[i + 2 : j]):
                if item[0].word in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
                    continue
                end = next((k for k, t in enumerate(item) if k > 1 and t.word in ("PRIMARY", "UNIQUE", "NOT", "NULL", "DEFAULT", "CHECK", "REFERENCES")), len(item))
                kind = dialect._TYPES.get(item[1].word, "".join(t.text for t in item[1:end]))
                columns.append(f"`{item[0].text.strip(chr(34))}` {kind}")
            df = self.spark.createDataFrame([], ", ".join(columns))
        self.catalog.overwrite(name, df, "query_result")

    def _alter(self, sql: str, ts: list[Token]) -> None:
        name, words = self._own(ts[2]), [t.word for t in ts]
        df, rest = self.catalog[name], ts[3:]
        if words[3] == "RENAME" and words[4] == "TO":
            self.catalog.rename(name, ts[5].text.strip('"'))
            return
        skip = 1 + (rest[1].word == "COLUMN")
        skip += 2 * (len(rest) > skip + 1 and rest[skip].word == "IF")
        column = rest[skip].text.strip('"')
        if words[3] == "RENAME":
            self.catalog.rename_column(name, column, rest[skip + 2].text.strip('"'))
        elif words[3] == "DROP":
            self.catalog.delete_column(name, column)
        elif words[3] == "ADD":
            at = self._at(ts, "DEFAULT")
            kind = dialect._TYPES.get(rest[skip + 1].word, rest[skip + 1].text)
            value = self._condition(sql[ts[at + 1].start :]) if at else F.lit(None)
            self.catalog.overwrite(name, df.withColumn(column, value.cast(kind)))
        elif words[3] == "ALTER":
            kind = next(t for t in reversed(ts) if t.kind == "word").word
            self.catalog.overwrite(name, df.withColumn(column, quoted(column).cast(dialect._TYPES.get(kind, kind))))
        else:
            raise dialect.Unsupported(sql)

    def _drop(self, sql: str, ts: list[Token]) -> None:
        quiet = ts[2].word == "IF"
        name = ts[-1].text.strip('"')
        name = name if name in self.catalog else name.lower()
        if not self.catalog.remove(name) and not quiet:
            raise ValueError(f"no table {name}")

    def _copy(self, sql: str, ts: list[Token]) -> None:
        to = self._at(ts, "TO")
        source = ts[1:to]
        df = self._query(sql[source[1].start : source[-1].start]) if source[0].text == "(" else self.table(self._any(source[0]))
        path = ts[to + 1].text[1:-1].replace("''", "'")
        options = " ".join(t.text for t in ts[to + 2 :])
        kind = re.search(r"FORMAT\s+'?(\w+)", options, re.I)
        sinks.export(df, path, kind[1].lower() if kind else None)

    def _any(self, t: Token) -> str:
        name = t.text.strip('"`')
        return name if name in self.catalog else name.lower()

    def _pivot(self, sql: str, ts: list[Token]) -> DataFrame:
        """PIVOT table ON column [IN (values)] USING aggregate [AS name] [GROUP BY columns]."""
        df = self.table(self._any(ts[1]))
        on, using, group = self._at(ts, "ON"), self._at(ts, "USING"), self._at(ts, "GROUP")
        column = ts[on + 1].text.strip('"')
        values = None
        if ts[on + 2].word == "IN":
            j = dialect._close(ts, on + 3)
            values = [t.text.strip("'") if t.kind == "string" else float(t.text) if "." in t.text else int(t.text) for t in ts[on + 4 : j] if t.kind in ("string", "number")]
        end = ts[group].start if group else len(sql)
        aggregate = self._condition(sql[ts[using + 1].start : end])
        used = {t.text.strip('"').lower() for t in ts[using + 1 : group]}
        keys = [t.text.strip('"') for t in ts[group + 2 :] if t.kind in ("word", "quoted")] if group else [c for c in df.columns if c != column and c.lower() not in used]
        return df.groupBy(*map(quoted, keys)).pivot(column, values).agg(aggregate)

    def _unpivot(self, sql: str, ts: list[Token]) -> DataFrame:
        """UNPIVOT table ON columns [INTO NAME n VALUE v]."""
        df = self.table(self._any(ts[1]))
        on, into = self._at(ts, "ON"), self._at(ts, "INTO")
        columns = [t.text.strip('"') for t in ts[on + 1 : into] if t.kind in ("word", "quoted")]
        name, value = (ts[into + 2].text, ts[into + 4].text) if into else ("name", "value")
        rest = [c for c in df.columns if c not in columns]
        out = df.unpivot([quoted(c) for c in rest], [quoted(c) for c in columns], name, value)
        return out.where(quoted(value).isNotNull())

    def _describe(self, sql: str, ts: list[Token]) -> DataFrame:
        df = self.table(self._any(ts[1])) if len(ts) == 2 else self._query(sql[ts[1].start :])
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "column_name string, column_type string, nullable boolean")

    def _show(self, sql: str, ts: list[Token]) -> DataFrame:
        rows = [(n, e.kind, e.source) for n, e in sorted(self.catalog.tables.items())]
        return self.spark.createDataFrame(rows, "name string, kind string, source string")

    def friendly_result(self) -> str:
        """The current result with friendly column names, as a table query_result_<hash>."""
        if self.current is None or self.current.df is None:
            raise ValueError("no result to convert")
        df = self.current.df
        mark = hashlib.md5(self.current.statement.encode()).hexdigest()[:8]
        return self.catalog.register(df.toDF(*friendly_names(df.columns)), f"query_result_{mark}", "transformed")

    def completions(self, sql: str, position: int | None = None, limit: int = 20) -> list[str]:
        """What may stand at a position of a statement (its end), best first; words used often come before others."""
        usage = sum((completion.terms(x) for x in self.history), Counter())
        names = tuple(e[0] for e in reference.entries())
        return [x for x, _ in completion.suggest(sql, position, self.catalog.types(), usage, names, limit)]

    # -- results ------------------------------------------------------------------
    def save_result(self, path: str, name: str | None = None) -> str:
        """Write the current result as Parquet and register the file as a table."""
        if self.current is None or self.current.df is None:
            raise ValueError("no result to save")
        return self.export(self.current.df, path, name)

    def export(self, df: DataFrame, path: str, name: str | None = None) -> str:
        """Write a table in the format of the path's extension and register the file."""
        sinks.export(df, path)
        return self.catalog.load(path, name=name or os.path.splitext(os.path.basename(path))[0])
