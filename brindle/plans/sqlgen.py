"""Generators: column snippets, join and set-operation builders (as SQL text and as DataFrames), drill-down."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import quoted
from .statements import significant, table_names

JOIN_TYPES = ("INNER", "LEFT", "RIGHT", "FULL")
SET_OPERATIONS = ("UNION", "UNION ALL", "EXCEPT", "INTERSECT")


def name(identifier: str) -> str:
    """An identifier, quoted where it isn't a plain word."""
    return identifier if re.fullmatch(r"[A-Za-z_]\w*", identifier) else '"' + identifier.replace('"', '""') + '"'


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


# -- column snippets ---------------------------------------------------------
def distinct_values(column: str, table: str) -> str:
    return f"SELECT DISTINCT {name(column)} FROM {name(table)} ORDER BY 1"


def count_distinct(column: str, table: str) -> str:
    return f"SELECT COUNT(DISTINCT {name(column)}) AS {name('distinct_' + column)} FROM {name(table)}"


def value_counts(column: str, table: str) -> str:
    return f"SELECT {name(column)}, COUNT(*) AS count FROM {name(table)} GROUP BY {name(column)} ORDER BY count DESC"


def select_column(column: str, table: str) -> str:
    return f"SELECT {name(column)} FROM {name(table)}"


def select_all(table: str) -> str:
    return f"SELECT * FROM {name(table)}"


def _clause(sql: str, word: str) -> int | None:
    """Where a top-level clause begins."""
    depth = 0
    for t in significant(sql):
        depth += (t.text in "([") - (t.text in ")]") if t.kind == "op" else 0
        if depth == 0 and t.word == word:
            return t.start
    return None


def where_equals(column: str, value: object, sql: str = "", table: str | None = None) -> str:
    """Adds a condition to a query: AND to its WHERE, or a WHERE of its own before GROUP, ORDER or LIMIT."""
    condition = f"{name(column)} IS NULL" if value is None else f"{name(column)} = {literal(value)}"
    sql = sql.rstrip().rstrip(";")
    if not sql:
        return f"SELECT * FROM {name(table or '[table_name]')} WHERE {condition}" if table else f"WHERE {condition}"
    at = min((p for w in ("GROUP", "HAVING", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "UNION") if (p := _clause(sql, w)) is not None), default=len(sql))
    link = "AND" if _clause(sql, "WHERE") is not None else "WHERE"
    return f"{sql[:at].rstrip()} {link} {condition} {sql[at:]}".rstrip()


def add_column(sql: str, column: str) -> str:
    """Adds a column to the select list; ``*`` gives way to it."""
    begin, end = _clause(sql, "SELECT"), _clause(sql, "FROM")
    if begin is None:
        return f"{sql.rstrip()} {name(column)}".strip()
    head = begin + len("SELECT")
    listed = sql[head : end if end is not None else len(sql)].strip()
    if name(column) in [x.strip() for x in listed.split(",")]:
        return sql
    new = name(column) if listed in ("", "*") else f"{listed}, {name(column)}"
    return f"{sql[:head]} {new} {sql[end:] if end is not None else ''}".rstrip()


def table_of(selection: str = "", lineage: str | None = None, sql: str = "") -> str:
    """The table a snippet is for: a selected word, the result's lineage, the first table of the query, else a placeholder."""
    if re.fullmatch(r"[A-Za-z_][\w.]*", selection.strip()):
        return selection.strip()
    return lineage or next(iter(table_names(sql)), "[table_name]")


def drill_down(table: str, column: str, feature: str, value: str | None = None) -> str:
    """Rows behind a flag: has_x -> the text contains x (in any case, as the flag does), is_x -> equals x."""
    word = value if value is not None else feature.split("_", 1)[-1]
    if feature.startswith("has_"):
        escaped = word.lower().replace("'", "''")
        return f"SELECT * FROM {name(table)} WHERE contains(lower({name(column)}), '{escaped}')"
    return f"SELECT * FROM {name(table)} WHERE {name(column)} = {literal(word)}"


# -- joins -------------------------------------------------------------------
@dataclass(frozen=True)
class Relationship:
    from_table: str
    from_column: str
    to_table: str
    to_column: str
    confidence: float


def _singular(table: str) -> str:
    t = table.lower()
    for end, new in (("ies", "y"), ("es", ""), ("s", "")):
        if t.endswith(end) and len(t) > len(end):
            return t[: -len(end)] + new
    return t


def names_match(table: str, prefix: str) -> bool:
    """A table's name and a column's prefix are equal, or one begins or ends with the other, in singular or plural."""
    a = {table.lower(), _singular(table), table.lower().rstrip("s")}
    b = {prefix.lower(), _singular(prefix), prefix.lower().rstrip("s")}
    return any(x and y and (x == y or x.startswith(y) or x.endswith(y) or y.startswith(x) or y.endswith(x)) for x in a for y in b)


def infer_relationships(columns: Mapping[str, Sequence[str]]) -> list[Relationship]:
    """From names only: <table>_id to its id (0.9), <table>id (0.85), equal names (0.8 with id or key in them, else 0.6)."""
    best: dict[tuple[str, str, str, str], Relationship] = {}

    def add(r: Relationship) -> None:
        k = (r.from_table, r.from_column, r.to_table, r.to_column)
        if k not in best or best[k].confidence < r.confidence:
            best[k] = r

    tables = list(columns)
    for t in tables:
        for c in columns[t]:
            low = c.lower()
            for o in tables:
                if o == t:
                    continue
                ident = next((x for x in columns[o] if x.lower() == "id"), None)
                if low.endswith("_id") and ident and names_match(o, low[:-3]):
                    add(Relationship(t, c, o, ident, 0.9))
                elif low.endswith("id") and len(low) > 2 and not low.endswith("_id") and ident and names_match(o, low[:-2]):
                    add(Relationship(t, c, o, ident, 0.85))
    for i, t in enumerate(tables):
        for o in tables[i + 1 :]:
            others = {x.lower(): x for x in columns[o]}
            for c in columns[t]:
                if c.lower() in others:
                    add(Relationship(t, c, o, others[c.lower()], 0.8 if "id" in c.lower() or "key" in c.lower() else 0.6))
    return sorted(best.values(), key=lambda r: (-r.confidence, tables.index(r.from_table), r.from_column, r.to_table))


@dataclass(frozen=True)
class JoinStep:
    """A table to join by ``left_table.left_column = table.column``; without columns, a cross join."""

    table: str
    left_table: str | None = None
    left_column: str | None = None
    column: str | None = None


def join_plan(tables: Sequence[str], relationships: Sequence[Relationship]) -> list[JoinStep]:
    """Starts at the first table and attaches the remaining one of highest confidence each time."""
    graph: dict[tuple[str, str], tuple[float, str, str]] = {}
    for r in relationships:
        for a, ac, b, bc in ((r.from_table, r.from_column, r.to_table, r.to_column), (r.to_table, r.to_column, r.from_table, r.from_column)):
            if (a, b) not in graph or graph[a, b][0] < r.confidence:
                graph[a, b] = (r.confidence, ac, bc)
    done, left, steps = [tables[0]], list(tables[1:]), []
    while left:
        options = [(graph[a, b][0], -left.index(b), -done.index(a), a, b) for a in done for b in left if (a, b) in graph]
        if options:
            _, _, _, a, b = max(options)
            _, ac, bc = graph[a, b]
            steps.append(JoinStep(b, a, ac, bc))
        else:
            b = left[0]
            steps.append(JoinStep(b))
        done.append(b)
        left.remove(b)
    return steps


def _kind(join_type: str, tables: Sequence[str], relationships: Sequence[Relationship]) -> str:
    kind = join_type.upper().replace(" OUTER", "").replace("OUTER", "FULL").strip()
    if kind not in JOIN_TYPES:
        raise ValueError(f"unknown join type {join_type}; one of {', '.join(JOIN_TYPES)}")
    if len(tables) < 2:
        raise ValueError("a join needs at least two tables")
    if not relationships:
        raise ValueError("no relationship between the tables was found")
    return kind


def join_sql(columns: Mapping[str, Sequence[str]], join_type: str = "INNER", relationships: Sequence[Relationship] | None = None) -> str:
    """SELECT of all columns as "<table>_<column>" over a chain of joins."""
    tables = list(columns)
    relationships = infer_relationships(columns) if relationships is None else relationships
    kind = _kind(join_type, tables, relationships)
    steps = join_plan(tables, relationships)
    items = [f'    {name(t)}.{name(c)} AS "{t}_{c}"' for t in [tables[0], *(s.table for s in steps)] for c in columns[t]]
    lines = ["SELECT", ",\n".join(items), f"FROM {name(tables[0])}"]
    for s in steps:
        if s.column is None:
            lines.append(f"CROSS JOIN {name(s.table)}")
        else:
            lines.append(f"{kind} JOIN {name(s.table)} ON {name(s.left_table)}.{name(s.left_column)} = {name(s.table)}.{name(s.column)}")
    return "\n".join(lines)


def join_tables(dfs: Mapping[str, DataFrame], join_type: str = "INNER", relationships: Sequence[Relationship] | None = None) -> DataFrame:
    """The same as a DataFrame; Catalyst picks each join's strategy from the sizes."""
    columns = {t: d.columns for t, d in dfs.items()}
    relationships = infer_relationships(columns) if relationships is None else relationships
    kind = _kind(join_type, list(dfs), relationships)
    named = {t: d.select(*(quoted(c).alias(f"{t}_{c}") for c in d.columns)) for t, d in dfs.items()}
    out = named[next(iter(dfs))]
    for s in join_plan(list(dfs), relationships):
        right = named[s.table]
        if s.column is None:
            out = out.crossJoin(right)
        else:
            out = out.join(right, quoted(f"{s.left_table}_{s.left_column}") == quoted(f"{s.table}_{s.column}"), kind.lower())
    return out


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), *, right_on: str | None = None, how: str = "left", suffix: str = "_right", allow_exact: bool = True) -> DataFrame:
    """Each left row with the last right row at or before it (within equal ``by``).

    Both sides are united and the last right row is carried forward in one window, so the cost is
    one shuffle and sort whatever the number of matches. Without ``by``, time ranges would all
    meet in one task; give a key.
    """
    right_on = right_on or on
    if not by:
        raise ValueError("an as-of join needs a key to be dealt by")
    from pyspark.sql import Window

    names = [c for c in right.columns if c not in by]
    payload = F.struct(*(quoted(c).alias(c) for c in names))
    a = left.select(*(quoted(b).alias(f"_b{i}") for i, b in enumerate(by)), quoted(on).alias("_t"), F.lit(1 if allow_exact else 0).alias("_side"), F.struct(*(quoted(c) for c in left.columns)).alias("_l"))
    b = right.select(*(quoted(x).alias(f"_b{i}") for i, x in enumerate(by)), quoted(right_on).alias("_t"), F.lit(0 if allow_exact else 1).alias("_side"), payload.alias("_r")).where("_t is not null")
    both = a.unionByName(b, allowMissingColumns=True)
    upto = Window.partitionBy(*(f"_b{i}" for i in range(len(by)))).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = both.withColumn("_m", F.last("_r", ignorenulls=True).over(upto)).where("_l is not null")
    if how == "inner":
        got = got.where("_m is not null")
    return got.select(*(F.col("_l").getField(c).alias(c) for c in left.columns), *(F.col("_m").getField(c).alias(c if c not in left.columns else c + suffix) for c in names))


# -- set operations ----------------------------------------------------------
def common_columns(columns: Mapping[str, Sequence[str]]) -> list[str]:
    """Columns by exact name in all tables, in the first one's order."""
    lists = list(columns.values())
    return [c for c in lists[0] if all(c in x for x in lists[1:])] if lists else []


def _set_columns(columns: Mapping[str, Sequence[str]], operation: str, chosen: Sequence[str] | None) -> list[str]:
    if len(columns) < 2:
        raise ValueError("a set operation needs at least two tables")
    if operation.upper() not in SET_OPERATIONS:
        raise ValueError(f"unknown operation {operation}; one of {', '.join(SET_OPERATIONS)}")
    got = list(chosen or common_columns(columns))
    if not got:
        raise ValueError("the tables have no column in common")
    return got


def set_sql(columns: Mapping[str, Sequence[str]], operation: str = "UNION", chosen: Sequence[str] | None = None) -> str:
    """The operation over the common (or chosen) columns of all tables, left to right."""
    listed = ", ".join(map(name, _set_columns(columns, operation, chosen)))
    return f"\n{operation.upper()}\n".join(f"SELECT {listed} FROM {name(t)}" for t in columns)


def set_tables(dfs: Mapping[str, DataFrame], operation: str = "UNION", chosen: Sequence[str] | None = None) -> DataFrame:
    cols = _set_columns({t: d.columns for t, d in dfs.items()}, operation, chosen)
    parts = [d.select(*map(quoted, cols)) for d in dfs.values()]
    step = {"UNION ALL": lambda a, b: a.unionByName(b), "UNION": lambda a, b: a.unionByName(b).distinct(), "EXCEPT": lambda a, b: a.subtract(b), "INTERSECT": lambda a, b: a.intersect(b)}[operation.upper()]
    return reduce(step, parts)
