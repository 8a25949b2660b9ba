"""Foreign keys, inclusion dependencies and referential integrity over several tables, on all rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import quoted

# By these parts of names results stay those that users know. A name looks like an identifier if
# it ends in one of ID_ENDS or begins with one of ID_BEGINNINGS; NOT_REFERENCES anywhere in a name rule it out as a reference.
ID_ENDS = ("id", "key", "code", "ref", "num", "number")
ID_BEGINNINGS = ("id", "key")
NOT_REFERENCES = (
    "quantity", "amount", "price", "cost", "total", "sum", "count", "rate", "percent", "ratio", "score", "weight",
    "length", "width", "height", "size", "age", "year", "month", "day", "time", "date", "timestamp",
    "name", "title", "description", "text", "comment", "note", "email", "phone", "address", "city", "state", "country",
)
EDGES = "fk_table string, fk_column string, pk_table string, pk_column string, match_ratio double, score double, matched bigint, distinct_values bigint"


def id_like(name: str) -> bool:
    return name.lower().endswith(ID_ENDS) or name.lower().startswith(ID_BEGINNINGS)


def may_refer(name: str) -> bool:
    return not any(part in name.lower() for part in NOT_REFERENCES)


def _stem(name: str) -> str:
    return re.sub(f"_?({'|'.join(ID_ENDS)})$", "", name)


def name_similarity(a: str, b: str) -> float:
    """1 for equal names, else 0.8 if one holds the other, else 0.9 for equal stems, else 0.6 if one stem holds the other (an empty one is in all), else 0."""
    x, y = a.lower(), b.lower()
    p, q = _stem(x), _stem(y)
    rules = ((x == y, 1.0), (x in y or y in x, 0.8), (p == q != "", 0.9), (p in q or q in p, 0.6))
    return next((value for holds, value in rules if holds), 0.0)


def _kind(df: DataFrame, c: str) -> str:
    k = df.schema[c].dataType.simpleString()
    return "bigint" if k in ("tinyint", "smallint", "int", "bigint") else k


def _facts(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """rows and non-null rows of each column: one pass a table."""
    row = df.agg(F.count("*").alias("n"), *(F.count(quoted(c)).alias(f"v{i}") for i, c in enumerate(columns))).first()
    return {c: (row["n"], row[f"v{i}"]) for i, c in enumerate(columns)}


def shared_values(dfs: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]]) -> dict[tuple[int, int], int]:
    """How many distinct non-null values each pair of ``columns`` (table, column) of one type shares, by their places; a column with itself: how many it has.

    One shuffle by value serves all columns of a type: values become sets of columns, equal sets are
    counted, and only the counts of pairs, at most the square of the number of columns, are collected.
    """
    kinds: dict[str, dict[str, list[int]]] = {}
    for i, (t, c) in enumerate(columns):
        kinds.setdefault(_kind(dfs[t], c), {}).setdefault(t, []).append(i)
    out: dict[tuple[int, int], int] = {}
    for kind, tables in kinds.items():
        parts = [dfs[t].select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), quoted(columns[i][1]).cast(kind).alias("v")) for i in places))).alias("x")).select("x.c", "x.v") for t, places in tables.items()]
        values = reduce(DataFrame.union, parts).where("v is not null").groupBy("v").agg(F.sort_array(F.collect_set("c")).alias("c"))
        sets = values.groupBy("c").agg(F.count("*").alias("n"))
        pairs = sets.select(F.explode("c").alias("a"), "c", "n").select("a", F.explode("c").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))
        out |= {(r.a, r.b): r.n for r in pairs.collect()}
    return out


def _find(dfs: Mapping[str, DataFrame], *, unique: bool, ratio: float, threshold: float, penalty: float) -> DataFrame:
    spark = next(iter(dfs.values())).sparkSession
    columns = [(t, c) for t, d in dfs.items() for c in d.columns if id_like(c) or may_refer(c)]
    facts = {(t, c): f for t in dfs for c, f in _facts(dfs[t], [c for u, c in columns if u == t]).items()}
    shared = shared_values(dfs, columns)
    out = []
    for (f, p), matched in shared.items():
        (ft, fk), (pt, pk) = columns[f], columns[p]
        have, asked = shared[p, p], shared[f, f]
        if ft == pt or not id_like(pk) or not may_refer(fk) or asked > have or (unique and facts[pt, pk] != (have, have)):
            continue
        similar = name_similarity(pk, fk)
        score = matched / asked + 0.3 * similar * (similar > 0.5) + 0.1 * id_like(fk) - penalty * (asked / facts[ft, fk][0] > 0.5)
        if matched / asked >= ratio and score >= threshold:
            out.append((ft, fk, pt, pk, matched / asked, score, matched, asked))
    return spark.createDataFrame(out, EDGES).orderBy(F.desc("match_ratio"), F.desc("score"), "fk_table", "fk_column", "pk_table", "pk_column")


def find_foreign_keys(dfs: Mapping[str, DataFrame], min_match_ratio: float = 0.95) -> DataFrame:
    """References to unique, non-null, id-like columns: at least 0.9 of the distinct values match, and the score (with bonuses for names, less 0.2 for nearly unique columns) reaches ``min_match_ratio``."""
    return _find(dfs, unique=True, ratio=0.9, threshold=min_match_ratio, penalty=0.2)


def find_inclusion_dependencies(dfs: Mapping[str, DataFrame], min_match_ratio: float = 0.8) -> DataFrame:
    """The same for id-like columns that need not be unique, from a ratio of 0.85."""
    return _find(dfs, unique=False, ratio=0.85, threshold=min_match_ratio, penalty=0.0)


def referential_integrity(child: DataFrame, fk: str, parent: DataFrame, pk: str, examples: int = 10) -> DataFrame:
    """One row: non-null rows, distinct violating values, their ratio to the rows, and the least few as examples."""
    values = child.select(quoted(fk).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    parents = parent.select(quoted(pk).alias("v"), F.lit(True).alias("ok")).where("v is not null").distinct()
    marked = values.join(parents, "v", "left")
    sums = marked.agg(F.sum("n").alias("fk_rows"), F.count(F.when(F.col("ok").isNull(), 1)).alias("violations"), F.coalesce(F.sum(F.when(F.col("ok").isNull(), F.col("n"))), F.lit(0)).alias("violating_rows"))
    few = marked.where("ok is null").orderBy("v").limit(examples).agg(F.sort_array(F.collect_list(F.col("v").cast("string"))).alias("examples"))
    return sums.join(F.broadcast(few)).select(F.coalesce("fk_rows", F.lit(0)).alias("fk_rows"), "violations", F.when(F.col("fk_rows") > 0, F.col("violations") / F.col("fk_rows")).otherwise(F.lit(0.0)).alias("violation_ratio"), "violating_rows", "examples")


def _name(x: str) -> str:
    return x if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", x) else '"' + x.replace('"', '""') + '"'


def join_sql(edge, *, keep_all: bool = False) -> str:
    """SQL that follows a found reference (a row of EDGES); ``keep_all`` keeps rows whose reference leads nowhere."""
    ft, fc, pt, pc = (_name(edge[k]) for k in ("fk_table", "fk_column", "pk_table", "pk_column"))
    return f"SELECT * FROM {ft} {'LEFT JOIN' if keep_all else 'JOIN'} {pt} ON {ft}.{fc} = {pt}.{pc}"


def join_reference(dfs: Mapping[str, DataFrame], edge, *, keep_all: bool = False) -> DataFrame:
    """The rows of that SQL; columns that both tables have are prefixed by the table."""
    child, parent = dfs[edge["fk_table"]], dfs[edge["pk_table"]]
    both = set(child.columns) & set(parent.columns)
    side = lambda df, t, a: [F.col(f"{a}.`{c}`").alias(f"{t}_{c}" if c in both else c) for c in df.columns]
    on = F.col(f"f.`{edge['fk_column']}`") == F.col(f"p.`{edge['pk_column']}`")
    return child.alias("f").join(parent.alias("p"), on, "left" if keep_all else "inner").select(*side(child, edge["fk_table"], "f"), *side(parent, edge["pk_table"], "p"))


def profile(dfs: Mapping[str, DataFrame] | Sequence[DataFrame], min_match_ratio: float = 0.95) -> dict:
    """Foreign keys, inclusion dependencies (at 0.8 of the ratio) and the integrity of each foreign key. Empty tables are left out."""
    tables = dict(dfs) if isinstance(dfs, Mapping) else {f"table{i}": d for i, d in enumerate(dfs, 1)}
    tables = {t: d for t, d in tables.items() if d.limit(1).count()}
    fks = find_foreign_keys(tables, min_match_ratio)
    checks = {(r.fk_table, r.fk_column, r.pk_table, r.pk_column): referential_integrity(tables[r.fk_table], r.fk_column, tables[r.pk_table], r.pk_column) for r in fks.collect()}
    return {"foreign_keys": fks, "inclusion_dependencies": find_inclusion_dependencies(tables, 0.8 * min_match_ratio), "integrity": checks}
