"""Completions for a statement at a position: what fits there, best first.

The words before the position tell the place: tables follow FROM and JOIN (a join with a condition,
where columns relate), columns follow SELECT, WHERE, ON, GROUP, ORDER and HAVING, arguments of a
function are columns of the type it takes. Names of the statement's own tables come before others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field

from ..plans.statements import Token, significant

# What each sign of a good suggestion counts.
POINTS = {"usage": 10, "keyword": 5, "table": 10, "own column": 15, "column": 8, "aggregate": 12, "prefix": 15, "same case": 20}
KEYWORDS = "SELECT FROM WHERE GROUP ORDER HAVING LIMIT OFFSET JOIN LEFT INNER FULL CROSS ASOF ON USING AND OR NOT IN LIKE ILIKE BETWEEN IS NULL DISTINCT AS CASE WHEN THEN ELSE END UNION EXCEPT INTERSECT WITH QUALIFY BY ASC DESC".split()
AGGREGATES = "COUNT SUM AVG MIN MAX MEDIAN STDDEV VARIANCE MODE QUANTILE_CONT STRING_AGG ARRAY_AGG ARG_MIN ARG_MAX".split()
#: Functions by the type of column they take.
TAKES = {
    "number": "SUM AVG MIN MAX COUNT MEDIAN STDDEV VARIANCE ROUND ABS CEIL FLOOR SQRT LOG LN POWER QUANTILE_CONT".split(),
    "text": "SUBSTRING LOWER UPPER TRIM REPLACE CONCAT LENGTH REGEXP_MATCHES REGEXP_EXTRACT REGEXP_REPLACE SPLIT_PART STRING_AGG STARTS_WITH".split(),
    "time": "YEAR QUARTER MONTH WEEK DAY HOUR MINUTE SECOND DATE_TRUNC DATE_PART DATE_DIFF STRFTIME EXTRACT EPOCH".split(),
}
_KINDS = {"number": re.compile("int|float|double|decimal|short|long|byte"), "text": re.compile("string|char"), "time": re.compile("date|time")}
_OPENS = {"FROM": "table", "JOIN": "table", "INTO": "table", "UPDATE": "table", "SELECT": "column", "WHERE": "column", "ON": "column", "HAVING": "column", "BY": "column", "QUALIFY": "column", "AND": "column", "OR": "column"}

Tables = Mapping[str, Mapping[str, str]]


@dataclass
class Place:
    kind: str  # start, table, column, argument
    word: str = ""  # typed so far
    qualifier: str = ""  # before a dot
    function: str = ""
    tables: dict[str, str] = field(default_factory=dict)  # names and aliases of the statement's tables


def _named(ts: list[Token], tables: Tables) -> dict[str, str]:
    """Names and aliases of the tables behind FROM and JOIN."""
    known, out = {t.lower(): t for t in tables}, {}
    for a, b, *rest in zip(ts, ts[1:], [*ts[2:], None], [*ts[3:], None, None]):
        if a.word in ("FROM", "JOIN") or a.text == ",":
            table = known.get(b.text.strip('"').lower())
            if table is None:
                continue
            out[table] = table
            alias = rest[1] if rest[0] is not None and rest[0].word == "AS" else rest[0]
            if alias is not None and alias.kind in ("word", "quoted") and alias.word not in KEYWORDS:
                out[alias.text.strip('"')] = table
    return out


def place(sql: str, position: int, tables: Tables) -> Place:
    word = re.search(r"\w*$", sql[:position])[0]
    ts = significant(sql[: position - len(word)])
    here = Place("start", word, tables=_named(significant(sql), tables))
    if ts and ts[-1].text == "." and len(ts) > 1:
        here.qualifier, here.kind = ts[-2].text.strip('"'), "column"
        return here
    depth = 0
    for i in range(len(ts) - 1, -1, -1):
        t = ts[i]
        if t.text == ")":
            depth += 1
        elif t.text == "(":
            if depth == 0 and i and ts[i - 1].kind == "word" and ts[i - 1].word not in KEYWORDS:
                here.kind, here.function = "argument", ts[i - 1].word
                return here
            depth = max(0, depth - 1)
        elif depth == 0 and t.kind == "word" and t.word in _OPENS:
            here.kind = _OPENS[t.word]
            return here
    return here


def relations(tables: Tables) -> list[tuple[str, str, str, str]]:
    """(table, column, other table, its column) that names relate: customer_id to customers' or customer's key, or equal names."""
    out = []
    for t, columns in tables.items():
        for c in columns:
            stem = re.sub("_?id$", "", c.lower()) if c.lower().endswith("id") and len(c) > 2 else ""
            for other, theirs in tables.items():
                if other == t:
                    continue
                if stem and other.lower() in (stem, f"{stem}s") or stem and other.lower().endswith((f"_{stem}", f"_{stem}s")):
                    key = next((k for k in theirs if k.lower() == "id"), None) or next((k for k in theirs if k.lower().endswith("id")), None)
                    if key is not None:
                        out.append((t, c, other, key))
                if c in theirs and (t, c, other, c) not in out:
                    out.append((t, c, other, c))
    return out


def _candidates(here: Place, tables: Tables) -> list[str]:
    own = list(dict.fromkeys(here.tables.values()))
    if here.qualifier:
        return list(tables.get(here.tables.get(here.qualifier, here.qualifier), ()))
    if here.kind == "table":
        joins = [f"{b} ON {a}.{x} = {b}.{y}" for a, x, b, y in relations(tables) if a in own and b not in own]
        return [*tables, *joins]
    mine = [c for t in own for c in tables[t]]
    full = [f"{n}.{c}" for n, t in here.tables.items() for c in tables[t]] if len(own) > 1 else []
    rest = [c for t in tables if t not in own for c in tables[t]]
    if here.kind == "argument":
        kind = next((k for k, fs in TAKES.items() if here.function in fs), None)
        fits = [c for t in (own or tables) for c, of in tables[t].items() if kind and _KINDS[kind].search(of.lower())]
        return [*fits, *(c for c in [*mine, *full, *rest] if c not in fits)]
    if here.kind == "column":
        return [*mine, *full, *rest, *AGGREGATES, *KEYWORDS]
    return [*KEYWORDS, *tables]


def suggest(sql: str, position: int | None, tables: Tables, usage: Mapping[str, int] | None = None, functions: tuple[str, ...] = (), limit: int = 20) -> list[tuple[str, float]]:
    """(suggestion, points), best first; the order of candidates decides ties."""
    here = place(sql, len(sql) if position is None else position, tables)
    found = list(dict.fromkeys([*_candidates(here, tables), *(functions if here.kind in ("column", "argument", "start") and not here.qualifier else ())]))
    w = here.word.lower()
    if w:
        found = [x for x in found if w in x.lower()]
    usage, most = usage or {}, max((usage or {"": 0}).values(), default=0)
    own = {c for t in here.tables.values() for c in tables[t]}
    every = {c for cs in tables.values() for c in cs}
    kind = next((k for k, fs in TAKES.items() if here.function in fs), None)
    fits = {c for t in tables for c, of in tables[t].items() if kind and _KINDS[kind].search(of.lower())}

    def points(x: str) -> float:
        out = POINTS["usage"] * usage.get(x.lower(), 0) / most if most else 0.0
        out += POINTS["keyword"] * (x in KEYWORDS)
        if here.kind == "table":
            out += POINTS["table"] * (x in tables)
        elif here.qualifier or (here.kind == "argument" and x in fits):
            out += POINTS["own column"]
        elif x in every:
            out += POINTS["column"] + (x in own)
        elif here.kind == "column" and x in AGGREGATES:
            out += POINTS["aggregate"] if not own else 0
        if w and x.lower().startswith(w):
            out += POINTS["same case"] if x.startswith(here.word) else POINTS["prefix"]
        return out

    scored = [(x, points(x)) for x in found]
    return sorted(scored, key=lambda s: -s[1])[:limit]


def terms(sql: str) -> Counter:
    """Words and names of a statement, in lower case."""
    return Counter(t.text.strip('"').lower() for t in significant(sql) if t.kind in ("word", "quoted"))
