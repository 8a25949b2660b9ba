"""Personal data: high-recall generators, boosted trees over candidates, calibrated thresholds.

Every step over the texts is a built-in DataFrame function. Eight generators (regular
expressions) propose spans that may overlap: for each of the four kinds the base format, whose
valid matches are always kept, and a looser one. Candidates become rows with format and context
features. Boosted trees are trained on the candidates of all documents: valid
base matches are positives, also with the mark that gives their kind away (``+``, ``@``) hidden, and
so are loose candidates inside one of their kind; others that touch no base span are negatives. A kind's threshold is the least score that keeps
``PRECISION`` on the texts of the other half. The trees are compiled into a column expression;
candidates that reach their threshold and touch no base span are added, and a run of them that
overlap becomes one span, of the kind of its best score (then of its earliest, then of the lesser kind).

Candidates have no labels but the base formats. Their features are small whole numbers, so the trees and thresholds are
fitted on counts of all candidates: the driver gets one row for each distinct combination, however many candidates there are.

Offsets are code points, end exclusive. Null and empty texts have no spans; very long ones are
searched whole, in one row, by patterns that need one pass. Rows that repeat are judged each for themselves and fitted on
once; ids may be null or tie. Extra columns are carried where named (an underscore follows the name
of one that the result has too) and ignored otherwise. An empty table has no result, and
without candidates of both kinds no span is added.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._learn import Node, boost, sigmoid

KINDS = ["email", "ip", "card", "phone"]
#: Context characters on either side.
CONTEXT = 24
PRECISION = 0.97
#: Possessive quantifiers and look-behinds keep every pattern linear; \G lets a match begin where the last one ended.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
GENERATORS: list[tuple[int, bool, str, str]] = [
    (0, True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(t, '@') > 0"),
    (1, True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "t rlike '[0-9][.][0-9]'"),
    (2, True, r"[0-9](?:[\x20-]?[0-9])++", "t rlike '[0-9]'"),
    (3, True, r"\+[0-9][\x20().0-9-]+[0-9]", "instr(t, '+') > 0"),
    (0, False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|(?<= )at(?= )) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )) ?[A-Za-z0-9-]++){1,8}+", "instr(t, 'dot') > 0"),
    (1, False, r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])", "instr(t, ':') > 0"),
    (2, False, r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ._-]{1,2}[0-9]{3,6}){2,4}(?![0-9A-Za-z])", "t rlike '[0-9]{4}[ ._-]'"),
    (3, False, r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9A-Za-z])", "t rlike '[0-9]{2}[) ./-]'"),
]
_WORDS = ["mail|contact|write", "host|server|addr|\\\\bip\\\\b", "card|visa|credit|pay", "phone|tel|call|fax|mobile"]
FEATURES = ["kind", "digits", "length", "marks", "groups", "longest", "shortest", "given_away", "luhn", "glued_before", "glued_after", "context_word", "dots"]
_HIDE = FEATURES.index("given_away")


def _luhn(digits: Column) -> Column:
    """Checksum of up to 19 digits; false for other lengths."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda s, i: s + F.when(i % 2 == 0, (F.substring(digits, -i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(digits, -i, F.lit(1)).cast("int") / 5).cast("int")).otherwise(F.substring(digits, -i, F.lit(1)).cast("int")),
    )
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _candidate(m: Column, p: Column, kind: int, gen: int):
    """The i-th match m[i] of a generator, between the pieces p[i] and p[i + 1] of the text."""
    return lambda i: F.struct(F.lit(kind).alias("kind"), F.lit(gen).alias("gen"), i.alias("i"), m[i].alias("s"), F.length(p[i]).alias("gap"), F.right(p[i], F.lit(CONTEXT)).alias("before"), F.left(p[i + 1], F.lit(CONTEXT)).alias("after"))


def candidates(rows: DataFrame) -> DataFrame:
    """rows: rid, t and others -> one row per candidate, and one with a null kind for each row of the input (it alone keeps the other columns)."""
    others = [c for c in rows.columns if c not in ("rid", "t")]
    found = rows.select("*", *(F.when(F.expr(cond), F.regexp_extract_all(F.col("t"), F.lit(pattern), F.lit(0))).alias(f"m{g}") for g, (_, _, pattern, cond) in enumerate(GENERATORS)))
    found = found.select("*", *(F.when(F.size(f"m{g}") > 0, F.split("t", pattern, -1)).alias(f"p{g}") for g, (_, _, pattern, _) in enumerate(GENERATORS)))
    lists = []
    for g, (kind, _, _, _) in enumerate(GENERATORS):
        m, p = F.col(f"m{g}"), F.col(f"p{g}")
        one = _candidate(m, p, kind, g)
        lists.append(F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.size(m) - 1), one)).otherwise(F.array()))
    none = F.array(F.struct(*(F.lit(None).cast(k).alias(n) for n, k in (("kind", "int"), ("gen", "int"), ("i", "int"), ("s", "string"), ("gap", "int"), ("before", "string"), ("after", "string")))))
    flat = found.select("rid", *others, F.explode(F.concat(none, *lists)).alias("c"))
    flat = flat.select("rid", *(F.when(F.col("c.kind").isNull(), F.col(c)).alias(c) for c in others), "c.*")
    # One shuffle by row serves all that follows.
    flat = flat.repartition("rid")
    turn = Window.partitionBy("rid", "gen").orderBy("i")
    n = F.length("s")
    begin = F.sum(F.col("gap") + n).over(turn) - n
    return flat.select("*", begin.cast("int").alias("start")).withColumn("stop", F.col("start") + n).drop("i", "gap")


def features(rows: DataFrame) -> DataFrame:
    """Adds valid (a valid base match) and the features, small whole numbers."""
    digits = F.regexp_replace("s", "[^0-9]", "")
    rows = rows.withColumn("digits_", digits)
    n, luhn = F.length("digits_"), _luhn(F.col("digits_"))
    group_sizes = F.transform(F.filter(F.split("s", "[^0-9A-Za-z]+", -1), lambda x: F.length(x) > 0), lambda x: F.length(x))
    rows = rows.withColumn("luhn_", luhn).withColumn("sizes_", group_sizes)
    ip = F.col("s").rlike(rf"^0*{_OCTET}(?:\.0*{_OCTET}){{3}}$")
    base = F.lit(False)
    for g, (kind, is_base, _, _) in enumerate(GENERATORS):
        if is_base:
            ok = [F.lit(True), ip, n.between(14, 19) & F.col("luhn_"), n.between(10, 15)][kind]
            base = base | ((F.col("gen") == g) & ok)
    context = F.lit(False)
    for k, words in enumerate(_WORDS):
        context = context | ((F.col("kind") == k) & F.lower("before").rlike(words.replace("\\\\", "\\")))
    cap = lambda c, m: F.least(c, F.lit(m)).cast("int")
    made = {
        "kind": F.col("kind"),
        "digits": cap(n, 24),
        "length": cap(F.length("s"), 40),
        "marks": cap(F.length(F.regexp_replace("s", "[0-9A-Za-z]", "")), 10),
        "groups": cap(F.size("sizes_"), 10),
        "longest": cap(F.coalesce(F.array_max("sizes_"), F.lit(0)), 20),
        "shortest": cap(F.coalesce(F.array_min("sizes_"), F.lit(0)), 8),
        "given_away": F.col("s").rlike("[+@]").cast("int"),
        "luhn": F.col("luhn_").cast("int"),
        "glued_before": F.col("before").rlike("[0-9A-Za-z]$").cast("int"),
        "glued_after": F.col("after").rlike("^[0-9A-Za-z]").cast("int"),
        "context_word": context.cast("int"),
        "dots": cap(F.length(F.regexp_replace("s", "[^.:]", "")), 6),
    }
    return rows.select("*", F.coalesce(base, F.lit(False)).alias("valid"), F.array(*(F.coalesce(made[f], F.lit(0)).cast("int") for f in FEATURES)).alias("x")).drop("digits_", "luhn_", "sizes_", "before", "after")


@dataclass
class Model:
    base: float
    trees: list[Node]
    thresholds: list[float]  # by kind; above 1: none is added

    def column(self) -> Column:
        x = [F.get("x", F.lit(i)) for i in range(len(FEATURES))]
        z = F.lit(self.base)
        for t in self.trees:
            z = z + t.column(x)
        return 1.0 / (1.0 + F.exp(-z))

    def reaches(self) -> Column:
        limit = F.lit(2.0)
        for k, t in enumerate(self.thresholds):
            limit = F.when(F.col("kind") == k, F.lit(float(t))).otherwise(limit)
        return F.col("score") >= limit


def _touching(rows: DataFrame) -> DataFrame:
    """Adds touched: a valid base span of the same text overlaps."""
    before = Window.partitionBy("rid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rid").orderBy(F.col("start").desc(), F.col("stop").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.max(F.when(F.col("valid"), F.col("stop"))).over(before)
    starts = F.min(F.when(F.col("valid"), F.col("start"))).over(after)
    return rows.withColumn("touched", F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("stop"), F.lit(False)))


def fit(rows: DataFrame, *, precision: float = PRECISION, trees: int = 30, depth: int = 3) -> Model:
    """rows: rid, t. Trains on the candidates of all texts; equal texts count once."""
    rows = rows.select(F.struct(F.xxhash64("t").alias("h"), "rid").alias("rid"), "t")
    seen = _touching(features(candidates(rows).where("kind is not null")))
    # A loose candidate inside a valid base span of its kind is the same thing without the mark that gives it away.
    sofar = Window.partitionBy("rid", "kind").orderBy("start", F.desc("valid"))
    seen = seen.withColumn("good", F.col("valid") | F.coalesce(F.max(F.when(F.col("valid"), F.col("stop"))).over(sofar) >= F.col("stop"), F.lit(False)))
    seen = seen.where("good or not touched").drop("valid").withColumnRenamed("good", "valid")
    seen = seen.groupBy(F.col("rid.h"), "gen", "start", "stop", "x", "valid").agg(F.min("rid.rid").alias("rid"))
    half = F.pmod(F.xxhash64("rid"), F.lit(2))
    cells = seen.groupBy("x", "valid", half.alias("half")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x", "valid", "half").collect()
    if not cells:
        return Model(0.0, [], [2.0] * 4)
    x, y, w, half_ = (np.array(v, float) for v in zip(*((r.x, r.valid, r.n, r.half) for r in cells)))
    hidden = x[y > 0].copy()
    hidden[:, _HIDE] = 0
    x, y, w, half_ = np.concatenate((x, hidden)), np.concatenate((y, np.ones(len(hidden)))), np.concatenate((w, w[y > 0])), np.concatenate((half_, half_[y > 0]))
    learn = half_ == 0
    if len(set(y[learn])) < 2:
        return Model(0.0, [], [2.0] * 4)
    base, grown = boost(x[learn], y[learn], w[learn], trees=trees, depth=depth)
    z = base + sum((t.predict(x) for t in grown), np.zeros(len(x)))
    p, rest = sigmoid(z), half_ == 1
    thresholds = []
    for k in range(len(KINDS)):
        mine = rest & (x[:, 0] == k)
        order = np.argsort(-p[mine], kind="stable")
        good, all_ = np.cumsum((w * y)[mine][order]), np.cumsum(w[mine][order])
        ps = p[mine][order]
        last = np.append(ps[1:] != ps[:-1], True) if len(ps) else np.empty(0, bool)
        ok = np.flatnonzero(last & (good >= precision * all_) & (ps >= 0.5))
        lower = ps[ok[-1] + 1] if len(ok) and ok[-1] + 1 < len(ps) else 0.0
        thresholds.append(max(0.5, float(lower) + 1e-9) if len(ok) else 2.0)
    return Model(base, grown, thresholds)


def _text_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of (start, kind, stop, ...)."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _runs(rows: DataFrame, chosen: Column, order: list, kind: Column) -> DataFrame:
    """Adds head, stop_ and kind_ : of each run of overlapping ``chosen`` rows of a text the first row, the end, and the greatest ``kind``."""
    rows = rows.withColumn("chosen_", chosen)
    turn = Window.partitionBy("rid", "chosen_").orderBy(*order)
    ahead = F.max("stop").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("head", F.coalesce(ahead <= F.col("start"), F.lit(True)))
    rows = rows.withColumn("run_", F.sum(F.col("head").cast("int")).over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    peers = Window.partitionBy("rid", "chosen_", "run_")
    return rows.select("*", F.max("stop").over(peers).alias("stop_"), F.max(kind).over(peers).alias("kind_")).withColumn("head", F.col("head") & F.col("chosen_")).drop("chosen_", "run_")


RESULT = ["base", "spans", "merged", "whole"]


def find(df: DataFrame, text: str = "text", *, carry: list[str] | None = None, keep_text: bool = False, **fitting) -> DataFrame:
    """Spans of each row of ``df``: the ``carry`` columns, base and spans (arrays of start, kind, stop) and, if asked, whole (the text) and merged (spans that overlap as one)."""
    carry = carry or []
    names = [f"c{i}" for i in range(len(carry))]
    docs = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(text).alias("whole"), *(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names))).withColumn("rid", F.monotonically_increasing_id())
    model = fit(docs.select("rid", "t"), **fitting)
    kept = ["rid", "t", *names, *(["whole"] if keep_text else [])]
    scored = features(candidates(docs.select(*kept))).withColumn("score", F.when(F.col("kind").isNotNull(), model.column()))
    scored = _touching(scored)
    scored = scored.withColumn("extra", F.coalesce(~F.col("valid") & ~F.col("touched") & model.reaches(), F.lit(False)))
    scored = _runs(scored, F.col("extra"), ["start", "stop"], F.struct("score", -F.col("start"), -F.col("kind")))
    scored = scored.withColumn("kind", F.when(F.col("extra"), -F.col("kind_.col3")).otherwise(F.col("kind"))).withColumn("stop", F.when(F.col("extra"), F.col("stop_")).otherwise(F.col("stop")))
    scored = scored.withColumn("taken", F.col("valid") | F.col("head")).drop("head", "stop_", "kind_")
    span = F.struct("start", "kind", "stop")
    lists = [F.sort_array(F.collect_list(F.when(F.col(c), span))).alias(n) for c, n in (("valid", "base"), ("taken", "spans"))]
    if keep_text:
        scored = _runs(scored, F.col("taken"), ["start", "kind", "stop"], F.col("kind"))
        lists.append(F.sort_array(F.collect_list(F.when(F.col("head"), F.struct("start", "kind", F.col("stop_").alias("stop"))))).alias("merged"))
    lists += [F.first(c, ignorenulls=True).alias(c) for c in kept[2:]]
    got = scored.groupBy("rid").agg(*lists)
    return got.select(*(F.col(n).alias(f"{c}_" if c in RESULT else c) for c, n in zip(carry, names)), "base", "spans", *(["merged", "whole"] if keep_text else []))


def report(found: DataFrame) -> DataFrame:
    """n_email, n_ip, n_card, n_phone, base_sha256 and spans in place of the arrays."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    rest = [c for c in found.columns if c not in ("base", "spans")]
    return found.select(*rest, *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(_text_spans(F.col("base")), 256).alias("base_sha256"), _text_spans(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its spans replaced by [KIND]; overlapping spans are replaced as one, under the first one's kind."""
    rest = [c for c in df.columns if c != text]
    folded = df.select(text, F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("_")).alias("rest_"))
    found = find(folded, text, carry=["rest_"], keep_text=True)
    found = found.withColumn("spans", F.col("merged"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["stop"])
    parts = F.transform("spans", lambda s, i: F.concat(F.substring(F.col("whole"), begin(i) + 1, s["start"] - begin(i)), F.get(names, s["kind"])))
    tail = F.substring(F.col("whole"), F.element_at("spans", -1)["stop"] + 1, F.length("whole"))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("whole"))
    return found.select(*(clean.alias(c) if c == text else F.col("rest_").getField(c).alias(c) for c in df.columns))
