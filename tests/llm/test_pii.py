import hashlib
import random
import re

import numpy as np
import regex
from brindle.llm import pii
from brindle.llm._learn import sigmoid
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, rid long, t string, kind int, score double, base string"
BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute(t):
    out = []
    for k, (name, rx) in enumerate(BASE):
        for m in rx.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = name == "email" or name == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or name == "card" and 14 <= len(d) <= 19 and luhn(d) or name == "phone" and 10 <= len(d) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    out.sort()
    n = [sum(k == j for _, k, _ in out) for j in range(4)]
    return (*n, hashlib.sha256(",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in out).encode()).hexdigest())


def card(rng, n):
    d = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def texts():
    rng = random.Random(7)
    bits = ["a@b.c", "x.y%z@mail-1.example.com", "a@b.c_d@e.f", "@", ".", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.0255", "+1 (555) 123-4567", "+12", "+1234567890123456", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "\U0001f600", " ", "\n", "12", "3", "-", "(", ")", "+", "word", "(555) 123-4567", "joe at mail dot com", "fe80:0:0:0:1:2:3:4"]
    out = [None, "", "a@b.c", "1.1.1.1", "9" * 3000 + ".1.1.1", "a" * 3000 + "@b." + "c." * 2000 + "d", "1 " * 3000, "+1" * 2000, "x@y.z " * 3000]
    for _ in range(300):
        out.append("".join(rng.choice(bits) if rng.random() < 0.8 else card(rng, rng.randrange(13, 21)) for _ in range(rng.randrange(1, 30))))
        out.append(" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 0.5, "z") for i, t in rows], SCHEMA)


def test_base_matches_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "a@b.c"), (5, "1.1.1.1"), (5, "1.1.1.1")]
    got = pii.report(pii.find(frame(spark, rows), "text", carry=["doc_id"])).collect()
    want = sorted(str((i, *brute(t))) for i, t in rows)
    assert sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in got) == want
    whole = dict(rows[:-2])
    for r in got:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [(int(a), pii.KINDS.index(k)) for k, a, _ in spans] == sorted((int(a), pii.KINDS.index(k)) for k, a, _ in spans)
        assert len(spans) >= r.n_email + r.n_ip + r.n_card + r.n_phone
        assert all(0 <= int(a) < int(b) <= len(whole[r.doc_id] or "") for _, a, b in spans)


def test_looser_forms_are_learned(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        n = f"{rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        rows.append((i, f"words and words phone: +1 ({n} more words {rng.randrange(10**6)} 10-{rng.randrange(10, 30)}-{rng.randrange(1900, 2000)} or {rng.randrange(10, 99)} {rng.randrange(10, 99)} {rng.randrange(10, 99)} end"))
    rows += [(1000, "call my phone: (415) 555-1234 today"), (1001, "in 10-12-1999 or 11 22 33 they")]
    got = {r.doc_id: r.spans for r in pii.report(pii.find(frame(spark, rows), "text", carry=["doc_id"])).collect()}
    assert got[1000] == "phone:15:29" and got[1001] == ""


def test_every_text_is_learned_from(spark):
    """Looser forms are learned from few texts among many that have none, whatever their hash; copies of a text change nothing."""
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        n = f"{rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        rows.append((i, f"words and words phone: +1 ({n} more words {rng.randrange(10**6)} 10-{rng.randrange(10, 30)}-{rng.randrange(1900, 2000)} or {rng.randrange(10, 99)} {rng.randrange(10, 99)} {rng.randrange(10, 99)} end"))
    with_forms = spark.createDataFrame(rows, "rid long, t string").where(F.xxhash64("t") > 1 << 62)  # of the greatest hashes
    without = spark.range(10_000, 40_000).select(F.col("id").alias("rid"), F.concat(F.lit("no such thing "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("t"))
    model = pii.fit(without.union(with_forms))
    assert model.trees and model.thresholds[3] < 1
    more = with_forms.select(F.col("rid") + 100_000, "t")
    again = pii.fit(without.union(with_forms).union(more).union(more.selectExpr("`(rid + 100000)` * 2", "t")))
    assert again == model


def test_redact(spark):
    rows = [(1, "é me@x.org or 1.2.3.4."), (2, "nothing"), (3, None), (4, ""), (5, "+1 (555) 123-4567"), (6, "a 4111 1111 1111 1111")]
    df = frame(spark, rows)
    out = pii.redact(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é [EMAIL] or [IP].", 2: "nothing", 3: None, 4: "", 5: "[PHONE]", 6: "a [CARD]"}
    assert pii.redact(df.limit(0)).count() == 0


def brute_features(kind, s, before, after):
    """The features of one candidate, by their names."""
    digits = re.sub("[^0-9]", "", s)
    sizes = [len(x) for x in re.split("[^0-9A-Za-z]+", s) if x]
    words = [r"mail|contact|write", r"host|server|addr|\bip\b", r"card|visa|credit|pay", r"phone|tel|call|fax|mobile"][kind]
    made = {
        "kind": kind,
        "digits": min(len(digits), 24),
        "length": min(len(s), 40),
        "marks": min(len(re.sub("[0-9A-Za-z]", "", s)), 10),
        "groups": min(len(sizes), 10),
        "longest": min(max(sizes, default=0), 20),
        "shortest": min(min(sizes, default=0), 8),
        "given_away": int(bool(re.search("[+@]", s))),
        "luhn": int(12 <= len(digits) <= 19 and luhn(digits)),
        "glued_before": int(bool(re.search("[0-9A-Za-z]$", before))),
        "glued_after": int(bool(re.search("^[0-9A-Za-z]", after))),
        "context_word": int(bool(re.search(words, before.lower()))),
        "dots": min(len(re.sub("[^.:]", "", s)), 6),
    }
    return [made[f] for f in pii.FEATURES]


def brute_spans(t, model):
    """base and added spans of one text: all candidates, one by one, and a plain merge of overlapping ones."""
    base, loose = [], []
    for kind, is_base, pattern, _ in pii.GENERATORS:
        for m in regex.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = is_base and (kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 14 <= len(d) <= 19 and luhn(d) or kind == 3 and 10 <= len(d) <= 15)
            if ok:
                base.append((m.start(), kind, m.end()))
            else:
                x = np.array([brute_features(kind, m[0], t[max(0, m.start() - pii.CONTEXT) : m.start()], t[m.end() : m.end() + pii.CONTEXT])], float)
                score = float(sigmoid(model.base + sum(tree.predict(x)[0] for tree in model.trees)))
                if score >= model.thresholds[kind]:
                    loose.append((m.start(), m.end(), kind, score))
    runs = []
    for a, b, kind, score in sorted(x for x in loose if not any(x[0] < e and s < x[1] for s, _, e in base)):
        if runs and runs[-1][1] > a:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]), max(runs[-1][2], (score, -a, -kind)))
        else:
            runs.append((a, b, (score, -a, -kind)))
    return sorted(base + [(a, -k[2], b) for a, b, k in runs])


def test_added_spans_match_brute_force(spark):
    rng = random.Random(9)
    rows = list(enumerate(t for t in texts() if t is None or len(t) < 2000))
    for i in range(400):
        n = f"{rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        rows.append((2000 + i, f"phone: +1 ({n} or ({n} and 10-{rng.randrange(10, 30)}-{rng.randrange(1900, 2000)} {rng.randrange(10, 99)} {rng.randrange(10, 99)} {rng.randrange(10, 99)} card {card(rng, 16)} {card(rng, 15)[:14]}"))
    df = frame(spark, rows)
    model = pii.fit(df.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("text", F.lit("")).alias("t")))
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(df, "text", carry=["doc_id"]).collect()}
    want = {i: brute_spans(t or "", model) for i, t in rows}
    assert found == want and sum(len(v) for v in want.values()) > sum(sum(brute(t)[:4]) for _, t in rows) + 20


def test_very_long_texts_and_clashing_names(spark):
    """Thousands of spans in one text, in one pass; names of the result in the input."""
    many = "x@y.zz (415) 555-1234 " * 4_000
    rows = [(1, many), (2, "1234 5678 9012 3456 " * 3_000), (3, "me@x.org")]
    df = frame(spark, rows).withColumnRenamed("rid", "spans").withColumnRenamed("t", "merged")
    got = {r.doc_id: r for r in pii.find(df, "text", carry=["doc_id", "base", "spans", "merged"], keep_text=True).collect()}
    assert len(got[1].base) == 4_000 and got[3].base_ == "z" and got[3].spans_ == 1 and got[3].merged_ == "x" and got[3].whole == "me@x.org"
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert "@" not in out[1] and out[3] == "[EMAIL]" and out[1].count("[EMAIL]") == 4_000
    assert pii.report(pii.find(df.limit(0), "text", carry=["doc_id"])).count() == 0
