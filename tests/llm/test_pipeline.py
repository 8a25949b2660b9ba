import random

import corpus_pipeline as P
import pytest
from brindle.llm import pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, rest string"


def row(i, t, source="s"):
    return (i, t, "en", source, None if t is None else len(t), 0.5, 1, "r")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted cases, and labels that make one word toxic."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    rows = [row(i, text(60)) for i in range(300)]
    labels = [(i, 1, 0) for i in range(300)]
    for i in range(300, 500):
        rows.append(row(i, text(30) + " you zidiot " + text(30)))
        labels.append((i, 1, 1))
    passage = text(70)
    rows += [row(1000, rows[0][1]), row(1001, rows[0][1]), row(1002, rows[5][1] + " x")]
    rows += [row(1100, text(20) + "\n" + passage + "\n" + text(20)), row(1101, text(25) + "\n" + passage + " " + text(9), None)]
    rows += [row(1200, "write to a.b@c.org or 1.2.3.4 " + text(20))]
    rows += [row(1300, None), row(1301, ""), row(None, text(12)), row(1302, "one two")]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, passage


def test_stages(spark, corpus):
    d, rows, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "pii", "packing"]
    whole = {r[0]: r[1] for r in rows}

    clean = P.materialise(P.drop_toxic(spark, docs, d), "t")
    assert clean.columns == docs.columns
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {r[0] for r in rows if not (r[1] and "zidiot" in r[1])}

    one = P.materialise(P.keep_one_of_near_copies(spark, clean, d), "n")
    assert one.columns == docs.columns
    assert kept - {r.doc_id for r in one.collect()} == {1000, 1001, 1002}
    assert one.count() == len(kept) - 3

    cut = P.materialise(P.drop_repeated_passages(spark, one, d), "s")
    got = {r.doc_id: r for r in cut.collect()}
    assert passage.split()[30] in got[1100].text and passage.split()[30] not in got[1101].text
    assert got[1100].text == whole[1100] and got[1101].n_chars == len(got[1101].text)
    assert got[1300].text is None and got[1300].n_chars is None and got[1301].text == ""

    safe = P.materialise(P.redact_personal_data(spark, cut, d), "p")
    got = {r.doc_id: r for r in safe.collect()}
    assert safe.columns == docs.columns
    assert got[1200].text.startswith("write to [EMAIL] or [IP] ") and got[1200].n_chars == len(got[1200].text)
    assert got[7].text == whole[7] and got[1200].source == "s" and got[7].rest == "r"
    assert pii.report(pii.find(safe)).agg({"n_email": "sum"}).first()[0] == 0

    pieces = P.pack_sequences(spark, safe, d).collect()
    per = {}
    for p in pieces:
        per[p.doc_id] = per.get(p.doc_id, 0) + p.length
        assert p.length <= 4096
    assert all(per[p.doc_id] == p.doc_tokens for p in pieces) and set(per) == set(got)


def test_copies_with_an_appended_passage_go(spark):
    words = [f"w{i}" for i in range(200)]
    texts = {1: words[:100], 2: words[:122], 3: words[:125], 4: words[100:]}
    docs = spark.createDataFrame([row(i, " ".join(t)) for i, t in texts.items()], COLUMNS)
    # 96 of 118 shingles of five words are in both 1 and 2, 96 of 121 in 1 and 3, 118 of 121 in 2 and 3.
    assert {r.doc_id for r in P.keep_one_of_near_copies(spark, docs.where("doc_id <> 3"), "").collect()} == {1, 4}
    assert {r.doc_id for r in P.keep_one_of_near_copies(spark, docs.where("doc_id <> 2"), "").collect()} == {1, 3, 4}


def test_run(spark, corpus):
    d, _, _ = corpus
    out = P.run(spark, d)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns) and out.count() > 300


def test_repeated_ids_and_empty_table(spark, corpus):
    """Rows of one id with different texts are judged each; equal rows are one; no text vanishes."""
    d, _, _ = corpus
    rng = random.Random(4)
    a, b, c = (" ".join(f"{rng.choice('abc')}{rng.randrange(999)}" for _ in range(80)) for _ in range(3))
    docs = spark.createDataFrame([row(1, a), row(1, b), row(1, b), row(2, b), row(3, c), row(None, a), row(None, a)], COLUMNS)
    got = P.keep_one_of_near_copies(spark, docs, d).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (1, b), (3, c), (0, a), (0, a)])
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0
