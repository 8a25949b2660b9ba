"""One-hot and text-concept encodings, related encodings and their drill-down."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entropy import numeric_columns, pearson
from .ranks import quantiles
from .search import as_text, quoted

#: Words too common to tell texts apart (a plain English list).
STOPWORDS = (
    "a about after all also an and any are as at be because been but by can could did do does for from had has have he her here him his how i if in into is it its just me more most my no not of on one only or other our out over she so some such than that the their them then there these they this to too up us very was we were what when where which who will with would you your"
).split()
#: Vocabulary of the topic models, at most.
VOCABULARY = 20_000
#: Categories that a column may have to be encoded value by value.
MOST_VALUES = 1_000
# The words and phrases that tell four subjects.
DOMAINS = {
    "ai_ml": [
        "artificial intelligence|ai|machine learning|ml|deep learning|neural network|nlp|computer vision|data science",
        "algorithm|model|training|prediction|classification|regression|clustering",
        "tensorflow|pytorch|scikit|keras|pandas|numpy",
    ],
    "tech": [
        "software|hardware|system|platform|framework|database|api|cloud|server",
        "programming|development|coding|bug|feature|deployment|testing",
        "python|java|javascript|sql|html|css|react|node",
    ],
    "business": [
        "revenue|profit|sales|customer|market|strategy|growth|roi|kpi",
        "management|team|project|budget|timeline|milestone|deliverable",
        "analytics|metrics|dashboard|report|insight|trend",
    ],
    "academic": [
        "research|study|analysis|experiment|hypothesis|methodology|results",
        "publication|paper|journal|conference|peer review|citation",
        "university|college|professor|student|degree|thesis",
    ],
}


def domain_pattern(domain: str) -> str:
    return rf"\b(?:{'|'.join(DOMAINS[domain])})\b"


def _safe(value: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]", "_", str(value).lower())).strip("_") or "value"


def _named(prefix: str, values: Sequence[str], taken: Sequence[str]) -> list[str]:
    out, used = [], {c.lower() for c in taken}
    for v in values:
        base = name = f"{prefix}_{_safe(v)}"
        n = 1
        while name in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name)
        out.append(name)
    return out


def _flag(hit: Column, binary_format: str) -> Column:
    hit = F.coalesce(hit, F.lit(False))
    return F.when(hit, "Yes").otherwise("No") if binary_format == "text" else hit.cast("int")


def is_text(df: DataFrame, name: str) -> bool:
    """Any value has a space, or the mean length is over 15."""
    t = as_text(df, name)
    spaced, length = df.agg(F.max(F.when(t.contains(" "), 1)), F.avg(F.length(t))).first()
    return bool(spaced) or (length or 0) > 15


def one_hot(df: DataFrame, name: str, *, binary_format: str = "numeric") -> DataFrame:
    """Adds is_<value> for every distinct non-null value, in order."""
    values = [r[0] for r in df.select(as_text(df, name).alias("v")).where("v is not null").distinct().orderBy("v").limit(MOST_VALUES + 1).collect()]
    if len(values) > MOST_VALUES:
        raise ValueError(f"{name} has more than {MOST_VALUES} values; group it first")
    return df.withColumns({n: _flag(as_text(df, name) == v, binary_format) for n, v in zip(_named("is", values, df.columns), values)})


def top_words(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    """word, count: the n most frequent tokens without stopwords; ties by word."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(as_text(df, name)), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.where(~F.col("word").isin(STOPWORDS)).groupBy("word").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "word").limit(n)


def text_flags(df: DataFrame, name: str, *, n: int = 10, binary_format: str = "numeric") -> DataFrame:
    """Adds has_<word> for the most frequent words: the lower-cased text contains it."""
    words = [r.word for r in top_words(df, name, n).collect()]
    return df.withColumns({c: _flag(F.lower(as_text(df, name)).contains(w), binary_format) for c, w in zip(_named("has", words, df.columns), words)})


def encode(df: DataFrame, name: str, *, binary_format: str = "numeric", algorithm: str = "basic", **options) -> DataFrame:
    """Values or words of a column as flags; ``advanced`` and ``comprehensive`` add concepts of texts. The input stays as it is."""
    if algorithm not in ("basic", "advanced", "comprehensive"):
        raise ValueError(f"unknown algorithm {algorithm}")
    if not is_text(df, name):
        return one_hot(df, name, binary_format=binary_format)
    if algorithm == "basic":
        return text_flags(df, name, binary_format=binary_format)
    return concept_flags(df, name, binary_format=binary_format, **options)


def _vectorised(df: DataFrame, name: str, least: int):
    rows = df.select(F.coalesce(as_text(df, name), F.lit("")).alias("t")).withColumn("row", F.monotonically_increasing_id())
    words = RegexTokenizer(inputCol="t", outputCol="w", pattern=r"[^a-z]+", toLowercase=True, minTokenLength=3).transform(rows)
    words = StopWordsRemover(inputCol="w", outputCol="words", stopWords=STOPWORDS).transform(words)
    counts = CountVectorizer(inputCol="words", outputCol="counts", vocabSize=VOCABULARY, minDF=least)
    try:
        model = counts.fit(words)
    except Exception as e:  # an empty vocabulary
        if "vocab" in str(e).lower():
            return words, None, None
        raise
    return words, model, model.transform(words)


def topics_lda(df: DataFrame, name: str, topics: int = 6, top: int = 5, least: int = 2) -> list[list[str]]:
    """Words of each topic, by latent Dirichlet allocation on counts."""
    _, model, data = _vectorised(df, name, least)
    if model is None:
        return []
    fitted = LDA(k=topics, maxIter=10, seed=42, featuresCol="counts").fit(data)
    return [[model.vocabulary[i] for i in r.termIndices] for r in fitted.describeTopics(top).orderBy("topic").collect()]


def topics_nmf(df: DataFrame, name: str, topics: int = 6, top: int = 5, least: int = 2, rounds: int = 12) -> list[list[str]]:
    """Words of each factor, by a non-negative factorisation of TF-IDF with multiplicative updates.

    Every round is one pass: the factors of the words (at most ``VOCABULARY``) go out, each document's own
    factors are found where it lies, and sums of the size of the vocabulary come back. No document needs a number.
    """
    _, model, data = _vectorised(df, name, least)
    if model is None:
        return []
    cells = vector_to_cells(IDF(inputCol="counts", outputCol="tfidf").fit(data).transform(data), "tfidf").persist()
    w = np.random.default_rng(42).random((len(model.vocabulary), topics)) + 0.01
    for _ in range(rounds):
        found = cells.mapInArrow(_nmf_step(w), "term int, s array<double>").groupBy("term").agg(*(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(topics))).collect()
        sums = np.zeros((len(w) + topics, topics))
        for r in found:
            sums[r.term] = r[1:]
        w *= sums[: len(w)] / np.maximum(w @ sums[len(w) :], 1e-12)
    cells.unpersist()
    w /= np.maximum(np.linalg.norm(w, axis=0), 1e-12)
    return [[model.vocabulary[i] for i in np.lexsort((np.arange(len(w)), -w[:, k]))[:top] if w[i, k] > 0] for k in range(topics)]


def vector_to_cells(df: DataFrame, name: str) -> DataFrame:
    """x, v: places and values of the non-zero cells of each sparse vector that has any."""
    v = F.col(name)
    struct = F.from_json(F.to_json(F.struct(v.alias("v"))), "v struct<type: int, size: int, indices: array<int>, values: array<double>>")
    return df.select(struct["v"]["indices"].alias("x"), struct["v"]["values"].alias("v")).where(F.size("x") > 0)


def _nmf_step(w: np.ndarray):
    """Factors h of each document for the words' factors ``w``; sums of x h by word, and behind them those of h h."""

    def run(batches):
        gram = w.T @ w
        for batch in batches:
            if not batch.num_rows:
                continue
            x, v = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(2))
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(0)).to_numpy())
            project = np.stack([np.bincount(owner, v * w[x, k], batch.num_rows) for k in range(w.shape[1])], axis=1)
            h = project / np.maximum(np.diag(gram), 1e-12)
            for _ in range(10):
                h *= project / np.maximum(h @ gram, 1e-12)
            words, at = np.unique(x, return_inverse=True)
            sums = np.stack([np.bincount(at, v * h[owner, k], len(words)) for k in range(w.shape[1])], axis=1)
            term = np.concatenate((words, len(w) + np.arange(w.shape[1]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(list(np.concatenate((sums, h.T @ h))), pa.list_(pa.float64()))], ["term", "s"])

    return run


def word_clusters(df: DataFrame, name: str, clusters: int = 5, top: int = 5, least: int = 2, vocabulary: int = 200) -> list[list[str]]:
    """Groups of words used in the same texts: k-means on the co-occurrence of the most frequent words."""
    words, model, _ = _vectorised(df, name, least)
    if model is None:
        return []
    vocab = model.vocabulary[:vocabulary]
    uses = words.select("row", F.explode(F.array_distinct("words")).alias("a")).where(F.col("a").isin(vocab))
    # At most ``vocabulary`` words a text, so pairs within a text are bounded.
    pairs = uses.join(uses.withColumnRenamed("a", "b"), "row").groupBy("a", "b").agg(F.count("*").alias("n")).collect()
    place = {w: i for i, w in enumerate(vocab)}
    vectors: list[list[float]] = [[0.0] * len(vocab) for _ in vocab]
    for r in pairs:
        vectors[place[r.a]][place[r.b]] = float(r.n)
    rows = []
    for w, v in zip(vocab, vectors):
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        rows.append((w, Vectors.dense([x / norm for x in v])))
    data = df.sparkSession.createDataFrame(rows, ["word", "features"])
    got = KMeans(k=min(clusters, len(vocab)), seed=42).fit(data).transform(data).select("word", "prediction").collect()
    by: dict[int, list[str]] = {}
    for r in got:
        by.setdefault(r.prediction, []).append(r.word)
    return [sorted(ws, key=place.get)[:top] for _, ws in sorted(by.items()) if len(ws) > 1]


def key_ngrams(df: DataFrame, name: str, n: int = 15, least: int = 2) -> DataFrame:
    """ngram, score: two- and three-word phrases of highest summed TF-IDF."""
    words, _, _ = _vectorised(df, name, 1)
    grams = None
    for k in (2, 3):
        part = NGram(n=k, inputCol="words", outputCol="g").transform(words).select("row", F.explode("g").alias("ngram"))
        grams = part if grams is None else grams.union(part)
    total = words.count()
    per_row = grams.groupBy("row", "ngram").agg(F.count("*").alias("tf"))
    score = per_row.groupBy("ngram").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).where(F.col("df") >= least)
    return score.select("ngram", (F.col("tf") * (F.log((F.lit(1.0) + total) / (1 + F.col("df"))) + 1)).alias("score")).orderBy(F.desc("score"), "ngram").limit(n)


def domain_counts(df: DataFrame, name: str) -> DataFrame:
    """domain, rows: how many texts mention each subject."""
    t = F.lower(as_text(df, name))
    one = df.agg(*(F.count(F.when(t.rlike(domain_pattern(d)), 1)).alias(d) for d in DOMAINS))
    return one.select(F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), F.col(d).alias("rows")) for d in DOMAINS))).alias("x")).select("x.*")


def domain_terms(df: DataFrame, name: str) -> DataFrame:
    """domain, term, rows: how many texts have each word of the subjects that occurs at all."""
    t = F.lower(as_text(df, name))
    found = F.array(*(F.struct(F.lit(d).alias("domain"), F.array_distinct(F.regexp_extract_all(t, F.lit(domain_pattern(d)), F.lit(0))).alias("terms")) for d in DOMAINS))
    each = df.select(F.explode(found).alias("x")).select("x.domain", F.explode("x.terms").alias("term"))
    return each.groupBy("domain", "term").agg(F.count("*").alias("rows"))


#: A capitalised phrase inside a sentence, with the word before it.
_ENTITY = r"([A-Za-z0-9.]+[,;:]?) ((?!(?:Mr|Mrs|Ms|Dr|Prof)\b)[A-Z][A-Za-z0-9&'-]+(?: (?:of |the |and )?[A-Z][A-Za-z0-9&'-]+)*)"


def entities(df: DataFrame, name: str, top: int = 5, least: int = 2) -> DataFrame:
    """type, entity, count: the most frequent names of each type that occur ``least`` times.

    There is no trained tagger here: a name is a run of capitalised words that does not begin a
    sentence. It is an ORG by its last word or if it is all capitals, a PERSON behind a title or as
    two or three plain words, a GPE behind in, at, from, near or to, and else a PRODUCT.
    """
    found = df.select(F.explode(F.regexp_extract_all(as_text(df, name), F.lit(_ENTITY), F.lit(0))).alias("x"))
    pair = found.select(F.regexp_extract("x", _ENTITY, 1).alias("before"), F.regexp_extract("x", _ENTITY, 2).alias("e")).where(~F.col("before").rlike("[.]$") | F.col("before").rlike("^(Mr|Mrs|Ms|Dr|Prof)[.]$"))
    kind = (
        F.when(F.col("e").rlike(r"\b(Inc|Corp|Corporation|Ltd|LLC|GmbH|Company|Group|Bank|University|Institute|Agency|Association)$") | F.col("e").rlike("^[A-Z0-9&]{2,}$"), "ORG")
        .when(F.col("before").rlike("^(Mr|Mrs|Ms|Dr|Prof)[.]?$"), "PERSON")
        .when(F.lower("before").isin("in", "at", "from", "near", "to"), "GPE")
        .when(F.col("e").rlike("^[A-Z][a-z]+( [A-Z][a-z]+){1,2}$"), "PERSON")
        .otherwise("PRODUCT")
    )
    counts = pair.select(kind.alias("type"), F.lower("e").alias("entity")).groupBy("type", "entity").agg(F.count("*").alias("count")).where(F.col("count") >= least)
    turn = Window.partitionBy("type").orderBy(F.desc("count"), "entity")
    return counts.withColumn("_r", F.row_number().over(turn)).where(F.col("_r") <= top).drop("_r")


def concepts(df: DataFrame, name: str, *, analysis: str = "comprehensive", topics: int = 6) -> dict[str, list[str]]:
    """Concept -> words that tell it: topics, factors, names, word groups, phrases and subjects."""
    out: dict[str, list[str]] = {}
    if analysis not in ("comprehensive", "advanced", "topic_focused", "semantic_focused", "entity_focused"):
        raise ValueError(f"unknown analysis {analysis}")
    if analysis not in ("semantic_focused", "entity_focused"):
        out |= {f"topic_{'_'.join(ws[:2])}": ws for ws in topics_lda(df, name, topics) if ws}
        out |= {f"theme_{'_'.join(ws[:2])}": ws for ws in topics_nmf(df, name, topics) if ws}
    if analysis not in ("topic_focused", "semantic_focused"):
        out |= {f"entity_{r.type.lower()}_{r.entity}": [r.entity] for r in entities(df, name).orderBy("type", F.desc("count"), "entity").collect()}
    if analysis not in ("topic_focused", "entity_focused"):
        out |= {f"group_{'_'.join(ws[:2])}": ws for ws in word_clusters(df, name) if ws}
        out |= {f"phrase_{r.ngram}": [r.ngram] for r in key_ngrams(df, name).collect()}
        out |= {f"domain_{r.domain}": [domain_pattern(r.domain)] for r in domain_counts(df, name).collect() if r["rows"]}
    return out


def concept_flags(df: DataFrame, name: str, *, binary_format: str = "numeric", analysis: str = "comprehensive", topics: int = 6, max_features: int = 25) -> DataFrame:
    """Adds has_<concept> for at most ``max_features`` concepts: the text contains one of its words."""
    found = list(concepts(df, name, analysis=analysis, topics=topics).items())[:max_features]
    t = F.lower(as_text(df, name))
    hit = lambda label, ws: t.rlike(ws[0]) if label.startswith("domain_") else F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(t, w))
    names = _named("has", [label for label, _ in found], df.columns)
    return df.withColumns({c: _flag(hit(label, ws), binary_format) for c, (label, ws) in zip(names, found)})


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_1, column_2, correlation, together (rows that have both flags), strength; all pairs in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    schema = "column_1 string, column_2 string, correlation double, together bigint, strength string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    v = lambda c: quoted(c).cast("double")
    one = df.agg(*(f for i, (a, b) in enumerate(pairs) for f in (pearson(v(a), v(b)).alias(f"r{i}"), F.count(F.when((v(a) > 0) & (v(b) > 0), 1)).alias(f"t{i}"))))
    cells = [F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.coalesce(F.nanvl(F.col(f"r{i}"), F.lit(0.0)), F.lit(0.0)).alias("correlation"), F.col(f"t{i}").alias("together")) for i, (a, b) in enumerate(pairs)]
    out = one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    r = F.abs("correlation")
    return out.withColumn("strength", F.when(r > 0.7, "strong").when(r > 0.5, "moderate").otherwise("weak"))


def coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, coverage: percent of rows that have each flag."""
    cols = list(columns or [c for c in df.columns if c.startswith(("is_", "has_"))])
    one = df.agg(*(F.avg(F.when(quoted(c).cast("string").isin("1", "Yes", "true"), 100.0).otherwise(0.0)).alias(f"c{i}") for i, c in enumerate(cols)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("coverage")) for i, c in enumerate(cols)))).alias("x")).select("x.*")


def _binned(df: DataFrame, name: str, bins: int) -> Column:
    """Quantile bins as categories."""
    c = quoted(name).cast("double")
    q = quantiles(df, {name: c}, [i / bins for i in range(bins + 1)])[name]
    edges = sorted(set(q or []))
    out = F.lit(None).cast("string")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when(c <= F.lit(edges[i + 1]), F.lit(f"{edges[i]:g}..{edges[i + 1]:g}")).otherwise(out)
    return F.when(c.isNotNull(), out if len(edges) > 1 else F.lit(f"{edges[0]:g}" if edges else ""))


def related(df: DataFrame, target: str, *, max_features: int = 20, most_values: int = 60, bins: int = 5) -> DataFrame:
    """feature, source, value, correlation, strength, coverage: one-hot features of the other columns by |Pearson| with the target.

    A numeric target of over 15 values counts by its quantile bin, another by its alphabetical code.
    Numeric columns are encoded by quantile bins, texts by their words. One aggregation serves all.
    """
    numeric = set(numeric_columns(df))
    spark = df.sparkSession
    if target in numeric and df.select(quoted(target)).distinct().count() > 15:
        values = [r[0] for r in df.select(_binned(df, target, bins).alias("v")).where("v is not null").distinct().collect()]
        values.sort(key=lambda v: float(v.split("..")[0]))
        coded, code = _binned(df, target, bins), {v: i for i, v in enumerate(values)}
    elif target in numeric:
        coded, code = None, None
    else:
        values = [r[0] for r in df.select(as_text(df, target).alias("v")).where("v is not null").distinct().orderBy("v").limit(MOST_VALUES + 1).collect()]
        if len(values) > MOST_VALUES:
            raise ValueError(f"{target} has more than {MOST_VALUES} values")
        coded, code = as_text(df, target), {v: i for i, v in enumerate(values)}
    if code is None:
        y = quoted(target).cast("double")
    else:
        y = F.element_at(F.create_map(*(x for v, i in code.items() for x in (F.lit(v), F.lit(float(i))))), coded) if code else F.lit(None).cast("double")
    features: list[tuple[str, str, str, Column]] = []
    for c in df.columns:
        if c == target:
            continue
        cell = _binned(df, c, bins) if c in numeric else as_text(df, c)
        if c not in numeric and is_text(df, c):
            words = [r.word for r in top_words(df, c).collect()]
            features += [(f"has_{_safe(w)}", c, w, F.lower(as_text(df, c)).contains(w)) for w in words]
            continue
        found = [r[0] for r in df.select(cell.alias("v")).where("v is not null").distinct().orderBy("v").limit(most_values + 1).collect()]
        if len(found) <= most_values:
            features += [(f"is_{_safe(v)}", c, v, cell == v) for v in found]
    schema = "feature string, source string, value string, correlation double, coverage double"
    if not features:
        return spark.createDataFrame([], schema)
    flags = [F.coalesce(h, F.lit(False)).cast("double").alias(f"f{i}") for i, (*_, h) in enumerate(features)]
    data = df.select(y.alias("y"), *flags).where("y is not null")
    one = data.agg(*(a for i in range(len(features)) for a in (pearson(F.col("y"), F.col(f"f{i}")).alias(f"r{i}"), F.avg(f"f{i}").alias(f"m{i}"))))
    cells = [F.struct(F.lit(n).alias("feature"), F.lit(c).alias("source"), F.lit(v).alias("value"), F.col(f"r{i}").alias("correlation"), (100 * F.col(f"m{i}")).alias("coverage")) for i, (n, c, v, _) in enumerate(features)]
    out = one.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("correlation is not null and not isnan(correlation)")
    return out.orderBy(F.desc(F.abs("correlation")), "source", "feature").limit(max_features)


def compare_flag(df: DataFrame, flag: Column, target: str) -> DataFrame:
    """Rows with and without a flag: the mean of a numeric target, else the shares of its values."""
    if target in numeric_columns(df):
        return df.groupBy(flag.alias("present")).agg(F.count("*").alias("rows"), F.avg(quoted(target).cast("double")).alias("mean"))
    counts = df.groupBy(flag.alias("present"), as_text(df, target).alias("value")).agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("present")))
