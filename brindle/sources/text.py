"""Delimited text: sniffing on a small sample, then distributed reading; pasted text."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import quoted

SAMPLE = 4096
SEPARATORS = ",;\t"
ENCODINGS = ("utf-8", "iso-8859-1")
#: Texts that are read as missing values.
NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def head(spark: SparkSession, path: str, size: int = SAMPLE) -> bytes:
    """First bytes of a file, through the file systems Spark knows; the first file of a folder or pattern."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    found = fs.globStatus(target)
    if found is None or len(found) == 0:
        raise FileNotFoundError(path)
    first = found[0]
    if first.isDirectory():
        inside = sorted((s for s in fs.listStatus(first.getPath()) if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=lambda s: s.getPath().getName())
        if not inside:
            raise FileNotFoundError(path)
        first = inside[0]
    stream = fs.open(first.getPath())
    try:
        n = min(size, int(first.getLen()))
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)) if n else b""
    finally:
        stream.close()


def decode(sample: bytes) -> tuple[str, str]:
    """(text, encoding): the first encoding that reads the sample; a character cut at its end doesn't count."""
    for e in ENCODINGS:
        for cut in range(4):
            try:
                return sample[: len(sample) - cut].decode(e), e
            except UnicodeDecodeError:
                if e != "utf-8":
                    break
    return sample.decode("iso-8859-1"), "iso-8859-1"


def detect_quote(sample: str) -> str:
    return "'" if sample.count("'") > 2 * sample.count('"') and sample.count('"') == 0 else '"'


def detect_separator(sample: str) -> str:
    """With quotes, the separator that most often stands next to one; else mean count times consistency over lines that all have it."""
    lines = [x for x in sample.splitlines() if x.strip()]
    if not lines:
        return ","
    if '"' in sample:
        near = {s: sample.count(f'"{s}') + sample.count(f'{s}"') for s in SEPARATORS}
        if max(near.values()):
            return max(SEPARATORS, key=near.get)
    if len(lines) > 2:
        lines = lines[:-1]  # the last may be cut
    best, score = ",", 0.0
    for s in SEPARATORS:
        counts = [x.count(s) for x in lines]
        if min(counts) > 0:
            v = sum(counts) / len(counts) * (1.0 if len(set(counts)) == 1 else 0.5)
            if v > score:
                best, score = s, v
    return best


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, *, dates: bool = False) -> DataFrame:
    """Texts as whole numbers, doubles, booleans (or dates, if asked) where every non-null value converts; one pass."""
    cols = list(columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])
    if not cols:
        return df
    kinds = ["bigint", "double", "boolean", *(["date", "timestamp_ntz"] if dates else [])]
    text = lambda c: F.trim(quoted(c))

    def converts(c: str, kind: str) -> Column:
        if kind == "boolean":
            return F.lower(text(c)).isin("true", "false")
        return text(c).try_cast(kind).isNotNull()

    aggs = [F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(cols)]
    aggs += [F.count(F.when(converts(c, k), 1)).alias(f"{k}{i}") for i, c in enumerate(cols) for k in kinds]
    row = df.agg(*aggs).first()
    changes = {}
    for i, c in enumerate(cols):
        for k in kinds:
            if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]:
                changes[c] = text(c).try_cast(k)
                break
    return df.select(*(changes[c].alias(c) if c in changes else quoted(c) for c in df.columns))


def _unique(names: Sequence[str]) -> list[str]:
    out, used = [], set()
    for i, n in enumerate(names):
        base = n = (n or "").strip() or f"column_{i + 1}"
        k = 1
        while n.lower() in used:
            n, k = f"{base}_{k}", k + 1
        used.add(n.lower())
        out.append(n)
    return out


def read_delimited(spark: SparkSession, path: str, *, sep: str | None = None, types: bool = True, max_rows: int | None = None, bad_lines: str = "skip") -> DataFrame:
    """CSV, TSV or TXT with a header. Separator, quote and encoding come from the first 4 KB.

    Missing-value texts become null, then types are inferred (dates stay texts). ``bad_lines``:
    skip, or keep (in ``_corrupt``). All rows are read; ``max_rows`` limits them.
    """
    text, encoding = decode(head(spark, path))
    sep = sep or ("\t" if path.lower().endswith(".tsv") else detect_separator(text))
    quote = detect_quote(text)
    first = next(csv.reader(io.StringIO(text), delimiter=sep, quotechar=quote), [])
    names = _unique(first)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    if bad_lines == "keep":
        schema += ", _corrupt string"
    if not names:
        return spark.createDataFrame([], "empty string").drop("empty")
    reader = spark.read.schema(schema).options(header=True, sep=sep, quote=quote, escape=quote, encoding=encoding, multiLine="\n" in "".join(first) or f"{quote}\n" in text, mode="PERMISSIVE" if bad_lines == "keep" else "DROPMALFORMED", columnNameOfCorruptRecord="_corrupt", enforceSchema=True, ignoreLeadingWhiteSpace=False)
    df = reader.csv(path)
    df = df.select(*(F.when(~quoted(n).isin(*NA), quoted(n)).alias(n) if n != "_corrupt" else quoted(n) for n in df.columns))
    if max_rows is not None:
        df = df.limit(max_rows)
    return infer_types(df, names) if types else df


# -- pasted text -------------------------------------------------------------
_PASTE = "\t,;|"
# Parts of names that are usual in headers.
_HEADER_WORDS = (
    "id", "name", "date", "time", "type", "status", "count",
    "amount", "price", "value", "total", "col", "column",
    "field", "key", "index", "num", "code", "description",
)


def is_table_text(text: str) -> bool:
    """Two lines or more in which some delimiter occurs about equally often (within one, over the first ten)."""
    lines = [x for x in text.strip().splitlines() if x.strip()][:10]
    if len(lines) < 2:
        return False
    return any(min(c := [x.count(d) for x in lines]) > 0 and max(c) - min(c) <= 1 for d in _PASTE)


def paste_delimiter(text: str) -> str:
    """The delimiter of greatest mean / (1 + variance), at a mean of one or more; else tab."""
    lines = [x for x in text.strip().splitlines() if x.strip()][:20]
    best, score = "\t", 0.0
    for d in _PASTE:
        c = [x.count(d) for x in lines]
        if c and (mean := sum(c) / len(c)) >= 1:
            v = mean / (1 + sum((x - mean) ** 2 for x in c) / len(c))
            if v > score:
                best, score = d, v
    return best


def _is_number(s: str) -> bool:
    try:
        float(s.replace(",", "").replace(" ", ""))
        return True
    except ValueError:
        return False


def has_header(rows: Sequence[Sequence[str]]) -> bool:
    """Whether the first row names the columns; a lone row does.

    Strong signs: a cell that is no number above a number within five rows, or a word usual in headers. Without them a first row without numbers is one.
    """
    if len(rows) < 2:
        return True
    first, rest = rows[0], rows[1:6]
    names = [i for i, x in enumerate(first) if x.strip() and not _is_number(x)]
    if any(_is_number(r[i]) for i in names for r in rest if i < len(r)):
        return True
    if any(w in first[i].lower() for i in names for w in _HEADER_WORDS):
        return True
    return not any(_is_number(x) for x in first)


def parse_pasted(spark: SparkSession, text: str) -> tuple[DataFrame, str]:
    """A table from pasted text and a message. Columns become numbers if more than half of their values convert (the rest null)."""
    if not text.strip():
        raise ValueError("nothing was pasted")
    delimiter = paste_delimiter(text)
    rows = [r for r in csv.reader(io.StringIO(text.strip("\r\n")), delimiter=delimiter) if any(x.strip() for x in r)]
    header = has_header(rows)
    width = max(map(len, rows))
    names = _unique([*(rows[0] if header else []), *([""] * (width - (len(rows[0]) if header else 0)))])
    data = [[x if x.strip() not in NA else None for x in (*r, *([""] * (width - len(r))))] for r in rows[1 if header else 0 :]]
    columns = []
    for i in range(width):
        values = [r[i] for r in data]
        known = [v for v in values if v is not None]
        numbers = [v for v in known if _is_number(v)]
        if known and len(numbers) > len(known) / 2:
            cast = [float(v.replace(",", "").replace(" ", "")) if v is not None and _is_number(v) else None for v in values]
            whole = all(v is None or v == int(v) for v in cast if v is None or abs(v) < 2**53)
            columns.append(([None if v is None else int(v) for v in cast], "bigint") if whole else (cast, "double"))
        else:
            columns.append((values, "string"))
    schema = ", ".join(f"`{n.replace('`', '``')}` {k}" for n, (_, k) in zip(names, columns))
    df = spark.createDataFrame(list(zip(*(c for c, _ in columns))) if data else [], schema)
    return df, f"{len(data)} rows, {width} columns, delimiter {delimiter!r}, header {'found' if header else 'not found'}"


def to_tsv(df: DataFrame, limit: int = 100_000) -> str:
    """Header and rows as tab-separated text, values unformatted; at most ``limit`` rows reach the driver."""
    out = io.StringIO()
    w = csv.writer(out, delimiter="\t", lineterminator="\n")
    w.writerow(df.columns)
    for r in df.limit(limit).toLocalIterator():
        w.writerow(["" if v is None else v for v in r])
    return out.getvalue()
