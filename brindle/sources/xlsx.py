"""Spreadsheets (.xlsx): a Python data source and a writer, with the standard library only."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROWS = 1_048_576
#: Built-in number formats that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
EPOCH = dt.datetime(1899, 12, 30)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def rows(content: bytes, sheet: int = 0) -> Iterator[list]:
    """Cells of each row of a sheet; missing ones are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
            cells = styles.find(f"{MAIN}cellXfs")
            for x in cells if cells is not None else []:
                i = int(x.get("numFmtId", 0))
                code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(i, ""))
                dates.append(i in DATE_FORMATS or bool(re.search(r"[ymdhs]", code, re.I)))
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        with z.open(sheets[sheet]) as f:
            last = 0
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                at = int(row.get("r", last + 1))
                for _ in range(last + 1, at):
                    yield []
                last = at
                out: list = []
                for c in row.iter(f"{MAIN}c"):
                    i = _column(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (i + 1 - len(out))
                    kind, v = c.get("t"), c.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        out[i] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    elif v is None or v.text is None:
                        out[i] = None
                    elif kind == "s":
                        out[i] = shared[int(v.text)]
                    elif kind == "b":
                        out[i] = v.text == "1"
                    elif kind in ("str", "e", "d"):
                        out[i] = None if kind == "e" else v.text
                    else:
                        x = float(v.text)
                        style = int(c.get("s", 0))
                        if style < len(dates) and dates[style]:
                            out[i] = EPOCH + dt.timedelta(milliseconds=round(x * 86_400_000))
                        else:
                            out[i] = int(x) if x == int(x) and "." not in v.text and abs(x) < 2**53 else x
                yield out
                row.clear()


def _types(data: list[list], width: int) -> list[T.DataType]:
    out: list[T.DataType] = []
    for i in range(width):
        seen = {type(r[i]) for r in data if i < len(r) and r[i] is not None}
        if seen == {int}:
            out.append(T.LongType())
        elif seen and seen <= {int, float}:
            out.append(T.DoubleType())
        elif seen == {bool}:
            out.append(T.BooleanType())
        elif seen == {dt.datetime}:
            out.append(T.TimestampNTZType())
        else:
            out.append(T.StringType())
    return out


def parse(content: bytes, sheet: int = 0) -> tuple[T.StructType, list[tuple]]:
    from .text import _unique

    every = list(rows(content, sheet))
    if not every:
        return T.StructType([]), []
    width = max(map(len, every))
    names = _unique([str(x) if x is not None else "" for x in every[0]] + [""] * (width - len(every[0])))
    data = [r + [None] * (width - len(r)) for r in every[1:] if any(x is not None for x in r)]
    kinds = _types(data, width)
    fix = [str if isinstance(k, T.StringType) else float if isinstance(k, T.DoubleType) else (lambda x: x) for k in kinds]
    return T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]), [tuple(None if x is None else f(x) for f, x in zip(fix, r)) for r in data]


class XlsxSource(DataSource):
    """format("brindle_xlsx").load(path): the first (or ``sheet``-th) sheet with a header row."""

    @classmethod
    def name(cls) -> str:
        return "brindle_xlsx"

    def _content(self) -> bytes:
        with open(self.options["path"].removeprefix("file:"), "rb") as f:
            return f.read()

    def schema(self):
        return parse(self._content(), int(self.options.get("sheet", 0)))[0]

    def reader(self, schema):
        return _XlsxReader(self._content(), int(self.options.get("sheet", 0)))


class _XlsxReader(DataSourceReader):
    """The file travels with the plan (a sheet has a million rows at most), so executors need no access to its folder."""

    def __init__(self, content: bytes, sheet: int):
        self.content, self.sheet = content, sheet

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        yield from parse(self.content, self.sheet)[1]


def read_xlsx(spark: SparkSession, path: str, *, sheet: int = 0, max_rows: int | None = None) -> DataFrame:
    if path.lower().endswith(".xls"):
        raise ValueError("the binary .xls format is not supported; save the file as .xlsx")
    spark.dataSource.register(XlsxSource)
    df = spark.read.format("brindle_xlsx").option("sheet", sheet).load(path)
    return df.limit(max_rows) if max_rows is not None else df


def _cell(ref: str, v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and v not in (float("inf"), float("-inf")):
        return f'<c r="{ref}"><v>{v!r}</v></c>' if not isinstance(v, int) or abs(v) < 2**53 else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    if isinstance(v, dt.datetime):
        return f'<c r="{ref}" s="1"><v>{(v.replace(tzinfo=None) - EPOCH) / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(v, dt.date):
        return f'<c r="{ref}" s="1"><v>{(dt.datetime(v.year, v.month, v.day) - EPOCH).days}</v></c>'
    text = v.hex() if isinstance(v, (bytes, bytearray)) else str(v)
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_xlsx(df: DataFrame, path: str) -> int:
    """Write a table as one sheet, row by row from the executors; returns the rows. More than a sheet holds is an error."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet {ns}><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f"{head}<worksheet {ns}><sheetData>".encode())
            letters = [_letters(i) for i in range(len(df.columns))]
            put = lambda k, values: f.write((f'<row r="{k}">' + "".join(_cell(f"{c}{k}", v) for c, v in zip(letters, values)) + "</row>").encode())
            put(1, df.columns)
            for r in df.toLocalIterator(prefetchPartitions=True):
                n += 1
                if n + 1 > ROWS:
                    raise ValueError(f"a sheet holds {ROWS} rows")
                put(n + 1, r)
            f.write(b"</sheetData></worksheet>")
    return n
