"""Workbooks (.xlsx): first sheet, header in the first row, one task per workbook."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that are dates or times.
_DATE_FORMATS = set(range(14, 23)) | {45, 46, 47}
_EPOCH = dt.datetime(1899, 12, 30)


def read_excel(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").load(list(paths))
    return parse_workbooks(files, schema=schema)


def parse_workbooks(files: DataFrame, schema: T.StructType | None = None,
                    content: str = "content") -> DataFrame:
    """Rows of all workbooks in a binary column, stacked by header name.

    Without a schema, one extra pass over the workbooks finds the columns and
    their types.
    """
    source = files.select(content)
    schema = schema or _infer(source)
    names = [f.name for f in schema]
    kinds = {f.name: f.dataType for f in schema}

    def load(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            for blob in batch.iloc[:, 0]:
                header, rows = read_sheet(bytes(blob))
                at = {h: i for i, h in enumerate(header)}
                columns = {
                    n: pd.Series([_fit(r[at[n]], kinds[n]) if n in at else None for r in rows], dtype=object)
                    for n in names
                }
                yield pd.DataFrame(columns, columns=names)

    return source.mapInPandas(load, schema)


def _infer(source: DataFrame) -> T.StructType:
    def kinds(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            found: dict[str, tuple[int, set]] = {}
            for blob in batch.iloc[:, 0]:
                header, rows = read_sheet(bytes(blob))
                for i, h in enumerate(header):
                    seen = found.setdefault(h, (i, set()))[1]
                    seen.update(type(r[i]).__name__ for r in rows if r[i] is not None)
            yield pd.DataFrame([(h, i, k) for h, (i, ks) in found.items() for k in (ks or {"none"})],
                               columns=["name", "position", "kind"])

    found = (
        source.mapInPandas(kinds, "name string, position int, kind string")
        .groupBy("name").agg(F.min("position").alias("position"), F.collect_set("kind").alias("kinds"))
        .orderBy("position", "name").collect()
    )
    if not found:
        raise FileNotFoundError("no workbooks")
    return T.StructType([T.StructField(r.name, _spark_type(set(r.kinds) - {"none"})) for r in found])


def _spark_type(kinds: set[str]) -> T.DataType:
    if kinds == {"int"}:
        return T.LongType()
    if kinds and kinds <= {"int", "float"}:
        return T.DoubleType()
    if kinds == {"bool"}:
        return T.BooleanType()
    if kinds == {"datetime"}:
        return T.TimestampNTZType()
    return T.StringType()


def _fit(value, data_type: T.DataType):
    if value is None:
        return None
    if isinstance(data_type, T.StringType):
        return value if isinstance(value, str) else str(value)
    if isinstance(data_type, T.FractionalType):
        return float(value)
    if isinstance(data_type, T.IntegralType):
        return int(value)
    return value


def read_sheet(blob: bytes) -> tuple[list[str], list[list]]:
    """Header and rows of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(blob)) as book:
        shared = _shared_strings(book)
        dates = _date_styles(book)
        grid: list[dict[int, object]] = []
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != _MAIN + "row":
                    continue
                cells = {}
                for i, c in enumerate(row.iter(_MAIN + "c")):
                    value = _cell(c, shared, dates)
                    if value is not None:
                        cells[_column(c.get("r"), i)] = value
                grid.append(cells)
                row.clear()
    if not grid:
        return [], []
    width = max((max(r) + 1 for r in grid if r), default=0)
    header = [str(grid[0].get(i, f"Unnamed: {i}")) for i in range(width)]
    return header, [[r.get(i) for i in range(width)] for r in grid[1:]]


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet")
    wanted = next(sheets).get(_REL)
    for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == wanted:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    raise ValueError("workbook has no sheet")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in root.iter(_MAIN + "si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")) for f in root.iter(_MAIN + "numFmt")
        if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())
    }
    formats = root.find(_MAIN + "cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else [])
            if int(x.get("numFmtId", 0)) in _DATE_FORMATS | custom}


def _column(reference: str | None, fallback: int) -> int:
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return fallback
    n = 0
    for ch in letters.group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _cell(c, shared: list[str], dates: set[int]):
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(_MAIN + "t"))
    v = c.find(_MAIN + "v")
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind == "str":
        return v.text
    if kind == "e":
        return None
    number = float(v.text)
    if int(c.get("s", 0)) in dates:
        return _EPOCH + dt.timedelta(days=number)
    return int(number) if number.is_integer() and "." not in v.text and "E" not in v.text.upper() else number
