"""Document files: one row per page, or per file for formats without pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions import text as X
from tabforge.functions.workspace import spread

# Suffixes read as documents.
TEXT_SUFFIXES = (".txt", ".md", ".rst")
BINARY_SUFFIXES = (".pdf", ".docx", ".doc")
PAGES = "array<struct<page: int, total_pages: int, text: string, char_count: bigint>>"
_PAGES = pa.list_(pa.struct([("page", pa.int32()), ("total_pages", pa.int32()), ("text", pa.string()), ("char_count", pa.int64())]))
#: Bytes of files that a worker parses at once, unless one file is larger.
PART_BYTES = 1 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

# An extractor returns the pages of one file as (page number, total pages, text).
Extractor = Callable[[bytes], Iterable[tuple[int, int, str]]]


def read_documents(spark: SparkSession, *paths: str, label_from_dir: bool = False,
                   extractors: Mapping[str, Extractor] | None = None) -> DataFrame:
    """Documents under the paths; other suffixes are skipped.

    A file that cannot be read yields one row with its error as the text.
    """
    def scan(suffixes: tuple[str, ...]) -> DataFrame:
        return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                .option("pathGlobFilter", X.suffix_glob(suffixes)).load(list(paths)).select("path", "content"))

    # Each scan lists and opens only its own files.
    rows = text_documents(scan(TEXT_SUFFIXES)).unionByName(
        extracted_documents(spread(scan(BINARY_SUFFIXES)), extractors))
    return _labelled(rows, label_from_dir)


def parse_documents(files: DataFrame, *, label_from_dir: bool = False,
                    extractors: Mapping[str, Extractor] | None = None) -> DataFrame:
    """Rows of the documents in a (path, content) frame, whose plan runs once.

    Python gets the contents of files that need a parser only; plain text is decoded in the JVM.
    """
    files = files.select("path", "content", X.suffix(F.col("path")).alias("__suffix"))
    files = files.where(F.col("__suffix").isin(*TEXT_SUFFIXES, *BINARY_SUFFIXES))
    is_text = F.col("__suffix").isin(*TEXT_SUFFIXES)
    parsed = files.withColumn("__pages", _parser(extractors)(F.when(~is_text, F.col("content")), "__suffix"))
    plain = F.struct(F.lit(1), F.lit(1), X.clean_document(F.col("content")), F.lit(None))
    pages = F.when(is_text, F.array(plain).cast(PAGES)).otherwise(F.col("__pages"))
    rows = _exploded(parsed, pages).where(F.col("text") != "")
    size = F.coalesce("char_count", F.char_length("text").cast("bigint"))
    return _labelled(rows.withColumn("char_count", size), label_from_dir)


def _exploded(files: DataFrame, pages: Column) -> DataFrame:
    path = F.col("path")
    return files.select(X.file_name(path).alias("filename"), X.plain_path(path).alias("source"),
                        F.explode(pages).alias("page")).select("filename", "source", "page.*")


def _labelled(rows: DataFrame, label_from_dir: bool) -> DataFrame:
    return rows.withColumn("label", X.parent_name(F.col("source"))) if label_from_dir else rows


def text_documents(files: DataFrame) -> DataFrame:
    """Plain text files, decoded and stripped without leaving the JVM."""
    cleaned = files.select(
        X.file_name(F.col("path")).alias("filename"),
        X.plain_path(F.col("path")).alias("source"),
        F.lit(1).alias("page"),
        F.lit(1).alias("total_pages"),
        X.clean_document(F.col("content")).alias("text"),
    )
    kept = cleaned.where(F.col("text") != "")
    return kept.withColumn("char_count", F.char_length("text").cast("bigint"))


def extracted_documents(files: DataFrame,
                        extractors: Mapping[str, Extractor] | None = None) -> DataFrame:
    """Files that need a parser, one file at a time inside the tasks."""
    return _exploded(files, _parser(extractors)("content", X.suffix(F.col("path"))))


def _parser(extractors: Mapping[str, Extractor] | None):
    """Pages of a file's content by its suffix; one page with the error if it cannot be read, none without an extractor."""
    known: dict[str, Extractor] = {".pdf": pdf_pages, ".docx": docx_pages, ".doc": docx_pages}
    known.update(extractors or {})

    def row(*values) -> dict:
        return dict(zip(("page", "total_pages", "text", "char_count"), values))

    def pages(blob: bytes, suffix: str) -> list[dict]:
        try:
            stripped = [(page, total, text.strip()) for page, total, text in known[suffix](bytes(blob))]
            return [row(page, total, text, len(text)) for page, total, text in stripped if text]
        except Exception as error:  # one bad file must not stop the job
            return [row(1, 1, f"[ERROR: {error}]", 0)]

    @F.arrow_udf(PAGES)
    def parse(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for content, suffix in parts(batches):
            yield pa.array([pages(c.as_py(), s.as_py()) if s.as_py() in known else [] for c, s in zip(content, suffix)], _PAGES)

    return parse


def parts(batches: Iterable[tuple[pa.Array, ...]]) -> Iterator[list[pa.Array]]:
    """The same rows in parts of about ``PART_BYTES``, so that a worker makes objects and results of a few files at a time."""
    for batch in batches:
        n = len(batch[0])
        step = max(1, PART_BYTES * n // max(1, sum(a.nbytes for a in batch)))
        for at in range(0, n, step):
            yield [a.slice(at, step) for a in batch]


def docx_pages(blob: bytes) -> list[tuple[int, int, str]]:
    """Non-blank paragraphs of the document body, one per line."""
    with zipfile.ZipFile(io.BytesIO(blob)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_W + "body")
    lines = [_paragraph(p) for p in body.findall(_W + "p")]
    return [(1, 1, "\n".join(line for line in lines if line.strip()))]


def _paragraph(p) -> str:
    pieces = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n"}
    return "".join((node.text or "") if node.tag == _W + "t" else pieces.get(node.tag, "")
                   for node in p.iter())


def pdf_pages(blob: bytes) -> list[tuple[int, int, str]]:
    from pypdf import PdfReader

    pages = PdfReader(io.BytesIO(blob)).pages
    return [(i, len(pages), page.extract_text() or "") for i, page in enumerate(pages, start=1)]
