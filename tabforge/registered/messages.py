"""Message decoding, record extraction and documents over the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.messages import explode_messages, extract_records, parse_messages
from tabforge.registered.base import query, spread_table
from tabforge.sources import documents as D

# --- messages -------------------------------------------------------------------

_MESSAGES = """
SELECT event_id, CASE
  WHEN event_id % 13 = 0 THEN '[' || props || ', 7, ' || props || ']'
  WHEN event_id % 11 = 0 THEN CAST(event_id AS VARCHAR)
  WHEN event_id % 10 = 0 THEN 'not json ' || event_type
  WHEN event_id % 17 = 0 THEN NULL
  WHEN event_id % 19 = 0 THEN props || ' trailing'
  WHEN event_id % 23 = 0 THEN '"' || event_type || '"'
  WHEN event_id % 29 = 0 THEN '[]'
  ELSE props END AS message FROM events
"""


def event_messages(events: DataFrame) -> DataFrame:
    """The events' properties as messages of every kind."""
    key, props = F.col("event_id"), F.col("props")
    message = (
        F.when(key % 13 == 0, F.concat(F.lit("["), props, F.lit(", 7, "), props, F.lit("]")))
        .when(key % 11 == 0, key.cast("string"))
        .when(key % 10 == 0, F.concat(F.lit("not json "), "event_type"))
        .when(key % 17 == 0, None)
        .when(key % 19 == 0, F.concat(props, F.lit(" trailing")))
        .when(key % 23 == 0, F.concat(F.lit('"'), "event_type", F.lit('"')))
        .when(key % 29 == 0, "[]")
        .otherwise(props)
    )
    return events.select("event_id", message.cast("binary").alias("message"))


PARSED = f"""
SELECT event_id, kind,
       CASE WHEN kind = 'object' THEN CAST(json_extract(message, '$.k') AS BIGINT) END AS k,
       CASE WHEN kind = 'value' THEN CASE WHEN json_type(message) = 'VARCHAR'
            THEN json_extract_string(message, '$') ELSE CAST(json(message) AS VARCHAR) END END AS value,
       CASE WHEN kind = 'raw' THEN message END AS raw
FROM (SELECT *, CASE WHEN NOT coalesce(json_valid(message), false) THEN 'raw'
                     WHEN json_type(message) = 'OBJECT' THEN 'object' ELSE 'value' END AS kind
      FROM ({_MESSAGES}))
"""
EXPLODED = f"""
WITH m AS (SELECT event_id, message, CASE WHEN coalesce(json_valid(message), false)
             THEN json_type(message) ELSE 'raw' END AS t FROM ({_MESSAGES})),
     items AS (
       SELECT event_id, unnest(range(len(l))) AS position, unnest(l) AS item, NULL AS raw
       FROM (SELECT event_id, CAST(message AS JSON[]) AS l FROM m WHERE t = 'ARRAY')
       UNION ALL SELECT event_id, 0, CAST(message AS JSON), NULL FROM m WHERE t NOT IN ('ARRAY', 'raw')
       UNION ALL SELECT event_id, 0, NULL, message FROM m WHERE t = 'raw')
SELECT event_id, position, CASE WHEN item IS NULL THEN 'raw' WHEN json_type(item) = 'OBJECT' THEN 'object'
         ELSE 'value' END AS kind,
       CASE WHEN json_type(item) = 'OBJECT' THEN CAST(json_extract(item, '$.k') AS BIGINT) END AS k,
       CASE WHEN json_type(item) <> 'OBJECT' THEN json_extract_string(item, '$') END AS value, raw
FROM items
"""


@query("parse_messages", PARSED)
def parsed(spark, sf_dir):
    return parse_messages(event_messages(spread_table(spark, sf_dir, "events")), "message", {"k": "bigint"})


@query("explode_messages", EXPLODED)
def exploded(spark, sf_dir):
    return explode_messages(event_messages(spread_table(spark, sf_dir, "events")), "message", {"k": "bigint"})


@query("extract_records", """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, unnest(range(len(lines))) AS position, unnest(lines) AS line FROM d WHERE doc_id % 3 < 2
UNION ALL SELECT doc_id, 0, text FROM d WHERE doc_id % 3 = 2
""")
def records(spark, sf_dir):
    """Lines of each document out of a list payload, a keyed list, or a single record."""
    docs = spread_table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line")))
    payload = (
        F.when(F.col("doc_id") % 3 == 0, F.to_json(lines))
        .when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(lines.alias("data"), F.lit(1).alias("page"))))
        .otherwise(F.to_json(F.struct(F.struct(F.col("text").alias("line")).alias("data"))))
    )
    return extract_records(docs.select("doc_id", payload.alias("payload")), "payload", {"line": "string"}, "data")


# --- documents --------------------------------------------------------------------

def document_files(spark, sf_dir, suffix: F.Column, content: F.Column) -> DataFrame:
    path = F.concat(F.lit("file:/docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), suffix)
    return spread_table(spark, sf_dir, "documents").select(path.alias("path"), content.alias("content"))


def _doc_id():
    return F.regexp_extract("filename", r"^(\d+)", 1).cast("bigint").alias("doc_id")


@query("extract_documents", """
SELECT doc_id, 1 AS page, 1 AS total_pages, length(text) AS char_count, text, lang AS label FROM documents
""")
def extract_documents(spark, sf_dir):
    """Padded text files with Windows line ends, cleaned back to the documents' text."""
    padded = F.concat(F.lit("\r\n  \t"), F.regexp_replace("text", "\n", "\r\n"), F.lit("  \r\n"))
    files = document_files(spark, sf_dir, F.lit(".txt"), padded.cast("binary"))
    rows = D.parse_documents(files, label_from_dir=True)
    return rows.select(_doc_id(), "page", "total_pages", "char_count", "text", "label")


@F.arrow_udf(T.BinaryType())
def docx_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Word files with one paragraph per line."""
    head = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'

    def build(t: str | None) -> bytes | None:
        if t is None:
            return None
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in t.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f"{head}{body}</w:body></w:document>")
        return out.getvalue()

    for (text,) in D.parts((text,) for text in batches):
        yield pa.array([build(t.as_py()) for t in text], pa.binary())


_PARAGRAPHS = "trim(array_to_string([x FOR x IN string_split(text, chr(10)) IF trim(x) <> ''], chr(10)))"


@query("extract_docx", f"SELECT doc_id, length({_PARAGRAPHS}) AS char_count, {_PARAGRAPHS} AS text FROM documents")
def extract_docx(spark, sf_dir):
    files = document_files(spark, sf_dir, F.lit(".docx"), docx_bytes("text"))
    return D.parse_documents(files).select(_doc_id(), "char_count", "text")


@query("extract_documents_job", f"""
SELECT doc_id, ['.txt', '.md', '.docx', '.doc', '.rst'][doc_id % 5 + 1] AS suffix, doc_id % 5 = 3 AS failed,
       CASE WHEN doc_id % 5 = 3 THEN 0 WHEN doc_id % 5 = 2 THEN length({_PARAGRAPHS}) ELSE length(text) END
       AS char_count
FROM documents
""")
def extract_documents_job(spark, sf_dir):
    """Files of all kinds in one job: unreadable ones give an error row."""
    kind = F.col("doc_id") % 5
    suffixes = F.array(*[F.lit(s) for s in (".txt", ".md", ".docx", ".doc", ".rst")])
    plain = F.col("text").cast("binary")
    content = F.when(kind == 2, docx_bytes(F.when(kind == 2, F.col("text")))).otherwise(plain)
    files = document_files(spark, sf_dir, F.element_at(suffixes, (kind + 1).cast("int")), content)
    rows = D.parse_documents(files)
    return rows.select(_doc_id(), F.regexp_extract("filename", r"(\.\w+)$", 1).alias("suffix"),
                       F.col("text").startswith("[ERROR: ").alias("failed"), "char_count")
