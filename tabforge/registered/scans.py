"""Sources, sinks and row operators over the given tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterable
from urllib.parse import urlparse
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions import text as X
from tabforge.functions.workspace import scratch_path
from tabforge.operators.combine import merge_sources
from tabforge.operators.rows import chunk_rows, sample_rows
from tabforge.operators.runs import label_from_path
from tabforge.registered.base import query, table
from tabforge.sources import excel, files


@query("scan_parquet", "SELECT * FROM lineitem")
def scan_parquet(spark, sf_dir):
    return files.read_parquet(spark, f"{sf_dir}/lineitem.parquet")


@query("scan_csv", "SELECT * FROM orders")
def scan_csv(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "orders-csv")
    orders.write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv(spark, path, schema=orders.schema)


@query("scan_csv_inferred", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv_inferred(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    return files.read_csv(spark, path)


@query("scan_json", "SELECT * FROM conversations")
def scan_json(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    path = scratch_path(spark, "conversations-json")
    turns.write.json(path)
    return files.read_json(spark, path, schema=turns.schema)


def write_arrow(df: DataFrame, path: str) -> None:
    """One Arrow file per task; a retried task replaces its file as a whole."""
    def save(batches: Iterable[pa.RecordBatch]):
        writer = None
        parsed = urlparse(path)
        if parsed.scheme in ("", "file"):
            fs, folder = pafs.LocalFileSystem(), parsed.path
        else:
            fs, folder = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        fs.create_dir(folder)
        part = f"part-{TaskContext.get().partitionId():06d}.arrow"
        draft = f"{folder}/.{part}-{uuid.uuid4().hex}"
        rows = 0
        for b in batches:
            if writer is None:
                sink = fs.open_output_stream(draft)
                writer = ipc.new_file(sink, b.schema)
            writer.write_batch(b)
            rows += b.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(draft, f"{folder}/{part}")
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    df.mapInArrow(save, "rows bigint").agg(F.sum("rows")).collect()


@query("scan_arrow", "SELECT * FROM events")
def scan_arrow(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    path = scratch_path(spark, "events-arrow")
    write_arrow(events, path)
    return files.read_arrow(spark, path, schema=events.schema)


def workbook(batch: pa.RecordBatch) -> bytes:
    """A minimal workbook with the batch's rows on its first sheet."""
    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    rows = [batch.schema.names, *zip(*[c.to_pylist() for c in batch.columns])]
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
                                      '<sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="r1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml",
                   f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


@query("scan_excel", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_excel(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")

    def books(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([workbook(b)], pa.binary())], names=["content"])

    blobs = customers.mapInArrow(books, "content binary")
    return excel.parse_workbooks(blobs, schema=customers.schema)


_STACKED = """
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal,
       c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS region_hint {tag1} FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 'r' || (s_nationkey % 5) {tag2} FROM supplier
"""


def _parties(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf_dir, "customer").toDF("key", "name", "nationkey", "acctbal", "segment")
    suppliers = table(spark, sf_dir, "supplier").toDF("key", "name", "nationkey", "acctbal")
    hint = F.concat(F.lit("r"), (F.col("nationkey") % 5).cast("string"))
    return customers, suppliers.withColumn("region_hint", hint)


@query("scan_multi_concat", _STACKED.format(tag1="", tag2=""))
def scan_multi_concat(spark, sf_dir):
    customers, suppliers = _parties(spark, sf_dir)
    root = scratch_path(spark, "parties")
    customers.write.parquet(f"{root}/customers.parquet")
    suppliers.write.option("header", True).csv(f"{root}/suppliers.csv")
    return files.read_table(spark, [f"{root}/customers.parquet", f"{root}/suppliers.csv"])


# Supplier files differ from customer files: other order, one column fewer and one more.
_MIXED = _STACKED.format(tag1="", tag2="")


def _mixed_frames(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    customers, suppliers = _parties(spark, sf_dir)
    return customers, suppliers.select("nationkey", "region_hint", "key", "acctbal", "name")


@query("scan_csv_glob_mixed", _MIXED)
def scan_csv_glob_mixed(spark, sf_dir):
    """One glob over files with other headers, delimiters and quoted line breaks."""
    customers, suppliers = _mixed_frames(spark, sf_dir)
    root = scratch_path(spark, "mixed-csv")
    broken = customers.withColumn("segment", F.concat(F.substring("segment", 1, 3), F.lit("\n"), F.substring("segment", 4, 99)))
    broken.write.options(header=True, escape='"').csv(f"{root}/customers")
    suppliers.write.options(header=True, escape='"', sep=";").csv(f"{root}/suppliers")
    found = files.read_table(spark, f"{root}/*/*.csv")
    return found.withColumn("segment", F.replace("segment", F.lit("\n"), F.lit(""))).select(
        "key", "name", "nationkey", "acctbal", "segment", "region_hint")


@query("scan_parquet_glob_mixed", _MIXED)
def scan_parquet_glob_mixed(spark, sf_dir):
    root = scratch_path(spark, "mixed-parquet")
    for name, df in zip(("customers", "suppliers"), _mixed_frames(spark, sf_dir)):
        df.write.parquet(f"{root}/{name}")
    return files.read_table(spark, f"{root}/*/*.parquet").select("key", "name", "nationkey", "acctbal", "segment", "region_hint")


@query("scan_parquet_conflicting", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice, o_orderstatus FROM orders")
def scan_parquet_conflicting(spark, sf_dir):
    """Many files of three schemas that do not merge, in folders that hold a column."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    root = scratch_path(spark, "conflicting-parquet")
    for status, kind in {"F": "int", "O": "string", "P": "bigint"}.items():
        some = orders.where(F.col("o_orderstatus") == status).withColumn("o_custkey", F.col("o_custkey").cast(kind))
        some.drop("o_orderstatus").repartition(6, "o_orderkey").write.parquet(f"{root}/o_orderstatus={status}")
    return files.read_parquet(spark, root).select(orders.columns)


@query("scan_csv_alike", "SELECT o_totalprice, o_orderdate, o_orderkey, o_orderstatus FROM orders")
def scan_csv_alike(spark, sf_dir):
    """Files that are said to have one header: no pass over them, each header checked as it is read."""
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "alike-csv")
    orders.write.partitionBy("o_orderstatus").options(header=True, escape='"', sep="|").csv(path)
    wanted = orders.select("o_totalprice", "o_orderdate", "o_orderkey", "o_orderstatus")
    return files.read_csv(spark, path, schema=wanted.schema, alike=True, sep="|")


@query("scan_arrow_glob_mixed", _MIXED)
def scan_arrow_glob_mixed(spark, sf_dir):
    root = scratch_path(spark, "mixed-arrow")
    for name, df in zip(("customers", "suppliers"), _mixed_frames(spark, sf_dir)):
        write_arrow(df, f"{root}/{name}")
    return files.read_table(spark, f"{root}/**/*.arrow").select("key", "name", "nationkey", "acctbal", "segment", "region_hint")


@query("scan_json_mixed_layout", _MIXED)
def scan_json_mixed_layout(spark, sf_dir):
    """Customers as lines, suppliers as one array for each nation."""
    customers, suppliers = _mixed_frames(spark, sf_dir)
    root = scratch_path(spark, "mixed-json")
    customers.write.json(f"{root}/customers")
    arrays = suppliers.groupBy("nationkey").agg(F.to_json(F.collect_list(F.struct(*suppliers.columns))).alias("value"))
    arrays.select(F.replace("value", F.lit(","), F.lit(",\n")).alias("value"), "nationkey").repartition("nationkey").write.partitionBy("nationkey").text(f"{root}/suppliers")
    return files.read_json(spark, f"{root}/customers", f"{root}/suppliers/*/*.txt").select("key", "name", "nationkey", "acctbal", "segment", "region_hint")


@query("scan_recursive_glob", """
    SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier
""")
def scan_recursive_glob(spark, sf_dir):
    """Files in folders of any depth; other folders are left out."""
    customers, suppliers = _parties(spark, sf_dir)
    root = scratch_path(spark, "deep")
    customers.select("key", "name").write.option("header", True).csv(f"{root}/a/b/wanted")
    suppliers.select("key", "name").write.option("header", True).csv(f"{root}/wanted")
    suppliers.select("key", "name").write.option("header", True).csv(f"{root}/a/other")
    return files.read_table(spark, f"{root}/**/wanted/*.csv")


@query("merge_sources", _STACKED.format(tag1=", 'customers' AS source", tag2=", 'suppliers'"))
def merged(spark, sf_dir):
    customers, suppliers = _parties(spark, sf_dir)
    return merge_sources({"customers": customers, "suppliers": suppliers})


@query("scan_object_store", "SELECT * FROM part")
def scan_object_store(spark, sf_dir):
    return files.read_object_store(spark, "file", "", f"{sf_dir}/part.parquet")


def document_paths(spark, sf_dir) -> DataFrame:
    """A storage path per document, with varied suffixes."""
    suffixes = F.array(*[F.lit(s) for s in (
        ".parquet", ".json", ".jsonl", ".arrow", ".csv", ".txt", ".PARQUET", ".json.gz")])
    ext = F.element_at(suffixes, (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.concat(F.lit("//"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext)
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("lang").alias("bucket"))


_PATHS = """
SELECT '//' || lang || '/' || source || '/' || doc_id ||
       ['.parquet', '.json', '.jsonl', '.arrow', '.csv', '.txt', '.PARQUET', '.json.gz'][doc_id % 8 + 1]
       AS path, lang AS bucket FROM documents
"""


@query("detect_path_format", f"""
SELECT path, CASE WHEN lower(path) LIKE '%.parquet%' THEN 'parquet' WHEN lower(path) LIKE '%.json%' THEN 'json'
       WHEN lower(path) LIKE '%.arrow%' THEN 'arrow' ELSE 'csv' END AS format FROM ({_PATHS})
""")
def detect_path_format(spark, sf_dir):
    return document_paths(spark, sf_dir).select("path", X.path_format(F.col("path")).alias("format"))


@query("object_url", f"SELECT bucket, path, 's3a://' || bucket || '/' || ltrim(path, '/') AS url FROM ({_PATHS})")
def object_url(spark, sf_dir):
    return document_paths(spark, sf_dir).select(
        "bucket", "path", X.object_url("s3a", F.col("bucket"), F.col("path")).alias("url"))


@query("label_from_dir", f"""
SELECT path, split_part(path, '/', 5) AS filename, split_part(path, '/', 4) AS label FROM ({_PATHS})
""")
def label_from_dir(spark, sf_dir):
    return label_from_path(document_paths(spark, sf_dir).select("path"))


@query("sample_head", "SELECT * FROM events ORDER BY event_id LIMIT 100")
def sample_head(spark, sf_dir):
    return sample_rows(table(spark, sf_dir, "events"), 100, "event_id")


@query("chunk_sequence", """
SELECT chunk_id, count(*) AS n_rows, min(event_id) AS min_key, max(event_id) AS max_key
FROM (SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 1000) AS BIGINT) AS chunk_id
      FROM events) GROUP BY chunk_id
""")
def chunk_sequence(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    chunks = chunk_rows(events, 1000, "event_id")
    return chunks.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("min_key"),
        F.max("event_id").alias("max_key"))
