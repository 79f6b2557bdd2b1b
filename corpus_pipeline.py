"""From raw documents to packed sequences: language ID, line dedup, near-dedup, best-fit packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns packs.
Stages are written as Parquet to the shared folder and read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import split_by_keys, stored
from tabforge.llm.langid import UNKNOWN, predict_language, train_language_model
from tabforge.llm.lines import dedup_lines
from tabforge.llm.minhash import near_duplicates
from tabforge.llm.packing import pack_documents
from tabforge.llm.queries import PACK_LENGTHS, QUERIES, SQL, held_out

#: A document whose most likely language is less likely than this is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language is uncertain."""
    marked = docs.withColumn("held_out", held_out())
    model = train_language_model(marked.where("not held_out and doc_id is not null"))
    found = predict_language(docs, model, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete runs of lines of 50 words or more that occurred before; documents of which nothing is left go."""
    left = dedup_lines(docs).where(F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near-duplicates, and those without id.

    Rows repeated with one id are one document and stay together.
    """
    gone = near_duplicates(docs, words=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = stored(gone, "gone")  # with exchanges of its own, the join can split a hot id
    some, whole = split_by_keys(docs, [F.col("doc_id")], gone, [F.col("gone_id")])
    return whole.unionByName(some.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti"))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts as sequences of a byte-level model, which ends each document with one token."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    return pack_documents(docs.select("doc_id", size.alias("n_tokens")), PACK_LENGTHS, "n_tokens")


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near), ("best-fit packing", packs)]

#: A trained model decides in the first stage, so no SQL has these rows; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = QUERIES | {"pipeline": run}
