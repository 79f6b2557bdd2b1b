"""Helpers of the corpus operators: stored intermediates, text batches and connected components."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.workspace import delete_tree, scratch_path


class Kept:
    """A frame written once to the shared folder, which can be deleted when nothing reads it any more.

    Reads of ``frame`` survive the loss of any executor and do not run the Python of ``df`` again.
    """

    def __init__(self, df: DataFrame, name: str):
        self.path, self._spark = scratch_path(df.sparkSession, name), df.sparkSession
        df.write.parquet(self.path)
        self.frame = self._spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete_tree(self._spark, self.path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back."""
    return Kept(df, name).frame


#: Different values that keys are hashed to, so at most as many rows of one number are broadcast.
KEY_BUCKETS = 1 << 20


def split_by_keys(rows: DataFrame, of_rows: list[Column], keys: DataFrame, of_keys: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that may have one of the keys, and those that surely have none.

    Keys are hashed to ``KEY_BUCKETS`` numbers, which are broadcast.  A join with the keys then shuffles only rows of the first part, and
    all if there are far more keys than numbers.  Nulls are keys like any other.
    """
    bucket, mark = "__key_bucket", "__key_there"
    there = stored(keys.select(F.pmod(F.xxhash64(*of_keys), F.lit(KEY_BUCKETS)).cast("int").alias(bucket)).distinct(), "keys")
    marked = rows.withColumn(bucket, F.pmod(F.xxhash64(*of_rows), F.lit(KEY_BUCKETS)).cast("int")).join(
        F.broadcast(there.withColumn(mark, F.lit(True))), bucket, "left")
    return tuple(marked.where(c).select(*[f"`{f}`" for f in rows.columns]) for c in (F.col(mark), F.col(mark).isNull()))


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """A value made once in each Python worker, also where the worker has no install of this package.

    Task code travels by value, so each task has its own copy of a module's variables; what lasts longer has to
    be held by the interpreter.
    """
    held = sys.modules.setdefault("_tabforge_held", types.ModuleType("_tabforge_held")).__dict__.setdefault("values", {})
    if key not in held:
        if len(held) > 3:
            held.clear()
        held[key] = make()
    return held[key]


#: Bytes of a batch that a task works on at once.
SLICE_BYTES = 2 << 20


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of some MB each, so that a worker's memory does not follow the size of batches."""
    for batch in batches:
        step = max(1, SLICE_BYTES * len(batch) // max(1, batch.nbytes))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def arrow_map(df: DataFrame, schema: str,
              fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` with a function of one small batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of ``edges`` with the smallest node it reaches.

    Alternating large and small stars: every round is an aggregate and a join on the node, so a hub
    with a third of all edges is pre-aggregated and its join can be split.  A round is written to the shared folder and deleted after the
    next; their number grows with the logarithm of the longest path.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    kept = Kept(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "stars")
    while not _is_forest(kept.frame):
        stars = kept.frame
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = Kept(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .where("u <> v").distinct(), "stars")
        kept.drop()
        low = large.frame.groupBy("u").agg(F.min("v").alias("m"))
        small = large.frame.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        kept = Kept(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        large.drop()
    stars = kept.frame
    roots = stars.select(F.col("v").alias("u"), "v").distinct()
    return stars.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _is_forest(stars: DataFrame) -> bool:
    """Every node has one parent and no parent has a parent."""
    sides = stars.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        stars.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = sides.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bad.where("up > 1 or (up = 1 and down = 1)").isEmpty()
