"""Exact dedup by content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import arrow_map, stored, utf8

#: A chunk ends where the hash of the last ``WINDOW`` bytes has this many low zero bits (2 KiB on average) ...
MASK_BITS = 11
WINDOW = 32
#: ... but has at least and at most so many bytes.
SHORTEST, LONGEST = 512, 16384
_WHITE = b" \t\n\v\f\r"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normalised(data: bytes) -> bytes:
    """The text without white space; its bytes never occur inside other UTF-8 characters."""
    return data.translate(None, _WHITE)


def chunks(data: bytes) -> list[bytes]:
    """Pieces whose ends depend on the content near them only."""
    if len(data) <= SHORTEST:
        return [data] if data else []
    rolled = np.frombuffer(data, np.uint8).astype(np.uint64) * _SPREAD
    rolled ^= rolled >> np.uint64(29)
    factor, width = 0x100000001B3, 1
    while width < WINDOW:  # the hash of twice the width, from two halves
        rolled = rolled[:-width] * np.uint64(factor) + rolled[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    ends = np.flatnonzero(((rolled ^ (rolled >> np.uint64(31))) & np.uint64((1 << MASK_BITS) - 1)) == 0) + WINDOW
    cuts = [0]
    for end in [*ends.tolist(), len(data)]:
        while end - cuts[-1] > LONGEST:
            cuts.append(cuts[-1] + LONGEST)
        if end - cuts[-1] >= SHORTEST or end == len(data) > cuts[-1]:
            cuts.append(end)
    return [data[i:j] for i, j in zip(cuts, cuts[1:])]


def identify(chunk: bytes, seed: int) -> int:
    """A signed 64-bit identifier, to be verified."""
    return xxhash.xxh3_64_intdigest(chunk, seed) - (1 << 63)


def recipes(docs: DataFrame, seed: int = 0, name=identify) -> DataFrame:
    """``doc_id, points, text_sha256, recipe``: the ordered chunk identifiers of each normalised text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cook(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        data = [normalised(d) for d in utf8(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()),
             pa.array([[name(c, seed) for c in chunks(d)] for d in data], pa.list_(pa.int64()))],
            ["doc_id", "points", "text_sha256", "recipe"])

    return arrow_map(docs, f"doc_id {kind}, points long, text_sha256 string, recipe array<long>", cook)


def chunk_contents(docs: DataFrame, seed: int = 0, name=identify) -> DataFrame:
    """``id, chunk``: each different chunk once; a chunk is moved once for each task that meets it."""
    def cut(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        found = {c: name(c, seed) for d in utf8(batch.column(2)) for c in chunks(normalised(d))}
        yield pa.RecordBatch.from_arrays([pa.array(found.values(), pa.int64()), pa.array(found.keys(), pa.binary())],
                                         ["id", "chunk"])

    return arrow_map(docs, "id long, chunk binary", cut).distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name=identify) -> DataFrame:
    """Groups of texts that are equal after white space is deleted.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row for each input row.  The row
    with the most code points stays, then the smallest id; a null text counts as empty, and all empty
    texts are one group.  A null id comes after all others.  Rows repeated with the same id and length
    cannot be told apart: all of them are marked as kept.  Other columns are ignored.

    Chunks are verified first: each different chunk is compared with those of the same identifier,
    byte by byte.  Should two share one, all are named anew with the next seed.  From then on equal
    lists of identifiers mean equal texts, and only these lists are grouped and joined.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("points"), text.alias("text"))
    seed = 0
    while _collide(docs, seed, name):
        seed += 1
    rows = stored(recipes(docs, seed, name), "recipes")
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    groups = rows.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select(F.col("recipe").alias("same"), F.col("best.doc_id").alias("keep_id"),
                           (-F.col("best.less")).alias("most"), "group_size")
    groups = stored(groups, "groups")  # with exchanges of its own, the join can split a hot group
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))
    return rows.join(groups, F.col("recipe") == F.col("same")).select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _collide(docs: DataFrame, seed: int, name) -> bool:
    """Whether two different chunks have one identifier."""
    return not chunk_contents(docs, seed, name).groupBy("id").count().where("count > 1").isEmpty()
