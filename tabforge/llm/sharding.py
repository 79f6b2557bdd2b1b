"""Reproducible shuffle into shards by a Feistel permutation of row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.rows import with_row_index

#: Rounds of the permutation.
ROUNDS = 6


#: Steps of a walk; see ``permuted``.
WALK = 64


def feistel(value: Column, side: Column, seed: int) -> Column:
    """A permutation of the numbers below ``side * side``, as pairs of digits below ``side``."""
    def mix(digits: Column, r: Column) -> Column:
        moved = F.pmod(digits["left"] + F.pmod(F.xxhash64(digits["right"], F.lit(seed).cast("long"), r), side), side)
        return F.struct(digits["right"].alias("left"), moved.alias("right"))

    start = F.struct(F.floor(value / side).alias("left"), F.pmod(value, side).alias("right"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, mix, lambda d: d["left"] * side + d["right"])


def side_of(n: Column) -> Column:
    """The side of the least square of at least ``n``."""
    root = F.ceil(F.sqrt(n.cast("double")))
    return F.when(root * root < n, root + 1).otherwise(root)


def permuted(row: Column, n: Column, side: Column, seed: int) -> Column:
    """The place of row number ``row`` among ``n``.

    The permutation covers the least square that holds ``n``.  A place outside ``n`` is permuted again
    until it is inside (cycle walking); it gets there, as the walk started inside.  Of ``s * s`` places
    at most ``2 * s`` are outside, so a walk has at most ``2 * s`` steps, which covers every ``n`` up to 1024, and needs
    more than 64 with a chance below ``16 ** -64`` beyond; a walk that did would fail, not give a wrong place.
    """
    first = feistel(row, side, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first,
                         lambda place, _: F.when(place < n, place).otherwise(feistel(place, side, seed)))
    return F.when(first < n, first).when(walked < n, walked).otherwise(F.raise_error(F.lit("walk did not end")).cast("long"))


def shard_rows(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows over ``shards`` in a shuffled order: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``rows``: counts differ by one at most.  Rows are numbered by id, size and checksum (null
    ids first); number ``i`` goes to place ``p(i)`` of the permutation, which is slot ``p(i) div shards`` of shard
    ``p(i) mod shards``, so slots have no gaps.  The result depends on the rows and the seed only, not
    on files or partitions; rows equal in id, size and checksum are interchangeable.  A null text has
    size 16 and the checksum of an empty text, 0.  ``grown_shard`` is null under this law.  Only id,
    size and checksum are moved; other columns are ignored.
    """
    data = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + 16).cast("long").alias("size"),
                       F.crc32(data.cast("binary")).alias("text_crc32"))
    numbered = with_row_index(keys, ["doc_id", "size", "text_crc32"], "row")
    total = numbered.agg(F.count("*").alias("n"))
    numbered = numbered.withColumn("n", total.scalar()).withColumn("side", total.select(side_of(F.col("n"))).scalar())
    placed = numbered.withColumn("place", permuted(F.col("row"), F.col("n"), F.col("side"), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
