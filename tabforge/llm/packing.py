"""Best-fit packing of token sequences into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.rows import with_row_index

#: Pieces packed together; bounds a task's memory, whatever the size of the table.
GROUP_PIECES = 8192


def held(sizes: Sequence[int], totals: Sequence[int], first: int, length: int) -> int:
    """Tokens of a bin of ``length`` that takes piece ``first`` and then, again and again, the largest later piece that fits.

    ``sizes`` are negated and rising, ``totals`` their running sums from 0.  Pieces in a row are taken at once; each such run
    leaves less than half of the room, so there are few.
    """
    room, at = length, first
    while room and at < len(sizes):
        end = bisect_right(totals, totals[at] + room) - 1
        room -= totals[end] - totals[at]
        at = bisect_left(sizes, -room, end)
    return length - room


def pack(sizes: Sequence[int], lengths: Sequence[int], cost: Callable[[int], float],
         opened: int | None = None) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, largest pieces first, each in the open bin that it fills best.

    A piece that fits in no open bin opens the one that costs least for each token it would hold if the largest pieces
    left filled it at once, counted after downsizing; the shorter one, if they are equal.  With ``opened`` it opens
    that length, or the least one that holds it.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    falling = [-sizes[i] for i in order]
    totals = [0, *accumulate(sizes[i] for i in order)]

    def price(first: int, length: int) -> float:
        tokens = held(falling, totals, first, length)
        return cost(lengths[bisect_left(lengths, tokens)]) / tokens

    where: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    free: dict[int, list[int]] = {}  # room left: bins, the oldest last opened first
    rooms: list[int] = []  # sorted keys of ``free``
    filled: list[int] = []
    for k, i in enumerate(order):
        size = sizes[i]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            target = free[room].pop()
            if not free[room]:
                del free[room], rooms[at]
        else:
            target, holding = len(filled), lengths[bisect_left(lengths, size):]
            room = min(holding, key=lambda n: price(k, n)) if opened is None else max(opened, holding[0])
            filled.append(0)
        where[i] = (target, filled[target])
        filled[target] += size
        if room := room - size:
            if room not in free:
                insort(rooms, room)
                free[room] = []
            free[room].append(target)
    return where


def best_pack(sizes: Sequence[int], lengths: Sequence[int], cost: Callable[[int], float]) -> list[tuple[int, int, int]]:
    """(bin, offset, length) of each piece: the length of each bin chosen as it is opened, then downsized to its contents.

    Choosing by estimate can cost more than opening one length throughout, for few pieces mostly; those packings are
    made as well, and the cheapest wins (the chosen lengths, then the shorter length, if they are equal).
    """
    best, least = [], None
    for opened in (None, *lengths):
        where, used = pack(sizes, lengths, cost, opened), {}
        for (b, _), size in zip(where, sizes):
            used[b] = used.get(b, 0) + size
        fitted = {b: lengths[bisect_left(lengths, n)] for b, n in used.items()}
        total = sum(map(cost, fitted.values()))
        if least is None or total < least:
            best, least = [(b, at, fitted[b]) for b, at in where], total
    return best


def pack_documents(docs: DataFrame, lengths: Sequence[int], size: str, id_col: str = "doc_id",
                   overhead: int = 64, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack whole documents into bins: ``doc_id, piece, start, size, bin_id, offset, bin_length``.

    ``lengths`` are the permitted sequence lengths and ``size`` a column with each document's tokens.  A
    document above the largest length is cut into pieces of that length and a rest, at ``start``; no token is
    dropped.  A bin costs its length and ``overhead``.  Null or zero sizes give no piece; a negative size is an error.  Rows with
    the same id and size are packed each.  Pieces are numbered by id and size and packed in groups of ``group_pieces``, so
    that no task grows with the table and the result does not depend on partitions.  Other columns are ignored.
    """
    lengths = sorted(set(lengths))
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    kind, top = docs.schema[id_col].dataType.simpleString(), lengths[-1]
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(size).cast("long").alias("total"))
    sized = sized.withColumn("total", F.when(F.col("total") < 0, F.raise_error(F.lit("negative size"))).otherwise(F.col("total")))
    count = F.ceil(F.col("total") / top)
    pieces = sized.where("total > 0").select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * top).alias("start"),
                           F.least(F.lit(top).cast("long"), F.col("total") - F.col("piece") * top).alias("size"))
    numbered = with_row_index(pieces, ["doc_id", "piece", "size"], "row")
    grouped = numbered.withColumn("group", F.floor(F.col("row") / group_pieces))

    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        found = best_pack(rows["size"].tolist(), lengths, lambda n: n + overhead)
        out = rows[["doc_id", "piece", "start", "size"]].copy()
        out["bin_id"] = [int(rows["group"].iloc[0]) * group_pieces + b for b, _, _ in found]
        out["offset"] = [at for _, at, _ in found]
        out["bin_length"] = [n for _, _, n in found]
        return out

    return grouped.groupBy("group").applyInPandas(
        pack_group, f"doc_id {kind}, piece long, start long, size long, bin_id long, offset long, bin_length long")
