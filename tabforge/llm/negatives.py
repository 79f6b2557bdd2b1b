"""Hard-negative mining: rotated one-bit codes bound every score, only scores that the bounds leave open are computed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import arrow_map, stored

#: Rows and anchors that meet in one task, in expectation.
BLOCK_ROWS, BLOCK_ANCHORS = 8192, 2048
#: One-bit codes of a vector; each codes what the one before it leaves.
CODES = 4
#: Bits of an anchor's rotated components.
QUERY_BITS = 6
#: Anchors and rows of a block whose bounds are in memory at once.
TILE = (64, 4096)
#: Integers that a double holds exactly.
_EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def rotation(dims: int) -> np.ndarray:
    """A random rotation, the same everywhere."""
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0] if dims else np.empty((0, 0))


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    width = max(8, -(-packed.shape[1] // 8) * 8)
    return np.pad(packed, ((0, 0), (0, width - packed.shape[1]))).view(np.uint64)


def encode(vectors: np.ndarray, center: np.ndarray, rotate: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-bit codes (rows x codes x words) of the rotated vectors, their alignments, and the length of what is left.

    A code is the vector of signs over the root of the dimensions, so its length is 1; its alignment is its product with
    what it codes.  What is left is orthogonal to the last code.
    """
    left = (vectors - center) @ rotate
    dims = max(1, left.shape[1])
    bits, aligned = [], []
    for _ in range(codes):
        up = left >= 0
        signs = np.where(up, 1.0, -1.0) / np.sqrt(dims)
        along = np.einsum("ij,ij->i", left, signs)
        left = left - along[:, None] * signs
        bits.append(words(up))
        aligned.append(along)
    return np.stack(bits, axis=1), np.stack(aligned, axis=1), np.sqrt(np.einsum("ij,ij->i", left, left))


def planes(anchors: np.ndarray, rotate: np.ndarray, bits: int = QUERY_BITS):
    """Bit planes of the rotated anchors on a grid, the grid's origin and step, and the sum of the rounding errors."""
    turned = anchors @ rotate
    low = turned.min(axis=1, initial=0.0)
    step = np.maximum((turned.max(axis=1, initial=0.0) - low) / ((1 << bits) - 1), 1e-300)
    grid = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    error = np.abs(turned - low[:, None] - grid * step[:, None]).sum(axis=1)
    return [words((grid >> b & 1).astype(bool)) for b in range(bits)], low, step, grid.sum(axis=1), error


def bounds(side: dict, rows: dict, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible product of each anchor of ``i`` with each row of ``j``.

    A row is its center, its codes times their alignments, and a rest.  The products of an anchor with the codes are
    popcounts of its bit planes.  The product with the rest is at most the rest's length times the length of the
    anchor's part that is orthogonal to the last code (Cauchy-Schwarz); rounding adds its largest effect.
    """
    dims = max(1, side["dims"])
    root = np.sqrt(dims)
    estimate = np.repeat(side["center"][i, None], rows["rest"][j].shape[0], axis=1)
    slack = np.zeros_like(estimate)
    for c in range(rows["codes"].shape[1]):
        code = rows["codes"][j, c]
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        inside = np.zeros(estimate.shape, np.int64)
        for b, plane in enumerate(side["planes"]):
            for w in range(code.shape[1]):
                inside += np.bitwise_count(plane[i, None, w] & code[None, :, w]).astype(np.int64) << b
        # The sum of signs times components: twice those of the ones, less all of them.
        low, step = side["low"][i, None], side["step"][i, None]
        product = (2 * (inside * step + ones[None, :] * low) - (side["total"][i, None] * step + dims * low)) / root
        along = rows["aligned"][j, c][None, :]
        estimate += along * product
        slack += np.abs(along) * (side["error"][i, None] / root)
    across = np.maximum(np.abs(product) - side["error"][i, None] / root, 0.0)
    length = side["length"][i, None]
    slack += rows["rest"][j][None, :] * np.sqrt(np.maximum(length * length - across * across, 0.0))
    slack += 1e-9 * length * (rows["length"][j][None, :] + side["center_length"]) + 1e-6
    return estimate - slack, estimate + slack


def products(anchors: np.ndarray, rows: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and exact integer products of the open pairs; products beyond a long are its limits."""
    x, y = np.nonzero(open_)
    largest = np.abs(anchors).max(initial=0.0) * np.abs(rows).max(initial=0.0) * max(1, anchors.shape[1])
    if largest >= _EXACT:
        whole = lambda m: [[int(v) for v in r] for r in m]
        a, b = whole(anchors), whole(rows)
        exact = [min(max(sum(p * q for p, q in zip(a[u], b[v])), _LONG[0]), _LONG[1]) for u, v in zip(x, y)]
        return x, y, np.array(exact, np.int64)
    if 8 * len(x) > open_.size:
        return x, y, (anchors @ rows.T)[x, y].astype(np.int64)
    return x, y, np.einsum("ij,ij->i", anchors[x], rows[y]).astype(np.int64)


def _best(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Positions of the first ``count`` of each anchor: higher scores first, ties by id."""
    order = np.lexsort((ids, ~score, anchor))  # descends like -score, without overflow
    of = anchor[order]
    start = np.r_[0, np.flatnonzero(np.diff(of)) + 1] if len(of) else np.empty(0, int)
    place = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
    return order[place < count]


def _at_least(low: np.ndarray, sure: np.ndarray, count: int) -> np.ndarray:
    """For each anchor the ``count``-th largest lower bound of the rows that surely qualify; none: minus infinity."""
    floor = np.where(sure, low, -np.inf)
    if floor.shape[1] < count:
        return np.full(len(floor), -np.inf)
    return np.partition(floor, floor.shape[1] - count, axis=1)[:, floor.shape[1] - count]


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3,
                   window: tuple[int, int] = (50, 95), id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """The nearest rows of another label whose score is between two percentages of a positive's score.

    Components are multiplied by 256 and rounded down; scores are integer inner products.  Rows with a null id or
    label, a null vector, or a null or non-finite component take no part.  Rows equal in id, label and vector count
    once; vectors of different lengths do not meet.  Anchors are the rows for which ``anchors``, a condition on the
    table's columns, holds.  An anchor's positives are its first ``positives`` rows of the same label and another id.
    For each, the first ``negatives`` rows of another label with ``window[0] * positive <= 100 * negative <=
    window[1] * positive`` are returned, higher scores first, ties by smaller id: ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``.  Other columns are ignored.

    Rows are dealt by a hash of the id into blocks, so no label or id decides a block's size; blocks of anchors meet blocks
    of rows.  Each row is stored with one-bit codes and their alignments.  In a task every pair gets an interval from
    popcounts; a pair goes on only if its upper end reaches the lower ends of enough others, so the result is exact.
    A task returns the first few of each anchor, which a window merges.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & finite
    whole = F.transform(v.cast("array<double>"), _floored)
    base = vectors.where(usable).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("vector"),
                                        F.coalesce(anchors, F.lit(False)).alias("anchor")).distinct()
    base = base.withColumn("key", F.monotonically_increasing_id())  # stored, so the numbers stay
    ids, labels = (base.schema[c].dataType.simpleString() for c in ("id", "label"))
    base = stored(base, "vectors")
    centers = _centers(base)

    def code(batch: pa.RecordBatch):
        sizes, values = _flat(batch.column(2))
        bits: list = [None] * len(sizes)
        aligned, rest, length = [None] * len(sizes), np.zeros(len(sizes)), np.zeros(len(sizes))
        for dims, at, matrix in _by_size(sizes, values):
            c, a, r = encode(matrix, centers.get(dims, np.zeros(dims)), rotation(dims))
            for k, i in enumerate(at):
                bits[i], aligned[i] = c[k].tobytes(), a[k].tolist()
            rest[at], length[at] = r, np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(bits, pa.binary()), pa.array(aligned, pa.list_(pa.float64())), pa.array(rest), pa.array(length)],
            [*batch.schema.names, "codes", "aligned", "rest", "length"])

    coded = stored(arrow_map(base, f"id {ids}, label {labels}, vector array<double>, anchor boolean, key long, codes binary, "
                                   "aligned array<double>, rest double, length double", code), "codes")
    n, n_anchors = coded.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1))).first()
    row_blocks, anchor_blocks = max(1, -(-n // block_rows)), max(1, -(-n_anchors // block_anchors))
    rows = coded.withColumn("r", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(row_blocks))).withColumn("a", _copies(anchor_blocks))
    shape = ["a", "r", "side", "key", "id", "label", "vector", "codes", "aligned", "rest", "length", "wanted"]
    none = F.lit(None).cast("array<long>")
    rows = rows.withColumn("side", F.lit(1)).withColumn("wanted", none)

    def met(heads: DataFrame, wanted: Column) -> DataFrame:
        heads = heads.withColumn("a", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(anchor_blocks))).withColumn("r", _copies(row_blocks))
        return heads.withColumn("side", F.lit(0)).withColumn("wanted", wanted).select(shape).unionByName(rows.select(shape))

    def first_positives(side, block, i, j, low, high):
        same = (side["label"][i][:, None] == block["label"][j][None, :]) & (side["id"][i][:, None] != block["id"][j][None, :])
        need = _at_least(low, same, positives)
        x, y, s = products(side["vector"][i], block["vector"][j], same & (high >= need[:, None]))
        best = _best(x, s, block["id"][j][y], positives)
        return x[best], np.ones(len(best), np.int64), y[best], s[best]

    def first_negatives(side, block, i, j, low, high):
        other = side["label"][i][:, None] != block["label"][j][None, :]
        wanted = side["wanted"][i]
        scores = [np.array([w[k] if k < len(w) else 0 for w in wanted], np.float64)[:, None] for k in range(max(map(len, wanted), default=0))]
        there = [np.array([k < len(w) for w in wanted])[:, None] for k in range(len(scores))]
        open_ = np.zeros(low.shape, bool)
        for score, has in zip(scores, there):
            least, most = score * (window[0] / 100), score * (window[1] / 100)
            slack = 1e-9 * np.abs(score) + 1e-6
            # A row surely qualifies if its whole interval does.
            need = _at_least(low, other & (low >= least + slack) & (high <= most - slack), negatives)
            open_ |= has & other & (high >= np.maximum(least - slack, need[:, None])) & (low <= most + slack)
        x, y, s = products(side["vector"][i], block["vector"][j], open_)
        out = []
        for k in range(len(scores)):
            score = [int(w[k]) if k < len(w) else None for w in wanted]
            ends = [(-(-window[0] * p // 100), window[1] * p // 100) if p is not None else (1, 0) for p in score]
            least = np.array([min(max(e[0], _LONG[0]), _LONG[1]) for e in ends], np.int64)
            most = np.array([min(max(e[1], _LONG[0]), _LONG[1]) for e in ends], np.int64)
            fits = np.flatnonzero((s >= least[x]) & (s <= most[x]))
            best = fits[_best(x[fits], s[fits], block["id"][j][y[fits]], negatives)]
            out.append((x[best], np.full(len(best), k + 1, np.int64), y[best], s[best]))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4

    def searched(frame: DataFrame, find, count: int) -> DataFrame:
        def task(table: pa.Table) -> pa.Table:
            return _task(table, centers, find, count)

        return frame.groupBy("a", "r").applyInArrow(task, f"key long, anchor_id {ids}, place long, other_id {ids}, score long")

    order = [F.col("score").desc(), "other_id"]
    heads = coded.where("anchor")
    place = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    found = searched(met(heads, none), first_positives, positives).withColumn("place", place.cast("long"))
    found = stored(found.where(F.col("place") <= positives).select(
        "key", "anchor_id", "place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"])
    heads = heads.join(found.groupBy("key").agg(scores.alias("scores")), "key")
    near = searched(met(heads, F.col("scores")), first_negatives, negatives).drop("anchor_id")
    rank = F.row_number().over(Window.partitionBy("key", "place").orderBy(*order))
    near = near.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return near.join(found, ["key", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _copies(n: int) -> Column:
    """A row for each of ``n`` blocks."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))


def _floored(x: Column) -> Column:
    """``floor(256 * x)`` as a double, which may be larger than a long; what would overflow a double is limited."""
    scaled = F.greatest(F.least(x * 256, F.lit(1e300)), F.lit(-1e300))
    down = F.floor(scaled).cast("double")
    return F.when(F.abs(scaled) < _EXACT, down).otherwise(scaled)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and all values of a list column without nulls."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _by_size(sizes: np.ndarray, values: np.ndarray):
    """(length, positions, matrix) of the vectors of each length."""
    ends = np.cumsum(sizes)
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        yield int(dims), at, values[(ends[at] - dims)[:, None] + np.arange(dims)]


def _centers(base: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each length: one sum for each task and component, added by Spark."""
    def add(batch: pa.RecordBatch):
        sizes, values = _flat(batch.column(0))
        parts = [(d, len(at), m.sum(axis=0)) for d, at, m in _by_size(sizes, values) if d]
        dims = np.concatenate([np.full(d, d) for d, _, _ in parts]) if parts else np.empty(0, np.int64)
        place = np.concatenate([np.arange(d) for d, _, _ in parts]) if parts else np.empty(0, np.int64)
        rows = np.concatenate([np.full(d, n) for d, n, _ in parts]) if parts else np.empty(0, np.int64)
        total = np.concatenate([s for _, _, s in parts]) if parts else np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int64()), pa.array(place, pa.int64()), pa.array(rows, pa.int64()),
                                          pa.array(total, pa.float64())], ["dims", "place", "n", "total"])

    sums = arrow_map(base.select("vector"), "dims long, place long, n long, total double", add)
    means = sums.groupBy("dims", "place").agg((F.sum("total") / F.sum("n")).alias("mean"))
    out: dict[int, np.ndarray] = {}
    for dims, place, mean in sorted(tuple(r) for r in means.collect()):  # a row for each component
        out.setdefault(dims, np.zeros(dims))[place] = mean
    return out


def _task(table: pa.Table, centers: dict[int, np.ndarray], find, count: int) -> pa.Table:
    """The first ``count`` rows of each anchor and place in one block, searched in tiles."""
    table = table.combine_chunks()
    head = table.column("side").to_numpy() == 0
    sizes, values = _flat(table.column("vector").combine_chunks())
    frame = table.select(["id", "label"]).to_pandas()
    codes, wanted = table.column("codes").to_pylist(), table.column("wanted").to_pylist()
    aligned = table.column("aligned").to_pylist()
    rest, length = (table.column(c).to_numpy() for c in ("rest", "length"))
    out = []
    for dims, at, matrix in _by_size(sizes, values):
        rotate, center = rotation(dims), centers.get(dims, np.zeros(dims))
        h, r = np.flatnonzero(head[at]), np.flatnonzero(~head[at])
        if not len(h) or not len(r):
            continue
        ids, labels = frame["id"].to_numpy()[at], frame["label"].to_numpy()[at]
        bit_planes, low, step, total, error = planes(matrix[h], rotate)
        side = {"id": ids[h], "label": labels[h], "vector": matrix[h], "dims": dims, "center": matrix[h] @ center,
                "center_length": float(np.sqrt(center @ center)), "planes": bit_planes, "low": low,
                "step": step, "total": total, "error": error, "length": length[at][h], "wanted": [wanted[at[k]] or [] for k in h]}
        width = max(1, -(-dims // 64))
        block = {"id": ids[r], "label": labels[r], "vector": matrix[r], "rest": rest[at][r], "length": length[at][r],
                 "codes": np.frombuffer(b"".join(codes[at[k]] for k in r), np.uint64).reshape(len(r), -1, width),
                 "aligned": np.array([aligned[at[k]] for k in r], np.float64)}
        for a in range(0, len(h), TILE[0]):
            i, found = slice(a, a + TILE[0]), []
            for b in range(0, len(r), TILE[1]):
                j = slice(b, b + TILE[1])
                x, k, y, s = find(side, block, i, j, *bounds(side, block, i, j))
                found.append((x + a, k, y + b, s))
            x, k, y, s = (np.concatenate(c) for c in zip(*found))
            best = _best(x * (1 << 20) + k, s, block["id"][y], count)
            out.append((h[x[best]], at[h[x[best]]], k[best], at[r[y[best]]], s[best]))
    merged = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (zip(*out) if out else [()] * 5)]
    _, heads, place, others, score = merged
    take = lambda c, rows: table.column(c).combine_chunks().take(pa.array(rows, pa.int64()))
    return pa.table([take("key", heads), take("id", heads), pa.array(place, pa.int64()), take("id", others), pa.array(score, pa.int64())],
                    names=["key", "anchor_id", "place", "other_id", "score"])
