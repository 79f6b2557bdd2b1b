"""Embedding near-dedup by counting window collisions of one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.workspace import cut_lineage
from tabforge.llm.common import arrow_map, connected, per_worker, stored
from tabforge.operators.rows import with_row_index

#: Rows of a block; two blocks are compared in one task.
BLOCK_ROWS = 2048
#: Queries compared at once with a block.
QUERIES = 256
#: Share of projections in which a linked pair may miss its window.
MISSES = 0.22


def windows(similarity: float, dims: int) -> tuple[float, float, int]:
    """Distance of linked unit vectors, half width of a window, and the collisions that every linked pair has.

    The projections are an orthonormal basis, so the squared differences of a pair add up to its squared
    distance.  At most ``m`` of them can exceed ``distance / sqrt(m + 1)``; a linked pair therefore
    collides in all others.  The count is calibrated to a recall of 1.
    """
    distance = math.sqrt(2 - 2 * similarity) + 1e-6
    misses = int(MISSES * dims)
    return distance, distance / math.sqrt(misses + 1), dims - misses


def basis(dims: int) -> np.ndarray:
    """Orthonormal directions, the same everywhere."""
    return per_worker(("basis", dims), lambda: np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that no square overflows."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def linked(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of unit vectors with so high a cosine; ``b`` ascends in the first projection."""
    dims = a.shape[1]
    distance, half, least = windows(similarity, dims)
    p, q = (a @ basis(dims)).astype(np.float32), (b @ basis(dims)).astype(np.float32)
    half, order = np.float32(half + 1e-5), np.argsort(q[:, 0], kind="stable")
    q, q0, first = q[order], q[order, 0], max(1, min(dims, 3 * dims // 8))
    rows, columns = [], []
    for at in range(0, len(p), QUERIES):
        block = p[at:at + QUERIES]
        lo = np.searchsorted(q0, block[:, 0].min() - distance - 1e-5)
        hi = np.searchsorted(q0, block[:, 0].max() + distance + 1e-5, "right")
        near = q[lo:hi]
        hits = np.zeros((len(block), len(near)), np.int16)
        for k in range(first):
            hits += np.abs(block[:, k, None] - near[None, :, k]) <= half
        i, j = np.nonzero(hits >= least - (dims - first))  # may still reach the count
        for s in range(0, len(i), 1 << 18):
            x, y = i[s:s + (1 << 18)], j[s:s + (1 << 18)]
            count = hits[x, y] + (np.abs(block[x, first:] - near[y, first:]) <= half).sum(axis=1)
            x, y = x[count >= least] + at, order[y[count >= least] + lo]
            true = np.einsum("ij,ij->i", a[x], b[y]) >= similarity
            rows.append(x[true])
            columns.append(y[true])
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.empty(0, int), np.empty(0, int))


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def similar_vectors(vectors: DataFrame, similarity: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links of vectors of one label with a cosine of ``similarity`` or more, in double precision.

    Returns ``vec_id, n_links, component_id, kept``, one row for each input row.  Null, empty and zero vectors, those with a null or
    non-finite component and those without label link with nothing; vectors of different lengths don't
    link.  Rows repeated with one id are separate vectors of that id; a null id takes part, and is never the
    smallest.  Other columns are ignored.

    Equal vectors of a label are one class.  Classes are sorted by label and first projection and cut into
    blocks; blocks are compared where their windows of that projection meet.  There, collisions of the query-centred windows
    of all projections are counted for each pair, and pairs that reach the count are verified.  Pairs do not
    leave the task: it returns the links of each vector and the local component, one row for each.
    A label of ``n`` vectors still takes up to ``(n / block_rows)^2 / 2`` comparisons of blocks if its windows all meet.
    """
    v, label = F.col(vector_col), F.col(label_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = v.isNotNull() & label.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    base = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), v.cast("array<double>").alias("vector"),
                          F.coalesce(usable, F.lit(False)).alias("usable"))
    classes = base.where("usable").groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    labels = classes.schema["label"].dataType.simpleString()

    def project(batch: pa.RecordBatch):
        first = [float(unit(np.array([x]))[0] @ basis(len(x))[:, 0]) for x in batch.column("vector").to_pylist()]
        sizes = [len(x) for x in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(first, pa.float64())],
                                         [*batch.schema.names, "dims", "first"])

    ids = base.schema["vec_id"].dataType.simpleString()
    projected = arrow_map(classes, f"label {labels}, vector array<double>, copies long, least {ids}, dims int, first double", project)
    numbered = stored(with_row_index(projected, ["label", "dims", "first"], "class"), "classes")
    blocks = numbered.withColumn("block", F.floor(F.col("class") / block_rows))
    spans = blocks.groupBy("label", "dims", "block").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    distance = windows(similarity, 1)[0]
    x, y = spans.alias("x"), spans.alias("y")
    meet = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.dims") == F.col("y.dims")) &
                  (F.col("x.block") <= F.col("y.block")) & (F.col("y.lo") - F.col("x.hi") <= distance))
    pairs = cut_lineage(meet.select(F.col("x.block").alias("i"), F.col("y.block").alias("j")).distinct())
    sides = pairs.select("i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.where("i <> j").select("i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    dealt = blocks.join(sides, "block").select("i", "j", "side", "class", "label", "dims", "vector", "copies")

    def compare(table: pa.Table) -> pa.Table:
        frame = table.select(["side", "class", "label", "dims", "copies"]).to_pandas()
        data, out = table.column("vector").combine_chunks(), []
        alone = not frame["side"].any()
        for _, part in frame.groupby(["label", "dims"]):
            at = part.index.to_numpy()
            a, b = at[(part["side"] == 0).to_numpy()], at[(part["side"] == (0 if alone else 1)).to_numpy()]
            if not len(a) or not len(b):
                continue
            matrix = lambda rows: unit(data.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1))
            p, q = linked(matrix(a), matrix(b), similarity)
            p, q = a[p], b[q]
            if alone:
                p, q = p[p < q], q[p < q]
            copies, classes = frame["copies"].to_numpy(), frame["class"].to_numpy()
            n = len(frame)
            links = np.bincount(p, copies[q], n) + np.bincount(q, copies[p], n)
            root, seen = roots(n, p, q), np.flatnonzero(links)
            out.append((classes[seen], links[seen].astype(np.int64), classes[root[seen]]))
        merged = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (zip(*out) if out else ([], [], []))]
        return pa.table([pa.array(c, pa.int64()) for c in merged], names=["class", "links", "root"])

    found = stored(dealt.groupBy("i", "j").applyInArrow(compare, "class long, links long, root long"), "links")
    component = connected(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    named = (numbered.select("class", "label", "vector", "copies", "least").join(counts, "class", "left")
             .join(component.select(F.col("node").alias("class"), "component"), "class", "left")
             .withColumn("component", F.coalesce("component", "class")))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(named.join(smallest, "component").select(
        F.col("label").alias("l"), F.col("vector").alias("w"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "components")
    out = base.join(named, F.col("usable") & (F.col("label") == F.col("l")) & (F.col("vector") == F.col("w")), "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"),
                      component_id.eqNullSafe(F.col("vec_id")).alias("kept"))
