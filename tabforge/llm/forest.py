"""Nearest neighbours with a forest of hash prefixes: sorted arrays of long hash strings, one for each tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import arrow_map, slices, stored
from tabforge.operators.rows import rank_in_groups, with_row_index

#: Trees, and bits of a hash string.
TREES, BITS = 16, 32
#: Levels that one group of nodes holds, so at most two to this power of them.
TIER = 16
#: Entries of a tree's sorted array that a task scores, and searches that meet them there, in expectation.
CHUNK, SEARCHES = 4096, 2048
#: Queries that are searched in full to calibrate how far the trees ascend, and the recall asked of them.
SAMPLE, RECALL = 128, 0.95


def planes(dims: int, trees: int, bits: int) -> np.ndarray:
    """Normals of the hyperplanes of all trees, the same everywhere; one more component makes lengths equal."""
    return np.random.default_rng([dims, trees, bits]).standard_normal((dims + 1, trees * bits))


def lengths(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        top = np.abs(vectors).max(axis=1, initial=0.0)
        return top * np.sqrt(np.square(vectors / np.where(top > 0, top, 1)[:, None]).sum(axis=1))


def hash_strings(vectors: np.ndarray, longest: float | None, trees: int, bits: int) -> np.ndarray:
    """A string of bits for each vector and tree, as a number.

    A candidate gets a component that fills its length up to ``longest``, a query (``None``) is scaled to length 1 and
    gets none: the angle between them then orders candidates as the inner product does.
    """
    n, dims = vectors.shape
    size = lengths(vectors)
    with np.errstate(all="ignore"):
        scaled = np.nan_to_num(vectors / (np.where(size > 0, size, 1)[:, None] if longest is None else longest))
    rest = np.zeros(n) if longest is None else np.sqrt(np.maximum(0.0, 1 - np.square(scaled).sum(axis=1)))
    signs = np.column_stack([scaled, rest]) @ planes(dims, trees, bits) > 0
    return signs.reshape(n, trees, bits) @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))


def shared_bits(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Length of the common prefix of two strings."""
    return bits - np.frexp((a ^ b).astype(np.float64))[1]


def first_rows(score: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties by ``least``."""
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((least[near], -score[near]))[:k]]


def nearest_vectors(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
                    trees: int = TREES, bits: int = BITS, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """The ``k`` rows of largest inner product, in double precision, found for each query.

    Queries are the rows for which ``queries`` holds; candidates are all rows but those of the query's id.  Vectors that are
    null, empty, zero, or hold null or non-finite components, and null ids, take no part; vectors of different
    lengths do not meet.  Rows repeated with one id and vector count once.  Returns ``query_id, rank, vec_id, score``, nearest
    first, ties by smaller id; other columns are ignored.

    Each tree is a sorted array of hash strings; a node is the range of strings with a common prefix.  A query
    descends to its own string in every tree; all trees then ascend together, one bit at a time, until the
    ranges of its prefix hold enough entries.  How many are enough is calibrated: ``SAMPLE`` queries are
    compared with all rows, and the least number that finds the share ``recall`` of their neighbours is taken.  All entries of the
    ranges are scored; a range of any size is cut into chunks of the sorted array.  Equal vectors are one entry with its ``k + 1``
    smallest ids, so copies do not make a node large.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    # Zeros of either sign are one.
    base = vectors.where(usable).select(F.col(id_col).alias("id"), F.transform(v.cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"),
                                        F.coalesce(queries, F.lit(False)).alias("query"))
    base = base.withColumn("a", F.xxhash64("vector")).withColumn("b", F.xxhash64("vector", F.lit(1)))
    rows = stored(base.groupBy("id", "a", "b").agg(F.max("query").alias("query")), "rows")
    ids = rows.schema["id"].dataType.simpleString()
    few = rank_in_groups(rows.select("a", "b", "id"), ["a", "b"], ["id"]).where(F.col("rank") <= k + 1)
    few = few.groupBy("a", "b").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.groupBy("a", "b").agg(F.max("query").alias("query"))
    classes = base.groupBy("a", "b").agg(F.first("vector").alias("vector")).join(few, ["a", "b"]).join(asked, ["a", "b"])
    classes = stored(classes.withColumn("entry", F.monotonically_increasing_id()), "classes")  # stored, so the numbers stay
    longest = _longest(classes)
    forest = stored(_hashed(classes, longest, trees, bits), "forest")
    enough = _calibrated(forest, trees, bits, k, recall)

    # The sorted arrays, with the place of each entry; trees of vectors of different lengths are different trees.
    tree = (F.col("dims") * trees + F.col("t")).alias("tree")
    listed = forest.select("entry", "dims", F.posexplode("strings").alias("t", "string")).select("entry", tree, "string")
    placed = stored(with_row_index(listed, ["tree", "string"], "place"), "arrays")
    descents = forest.where("query").select("entry", "dims", F.posexplode("query_strings").alias("t", "string")).select("entry", tree, "string")
    ranges = _ascend(placed, descents, forest, bits, enough, trees)

    chunks = F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor((F.col("first") + F.col("n") - 1) / chunk))).alias("chunk")
    searches = stored(ranges.select("entry", "first", "n", chunks), "searches")
    parts = searches.groupBy("chunk").agg(F.ceil(F.count("*") / SEARCHES).alias("parts"))
    split = searches.join(parts, "chunk").withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts"))).drop("parts")
    filled = placed.select("entry", "place", F.floor(F.col("place") / chunk).alias("chunk")).join(parts, "chunk")
    filled = filled.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<long>")))
    none = F.lit(None).cast("long")
    sides = split.select("chunk", "part", F.lit(0).alias("side"), "entry", "first", "n").unionByName(
        filled.select("chunk", "part", F.lit(1).alias("side"), "entry", F.col("place").alias("first"), none.alias("n")))
    known = classes.select("entry", "vector", F.col("ids")[0].alias("least"))
    kept = k + 1

    def score(table: pa.Table) -> pa.Table:
        return _scored(table, kept)

    near = sides.join(known, "entry").groupBy("chunk", "part").applyInArrow(score, "query long, entry long, score double")
    near = near.groupBy("query", "entry").agg(F.max("score").alias("score")).join(classes.select("entry", "ids"), "entry")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("ids")[0]))
    near = near.withColumn("row", first).where(F.col("row") <= kept).select("query", "score", F.explode("ids").alias("other"))
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "other"))
    near = near.withColumn("row", first).where(F.col("row") <= 2 * kept)
    # One id may have several vectors: its best one counts.
    lists = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "other"))).alias("found"))
    lists = lists.join(classes.select(F.col("entry").alias("query"), "a", "b"), "query")
    out = rows.where("query").select("a", "b", F.col("id").alias("query_id")).join(lists.drop("query"), ["a", "b"])
    others = F.filter("found", lambda s: s["other"] != F.col("query_id"))
    out = out.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "s"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("s.other").cast(ids).alias("vec_id"), (-F.col("s.minus")).alias("score"))


def _matrices(column: pa.Array):
    """(dims, positions, matrix) of the vectors of each length in a list column."""
    sizes, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        yield int(dims), at, values[(ends[at] - dims)[:, None] + np.arange(dims)]


def _longest(classes: DataFrame) -> float:
    """The length of the longest vector, from one number for each task."""
    def run(batches):
        most = 0.0
        for batch in slices(batches):
            for _, _, matrix in _matrices(batch.column(0)):
                most = max(most, float(lengths(matrix).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    found = classes.select("vector").mapInArrow(run, "most double").agg(F.max("most")).first()[0]
    return min(found or 1.0, 1e300) or 1.0


def _hashed(classes: DataFrame, longest: float, trees: int, bits: int) -> DataFrame:
    def run(batch: pa.RecordBatch):
        dims, strings, searches = np.zeros(len(batch), np.int64), [None] * len(batch), [None] * len(batch)
        for d, at, matrix in _matrices(batch.column(1)):
            dims[at] = d
            for i, s, q in zip(at, hash_strings(matrix, longest, trees, bits).tolist(), hash_strings(matrix, None, trees, bits).tolist()):
                strings[i], searches[i] = s, q
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(strings, kind), pa.array(searches, kind)],
                                         [*batch.schema.names, "dims", "strings", "query_strings"])

    return arrow_map(classes.select("entry", "vector", "query"),
                     "entry long, vector array<double>, query boolean, dims long, strings array<long>, query_strings array<long>", run)


def _calibrated(forest: DataFrame, trees: int, bits: int, k: int, recall: float) -> int:
    """The least number of entries that the ranges of a query must hold to find the share ``recall`` of the neighbours.

    ``SAMPLE`` queries meet every entry.  A task returns the counts by length of the common prefix and its ``k`` nearest of each query.
    """
    sample = forest.where("query").orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("entry", "dims", "vector", "query_strings").collect()
    if not sample:
        return 0
    groups = {d: [r for r in sample if r["dims"] == d] for d in {r["dims"] for r in sample}}
    held = {d: (np.array([r["entry"] for r in g]), np.array([r["vector"] for r in g]), np.array([r["query_strings"] for r in g])) for d, g in groups.items()}

    def run(batches):
        counts = {d: np.zeros((len(g[0]), bits + 1), np.int64) for d, g in held.items()}
        top = {d: [np.empty((0, 2))] * len(g[0]) for d, g in held.items()}
        for batch in slices(batches):
            entries, strings = batch.column(0).to_numpy(), np.array(batch.column(2).to_pylist(), np.int64).reshape(len(batch), trees)
            for d, at, matrix in _matrices(batch.column(1)):
                if d not in held:
                    continue
                own, queries, searched = held[d]
                scores = queries @ matrix.T
                for i in range(len(own)):
                    shared = shared_bits(strings[at], searched[i], bits)
                    counts[d][i] += np.bincount(shared.ravel(), minlength=bits + 1)
                    rows = np.flatnonzero(entries[at] != own[i])
                    seen = np.vstack([top[d][i], np.column_stack([scores[i, rows], shared[rows].max(axis=1)])])
                    top[d][i] = seen[np.argsort(-seen[:, 0], kind="stable")[:k]]
        for d, (own, _, _) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(counts[d].tolist(), pa.list_(pa.int64())), pa.array([t[:, 0].tolist() for t in top[d]], pa.list_(pa.float64())),
                 pa.array([t[:, 1].astype(int).tolist() for t in top[d]], pa.list_(pa.int64()))], ["query", "counts", "scores", "shared"])

    seen = stored(forest.select("entry", "vector", "strings").mapInArrow(run, "query long, counts array<long>, scores array<double>, shared array<long>"), "sample")
    sums = [F.sum(F.col("counts")[i]).alias(str(i)) for i in range(bits + 1)]
    counts = {r[0]: np.array(r[1:]) for r in seen.groupBy("query").agg(*sums).collect()}
    best = seen.select("query", F.explode(F.arrays_zip("scores", "shared")).alias("s")).select("query", "s.*")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.col("scores").desc(), F.col("shared").desc()))
    found: dict[int, list[int]] = {}
    for query, shared in best.withColumn("row", first).where(F.col("row") <= k).select("query", "shared").collect():
        found.setdefault(query, []).append(shared)
    if not found:
        return 0
    # Entries in the ranges of a prefix of each length, and the neighbours that a range of that prefix holds.
    held_by = {q: np.cumsum(c[::-1])[::-1] for q, c in counts.items()}
    total = sum(map(len, found.values()))
    for enough in sorted({int(n) for q in found for n in held_by[q]}):
        level = {q: max(np.flatnonzero(held_by[q] >= enough), default=0) for q in found}
        if sum(s >= level[q] for q, each in found.items() for s in each) >= recall * total:
            return enough
    return max(int(n.max()) for n in held_by.values())


def _ascend(placed: DataFrame, descents: DataFrame, forest: DataFrame, bits: int, enough: int, trees: int) -> DataFrame:
    """``entry, first, n``: the ranges of the sorted arrays that each query reaches."""
    entries = max(1, forest.count())
    deepest = min(bits, max(1, int(entries).bit_length()))  # below, a node holds few entries
    node = lambda level: F.shiftright("string", bits - level)
    # Nodes of the deepest level, then the counts of all nodes above, tier by tier.
    leaves = stored(placed.groupBy("tree", node(deepest).alias("node")).agg(F.count("*").alias("n"), F.min("place").alias("first")), "nodes")
    nodes, paths = leaves, None
    for low in range((deepest - 1) // TIER * TIER, -1, -TIER):
        high = min(deepest, low + TIER)
        known = _paths(nodes, low, high)
        paths = known if paths is None else paths.join(
            known.select("tree", F.col("node").alias("above"), F.col("ns").alias("more"), F.col("firsts").alias("before")),
            (paths["tree"] == known["tree"]) & (F.shiftright(paths["node"], deepest - high) == F.col("above"))).select(
            paths["tree"], paths["node"], F.concat(F.slice("more", 1, high - low), paths["ns"]).alias("ns"),
            F.concat(F.slice("before", 1, high - low), paths["firsts"]).alias("firsts"))
        paths = stored(paths, "paths")
        nodes = nodes.groupBy("tree", F.shiftright("node", high - low).alias("node")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    # A query whose own leaf is empty ascends from the nearest node that is not.
    wanted = descents.select("entry", "tree", node(deepest).alias("node"))
    on = wanted.join(paths.withColumnRenamed("tree", "t").withColumnRenamed("node", "m"), (F.col("tree") == F.col("t")) & (F.col("node") == F.col("m")), "left")
    missing = stored(on.where("t is null").select("entry", "tree", "node"), "missing")
    found = on.where("t is not null").select("entry", "tree", "ns", "firsts")
    if not missing.isEmpty():
        levels = F.explode(F.sequence(F.lit(0), F.lit(deepest - 1))).alias("level")
        up = F.expr(f"shiftright(node, {deepest} - level)").alias("up")
        above = paths.select("tree", "node", levels).groupBy("tree", "level", up).agg(F.min("node").alias("leaf"))
        climbs = missing.select("entry", "tree", "node", levels).select("entry", "tree", "level", up).join(above, ["tree", "level", "up"])
        climbs = climbs.groupBy("entry", "tree").agg(F.max(F.struct("level", "leaf")).alias("s")).select("entry", "tree", "s.level", F.col("s.leaf").alias("node"))
        size = F.col("level") + 1
        empty = F.concat(F.slice("ns", F.lit(1), size), F.array_repeat(F.lit(0).cast("long"), F.lit(deepest) - F.col("level")))
        found = found.unionByName(climbs.join(paths, ["tree", "node"]).select("entry", "tree", empty.alias("ns"), F.slice("firsts", F.lit(1), size).alias("firsts")))
    found = stored(found, "descents")
    sums = F.array(*[F.sum(F.col("ns")[i]) for i in range(deepest + 1)])
    level = found.groupBy("entry").agg(sums.alias("held")).select("entry", F.greatest(F.lit(0), F.array_max(F.transform(
        "held", lambda n, i: F.when(n >= enough, i).otherwise(F.lit(0))))).alias("level"))
    reached = found.join(level, "entry")
    # The roots of all trees hold the same entries.
    once = (F.col("level") > 0) | (F.col("tree") % trees == 0)
    return reached.where(once).select("entry", F.col("firsts")[F.col("level")].alias("first"), F.col("ns")[F.col("level")].alias("n")).where("n > 0")


def _paths(nodes: DataFrame, low: int, high: int) -> DataFrame:
    """``tree, node, ns, firsts``: for nodes of level ``high`` the sizes and starts of their nodes at the levels from ``low`` on.

    A group holds the nodes below one node of level ``low``, ``2 ** TIER`` at most.
    """
    def run(table: pa.Table) -> pa.Table:
        node, n, first = (table.column(c).to_numpy() for c in ("node", "n", "first"))
        ns, firsts = np.empty((len(node), high - low + 1), np.int64), np.empty((len(node), high - low + 1), np.int64)
        for level in range(low, high + 1):
            _, back = np.unique(node >> (high - level), return_inverse=True)
            start = np.full(back.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(start, back, first)
            ns[:, level - low], firsts[:, level - low] = np.bincount(back, n).astype(np.int64)[back], start[back]
        kind = pa.list_(pa.int64())
        return pa.table([table.column("tree"), table.column("node"), pa.array(ns.tolist(), kind), pa.array(firsts.tolist(), kind)],
                        names=["tree", "node", "ns", "firsts"])

    grouped = nodes.groupBy("tree", F.shiftright("node", high - low).alias("under"))
    return grouped.applyInArrow(run, "tree long, node long, ns array<long>, firsts array<long>")


def _scored(table: pa.Table, kept: int) -> pa.Table:
    """The first entries of each search within one chunk of a sorted array."""
    table = table.combine_chunks()
    side, entry, first, least = (table.column(c).to_numpy() for c in ("side", "entry", "first", "least"))
    n = table.column("n").to_pandas().fillna(0).to_numpy().astype(np.int64)
    out = []
    for _, at, matrix in _matrices(table.column("vector").combine_chunks()):
        held, asked = np.flatnonzero(side[at] == 1), np.flatnonzero(side[at] == 0)
        held = held[np.argsort(first[at[held]], kind="stable")]
        places = first[at[held]]
        lo, hi = np.searchsorted(places, first[at[asked]]), np.searchsorted(places, first[at[asked]] + n[at[asked]])
        order = np.lexsort((hi, lo))
        for group in np.split(order, np.flatnonzero(np.diff(lo[order]) | np.diff(hi[order])) + 1) if len(order) else []:
            rows = held[lo[group[0]]:hi[group[0]]]
            if not len(rows):
                continue
            for s in range(0, len(group), 256):
                heads = asked[group[s:s + 256]]
                scores = matrix[heads] @ matrix[rows].T
                for i, head in enumerate(heads):
                    best = rows[first_rows(scores[i], least[at[rows]], kept)]
                    # One order of additions for a pair, wherever it is met.
                    out.append((np.full(len(best), entry[at[head]]), entry[at[best]], np.einsum("j,ij->i", matrix[head], matrix[best])))
    merged = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return pa.table([pa.array(merged[0], pa.int64()), pa.array(merged[1], pa.int64()), pa.array(merged[2], pa.float64())], names=["query", "entry", "score"])
