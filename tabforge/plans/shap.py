"""Mean absolute Shapley values of tree models, over all given rows.

The trees are read as tables; each task scores its rows against every leaf, equal rows once.
For a leaf, a feature takes part through the share of training rows that pass
its splits (feature unknown) or through whether the row passes them (known).
"""

from __future__ import annotations

from collections.abc import Iterable
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.workspace import scratch_path
from tabforge.plans.models import ROWS, TrainedModel, grouped, model_array, model_names

# A leaf as (value per output, features, lower bounds, upper bounds, shares).
Leaf = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def shap_importance(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Mean |contribution| of each feature, averaged over classes too.

    Forests explain class probabilities or the predicted value; boosted models
    explain their margins.
    """
    spark = df.sparkSession
    names = model_names(model)
    # As large as the model: a task gets the leaves once and packs them once.
    leaves = spark.sparkContext.broadcast(model_leaves(spark, model))
    width = len(names)

    def explain(batches: Iterable[pd.DataFrame]):
        groups = None
        for b in batches:
            groups = packed(leaves.value) if groups is None else groups
            x, n = np.array(b["x"].tolist(), float).reshape(len(b), width), b["n"].to_numpy()
            phi = contributions(leaves.value, x, groups)
            yield pd.DataFrame([[n.sum(), *(np.abs(phi).mean(axis=2) * n[:, None]).sum(axis=0)]],
                               columns=["n", *[f"s{i}" for i in range(width)]])

    # Equal rows have equal values, so each is explained once.  A fixed number of partitions: rows are small, but dear.
    rows = grouped(df, model.features)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select(model_array(rows, model).alias("x"), F.col(ROWS).alias("n")).repartition(parts)
    sums = rows.mapInPandas(explain, "n bigint, " + ", ".join(f"s{i} double" for i in range(width)))
    one = sums.agg(*[(F.sum(f"s{i}") / F.sum("n")).alias(f"s{i}") for i in range(width)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"s{i}").alias("score")) for i, n in enumerate(names)])))


def contributions(leaves: list[Leaf], x: np.ndarray, groups: list[tuple] | None = None) -> np.ndarray:
    """Shapley values, shape (rows, features, outputs)."""
    outputs = len(leaves[0][0]) if leaves else 1
    phi = np.zeros((len(x), x.shape[1], outputs))
    for group in packed(leaves) if groups is None else groups:
        step = max(1, _CELLS // (group[0].size + len(group[0])))
        for at in range(0, len(x), step):
            _add_contributions(phi[at:at + step], group, x[at:at + step])
    return phi


# Array cells a task works on at a time.
_CELLS = 1 << 22


def packed(leaves: list[Leaf]) -> list[tuple]:
    """Leaves with equally many features as arrays, and where each feature of their paths adds up.

    ``places[j]`` orders the leaves by their ``j``-th feature: the order, where each feature starts, and the features.  Its
    size follows the leaves and their depth, not the width of the table.
    """
    by_size: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        by_size.setdefault(len(leaf[1]), []).append(leaf)
    out = []
    for d, same in by_size.items():
        if d == 0:
            continue
        for at in range(0, len(same), 4096):
            part = same[at:at + 4096]
            value, feats, low, high, share = (np.array([leaf[i] for leaf in part]) for i in range(5))
            places = []
            for j in range(d):
                order = np.argsort(feats[:, j], kind="stable")
                there, start = np.unique(feats[order, j], return_index=True)
                places.append((order, start, there))
            out.append((feats, low, high, share, value, places))
    return out


def _add_contributions(phi: np.ndarray, group: tuple, x: np.ndarray) -> None:
    """Extend each leaf's path by all its features, then unwind one at a time for that feature's value."""
    feats, low, high, share, value, places = group
    d = feats.shape[1]
    values = x[:, feats]
    known = (values > low) & (values <= high)
    # Coefficient k of the product over all features: k of them known.
    poly = np.zeros((*known.shape[:2], d + 1))
    poly[..., 0] = 1.0
    for m in range(d):
        shifted = poly[..., :-1] * known[..., m:m + 1]
        poly *= share[:, m:m + 1]
        poly[..., 1:] += shifted
    order = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
    for j in range(d):
        # Take feature j out of the product again: divide by (share + t) or by share.
        s, weight, q = share[:, j], 0.0, 0.0
        for k in range(d - 1, -1, -1):
            q = np.where(known[..., j], poly[..., k + 1] - s * q, poly[..., k] / s)
            weight = weight + order[k] * q
        order_j, start, there = places[j]
        part = ((known[..., j] - s) * weight)[:, order_j]
        for o in range(value.shape[1]):
            phi[:, there, o] += np.add.reduceat(part * value[order_j, o], start, axis=1)


def model_leaves(spark: SparkSession, model: TrainedModel) -> list[Leaf]:
    """Leaves of all trees, values scaled so that they add up to the output."""
    total = sum(m.getNumTrees for m in model.members)
    out: list[Leaf] = []
    for k, member in enumerate(model.members):
        weights = list(member.treeWeights)
        boosted = "GBT" in type(member).__name__
        for tree, nodes in _tree_tables(spark, member).items():
            scale = weights[tree] if boosted else 1.0 / total
            value = _class_share if model.combine == "votes" else _prediction
            for leaf in _walk(nodes, value):
                v = leaf[0] * scale
                if model.combine == "one_vs_rest":
                    v = np.eye(len(model.members))[k] * v
                out.append((v, *leaf[1:]))
    return out


def _tree_tables(spark: SparkSession, member) -> dict[int, dict[int, object]]:
    """Node rows of each tree, from the model's own table format."""
    path = scratch_path(spark, "trees")
    member.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    found: dict[int, dict[int, object]] = {}
    for r in nodes.toLocalIterator():
        found.setdefault(r.treeID, {})[r.id] = r
    return found


def _class_share(node) -> np.ndarray:
    stats = np.asarray(node.impurityStats, float)
    return stats / stats.sum()


def _prediction(node) -> np.ndarray:
    return np.array([node.prediction])


def _weight(node, by_class: bool) -> float:
    """Training rows of a node: equal rows may be one weighted row, of which ``rawCount`` knows nothing."""
    return float(sum(node.impurityStats) if by_class else node.impurityStats[0])


def _walk(nodes: dict[int, object], value) -> Iterable[Leaf]:
    """Leaves with the splits of their paths merged per feature."""
    pending, by_class = [(0, {})], value is _class_share
    while pending:
        node_id, path = pending.pop()
        node = nodes[node_id]
        if node.leftChild < 0:
            feats = sorted(path)
            low, high, share = (np.array([path[f][i] for f in feats]) for i in range(3))
            yield value(node), np.array(feats, int), low, high, share
            continue
        feature, bound = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
        for child, left in ((node.leftChild, True), (node.rightChild, False)):
            lo, hi, share = path.get(feature, (-np.inf, np.inf, 1.0))
            part = _weight(nodes[child], by_class) / _weight(node, by_class)
            lo, hi = (lo, min(hi, bound)) if left else (max(lo, bound), hi)
            pending.append((child, {**path, feature: (lo, hi, share * part)}))
