"""Hard negatives and nearest neighbours against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm.forest import nearest_vectors
from tabforge.llm.negatives import _EXACT, bounds, encode, hard_negatives, planes, rotation

SCHEMA = "vec_id long, embedding array<float>, label int, score int, rank int, key string, place int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "k", 3) for i, v, label in rows], SCHEMA)


def some(n, dims, seed, labels=3):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1) for _ in range(dims)], r.randrange(labels)) for i in range(n)]


ODD = [(1000, None, 1), (1001, [1.0, None, 0.0, 0.0], 1), (1002, [math.nan, 0.0, 0.0, 0.0], 1), (1003, [math.inf, 0.0, 0.0, 0.0], 1),
       (None, [1.0, 0.0, 0.0, 0.0], 1), (1005, [0.0, 0.0, 0.0, 0.0], 1), (1006, [], 1), (1010, [1.0, 2.0], 1), (1011, [1.0, 2.0], 2),
       (1012, [1.0, 2.0, 3.0, 4.0], None)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows, anchors, positives=5, negatives=3):
    rows = {(i, label, tuple(np.float32(x).item() for x in v)) for i, v, label in rows if i is not None and label is not None and usable(v)}
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for i, label, v in whole:
        if not anchors(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in whole if j != i and len(w) == len(v)]
        best = sorted(s for s in scored if s[2] == label)[:positives]
        for minus, p, _ in best:
            fit = sorted(s for s in scored if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus)[:negatives]
            out += [(i, p, r, j, -minus, -s) for r, (s, j, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 2048), (17, 3)])
def test_hard_negatives_equal_brute_force(spark, blocks):
    rows = some(150, 4, 1) + ODD
    rows += rows[:20] + [(200 + i, rows[i][1], rows[i][2]) for i in range(30)]  # repeated rows, and ties of other ids
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0, block_rows=blocks[0], block_anchors=blocks[1])
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 5 == 0)


def test_hard_negatives_of_long_and_wide_vectors(spark):
    rows = some(60, 130, 2) + [(300 + i, [x * 1e9 for x in v], label) for i, v, label in some(12, 3, 3)]
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 4 == 0)
    long = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    want = [(*r[:4], long(r[4]), long(r[5])) for r in plain_negatives(rows, lambda i: i % 4 == 0) if abs(r[4]) < 1 << 63]
    assert [r for r in sorted(map(tuple, got.collect())) if r[4] < (1 << 63) - 1] == want


def test_hard_negatives_of_an_empty_table(spark):
    assert hard_negatives(table(spark, []), F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives(table(spark, ODD), F.col("vec_id") % 5 == 0).collect() == []


@pytest.mark.parametrize("dims", [1, 3, 64, 100])
def test_intervals_hold_every_product(dims):
    rng = np.random.default_rng(dims)
    rows, heads = np.floor(rng.standard_normal((300, dims)) * 256) + 40, np.floor(rng.standard_normal((20, dims)) * 256)
    center, rotate = rows.mean(axis=0), rotation(dims)
    codes, aligned, rest = encode(rows, center, rotate)
    bits, low, step, total, error = planes(heads, rotate)
    side = {"dims": dims, "center": heads @ center, "center_length": np.linalg.norm(center), "planes": bits, "low": low, "step": step, "total": total,
            "error": error, "length": np.linalg.norm(heads, axis=1)}
    block = {"codes": codes, "aligned": aligned, "rest": rest, "length": np.linalg.norm(rows, axis=1)}
    least, most = bounds(side, block, slice(0, 20), slice(0, 300))
    assert ((least <= heads @ rows.T) & (heads @ rows.T <= most)).all()
    if dims > 8:  # and they are far narrower than what the lengths alone allow
        assert np.median(most - least) < 0.8 * np.median(np.outer(side["length"], block["length"]))
    assert _EXACT > 0


def plain_nearest(rows, asked, k):
    rows = {(i, tuple(np.float32(x).item() for x in v)) for i, v, _ in rows if i is not None and usable(v) and any(v)}
    out = {}
    for i, v in rows:
        if asked(i):
            scored = {}
            for j, w in rows:
                if j != i and len(w) == len(v):
                    scored[j] = max(scored.get(j, -math.inf), sum(a * b for a, b in zip(v, w)))
            out[i] = sorted(((-s, j) for j, s in scored.items()))[:k]
    return out


def found(frame):
    out = {}
    for q, rank, j, score in sorted(map(tuple, frame.collect())):
        out.setdefault(q, []).append((-score, j))
        assert rank == len(out[q])
    return out


def test_nearest_vectors_with_full_recall(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i % 40).integers(-2, 3, 6)], 0) for i in range(160)] + ODD  # copies and ties
    rows += rows[:15]
    frame = table(spark, rows)
    got = nearest_vectors(frame, F.col("vec_id") % 10 == 0, k=7, recall=1.0, chunk=16)
    assert found(got) == {q: near for q, near in plain_nearest(rows, lambda i: i % 10 == 0, 7).items() if near}


def test_nearest_vectors_of_one_vector_for_all(spark):
    rows = [(i, [1.0, 2.0, -0.0], 0) for i in range(90)] + [(100, [1.0, 2.0, 0.0], 0)]
    assert found(nearest_vectors(table(spark, rows), F.col("vec_id") % 30 == 0, k=4)) == plain_nearest(rows, lambda i: i % 30 == 0, 4)


def test_nearest_vectors_of_empty_tables(spark):
    assert nearest_vectors(table(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert nearest_vectors(table(spark, ODD[:7]), F.col("vec_id") % 10 == 0).collect() == []
    assert nearest_vectors(table(spark, some(20, 3, 1)), F.col("vec_id") > 1000).collect() == []


def test_recall_of_the_query(spark, sf_dir):
    from tabforge.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, got = plain_nearest(rows, lambda i: i % 20 == 0, 20), found(QUERIES["op13_hash_prefix_forest"](spark, sf_dir))
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    scores = {q: dict((j, s) for s, j in plain_nearest(rows, lambda i: i == q, len(rows))[q]) for q in list(want)[:3]}
    assert all(abs(scores[q][j] - s) < 1e-12 for q in scores for s, j in got[q])
