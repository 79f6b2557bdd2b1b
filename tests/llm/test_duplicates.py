"""Exact, near and embedding duplicates against brute force."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import frame  # noqa: F401
from tabforge.llm import exact, minhash
from tabforge.llm.common import connected
from tabforge.llm.embeddings import linked, similar_vectors, unit
from tabforge.llm.exact import chunks, exact_duplicates, identify
from tabforge.llm.minhash import buckets, near_duplicates, shingles, signature
from tabforge.llm.queries import QUERIES


def components(nodes, edges):
    root = {n: n for n in nodes}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)]
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == components(nodes, edges)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunks():
    data = random.Random(0).randbytes(60_000)
    found = chunks(data)
    assert b"".join(found) == data and max(map(len, found)) <= exact.LONGEST and len(found) > 10
    assert set(chunks(b"new start " * 60 + data)) & set(found)  # boundaries find each other again
    assert chunks(b"") == [] and chunks(b"a") == [b"a"] and b"".join(chunks(b"a" * 50_000)) == b"a" * 50_000


@pytest.mark.parametrize("name", [identify, lambda c, seed: identify(c, seed) % 3 if seed < 2 else identify(c, seed)])
def test_exact(spark, frame, name):
    long = " ".join(map(str, range(9000)))
    docs = [(5, "a b"), (2, "ab"), (3, "a  b"), (9, "ab\t"), (4, None), (6, ""), (7, " \n"), (8, long), (10, long.replace(" ", "\n") + " "),
            (11, long + "x"), (12, "é "), (13, "é")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(frame(docs), name=name).collect()}
    assert got == {5: (3, 4, False), 2: (3, 4, False), 3: (3, 4, True), 9: (3, 4, False), 4: (7, 3, False), 6: (7, 3, False), 7: (7, 3, True),
                   8: (10, 2, False), 10: (10, 2, True), 11: (11, 1, True), 12: (12, 1, True), 13: (13, 1, True)}
    assert exact_duplicates(frame(docs).limit(0)).count() == 0
    twice = exact_duplicates(frame([(1, "x"), (1, "x"), (None, "x")])).collect()
    assert sorted((repr(r.doc_id), r.keep_id, r.group_size, r.kept) for r in twice) == [
        ("1", 1, 3, True), ("1", 1, 3, True), ("None", 1, 3, False)]


def brute_near(docs, words, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = set(zip(*[w[k:] for k in range(words)])) if len(w) >= words else {tuple(w)} if w else set()
    edges = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = components(sets, edges)
    return {i: (len(s), found[i], found[i] == i) for i, s in sets.items()}


def near_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(500)}"
    return " ".join(words)


def test_near_matches_brute_force(spark, frame):
    r = random.Random(7)
    docs = []
    for g in range(12):  # groups whose members differ by some words, near the threshold and beyond
        base = [f"w{r.randrange(500)}" for _ in range(r.randrange(5, 150))]
        docs += [edited(r, base, r.randrange(0, 1 + len(base) // 16)) for _ in range(r.randrange(1, 12))]
    chain = [f"c{i}" for i in range(120)]
    for i in range(12):  # each links with the next only
        chain[8 * i:8 * i + 3] = [f"new{i}a", f"new{i}b", f"new{i}c"]
        docs.append(" ".join(chain))
    docs += [None, "", " \n\t ", "one", "ONE", "one two", "one two three four", "One Two three\ffour", "É é", "é É", "x " * 4000, "x " * 3999]
    docs = list(enumerate(docs))
    r.shuffle(docs)
    assert near_rows(near_duplicates(frame(docs), words=4)) == brute_near(docs, 4, 80)


def test_near_finishes_a_hub_that_links_with_few(spark, frame, monkeypatch):
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)  # all links from the last, full comparison
    r = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    docs = list(enumerate(edited(r, base, r.randrange(0, 4)) for _ in range(25)))
    assert near_rows(near_duplicates(frame(docs))) == brute_near(docs, 5, 80)


def test_near_edges(spark, frame):
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(
        frame([(1, "a b"), (1, "c d"), (None, "a b"), (0, "c d"), (3, "c d"), (3, "c d")])).collect())
    assert got == [("0", 1, 0, True), ("1", 1, 0, False), ("1", 1, 0, False), ("3", 1, 0, False), ("3", 1, 0, False), ("None", 1, None, True)]
    assert near_duplicates(frame([(1, "a")]).limit(0)).count() == 0


def test_recall_and_variance_of_minmax():
    r = np.random.default_rng(0)
    hits = values = 0
    for _ in range(300):
        x = r.integers(0, 1 << 63, 900).astype(np.uint64)
        a, b = np.unique(x[:800]), np.unique(x[100:])  # similarity 7/9
        low, high = zip(signature(a), signature(b))
        values += (low[0] == low[1]).mean() / 2 + (high[0] == high[1]).mean() / 2
        hits += bool(set(buckets(a)) & set(buckets(b)))
    assert hits == 300 and abs(values / 300 - 700 / 900) < 0.01


def test_shingles_are_of_ascii_case_and_space():
    assert (shingles(b"A b C d e", 4) == shingles("a B\tc\x0bD e".encode(), 4)).all()
    assert len(shingles("a b".encode(), 1)) == 1 and len(shingles(b"a b a b a b", 2)) == 2


def brute_vectors(rows, similarity):
    use = {k: np.array(v, float) for k, (v, label) in rows.items() if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    edges = []
    for a, b in combinations(sorted(use), 2):
        if rows[a][1] == rows[b][1] and len(use[a]) == len(use[b]):
            if use[a] @ use[b] / np.linalg.norm(use[a]) / np.linalg.norm(use[b]) >= similarity:
                edges.append((a, b))
    degree = defaultdict(int)
    for e in edges:
        for x in e:
            degree[x] += 1
    found = components(rows, edges)
    return {k: (degree[k], found[k], found[k] == k) for k in rows}


@pytest.mark.parametrize("block", [16, 2048])
def test_vectors_match_brute_force(spark, block):
    r = np.random.default_rng(4)
    rows, k = {}, 0
    for dims in (2, 16):
        for label in (0, 1, None):
            centres = r.standard_normal((8, dims))
            for _ in range(45):
                v = centres[r.integers(8)] + r.standard_normal(dims) * r.choice([0, 0.1, 0.25])
                rows[k] = ((v * r.choice([1, 3])).astype(np.float32).tolist(), label)
                k += 1
    nan, inf = float("nan"), float("inf")
    for v in (None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1e30, 1e30], [1.0, 1.0], [-0.0, 1.0], [0.0, 1.0]):
        rows[k] = (v, 0)
        k += 1
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "vec_id long, embedding array<float>, label int")
    df = df.selectExpr("*", "1 as vector", "2 as class", "3 as block", "4 as usable")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in similar_vectors(df, block_rows=block).collect()}
    assert got == brute_vectors(rows, 0.93)
    assert similar_vectors(df.limit(0)).count() == 0


def test_collisions_find_every_pair():
    r = np.random.default_rng(9)
    a = unit(np.repeat(r.standard_normal((60, 64)), 10, axis=0) + 0.2 * r.standard_normal((600, 64)))
    x, y = linked(a, a, 0.93)
    assert set(zip(x.tolist(), y.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(a @ a.T >= 0.93)))) and len(x) > 1500


def test_queries_over_whole_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert near_rows(QUERIES["op6_minmax_near_dedup"](spark, sf_dir)) == brute_near(docs, 4, 80)
    rows = {r.vec_id: (r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op2_collision_near_dedup"](spark, sf_dir).collect()}
    assert got == brute_vectors(rows, 0.93)
