"""Ranked metrics, keyed exchanges, curves, random features and keyed stream state."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators.metrics import ranked_auc
from tabforge.operators.rows import running_totals
from tabforge.plans import models as MO
from tabforge.plans import training as TR
from tabforge.plans.importance import exchange, permutation_importance
from tabforge.plans.randomfeatures import RandomCosines
from tabforge.streaming.batches import drain, drop_repeated, write_batches


def plain_auc(rows):
    pos, neg = ([s for y, s in rows if y == k] for k in (1, 0))
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_groups_and_gaps(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(2), 1.0 if r.random() < 0.4 else round(r.gauss(0, 1), 1)) for _ in range(400)]
    rows += [("one", 1, 0.5), ("one", 1, 0.7), (None, 0, 1.0), (None, 1, 2.0)]
    odd = [("a", None, 1.0), ("a", 1, None), ("a", 0, math.nan)]
    df = spark.createDataFrame(rows + odd, "g string, y int, s double").repartition(5)
    got = {x.g: x.value for x in ranked_auc(df, "y", "s", by=["g"]).collect()}
    for g in ("a", "b", "one", None):
        want = plain_auc([(y, s) for k, y, s in rows if k == g])
        assert got[g] == (want if want is None else pytest.approx(want, abs=1e-12))
    whole = ranked_auc(df, "y", "s").collect()
    assert [x.metric for x in whole] == ["auc"] and whole[0].value == pytest.approx(plain_auc([(y, s) for _, y, s in rows]), abs=1e-12)
    assert ranked_auc(df.limit(0), "y", "s").collect()[0].value is None


def test_auc_of_other_labels_and_large_counts(spark):
    df = spark.createDataFrame([("yes", 3), ("no", 1), ("no", 3), ("yes", 2)], "y string, s int")
    assert ranked_auc(df, "y", "s", pos_label="yes").first().value == pytest.approx(0.625)


def test_running_totals_in_groups(spark):
    rows = [(i % 3 or None, i // 7, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, k int, n long").repartition(7)
    got = running_totals(df, ["g"], ["k", "n"], {"n": "before"}).collect()
    for x in got:
        assert x.before == sum(n for g, k, n in rows if g == x.g and (k, n) < (x.k, x.n))
    assert len(got) == 200


def test_exchange_is_a_permutation():
    for n in [*range(1, 60), 4096, 9973]:
        step, start = exchange(n, 42)
        assert len({(i * step + start) % n for i in range(n)}) == n
    step, _ = exchange(10**12, 7)
    assert step * 10**12 < 1 << 63 and math.gcd(step, 10**12) == 1


def lines(spark, n=900):
    r = random.Random(1)
    rows = [(i, r.randrange(7), r.randrange(9), r.random()) for i in range(n)]
    return spark.createDataFrame([(i, a, b, c, int(a > 3 and b > 4)) for i, a, b, c in rows], "id int, a int, b int, c double, y int")


def test_permutation_importance_ignores_partitions(spark):
    df = lines(spark)
    model = TR.train_random_forest(df, "y", features=["a", "b", "c"], n_estimators=4, max_depth=4)
    two, nine = (dict(permutation_importance(model, df.repartition(n)).collect()) for n in (2, 9))
    assert two == nine and two["a"] > 0.1 and two["b"] > 0.1 and abs(two["c"]) < 0.05


def test_round_curve(spark):
    df = lines(spark)
    model = TR.train_boosted(df, "y", features=["a", "b"], n_estimators=5, max_depth=3)
    curve = sorted(MO.round_curve(model, df).collect())
    assert [r["round"] for r in curve] == [1, 2, 3, 4, 5] and all(x.loss > y.loss for x, y in zip(curve, curve[1:]))
    with pytest.raises(ValueError):
        MO.round_curve(TR.train_random_forest(df, "y", features=["a"], n_estimators=2), df)
    assert MO.model_auc(model, df).first().value > 0.99


def test_numeric_network_learns_products_and_is_saved(spark, tmp_path):
    r = random.Random(2)
    rows = [(a, b, a * b) for a, b in ((r.gauss(0, 1), r.gauss(0, 1)) for _ in range(1500))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = TR.train_mlp(df.limit(1200), "y", features=["a", "b"], task="regression")
    error = lambda m: np.sqrt(np.mean([(x.y - x.p) ** 2 for x in MO.predict(m, df, output="p").collect()]))
    assert error(model) < 0.2 < 0.8 < np.std([y for *_, y in rows])
    MO.save_model(spark, model, f"file://{tmp_path}/model")
    again = MO.load_model(spark, f"file://{tmp_path}/model")
    key = lambda m: sorted((x.a, x.b, x.p) for x in MO.predict(m, df, output="p").collect())
    assert key(again) == key(model)


def test_random_cosines_keep_the_vector(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),), (Vectors.sparse(2, [1], [3.0]),)], ["x"])
    out = [r.z.toArray() for r in RandomCosines(inputCol="x", outputCol="z", count=8, seed=1).transform(df).collect()]
    assert [list(z[:2]) for z in out] == [[1.0, 2.0], [0.0, 3.0]] and all(len(z) == 10 and abs(z[2:]).max() <= 1 for z in out)


START = datetime(2024, 1, 1)


def poll(spark, folder, rows):
    spark.createDataFrame([(i, START + timedelta(minutes=m)) for i, m in rows], "id int, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(folder)


def test_repeated_rows_are_dropped_across_batches_and_restarts(spark, tmp_path):
    folder, sink, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    run = lambda: sorted(r.id for r in drain(drop_repeated(
        spark.readStream.schema("id int, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(folder), ["id"], "ts", "1 hour"), sink, checkpoint).collect())
    poll(spark, folder, [(1, 0), (2, 5), (2, 5)])
    poll(spark, folder, [(2, 5), (3, 10)])
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]  # nothing new
    poll(spark, folder, [(1, 0), (3, 10), (4, 20)])
    assert run() == [1, 2, 3, 4]  # the state was kept over the restart
    poll(spark, folder, [(5, 600)])
    run()
    poll(spark, folder, [(6, 601), (1, 0), (7, 30)])  # 1 again and 7, both before the watermark
    assert run() == [1, 2, 3, 4, 5, 6]
    poll(spark, folder, [(4, 700)])  # its entry has expired: a new row of an old key
    assert run() == [1, 2, 3, 4, 4, 5, 6]


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    folder, sink, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    for k in range(3):
        poll(spark, folder, [(10 * k + i, i) for i in range(4)])
    spark.range(99).selectExpr("cast(id as int) id", "timestamp_ntz'2024-01-01' ts").write.parquet(f"{sink}/sequence=1")  # left by a failure
    stream = spark.readStream.schema("id int, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(folder)
    got = [(r.id, r.sequence) for r in write_batches(stream, sink, checkpoint).collect()]
    assert sorted(i for i, _ in got) == sorted(10 * k + i for k in range(3) for i in range(4))
    assert {s for _, s in got} == {0, 1, 2} and all(len({s for i, s in got if i // 10 == k}) == 1 for k in range(3))


@pytest.mark.parametrize("width", [64, 512])
def test_shapley_values_add_up_whatever_the_width(spark, width):
    from tabforge.plans.shap import contributions, model_leaves, packed
    r = np.random.default_rng(5)
    x = r.integers(0, 6, (300, width)).astype(float)
    y = 3 * x[:, 1] + x[:, width - 2] * (x[:, 7] > 2)
    df = spark.createDataFrame([(row.tolist(), float(v)) for row, v in zip(x, y)], "x array<double>, y double")
    model = TR.train_random_forest(df, "y", features=["x"], task="regression", n_estimators=3, max_depth=5, featureSubsetStrategy="all")
    leaves = model_leaves(spark, model)
    phi = contributions(leaves, x)
    predicted = {tuple(p.x): p.p for p in MO.predict(model, df, output="p").collect()}
    mean = sum(leaf[0][0] * np.prod(leaf[4]) for leaf in leaves)
    assert phi.shape == (300, width, 1)
    assert np.allclose(phi.sum(axis=(1, 2)), [predicted[tuple(row)] - mean for row in x.tolist()])
    assert set(np.argsort(-np.abs(phi).mean(axis=(0, 2)))[:2]) <= {1, 7, width - 2}
    cells = sum(sum(a.size for a in g[:5]) for g in packed(leaves))
    assert cells <= sum(5 * len(leaf[1]) + 1 for leaf in leaves)
