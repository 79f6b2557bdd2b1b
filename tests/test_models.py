import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import rows
from tabforge.plans import models as MO
from tabforge.plans import training as TR
from tabforge.plans import updating as UP
from tabforge.plans.feature_sets import FeatureSets, save_merged
from tabforge.plans.importance import permutation_importance
from tabforge.plans.shap import contributions, model_leaves, shap_importance
from tabforge.plans.tuning import BOOSTED_SPACE, draw, train_tuned, tune


@pytest.fixture(scope="module")
def people(spark):
    """600 rows: ``label`` depends on income only, ``band`` on age, ``target`` on both."""
    r = spark.range(600)
    df = r.select(
        (20 + 40 * F.rand(1)).alias("age"), (F.rand(2) * 80000 + 20000).alias("income"), F.rand(3).alias("score"))
    df = df.select(
        "*", (F.col("income") > 55000).cast("int").alias("label"),
        F.when(F.col("age") > 45, "old").when(F.col("age") > 32, "mid").otherwise("young").alias("band"),
        (F.col("age") * 2 + F.col("income") / 1000).alias("target"))
    return df.checkpoint()


X = ["age", "income", "score"]


def values(df):
    return {r.metric: r.value for r in df.collect()}


def shuffled(df, label, seed=9):
    """Control: the same labels on other rows."""
    from tabforge.operators.rows import with_row_index

    a = with_row_index(df.drop(label).withColumn("r", F.rand(seed)), "r", "i")
    b = with_row_index(df.select(label).withColumn("r2", F.rand(seed + 1)), "r2", "i")
    return a.join(b, "i").drop("i", "r", "r2")


def test_forest_learns_and_control_does_not(people):
    model = TR.train_random_forest(people, "label", features=X, n_estimators=10, max_depth=5)
    assert model.task == "binary_classification" and model.n_trees == 10
    assert values(MO.evaluate_model(model, people))["accuracy"] > 0.95
    control = TR.train_random_forest(shuffled(people, "label"), "label", features=X, n_estimators=10, max_depth=5)
    assert values(MO.evaluate_model(control, people))["accuracy"] < 0.8


def test_forest_regression(people):
    model = TR.train_random_forest(people, "target", features=X, n_estimators=10, max_depth=8)
    assert model.task == "regression"
    assert values(MO.evaluate_model(model, people))["rmse"] < 6


@pytest.mark.parametrize("label, floor", [("label", 0.95), ("band", 0.95)])
def test_boosting_classifies(people, label, floor):
    model = TR.train_boosted(people, label, features=X, n_estimators=3, max_depth=3)
    assert values(MO.evaluate_model(model, people))["f1"] > floor


def test_default_features_skip_text_and_target(people):
    model = TR.outline(people, "xgboost", "label", None, None, {})
    assert model.features == ["age", "income", "score", "target"]


def test_string_labels_and_confidence(spark, people):
    model = TR.train_random_forest(people, "band", features=X, n_estimators=5, max_depth=4)
    assert model.labels == ["mid", "old", "young"]
    got = MO.predict_with_confidence(model, people, keep=["age"]).collect()
    assert len(got) == 600
    assert all(0 < r.confidence <= 1 and r.top_feature == "age" and r.top_value == r.age for r in got)
    assert {r.prediction for r in got} == {"mid", "old", "young"}
    sparse = MO.predict_with_confidence(model, people.select("age"), keep=["age"])
    assert sparse.count() == 600
    with pytest.raises(ValueError, match="income"):
        MO.predict(model, people.drop("income"))


def test_null_features_are_errors_unless_asked(spark, people):
    model = TR.train_random_forest(people, "label", features=X, n_estimators=3, max_depth=3)
    holes = people.limit(5).withColumn("age", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="feature age is null"):
        MO.predict(model, holes).collect()
    assert MO.predict(model, holes, invalid="zero").count() == 5


def test_save_load_scan_update(spark, people, tmp_path):
    project = f"file://{tmp_path}/proj"
    model = TR.train_random_forest(people, "label", features=X, n_estimators=4, max_depth=4)
    path = MO.save_model(spark, model, MO.model_dir(project, "run_001", "random_forest"))
    with pytest.raises(FileExistsError):
        MO.save_model(spark, model, path)
    again = MO.load_model(spark, path)
    assert rows(MO.predict(again, people)) == rows(MO.predict(model, people))
    receipt = UP.update_saved_model(spark, project, "random_forest", "run_001", "run_002", people, n_estimators=3)
    assert receipt.first().source_run == "run_001"
    newer = MO.load_model(spark, receipt.first().updated_artifact_path)
    assert (newer.n_trees, MO.load_model(spark, path).n_trees) == (7, 4)
    catalog = MO.scan_models(spark, project).orderBy("run_name").collect()
    assert [(r.run_name, r.plugin_name, r.task, r.n_features) for r in catalog] == [
        ("run_001", "random_forest", "binary_classification", 3),
        ("run_002", "random_forest", "binary_classification", 3)]
    metrics = spark.createDataFrame([("run_001", "random_forest", "f1", 0.9), ("run_001", "xgboost", "f1", 0.8)],
                                    "run_name string, plugin_name string, metric string, value double")
    best = MO.publish_best(spark, project, metrics).first()
    assert (best.format, best.plugin, best.path) == ("spark", "random_forest", path)
    assert MO.scan_models(spark, f"{project}/none").count() == 0
    assert [tuple(r) for r in MO.published(spark, project).collect()] == [("run_001", "spark", path, "random_forest")]


def test_publishing_replaces_only_the_runs_given(spark, tmp_path):
    project = f"file://{tmp_path}/project"
    models = spark.createDataFrame([("a", "xgboost"), ("a", "own"), ("b c+%41", "xgboost"), ("007", "lightgbm")], "run_name string, plugin_name string")
    rows = [("a", "xgboost", "f1", 0.5), ("a", "own", "f1", 0.5), ("b c+%41", "xgboost", "f1", 0.1), ("007", "lightgbm", "f1", None)]
    metrics = spark.createDataFrame(rows, "run_name string, plugin_name string, metric string, value double")
    assert MO.published(spark, project).count() == 0
    MO.publish_best(spark, project, metrics, models=models)
    again = spark.createDataFrame([("a", "xgboost", "rmse", 1.0), ("a", "own", "rmse", 2.0), ("007", "lightgbm", "rmse", 0.0)], metrics.schema)
    MO.publish_best(spark, project, again, "rmse", models)
    assert sorted((r.run_name, r.plugin, r.path[len(project):]) for r in MO.published(spark, project).collect()) == [
        ("007", "lightgbm", "/runs/007/artifacts/lgbm_model"), ("a", "xgboost", "/runs/a/artifacts/xgb_model"),
        ("b c+%41", "xgboost", "/runs/b c+%41/artifacts/xgb_model")]
    lost = spark.createDataFrame([("b c+%41", "own", "f1", 1.0), ("z", "own", "f1", 1.0)], metrics.schema)
    with pytest.raises(FileNotFoundError, match="runs/z/artifacts/own_model"):
        MO.publish_best(spark, project, lost, models=models)
    assert MO.published(spark, project).count() == 3
    assert MO.publish_best(spark, project, metrics.limit(0), models=models).count() == 0 and MO.published(spark, project).count() == 3


def test_saved_models_of_oddly_named_runs_are_found(spark, tmp_path, people):
    project, run = f"file://{tmp_path}/project", "my run+1"
    MO.save_model(spark, TR.train_random_forest(people, "label", features=X, n_estimators=1, max_depth=2), MO.model_dir(project, run, "random_forest"))
    metrics = spark.createDataFrame([(run, "random_forest", "f1", 0.9)], "run_name string, plugin_name string, metric string, value double")
    assert MO.load_model(spark, MO.publish_best(spark, project, metrics).first().path).n_trees == 1


def test_update_needs_all_features(people):
    model = TR.train_random_forest(people, "label", features=X, n_estimators=2, max_depth=2)
    with pytest.raises(ValueError, match="income"):
        UP.update_forest(model, people.drop("income"))


def test_forest_update_votes_add_up(people):
    model = TR.train_random_forest(people, "label", features=X, n_estimators=3, max_depth=3)
    one_class = people.where("label = 1")
    newer = UP.update_forest(model, one_class, 5)
    scores = MO.add_scores(newer, people.limit(50).withColumn(MO.FEATURES, MO.inputs(people, newer)))
    assert all(abs(sum(r[MO.SCORES]) - 1) < 1e-9 and r[MO.SCORES][1] >= 5 / 8 - 1e-9 for r in scores.collect())


@pytest.mark.parametrize("label", ["label", "target", "band"])
def test_boosted_update_lowers_loss(spark, people, label):
    model = TR.train_boosted(people, label, features=X, n_estimators=2, max_depth=2)
    newer = UP.update_boosted(model, people, n_estimators=4, checkpoint_every=2)
    assert newer.n_trees == model.n_trees + 4 * len(model.members)
    before, after = (values(MO.evaluate_model(m, people)) for m in (model, newer))
    if label == "target":
        assert after["rmse"] < before["rmse"]
    else:
        assert after["f1"] >= before["f1"]


def test_updated_boosting_margin_matches_its_rounds(spark, people, tmp_path):
    model = TR.train_boosted(people, "target", features=X, n_estimators=2, max_depth=2)
    newer = UP.update_boosted(model, people, n_estimators=2, learning_rate=0.5)
    member = newer.members[0]
    assert list(member.treeWeights) == [1.0, 0.1, 0.5, 0.5]
    again = MO.load_model(spark, MO.save_model(spark, newer, f"file://{tmp_path}/m"))
    assert rows(MO.predict(again, people).select("prediction")) == rows(MO.predict(newer, people).select("prediction"))


def test_informative_feature_ranks_first(spark, people):
    model = TR.train_random_forest(people, "label", features=X, n_estimators=5, max_depth=4)
    by_gain = MO.feature_importance(model)
    assert list(by_gain) == X and max(by_gain, key=by_gain.get) == "income"
    by_loss = {r.feature: r.score for r in permutation_importance(model, people, normalise=True).collect()}
    assert set(by_loss) == set(X) and by_loss["income"] > 0.8 and sum(by_loss.values()) == pytest.approx(1)
    by_share = {r.feature: r.score for r in shap_importance(model, people).collect()}
    assert max(by_share, key=by_share.get) == "income"


def test_shapley_values_against_all_subsets(spark, people):
    model = TR.train_boosted(people, "target", features=X, n_estimators=2, max_depth=3)
    leaves = model_leaves(spark, model)
    x = np.array(people.select(*X).limit(4).toPandas(), float)
    phi = contributions(leaves, x)

    def expected(row, known):
        total = 0.0
        for value, feats, low, high, share in leaves:
            w = 1.0
            for f, lo, hi, s in zip(feats, low, high, share):
                w *= float(lo < row[f] <= hi) if f in known else s
            total += value[0] * w
        return total

    for r, i in itertools.product(range(4), range(3)):
        others = [j for j in range(3) if j != i]
        want = sum(
            factorial(k) * factorial(2 - k) / 6 * (expected(x[r], {*s, i}) - expected(x[r], set(s)))
            for k in range(3) for s in itertools.combinations(others, k))
        assert phi[r, i, 0] == pytest.approx(want, abs=1e-9)
    full = [r.prediction for r in MO.predict(model, people.limit(4)).collect()]
    assert [expected(row, {0, 1, 2}) for row in x] == pytest.approx(full)


def test_mlp_text_and_training_log(spark, people):
    net = TR.train_mlp(people, "label", features=X, hidden=8, layers=1, epochs=40)
    assert values(MO.evaluate_model(net, people))["accuracy"] > 0.9
    log = MO.training_log(spark, net).orderBy("epoch").collect()
    assert log[0].epoch == 1 and log[-1].objective < log[0].objective
    line = TR.train_mlp(people, "target", features=X)
    assert values(MO.evaluate_model(line, people))["rmse"] < 1
    reviews = spark.createDataFrame(
        [(f"really {w} product number {i}", s) for i in range(50) for w, s in (("good", "positive"), ("bad", "negative"))],
        "review string, sentiment string")
    text = TR.train_text(reviews, "sentiment", n_features=1 << 12)
    assert text.features == ["review"] and text.labels == ["negative", "positive"]
    assert values(MO.evaluate_model(text, reviews))["accuracy"] == 1.0


def test_scoring_leaves_summaries_behind_and_the_log_keeps_them(spark, tmp_path):
    docs = spark.range(40).selectExpr("if(id % 2 = 0, 'good fine film', 'bad dull film') AS review", "id % 2 AS y")
    # A session that observed a write is not serializable.
    docs.observe(Observation("seen"), F.count("*").alias("n")).write.parquet(f"file://{tmp_path}/seen")
    model = TR.train_text(docs, "y", text="review", epochs=5)
    assert values(MO.evaluate_model(model, docs))["accuracy"] == 1.0
    assert MO.training_log(spark, model).count() > 0


def test_image_resize():
    flat = TR.resize(np.full((4, 6, 3), 9, np.uint8), 3)
    assert flat.shape == (3, 3, 3) and np.allclose(flat, 9)
    ramp = TR.resize(np.arange(16, dtype=np.uint8).reshape(1, 16, 1), 4)
    assert np.allclose(ramp[0, :, 0], [1.5, 5.5, 9.5, 13.5])


def test_tuning(spark, people):
    found = tune(people, "label", plugin="random_forest", features=X, n_trials=2, cv=2,
                 space={"n_estimators": (2, 4), "max_depth": (1, 4), "min_instances": (1, 3)})
    trials = found.trials.collect()
    assert len(trials) == 2 and sum(r.is_best for r in trials) == 1
    assert found.metric == "f1" and found.best_value == max(r.fold_mean for r in trials)
    model = train_tuned(people, found, "label", features=X)
    assert model.n_trees == found.best_params["n_estimators"]
    drawn = draw(BOOSTED_SPACE, 50, 1)
    assert drawn == draw(BOOSTED_SPACE, 50, 1)
    assert all(0.01 <= d["learning_rate"] <= 0.3 and 3 <= d["max_depth"] <= 10 for d in drawn)


def test_search_fits_each_setting_once_a_fold(spark, people, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    fits, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, rows: fits.append(rows.count()) or fit(self, rows))
    settings = [{"n_estimators": 1, "max_depth": 2, "min_instances": 1}, {"n_estimators": 2, "max_depth": 3, "min_instances": 1}]
    found = tune(people, "label", plugin="random_forest", features=X, cv=3, settings=settings)
    folds, n = found.folds.orderBy("trial", "fold").collect(), people.count()
    assert len(fits) == 6 and sum(fits) == 4 * n
    assert [(r.trial, r.fold) for r in folds] == [(t, str(f)) for t in range(2) for f in range(3)]
    assert sum(r.held_out for r in folds) == 2 * n and max(r.held_out for r in folds) - min(r.held_out for r in folds) <= 8
    means = {r.trial: r.fold_mean for r in found.trials.collect()}
    assert all(abs(means[t] - sum(r.value for r in folds if r.trial == t) / 3) < 1e-12 for t in means)
    train_tuned(people, found, "label", features=X)
    assert len(fits) == 7
    for parts in (1, 5):
        same = tune(people.repartition(parts), "label", plugin="random_forest", features=X, cv=3, settings=settings)
        assert [r.value for r in same.folds.orderBy("trial", "fold").collect()] == [r.value for r in folds]


def test_search_by_a_fold_column(spark, people):
    parted = people.withColumn("part", F.when(F.rand(1) < 0.9, F.when(F.col("label") == 1, "x").otherwise("y")))
    with pytest.raises(ValueError, match="folds"):
        tune(people.withColumn("part", F.lit(1)), "label", features=X, fold_col="part", settings=[{"n_estimators": 1}])
    with pytest.raises(ValueError, match="folds"):
        tune(people.limit(0).withColumn("part", F.lit(1)), "target", plugin="random_forest", features=X, fold_col="part", settings=[{"n_estimators": 1}])
    found = tune(parted, "target", plugin="random_forest", fold_col="part", settings=[{"n_estimators": 2, "max_depth": 2}])
    assert found.metric == "rmse"
    assert {r.fold: r.held_out for r in found.folds.collect()} == {
        r.part: r["count"] for r in parted.where("part IS NOT NULL AND target IS NOT NULL").groupBy("part").count().collect()}


# --- feature sets ---

@pytest.fixture
def store(spark, tmp_path):
    return FeatureSets(spark, f"file://{tmp_path}/features")


def test_versions_and_metadata(spark, store):
    big, small = spark.range(10), spark.range(5)
    assert [store.save(big, "x").version, store.save(small, "x", tags=["v1", "production"], run_id=42).version] == [1, 2]
    assert store.load("x").count() == 5 and store.load("x", 1).count() == 10
    meta = store.info("x").first()
    assert (meta.version, meta.row_count, meta.tags, meta.run_id) == (2, 5, ["v1", "production"], 42)
    assert meta.columns == {"id": "int"} and meta.created_at is not None
    store.save(big, "a")
    assert [(r.name, r.version) for r in store.list().collect()] == [("a", 1), ("x", 2)]
    assert [r.version for r in store.versions("x").collect()] == [1, 2]


def test_missing_sets_and_bad_names(spark, store):
    with pytest.raises(KeyError, match="not found"):
        store.load("nope")
    store.save(spark.range(1), "x")
    with pytest.raises(KeyError, match="version 9 not found"):
        store.load("x", 9)
    assert store.list().count() == 1
    for bad in ("", "a/b", "../up", "_catalog"):
        with pytest.raises(ValueError, match="feature_name"):
            store.save(spark.range(1), bad)
    with pytest.raises(ValueError, match="feature_name"):
        save_merged(store, spark.range(1), None)


def test_delete(spark, store):
    for _ in range(3):
        store.save(spark.range(3), "x")
    assert store.delete("x", 3) == 1 and store.load("x").count() == 3
    assert store.info("x").first().version == 2
    assert store.save(spark.range(7), "x").version == 4
    assert store.delete("x") == 3 and store.delete("x") == 0
    with pytest.raises(KeyError):
        store.load("x")


def test_taken_numbers_are_skipped(spark, store):
    from tabforge.functions import workspace

    assert workspace.claim(spark, f"{store.root}/_claims/x/v000001")
    assert not workspace.claim(spark, f"{store.root}/_claims/x/v000001")
    assert store.save(spark.range(1), "x").version == 2


def test_nulls_are_observed_while_writing(spark, store):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x"), (None, "y")], "a double, b string")
    store.save(df, "x")
    got = [(r.column_name, r.logical_type, r.nulls) for r in store.columns("x").collect()]
    assert got == [("a", "float", 2), ("b", "string", 1)]
    receipt = save_merged(store, df, "y", tags=["t"]).first()
    assert tuple(receipt) == ("y", 1, 3)


def test_a_model_does_not_depend_on_the_layout(spark, people):
    few = TR.train_random_forest(people.repartition(2), "label", features=X, n_estimators=4, max_depth=5)
    many = TR.train_random_forest(people.repartition(9), "label", features=X, n_estimators=4, max_depth=5)
    assert few.members[0].toDebugString.split("\n")[1:] == many.members[0].toDebugString.split("\n")[1:]


def test_gaps_are_flagged(spark):
    rows = spark.range(400).selectExpr("IF(id % 4 = 0, NULL, id % 10) AS x", "IF(id % 4 = 0, 1, 0) AS y").withColumn("x", F.col("x").cast("double"))
    model = TR.train_boosted(rows, "y", features=["x"], n_estimators=2, max_depth=2, missing="flag")
    assert MO.model_names(model) == ["x", "x is missing"]
    assert MO.predict(model, rows).where("prediction <> y").count() == 0
    with pytest.raises(Exception):
        TR.train_boosted(rows, "y", features=["x"], n_estimators=1, max_depth=2)


def test_array_features_with_gaps(spark):
    rows = [(i, None if i % 5 == 0 else [float(i % 2), None if i % 7 == 0 else 1.0], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "x int, v array<double>, y int")  # the first array is null
    train = lambda d, **k: TR.train_random_forest(d, "y", features=["v", "x"], n_estimators=3, max_depth=3, **k)
    with pytest.raises(Exception, match="v is null or NaN"):
        train(df)
    for missing, names in (("zero", ["v[0]", "v[1]", "x"]),
                           ("flag", ["v[0]", "v[1]", "x", "v is missing", "x is missing"])):
        model = train(df, missing=missing)
        assert model.widths == {"v": 2} and MO.model_names(model) == names
        got = df.select("x", MO.model_array(df, model).alias("a")).orderBy("x").limit(8).collect()
        want = {0: [0.0, 0.0, 0.0], 1: [1.0, 1.0, 1.0], 7: [1.0, 0.0, 7.0]}
        flags = {0: [1.0, 0.0], 1: [0.0, 0.0], 7: [1.0, 0.0]} if missing == "flag" else {}
        assert all(got[i].a == want[i] + flags.get(i, []) for i in want)
        scored = MO.predict_with_confidence(model, df, keep=["x"])
        assert scored.count() == 200
    with pytest.raises(ValueError, match="arrays of 1 to 2"):
        train(df.unionByName(spark.createDataFrame([(1, [1.0], 0)], df.schema)), missing="zero")
    with pytest.raises(ValueError, match="null in all rows"):
        train(df.where("x % 5 = 0"), missing="zero")
    with pytest.raises(ValueError, match="no rows"):
        MO.array_widths(df.limit(0), ["v"])


def test_search_after_an_observed_write(spark, tmp_path):
    FeatureSets(spark, str(tmp_path)).save(spark.range(3), "seen")
    df = spark.range(60).selectExpr("id AS x", "cast(id % 2 AS int) AS y")
    found = tune(df, "y", plugin="random_forest", features=["x"], cv=2,
                 settings=[{"n_estimators": 2, "max_depth": 2, "min_instances": 1}])
    assert found.trials.count() == 1


# --- equal rows are one weighted row ---

@pytest.fixture(scope="module")
def repeated(spark):
    """16 different rows, 3 times each, and the same 3000 times each."""
    few = spark.range(48).selectExpr("id % 4 AS a", "int(id / 4) % 4 AS b").selectExpr("*", "10.0 * a + b AS number", "a > 1 AND b > 1 AS kind")
    few = few.withColumn("kind", F.col("kind").cast("int")).checkpoint()
    return few, few.crossJoin(spark.range(1000).select()).checkpoint()


@pytest.mark.parametrize("train, rows_a_group", [
    (lambda df: TR.train_boosted(df, "number", features=["a", "b"], n_estimators=3, max_depth=3), 1),
    (lambda df: TR.train_random_forest(df, "number", features=["a", "b"], n_estimators=3, max_depth=4, featureSubsetStrategy="all"), MO.PIECES)])
def test_trees_are_fitted_to_counted_rows(repeated, monkeypatch, train, rows_a_group):
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    seen = []
    for kind in (GBTRegressor, RandomForestRegressor):
        fit = kind._fit
        monkeypatch.setattr(kind, "_fit", lambda self, rows, fit=fit: seen.append((rows.count(), rows.agg(F.sum("__rows")).first()[0])) or fit(self, rows))
    few, many = repeated
    a, b = train(few), train(many)
    assert seen[0][1] == 48 and seen[1] == (16 * rows_a_group, pytest.approx(48000))
    if rows_a_group == 1:
        assert rows(MO.predict(a, few)) == rows(MO.predict(b, few))


def test_shares_curves_and_updates_count_rows(spark, repeated):
    few, many = repeated
    lopsided = few.unionByName(many.where("a = 0"))
    model = TR.train_boosted(lopsided, "number", features=["a", "b"], n_estimators=2, max_depth=2)
    first = model_leaves(spark, model)
    # Of 12048 rows, 12012 have a = 0; a leaf that a splits off has their share.
    shares = [dict(zip(feats, share)).get(0, 1.0) for _, feats, _, _, share in first]
    assert max(s for s in shares if s < 1) == pytest.approx(12012 / 12048, abs=0.01)
    curve = [r.loss for r in MO.round_curve(model, lopsided).orderBy("round").collect()]
    gap = MO.predict(model, lopsided).agg(F.avg((F.col("number") - F.col("prediction")) ** 2)).first()[0]
    assert curve[-1] == pytest.approx(gap)
    base = TR.train_boosted(few, "number", features=["a", "b"], n_estimators=1, max_depth=2)
    found = [[r.prediction for r in MO.predict(UP.update_boosted(base, df, 2), few).orderBy("a", "b").collect()] for df in repeated]
    assert found[0] == pytest.approx(found[1])


def test_folds_deal_the_rows_of_a_group(repeated):
    found = tune(repeated[1], "kind", plugin="xgboost", features=["a", "b"], cv=3, settings=[{"n_estimators": 1, "max_depth": 2}])
    assert [r.held_out for r in found.folds.collect()] == [16000] * 3
    assert found.best_value == pytest.approx(1.0)


def test_equal_rows_are_explained_scored_and_mapped_once(spark, repeated, monkeypatch):
    import tabforge.plans.importance as IM
    from pyspark.ml.regression import LinearRegression

    few, many = repeated
    model = TR.train_random_forest(few, "kind", features=["a", "b"], n_estimators=3, max_depth=4)
    assert [r.score for r in shap_importance(model, many).orderBy("feature").collect()] == pytest.approx(
        [r.score for r in shap_importance(model, few).orderBy("feature").collect()])
    scored, add = [], IM.add_scores
    monkeypatch.setattr(IM, "add_scores", lambda model, rows: scored.append(rows.count()) or add(model, rows))
    IM.permutation_importance(model, many)
    assert scored[0] <= 16 + 2 * 32
    seen, fit = [], LinearRegression._fit
    monkeypatch.setattr(LinearRegression, "_fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    nets = [TR.train_mlp(df, "number", features=["a", "b"], task="regression") for df in repeated]
    assert seen == [16, 16]
    out = [[r.prediction for r in MO.predict(net, few).orderBy("a", "b").collect()] for net in nets]
    assert out[0] == pytest.approx(out[1], abs=0.05)


def test_terms_of_texts_are_kept_for_all_passes(spark, monkeypatch):
    from pyspark.ml.feature import IDF

    seen, fit = [], IDF._fit
    monkeypatch.setattr(IDF, "_fit", lambda self, rows: seen.append((rows.storageLevel.useMemory, rows.columns)) or fit(self, rows))
    docs = spark.range(40).selectExpr("if(id % 2 = 0, 'good fine film', 'bad dull film') AS review", "id % 2 AS y")
    model = TR.train_text(docs, "y", text="review", epochs=5)
    assert seen == [(True, ["__tf", "__label"])]
    assert values(MO.evaluate_model(model, docs))["accuracy"] == 1.0


@pytest.mark.parametrize("label", ["kind", "number", "band"])
def test_equal_rows_are_scored_once_in_evaluation(repeated, monkeypatch, label):
    from tabforge.operators.metrics import evaluate

    few, many = [df.withColumn("band", F.when(F.col("a") > 2, "old").when(F.col("b") > 2, "mid").otherwise("young")) for df in repeated]
    model = TR.train_boosted(few.where("b <> 1"), label, features=["a", "b"], n_estimators=2, max_depth=1)
    lopsided = few.unionByName(many.where("a = 0")).unionByName(few.withColumn(label, F.lit(None).cast(few.schema[label].dataType)))
    whole = values(evaluate(MO.predict(model, lopsided, output="__p"), label, "__p", model.task, pos_label=model.pos_label))
    scored, add = [], MO.add_scores
    monkeypatch.setattr(MO, "add_scores", lambda model, rows: scored.append(rows.where(F.col(label).isNotNull()).count()) or add(model, rows))
    found = values(MO.evaluate_model(model, lopsided))
    assert scored == [16] and found == pytest.approx(whole) and len(found) == 2


@pytest.mark.parametrize("train", [
    lambda df: TR.train_boosted(df, "kind", features=["a", "b"], n_estimators=2, max_depth=2),
    lambda df: TR.train_random_forest(df, "kind", n_estimators=2, max_depth=2, featureSubsetStrategy="all")])
def test_task_and_classes_are_found_from_counted_rows(repeated, monkeypatch, train):
    from pyspark.ml.classification import GBTClassifier

    seen, fitted, fit = [], [], GBTClassifier._fit
    for name in ("detect_task_type", "class_labels"):
        find = getattr(TR, name)
        monkeypatch.setattr(TR, name, lambda df, target, find=find: seen.append(df.count()) or find(df, target))
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, rows: fitted.append((rows.count(), rows.agg(F.sum("__rows")).first()[0])) or fit(self, rows))
    many = repeated[1].drop("number")
    model = train(many.unionByName(many.limit(5).withColumn("kind", F.lit(None).cast("int"))).select("a", "b", "kind"))
    assert seen[0] == seen[1] and 16 < seen[0] <= 21
    assert (model.task, model.labels, model.features) == ("binary_classification", [0, 1], ["a", "b"])
    assert fitted == ([(16, 48000)] if model.plugin == "xgboost" else [])
    assert values(MO.evaluate_model(model, many))["accuracy"] == 1.0
