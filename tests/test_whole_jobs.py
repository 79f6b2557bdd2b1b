"""Registered training does the whole work of its algorithm: all rounds of the preset, all of an update, all trials of a search."""

import json
from collections import Counter

import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tabforge.plans import tuning as TU
from tabforge.plans.training import BOOSTING_PRESETS

QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Folder with a line item table of 600 rows."""
    folder = f"file://{tmp_path_factory.mktemp('lines')}"
    spark.range(600).selectExpr(
        "int(id / 4) AS l_orderkey", "int(id % 4) AS l_linenumber", "id AS l_partkey", "double(id * 7 % 50 + 1) AS l_quantity",
        "(id * 3 % 11) / 100D AS l_discount", "(id * 5 % 9) / 100D AS l_tax").write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name, kind", [("train_gbt_classify", GBTClassifier), ("train_gbt_regress", GBTRegressor)])
def test_training_does_all_rounds_of_the_preset(spark, lines, monkeypatch, name, kind):
    seen, fit = [], kind._fit
    monkeypatch.setattr(kind, "_fit", lambda self, rows: seen.append((self.getMaxIter(), self.getStepSize(), self.getMaxDepth())) or fit(
        self.copy({self.maxIter: 2}), rows))
    assert QUERIES[name](spark, lines).count() == 2
    whole = BOOSTING_PRESETS["xgboost"]
    assert seen == [(whole["n_estimators"], whole["learning_rate"], whole["max_depth"])] == [(100, 0.1, 6)]


def test_an_update_adds_all_its_rounds_to_a_whole_model(spark, lines, monkeypatch):
    # Rounds are counted here; shallow trees will do for the first model.
    seen, fit = [], GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, rows: seen.append(self.getMaxDepth()) or fit(self.copy({self.maxDepth: 1}), rows))
    found = QUERIES["update_boosted"](spark, lines).collect()
    assert seen == [6] and {(r.rounds_before, r.rounds_after) for r in found} == {(100, 150)}


def test_a_search_grows_all_trees_of_all_trials(spark, lines, monkeypatch):
    seen, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, rows: seen.append(
        (self.getNumTrees(), self.getMaxDepth(), self.getMinInstancesPerNode())) or fit(self.copy({self.numTrees: 1, self.maxDepth: 1}), rows))
    trials = QUERIES["tune_model"](spark, lines).orderBy("trial").collect()
    whole = [(t["n_estimators"], t["max_depth"], t["min_instances"]) for t in TU.draw(TU.FOREST_SPACE, 20, 42)]
    assert [tuple(json.loads(t.params).values()) for t in trials] == whole
    grown = Counter()
    for trees, *rest in seen:
        grown[tuple(rest)] += trees
    wanted = Counter()
    for trees, *rest in whole:
        wanted[tuple(rest)] += 3 * trees
    assert grown == wanted and max(t[0] for t in whole) > 200 and max(t[1] for t in whole) == 15


@pytest.mark.parametrize("kind", [RandomForestClassifier, RandomForestRegressor])
def test_trees_of_a_large_forest_are_grown_some_at_a_time_and_all_vote(spark, monkeypatch, kind):
    classes = kind is RandomForestClassifier
    few = spark.range(200).selectExpr("double(id % 20) AS a", "double(id % 7) AS b", "int(id % 20 > 9 AND id % 7 < 5 OR id % 11 = 0) AS y")
    setting = {"n_estimators": 5, "max_depth": 3, "min_instances": 1}
    seen, fit = [], kind._fit
    monkeypatch.setattr(kind, "_fit", lambda self, rows: seen.append((self.getNumTrees(), self.getSeed(), fit(self, rows))) or seen[-1][2])
    few = few if classes else few.withColumn("y", F.col("y") + F.lit(0.5))
    tune = lambda: TU.tune(few, "y", plugin="random_forest", features=["a", "b"], cv=2, settings=[setting], parallelism=1)
    tune()
    assert [s[0] for s in seen] == [5, 5]
    seen.clear()
    monkeypatch.setattr(TU, "GROWN_NODES", 32)
    found, scored, voted = tune(), [], TU._voted
    monkeypatch.setattr(TU, "_voted", lambda *args: scored.append(voted(*args).select("__features", "prediction").collect()) or voted(*args))
    assert [s[0] for s in seen] == [2, 2, 1] * 2 and len({s[1] for s in seen}) == 3
    seen.clear()
    again = tune()
    assert again.best_value == found.best_value
    # By hand: each forest's votes, or its mean for each tree, added up.
    for k, held in enumerate(scored):
        rows = spark.createDataFrame([(i, r["__features"]) for i, r in enumerate(held)], ["i", "__features"])
        total = [None] * len(held)
        for trees, _, model in seen[3 * k:3 * k + 3]:
            out = vector_to_array("rawPrediction") if classes else F.array(F.col("prediction") * trees)
            for r in model.copy().transform(rows).select("i", out.alias("v")).collect():
                total[r.i] = r.v if total[r.i] is None else [x + y for x, y in zip(total[r.i], r.v)]
        assert [r.prediction for r in held] == pytest.approx([float(v.index(max(v))) if classes else v[0] / 5 for v in total])
