"""Models of labels that are exact rules of their features: predictions must equal the rule, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.workspace import scratch_path
from tabforge.plans import models as MO
from tabforge.plans import training as TR
from tabforge.plans.importance import permutation_importance
from tabforge.plans.shap import shap_importance
from tabforge.plans.tuning import train_tuned, tune
from tabforge.plans.updating import update_forest, update_saved_model
from tabforge.registered.base import query, table
from tabforge.registered.models import embedding_images, labelled_vectors
from tabforge.registered.streams import drained, stream

KEY = ["l_orderkey", "l_linenumber"]
# Seven and nine values: fewer than a tree has bins, so every rule of them can be learned exactly.
FEATURES = ["l_linenumber", "l_tax"]
RULES = {
    "multi": "CASE WHEN l_linenumber > 4 AND l_tax >= 0.05 THEN 'high' WHEN l_linenumber <= 2 THEN 'low' ELSE 'mid' END",
    "binary": "CASE WHEN l_linenumber > 4 AND l_tax >= 0.05 THEN 1 ELSE 0 END",
    "number": "CAST(10 * l_linenumber + CASE WHEN l_tax >= 0.05 THEN 5 ELSE 0 END AS DOUBLE)",
    # One line number in seven is unknown; what is unknown counts as high.
    "gaps": "CASE WHEN l_orderkey % 7 = 0 OR l_linenumber > 4 THEN 1 ELSE 0 END",
}
FOREST = {"n_estimators": 5, "max_depth": 6, "featureSubsetStrategy": "all"}


def ruled(spark, sf_dir, kind: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*KEY, "l_tax", F.expr(RULES[kind]).alias("outcome"))


def expected(kind: str, where: str = "l_orderkey % 5 = 0") -> str:
    rule = RULES[kind]
    return f"SELECT l_orderkey, l_linenumber, {rule} AS outcome, {rule} AS prediction FROM lineitem WHERE {where}"


def learned(kind: str, spark, sf_dir, train) -> tuple[MO.TrainedModel, DataFrame, DataFrame]:
    rows = ruled(spark, sf_dir, kind)
    held = F.col("l_orderkey") % 5 == 0
    return train(rows.where(~held)), rows.where(~held), rows.where(held)


def scored(model: MO.TrainedModel, rows: DataFrame) -> DataFrame:
    out = MO.predict(model, rows)
    value = F.round("prediction", 6) if model.labels is None else F.col("prediction")
    return out.select(*KEY, "outcome", value.alias("prediction"))


def forest(rows: DataFrame) -> MO.TrainedModel:
    return TR.train_random_forest(rows, "outcome", features=FEATURES, **FOREST)


@query("train_rf_classify_rule", expected("multi"))
def rf_classify(spark, sf_dir):
    model, _, test = learned("multi", spark, sf_dir, forest)
    return scored(model, test)


@query("train_rf_regress_rule", expected("number"))
def rf_regress(spark, sf_dir):
    model, _, test = learned("number", spark, sf_dir, forest)
    return scored(model, test)


@query("train_gbt_classify_rule", expected("binary"))
def gbt_classify(spark, sf_dir):
    model, _, test = learned("binary", spark, sf_dir, lambda rows: TR.train_boosted(
        rows, "outcome", features=FEATURES, n_estimators=3, max_depth=4))
    return scored(model, test)


@query("train_gbt_multiclass_rule", expected("multi"))
def gbt_multiclass(spark, sf_dir):
    model, _, test = learned("multi", spark, sf_dir, lambda rows: TR.train_boosted(
        rows, "outcome", preset="lightgbm", features=FEATURES, n_estimators=3, max_depth=4))
    return scored(model, test)


@query("train_gbt_regress_rule", expected("number"))
def gbt_regress(spark, sf_dir):
    model, _, test = learned("number", spark, sf_dir, lambda rows: TR.train_boosted(
        rows, "outcome", features=FEATURES, n_estimators=3, max_depth=6))
    return scored(model, test)


@query("train_gbt_missing", expected("gaps"))
def gbt_missing(spark, sf_dir):
    """Gaps are learned: a flag and a fill for each feature, saved with the model and used in scoring."""
    known = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_linenumber"))
    model, _, test = learned("gaps", spark, sf_dir, lambda rows: TR.train_boosted(
        rows.withColumn("number", known), "outcome", features=["number", "l_tax"], n_estimators=3, max_depth=4, missing="flag"))
    path = MO.model_dir(scratch_path(spark, "project"), "run_001", model.plugin)
    MO.save_model(spark, model, path)
    return scored(MO.load_model(spark, path), test.withColumn("number", known))


@query("evaluate_model_rule", expected("multi"))
def evaluated(spark, sf_dir):
    """A saved model, loaded again."""
    model, _, test = learned("multi", spark, sf_dir, forest)
    path = MO.model_dir(scratch_path(spark, "project"), "run_001", model.plugin)
    MO.save_model(spark, model, path)
    return scored(MO.load_model(spark, path), test)


@query("predict_with_confidence_rule", f"""
    SELECT l_orderkey, l_linenumber, {RULES["multi"]} AS prediction, CAST(1 AS DOUBLE) AS confidence FROM lineitem
""")
def confident(spark, sf_dir):
    model, _, _ = learned("multi", spark, sf_dir, forest)
    return MO.predict_with_confidence(model, table(spark, sf_dir, "lineitem"), keep=KEY).select(*KEY, "prediction", "confidence")


@query("update_forest_rule", f"SELECT *, 8 AS trees FROM ({expected('multi', 'l_orderkey % 5 <> 0')})")
def updated(spark, sf_dir):
    model, train, test = learned("multi", spark, sf_dir, forest)
    newer = update_forest(model, test, n_estimators_new=3)
    return scored(newer, train).withColumn("trees", F.lit(newer.n_trees))


@query("stream_score_rule", f"SELECT l_orderkey, l_linenumber, {RULES['multi']} AS prediction FROM lineitem")
def stream_scored(spark, sf_dir):
    model, _, _ = learned("multi", spark, sf_dir, forest)
    scores = MO.predict_with_confidence(model, stream(spark, sf_dir, "lineitem"), keep=KEY)
    return drained(spark, scored_columns(scores))


def scored_columns(scores: DataFrame) -> DataFrame:
    return scores.select(*KEY, "prediction")


def by_class(model: MO.TrainedModel, test: DataFrame, target: str, floor: float) -> DataFrame:
    """Held-out rows of each class, and whether the model as a whole clears the floor."""
    counts = MO.predict(model, test).groupBy(F.col(target).alias("label")).agg(
        F.count("*").alias("rows"), F.sum((F.col(target) == F.col("prediction")).cast("int")).alias("hits"))
    total = counts.agg((F.sum("hits") / F.sum("rows") >= floor).alias("passed"))
    return counts.select("label", "rows").withColumn("passed", total.scalar())


_QUADRANTS = """
    SELECT CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END AS label,
           count(*) AS rows, count(*) > 0 AS passed FROM embeddings WHERE vec_id % 5 = 0 GROUP BY 1
"""


@query("train_text_classes", "SELECT lang AS label, count(*) AS rows, count(*) > 0 AS passed FROM documents WHERE doc_id % 5 = 0 GROUP BY 1")
def text_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.col("doc_id") % 5 == 0
    return by_class(TR.train_text(docs.where(~held), "lang", text="text", epochs=20), docs.where(held), "lang", 0.9)


@query("train_mlp_classes", _QUADRANTS)
def mlp_classes(spark, sf_dir):
    rows, held = labelled_vectors(spark, sf_dir), F.col("vec_id") % 5 == 0
    model = TR.train_mlp(rows.where(~held), "quadrant", features=["embedding"], hidden=16, layers=1, epochs=60)
    return by_class(model, rows.where(held), "quadrant", 0.6)


@query("train_image_classes", _QUADRANTS)
def image_classes(spark, sf_dir):
    pixels = TR.image_pixels(embedding_images(spark, sf_dir), size=8, keep=("vec_id", "quadrant"))
    held = F.col("vec_id") % 5 == 0
    return by_class(TR.train_image(pixels.where(~held), "quadrant", hidden=16), pixels.where(held), "quadrant", 0.6)


# --- networks for numbers, curves and importances ------------------------------------

_PRODUCT = "(l_quantity - 25) * (l_discount - 0.05)"


@query("train_mlp_regress_rule", """
    SELECT count(*) AS rows, true AS beats_line FROM lineitem WHERE l_orderkey % 5 = 0
""")
def mlp_regress(spark, sf_dir):
    """An interaction of two columns, which a line cannot follow: held-out error below a third of the line's."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_quantity", "l_discount", f"{_PRODUCT} AS outcome")
    held = F.col("l_orderkey") % 5 == 0
    train, test = rows.where(~held), rows.where(held)
    model = TR.train_mlp(train, "outcome", features=["l_quantity", "l_discount"], task="regression")
    line = train.agg(*[f("outcome", c).alias(f"{f.__name__}_{c}") for f in (F.regr_slope, F.regr_intercept) for c in ("l_quantity", "l_discount")]).first()
    n = F.col(MO.ROWS)
    error = lambda p: F.sqrt(F.sum(n * (F.col("outcome") - p) * (F.col("outcome") - p)) / F.sum(n))
    lines = [error(line[f"regr_slope_{c}"] * F.col(c) + line[f"regr_intercept_{c}"]) for c in ("l_quantity", "l_discount")]
    # Equal rows are predicted once.
    return MO.predict(model, MO.grouped(test, ["l_quantity", "l_discount", "outcome"])).agg(
        F.sum(n).alias("rows"), (3 * error(F.col("prediction")) < F.least(*lines)).alias("beats_line"))


def falls(curve: DataFrame) -> DataFrame:
    before = F.lag("loss").over(Window.partitionBy("class").orderBy("round"))
    return curve.withColumn("falls", F.coalesce(F.col("loss") < before, F.lit(True))).select("round", "class", "falls")


@query("training_rounds_rule", """
    SELECT i::INTEGER AS round, NULL::VARCHAR AS class, true AS falls FROM range(1, 7) r(i) WHERE EXISTS (FROM lineitem)
""")
def rounds(spark, sf_dir):
    """Loss on held-out rows falls with each round."""
    model, _, test = learned("binary", spark, sf_dir, lambda rows: TR.train_boosted(
        rows, "outcome", features=FEATURES, n_estimators=6, max_depth=4))
    return falls(MO.round_curve(model, test))


@query("training_rounds_by_class_rule", """
    SELECT i::INTEGER AS round, c AS class, true AS falls FROM range(1, 4) r(i), (VALUES ('high'), ('low'), ('mid')) v(c) WHERE EXISTS (FROM lineitem)
""")
def rounds_by_class(spark, sf_dir):
    model, _, test = learned("multi", spark, sf_dir, lambda rows: TR.train_boosted(
        rows, "outcome", preset="lightgbm", features=FEATURES, n_estimators=3, max_depth=4))
    return falls(MO.round_curve(model, test))


@query("model_auc_rule", "SELECT 'auc' AS metric, CAST(1 AS DOUBLE) AS value WHERE EXISTS (FROM lineitem)")
def model_auc(spark, sf_dir):
    """A model that has learned the rule ranks every positive row above every negative one."""
    model, _, test = learned("binary", spark, sf_dir, lambda rows: TR.train_boosted(
        rows, "outcome", features=FEATURES, n_estimators=3, max_depth=4))
    return MO.model_auc(model, test)


# The rule needs the line number most and the tax less; nothing else decides.
_ORDER = """SELECT * FROM (VALUES (1, 'l_linenumber'), (2, 'l_tax'), (3, 'l_quantity')) v(place, feature) WHERE EXISTS (FROM lineitem)"""


def ordered(importance: DataFrame) -> DataFrame:
    return importance.select(F.row_number().over(Window.orderBy(F.col("score").desc(), "feature")).alias("place"), "feature")


def weighed(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*KEY, "l_tax", "l_quantity", F.expr(RULES["multi"]).alias("outcome"))
    held = F.col("l_orderkey") % 5 == 0
    model = TR.train_random_forest(rows.where(~held), "outcome", features=[*FEATURES, "l_quantity"], **FOREST)
    return model, rows.where(held)


@query("feature_importance_rule", _ORDER)
def importance_order(spark, sf_dir):
    model, _ = weighed(spark, sf_dir)
    return ordered(MO.importance_frame(spark, MO.feature_importance(model)))


@query("permutation_importance_rule", _ORDER)
def permutation_order(spark, sf_dir):
    model, test = weighed(spark, sf_dir)
    return ordered(permutation_importance(model, test))


@query("shap_importance_rule", _ORDER)
def shap_order(spark, sf_dir):
    model, test = weighed(spark, sf_dir)
    return ordered(shap_importance(model, test))


# --- search, updates of saved models and records --------------------------------------

@query("tune_model_rule", """
    SELECT t::INTEGER AS trial, f.fold, f.held_out, t = 2 AS perfect, t = 2 AS is_best FROM range(3) r(t),
           (SELECT CAST(l_orderkey % 3 AS VARCHAR) AS fold, count(*) AS held_out FROM lineitem GROUP BY 1) f
""")
def tuned(spark, sf_dir):
    """One row for each setting and fold: only the deepest trees can hold the rule, so that setting is perfect and best."""
    rows = ruled(spark, sf_dir, "multi").withColumn("part", F.col("l_orderkey") % 3)
    found = tune(rows, "outcome", plugin="lightgbm", features=FEATURES, fold_col="part", settings=[
        {"n_estimators": n, "learning_rate": 0.1, "max_depth": d} for n, d in ((1, 1), (2, 1), (2, 4))])
    return found.folds.join(found.trials, "trial").select("trial", "fold", "held_out", (F.col("value") > 1 - 1e-9).alias("perfect"), "is_best")


@query("train_tuned_rule", expected("binary"))
def best_of_search(spark, sf_dir):
    """The model of the best setting, with folds dealt by value."""
    def search(rows: DataFrame) -> MO.TrainedModel:
        found = tune(rows, "outcome", plugin="random_forest", features=FEATURES, cv=2, settings=[
            {"n_estimators": 3, "max_depth": d, "min_instances": 1} for d in (1, 6)])
        return train_tuned(rows, found, "outcome", features=FEATURES, featureSubsetStrategy="all")

    model, _, test = learned("binary", spark, sf_dir, search)
    return scored(model, test)


@query("update_saved_model_rule", f"""
    SELECT *, 8 AS trees, 'random_forest' AS plugin_name, 'run_001' AS source_run FROM ({expected('multi', 'l_orderkey % 5 <> 0')})
""")
def updated_saved(spark, sf_dir):
    """A saved model is updated under a new run; the new one is loaded by the path of its receipt."""
    model, train, test = learned("multi", spark, sf_dir, forest)
    project = scratch_path(spark, "project")
    MO.save_model(spark, model, MO.model_dir(project, "run_001", model.plugin))
    receipt = update_saved_model(spark, project, model.plugin, "run_001", "run_002", test, n_estimators=3).first()
    newer = MO.load_model(spark, receipt.updated_artifact_path)
    return scored(newer, train).select("*", F.lit(newer.n_trees).alias("trees"), F.lit(receipt.plugin_name).alias("plugin_name"),
                                       F.lit(receipt.source_run).alias("source_run"))


_RUN = "concat('run_', o_custkey % 1000)"
_PLUGIN = ("CASE left(o_orderpriority, 1) WHEN '1' THEN 'random_forest' WHEN '2' THEN 'xgboost' WHEN '3' THEN 'lightgbm' "
           "WHEN '4' THEN 'lstm_tabular' ELSE 'own' END")
_RUN_SCORES = f"""
    SELECT {_RUN} AS run_name, {_PLUGIN} AS plugin_name, 'f1' AS metric, CAST(max(o_totalprice) AS DOUBLE) AS value FROM orders GROUP BY 1, 2
    UNION ALL SELECT {_RUN}, {_PLUGIN}, 'rmse', CAST(min(o_totalprice) AS DOUBLE) FROM orders GROUP BY 1, 2
"""


@query("publish_best", f"""
    WITH m AS (SELECT *, CAST(substr(run_name, 5) AS INTEGER) % 2 = 0 AS again FROM ({_RUN_SCORES})),
    r AS (SELECT run_name, plugin_name, row_number() OVER (PARTITION BY run_name ORDER BY CASE metric WHEN 'f1' THEN -value ELSE value END, plugin_name) AS k
          FROM m WHERE metric = CASE WHEN again THEN 'rmse' ELSE 'f1' END)
    SELECT run_name, 'spark' AS format, plugin_name AS plugin, concat('/runs/', run_name, '/artifacts/', CASE plugin_name
           WHEN 'random_forest' THEN 'rf' WHEN 'xgboost' THEN 'xgb' WHEN 'lightgbm' THEN 'lgbm' WHEN 'lstm_tabular' THEN 'lstm' ELSE plugin_name END,
           '_model') AS path FROM r WHERE k = 1
""")
def publish(spark, sf_dir):
    """A thousand runs are published by F1, then every second one anew by error; the others keep their records."""
    metrics = table(spark, sf_dir, "orders").groupBy(F.expr(_RUN).alias("run_name"), F.expr(_PLUGIN).alias("plugin_name")).agg(
        F.max("o_totalprice").cast("double").alias("f1"), F.min("o_totalprice").cast("double").alias("rmse")).unpivot(
        ["run_name", "plugin_name"], ["f1", "rmse"], "metric", "value")
    models, project = metrics.select("run_name", "plugin_name").distinct(), scratch_path(spark, "project")
    MO.publish_best(spark, project, metrics, "f1", models)
    MO.publish_best(spark, project, metrics.where(F.substring("run_name", 5, 9).cast("int") % 2 == 0), "rmse", models)
    return MO.published(spark, project).withColumn("path", F.replace("path", F.lit(project), F.lit("")))
