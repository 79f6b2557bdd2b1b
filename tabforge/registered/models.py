"""Training, scoring, updating and tuning on the given tables.

Labels follow known rules, so each result has a floor a working model clears.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.workspace import scratch_path, spread
from tabforge.plans import models as MO
from tabforge.plans import training as TR
from tabforge.plans.importance import permutation_importance
from tabforge.plans.shap import shap_importance
from tabforge.plans.tuning import tune
from tabforge.plans.updating import update_boosted, update_forest
from tabforge.registered.base import query, r6, spread_table, table

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
KEY = ["l_orderkey", "l_linenumber"]


def labelled_lines(spark, sf_dir, kind: str) -> DataFrame:
    """Line items with a label that is a rule of their numbers; one class label in 25 is wrong."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    rules = {
        "binary": F.when((q > 30) & (d >= 0.05), 1).otherwise(0),
        "multi": F.when((q > 30) & (d >= 0.05), "high").when(t > 0.04, "mid").otherwise("low"),
        "number": q * (1 - d) + 100 * t,
    }
    wrong = {"binary": F.lit(1), "multi": F.lit("mid")}
    outcome = rules[kind]
    if kind in wrong:
        noisy = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(25)) == 0
        outcome = F.when(noisy, wrong[kind]).otherwise(outcome)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *FEATURES, outcome.alias("outcome"))


def labelled_vectors(spark, sf_dir) -> DataFrame:
    """Embeddings labelled by the signs of their first two components."""
    sign = F.when(F.col("embedding")[0] > 0, 2).otherwise(0) + F.when(F.col("embedding")[1] > 0, 1).otherwise(0)
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", sign.alias("quadrant"))


def hold_out(df: DataFrame, key: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; all rows of a key fall on the same side."""
    test = F.pmod(F.xxhash64(key), F.lit(1000)) < int(share * 1000)
    return df.where(~test), df.where(test)


def report(model: MO.TrainedModel, test: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Test metrics with the bound each must clear (errors must stay below theirs)."""
    floor: Column = F.lit(None).cast("double")
    for metric, bound in floors.items():
        floor = F.when(F.col("metric") == metric, bound).otherwise(floor)
    return MO.evaluate_model(model, test).select(
        F.lit(model.plugin).alias("model"), "metric", r6("value").alias("value"), floor.alias("floor"))


@query("train_rf_classify")
def train_rf_classify(spark, sf_dir):
    train, test = hold_out(labelled_lines(spark, sf_dir, "multi"), "l_orderkey")
    model = TR.train_random_forest(train, "outcome", features=FEATURES, n_estimators=20, max_depth=8)
    return report(model, test, {"accuracy": 0.9, "f1": 0.9})


@query("train_rf_regress")
def train_rf_regress(spark, sf_dir):
    train, test = hold_out(labelled_lines(spark, sf_dir, "number"), "l_orderkey")
    model = TR.train_random_forest(train, "outcome", features=FEATURES, n_estimators=20, max_depth=8)
    return report(model, test, {"rmse": 3.0, "mae": 3.0})


@query("train_gbt_classify")
def train_gbt_classify(spark, sf_dir):
    """All rounds of the preset."""
    train, test = hold_out(labelled_lines(spark, sf_dir, "binary"), "l_orderkey")
    model = TR.train_boosted(train, "outcome", features=FEATURES)
    return report(model, test, {"accuracy": 0.9, "f1": 0.8})


@query("train_gbt_multiclass")
def train_gbt_multiclass(spark, sf_dir):
    train, test = hold_out(labelled_lines(spark, sf_dir, "multi"), "l_orderkey")
    model = TR.train_boosted(train, "outcome", preset="lightgbm", features=FEATURES, n_estimators=5, max_depth=4)
    return report(model, test, {"accuracy": 0.9, "f1": 0.9})


@query("train_gbt_regress")
def train_gbt_regress(spark, sf_dir):
    """All rounds of the preset."""
    train, test = hold_out(labelled_lines(spark, sf_dir, "number"), "l_orderkey")
    model = TR.train_boosted(train, "outcome", features=FEATURES)
    return report(model, test, {"rmse": 3.0, "mae": 3.0})


@query("train_mlp_classify")
def train_mlp_classify(spark, sf_dir):
    train, test = hold_out(labelled_vectors(spark, sf_dir), "vec_id")
    model = TR.train_mlp(train, "quadrant", features=["embedding"], hidden=16, layers=1, epochs=60)
    return report(model, test, {"accuracy": 0.6, "f1": 0.6})


@query("train_text_classify")
def train_text_classify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train, test = hold_out(docs, "doc_id")
    return report(TR.train_text(train, "lang", text="text", epochs=20), test, {"accuracy": 0.8, "f1": 0.8})


def embedding_images(spark, sf_dir) -> DataFrame:
    """Each vector as the rows of Spark's image source: grey, eight pixels wide."""
    level = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), (x * 254 + 127).cast("int"))))
    data = F.unhex(F.array_join(F.transform(level, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    image = F.struct(
        F.concat(F.lit("file:/images/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("origin"),
        (F.size("embedding") / 8).cast("int").alias("height"), F.lit(8).alias("width"),
        F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))
    return labelled_vectors(spark, sf_dir).select("vec_id", "quadrant", image.alias("image"))


@query("train_image_classify")
def train_image_classify(spark, sf_dir):
    pixels = TR.image_pixels(embedding_images(spark, sf_dir), size=8, keep=("vec_id", "quadrant"))
    train, test = hold_out(pixels, "vec_id")
    return report(TR.train_image(train, "quadrant", hidden=16), test, {"accuracy": 0.6, "f1": 0.6})


def line_model(spark, sf_dir) -> tuple[MO.TrainedModel, DataFrame, DataFrame]:
    train, test = hold_out(labelled_lines(spark, sf_dir, "multi"), "l_orderkey")
    return TR.train_random_forest(train, "outcome", features=FEATURES, n_estimators=10, max_depth=8), train, test


@query("evaluate_model")
def evaluate_model(spark, sf_dir):
    """A saved model, loaded again and evaluated on held-out rows."""
    model, _, test = line_model(spark, sf_dir)
    path = MO.model_dir(scratch_path(spark, "project"), "run_001", model.plugin)
    MO.save_model(spark, model, path)
    return report(MO.load_model(spark, path), test, {"accuracy": 0.9, "f1": 0.9})


@query("predict_with_confidence")
def predict_with_confidence(spark, sf_dir):
    model, _, _ = line_model(spark, sf_dir)
    return MO.predict_with_confidence(model, spread_table(spark, sf_dir, "lineitem"), keep=KEY)


@query("feature_importance")
def feature_importance(spark, sf_dir):
    model, _, _ = line_model(spark, sf_dir)
    return MO.importance_frame(spark, MO.feature_importance(model))


@query("permutation_importance")
def permuted(spark, sf_dir):
    model, _, _ = line_model(spark, sf_dir)
    return permutation_importance(model, labelled_lines(spark, sf_dir, "multi"), normalise=True)


@query("shap_importance")
def shap(spark, sf_dir):
    model, _, _ = line_model(spark, sf_dir)
    lines = spread(labelled_lines(spark, sf_dir, "multi"))
    return shap_importance(model, lines).withColumn("score", r6("score"))


@query("update_forest")
def updated_forest(spark, sf_dir):
    model, train, test = line_model(spark, sf_dir)
    newer = update_forest(model, test, n_estimators_new=5)
    return report(newer, train, {"accuracy": 0.9, "f1": 0.9}).select(
        "model", F.lit(model.n_trees).alias("trees_before"), F.lit(newer.n_trees).alias("trees_after"),
        "metric", "value")


@query("update_boosted")
def updated_boosted(spark, sf_dir):
    """All rounds of the preset, and then as many as an update adds."""
    train, test = hold_out(labelled_lines(spark, sf_dir, "binary"), "l_orderkey", 0.5)
    model = TR.train_boosted(train, "outcome", features=FEATURES)
    newer = update_boosted(model, test)
    return report(newer, train, {"accuracy": 0.9, "f1": 0.8}).select(
        "model", F.lit(model.n_trees).alias("rounds_before"), F.lit(newer.n_trees).alias("rounds_after"),
        "metric", "value")


@query("tune_model")
def tune_model(spark, sf_dir):
    """All trials of a search over the whole space of forests."""
    found = tune(labelled_lines(spark, sf_dir, "multi"), "outcome", plugin="random_forest", features=FEATURES)
    return found.trials.withColumn("fold_mean", r6("fold_mean"))
