"""Continuing a trained model on new rows; always a new model, never in place."""

from __future__ import annotations

from dataclasses import replace

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tabforge.functions.workspace import cut_lineage
from tabforge.plans.models import FEATURES, LABEL, ROWS, TrainedModel, grouped_design, load_model, model_dir, save_model
from tabforge.plans.training import BOOSTING_PRESETS, fit_forest

_MARGIN, _RESIDUAL, _STEP = "__margin", "__residual", "__step"


def _check_features(model: TrainedModel, df: DataFrame) -> None:
    missing = [c for c in [*model.features, model.target] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def update_forest(model: TrainedModel, df: DataFrame, n_estimators_new: int = 50) -> TrainedModel:
    """Add trees grown on the new rows; old and new trees vote together."""
    _check_features(model, df)
    seed = model.params["seed"] + len(model.members)
    added = fit_forest(model, df, n_estimators_new, seed)
    return replace(model, members=[*model.members, added],
                   params={**model.params, "n_estimators_new": n_estimators_new})


def update_boosted(model: TrainedModel, df: DataFrame, n_estimators: int = 50,
                   learning_rate: float | None = None, checkpoint_every: int = 10) -> TrainedModel:
    """Boosting rounds on the new rows, starting from the old model's margins."""
    _check_features(model, df)
    rate = learning_rate or model.params["learning_rate"]
    rows = grouped_design(df, model)
    try:
        if model.combine == "one_vs_rest":
            members = [
                _boost(m, rows.withColumn(LABEL, (F.col(LABEL) == i).cast("double")), model,
                       n_estimators, rate, checkpoint_every)
                for i, m in enumerate(model.members)
            ]
        else:
            members = [_boost(model.members[0], rows, model, n_estimators, rate, checkpoint_every)]
    finally:
        rows.unpersist()
    return replace(model, members=members, params={**model.params, "learning_rate": rate})


def update_saved_model(spark: SparkSession, project: str, plugin: str, source_run: str, new_run: str,
                       df: DataFrame, *, n_estimators: int = 50,
                       learning_rate: float | None = None) -> DataFrame:
    """Continue a saved model on new rows and save the result under a new run.

    The source run's model stays as it is.  Returns the receipt.
    """
    model = load_model(spark, model_dir(project, source_run, plugin))
    if plugin == "random_forest":
        newer = update_forest(model, df, n_estimators)
    elif plugin in BOOSTING_PRESETS:
        newer = update_boosted(model, df, n_estimators, learning_rate)
    else:
        raise ValueError(f"{plugin} models cannot be updated")
    path = save_model(spark, newer, model_dir(project, new_run, plugin))
    return spark.createDataFrame([(plugin, source_run, path)],
                                 "plugin_name string, source_run string, updated_artifact_path string")


def _boost(base, rows: DataFrame, model: TrainedModel, rounds: int, rate: float, every: int):
    """Fit trees to the loss gradient at the current margin, one per round.

    Each round extends the margin column by one tree; a reliable checkpoint
    cuts the growing lineage every few rounds.
    """
    classify = model.is_classifier
    if classify:
        scored = base.transform(rows, {base.rawPredictionCol: _STEP, base.probabilityCol: "",
                                       base.predictionCol: ""})
        start = vector_to_array(F.col(_STEP))[1]
    else:
        scored = base.transform(rows, {base.predictionCol: _STEP})
        start = F.col(_STEP)
    state = scored.select(FEATURES, LABEL, ROWS, start.alias(_MARGIN)).persist(StorageLevel.MEMORY_AND_DISK)
    trees = []
    for i in range(rounds):
        learner = DecisionTreeRegressor(featuresCol=FEATURES, labelCol=_RESIDUAL, weightCol=ROWS,
                                        maxDepth=model.params["max_depth"],
                                        seed=model.params["seed"] + i + 1)
        tree = learner.fit(state.select(FEATURES, ROWS, _gradient(classify).alias(_RESIDUAL)))
        trees.append(tree)
        if i + 1 == rounds:
            break
        moved = tree.transform(state, {tree.predictionCol: _STEP}).select(
            FEATURES, LABEL, ROWS, (F.col(_MARGIN) + rate * F.col(_STEP)).alias(_MARGIN))
        moved = cut_lineage(moved) if (i + 1) % every == 0 else moved.persist(StorageLevel.MEMORY_AND_DISK)
        moved.count()
        state.unpersist()
        state = moved
    state.unpersist()
    return _extended(base, trees, rate)


def _gradient(classify: bool) -> Column:
    """Negative gradient: logistic loss on labels -1 and 1, or squared error."""
    if not classify:
        return F.col(LABEL) - F.col(_MARGIN)
    y = 2 * F.col(LABEL) - 1
    return 4 * y / (1 + F.exp(2 * y * F.col(_MARGIN)))


def _extended(base, trees: list, rate: float):
    """Boosted model with the old trees and weights followed by the new ones."""
    sc = SparkContext.getOrCreate()
    old = list(base._java_obj.trees())
    weights = list(base.treeWeights) + [rate] * len(trees)
    jtree = sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    jtrees = sc._gateway.new_array(jtree, len(weights))
    for i, t in enumerate(old + [t._java_obj for t in trees]):
        jtrees[i] = t
    jweights = sc._gateway.new_array(sc._jvm.double, len(weights))
    for i, w in enumerate(weights):
        jweights[i] = float(w)
    if isinstance(base, GBTClassificationModel):
        make, wrap = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel, GBTClassificationModel
    else:
        make, wrap = sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel, GBTRegressionModel
    out = wrap(make(f"{base.uid}_u{len(weights)}", jtrees, jweights))
    return out.setFeaturesCol(FEATURES)
