"""Random hyper-parameter search with k-fold cross-validation."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.workspace import use_checkpoint_dir
from tabforge.operators.profile import MULTICLASS
from tabforge.plans.models import FEATURES, LABEL, PIECES, ROWS, SCORES, TrainedModel, add_scores, grouped_design
from tabforge.plans.training import outline, train_boosted, train_random_forest, with_class_metadata

FOREST_SPACE = {"n_estimators": (50, 300), "max_depth": (3, 15), "min_instances": (1, 10)}
BOOSTED_SPACE = {"n_estimators": (50, 300), "learning_rate": (0.01, 0.3), "max_depth": (3, 10)}
_SPARK_NAMES = {
    "random_forest": {"n_estimators": "numTrees", "max_depth": "maxDepth",
                      "min_instances": "minInstancesPerNode"},
    "boosted": {"n_estimators": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth"},
}

_FOLD = "__fold"
#: A fold column with more values than this is taken for a mistake.
MOST_FOLDS = 100
#: Nodes that the trees grown at a time have at most: the driver holds them all until the trees are whole and cut back.
GROWN_NODES = 1 << 19
#: MB of split statistics in a task.  Several fits run at a time, so it is less than Spark's own 256.
STATISTICS_MB = 64


@dataclass
class Tuning:
    plugin: str
    task: str
    metric: str
    trials: DataFrame
    folds: DataFrame
    best_params: dict
    best_value: float


def draw(space: dict, trials: int, seed: int) -> list[dict]:
    """Random settings; learning rates are drawn on a log scale."""
    rng = random.Random(seed)

    def one(name: str, low, high):
        if name == "learning_rate":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.randint(low, high)

    return [{k: one(k, *bounds) for k, bounds in space.items()} for _ in range(trials)]


def tune(df: DataFrame, target: str | None = None, *, plugin: str = "xgboost",
         features: Sequence[str] | None = None, n_trials: int = 20, cv: int = 3,
         space: dict | None = None, settings: Sequence[dict] | None = None, fold_col: str | None = None,
         seed: int = 42, parallelism: int = 4) -> Tuning:
    """Cross-validate random settings, or the given ones: highest F1, or lowest RMSE, wins; the first of equals.

    Rows are dealt to ``cv`` folds in turn by the order of their values, beginning anew for each value, so folds do not depend on the
    cluster and equal rows are spread; or ``fold_col`` says each row's fold and is no feature (null folds take no part).  Features are made once and shared
    by all fits.  ``trials`` has one row for each setting, ``folds`` one for each setting and fold with the rows held out.  Each
    setting is fitted once a fold and nothing else is: ``train_tuned`` makes the model of the best.  Large forests are grown some
    trees at a time, and all their trees vote.
    """
    forest = plugin == "random_forest"
    model = outline(df.drop(fold_col) if fold_col else df, plugin, target, features, None, {})
    settings = list(settings) if settings else draw(space or (FOREST_SPACE if forest else BOOSTED_SPACE), n_trials, seed)
    estimator, grid = _estimator_and_grid(model, settings, forest, seed)
    if model.is_classifier:
        name = "f1"
        evaluator = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="f1", weightCol=ROWS)
        if model.task != MULTICLASS:
            evaluator = evaluator.setMetricName("fMeasureByLabel").setMetricLabel(1.0)
    else:
        name = "rmse"
        evaluator = RegressionEvaluator(labelCol=LABEL, metricName="rmse", weightCol=ROWS)
    use_checkpoint_dir(df.sparkSession)
    pieces = max(PIECES, *[s.get("min_instances", 1) for s in settings]) if forest else 1
    rows = persisted = _dealt(df, model, cv, fold_col, pieces)
    try:
        counts = rows.groupBy(_FOLD).agg(F.round(F.sum(ROWS)).cast("long"))
        sizes = dict(counts.orderBy(_FOLD).limit(MOST_FOLDS + 1).collect())
        if not 2 <= len(sizes) <= MOST_FOLDS:
            raise ValueError(f"2 to {MOST_FOLDS} folds with rows are needed")
        rows = with_class_metadata(rows, model)

        def value(job: tuple[int, object]) -> float:
            trial, fold = job
            kept, held = rows.where(F.col(_FOLD) != fold), rows.where(F.col(_FOLD) == fold)
            # Copies leave the summaries behind: they hold the session, which no task takes once a write was observed.
            if forest:
                scored = _voted(model, [f.copy() for f in _forests(estimator, grid[trial], kept, sum(sizes.values()))], held)
            else:
                scored = estimator.fit(kept, grid[trial]).copy().transform(held)
            return float(evaluator.evaluate(scored))

        jobs = [(i, fold) for i in range(len(settings)) for fold in sizes]
        with ThreadPool(min(parallelism, len(jobs))) as pool:
            values = pool.map(inheritable_thread_target(df.sparkSession)(value), jobs, chunksize=1)
    finally:
        persisted.unpersist()
    means = [sum(values[i:i + len(sizes)]) / len(sizes) for i in range(0, len(values), len(sizes))]
    pick = max if model.is_classifier else min
    best = pick(range(len(means)), key=means.__getitem__)
    spark = df.sparkSession
    trials = spark.createDataFrame(
        [(i, json.dumps(s), m, i == best) for i, (s, m) in enumerate(zip(settings, means))],
        "trial int, params string, fold_mean double, is_best boolean")
    folds = spark.createDataFrame(
        [(trial, str(fold), sizes[fold], v) for (trial, fold), v in zip(jobs, values)],
        "trial int, fold string, held_out long, value double")
    return Tuning(plugin, model.task, name, trials, folds, settings[best], means[best])


def _dealt(df: DataFrame, model: TrainedModel, cv: int, fold_col: str | None, pieces: int) -> DataFrame:
    """Training rows with their fold.  Fits run side by side, and each partition of one has statistics of its own, so a few rows are one partition."""
    if fold_col:
        known = df.where(F.col(f"`{fold_col}`").isNotNull())
        return grouped_design(known, model, pieces=pieces, least=1, **{_FOLD: F.col(f"`{fold_col}`")})
    # The layout is sorted by value in a number of partitions that follows from the rows, so places in it are fixed.
    return grouped_design(df, model, pieces=pieces, cv=cv, fold=_FOLD, least=1)


def _estimator_and_grid(model: TrainedModel, settings: list[dict], forest: bool, seed: int):
    names = _SPARK_NAMES["random_forest" if forest else "boosted"]
    cols = {"featuresCol": FEATURES, "labelCol": LABEL, "weightCol": ROWS}
    if forest:
        est = (RandomForestClassifier if model.is_classifier else RandomForestRegressor)(
            **cols, seed=seed, maxMemoryInMB=STATISTICS_MB, cacheNodeIds=True)
    elif not model.is_classifier:
        est = GBTRegressor(**cols, seed=seed)
    elif len(model.labels) == 2:
        est = GBTClassifier(**cols, seed=seed)
    else:
        est = OneVsRest(**cols)
        grid = [{est.classifier: GBTClassifier(**cols, seed=seed, **{names[k]: v for k, v in s.items()})}
                for s in settings]
        return est, grid
    return est, [{est.getParam(names[k]): v for k, v in s.items()} for s in settings]


def _forests(estimator, setting: dict, rows: DataFrame, most: int):
    """All trees of a setting, in forests of as many as ``GROWN_NODES`` allows; ``most`` is a bound of the rows, each of which ends in a leaf."""
    own = {p.name: v for p, v in setting.items()}
    trees, depth = own.get("numTrees", estimator.getNumTrees()), own.get("maxDepth", estimator.getMaxDepth())
    together = max(1, GROWN_NODES // min(2 << depth, 2 * most))
    for i, first in enumerate(range(0, trees, together)):
        # Rows are drawn by seed and partition, so seeds are further apart than partitions.
        yield estimator.fit(rows, {**setting, estimator.numTrees: min(together, trees - first), estimator.seed: estimator.getSeed() + 1_000_003 * i})


def _voted(model: TrainedModel, forests: list, rows: DataFrame) -> DataFrame:
    """Rows with the prediction of all the trees."""
    scored = add_scores(replace(model, members=forests, combine="votes" if model.is_classifier else "single"), rows)
    found = F.array_position(SCORES, F.array_max(SCORES)) - 1 if model.is_classifier else F.col(SCORES)[0]
    return scored.withColumn("prediction", found.cast("double"))


def train_tuned(df: DataFrame, tuning: Tuning, target: str | None = None, **kwargs) -> TrainedModel:
    """Train on all rows with the best settings found."""
    best = dict(tuning.best_params)
    if tuning.plugin == "random_forest":
        best["minInstancesPerNode"] = best.pop("min_instances")
        return train_random_forest(df, target, **best, **kwargs)
    return train_boosted(df, target, preset=tuning.plugin, **best, **kwargs)
