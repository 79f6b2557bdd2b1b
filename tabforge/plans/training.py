"""Training of the tabular, text and image algorithms."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StandardScaler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tabforge.functions import text as X
from tabforge.functions.workspace import use_checkpoint_dir
from tabforge.operators.features import target_name
from tabforge.operators.profile import BINARY, MULTICLASS, REGRESSION, detect_task_type, find_text_column
from tabforge.plans.models import (
    FEATURES,
    LABEL,
    PIECES,
    ROWS,
    TrainedModel,
    array_widths,
    design,
    feature_columns,
    grouped,
    grouped_design,
    inputs,
    learn_gaps,
    model_names,
)
from tabforge.plans.randomfeatures import cosine_regression

# Preset settings of the two boosting algorithms.
BOOSTING_PRESETS = {
    "xgboost": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6},
    "lightgbm": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5},
}


def class_labels(df: DataFrame, target: str, max_classes: int | None = None) -> list:
    """Sorted distinct labels, which a model holds; ``max_classes`` refuses more of them."""
    rows = df.select(f"`{target}`").where(F.col(f"`{target}`").isNotNull()).distinct()
    if max_classes is not None:
        rows = rows.limit(max_classes + 1)
    labels = sorted(r[0] for r in rows.collect())
    if max_classes is not None and len(labels) > max_classes:
        raise ValueError(f"{target} has more than {max_classes} classes")
    if len(labels) < 2:
        raise ValueError(f"{target} needs at least two classes")
    return labels


def outline(df: DataFrame, plugin: str, target: str | None, features: Sequence[str] | None,
            task: str | None, params: dict, **more) -> TrainedModel:
    """The untrained model: task, classes and features settled, no members yet."""
    target = target_name(df, target)
    features = list(features) if features is not None else feature_columns(df, target)
    if not features:
        raise ValueError("no usable feature columns")
    task = task or detect_task_type(df, target)
    labels = None if task == REGRESSION else class_labels(df, target)
    return TrainedModel(plugin=plugin, task=task, target=target, features=features, members=[],
                        labels=labels, widths=array_widths(df, features), params=params, **more)


def counted(df: DataFrame, target: str | None, features: Sequence[str] | None) -> tuple[DataFrame, str, list[str]]:
    """What training looks at, equal rows counted, with the names of target and features.  Persisted: unpersist after use.

    The task, the classes and the training rows are then found from the counts, so the input is read once.
    """
    target = target_name(df, target)
    features = list(features) if features is not None else feature_columns(df, target)
    return grouped(df, [*features, target]).persist(StorageLevel.MEMORY_AND_DISK), target, features


def train_random_forest(df: DataFrame, target: str | None = None, *,
                        features: Sequence[str] | None = None, task: str | None = None,
                        n_estimators: int = 100, max_depth: int = 12, seed: int = 42,
                        missing: str = "error", **tree_params) -> TrainedModel:
    """Random forest; classification or regression by the label.

    ``missing`` says what null and NaN features mean: an error, 0 (``zero``), or a learned fill and a flag (``flag``).
    """
    params = {"n_estimators": n_estimators, "max_depth": max_depth, "seed": seed, **tree_params}
    counts, target, features = counted(df, target, features)
    try:
        model = outline(counts, "random_forest", target, features, task, params)
        learn_gaps(df, model, missing)
        model.combine = "votes" if model.is_classifier else "single"
        model.members.append(fit_forest(model, counts, n_estimators))
    finally:
        counts.unpersist()
    return model


def fit_forest(model: TrainedModel, df: DataFrame, n_estimators: int, seed: int | None = None):
    extra = {k: v for k, v in model.params.items()
             if k not in ("n_estimators", "max_depth", "seed", "n_estimators_new", "missing", "fill")}
    make = RandomForestClassifier if model.is_classifier else RandomForestRegressor
    forest = make(featuresCol=FEATURES, labelCol=LABEL, weightCol=ROWS, numTrees=n_estimators,
                  maxDepth=model.params["max_depth"],
                  seed=model.params["seed"] if seed is None else seed, **extra)
    # A group of rows is enough of them for a node if its pieces are.
    rows = grouped_design(df, model, pieces=max(PIECES, extra.get("minInstancesPerNode", 1)))
    try:
        return forest.fit(with_class_metadata(rows, model))
    finally:
        rows.unpersist()


def with_class_metadata(rows: DataFrame, model: TrainedModel) -> DataFrame:
    """Declare the number of classes, so a part without some class still fits."""
    if not model.is_classifier:
        return rows
    attr = {"ml_attr": {"type": "nominal", "name": LABEL, "vals": [str(v) for v in model.labels]}}
    return rows.withMetadata(LABEL, attr)


def train_boosted(df: DataFrame, target: str | None = None, *, preset: str = "xgboost",
                  features: Sequence[str] | None = None, task: str | None = None,
                  n_estimators: int | None = None, learning_rate: float | None = None,
                  max_depth: int | None = None, seed: int = 42, parallelism: int = 2,
                  missing: str = "error") -> TrainedModel:
    """Gradient-boosted trees: squared error, logistic, or one logistic model per class.

    ``missing`` as for forests.
    """
    base = BOOSTING_PRESETS[preset]
    params = {
        "n_estimators": n_estimators or base["n_estimators"],
        "learning_rate": learning_rate or base["learning_rate"],
        "max_depth": max_depth or base["max_depth"],
        "seed": seed,
    }
    counts, target, features = counted(df, target, features)
    try:
        model = outline(counts, preset, target, features, task, params)
        learn_gaps(df, model, missing)
        rows = grouped_design(counts, model)
    finally:
        counts.unpersist()
    settings = {"featuresCol": FEATURES, "labelCol": LABEL, "weightCol": ROWS, "maxIter": params["n_estimators"],
                "stepSize": params["learning_rate"], "maxDepth": params["max_depth"], "seed": seed}
    use_checkpoint_dir(df.sparkSession)

    def fit_class(i: int):
        one = rows.withColumn(LABEL, (F.col(LABEL) == i).cast("double"))
        return GBTClassifier(**settings).fit(one)

    try:
        if not model.is_classifier:
            model.members.append(GBTRegressor(**settings).fit(rows))
        elif len(model.labels) == 2:
            model.members.append(GBTClassifier(**settings).fit(rows))
        else:
            model.combine = "one_vs_rest"
            with ThreadPoolExecutor(parallelism) as pool:
                model.members.extend(pool.map(fit_class, range(len(model.labels))))
    finally:
        rows.unpersist()
    return model


#: Random units of a numeric network, at least.
COSINES = 256


def train_mlp(df: DataFrame, target: str | None = None, *, features: Sequence[str] | None = None,
              task: str | None = None, hidden: int = 64, layers: int = 2, epochs: int = 100,
              learning_rate: float = 0.03, seed: int = 42, spread: float = 1.0) -> TrainedModel:
    """Feed-forward network on one row per step; for numeric labels, ridge regression on random cosines.

    Integer labels are classes whatever their number.  The numeric model has one layer of ``hidden * layers`` random units or ``COSINES``,
    whichever is more, and learns only their weights, which takes one pass; ``epochs`` and ``learning_rate`` are of no use to it.
    """
    target = target_name(df, target)
    if task is None:
        task = detect_task_type(df, target, max_classes=None)
    params = {"hidden": hidden, "layers": layers, "epochs": epochs, "seed": seed}
    model = outline(df, "lstm_tabular", target, features, task, params)
    scaled = "__scaled"
    scaler = StandardScaler(inputCol=FEATURES, outputCol=scaled, withMean=True)
    if model.is_classifier:
        width = len(model_names(model))
        net = MultilayerPerceptronClassifier(
            featuresCol=scaled, labelCol=LABEL, seed=seed, maxIter=epochs, stepSize=learning_rate,
            layers=[width] + [hidden] * layers + [len(model.labels)])
        whole = Pipeline(stages=[scaler, net])
        # The network reads its rows in every step.
        rows = design(df, model).persist(StorageLevel.MEMORY_AND_DISK)
    else:
        # Cosines are made for different rows only; the scaler takes no weights, but its one pass is cheap.
        known = df.where(F.col(f"`{model.target}`").isNotNull())
        fitted = scaler.fit(known.select(inputs(known, model).alias(FEATURES)))
        whole = cosine_regression(FEATURES, LABEL, count=max(COSINES, hidden * layers), spread=spread, seed=seed,
                                  scaler=fitted, weight=ROWS)
        rows = grouped_design(df, model)
    try:
        model.members.append(whole.fit(rows))
    finally:
        rows.unpersist()
    return model


def train_text(df: DataFrame, target: str | None = None, *, text: str | None = None,
               n_features: int = 1 << 16, min_doc_freq: int = 2, epochs: int = 50,
               reg: float = 0.001) -> TrainedModel:
    """Text classifier: hashed term weights and logistic regression."""
    target = target_name(df, target)
    text = text or find_text_column(df.drop(target))
    if text is None:
        raise ValueError("no text column")
    labels = class_labels(df, target)
    model = TrainedModel(
        plugin="lora_text", task=BINARY if len(labels) == 2 else MULTICLASS, target=target,
        features=[text], members=[], labels=labels, kind="text",
        params={"n_features": n_features, "epochs": epochs, "reg": reg})
    terms = PipelineModel([
        RegexTokenizer(inputCol=FEATURES, outputCol="__tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=n_features)])
    weights = Pipeline(stages=[
        IDF(inputCol="__tf", outputCol="__tfidf", minDocFreq=min_doc_freq),
        LogisticRegression(featuresCol="__tfidf", labelCol=LABEL, maxIter=epochs, regParam=reg)])
    # Several passes read the terms; texts are split into words once.
    rows = terms.transform(design(df, model)).select("__tf", LABEL).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model.members.append(PipelineModel([*terms.stages, *weights.fit(rows).stages]))
    finally:
        rows.unpersist()
    return model


# --- images ---------------------------------------------------------------------

def image_pixels(images: DataFrame, size: int = 64, keep: Sequence[str] = ("label",)) -> DataFrame:
    """Pixels of Spark image rows, resized to a square and scaled to [-1, 1].

    ``images`` has the image source's ``image`` struct; rows it could not
    decode (negative size) are left out.
    """
    fields = [images.schema[c].simpleString() for c in keep]
    schema = ", ".join([f.replace(":", " ", 1) for f in fields] + ["pixels array<double>"])

    def load(batches: Iterable[pd.DataFrame]):
        for b in batches:
            px = [resize(np.frombuffer(d, np.uint8).reshape(h, w, n), size)
                  for d, h, w, n in zip(b["data"], b["height"], b["width"], b["channels"])]
            yield b[list(keep)].assign(pixels=[p.ravel() / 127.5 - 1 for p in px])

    rows = images.where(F.col("image.height") > 0).select(
        *keep, "image.data", "image.height", "image.width", F.col("image.nChannels").alias("channels"))
    return rows.mapInPandas(load, schema)


def resize(pixels: np.ndarray, size: int) -> np.ndarray:
    """Bilinear resize to size x size in three channels."""
    pixels = pixels[..., :3].astype(float) if pixels.shape[2] >= 3 else np.repeat(
        pixels[..., :1].astype(float), 3, axis=2)
    for axis in (0, 1):
        n = pixels.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, n - 1)
        part = (at - low).reshape([-1 if a == axis else 1 for a in range(3)])
        pixels = np.take(pixels, low, axis) * (1 - part) + np.take(pixels, high, axis) * part
    return pixels


def read_image_pixels(spark, image_dir: str, size: int = 64) -> DataFrame:
    """Pixels and folder label of the images in class folders."""
    images = spark.read.format("image").option("dropInvalid", True).option(
        "recursiveFileLookup", True).load(image_dir)
    labelled = images.withColumn("label", X.parent_name(F.col("image.origin")))
    return image_pixels(labelled, size)


def train_image(pixels: DataFrame, target: str = "label", *, hidden: int = 64,
                epochs: int = 60, seed: int = 42) -> TrainedModel:
    """Image classifier over resized pixels."""
    model = train_mlp(pixels, target, features=["pixels"], hidden=hidden, layers=1,
                      epochs=epochs, seed=seed)
    model.plugin = "cnn_image"
    return model
