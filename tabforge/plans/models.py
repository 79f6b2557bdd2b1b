"""Trained models: what they hold, scoring, evaluation and storage."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from importlib import import_module

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from tabforge.functions import workspace
from tabforge.functions.types import is_numeric
from tabforge.operators.metrics import evaluate, ranked_auc
from tabforge.operators.profile import REGRESSION
from tabforge.operators.runs import MODEL_FOLDERS, best_model, model_catalog

# Internal columns, prefixed so they never meet a user's column.
FEATURES, LABEL, SCORES, ROWS = "__features", "__label", "__scores", "__rows"
#: Parts of which a bootstrap draws the rows of a group of equal rows, at least; smaller groups are drawn row by row.
PIECES = 32


@dataclass
class TrainedModel:
    """Fitted Spark ML models with what is needed to score any table.

    ``combine`` says how the members' outputs become one: ``single``, ``votes``
    (forests whose tree votes are added) or ``one_vs_rest`` (one per class).
    """

    plugin: str
    task: str
    target: str
    features: list[str]
    members: list
    combine: str = "single"
    labels: list | None = None
    widths: dict[str, int] = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    kind: str = "vector"

    @property
    def is_classifier(self) -> bool:
        return self.task != REGRESSION

    @property
    def pos_label(self):
        """Class that counts as positive: 1 when it occurs, else the largest."""
        if not self.labels:
            return None
        return 1 if 1 in self.labels else self.labels[-1]

    @property
    def n_trees(self) -> int:
        return sum(getattr(m, "getNumTrees", 0) for m in self.members)


# --- feature and label columns ------------------------------------------------

def feature_columns(df: DataFrame, target: str | None, exclude: Sequence[str] = ()) -> list[str]:
    """Columns a model can use: numbers, booleans, and arrays of numbers."""
    out = []
    for f in df.schema.fields:
        usable = is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType) or (
            isinstance(f.dataType, T.ArrayType) and is_numeric(f.dataType.elementType))
        if usable and f.name != target and f.name not in exclude:
            out.append(f.name)
    return out


def array_widths(df: DataFrame, features: Sequence[str]) -> dict[str, int]:
    """Length of each array feature: that of all its arrays, null ones aside, by one aggregate.  Other lengths are an error."""
    arrays = [c for c in features if isinstance(df.schema[c].dataType, T.ArrayType)]
    if not arrays:
        return {}
    size = lambda c: F.array_size(F.col(f"`{c}`"))
    found = df.agg(F.count("*").alias("rows"), *[F.struct(F.min(size(c)), F.max(size(c))).alias(c) for c in arrays]).first()
    if not found["rows"]:
        raise ValueError("no rows to train on")
    for c in arrays:
        least, most = found[c]
        if least is None:
            raise ValueError(f"feature {c} is null in all rows")
        if least != most:
            raise ValueError(f"feature {c} has arrays of {least} to {most} values")
    return {c: found[c][0] for c in arrays}


def feature_names(features: Sequence[str], widths: dict[str, int], flagged: bool = False) -> list[str]:
    out = []
    for c in features:
        out += [f"{c}[{i}]" for i in range(widths[c])] if c in widths else [c]
    return out + [f"{c} is missing" for c in features] if flagged else out


def model_names(model: TrainedModel) -> list[str]:
    """Names of the values in the model's feature vector."""
    return feature_names(model.features, model.widths, model.params.get("missing") == "flag")


def model_array(df: DataFrame, model: TrainedModel, invalid: str = "error") -> Column:
    """The feature vector as the model was trained on it.  What it learned about gaps comes before ``invalid``."""
    learned = model.params.get("missing", "error")
    return feature_array(df, model.features, model.widths, invalid if learned == "error" else learned,
                         model.params.get("fill"))


def learn_gaps(df: DataFrame, model: TrainedModel, missing: str) -> None:
    """Keep the policy with the model; ``flag`` also learns the mean of each plain feature as its fill."""
    if missing not in ("error", "zero", "flag"):
        raise ValueError(f"unknown policy {missing!r}")
    if missing == "error":
        return
    model.params["missing"] = missing
    plain = [c for c in model.features if c not in model.widths]
    if missing == "flag" and plain:
        value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
        means = df.agg(*[F.avg(value(c)).alias(c) for c in plain]).first()
        model.params["fill"] = {c: 0.0 if means[c] is None else means[c] for c in plain}


def feature_array(df: DataFrame, features: Sequence[str], widths: dict[str, int],
                  invalid: str = "error", fill: dict[str, float] | None = None) -> Column:
    """All features of a row as one array of doubles.

    ``invalid`` handles null and NaN: ``error`` stops the job, ``zero`` uses 0, ``flag`` uses ``fill`` (0 in arrays) and
    adds a flag for each feature; that of an array says that it, or a value in it, is missing.  A null array is one
    whose values are all missing; another length is an error.  Pure column expressions, so it works on streams too.
    """
    if invalid not in ("error", "zero", "flag"):
        raise ValueError(f"unknown policy {invalid!r}")

    def clean(value: Column, name: str) -> Column:
        value = value.cast("double")
        other = F.raise_error(F.lit(f"feature {name} is null or NaN")).cast("double") if invalid == "error" else F.lit(
            float((fill or {}).get(name, 0.0)))
        return F.when(value.isNotNull() & ~F.isnan(value), value).otherwise(other)

    def cleaner(name: str):
        return lambda value: clean(value, name)

    parts, plain = [], []
    for c in features:
        if c in widths:
            if plain:
                parts.append(F.array(*plain))
                plain = []
            gaps = F.array_repeat(F.lit(None).cast("double"), widths[c])
            values = F.transform(F.coalesce(F.col(f"`{c}`").cast("array<double>"), gaps), cleaner(c))
            sized = F.when(F.size(values) == widths[c], values).otherwise(
                F.raise_error(F.lit(f"feature {c} must have {widths[c]} values")).cast("array<double>"))
            parts.append(sized)
        elif c in df.columns:
            plain.append(clean(F.col(f"`{c}`"), c))
        else:
            plain.append(F.lit(0.0))
    if invalid == "flag":
        present = lambda value: value.isNotNull() & ~F.isnan(value.cast("double"))
        whole = lambda c: F.forall(F.col(f"`{c}`"), present) if c in widths else present(F.col(f"`{c}`"))
        plain += [F.when(whole(c), 0.0).otherwise(1.0) if c in df.columns else F.lit(1.0) for c in features]
    if plain:
        parts.append(F.array(*plain))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def label_number(target: str, labels: list | None) -> Column:
    """Class position of the label, or its value for regression."""
    c = F.col(f"`{target}`")
    if labels is None:
        return c.cast("double")
    position = F.array_position(F.array(*[F.lit(v) for v in labels]), c)
    return F.when(position > 0, (position - 1).cast("double")).otherwise(
        F.raise_error(F.concat(F.lit("unknown label "), c.cast("string"))).cast("double"))


def design(df: DataFrame, model: TrainedModel, **more: Column) -> DataFrame:
    """Training rows: feature vector and numeric label, and what else is asked for, only."""
    rows = df.where(F.col(f"`{model.target}`").isNotNull())
    plain = _text_input(model) if model.kind == "text" else model_array(df, model)
    rows = workspace.steady_layout(rows.select(plain.alias(FEATURES), label_number(model.target, model.labels).alias(LABEL),
                                               *[c.alias(name) for name, c in more.items()]))
    return rows if model.kind == "text" else rows.withColumn(FEATURES, array_to_vector(FEATURES))


def grouped(df: DataFrame, columns: Sequence[str], **more: Column) -> DataFrame:
    """Distinct values of the columns that are there, with the number of their rows as ``ROWS``.  Counted rows stay as they are."""
    keys = [c for c in dict.fromkeys(columns) if c in df.columns]
    rows = df.select(*[F.col(f"`{c}`") for c in keys], *[c.alias(name) for name, c in more.items()], *[c for c in (ROWS,) if c in df.columns])
    if ROWS in rows.columns:
        return rows
    return rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count("*").alias(ROWS))


def grouped_design(df: DataFrame, model: TrainedModel, *, pieces: int = 1, cv: int = 0, fold: str | None = None,
                   least: int = workspace.LAYOUT_LEAST, **more: Column) -> DataFrame:
    """Training rows as ``design`` gives them, equal ones as one row that counts ``ROWS`` times.  Persisted: unpersist after use.

    Trees of weighted rows are those of the rows.  A bootstrap draws rows, so it gets up to ``pieces`` rows of equal weight for each
    group.  ``cv`` deals the rows of each group to so many values of ``fold`` in turn, beginning anew for each group.  ``least`` is
    the fewest partitions.
    """
    labelled = df.where(F.col(f"`{model.target}`").isNotNull())
    rows = grouped(labelled, [*model.features, model.target], **more)
    rows = rows.select(model_array(rows, model).alias(FEATURES), label_number(model.target, model.labels).alias(LABEL), *more, ROWS)
    if ROWS not in df.columns:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size = rows.agg(F.sum(F.least(ROWS, F.lit(pieces * max(1, cv))))).first()[0] or 0
        laid = workspace.laid_out(rows, size, least)
        if cv:
            turns = F.transform(F.sequence(F.lit(0), F.lit(cv - 1)), lambda i: F.struct(
                F.pmod(F.col("__at") + i, F.lit(cv)).cast("int").alias(fold),
                (F.floor(F.col(ROWS) / cv) + (i < F.col(ROWS) % cv).cast("long")).alias(ROWS)))
            laid = laid.withColumn("__at", F.monotonically_increasing_id()).select(
                FEATURES, LABEL, *more, F.inline(turns)).where(F.col(ROWS) > 0)
        if pieces > 1:
            parts = F.least(ROWS, F.lit(pieces)).cast("int")
            laid = laid.withColumn(ROWS, F.explode(F.array_repeat(F.col(ROWS) / parts, parts)))
        laid = laid.withColumns({FEATURES: array_to_vector(FEATURES), ROWS: F.col(ROWS).cast("double")}).persist(
            StorageLevel.MEMORY_AND_DISK)
        laid.count()
    finally:
        rows.unpersist()
    return laid


def _text_input(model: TrainedModel) -> Column:
    return F.coalesce(F.col(f"`{model.features[0]}`").cast("string"), F.lit(""))


def inputs(df: DataFrame, model: TrainedModel, invalid: str = "error") -> Column:
    if model.kind == "text":
        return _text_input(model)
    return array_to_vector(model_array(df, model, invalid))


# --- scoring -----------------------------------------------------------------------

def predict(model: TrainedModel, df: DataFrame, *, output: str = "prediction",
            confidence: str | None = None, invalid: str = "error") -> DataFrame:
    """Add the predicted label, and optionally the winning class's probability."""
    missing = [f for f in model.features if f not in df.columns]
    if missing and invalid == "error":
        raise ValueError(f"missing features: {', '.join(missing)}")
    scored = add_scores(model, df.withColumn(FEATURES, inputs(df, model, invalid)))
    if not model.is_classifier:
        out = scored.withColumn(output, F.col(SCORES)[0])
        if confidence:
            out = out.withColumn(confidence, F.lit(None).cast("double"))
    else:
        best = F.array_position(SCORES, F.array_max(SCORES)).cast("int")
        decoded = F.element_at(F.array(*[F.lit(v) for v in model.labels]), best)
        out = scored.withColumn(output, decoded)
        if confidence:
            out = out.withColumn(confidence, F.array_max(SCORES))
    return out.drop(FEATURES, SCORES)


def add_scores(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Class probabilities, or the predicted value, as an array column."""
    keep = df.columns
    parts = []
    for i, member in enumerate(model.members):
        df, part = _member_output(model, member, df, f"__m{i}")
        parts.append(part)
    if not model.is_classifier:
        weights = [float(getattr(m, "getNumTrees", 1)) for m in model.members]
        total = sum(w * p for w, p in zip(weights, parts)) / sum(weights)
        return df.select(*keep, F.array(total).alias(SCORES))
    if model.combine == "one_vs_rest":
        raw = F.array(*[p[1] for p in parts])
    else:
        raw = parts[0]
        for p in parts[1:]:
            raw = F.zip_with(raw, p, lambda a, b: a + b)
    df = df.select(*keep, raw.alias("__raw"))
    total = F.aggregate("__raw", F.lit(0.0), lambda acc, x: acc + x)
    even = F.transform("__raw", lambda x: F.lit(1.0) / F.size("__raw"))
    share = F.when(total > 0, F.transform("__raw", lambda x: x / total)).otherwise(even)
    return df.select(*keep, share.alias(SCORES))


def _without_summary(member):
    """A copy for scoring.  A summary holds the session, which no task takes once a write was observed; some copies keep it."""
    if not getattr(member, "hasSummary", False):
        return member
    out = member.copy()
    out._java_obj.setSummary(SparkContext.getOrCreate()._jvm.scala.Option.empty())
    return out


def _member_output(model: TrainedModel, member, df: DataFrame, name: str):
    if isinstance(member, PipelineModel):
        head, last = PipelineModel(member.stages[:-1]), member.stages[-1]
        df = head.transform(df)
    else:
        last = member
    last = _without_summary(last)
    if not model.is_classifier:
        return last.transform(df, {last.predictionCol: name}), F.col(name)
    raw, prob = (name, "") if model.combine == "votes" else (f"{name}_raw", name)
    out = last.transform(df, {last.predictionCol: f"{name}_p", last.rawPredictionCol: raw,
                              last.probabilityCol: prob})
    return out, vector_to_array(F.col(name))


def predict_with_confidence(model: TrainedModel, df: DataFrame, *, keep: Sequence[str] = (),
                            importance: dict[str, float] | None = None) -> DataFrame:
    """Prediction as text, confidence, and the most important feature with its value."""
    importance = feature_importance(model) if importance is None else importance
    scored = predict(model, df, confidence="confidence", invalid="zero")
    top = min(importance, key=lambda f: (-importance[f], f)) if importance else None
    return scored.select(
        *keep,
        F.col("prediction").cast("string").alias("prediction"),
        "confidence",
        F.lit(top).cast("string").alias("top_feature"),
        (_feature_value(model, df, top) if top else F.lit(None).cast("double")).alias("top_value"),
    )


def _feature_value(model: TrainedModel, df: DataFrame, name: str) -> Column:
    if name in df.columns:
        return F.col(f"`{name}`").cast("double")
    base, _, rest = name.partition("[")
    return F.col(f"`{base}`")[int(rest[:-1])].cast("double") if rest else F.lit(None).cast("double")


def feature_importance(model: TrainedModel) -> dict[str, float]:
    """Mean impurity importance over the members' trees; empty for other models."""
    names = model_names(model)
    trees = [m for m in model.members if hasattr(m, "featureImportances")]
    if not trees or model.kind == "text":
        return {}
    total = [0.0] * len(names)
    for m in trees:
        for i, v in zip(range(len(names)), m.featureImportances.toArray()):
            total[i] += float(v) * m.getNumTrees
    norm = sum(total) or 1.0
    return {n: v / norm for n, v in zip(names, total)}


def importance_frame(spark: SparkSession, importance: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(importance.items()), "feature string, score double")


def evaluate_model(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Metrics of the model on a table that has its trained target column.

    Equal rows are scored once and counted, unless their input is a text or holds arrays, which hardly repeat.
    """
    count = None if model.kind == "text" or model.widths else ROWS
    rows = grouped(df, [*model.features, model.target]) if count else df
    return evaluate(predict(model, rows, output="__prediction"), model.target, "__prediction",
                    model.task, pos_label=model.pos_label, count=count)


def training_log(spark: SparkSession, model: TrainedModel) -> DataFrame:
    """Objective per training step, for freshly trained models that record it."""
    rows = []
    for member in model.members:
        last = member.stages[-1] if isinstance(member, PipelineModel) else member
        if getattr(last, "hasSummary", False):
            summary = last.summary() if callable(last.summary) else last.summary
            history = list(summary.objectiveHistory)
            rows += [(i, len(history), float(v)) for i, v in enumerate(history, start=1)]
    return spark.createDataFrame(rows, "epoch int, epochs int, objective double")


def round_curve(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Loss on ``df`` after each round of boosting: ``round, class, loss``, with a class where there is one model for each.

    Squared error for numbers, logistic loss for classes.  Equal rows are counted first, then one pass over them for each
    member; what comes back is a number for each round.
    """
    if not model.members or not hasattr(model.members[0], "evaluateEachIteration"):
        raise ValueError(f"{model.plugin} has no rounds")
    rows = grouped_design(df, model)
    several, out = model.combine == "one_vs_rest", []
    try:
        for i, member in enumerate(model.members):
            one = rows.withColumn(LABEL, (F.col(LABEL) == i).cast("double")) if several else rows
            losses = member.copy({member.weightCol: ROWS}).evaluateEachIteration(one, *([] if model.is_classifier else ["squared"]))
            out += [(k, str(model.labels[i]) if several else None, float(v)) for k, v in enumerate(losses, start=1)]
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, "round int, class string, loss double")


def model_auc(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Area under the ROC curve of a two-class model's score for its positive class."""
    if not model.is_classifier or len(model.labels) != 2:
        raise ValueError("two classes are needed")
    at = model.labels.index(model.pos_label) if model.pos_label in model.labels else 1
    rows = df.where(F.col(f"`{model.target}`").isNotNull()).select(
        F.col(f"`{model.target}`").alias("__y"), array_to_vector(model_array(df, model)).alias(FEATURES))
    scored = add_scores(model, rows).select("__y", F.col(SCORES)[at].alias("__s"))
    return ranked_auc(scored, "__y", "__s", pos_label=model.labels[at])


# --- storage --------------------------------------------------------------------------

def model_dir(project: str, run_name: str, plugin: str) -> str:
    folder = {v: k for k, v in MODEL_FOLDERS.items()}.get(plugin, plugin)
    return f"{project.rstrip('/')}/runs/{run_name}/artifacts/{folder}_model"


def save_model(spark: SparkSession, model: TrainedModel, path: str) -> str:
    """Write the model to a new folder; an existing model is never replaced."""
    if workspace.path_exists(spark, path):
        raise FileExistsError(path)
    for i, member in enumerate(model.members):
        member.write().save(f"{path}/members/{i}")
    meta = {
        "plugin": model.plugin, "task": model.task, "target": model.target,
        "features": model.features, "combine": model.combine, "labels": model.labels,
        "widths": model.widths, "params": model.params, "kind": model.kind,
        "classes": [f"{type(m).__module__}.{type(m).__name__}" for m in model.members],
    }
    row = spark.createDataFrame([(json.dumps(meta),)], "value string")
    row.coalesce(1).write.text(f"{path}/metadata")
    return path


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    meta = json.loads(spark.read.text(f"{path}/metadata").first().value)
    members = []
    for i, full_name in enumerate(meta.pop("classes")):
        module, _, cls = full_name.rpartition(".")
        members.append(getattr(import_module(module), cls).load(f"{path}/members/{i}"))
    return TrainedModel(members=members, **meta)


def write_report(df: DataFrame, path: str) -> None:
    """A small result (profile, ranking, metrics, receipt) as one JSON file."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def publish_best(spark: SparkSession, project: str, metrics: DataFrame, metric: str = "f1",
                 models: DataFrame | None = None) -> DataFrame:
    """Point each run's export record at its best saved model; the records are returned.

    ``metrics`` has (run_name, plugin_name, metric, value) rows, ``models`` the saved models as ``scan_models`` lists them (the
    default).  A best model that is not saved is an error, and then nothing is published.  All records go in one write that
    replaces those of the runs given; the records of other runs stay.
    """
    root = project.rstrip("/")
    folder = F.coalesce(F.create_map(*[F.lit(x) for f, p in MODEL_FOLDERS.items() for x in (p, f)])[F.col("plugin_name")],
                        F.col("plugin_name"))
    path = F.concat(F.lit(f"{root}/runs/"), "run_name", F.lit("/artifacts/"), folder, F.lit("_model"))
    best = workspace.cut_lineage(best_model(metrics, metric).select("run_name", "plugin_name", path.alias("path")))
    listed = scan_models(spark, project) if models is None else models
    lost = best.join(listed.select("run_name", "plugin_name"), ["run_name", "plugin_name"], "left_anti").orderBy("path").head(3)
    if lost:
        raise FileNotFoundError(", ".join(r.path for r in lost))
    records = best.select("run_name", F.lit("spark").alias("format"), "path", F.col("plugin_name").alias("plugin"))
    (records.repartition("run_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_name").json(f"{root}/exports"))
    return records


def published(spark: SparkSession, project: str) -> DataFrame:
    """The export records of all runs of a project."""
    path, fields = f"{project.rstrip('/')}/exports", "run_name string, format string, path string, plugin string"
    if not workspace.path_exists(spark, path):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).json(path).select("run_name", "format", "path", "plugin")


def scan_models(spark: SparkSession, project: str) -> DataFrame:
    """Catalog of the models saved under all runs of a project."""
    pattern = f"{project.rstrip('/')}/runs/*/artifacts/*_model/metadata"
    if not workspace.glob_has_match(spark, pattern):
        empty = spark.createDataFrame([], "path string, metadata string")
        return model_catalog(empty)
    shown = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    files = spark.read.text(pattern).select(shown.alias("path"), F.col("value").alias("metadata"))
    return model_catalog(files)
