"""Analysis of run logs, metrics, importances and model catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions import text as X
from tabforge.operators.metrics import higher_is_better
from tabforge.operators.profile import HIGH_NULL_PCT
from tabforge.operators.rows import rank_in_groups

# Node states, those that count as done, the state of a node
# without a log row, the insight bounds, and the model folders of each algorithm.
STATES = ("pending", "ready", "running", "succeeded", "failed", "awaiting_human", "approved", "skipped")
DONE_STATES = ("succeeded", "approved", "skipped")
INITIAL_STATE = "pending"
LOW_ACCURACY = 0.7
DOMINANT_IMPORTANCE = 0.8
MODEL_FOLDERS = {
    "rf": "random_forest",
    "xgb": "xgboost",
    "lgbm": "lightgbm",
    "cnn": "cnn_image",
    "lstm": "lstm_tabular",
    "lora": "lora_text",
}


def run_progress(node_runs: DataFrame) -> DataFrame:
    """Done and total nodes of every run."""
    return node_runs.groupBy("run_name").agg(
        F.count_if(F.col("state").isin(*DONE_STATES)).alias("done"),
        F.count(F.lit(1)).alias("total"),
    )


def run_summary(node_runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Progress of every run with its first metric, by metric position."""
    first = metrics.groupBy("run_name").agg(
        F.min_by(F.struct("metric", "value"), "position").alias("first"))
    return run_progress(node_runs).join(first, "run_name", "left").select(
        "run_name", "done", "total", F.col("first.metric").alias("first_metric"),
        F.col("first.value").alias("value"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run with the highest id."""
    return runs.orderBy(F.desc("run_id")).limit(1)


def node_states(log: DataFrame, node_ids: Sequence[str] | None = None) -> DataFrame:
    """Latest state of each run's nodes; a listed node without a log row is pending.

    States are compared as numbers: a fixed-width buffer lets the log be
    reduced by hash, map-side, where text would sort all of it first.
    """
    known = F.array(*[F.lit(s) for s in STATES])
    number = F.array_position(known, F.col("state"))
    number = F.when(number > 0, number).otherwise(
        F.raise_error(F.concat(F.lit("unknown state "), F.coalesce("state", F.lit("null")))).cast("bigint"))
    latest = log.groupBy("run_name", "node_id").agg(F.max_by(number, F.struct("ts", number)).alias("number"))
    latest = latest.select("run_name", "node_id", F.element_at(known, F.col("number").cast("int")).alias("state"))
    if node_ids is None:
        return latest
    # At most one entry per listed node goes into a run's map.
    listed = F.when(F.col("node_id").isin(*node_ids), F.struct("node_id", "state"))
    wanted = latest.groupBy("run_name").agg(F.map_from_entries(F.collect_list(listed)).alias("states"))
    nodes = F.explode(F.array(*[F.lit(n) for n in node_ids])).alias("node_id")
    rows = wanted.select("run_name", "states", nodes)
    state = F.coalesce(F.try_element_at("states", F.col("node_id")), F.lit(INITIAL_STATE))
    return rows.select("run_name", "node_id", state.alias("state"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metrics of two runs side by side; the delta needs both values."""
    left = a.select("metric", F.col("value").alias("value_a"))
    right = b.select("metric", F.col("value").alias("value_b"))
    return left.join(right, "metric", "full_outer").select(
        "metric", "value_a", "value_b", (F.col("value_b") - F.col("value_a")).alias("delta"),
        higher_is_better(F.col("metric")).alias("higher_is_better"))


def leaderboard(metrics: DataFrame, by: Sequence[str] = ("run_name", "metric")) -> DataFrame:
    """Models ranked within each run and metric, best first, ties by name."""
    cost = F.when(higher_is_better(F.col("metric")), -F.col("value")).otherwise(F.col("value"))
    # A model without a value comes last.
    costed = metrics.withColumn("__cost", F.coalesce(cost, F.lit(float("inf"))))
    return rank_in_groups(costed, by, ["__cost", "plugin_name"]).drop("__cost")


def best_model(metrics: DataFrame, metric: str = "f1") -> DataFrame:
    """The best model of each run by one metric."""
    signed = F.when(higher_is_better(F.col("metric")), F.col("value")).otherwise(-F.col("value"))
    ranked = metrics.where((F.col("metric") == metric) & F.col("value").isNotNull())
    # Smallest (negated score, name): best score first, ties by name.
    pick = F.min(F.struct((-signed).alias("s"), "plugin_name", "metric", "value")).alias("best")
    return ranked.groupBy("run_name").agg(pick).select(
        "run_name", "best.plugin_name", "best.metric", "best.value")


def top_feature(importance: DataFrame) -> DataFrame:
    """The most important feature; the first by name among equals."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "feature", "score")).alias("best")
    return importance.agg(best).select("best.feature", "best.score")


def relative_importance(importance: DataFrame) -> DataFrame:
    """Scores as whole percent of the highest score."""
    top = importance.agg(F.max("score")).scalar()
    share = F.coalesce(F.col("score") / F.nullif(top, F.lit(0.0)) * 100, F.lit(0.0))
    return importance.select("feature", "score", share.cast("int").alias("relative_pct"))


def insights(metrics: DataFrame, importance: DataFrame, profile: DataFrame) -> DataFrame:
    """Findings of one run: low accuracy, a dominant feature, columns with many nulls."""
    low = metrics.where((F.col("metric") == "accuracy") & (F.col("value") < LOW_ACCURACY)).select(
        F.lit("low_accuracy").alias("rule"), F.col("metric").alias("subject"), "value")
    dominant = top_feature(importance).where(F.col("score") > DOMINANT_IMPORTANCE).select(
        F.lit("dominant_feature").alias("rule"), F.col("feature").alias("subject"),
        F.col("score").alias("value"))
    nulls = profile.where((F.col("row_count") > 0) & (F.col("null_pct") > HIGH_NULL_PCT)).select(
        F.lit("high_null_rate").alias("rule"), F.col("column_name").alias("subject"),
        F.col("null_pct").alias("value"))
    return low.unionByName(dominant).unionByName(nulls)


_MODEL_PATH = r"([^/]+)/artifacts/([^/]+)_model/"


def model_catalog(files: DataFrame) -> DataFrame:
    """Trained models of all runs, from their metadata files (path, metadata JSON).

    The path holds ``<run>/artifacts/<folder>_model/``.
    """
    path = F.col("path")
    meta = F.from_json("metadata", "task string, features array<string>, X_cols array<string>")
    rows = files.where(path.rlike(_MODEL_PATH)).withColumn("__meta", meta)
    cols = F.coalesce("__meta.X_cols", "__meta.features")
    plugin = _plugin_of(F.regexp_extract(path, _MODEL_PATH, 2))
    return rows.select(
        F.regexp_extract(path, _MODEL_PATH, 1).alias("run_name"),
        F.concat(F.lit("train_"), plugin).alias("node_id"),
        plugin.alias("plugin_name"),
        F.coalesce(F.col("__meta.task"), F.lit("unknown")).alias("task"),
        F.coalesce(F.size(cols), F.lit(0)).alias("n_features"),
        path.alias("artifact_path"),
    )


def _plugin_of(folder: Column) -> Column:
    out = None
    for short, plugin in MODEL_FOLDERS.items():
        hit = folder == short
        out = F.when(hit, plugin) if out is None else out.when(hit, plugin)
    return out.otherwise(folder)


def find_models(catalog: DataFrame, run_name: str, plugin_name: str) -> DataFrame:
    return catalog.where((F.col("run_name") == run_name) & (F.col("plugin_name") == plugin_name))


def label_from_path(df: DataFrame, path: str = "path") -> DataFrame:
    """File name and parent-folder label of each path."""
    return df.withColumn("filename", X.file_name(F.col(path))).withColumn(
        "label", X.parent_name(F.col(path)))
