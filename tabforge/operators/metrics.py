"""Evaluation metrics over prediction tables.

Every classification metric derives from the confusion counts: one aggregate
with map-side combine over the predictions, then work on class pairs only.
``by`` evaluates many runs or models in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.operators.profile import BINARY, MULTICLASS, REGRESSION, detect_task_type, present
from tabforge.operators.rows import running_totals

# Direction of each metric.
HIGHER_IS_BETTER = {"accuracy": True, "f1": True, "auc": True, "rmse": False, "mae": False}


def higher_is_better(metric: Column) -> Column:
    lower = [m for m, up in HIGHER_IS_BETTER.items() if not up]
    return ~metric.isin(*lower)


def confusion_matrix(df: DataFrame, label: str, prediction: str, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Row count per pair of true and predicted class; unlabelled rows are left out.

    Here and below, ``count`` names a column that says for how many rows a row stands.
    """
    rows = df.where(F.col(label).isNotNull())
    return rows.groupBy(*by, F.col(label).alias("y_true"), F.col(prediction).alias("y_pred")).agg(
        (F.sum(count) if count else F.count(F.lit(1))).alias("n"))


def confusion_table(confusion: DataFrame, classes: Sequence) -> DataFrame:
    """The counts as a square table, one column per predicted class."""
    cells = [F.coalesce(F.sum(F.when(F.col("y_pred") == F.lit(c), F.col("n"))), F.lit(0)).alias(str(c))
             for c in classes]
    return confusion.groupBy("y_true").agg(*cells)


def _melt(one: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    return one.select(*by, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])))


def _hit() -> Column:
    return F.col("y_true").eqNullSafe(F.col("y_pred"))


def binary_metrics(df: DataFrame, label: str, prediction: str, *, pos_label=None,
                   by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Accuracy, and F1 of the positive class (0 when it never occurs).

    Without ``pos_label`` it is 1, or the largest label where labels are text.
    """
    conf = confusion_matrix(df, label, prediction, by, count)
    if pos_label is None:
        pos_label = conf.agg(F.max("y_true")).first()[0] if isinstance(df.schema[label].dataType, T.StringType) else 1
    pos = F.lit(pos_label)
    n = F.col("n")
    true_pos = F.coalesce(F.sum(F.when((F.col("y_true") == pos) & (F.col("y_pred") == pos), n)), F.lit(0))
    actual = F.coalesce(F.sum(F.when(F.col("y_true") == pos, n)), F.lit(0))
    called = F.coalesce(F.sum(F.when(F.col("y_pred") == pos, n)), F.lit(0))
    one = conf.groupBy(*by).agg(
        (F.sum(F.when(_hit(), n).otherwise(0)) / F.sum(n)).alias("accuracy"),
        F.when(actual + called > 0, 2 * true_pos / (actual + called)).otherwise(0.0).alias("f1"),
    )
    return _melt(one, by, ("accuracy", "f1"))


def multiclass_metrics(df: DataFrame, label: str, prediction: str, *,
                       by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Accuracy, and F1 per class weighted by the class's true rows."""
    per_class = class_f1(df, label, prediction, by=by, count=count)
    one = per_class.groupBy(*by).agg(
        (F.sum("true_pos") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
    )
    return _melt(one, by, ("accuracy", "f1"))


def class_f1(df: DataFrame, label: str, prediction: str, *, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Support, calls, hits and F1 of every class, also of classes only predicted."""
    conf = confusion_matrix(df, label, prediction, by, count)
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    sides = conf.select(*by, F.inline(F.array(
        F.struct(F.col("y_true").alias("class"), n.alias("support"), zero.alias("called"),
                 F.when(_hit(), n).otherwise(zero).alias("true_pos")),
        F.struct(F.col("y_pred").alias("class"), zero.alias("support"), n.alias("called"),
                 zero.alias("true_pos")),
    )))
    sums = sides.groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "called", "true_pos")])
    return sums.withColumn("f1", 2 * F.col("true_pos") / (F.col("support") + F.col("called")))


def regression_metrics(df: DataFrame, label: str, prediction: str, *,
                       by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    rows = df.where(F.col(label).isNotNull())
    gap = F.col(label).cast("double") - F.col(prediction).cast("double")
    # As an average does, gaps that are null stand for no rows.
    mean = lambda c: F.sum(c * F.col(count)) / F.sum(F.when(c.isNotNull(), F.col(count))) if count else F.avg(c)
    one = rows.groupBy(*by).agg(F.sqrt(mean(gap * gap)).alias("rmse"), mean(F.abs(gap)).alias("mae"))
    return _melt(one, by, ("rmse", "mae"))


def ranked_auc(df: DataFrame, label: str, score: str, *, pos_label=1, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve: the share of pairs of a positive and a negative row that the score orders rightly.

    A tie counts as half.  Exact, from rank sums: rows are counted by score first, so a score that a third of the rows share
    is one row; the negatives below each score are running totals over range partitions, so no window holds all scores.
    Rows without label or score (null, NaN) are left out; where either class is missing the value is null.
    """
    rows = df.where(F.col(label).isNotNull() & present(score, df.schema[score].dataType).isNotNull())
    hit = (F.col(label) == F.lit(pos_label)).cast("long")
    counts = rows.groupBy(*by, F.col(score).alias("__score")).agg(F.sum(hit).alias("__pos"), F.sum(1 - hit).alias("__neg"))
    below = running_totals(counts, by, ["__score"], {"__neg": "__below"})
    exact = "decimal(19,0)"  # products of two longs
    won = F.sum(F.col("__pos").cast(exact) * (2 * F.col("__below") + F.col("__neg")).cast(exact))
    pairs = 2 * F.sum("__pos").cast("double") * F.sum("__neg").cast("double")
    one = below.groupBy(*by).agg(F.when(pairs > 0, won.cast("double") / pairs).alias("auc"))
    return _melt(one, by, ("auc",))


def evaluate(df: DataFrame, label: str, prediction: str, task: str | None = None, *,
             pos_label=None, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Metrics of the task, which is detected from the label when not given."""
    task = task or detect_task_type(df, label)
    if task == REGRESSION:
        return regression_metrics(df, label, prediction, by=by, count=count)
    if task == MULTICLASS:
        return multiclass_metrics(df, label, prediction, by=by, count=count)
    if task != BINARY:
        raise ValueError(f"unknown task {task!r}")
    if pos_label is None:
        pos_label = positive_label(df, label)
    return binary_metrics(df, label, prediction, pos_label=pos_label, by=by, count=count)


def positive_label(df: DataFrame, label: str):
    """1 when it occurs, else the larger label."""
    if isinstance(df.schema[label].dataType, T.BooleanType):
        return True
    top = df.agg(F.max(label).alias("top"),
                 F.bool_or(F.col(label).cast("string") == "1").alias("one")).first()
    if top.one and not isinstance(df.schema[label].dataType, T.StringType):
        return 1
    return top.top
