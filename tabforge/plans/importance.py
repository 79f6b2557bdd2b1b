"""Permutation importance as one Spark job over all rows and features."""

from __future__ import annotations

from math import gcd
from random import Random

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.metrics import evaluate
from tabforge.operators.profile import REGRESSION
from tabforge.operators.rows import with_row_index
from tabforge.plans.models import FEATURES, ROWS, SCORES, TrainedModel, add_scores, model_array, model_names


def exchange(n: int, seed: int) -> tuple[int, int]:
    """``(step, start)`` of a permutation ``i * step + start`` modulo ``n`` of row numbers; products fit a long.

    The step is near the golden section of what fits, so rows that are alike, and have neighbouring numbers, take values from
    all over the table.
    """
    draw = Random(seed * 1_000_003 + n)
    step = max(1, int(min(n, (1 << 62) // n) * 0.6180339887498949) - draw.randrange(max(1, n // 1000)))
    while gcd(step, n) > 1:
        step += 1
    return step, draw.randrange(n)


def permutation_importance(model: TrainedModel, df: DataFrame, *, seed: int = 42,
                           normalise: bool = False) -> DataFrame:
    """Loss of the main metric when a feature's values are exchanged among rows.

    ``normalise`` gives shares of the sum, with gains from an exchange as 0.

    Rows are numbered in the order of a hash of their values, and each takes the values of the row whose number a
    permutation keyed by ``seed`` gives, so the result depends on the rows alone, not on their partitions.  The unchanged row and one
    variant per feature are then counted side by side, so that equal ones are scored once, and reduced to metrics.
    """
    names = model_names(model)
    base = df.where(F.col(f"`{model.target}`").isNotNull()).select(F.col(f"`{model.target}`").alias("__y"), model_array(df, model).alias("__x"))
    numbered = with_row_index(base.withColumn("__h", F.xxhash64("__y", "__x", F.lit(seed))), "__h", "__n")
    n = max(1, numbered.count())
    step, start = exchange(n, seed)
    partner = (F.col("__n") * step + start) % n
    other = numbered.select(F.col("__n").alias("__m"), F.col("__x").alias("__other"))
    paired = numbered.select("__y", "__x", partner.alias("__m")).join(other, "__m")
    # Variant -1 is the row itself.  One variant is made at a time, so a row never holds width * width numbers.
    rows = paired.select("__y", "__x", "__other", F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))).alias("feature"))
    swapped = F.when(F.col("feature") < 0, F.col("__x")).otherwise(F.concat(
        F.slice("__x", F.lit(1), F.col("feature")), F.slice("__other", F.col("feature") + 1, F.lit(1)),
        F.slice("__x", F.col("feature") + 2, F.size("__x"))))
    rows = rows.select("__y", "feature", swapped.alias("__x")).groupBy("__y", "feature", "__x").agg(F.count("*").alias(ROWS))
    scored = add_scores(model, rows.select("__y", "feature", ROWS, array_to_vector("__x").alias(FEATURES)))
    metric = "rmse" if model.task == REGRESSION else "f1"
    if model.task == REGRESSION:
        scored = scored.withColumn("__p", F.col(SCORES)[0])
    else:
        best = F.array_position(SCORES, F.array_max(SCORES)).cast("int")
        scored = scored.withColumn("__p", F.element_at(F.array(*[F.lit(v) for v in model.labels]), best))
    values = evaluate(scored, "__y", "__p", model.task, pos_label=model.pos_label, by=("feature",), count=ROWS)
    # One value per feature: as many as the model is wide.
    found = {r.feature: r.value for r in values.where(F.col("metric") == metric).collect()}
    sign = -1.0 if metric == "rmse" else 1.0
    scores = [(n, sign * (found[-1] - found[i])) for i, n in enumerate(names)]
    if normalise:
        positive = [(n, max(v, 0.0)) for n, v in scores]
        total = sum(v for _, v in positive) or 1.0
        scores = [(n, v / total) for n, v in positive]
    return df.sparkSession.createDataFrame(scores, "feature string, score double")

