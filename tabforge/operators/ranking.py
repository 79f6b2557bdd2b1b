"""Suitability of the algorithms for a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scores(rows: Column) -> tuple[tuple[str, str, Column], ...]:
    """(algorithm, modality it needs, score) triples.

    The thresholds and scores are fixed values.
    """
    return (
        ("random_forest", "tabular", F.when(rows < 10, 0.30).otherwise(0.85)),
        ("xgboost", "tabular", F.lit(0.90)),
        ("lightgbm", "tabular", F.when(rows > 5000, 0.88).otherwise(0.80)),
        ("lstm_tabular", "tabular", F.when(rows >= 50, 0.70).otherwise(0.30)),
        ("cnn_image", "image", F.lit(0.90)),
        ("lora_text", "text", F.lit(0.90)),
    )


def rank_algorithms(profiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Algorithms by descending score, ties by name.

    ``profiles`` has ``row_count`` and ``data_types``; ``by`` names the columns
    that tell several profiles apart.
    """
    entries = [
        F.struct(F.lit(name).alias("algorithm"),
                 F.when(F.array_contains("data_types", tag), score).otherwise(0.0).alias("score"))
        for name, tag, score in _scores(F.col("row_count"))
    ]
    rows = profiles.select(*by, F.inline(F.array(*entries)))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "algorithm")
    return rows.withColumn("rank", F.row_number().over(order))
