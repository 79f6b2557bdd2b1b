"""Random cosine features: a nonlinear regressor that is linear in what it learns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def directions(width: int, count: int, spread: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions and phases; the same for the same numbers."""
    rng = np.random.default_rng([seed, width, count])
    return rng.standard_normal((width, count)) * spread, rng.uniform(0, 2 * np.pi, count)


class RandomCosines(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Appends ``count`` cosines of random projections to a vector.

    A linear model of them is a kernel machine with a Gaussian kernel whose width falls with ``spread``.  Nothing is
    learned here, so rows are mapped in Arrow batches without a pass over the table.
    """

    count = Param(Params._dummy(), "count", "number of cosines", TypeConverters.toInt)
    spread = Param(Params._dummy(), "spread", "scale of the projections", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, count=256, spread=1.0, seed=42):
        super().__init__()
        self._setDefault(count=256, spread=1.0, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        count, spread, seed = (self.getOrDefault(p) for p in ("count", "spread", "seed"))

        @F.pandas_udf("array<double>")
        def cosines(rows: pd.Series) -> pd.Series:
            given, out = rows.tolist(), [None] * len(rows)
            for width in {len(r) for r in given if r is not None}:
                at = [i for i, r in enumerate(given) if r is not None and len(r) == width]
                matrix = np.stack([given[i] for i in at])
                turn, phase = directions(width, count, spread / np.sqrt(max(1, width)), seed)
                for i, r in zip(at, np.hstack([matrix, np.cos(matrix @ turn + phase)])):
                    out[i] = r
            return pd.Series(out)

        found = array_to_vector(cosines(vector_to_array(F.col(self.getInputCol()))))
        return dataset.withColumn(self.getOutputCol(), found)


def cosine_regression(features: str, label: str, *, count: int = 256, spread: float = 1.0, ridge: float = 1e-6, seed: int = 42,
                      scaler: StandardScalerModel | None = None, weight: str | None = None) -> Pipeline:
    """Scaled features, random cosines, and ridge regression by normal equations: one aggregate over the rows.

    Rows may be weighted; a scaler takes no weights, so it is then given as fitted to the rows themselves.
    """
    scaled, mapped = "__scaled", "__cosines"
    return Pipeline(stages=[
        scaler.setOutputCol(scaled) if scaler else StandardScaler(inputCol=features, outputCol=scaled, withMean=True),
        RandomCosines(inputCol=scaled, outputCol=mapped, count=count, spread=spread, seed=seed),
        LinearRegression(featuresCol=mapped, labelCol=label, solver="normal", regParam=ridge, standardization=False,
                         **({"weightCol": weight} if weight else {}))])
