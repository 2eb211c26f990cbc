"""Two transformers Spark ML has no counterpart for; both are saved with their pipeline."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of the Gaussian kernel (Rahimi and Recht, 2007)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    dimension = Param(Params._dummy(), "dimension", "output size", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the projection", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, gamma=0.1, dimension=128, seed=42):
        super().__init__()
        self._setDefault(gamma=0.1, dimension=128, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, size, seed = (self.getOrDefault(p) for p in (self.gamma, self.dimension, self.seed))

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            rows = np.stack(x.to_numpy())
            rng = np.random.RandomState(seed)
            w = rng.normal(size=(rows.shape[1], size)) * np.sqrt(2 * gamma)
            b = rng.uniform(0, 2 * np.pi, size)
            return pd.Series(list(np.sqrt(2.0 / size) * np.cos(rows @ w + b)))

        return df.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol()))))


class BoostedStumps(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Weighted vote of one-split trees, as one native expression.

    ``rules`` holds ``[feature, threshold, left class, right class, weight]`` per round; the output is
    the vote share of class 1.
    """

    rules = Param(Params._dummy(), "rules", "json list of stumps", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, rules="[]"):
        super().__init__()
        self._setDefault(rules="[]")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(
            self.getOutputCol(), stump_vote(vector_to_array(self.getInputCol()), json.loads(self.getOrDefault(self.rules)))
        )


def stump_vote(values, rules):
    """Share of the vote weight that goes to class 1."""
    stumps = F.array(
        *[
            F.struct(
                F.lit(int(f)).alias("f"), F.lit(float(t)).alias("t"), F.lit(float(a)).alias("a"),
                F.lit(float(b)).alias("b"), F.lit(float(w)).alias("w"),
            )
            for f, t, a, b, w in rules
        ]
    )
    vote = F.aggregate(
        stumps,
        F.lit(0.0),
        lambda acc, s: acc + s["w"] * F.when(F.get(values, s["f"]) <= s["t"], s["a"]).otherwise(s["b"]),
    )
    total = sum(r[4] for r in rules) or 1.0
    return vote / F.lit(float(total))
