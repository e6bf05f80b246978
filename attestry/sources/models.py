"""Linear models from ``.npz``/``.npy`` files, scored inside Catalyst."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, SparkSession

from attestry.functions.numbers import linear_model

#: Weights of a model that is read to the driver.
MAX_WEIGHTS = 100_000


@dataclass(frozen=True)
class Linear:
    weights: tuple[float, ...]
    bias: float

    def score(self, features: str | Column) -> Column:
        """Probability; missing features count as 0, further ones are dropped."""
        return linear_model(features, list(self.weights), self.bias)


def parse(data: bytes) -> Linear:
    """``weights`` (or ``w``) and ``bias`` (or ``b``) of an archive, or one array."""
    loaded = np.load(io.BytesIO(data), allow_pickle=False)
    if isinstance(loaded, np.ndarray):
        weights, bias = loaded, 0.0
    else:
        pick = lambda *names: next((loaded[n] for n in names if n in loaded.files), None)
        weights, bias = pick("weights", "w", "coef"), pick("bias", "b", "intercept")
    if weights is None:
        raise ValueError("no weights in the model file")
    flat = np.asarray(weights, np.float64).ravel()
    if len(flat) > MAX_WEIGHTS:
        raise ValueError(f"over {MAX_WEIGHTS} weights")
    return Linear(tuple(flat.tolist()), float(np.asarray(0.0 if bias is None else bias).ravel()[0]))


def read(spark: SparkSession, path: str) -> Linear:
    """A model from any store that Spark reads."""
    return parse(bytes(spark.read.format("binaryFile").load(path).select("content").first().content))
