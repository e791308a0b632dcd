"""ML4: kernel regression for sets that no kernel matrix fits.

Rows meet a bounded number of landmarks, not each other: their kernel values, turned by the inverse root of
the landmarks' own matrix, are the features of a linear fit (a Nystroem map). The fit minimises the mean
squared error and a square penalty, and is solved from sums that each task forms over its own rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANDMARKS = 500  # fixed value: of a map
SAID = "prediction"


@dataclass
class Kernel:
    low: np.ndarray
    span: np.ndarray
    landmarks: np.ndarray
    root: np.ndarray
    gamma: float
    weights: np.ndarray
    bias: float = 0.0

    def mapped(self, x: np.ndarray) -> np.ndarray:
        """Rows of 0..1 features as kernel features."""
        scaled = np.nan_to_num((x - self.low) / self.span)
        far = (scaled**2).sum(axis=1)[:, None] - 2 * scaled @ self.landmarks.T + (self.landmarks**2).sum(axis=1)
        return np.exp(-self.gamma * np.maximum(far, 0)) @ self.root

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``. Null features give null."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def said(x: pd.Series) -> pd.Series:
            out, held = np.full(len(x), np.nan), np.flatnonzero(x.notna().to_numpy())
            if len(held):
                out[held] = shared.value.mapped(np.stack(x.to_numpy()[held]).astype(float)) @ shared.value.weights + shared.value.bias
            return pd.Series(out)

        return df.withColumn(SAID, F.when(F.col("features").isNotNull(), said(arrays(df))))


def arrays(df: DataFrame):
    kind = df.schema["features"].dataType.typeName()
    return vector_to_array("features") if kind == "vectorudt" else F.col("features").cast("array<double>")


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``column`` that are there, and their places."""
    held = np.flatnonzero(np.asarray(column.is_valid()))
    flat = column.take(pa.array(held)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(held), dim), held


def bounds(df: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each feature; each task sends one row."""

    def run(batches):
        low, high = np.full(dim, np.inf), np.full(dim, -np.inf)
        for batch in batches:
            x, held = matrix(batch.column(0), dim)
            if len(held):
                low, high = np.fmin(low, np.fmin.reduce(x)), np.fmax(high, np.fmax.reduce(x))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(low), pa.array(high)], ["i", "low", "high"])

    rows = df.select(arrays(df)).mapInArrow(run, "i int, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row a feature
    found = sorted((r["i"], r["low"], r["high"]) for r in rows)
    low, high = (np.array([r[k] for r in found]) for k in (1, 2))
    return low, np.where(high > low, high - low, 1.0)


def sums(df: DataFrame, model: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of products of the kernel features (and of 1) among themselves and with the label.
    Each task adds up its own rows; rows of the matrix are added where Spark deals them."""
    shared, m, dim = df.sparkSession.sparkContext.broadcast(model), len(model.weights) + 1, len(model.low)
    schema = "i int, v binary"

    def own(batches):
        total = np.zeros((m, m + 1))
        for batch in batches:
            x, held = matrix(batch.column(0), dim)
            if len(held):
                phi = np.concatenate([shared.value.mapped(x), np.ones((len(x), 1))], axis=1)
                y, w = (batch.column(k).to_numpy(zero_copy_only=False)[held] for k in (1, 2))
                total += (phi * w[:, None]).T @ np.concatenate([phi, y[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(m), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], ["i", "v"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["i", "v"])

    rows = df.select(arrays(df).alias("x"), F.col("label").cast("double"), F.col("weight").cast("double")).filter("x IS NOT NULL AND label IS NOT NULL AND weight IS NOT NULL")
    out = np.zeros((m, m + 1))
    for r in rows.mapInArrow(own, schema).repartition("i").mapInArrow(added, schema).collect():  # m rows of m numbers
        out[r["i"]] = np.frombuffer(r["v"])
    return out[:, :m], out[:, m]


def fit(df: DataFrame, key: str, c: float = 1.0, landmarks: int = LANDMARKS, gamma: float | None = None) -> Kernel:
    """A kernel regression of ``label`` on ``features`` (arrays or vectors, scaled to 0..1 first) with ``weight``:
    an exponential kernel of squared distances, penalty ``1 / c``, the rows of least hash of ``key`` as landmarks.

    Rows with a null label, weight or features are left out; repeated landmarks count once. Without rows it is an error.
    """
    held = df.filter("features IS NOT NULL AND label IS NOT NULL AND weight IS NOT NULL")
    taken = held.select(F.md5(F.col(key).cast("string")).alias("h"), arrays(held).alias("x")).orderBy("h", "x").limit(landmarks).collect()
    if not taken:
        raise ValueError("there are no rows to learn from")
    dim = len(taken[0]["x"])
    low, span = bounds(held, dim)
    marks = np.unique((np.array([r["x"] for r in taken]) - low) / span, axis=0)
    gamma = 1.0 / dim if gamma is None else gamma
    own = np.exp(-gamma * np.maximum(_far(marks), 0))
    values, turns = np.linalg.eigh(own)
    root = (turns / np.sqrt(np.maximum(values, 1e-12))) @ turns.T
    model = Kernel(low, span, marks, root, gamma, np.zeros(len(marks)))
    products, with_label = sums(held, model)
    penalty = np.eye(len(products)) / c
    penalty[-1, -1] = 0  # the constant is free
    solved = np.linalg.solve(products / products[-1, -1] + penalty, with_label / products[-1, -1])
    model.weights, model.bias = solved[:-1], float(solved[-1])
    return model


def _far(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(axis=1)
    return s[:, None] - 2 * x @ x.T + s
