"""Calibration of scores to ordinal labels, and the scores themselves.

Calibrators follow one protocol: ``fit(train, score, label)`` returns a model with
``predict(df, score)``, which adds ``calibrated``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LABELS = 6


def valid(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows with a score and a label; NaN counts as missing."""
    return df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))


@dataclass
class QuantileMap:
    """CAL1: the share of training scores up to x, looked up among the sorted labels with linear
    interpolation. ``scores`` has ``s, upto`` (training rows up to s) for each distinct score and
    ``labels`` has ``y, above`` (rows with labels up to y) for each distinct label."""

    scores: DataFrame
    labels: list[tuple[float, int]]
    n: int

    def predict(self, df: DataFrame, score: str) -> DataFrame:
        """``df`` with ``calibrated``: an as-of join by a sort over scores of both sides, and
        arithmetic over the few distinct labels. Null where the score is null or nothing was learned."""
        if not self.n:
            return df.withColumn("calibrated", F.lit(None).cast("double"))
        asked = df.select(F.col(score).cast("double").alias("s")).filter("s IS NOT NULL AND NOT isnan(s)").distinct()
        known = asked.join(self.lookup(asked), "s", "left").select("s", F.coalesce("upto", F.lit(0)).alias("upto"))
        h = F.col("upto") / self.n * (self.n - 1)

        def at(k: Column) -> Column:  # the label at a 0-based place of the sorted labels
            out = F.lit(self.labels[-1][0])
            for y, above in reversed(self.labels[:-1]):
                out = F.when(k < above, y).otherwise(out)
            return out

        low, high = at(F.floor(h)), at(F.ceil(h))
        mapped = known.select(F.col("s").alias("__at"), (low + (high - low) * (h - F.floor(h))).alias("calibrated"))
        return df.withColumn("__of", F.col(score).cast("double")).join(mapped, F.col("__of") == F.col("__at"), "left").drop("__of", "__at")

    def lookup(self, asked: DataFrame) -> DataFrame:
        """``s, upto`` for each asked score: both sides are cut into ranges of scores, the greatest
        count of earlier ranges is carried over, and the rest is a window in each range."""
        both = self.scores.unionByName(asked.withColumn("upto", F.lit(None).cast("long")))
        parts = both.repartitionByRange("s").withColumn("part", F.spark_partition_id())
        w = W.partitionBy("part").orderBy("s", F.col("upto").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
        inside = parts.withColumn("seen", F.max("upto").over(w))
        ends = parts.groupBy("part").agg(F.max("upto").alias("last"))
        carried = ends.select("part", F.max("last").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
        return inside.filter("upto IS NULL").join(F.broadcast(carried), "part").select("s", F.coalesce("seen", "before").alias("upto"))


def quantile_map(train: DataFrame, score: str, label: str) -> QuantileMap:
    """CAL1: fit. Counts by distinct score and label are all that is kept."""
    rows = valid(train, score, label)
    by_score = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("c"))
    parts = by_score.repartitionByRange("s").withColumn("part", F.spark_partition_id())
    w = W.partitionBy("part").orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = parts.groupBy("part").agg(F.sum("c").alias("t"))
    before = totals.select("part", F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = parts.withColumn("run", F.sum("c").over(w)).join(F.broadcast(before), "part").select("s", (F.col("run") + F.col("before")).alias("upto"))
    counts = rows.groupBy(F.col(label).cast("double").alias("y")).agg(F.count("*").alias("c")).orderBy("y").collect()
    labels, n = [], 0
    for r in counts:
        n += r["c"]
        labels.append((r["y"], n))
    return QuantileMap(upto, labels, n)


@dataclass
class Isotonic:
    """CAL2: a monotone step line between boundaries, clipped outside them."""

    model: object

    def predict(self, df: DataFrame, score: str) -> DataFrame:
        vector = VectorAssembler(inputCols=["__s"], outputCol="features")
        known = df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__s", F.col(score).cast("double"))
        ok = known.filter("__s IS NOT NULL AND NOT isnan(__s)")
        out = self.model.transform(vector.transform(ok)).drop("features", "__s", "__row").withColumnRenamed("prediction", "calibrated")
        return out.unionByName(known.filter("__s IS NULL OR isnan(__s)").drop("__s", "__row").withColumn("calibrated", F.lit(None).cast("double")))


def isotonic(train: DataFrame, score: str, label: str) -> Isotonic:
    """CAL2: fit by Spark's pool-adjacent-violators."""
    rows = valid(train, score, label).select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("label"))
    rows = VectorAssembler(inputCols=["s"], outputCol="features").transform(rows.groupBy("s").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight")))
    return Isotonic(IsotonicRegression(weightCol="weight").fit(rows))


@dataclass
class OrdinalLogistic:
    """CAL3: one slope and five thresholds; the expected label under the model."""

    slope: float
    thresholds: list[float]

    def predict(self, df: DataFrame, score: str) -> DataFrame:
        upto = [F.least(F.greatest(1 / (1 + F.exp(F.col(score).cast("double") * self.slope - t)), F.lit(1e-10)), F.lit(1 - 1e-10)) for t in self.thresholds]
        expected = sum((1 - p for p in upto[1:]), 1 - upto[0])  # sum of P(label > k)
        return df.withColumn("calibrated", F.least(F.greatest(expected, F.lit(0.0)), F.lit(float(LABELS - 1))))


def ordinal_logistic(train: DataFrame, score: str, label: str, bins: int = 4096, steps: int = 400) -> OrdinalLogistic:
    """CAL3: maximum likelihood over counts by label and score; scores beyond ``bins`` distinct ones
    are first brought to as many equal steps, so what comes to the driver is bounded. Gradient
    steps with a backtracking rate; thresholds stay sorted."""
    rows = valid(train, score, label).select(F.col(score).cast("double").alias("s"), F.least(F.greatest(F.col(label).cast("int"), F.lit(0)), F.lit(LABELS - 1)).alias("y"))
    edge = rows.agg(F.min("s").alias("a"), F.max("s").alias("b"), F.approx_count_distinct("s").alias("k")).first()
    if edge["a"] is None:
        return OrdinalLogistic(1.0, [0.0] * (LABELS - 1))
    width = (edge["b"] - edge["a"]) / bins
    place = F.col("s") if edge["k"] <= bins or width == 0 else F.lit(edge["a"]) + F.floor((F.col("s") - edge["a"]) / width) * width
    counts = rows.groupBy(place.alias("s"), "y").agg(F.count("*").alias("c")).orderBy("s", "y").limit(2 * LABELS * bins).collect()
    s, y, c = np.array([r["s"] for r in counts]), np.array([r["y"] for r in counts]), np.array([r["c"] for r in counts], float)

    def loss(params):
        z = np.sort(params[1:])[:, None] - params[0] * s[None, :]
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -40, 40))), 1e-10, 1 - 1e-10)
        p = np.vstack([np.zeros(len(s)), p, np.ones(len(s))])
        at = np.arange(len(s))
        return -(c * np.log(np.maximum(p[y + 1, at] - p[y, at], 0) + 1e-10)).sum() / c.sum()

    order = np.repeat(y, c.astype(int)) if c.sum() < 1e6 else np.repeat(y, np.maximum(1, c / c.sum() * 1e6).astype(int))
    now = np.concatenate([[1.0], np.percentile(order, np.linspace(0, 100, LABELS - 1))])
    rate, value = 1.0, loss(now)
    for _ in range(steps):
        slope = np.array([(loss(now + d) - loss(now - d)) / 2e-5 for d in np.eye(len(now)) * 1e-5])
        while rate > 1e-8 and loss(now - rate * slope) > value - 1e-4 * rate * (slope @ slope):
            rate /= 2
        if rate <= 1e-8 or np.abs(slope).max() < 1e-6:
            break
        now = now - rate * slope
        value, rate = loss(now), rate * 2
    return OrdinalLogistic(float(now[0]), np.sort(now[1:]).tolist())


class Uncalibrated:
    """Scores as they are."""

    def predict(self, df: DataFrame, score: str) -> DataFrame:
        return df.withColumn("calibrated", F.col(score).cast("double"))


METHODS = {"none": lambda train, score, label: Uncalibrated(), "isotonic": isotonic, "q2q": quantile_map, "ordinal": ordinal_logistic}


def out_of_fold(df: DataFrame, method: str, score: str, label: str, fold: str = "fold", folds: int = 5) -> DataFrame:
    """CAL5: the rows with a score and a label and ``calibrated``, each fold predicted by a calibrator
    of the others. ``folds`` is small: a plan for each."""
    rows, out = valid(df, score, label), None
    for k in range(folds):
        part = METHODS[method](rows.filter(F.col(fold) != k), score, label).predict(rows.filter(F.col(fold) == k), score)
        out = part if out is None else out.unionByName(part)
    return out


def fold_comparison(df: DataFrame, methods: tuple[str, ...], score: str, label: str, fold: str = "fold", folds: int = 5) -> DataFrame:
    """CAL4: ``method`` with mean and population deviation over folds of RMSE and accuracy."""
    clip = lambda c: F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(LABELS - 1.0))
    out = None
    for m in methods:
        rows = out_of_fold(df, m, score, label, fold, folds)
        each = rows.groupBy(fold).agg(F.sqrt(F.avg(F.pow(F.col("calibrated") - F.col(label), 2))).alias("rmse"), F.avg((clip(F.col("calibrated")) == clip(F.col(label).cast("double"))).cast("double")).alias("acc"))
        row = each.agg(F.lit(m).alias("method"), F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"), F.avg("acc").alias("accuracy_mean"), F.stddev_pop("acc").alias("accuracy_std"))
        out = row if out is None else out.unionByName(row)
    return out


def unit_score(c: Column, clamp: bool = True) -> Column:
    """SCR3: a label 0..5 as 0..1; the browser's path doesn't clamp."""
    return (F.least(F.greatest(c, F.lit(0.0)), F.lit(5.0)) if clamp else c) / 5


def uniform(*keys: str, seed: int = 42) -> Column:
    """SCR4: a score in [0, 1) that depends on the row's key alone, so reruns agree."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))


def sampled_labels(df: DataFrame, train: DataFrame, label: str, key: str, weighted: bool = True, seed: int = 42) -> DataFrame:
    """SCR5: ``df`` with ``predicted``: a label drawn by the training rows' distribution, or uniformly
    from its distinct labels. Labels are few: their shares come to the driver."""
    counts = [(r[label], r["c"] if weighted else 1) for r in train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("c")).orderBy(label).collect()]
    total, upto, out = sum(c for _, c in counts), 0, F.lit(None)
    u = uniform(key, seed=seed)
    bounds = []
    for y, c in counts:
        upto += c
        bounds.append((y, upto / total))
    for y, b in reversed(bounds):
        out = F.when(u < b, F.lit(y)).otherwise(out)
    return df.withColumn("predicted", out)


def swept(texts: DataFrame, configs: DataFrame, most: int = 1000) -> DataFrame:
    """SCR8: every configuration with every text. The number of configurations is a checked bound."""
    if configs.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} configurations")
    return texts.crossJoin(F.broadcast(configs))
