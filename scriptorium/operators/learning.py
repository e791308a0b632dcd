"""Regressors and classifiers over feature vectors, on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_WEIGHT = 200.0  # fixed value: how much a row of the small set weighs beside the large one
LARGEST = 5.0


def vectors(df: DataFrame, column: str, label: str, weight: str | None = None) -> DataFrame:
    """``features, label, weight`` beside the columns of ``df``; features by a column of arrays."""
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))).withColumn("label", F.col(label).cast("double")).withColumn("weight", F.col(weight).cast("double") if weight else F.lit(1.0))


def ridge(reg: float = 0.1) -> Pipeline:
    """ML1: features to 0..1, then least squares with a square penalty. (Spark's loss is a mean, so its
    penalty is that of a sum divided by the rows.)"""
    return Pipeline(stages=[MinMaxScaler(inputCol="features", outputCol="scaled"), LinearRegression(featuresCol="scaled", weightCol="weight", regParam=reg, elasticNetParam=0.0)])


def forest(trees: int = 50, depth: int = 8, seed: int = 42) -> RandomForestRegressor:
    """ML2."""
    return RandomForestRegressor(weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)


def boosted(rounds: int = 30, depth: int = 4, rate: float = 0.1, seed: int = 42) -> GBTRegressor:
    """ML3: gradient-boosted trees in place of a library that Spark lacks."""
    return GBTRegressor(weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Weights n / (k n_label). Labels are few: their counts are broadcast."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    return df.drop("weight").join(F.broadcast(counts.crossJoin(total)), label).withColumn("weight", F.col("__n") / (F.col("__k") * F.col("__c"))).drop("__c", "__n", "__k")


def bayes() -> NaiveBayes:
    """ML5: Gaussian naive Bayes over balanced weights."""
    return NaiveBayes(modelType="gaussian", weightCol="weight")


def searched(train: DataFrame, estimator, grid: dict[str, list], folds: int = 5, seed: int = 42):
    """ML6: the best of a grid by the mean squared error over folds; ``(model, errors by setting)``."""
    build = ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(estimator.getParam(name), values)
    maps = build.build()
    found = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=RegressionEvaluator(metricName="mse"), numFolds=folds, seed=seed, parallelism=2).fit(train)
    return found.bestModel, [({p.name: v for p, v in m.items()}, e) for m, e in zip(maps, found.avgMetrics)]


def joined_training(small: DataFrame, large: DataFrame, fold: int | None = None, weight: float = SMALL_WEIGHT) -> DataFrame:
    """ML7: rows to train on: the small set (without the rows of ``fold``) weighed up, and all of the
    large set, which is never validated on."""
    kept = small if fold is None else small.filter(F.col("fold") != fold)
    return kept.withColumn("weight", F.col("weight") * weight).unionByName(large, allowMissingColumns=True)


def clipped(predictions: DataFrame) -> DataFrame:
    """Predictions as labels 0..5, rounded half to even."""
    return predictions.withColumn("rounded", F.least(F.greatest(F.rint("prediction"), F.lit(0.0)), F.lit(LARGEST)).cast("int"))


def without(df: DataFrame, groups: dict[str, tuple[int, int]], left_out: str | None) -> DataFrame:
    """FLT14: ``features`` without a group's places; groups are (offset, size)."""
    if left_out is None:
        return df
    a, n = groups[left_out]
    size = max(x + y for x, y in groups.values())
    keep = [k for k in range(size) if not a <= k < a + n]
    return VectorSlicer(inputCol="features", outputCol="__f", indices=keep).transform(df).drop("features").withColumnRenamed("__f", "features")


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, tuple[int, int]], make, seeds: tuple[int, ...] = (40, 41, 42)) -> DataFrame:
    """ML8: ``left_out, seed, mse``: a model of all features and one without each group, for each seed."""
    out = None
    for left_out in (None, *groups):
        for seed in seeds:
            scored = make(seed).fit(without(train, groups, left_out)).transform(without(test, groups, left_out))
            row = scored.agg(F.lit(left_out or "none").alias("left_out"), F.lit(seed).alias("seed"), F.avg(F.pow(F.col("prediction") - F.col("label"), 2)).alias("mse"))
            out = row if out is None else out.unionByName(row)
    return out


def scaled_by(large: DataFrame, small: DataFrame) -> DataFrame:
    """ML9: the small set's features by the large set's ranges; what is no number then is 0."""
    model = MinMaxScaler(inputCol="features", outputCol="__s").fit(large)
    plain = F.transform(vector_to_array("__s"), lambda x: F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x, F.lit(0.0))))
    return model.transform(small).withColumn("features", array_to_vector(plain)).drop("__s")


def loss_curve(model, rows: DataFrame) -> DataFrame:
    """ML9: ``round, loss``: the squared error of a boosted model after each round, on ``rows``."""
    losses = model.evaluateEachIteration(rows, "squared")
    return rows.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(losses, 1)], "round int, loss double")


def stopped_early(train: DataFrame, validation: DataFrame, rounds: int = 30, depth: int = 4, rate: float = 0.1, seed: int = 42):
    """ML9: boosting up to the round of least loss on ``validation``: ``(model, curve)``. All rounds are run
    once for the curve; the model of the best round has the same first rounds, as the seed is the same."""
    whole = boosted(rounds, depth, rate, seed).fit(train)
    curve = loss_curve(whole, validation)
    best = best_round(curve).first()["round"]
    return (whole if best == rounds else boosted(best, depth, rate, seed).fit(train)), curve


@dataclass
class TwoStages:
    """ML9: a model of the large set, and one of what it leaves over on the small set."""

    first: object
    second: object

    def transform(self, df: DataFrame) -> DataFrame:
        both = self.second.transform(self.first.transform(df).withColumnRenamed("prediction", "first_"))
        return both.withColumn("prediction", F.col("first_") + F.col("prediction")).drop("first_")


def two_stages(large: DataFrame, small: DataFrame, validation: DataFrame, **how) -> TwoStages:
    """ML9: boosting on the large set, then on the small set's errors, both stopped by ``validation``."""
    first, _ = stopped_early(large, validation, **how)
    left = lambda df: first.transform(df).withColumn("label", F.col("label") - F.col("prediction")).drop("prediction")
    second, _ = stopped_early(left(small), left(validation), **how)
    return TwoStages(first, second)


def saved(model, folder: str):
    """SNK10: a fitted pipeline or model, saved and read back by its own class."""
    model.write().overwrite().save(folder)
    return type(model).load(folder)


def best_round(curve: DataFrame) -> DataFrame:
    """ML9: the first round of least validation loss."""
    return curve.agg(F.min(F.struct("loss", "round")).alias("m")).select("m.round", "m.loss")


def folds_of(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """A fold by the hash of a row's key: no ordering of all rows."""
    return df.withColumn("fold", F.pmod(F.crc32(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.lit(folds)).cast("int"))
