"""Ordinal evaluation: metric bundles, confusion matrices, run aggregation, comparison tables.

Predictions come as ``y`` (label) and ``p`` (raw score) under any key columns. Everything past the
first aggregation works on confusion cells, at most k * k rows per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.session import cut, few

from .ranks import running_sum


def to_label(p: Column, k: int = 6) -> Column:
    """EVL1: rounded half to even and clipped to the scale."""
    return F.least(F.greatest(F.rint(p), F.lit(0.0)), F.lit(float(k - 1))).cast("int")


def safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def pearson(x: str, y: str) -> Column:
    """Correlation from sums; null without spread (``corr`` raises there)."""
    n, sx, sy = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).cast("double"), F.sum(x), F.sum(y)
    cov = n * F.sum(F.col(x) * F.col(y)) - sx * sy
    return F.try_divide(cov, F.sqrt(F.greatest(n * F.sum(F.col(x) * F.col(x)) - sx * sx, F.lit(0.0))) * F.sqrt(F.greatest(n * F.sum(F.col(y) * F.col(y)) - sy * sy, F.lit(0.0))))


def headline(rows: DataFrame, keys: list[str], rounded_mse: bool = False) -> DataFrame:
    """EVL2-4: MSE (of raw or rounded scores), RMSE, accuracy, correlation; all null if a score is
    missing or not a number."""
    label = to_label(F.col("p"))
    error = (label if rounded_mse else F.col("p")) - F.col("y")
    typed = rows.withColumns({"p": F.col("p").cast("double"), "y": F.col("y").cast("double")}).withColumns({"__e": error * error, "__hit": (label == F.col("y")).cast("double")})
    whole = F.sum((F.col("p").isNull() | F.isnan("p")).cast("int")) == 0
    made = typed.groupBy(*keys).agg(F.count("*").alias("n"), F.when(whole, F.avg("__e")).alias("mse"), F.when(whole, F.avg("__hit")).alias("accuracy"), F.when(whole, pearson("y", "p")).alias("corr"))
    return made.withColumn("rmse", F.sqrt("mse"))


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells ``t, p, n`` that occur."""
    return rows.select(*keys, F.col("y").cast("int").alias("t"), to_label(F.col("p")).alias("p")).groupBy(*keys, "t", "p").agg(F.count("*").alias("n"))


def grid(cells: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """EVL6: all k * k cells of every key, missing ones 0, labels beyond the scale cut off."""
    axis = F.sequence(F.lit(0), F.lit(k - 1))
    every = cells.select(*keys).distinct().withColumn("t", F.explode(axis)).withColumn("p", F.explode(axis))
    return every.join(cells, [*keys, "t", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def relaxed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """EVL7: labels collapsed by pairs."""
    return cells.groupBy(*keys, F.floor(F.col("t") / 2).cast("int").alias("t"), F.floor(F.col("p") / 2).cast("int").alias("p")).agg(F.sum("n").alias("n"))


def neighbours_right(cells: DataFrame, keys: list[str]) -> DataFrame:
    """EVL8: cells one off count as right, for their true label."""
    return cells.withColumn("p", F.when(F.abs(F.col("t") - F.col("p")) == 1, F.col("t")).otherwise(F.col("p"))).groupBy(*keys, "t", "p").agg(F.sum("n").alias("n"))


def per_label(cells: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """EVL9-10: precision, recall, F1 and support of each label; 0 where undefined."""
    long = cells.select(*keys, "n", "t", "p", F.explode(F.array_distinct(F.array("t", "p"))).alias("label"))
    sums = long.groupBy(*keys, "label").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a) for a, c in (("tp", (F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))), ("support", F.col("t") == F.col("label")), ("said", F.col("p") == F.col("label")))])
    every = cells.select(*keys).distinct().withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    full = every.join(sums, [*keys, "label"], "left").na.fill(0, ["tp", "support", "said"])
    tp = F.col("tp").cast("double")
    return full.select(*keys, "label", safe(tp, F.col("said")).alias("precision"), safe(tp, F.col("support")).alias("recall"), safe(2 * tp, F.col("said") + F.col("support")).alias("f1"), "support")


def from_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """EVL9: count, accuracy and MSE of confusion cells."""
    n = F.sum("n")
    return cells.groupBy(*keys).agg(n.alias("n"), safe(F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).cast("double"), n).alias("accuracy"), safe(F.sum(F.pow(F.col("t") - F.col("p"), F.lit(2)) * F.col("n")), n).alias("mse"))


def f1_means(labels: DataFrame, keys: list[str]) -> DataFrame:
    """EVL11: macro and support-weighted F1."""
    return labels.groupBy(*keys).agg(F.avg("f1").alias("f1_macro"), safe(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))


def normalised(cells: DataFrame, keys: list[str]) -> DataFrame:
    """EVL36: cells as shares of their true label."""
    total = F.greatest(F.sum("n").over(W.partitionBy(*keys, "t")), F.lit(1))
    return cells.select(*keys, "t", "p", (F.col("n") / total).alias("share"))


def latest_per_seed(files: DataFrame) -> DataFrame:
    """EVL13: of each (key, seed) the run with the last time stamp."""
    rank = F.row_number().over(W.partitionBy("key", "seed").orderBy(F.desc("timestamp")))
    return files.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def mean_bundles(runs: DataFrame, keys: list[str], scalars: list[str], sums: list[str] = (), whole: list[str] = ()) -> DataFrame:
    """EVL5, EVL14-15, EVL21: means that pass over nulls, sums, and means (``whole``) that are null
    unless every run has the value."""
    return runs.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in scalars], *[F.sum(c).alias(c) for c in sums], *[F.when(F.count(c) == F.count("*"), F.avg(c)).alias(c) for c in whole])


def best_epoch(curves: DataFrame, keys: list[str]) -> DataFrame:
    """EVL17: the epoch of the least loss, the first of equal ones."""
    return curves.groupBy(*keys).agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"), F.min("loss").alias("loss"))


def ablation(runs: DataFrame, baseline: str, column: str = "mse") -> DataFrame:
    """EVL18: each group against the baseline of the same seed: mean difference and twice the sample
    deviation (0 for a single seed)."""
    base = runs.filter(F.col("grp") == baseline).select("seed", F.col(column).alias("__base"))
    d = F.col(column) - F.col("__base")
    return runs.filter(F.col("grp") != baseline).join(base, "seed").groupBy("grp").agg(F.count("*").alias("seeds"), F.avg(d).alias("delta"), F.coalesce(2 * F.stddev_samp(d), F.lit(0.0)).alias("spread"))


def weighed_ranks(rows: DataFrame, keys: list[str], column: str, weight: str, name: str) -> DataFrame:
    """Ranks from 1, equal values sharing the mean of theirs; a row stands for ``weight`` equal ones. Rows are summed by value
    first, and the values' sums over range partitions, so no task holds a key's rows."""
    of = [f"of{i}_" for i in range(len(keys))]
    counts = cut(rows.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, of)], F.col(column).alias("value_")).agg(F.sum(weight).alias("same_")))
    upto = running_sum(counts, of, ["value_"], "same_", "upto_")
    ranks = few(cut(upto.select(*of, "value_", (F.col("upto_") - (F.col("same_") - 1) / 2.0).alias(name))))
    same = F.col(column).eqNullSafe(F.col("value_"))
    for k, o in zip(keys, of):
        same &= F.col(k).eqNullSafe(F.col(o))
    return rows.join(ranks, same).select(*rows.columns, name)


def spearman(rows: DataFrame, keys: list[str]) -> DataFrame:
    """EVL19: correlation of ranks over rows that have both values; equal pairs of values are one row with their number."""
    pairs = cut(rows.filter("y IS NOT NULL AND p IS NOT NULL").groupBy(*keys, "y", "p").agg(F.count("*").alias("n_")))
    ranked = pairs
    for column, name in (("y", "ry_"), ("p", "rp_")):
        ranked = weighed_ranks(ranked, keys, column, "n_", name)
    n, x, y, c = F.sum("n_"), F.col("ry_"), F.col("rp_"), F.col("n_")
    s = {k: F.sum(c * v) for k, v in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))}
    spread = F.sqrt(F.greatest(n * s["xx"] - s["x"] * s["x"], F.lit(0.0))) * F.sqrt(F.greatest(n * s["yy"] - s["y"] * s["y"], F.lit(0.0)))
    return ranked.groupBy(*keys).agg(n.alias("n"), F.try_divide(n * s["xy"] - s["x"] * s["y"], spread).alias("spearman"))


def best_marked(table: DataFrame, column: str, low: bool, tolerance: float = 1e-6) -> Column:
    """EVL12: whether a cell is the best of its column, within an absolute and a relative 1e-5."""
    best = (F.min if low else F.max)(column).over(W.partitionBy())
    return F.abs(F.col(column) - best) <= tolerance + 1e-5 * F.abs(best)
