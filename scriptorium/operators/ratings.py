"""Agreement between annotators over long ratings: ``task, annotator, rating[, lead_time]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def adjusted_rating(rating: Column, visual_actions: Column) -> Column:
    """AGR1: the rating as an integer (null if it is none), one more (5 at most) if any visual
    action says true."""
    number = rating.try_cast("int")
    said = F.exists(F.coalesce(visual_actions, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)) == "true")
    return F.when(said & number.isNotNull(), F.least(number + 1, F.lit(5))).otherwise(number)


def first_per_alias(annotations: DataFrame, aliases: dict[int, int], order: str = "ann_pos") -> DataFrame:
    """AGR2: annotators under their alias, and the first rating of each (task, alias); rows without
    annotator or rating are left out before."""
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    alias = F.coalesce(F.element_at(F.create_map(*pairs), F.col("annotator")), F.col("annotator")) if pairs else F.col("annotator")
    known = annotations.filter("annotator IS NOT NULL AND rating IS NOT NULL").withColumn("annotator", alias)
    rank = F.row_number().over(W.partitionBy("task", "annotator").orderBy(order))
    return known.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def pairs(ratings: DataFrame) -> DataFrame:
    """JN7: ratings of the same task by two annotators, ``ann_a < ann_b``."""
    a = ratings.select("task", F.col("annotator").alias("ann_a"), F.col("rating").alias("a"), *([F.col("lead_time").alias("lead_a")] if "lead_time" in ratings.columns else []))
    b = ratings.select("task", F.col("annotator").alias("ann_b"), F.col("rating").alias("b"), *([F.col("lead_time").alias("lead_b")] if "lead_time" in ratings.columns else []))
    return a.join(b, "task").filter("ann_a < ann_b")


def weight(a: Column, b: Column, k: int) -> Column:
    """AGR4: quadratic weight of two categories out of ``k``."""
    return F.lit(1.0) - F.pow(a - b, F.lit(2.0)) / float((k - 1) ** 2 or 1)


def weight_matrix(spark, k: int) -> DataFrame:
    grid = spark.range(k)
    return grid.select(F.col("id").cast("int").alias("i")).crossJoin(grid.select(F.col("id").cast("int").alias("j"))).withColumn("weight", weight(F.col("i"), F.col("j"), k))


def cells(pair: DataFrame) -> DataFrame:
    """Counts of each pair of ratings; everything after works on these at most k * k rows a pair."""
    return pair.groupBy("ann_a", "ann_b", "a", "b").agg(F.count("*").alias("n"))


def pairwise_kappa(ratings: DataFrame, k: int = 6) -> DataFrame:
    """AGR3, AGR5, AGR7: per pair of annotators the number of shared tasks, percent agreement and
    quadratically weighted kappa (null where the expected agreement is 1)."""
    valid = F.assert_true(F.col("rating").between(0, k - 1), F.lit("a rating is outside its scale"))
    cell = cells(pairs(ratings.withColumn("__ok", valid).filter("__ok IS NULL").drop("__ok")))
    key = ["ann_a", "ann_b"]
    observed = cell.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"), F.sum(weight(F.col("a"), F.col("b"), k) * F.col("n")).alias("w"))
    rows = cell.groupBy(*key, "a").agg(F.sum("n").alias("na"))
    cols = cell.groupBy(*key, "b").agg(F.sum("n").alias("nb"))
    expected = rows.join(cols, key).groupBy(*key).agg(F.sum(weight(F.col("a"), F.col("b"), k) * F.col("na") * F.col("nb")).alias("e"))
    o, e = F.col("w") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return observed.join(expected, key).select(*key, "n", (F.col("agree") / F.col("n")).alias("agreement"), F.when(F.abs(1 - e) < 1e-12, None).otherwise(F.try_divide(o - e, 1 - e)).alias("kappa"))


def category_f1(pair: DataFrame, k: int = 6) -> DataFrame:
    """AGR6: F1 of each category over the full scale; null for one that nobody used."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("category")
    long = pair.select("ann_a", "ann_b", "a", "b", grid)
    tp = F.sum((F.col("a") == F.col("category")).cast("int") * (F.col("b") == F.col("category")).cast("int"))
    used = F.sum((F.col("a") == F.col("category")).cast("int") + (F.col("b") == F.col("category")).cast("int"))
    return long.groupBy("ann_a", "ann_b", "category").agg(tp.cast("long").alias("tp"), F.try_divide(2.0 * tp, used.cast("double")).alias("f1"))


def without_outliers(values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """AGR8: rows within 1.5 interquartile ranges; all of groups of under 4 rows or without spread."""
    q = values.groupBy(*keys).agg(F.count(column).alias("__n"), F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    low, high = F.col("__q")[0], F.col("__q")[1]
    keep = (F.col("__n") < 4) | (high - low <= 0) | F.col(column).between(low - 1.5 * (high - low), high + 1.5 * (high - low))
    return values.join(q, keys).filter(keep).drop("__n", "__q")


def pair_lead_times(ratings: DataFrame) -> DataFrame:
    """AGR9: mean lead times of each pair over shared tasks, outliers of each side left out."""
    p = pairs(ratings)
    sides = p.select("ann_a", "ann_b", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("lead_a").alias("lead")), F.struct(F.lit("b").alias("side"), F.col("lead_b").alias("lead")))).alias("x")).select("ann_a", "ann_b", "x.side", "x.lead").filter("lead IS NOT NULL")
    kept = without_outliers(sides, ["ann_a", "ann_b", "side"], "lead")
    return kept.groupBy("ann_a", "ann_b").agg(F.avg(F.when(F.col("side") == "a", F.col("lead"))).alias("lead_a"), F.avg(F.when(F.col("side") == "b", F.col("lead"))).alias("lead_b"), F.avg("lead").alias("lead_both"))


def summary(ratings: DataFrame, k: int = 6) -> DataFrame:
    """AGR10: one row: annotations, filtered mean and total lead time, kappa and agreement weighted by
    the number of shared tasks (pairs without a kappa left out of its mean)."""
    lead = without_outliers(ratings.filter("lead_time IS NOT NULL"), ["annotator"], "lead_time").agg(F.avg("lead_time").alias("mean_lead"), F.sum("lead_time").alias("total_lead"))
    count = ratings.agg(F.count("*").alias("annotations"))
    kappa = pairwise_kappa(ratings, k).agg(F.try_divide(F.sum(F.col("kappa") * F.col("n")), F.sum(F.when(F.col("kappa").isNotNull(), F.col("n")))).alias("kappa"), F.try_divide(F.sum(F.col("agreement") * F.col("n")), F.sum("n")).alias("agreement"))
    return count.crossJoin(lead).crossJoin(kappa)


def agreed(ratings: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """AGR11: the most frequent rating if two annotators gave it; of tied ones the previous agreed
    value if among them, else the least. Without such a rating the previous value, if any."""
    count = ratings.filter("rating IS NOT NULL").groupBy("task", "rating").agg(F.count("*").alias("n"))
    best = count.groupBy("task").agg(F.max("n").alias("most"), F.collect_list(F.struct("n", "rating")).alias("all"))
    tied = F.array_sort(F.transform(F.filter("all", lambda x: (x["n"] == F.col("most")) & (x["n"] >= 2)), lambda x: x["rating"]))
    rows = best.select("task", tied.alias("tied"))
    if previous is not None:
        rows = rows.join(previous.select("task", F.col("agreed_rating").alias("previous")), "task", "left")
    else:
        rows = rows.withColumn("previous", F.lit(None).cast("int"))
    value = F.when(F.size("tied") == 0, F.col("previous")).when(F.array_contains("tied", F.coalesce("previous", F.lit(-1))), F.col("previous")).otherwise(F.array_min("tied"))
    return rows.select("task", value.cast("int").alias("agreed_rating"))


def with_agreed(ratings: DataFrame, agreement: DataFrame, annotator: int) -> DataFrame:
    """AGR12: an annotator's ratings give way to the agreed ones; without one they are dropped."""
    joined = ratings.join(agreement, "task", "left")
    mine = F.col("annotator") == annotator
    return joined.withColumn("rating", F.when(mine, F.col("agreed_rating")).otherwise(F.col("rating"))).filter("rating IS NOT NULL").drop("agreed_rating")


def wide(ratings: DataFrame, most: int | None = None) -> DataFrame:
    """AGR13: a column per annotator in the order of annotators, the first ``most`` of them or all
    (counted in the data). A task stays even if none of these rated it."""
    found = sorted(r["annotator"] for r in ratings.select("annotator").distinct().filter("annotator IS NOT NULL").collect())[:most]
    columns = [F.first(F.when(F.col("annotator") == F.lit(x), F.col("rating")), True).alias(f"annotator_{i}") for i, x in enumerate(found, 1)]
    columns += [F.lit(None).cast(ratings.schema["rating"].dataType).alias(f"annotator_{i}") for i in range(len(found) + 1, (most or 0) + 1)]
    return ratings.groupBy("task").agg(*columns) if columns else ratings.select("task").distinct()


def multi_annotated(ratings: DataFrame, least: int = 2) -> DataFrame:
    """AGR14: tasks with several annotators."""
    return ratings.groupBy("task").agg(F.countDistinct("annotator").alias("annotators")).filter(F.col("annotators") >= least)


def without_annotated(ratings: DataFrame, earlier: DataFrame) -> DataFrame:
    """JN10: tasks that earlier data has with several annotators are left out."""
    return ratings.join(multi_annotated(earlier), "task", "left_anti")
