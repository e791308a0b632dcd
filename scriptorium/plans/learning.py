"""Queries of regressors and classifiers over the embeddings."""

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scriptorium.operators import kernels as K
from scriptorium.operators import learning as L
from scriptorium.operators import searching as H
from scriptorium.session import shared_dir, table
from scriptorium.sources import writers as O

from .base import query, r6


def data(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("y", (F.col("label") % 6).cast("double"))
    return L.folds_of(L.vectors(e, "embedding", "y"), "vec_id").select("vec_id", "features", "label", "weight", "fold")


def _scored(model, test):
    return L.clipped(model.transform(test)).select("vec_id", r6("prediction"), "rounded")


@query("ml1_ridge")
def ml1(spark, sf):
    d = data(spark, sf)
    return _scored(L.ridge().fit(L.balanced(d.filter("fold <> 0"))), d.filter("fold = 0"))


@query("ml2_forest")
def ml2(spark, sf):
    d = data(spark, sf)
    return _scored(L.forest(20, 6).fit(d.filter("fold <> 0")), d.filter("fold = 0"))


@query("ml3_boosted")
def ml3(spark, sf):
    d = data(spark, sf)
    return _scored(L.boosted(8, 3).fit(d.filter("fold <> 0")), d.filter("fold = 0"))


@query("ml5_bayes")
def ml5(spark, sf):
    d = data(spark, sf)
    return L.bayes().fit(L.balanced(d.filter("fold <> 0"))).transform(d.filter("fold = 0")).select("vec_id", F.col("prediction").cast("int").alias("predicted"))


@query("ml6_search")
def ml6(spark, sf):
    _, errors = L.searched(data(spark, sf), L.forest(10, 4), {"maxDepth": [2, 4]}, folds=3)
    return spark.createDataFrame([(s["maxDepth"], float(e)) for s, e in errors], "depth int, mse double")


@query("ml7_weights", "SELECT label, count(*) AS n, round(sum(CASE WHEN vec_id % 4 = 0 THEN 200 ELSE 1 END), 6)::DOUBLE AS weight FROM (SELECT vec_id, label % 6 AS label FROM embeddings) GROUP BY label")
def ml7(spark, sf):
    d = data(spark, sf)
    rows = L.joined_training(d.filter("vec_id % 4 = 0"), d.filter("vec_id % 4 <> 0"))
    return rows.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), r6(F.sum("weight"), "weight"))


@query("ml8_ablation")
def ml8(spark, sf):
    d = data(spark, sf)
    return L.ablation(d.filter("fold <> 0"), d.filter("fold = 0"), {"first": (0, 32), "second": (32, 32)}, lambda seed: L.forest(5, 3, seed), (40, 41))


@query("ml9_two_stage", "WITH r AS (SELECT min(embedding[1]) AS a, max(embedding[1]) AS b FROM embeddings WHERE vec_id % 4 <> 0) SELECT vec_id, round((embedding[1]::DOUBLE - a) / (b::DOUBLE - a), 4) AS first FROM embeddings, r WHERE vec_id % 4 = 0")
def ml9(spark, sf):
    d = data(spark, sf)
    return L.scaled_by(d.filter("vec_id % 4 <> 0"), d.filter("vec_id % 4 = 0")).select("vec_id", F.round(vector_to_array("features")[0], 4).alias("first"))


@query("ml9b_best_round", "WITH c AS (SELECT l_linenumber AS round, avg(l_discount) AS loss FROM lineitem GROUP BY ALL) SELECT arg_min(round, (loss, round)) AS round, round(min(loss), 6) AS loss FROM c")
def ml9b(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("round")).agg(F.avg("l_discount").alias("loss"))
    return L.best_round(c).select("round", r6("loss"))


def curved(spark, sf):
    """Embeddings with a label that isn't linear in them."""
    x = lambda k: F.col("embedding")[k].cast("double")
    e = table(spark, sf, "embeddings").withColumn("y", F.abs(x(0)) * 8 + F.pow(x(1) * 5, 2))
    return L.folds_of(L.vectors(e.withColumn("embedding", F.slice("embedding", 1, 4)), "embedding", "y"), "vec_id").select("vec_id", "features", "label", "weight", "fold")


@query("ml4_kernel_regression")
def ml4(spark, sf):
    d = curved(spark, sf)
    return K.fit(d.filter("fold <> 0"), "vec_id", c=1e4, landmarks=200).transform(d.filter("fold = 0")).select("vec_id", r6("label"), r6("prediction"))


@query("ml6b_parzen_search")
def ml6b(spark, sf):
    d = curved(spark, sf)
    study = H.Study({"reg": H.Real(1e-4, 10.0, log=True), "net": H.Choice((0.0, 0.5))}, startup=3)
    study.run(H.fold_loss(d, lambda s: L.LinearRegression(weightCol="weight", regParam=s["reg"], elasticNetParam=s["net"]), 2), 6)
    return study.table(spark).select("trial", F.col("setting")["reg"].alias("reg"), F.col("setting")["net"].alias("net"), r6("loss"))


@query("ml9c_stopped_early")
def ml9c(spark, sf):
    """The loss on the validation fold after each round, and the round that is kept."""
    d = curved(spark, sf)
    model, curve = L.stopped_early(d.filter("fold > 1"), d.filter("fold = 1"), rounds=8, depth=2, rate=0.5)
    return curve.select("round", r6("loss"), (F.col("round") == len(model.trees)).alias("kept"))


@query("snk10b_saved_model", "SELECT count(*) AS rows, 0.0::DOUBLE AS largest, true AS equal FROM embeddings")
def snk10b(spark, sf):
    """A fitted pipeline, saved in the shared folder, read back and compared row by row."""
    d = data(spark, sf)
    model = L.ridge().fit(d.filter("fold <> 0"))
    again = L.saved(model, f"{shared_dir(spark)}/model-{uuid.uuid4().hex}")
    said = lambda m, name: m.transform(d).select("vec_id", F.col("prediction").alias(name))
    return O.parity(said(model, "a"), said(again, "b"), "vec_id", "a", "b")
