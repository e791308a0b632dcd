"""Queries of the evaluation family."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.operators import metrics as M
from scriptorium.session import table

from .base import PREDICTIONS, predictions, query, r6

LAB = "CAST(least(greatest(round_even(p, 0), 0), 5) AS INTEGER)"
CELLS = f"WITH {PREDICTIONS}, cells AS (SELECT model, split, y AS t, {LAB} AS p, count(*) AS n FROM preds GROUP BY ALL)"
KEYS = ["model", "split"]
HEAD = "round(avg(({p} - y) * ({p} - y)), 6) AS mse, round(avg(CAST({lab} = y AS INTEGER)), 6) AS accuracy"
PER = """per AS (SELECT g.model, g.split, CAST(g.label AS INTEGER) AS label,
  coalesce(sum(CASE WHEN t = g.label AND p = g.label THEN n END), 0) AS tp, coalesce(sum(CASE WHEN t = g.label THEN n END), 0) AS support, coalesce(sum(CASE WHEN p = g.label THEN n END), 0) AS said
  FROM (SELECT DISTINCT model, split, label FROM cells, range(6) r(label)) g JOIN cells c ON c.model = g.model AND c.split = g.split GROUP BY ALL),
pl AS (SELECT model, split, label, coalesce(tp / nullif(said, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(said + support, 0)::DOUBLE, 0) AS f1, CAST(support AS BIGINT) AS support FROM per)"""


def cells(spark, sf):
    return M.confusion(predictions(spark, sf), KEYS)


@query("evl1_round_to_label", f"WITH {PREDICTIONS} SELECT id, {LAB} AS label FROM preds")
def evl1(spark, sf):
    return predictions(spark, sf).select("id", M.to_label(F.col("p")).alias("label"))


@query("evl2_metric_bundle", f"WITH {PREDICTIONS} SELECT model, split, count(*) AS n, {HEAD.format(p='p', lab=LAB)}, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(corr(y, p), 6) AS corr FROM preds GROUP BY ALL")
def evl2(spark, sf):
    return M.headline(predictions(spark, sf), KEYS).select(*KEYS, "n", r6("mse"), r6("accuracy"), r6("rmse"), r6("corr"))


@query("evl3_rounded_bundle", f"WITH {PREDICTIONS} SELECT model, split, {HEAD.format(p=LAB, lab=LAB)} FROM preds GROUP BY ALL")
def evl3(spark, sf):
    return M.headline(predictions(spark, sf), KEYS, True).select(*KEYS, r6("mse"), r6("accuracy"))


@query("evl4_raw_mse_bundle", f"WITH {PREDICTIONS} SELECT model, {HEAD.format(p='p', lab=LAB)} FROM preds GROUP BY ALL")
def evl4(spark, sf):
    return M.headline(predictions(spark, sf), ["model"]).select("model", r6("mse"), r6("accuracy"))


@query("evl5_mean_over_seeds", f"""WITH {PREDICTIONS}, runs AS (SELECT model, split, seed, avg((p - y) * (p - y)) AS mse, count(*) AS support, CASE WHEN seed < 7 THEN corr(y, p) END AS corr FROM preds GROUP BY model, split, seed)
SELECT model, split, round(avg(mse), 6) AS mse, CAST(sum(support) AS BIGINT) AS support, round(CASE WHEN count(corr) = count(*) THEN avg(corr) END, 6) AS corr FROM runs GROUP BY ALL""")
def evl5(spark, sf):
    runs = M.headline(predictions(spark, sf), [*KEYS, "seed"]).withColumn("corr", F.when(F.col("seed") < 7, F.col("corr")))
    return M.mean_bundles(runs.withColumnRenamed("n", "support"), KEYS, ["mse"], ["support"], ["corr"]).select(*KEYS, r6("mse"), "support", r6("corr"))


@query("evl6_confusion_grid", f"{CELLS} SELECT g.model, g.split, CAST(g.t AS INTEGER) AS t, CAST(g.p AS INTEGER) AS p, coalesce(n, 0) AS n FROM (SELECT DISTINCT model, split, a.t, b.p FROM cells, range(6) a(t), range(6) b(p)) g LEFT JOIN cells c ON g.model = c.model AND g.split = c.split AND g.t = c.t AND g.p = c.p")
def evl6(spark, sf):
    return M.grid(cells(spark, sf), KEYS)


@query("evl7_relaxed", f"{CELLS}, r AS (SELECT model, split, t // 2 AS t, p // 2 AS p, sum(n) AS n FROM cells GROUP BY ALL) SELECT model, split, CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN t = p THEN n ELSE 0 END) / sum(n), 6) AS accuracy, round(sum((t - p) * (t - p) * n) / sum(n), 6) AS mse FROM r GROUP BY ALL")
def evl7(spark, sf):
    return M.from_cells(M.relaxed(cells(spark, sf), KEYS), KEYS).select(*KEYS, "n", r6("accuracy"), r6("mse"))


@query("evl8_neighbours_right", f"{CELLS} SELECT model, split, round(sum(CASE WHEN abs(t - p) <= 1 THEN n ELSE 0 END) / sum(n), 6) AS accuracy FROM cells GROUP BY ALL")
def evl8(spark, sf):
    return M.from_cells(M.neighbours_right(cells(spark, sf), KEYS), KEYS).select(*KEYS, r6("accuracy"))


@query("evl9_from_confusion", f"{CELLS} SELECT model, split, CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN t = p THEN n ELSE 0 END) / sum(n), 6) AS accuracy, round(sum((t - p) * (t - p) * n) / sum(n), 6) AS mse FROM cells GROUP BY ALL")
def evl9(spark, sf):
    return M.from_cells(cells(spark, sf), KEYS).select(*KEYS, "n", r6("accuracy"), r6("mse"))


@query("evl10_per_label", f"{CELLS}, {PER} SELECT model, split, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pl")
def evl10(spark, sf):
    return M.per_label(cells(spark, sf), KEYS).select(*KEYS, "label", r6("precision"), r6("recall"), r6("f1"), "support")


@query("evl11_f1_means", f"{CELLS}, {PER} SELECT model, split, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM pl GROUP BY ALL")
def evl11(spark, sf):
    return M.f1_means(M.per_label(cells(spark, sf), KEYS), KEYS).select(*KEYS, r6("f1_macro"), r6("f1_weighted"))


@query("evl12_comparison_table", f"""WITH {PREDICTIONS}, m AS (SELECT model, sqrt(avg(CASE WHEN split = 'train' THEN (p - y) * (p - y) END)) AS rmse_train, sqrt(avg(CASE WHEN split = 'test' THEN (p - y) * (p - y) END)) AS rmse_test,
  avg(CASE WHEN split = 'test' THEN CAST({LAB} = y AS INTEGER) END) AS acc_test FROM preds GROUP BY ALL)
SELECT model, round(rmse_train, 6) AS rmse_train, round(rmse_test, 6) AS rmse_test, round(acc_test, 6) AS acc_test, coalesce(abs(rmse_test - min(rmse_test) OVER ()) <= 1e-6 + 1e-5 * min(rmse_test) OVER (), false) AS best_rmse, coalesce(abs(acc_test - max(acc_test) OVER ()) <= 1e-6 + 1e-5 * max(acc_test) OVER (), false) AS best_acc FROM m""")
def evl12(spark, sf):
    m = M.headline(predictions(spark, sf), KEYS).groupBy("model").pivot("split", ["train", "test"]).agg(F.first("rmse").alias("rmse"), F.first("accuracy").alias("acc"))
    t = m.select("model", F.col("train_rmse").alias("rmse_train"), F.col("test_rmse").alias("rmse_test"), F.col("test_acc").alias("acc_test"))
    return t.select("model", r6("rmse_train"), r6("rmse_test"), r6("acc_test"), F.coalesce(M.best_marked(t, "rmse_test", True), F.lit(False)).alias("best_rmse"), F.coalesce(M.best_marked(t, "acc_test", False), F.lit(False)).alias("best_acc"))


@query("evl13_latest_per_seed", """SELECT key, seed, timestamp, id FROM (SELECT *, row_number() OVER (PARTITION BY key, seed ORDER BY timestamp DESC, id DESC) AS rn FROM
 (SELECT event_type AS key, CAST(user_id % 5 AS BIGINT) AS seed, strftime(ts, '%Y-%m-%d-%H-%M-%S') || '-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS timestamp, event_id AS id FROM events)) WHERE rn = 1""")
def evl13(spark, sf):
    files = table(spark, sf, "events").select(F.col("event_type").alias("key"), (F.col("user_id") % 5).alias("seed"), F.concat(F.date_format("ts", "yyyy-MM-dd-HH-mm-ss"), F.lit("-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("timestamp"), F.col("event_id").alias("id"))
    return M.latest_per_seed(files)


@query("evl14_cross_seed", f"""WITH {PREDICTIONS}, runs AS (SELECT model, split, seed, avg((p - y) * (p - y)) AS mse, count(DISTINCT y) AS labels FROM preds GROUP BY ALL)
SELECT model, split, round(avg(mse), 6) AS mse, count(*) AS seeds, count(DISTINCT labels) = 1 AS compatible FROM runs GROUP BY ALL""")
def evl14(spark, sf):
    runs = predictions(spark, sf).groupBy(*KEYS, "seed").agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("mse"), F.countDistinct("y").alias("labels"))
    return runs.groupBy(*KEYS).agg(r6(F.avg("mse"), "mse"), F.count("*").alias("seeds"), (F.countDistinct("labels") == 1).alias("compatible"))


@query("evl15_by_model", f"WITH {PREDICTIONS}, f AS (SELECT model, seed % 5 AS fold, avg((p - y) * (p - y)) AS mse FROM preds GROUP BY ALL) SELECT model, round(avg(mse), 6) AS mse, round(stddev_pop(mse), 6) AS spread FROM f GROUP BY ALL")
def evl15(spark, sf):
    folds = M.headline(predictions(spark, sf).withColumn("fold", F.col("seed") % 5), ["model", "fold"])
    return folds.groupBy("model").agg(r6(F.avg("mse"), "mse"), r6(F.stddev_pop("mse"), "spread"))


@query("evl16_model_order", "WITH o(model, base) AS (VALUES ('R', 0), ('A', 1)) SELECT l_returnflag AS model, count(*) AS n, CAST(row_number() OVER (ORDER BY coalesce(base, 99), l_returnflag) AS INTEGER) AS place FROM lineitem LEFT JOIN o ON l_returnflag = model GROUP BY l_returnflag, base")
def evl16(spark, sf):
    order = spark.createDataFrame([("R", 0), ("A", 1)], "model string, base int")
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.count("*").alias("n")).join(order, "model", "left")
    return m.select("model", "n", F.row_number().over(W.orderBy(F.coalesce("base", F.lit(99)), "model")).alias("place"))


CURVES = "SELECT l_returnflag AS model, l_linenumber AS fold, CAST(date_part('month', l_shipdate) AS INTEGER) AS epoch, round(avg(l_discount), 4) AS loss FROM lineitem GROUP BY ALL"


@query("evl17_best_epoch", f"WITH c AS ({CURVES}) SELECT model, fold, epoch, loss FROM c QUALIFY row_number() OVER (PARTITION BY model, fold ORDER BY loss, epoch) = 1")
def evl17(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold"), F.month("l_shipdate").alias("epoch")).agg(F.round(F.avg("l_discount"), 4).alias("loss"))
    return M.best_epoch(c, ["model", "fold"])


@query("evl18_ablation", f"WITH {PREDICTIONS}, r AS (SELECT model AS grp, seed, avg((p - y) * (p - y)) AS mse FROM preds GROUP BY ALL) SELECT r.grp, count(*) AS seeds, round(avg(r.mse - b.mse), 6) AS delta, round(coalesce(2 * stddev_samp(r.mse - b.mse), 0), 6) AS spread FROM r JOIN r b ON r.seed = b.seed AND b.grp = 'N' WHERE r.grp <> 'N' GROUP BY r.grp")
def evl18(spark, sf):
    runs = M.headline(predictions(spark, sf), ["model", "seed"]).withColumnRenamed("model", "grp")
    return M.ablation(runs, "N").select("grp", "seeds", r6("delta"), r6("spread"))


@query("evl19_spearman", f"""WITH {PREDICTIONS}, k AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS b FROM preds)
SELECT model, count(*) AS n, round(corr(a, b), 6) AS spearman FROM k GROUP BY ALL""")
def evl19(spark, sf):
    return M.spearman(predictions(spark, sf), ["model"]).select("model", "n", r6("spearman"))


@query("evl20_error_rate", "SELECT event_type, round(100.0::DOUBLE * count(*) FILTER (event_id % 9 = 0) / count(*), 6) AS error_rate FROM events GROUP BY ALL")
def evl20(spark, sf):
    out = F.when(F.col("event_id") % 9 != 0, F.col("value"))
    return table(spark, sf, "events").groupBy("event_type").agg(r6(F.coalesce(F.try_divide(100.0 * F.count_if(out.isNull()), F.count("*")), F.lit(0.0)), "error_rate"))


@query("evl21_seed_averages", "WITH r AS (SELECT event_type AS model, user_id % 3 AS dataset, user_id % 5 AS seed, avg(value) AS score, count(*) FILTER (event_id % 9 = 0) AS errors, count(*) AS samples FROM events GROUP BY ALL) SELECT model, dataset, round(avg(score), 6) AS score, CAST(sum(errors) AS BIGINT) AS errors, arg_min(samples, seed) AS samples FROM r GROUP BY ALL")
def evl21(spark, sf):
    r = table(spark, sf, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("dataset"), (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("score"), F.count_if(F.col("event_id") % 9 == 0).alias("errors"), F.count("*").alias("samples"))
    return r.groupBy("model", "dataset").agg(r6(F.avg("score"), "score"), F.sum("errors").alias("errors"), F.min_by("samples", "seed").alias("samples"))


@query("evl22_last_wins_pivot", "SELECT user_id % 20 AS config, arg_max(value, event_id) FILTER (event_type = 'click') AS train, coalesce(arg_max(value, event_id) FILTER (event_type = 'view'), arg_max(value, event_id) FILTER (event_type = 'error')) AS test FROM events GROUP BY ALL")
def evl22(spark, sf):
    pick = lambda kind: F.max_by("value", F.when(F.col("event_type") == kind, F.col("event_id")))
    return table(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("config")).agg(pick("click").alias("train"), F.coalesce(pick("view"), pick("error")).alias("test"))


@query("evl23_combined_correlation", f"WITH {PREDICTIONS} SELECT model, round(corr(y, p), 6) AS corr FROM (SELECT * FROM preds WHERE split = 'train' UNION ALL SELECT * FROM preds WHERE split = 'test') GROUP BY ALL")
def evl23(spark, sf):
    p = predictions(spark, sf)
    both = p.filter("split = 'train'").unionByName(p.filter("split = 'test'"))
    return M.headline(both, ["model"]).select("model", r6("corr"))


@query("evl24_best_per_config", f"WITH {PREDICTIONS}, c AS (SELECT model, seed, corr(y, p) AS corr FROM preds GROUP BY ALL), b AS (SELECT seed, max(corr) AS corr FROM c GROUP BY ALL) SELECT seed, round(corr, 6) AS corr, CAST(row_number() OVER (ORDER BY corr DESC NULLS LAST, seed) AS INTEGER) AS place FROM b")
def evl24(spark, sf):
    b = M.headline(predictions(spark, sf), ["model", "seed"]).groupBy("seed").agg(F.max("corr").alias("corr"))
    return b.select("seed", r6("corr"), F.row_number().over(W.orderBy(F.desc_nulls_last("corr"), "seed")).alias("place"))


@query("evl25_pivot_with_average", f"WITH {PREDICTIONS}, c AS (SELECT model, seed, corr(y, p) AS corr FROM preds GROUP BY ALL) SELECT coalesce(CAST(seed AS VARCHAR), 'AVG') AS config, " + ", ".join(f"round(avg(corr) FILTER (model = '{m}'), 6) AS corr_{m.lower()}" for m in "ANR") + " FROM c GROUP BY ROLLUP (seed)")
def evl25(spark, sf):
    c = M.headline(predictions(spark, sf), ["model", "seed"])
    return c.rollup("seed").agg(*[r6(F.avg(F.when(F.col("model") == m, F.col("corr"))), f"corr_{m.lower()}") for m in "ANR"]).select(F.coalesce(F.col("seed").cast("string"), F.lit("AVG")).alias("config"), *[f"corr_{m}" for m in "anr"])


@query("evl26_model_correlations", "WITH v AS (SELECT event_type AS model, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos, value FROM events) SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, round(corr(a.value, b.value), 6) AS corr FROM v a JOIN v b USING (pos) GROUP BY ALL")
def evl26(spark, sf):
    v = table(spark, sf, "events").select(F.col("event_type").alias("model"), F.row_number().over(W.partitionBy("event_type").orderBy("event_id")).alias("pos"), "value")
    a, b = v.select("pos", F.col("model").alias("model_a"), F.col("value").alias("x")), v.select("pos", F.col("model").alias("model_b"), F.col("value").alias("z"))
    return a.join(b, "pos").groupBy("model_a", "model_b").agg(F.count("*").alias("n"), r6(M.pearson("x", "z"), "corr"))


@query("evl27_selected_vs_others", "WITH m AS (SELECT event_type AS model, avg(value) AS v FROM events GROUP BY ALL) SELECT round(max(v) FILTER (model = 'click'), 6) AS selected, round(avg(v) FILTER (model <> 'click'), 6) AS others, round(max(v) FILTER (model = 'click') - avg(v) FILTER (model <> 'click'), 6) AS delta FROM m")
def evl27(spark, sf):
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("v"))
    mine, rest = F.max(F.when(F.col("model") == "click", F.col("v"))), F.avg(F.when(F.col("model") != "click", F.col("v")))
    return m.agg(r6(mine, "selected"), r6(rest, "others"), r6(mine - rest, "delta"))


@query("evl28_relaxed_f1", f"{CELLS}, r AS (SELECT model, split, t // 2 AS t, p // 2 AS p, sum(n) AS n FROM cells GROUP BY ALL), q AS (SELECT * FROM cells), z AS (SELECT g.model, g.label, coalesce(sum(CASE WHEN t = g.label AND p = g.label THEN n END), 0) AS tp, coalesce(sum(CASE WHEN t = g.label THEN n END), 0) AS s, coalesce(sum(CASE WHEN p = g.label THEN n END), 0) AS d FROM (SELECT DISTINCT model, label FROM r, range(3) x(label)) g JOIN r ON r.model = g.model GROUP BY ALL) SELECT model, round(sum(coalesce(2 * tp / nullif(s + d, 0)::DOUBLE, 0) * s) / sum(s), 6) AS f1_weighted FROM z GROUP BY ALL")
def evl28(spark, sf):
    r = M.relaxed(M.confusion(predictions(spark, sf), ["model"]), ["model"])
    return M.f1_means(M.per_label(r, ["model"], 3), ["model"]).select("model", r6("f1_weighted"))


@query("evl29_best_per_plan", f"WITH {PREDICTIONS}, c AS (SELECT model, seed, corr(y, p) AS corr, sqrt(avg((p - y) * (p - y))) AS rmse FROM preds GROUP BY ALL), plan(plan, prefix) AS (VALUES ('a', 'A'), ('n', 'N'), ('all', '')) SELECT plan, round(max(corr), 6) AS corr, round(min(rmse), 6) AS rmse FROM plan JOIN c ON starts_with(model, prefix) GROUP BY ALL")
def evl29(spark, sf):
    plan = spark.createDataFrame([("a", "A"), ("n", "N"), ("all", "")], "plan string, prefix string")
    c = M.headline(predictions(spark, sf), ["model", "seed"])
    return c.join(F.broadcast(plan), F.startswith(c["model"], F.col("prefix"))).groupBy("plan").agg(r6(F.max("corr"), "corr"), r6(F.min("rmse"), "rmse"))


@query("evl30_search_loss", "SELECT user_id % 10 AS trial, round(avg(coalesce((event_id % 6 - user_id % 6) * (event_id % 6 - user_id % 6), 25)) FILTER (true), 6) AS loss FROM (SELECT user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS event_id FROM events) GROUP BY ALL")
def evl30(spark, sf):
    p = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 6)
    return table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("trial")).agg(r6(F.avg(F.coalesce(F.pow(p - F.col("user_id") % 6, F.lit(2.0)), F.lit(25.0))), "loss"))


@query("evl31_model_size", "SELECT DISTINCT p_type, CASE WHEN size % 3 = 0 THEN 50 ELSE size END AS size FROM (SELECT p_type || CASE WHEN p_size % 3 = 0 THEN '' ELSE '-' || p_size || 'b' END AS p_type, CAST(p_size AS INTEGER) AS size FROM part)")
def evl31(spark, sf):
    name = F.concat("p_type", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit("b"))))
    named = table(spark, sf, "part").select(name.alias("p_type"))
    return named.select("p_type", F.coalesce(F.regexp_extract("p_type", r"-(\d+)b?$", 1).try_cast("int"), F.lit(50)).alias("size")).distinct()


@query("evl32_top_trials", "SELECT event_id, value FROM events WHERE event_type <> 'error' ORDER BY value, event_id LIMIT 20")
def evl32(spark, sf):
    return table(spark, sf, "events").filter("event_type <> 'error'").select("event_id", "value").orderBy("value", "event_id").limit(20)


@query("evl33_methods_combined", f"WITH {PREDICTIONS}, m AS (SELECT model, round(avg((p - y) * (p - y)), 6) AS mse FROM preds GROUP BY ALL) SELECT 0 AS ord, 'random' AS name, CAST(NULL AS DOUBLE) AS mse UNION ALL SELECT 1, 'encoder ' || model, mse FROM m WHERE model = 'A' UNION ALL SELECT 2, 'llm ' || model, mse FROM m WHERE model <> 'A'")
def evl33(spark, sf):
    m = M.headline(predictions(spark, sf), ["model"]).select("model", r6("mse"))
    part = lambda ord, label, cond: m.filter(cond).select(F.lit(ord).alias("ord"), F.concat(F.lit(label), "model").alias("name"), "mse")
    head = spark.range(1).select(F.lit(0).alias("ord"), F.lit("random").alias("name"), F.lit(None).cast("double").alias("mse"))
    return head.unionByName(part(1, "encoder ", "model = 'A'")).unionByName(part(2, "llm ", "model <> 'A'"))


@query("evl34_step_to_epoch", "WITH b AS (SELECT CAST(date_part('month', l_shipdate) AS INTEGER) AS epoch, count(*) AS batches FROM lineitem GROUP BY ALL), c AS (SELECT epoch, batches, sum(batches) OVER (ORDER BY epoch) AS done FROM b), s AS (SELECT DISTINCT l_partkey AS step FROM lineitem) SELECT step, round(epoch + (step - (done - batches)) / batches::DOUBLE, 6) AS epoch FROM s JOIN c ON step >= done - batches AND step < done")
def evl34(spark, sf):
    b = table(spark, sf, "lineitem").groupBy(F.month("l_shipdate").alias("epoch")).agg(F.count("*").alias("batches"))
    c = F.broadcast(b.withColumn("done", F.sum("batches").over(W.orderBy("epoch"))))  # a row per epoch
    s = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("step")).distinct()
    return s.join(c, (F.col("step") >= F.col("done") - F.col("batches")) & (F.col("step") < F.col("done"))).select("step", r6(F.col("epoch") + (F.col("step") - (F.col("done") - F.col("batches"))) / F.col("batches"), "epoch"))


@query("evl35_label_accuracy", f"{CELLS}, {PER} SELECT model, split, label, round(CASE WHEN support > 0 THEN recall END, 6) AS accuracy FROM pl")
def evl35(spark, sf):
    return M.per_label(cells(spark, sf), KEYS).select(*KEYS, "label", F.when(F.col("support") > 0, F.round("recall", 6)).alias("accuracy"))


@query("evl36_row_normalised", f"{CELLS} SELECT model, split, t, p, round(n / sum(n) OVER (PARTITION BY model, split, t), 6) AS share FROM cells")
def evl36(spark, sf):
    return M.normalised(cells(spark, sf), KEYS).select(*KEYS, "t", "p", r6("share"))
