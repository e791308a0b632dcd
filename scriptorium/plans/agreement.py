"""Queries of the agreement family."""

from pyspark.sql import functions as F

from scriptorium.operators import ratings as R
from scriptorium.session import table

from .base import RATINGS, md5_order, query, r6, ratings

PAIRS = f"""WITH {RATINGS},
pair AS (SELECT a.annotator AS ann_a, b.annotator AS ann_b, a.task, a.rating AS a, b.rating AS b, a.lead_time AS lead_a, b.lead_time AS lead_b
         FROM ratings a JOIN ratings b ON a.task = b.task AND a.annotator < b.annotator)"""

KAPPA = f"""{PAIRS},
obs AS (SELECT ann_a, ann_b, count(*) AS n, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS agreement, avg(1 - (a - b) * (a - b) / 25.0::DOUBLE) AS o FROM pair GROUP BY ALL),
ra AS (SELECT ann_a, ann_b, a, count(*) AS c FROM pair GROUP BY ALL), cb AS (SELECT ann_a, ann_b, b, count(*) AS c FROM pair GROUP BY ALL),
ex AS (SELECT ann_a, ann_b, sum((1 - (a - b) * (a - b) / 25.0::DOUBLE) * ra.c * cb.c) AS e FROM ra JOIN cb USING (ann_a, ann_b) GROUP BY ALL),
kappa AS (SELECT ann_a, ann_b, n, agreement, CASE WHEN abs(1 - e / (n * n)) < 1e-12 THEN NULL ELSE (o - e / (n * n)) / (1 - e / (n * n)) END AS kappa FROM obs JOIN ex USING (ann_a, ann_b))"""

KEPT = """qs AS (SELECT {keys}, count({col}) AS n, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM {of} GROUP BY ALL),
kept AS (SELECT v.* FROM {of} v JOIN qs USING ({keys}) WHERE n < 4 OR q3 - q1 <= 0 OR {col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""


@query("agr1_adjusted_rating", """
WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(event_id % 6 AS VARCHAR) END AS rating, event_type = 'click' AS act FROM events)
SELECT event_id, CAST(CASE WHEN act THEN least(TRY_CAST(rating AS INTEGER) + 1, 5) ELSE TRY_CAST(rating AS INTEGER) END AS INTEGER) AS rating
FROM t WHERE TRY_CAST(rating AS INTEGER) IS NOT NULL""")
def agr1(spark, sf):
    raw = F.when(F.col("event_id") % 7 == 0, "x").otherwise((F.col("event_id") % 6).cast("string"))
    actions = F.array(F.when(F.col("event_type") == "click", F.lit(" True ")).otherwise("no"))
    return table(spark, sf, "events").select("event_id", R.adjusted_rating(raw, actions).alias("rating")).filter("rating IS NOT NULL")


@query("agr2_first_per_alias", """
WITH t AS (SELECT event_id, user_id % 50 AS task, CASE WHEN user_id % 8 = 6 THEN 4 ELSE CAST(user_id % 8 AS BIGINT) END AS annotator, CASE WHEN event_id % 5 <> 4 THEN event_id % 5 END AS rating FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY task, annotator ORDER BY event_id) AS rn FROM t WHERE rating IS NOT NULL)
SELECT task, annotator, rating FROM k WHERE rn = 1""")
def agr2(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 50).alias("task"), (F.col("user_id") % 8).alias("annotator"), F.when(F.col("event_id") % 5 != 4, F.col("event_id") % 5).alias("rating"), F.col("event_id").alias("ann_pos"))
    return R.first_per_alias(rows.withColumn("annotator", F.col("annotator").cast("int")), {6: 4}).select("task", F.col("annotator").cast("long").alias("annotator"), "rating")


@query("agr3_percent_agreement", f"{PAIRS} SELECT ann_a, ann_b, round(avg(CAST(a = b AS INTEGER)), 6) AS agreement FROM pair GROUP BY ALL")
def agr3(spark, sf):
    return R.pairs(ratings(spark, sf)).groupBy("ann_a", "ann_b").agg(r6(F.avg((F.col("a") == F.col("b")).cast("double")), "agreement"))


@query("agr4_quadratic_weights", "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(1 - (i - j) * (i - j) / 25.0::DOUBLE, 6) AS weight FROM range(6) a(i), range(6) b(j)")
def agr4(spark, sf):
    return R.weight_matrix(spark, 6).select("i", "j", r6("weight"))


@query("agr5_weighted_kappa", f"{KAPPA} SELECT ann_a, ann_b, round(kappa, 6) AS kappa FROM kappa WHERE ann_a = 1")
def agr5(spark, sf):
    return R.pairwise_kappa(ratings(spark, sf)).filter("ann_a = 1").select("ann_a", "ann_b", r6("kappa"))


@query("agr6_category_f1", f"""{PAIRS}, g AS (SELECT *, CAST(c AS INTEGER) AS category FROM pair, range(6) r(c))
SELECT ann_a, ann_b, category, CAST(sum(CASE WHEN a = category AND b = category THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       round(2.0::DOUBLE * sum(CASE WHEN a = category AND b = category THEN 1 ELSE 0 END) / nullif(sum((a = category)::INT + (b = category)::INT), 0), 6) AS f1
FROM g GROUP BY ann_a, ann_b, category""")
def agr6(spark, sf):
    return R.category_f1(R.pairs(ratings(spark, sf))).select("ann_a", "ann_b", "category", "tp", r6("f1"))


@query("agr7_pairwise_kappa", f"{KAPPA} SELECT ann_a, ann_b, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa FROM kappa")
def agr7(spark, sf):
    return R.pairwise_kappa(ratings(spark, sf)).select("ann_a", "ann_b", "n", r6("agreement"), r6("kappa"))


@query("agr8_outliers_removed", f"WITH {RATINGS}, {KEPT.format(keys='annotator', col='lead_time', of='ratings')} SELECT annotator, count(*) AS n, round(avg(lead_time), 6) AS mean_lead FROM kept GROUP BY ALL")
def agr8(spark, sf):
    return R.without_outliers(ratings(spark, sf), ["annotator"], "lead_time").groupBy("annotator").agg(F.count("*").alias("n"), r6(F.avg("lead_time"), "mean_lead"))


@query("agr9_pair_lead_times", f"""{PAIRS}, sides AS (SELECT ann_a, ann_b, 'a' AS side, lead_a AS lead FROM pair UNION ALL SELECT ann_a, ann_b, 'b', lead_b FROM pair),
{KEPT.format(keys='ann_a, ann_b, side', col='lead', of='sides')}
SELECT ann_a, ann_b, round(avg(CASE WHEN side = 'a' THEN lead END), 6) AS lead_a, round(avg(CASE WHEN side = 'b' THEN lead END), 6) AS lead_b, round(avg(lead), 6) AS lead_both FROM kept GROUP BY ALL""")
def agr9(spark, sf):
    return R.pair_lead_times(ratings(spark, sf)).select("ann_a", "ann_b", r6("lead_a"), r6("lead_b"), r6("lead_both"))


@query("agr10_summary", f"""{KAPPA}, {KEPT.format(keys='annotator', col='lead_time', of='ratings')}
SELECT (SELECT count(*) FROM ratings) AS annotations, (SELECT round(avg(lead_time), 6) FROM kept) AS mean_lead, (SELECT round(sum(lead_time), 2) FROM kept) AS total_lead,
       round(sum(kappa * n) / sum(CASE WHEN kappa IS NOT NULL THEN n END), 6) AS kappa, round(sum(agreement * n) / sum(n), 6) AS agreement FROM kappa""")
def agr10(spark, sf):
    return R.summary(ratings(spark, sf)).select("annotations", r6("mean_lead"), F.round("total_lead", 2).alias("total_lead"), r6("kappa"), r6("agreement"))


AGREED = """counts AS (SELECT task, rating, count(*) AS n FROM ratings GROUP BY ALL),
tied AS (SELECT task, rating FROM counts QUALIFY n = max(n) OVER (PARTITION BY task) AND n >= 2),
prev AS (SELECT task, CAST(task % 6 AS INTEGER) AS p FROM ratings WHERE task % 3 = 0 GROUP BY task),
agreed AS (SELECT t.task, CASE WHEN count(d.rating) = 0 THEN any_value(p) WHEN bool_or(d.rating = p) THEN any_value(p) ELSE min(d.rating) END AS agreed_rating
           FROM (SELECT DISTINCT task FROM ratings) t LEFT JOIN tied d USING (task) LEFT JOIN prev USING (task) GROUP BY t.task)"""


def _agreed(spark, sf):
    rows = ratings(spark, sf)
    return rows, R.agreed(rows, rows.filter("task % 3 = 0").select("task", (F.col("task") % 6).cast("int").alias("agreed_rating")).distinct())


@query("agr11_agreed_rating", f"WITH {RATINGS}, {AGREED} SELECT task, CAST(agreed_rating AS INTEGER) AS agreed_rating FROM agreed")
def agr11(spark, sf):
    return _agreed(spark, sf)[1]


@query("agr12_with_agreed", f"""WITH {RATINGS}, {AGREED} SELECT task, annotator, CAST(CASE WHEN annotator = 1 THEN agreed_rating ELSE rating END AS INTEGER) AS rating
FROM ratings JOIN agreed USING (task) WHERE annotator <> 1 OR agreed_rating IS NOT NULL""")
def agr12(spark, sf):
    rows, value = _agreed(spark, sf)
    return R.with_agreed(rows, value, 1).select("task", "annotator", "rating")


@query("agr13_wide", f"""WITH {RATINGS} SELECT task, """ + ", ".join(f"max(CASE WHEN annotator = {i} THEN rating END) AS annotator_{i}" for i in range(1, 8)) + " FROM ratings GROUP BY task")
def agr13(spark, sf):
    return R.wide(ratings(spark, sf))


@query("agr14_multi_annotated", f"WITH {RATINGS} SELECT task, count(DISTINCT annotator) AS annotators FROM ratings GROUP BY task HAVING count(DISTINCT annotator) >= 2")
def agr14(spark, sf):
    return R.multi_annotated(ratings(spark, sf))


@query("jn7_annotator_pairs", f"{PAIRS} SELECT ann_a, ann_b, count(*) AS shared FROM pair GROUP BY ALL")
def jn7(spark, sf):
    return R.pairs(ratings(spark, sf)).groupBy("ann_a", "ann_b").agg(F.count("*").alias("shared"))


@query("jn10_earlier_excluded", f"""WITH {RATINGS}, old AS (SELECT task FROM ratings WHERE annotator <= 3 GROUP BY task HAVING count(DISTINCT annotator) >= 2)
SELECT task, annotator, rating FROM ratings WHERE task NOT IN (SELECT task FROM old)""")
def jn10(spark, sf):
    rows = ratings(spark, sf)
    return R.without_annotated(rows, rows.filter("annotator <= 3")).select("task", "annotator", "rating")
