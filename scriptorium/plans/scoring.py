"""Queries of calibration and scoring."""

from pyspark.sql import functions as F

from scriptorium.functions import scorers as P
from scriptorium.functions import text as T
from scriptorium.operators import calibration as K
from scriptorium.session import table

from .base import query, r6

# Scores are discounts of line items, labels the quantity's remainder; order keys make the folds.
PAIRS = "pairs AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_discount * 10 + l_tax AS s, CAST(trunc(l_quantity) AS INTEGER) % 6 AS y, l_orderkey % 5 AS fold FROM lineitem)"


def pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("s"), (F.col("l_quantity").cast("int") % 6).alias("y"), (F.col("l_orderkey") % 5).cast("int").alias("fold"))


@query("cal1_quantile_map", f"""WITH {PAIRS}, tr AS (SELECT * FROM pairs WHERE fold <> 0), n AS (SELECT count(*) AS n FROM tr),
e AS (SELECT s, max(c) AS c FROM (SELECT s, count(*) OVER (ORDER BY s) AS c FROM tr) GROUP BY s), q AS (SELECT DISTINCT s FROM pairs WHERE fold = 0),
a AS (SELECT q.s, coalesce(max(c), 0) / any_value(n.n)::DOUBLE AS q, any_value(n.n) AS n FROM q CROSS JOIN n LEFT JOIN e ON e.s <= q.s GROUP BY q.s),
o AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS k FROM tr)
SELECT a.s, round(lo.y + (hi.y - lo.y) * (a.q * (a.n - 1) - floor(a.q * (a.n - 1))), 6) AS calibrated FROM a JOIN o lo ON lo.k = floor(a.q * (a.n - 1)) JOIN o hi ON hi.k = ceil(a.q * (a.n - 1))""")
def cal1(spark, sf):
    rows = pairs(spark, sf)
    asked = rows.filter("fold = 0").select("s").distinct()
    return K.quantile_map(rows.filter("fold <> 0"), "s", "y").predict(asked, "s").select("s", r6("calibrated"))


@query("cal2_isotonic", f"""WITH {PAIRS}, d AS (SELECT s, sum(y) AS t, count(*) AS n FROM pairs WHERE fold <> 0 GROUP BY s),
c AS (SELECT s, row_number() OVER (ORDER BY s) AS i, sum(t) OVER (ORDER BY s) AS upto, sum(n) OVER (ORDER BY s) AS seen, t, n FROM d),
ab AS (SELECT a.i AS a, b.i AS b, (b.upto - a.upto + a.t)::DOUBLE / (b.seen - a.seen + a.n) AS m FROM c a JOIN c b ON a.i <= b.i),
low AS (SELECT ab.a, c.i, min(m) AS m FROM ab JOIN c ON ab.a <= c.i AND ab.b >= c.i GROUP BY ab.a, c.i),
fit AS (SELECT s, c.i, max(m) AS f FROM c JOIN low ON low.i = c.i GROUP BY s, c.i),
q AS (SELECT DISTINCT s FROM pairs WHERE fold = 0),
near AS (SELECT q.s, coalesce(max(fit.i) FILTER (fit.s <= q.s), 1) AS lo, coalesce(min(fit.i) FILTER (fit.s >= q.s), max(fit.i)) AS hi FROM q, fit GROUP BY q.s),
said AS (SELECT near.s, a.f + CASE WHEN b.s > a.s THEN (b.f - a.f) * (least(greatest(near.s, a.s), b.s) - a.s) / (b.s - a.s) ELSE 0 END AS v FROM near JOIN fit a ON a.i = lo JOIN fit b ON b.i = hi)
SELECT id, round(v, 6) AS calibrated FROM pairs JOIN said USING (s) WHERE fold = 0""")
def cal2(spark, sf):
    rows = pairs(spark, sf)
    return K.isotonic(rows.filter("fold <> 0"), "s", "y").predict(rows.filter("fold = 0"), "s").select("id", r6("calibrated"))


@query("cal3_ordinal")
def cal3(spark, sf):
    rows = pairs(spark, sf)
    return K.ordinal_logistic(rows.filter("fold <> 0"), "s", "y").predict(rows.filter("fold = 0"), "s").select("id", r6("calibrated"))


@query("cal4_fold_comparison")
def cal4(spark, sf):
    out = K.fold_comparison(pairs(spark, sf), ("none", "isotonic", "q2q"), "s", "y")
    return out.select("method", *[r6(c) for c in out.columns if c != "method"])


@query("cal5_uncalibrated_core", f"WITH {PAIRS}, f AS (SELECT fold, avg((s - y) ** 2) AS mse, avg(CAST(least(greatest(round_even(s, 0), 0), 5) = y AS INTEGER)) AS acc FROM pairs GROUP BY fold) SELECT round(avg(mse), 6) AS mse, round(avg(acc), 6) AS accuracy FROM f")
def cal5(spark, sf):
    rows = K.out_of_fold(pairs(spark, sf), "none", "s", "y")
    clip = F.least(F.greatest(F.rint("calibrated"), F.lit(0.0)), F.lit(5.0))
    each = rows.groupBy("fold").agg(F.avg(F.pow(F.col("calibrated") - F.col("y"), 2)).alias("mse"), F.avg((clip == F.col("y")).cast("double")).alias("acc"))
    return each.agg(r6(F.avg("mse"), "mse"), r6(F.avg("acc"), "accuracy"))


@query("cal5b_core_support", f"WITH {PAIRS}, f AS (SELECT fold, y, count(*) AS n FROM pairs GROUP BY ALL), g AS (SELECT y, fold FROM (SELECT DISTINCT y FROM pairs), (SELECT DISTINCT fold FROM pairs)) SELECT y, CAST(trunc(avg(coalesce(n, 0))) AS INTEGER) AS support FROM g LEFT JOIN f USING (y, fold) GROUP BY y")
def cal5b(spark, sf):
    rows = K.out_of_fold(pairs(spark, sf), "isotonic", "s", "y")
    counts = rows.groupBy("y").pivot("fold", [0, 1, 2, 3, 4]).count().na.fill(0)
    return counts.select("y", (sum((F.col(str(k)) for k in range(1, 5)), F.col("0")) / 5).cast("int").alias("support"))


@query("jn16_ecdf_lookup", f"WITH {PAIRS}, tr AS (SELECT s FROM pairs WHERE fold <> 0), q AS (SELECT DISTINCT s FROM pairs WHERE fold = 0) SELECT q.s, (SELECT count(*) FROM tr WHERE tr.s <= q.s) AS upto FROM q")
def jn16(spark, sf):
    rows = pairs(spark, sf)
    asked = rows.filter("fold = 0").select("s").distinct()
    return K.quantile_map(rows.filter("fold <> 0"), "s", "y").lookup(asked).select("s", F.coalesce("upto", F.lit(0)).cast("long").alias("upto"))


@query("scr1_expected_position", """WITH p AS (SELECT l_orderkey, l_linenumber, [l_discount, l_tax, l_quantity / 100] AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN p[1] + p[2] + p[3] <= 0 THEN 0 ELSE least(greatest((p[2] + 2 * p[3]) / ((p[1] + p[2] + p[3]) * 2), 0), 1) END, 6) AS score FROM p""")
def scr1(spark, sf):
    p = F.array("l_discount", "l_tax", F.col("l_quantity") / 100)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(T.expected_position(p), "score"))


@query("scr2_parsed_rating", """WITH o AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Rating: ' || (event_id % 8) WHEN 1 THEN '{"rating": ' || (event_id % 8) || '}' WHEN 2 THEN props WHEN 3 THEN 'none' ELSE 'so {"rating": ' || (event_id % 6) || '} it is' END AS t, event_id AS e, props FROM events),
v AS (SELECT event_id, CASE e % 5 WHEN 0 THEN e % 8 WHEN 1 THEN e % 8 WHEN 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) WHEN 4 THEN e % 6 END AS v FROM o)
SELECT event_id, CAST(CASE WHEN v BETWEEN 0 AND 5 THEN v END AS INTEGER) AS rating FROM v""")
def scr2(spark, sf):
    e = table(spark, sf, "events")
    n = lambda k: (F.col("event_id") % k).cast("string")
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.concat(F.lit("Rating: "), n(8))).when(kind == 1, F.concat(F.lit('{"rating": '), n(8), F.lit("}"))).when(kind == 2, F.col("props")).when(kind == 3, "none").otherwise(F.concat(F.lit('so {"rating": '), n(6), F.lit("} it is")))
    return e.select("event_id", T.parsed_rating(text).alias("rating"))


@query("scr3_unit_score", "SELECT l_orderkey, l_linenumber, round(least(greatest(l_quantity / 8 - 1, 0), 5) / 5, 6) AS clamped, round((l_quantity / 8 - 1) / 5, 6) AS plain FROM lineitem")
def scr3(spark, sf):
    q = F.col("l_quantity") / 8 - 1
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(K.unit_score(q), "clamped"), r6(K.unit_score(q, False), "plain"))


@query("scr4_random", "SELECT doc_id, round(CAST('0x' || substr(md5(concat_ws(':', doc_id, '42')), 1, 8) AS BIGINT) / 4294967296::DOUBLE, 6) AS score FROM documents")
def scr4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", r6(K.uniform("doc_id"), "score"))


BASELINE = """y AS (SELECT n_chars % 6 AS y, {} AS c FROM documents WHERE doc_id % 3 <> 0 GROUP BY n_chars % 6),
b AS (SELECT y, sum(c) OVER (ORDER BY y) / (SELECT sum(c) FROM y)::DOUBLE AS upto FROM y),
u AS (SELECT doc_id, CAST('0x' || substr(md5(concat_ws(':', doc_id, '42')), 1, 8) AS BIGINT) / 4294967296::DOUBLE AS u FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, min(y) AS predicted FROM u JOIN b ON u < upto GROUP BY doc_id"""


@query("scr5_weighted_baseline", "WITH " + BASELINE.format("count(*)"))
def scr5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 6).alias("y"))
    return K.sampled_labels(d.filter("doc_id % 3 = 0"), d.filter("doc_id % 3 <> 0"), "y", "doc_id").select("doc_id", "predicted")


@query("scr5b_uniform_baseline", "WITH " + BASELINE.format("1"))
def scr5b(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 6).alias("y"))
    return K.sampled_labels(d.filter("doc_id % 3 = 0"), d.filter("doc_id % 3 <> 0"), "y", "doc_id", weighted=False).select("doc_id", "predicted")


@query("scr6_candidate_order", "SELECT event_id, round(value + 1, 4) AS plain, round(value + 2, 4) AS vivid, round(value + 3, 4) AS vague FROM events")
def scr6(spark, sf):
    names = ["plain", "vivid", "vague"]
    e = table(spark, sf, "events").select("event_id", F.array(*map(F.lit, ["vague", "plain", "vivid"])).alias("labels"), F.array(*[F.col("value") + k for k in (3, 1, 2)]).alias("scores"))
    s = P.in_candidate_order(names, F.col("labels"), F.col("scores"))
    return e.select("event_id", *[F.round(s[k], 4).alias(n) for k, n in enumerate(names)])


@query("scr8_sweep", "SELECT n_name || ':' || c_mktsegment AS config, count(*) AS texts, sum(length(c_name)) AS chars FROM nation, customer GROUP BY ALL")
def scr8(spark, sf):
    texts = table(spark, sf, "customer").select("c_mktsegment", "c_name")
    return K.swept(texts, table(spark, sf, "nation").select("n_name")).groupBy(F.concat_ws(":", "n_name", "c_mktsegment").alias("config")).agg(F.count("*").alias("texts"), F.sum(F.length("c_name")).alias("chars"))


def _letters(texts):
    return [[t.count(c) for c in "etaoinsh"] for t in texts]


@query("scr9_embedding", "WITH c AS (SELECT doc_id, list_transform(['e', 't', 'a', 'o'], lambda x: length('classification: ' || text) - length(replace('classification: ' || text, x, ''))) AS v FROM documents) SELECT doc_id, round(v[1] / sqrt(v[1]**2 + v[2]**2 + v[3]**2 + v[4]**2), 4) AS first FROM c")
def scr9(spark, sf):
    v = P.embedded(_letters, 4, "classification: ")
    return table(spark, sf, "documents").select("doc_id", v("text").alias("v")).select("doc_id", F.round(F.col("v")[0].cast("double"), 4).alias("first"))


@query("udx1_scorer", "SELECT doc_id, round(least(length(text) / 1000, 1), 6) AS score FROM documents")
def udx1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", r6(P.score("length")("text"), "score"))


@query("udx2_calibrators", f"WITH {PAIRS} SELECT fold, count(*) AS n FROM pairs GROUP BY fold")
def udx2(spark, sf):
    rows = pairs(spark, sf)
    out = [K.METHODS[m](rows, "s", "y").predict(rows, "s").groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("calibrated").alias("n")) for m in ("isotonic", "q2q", "none")]
    return out[0].intersect(out[1]).intersect(out[2])


@query("udx3_failover", "SELECT event_id, event_type <> 'error' AS ok, CASE WHEN event_type = 'click' THEN 'first:' || event_type WHEN event_type <> 'error' THEN 'second:' || event_type END AS value, CASE WHEN event_type = 'error' THEN 'all providers failed: first: not mine; second: broken' END AS error FROM events")
def udx3(spark, sf):
    def first(t):
        if t != "click":
            raise ValueError("not mine")
        return f"first:{t}"

    def second(t):
        if t == "error":
            raise ValueError("broken")
        return f"second:{t}"

    r = P.attempted([("first", first), ("second", second)])(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", r.alias("r")).select("event_id", "r.*")


@query("udx4_text_getters", "SELECT conv_id, turn, CASE role WHEN 'user' THEN replace(text, ' @-@ ', '-') WHEN 'assistant' THEN lower(text) END AS t FROM conversations")
def udx4(spark, sf):
    t = P.text_of(F.col("role"), {"user": F.replace("text", F.lit(" @-@ "), F.lit("-")), "assistant": F.lower("text")})
    return table(spark, sf, "conversations").select("conv_id", "turn", t.alias("t"))
