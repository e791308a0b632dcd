"""Queries of filters, joins, aggregates, samples, sets and windows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.operators import features as X
from scriptorium.operators import relational as R
from scriptorium.operators.intervals import overlapping
from scriptorium.operators.ranks import cumulative_share, numbered
from scriptorium.session import table

from .base import md5_order, query, r6

H = "md5(CAST(doc_id AS VARCHAR) || ':42')"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("flt1_book_filter", r"""SELECT p_partkey FROM part WHERE (contains(p_type, 'ECON') OR contains(p_type, 'SM')) AND NOT contains(lower(p_name), 'red') AND 1850 + p_size * 4 >= 1900 AND floor(p_retailprice) >= 905""")
def flt1(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("locc"), F.col("p_name").alias("subjects"), F.lit("").alias("bookshelves"), (1850 + F.col("p_size") * 4).cast("string").alias("issued"), F.lit("Someone, 1851-1900").alias("authors"), F.repeat(F.lit("x"), F.floor("p_retailprice").cast("int")).alias("text"))
    return R.book_filter(p, ["ECON", "SM"], ["red"], 905).select("p_partkey")


@query("flt2_length_window", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 60 AND length(text) <= 500")
def flt2(spark, sf):
    return docs(spark, sf).filter(R.length_window("text")).select("doc_id")


@query("flt3_skip_take", "SELECT doc_id FROM (SELECT * FROM documents ORDER BY doc_id OFFSET 50) WHERE length(trim(text)) >= 60 AND length(text) <= 500 ORDER BY doc_id LIMIT 40")
def flt3(spark, sf):
    return R.skip_take(docs(spark, sf), "doc_id", 50, 40, R.length_window("text")).select("doc_id")


@query("flt4_source_projection", "SELECT doc_id, replace(CASE WHEN source = 'src1' THEN reverse(text) ELSE text END, ' and ', '-') AS text FROM documents")
def flt4(spark, sf):
    return docs(spark, sf).select("doc_id", F.replace(F.when(F.col("source") == "src1", F.reverse("text")).otherwise(F.col("text")), F.lit(" and "), F.lit("-")).alias("text"))


@query("flt5_middle_segment", "WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) >= 20) AS parts FROM documents) SELECT doc_id, parts[len(parts) // 2 + 1] AS segment FROM s WHERE len(parts) > 0")
def flt5(spark, sf):
    parts = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 20)
    return docs(spark, sf).select("doc_id", R.middle(parts).alias("segment")).filter("segment IS NOT NULL")


@query("flt6_middle_lines", "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, array_to_string(l[greatest(len(l) // 2 - 15, 0) + 1 : greatest(len(l) // 2 - 15, 0) + 30], chr(10)) AS preview FROM s")
def flt6(spark, sf):
    return docs(spark, sf).select("doc_id", R.middle_lines(F.col("text")).alias("preview"))


@query("flt7_drop_nulls", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def flt7(spark, sf):
    return docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").dropna(subset=["quality"]).select("doc_id", "quality")


@query("flt8_rename_cast", "SELECT CAST(doc_id AS VARCHAR) AS segment_id, source AS book, CAST(n_chars AS INTEGER) AS length FROM documents")
def flt8(spark, sf):
    return docs(spark, sf).drop("text", "lang").withColumnsRenamed({"source": "book"}).select(F.col("doc_id").cast("string").alias("segment_id"), "book", F.col("n_chars").cast("int").alias("length"))


@query("flt9_first_year", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1900 + p_size WHEN p_size % 3 = 1 THEN -p_size END AS year FROM part")
def flt9(spark, sf):
    a = F.when(F.col("p_size") % 3 == 0, (1900 + F.col("p_size")).cast("string")).otherwise("n/a")
    b = F.when(F.col("p_size") % 3 == 1, (-F.col("p_size")).cast("string"))
    return table(spark, sf, "part").select("p_partkey", R.year_of(a, b).alias("year"))


@query("flt10_score_range", "SELECT event_id, value FROM events WHERE coalesce(value, 0) BETWEEN 5 AND 10 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error') ")
def flt10(spark, sf):
    e = table(spark, sf, "events")
    return e.filter(F.coalesce("value", F.lit(0)).between(5, 10)).join(e.filter("event_type = 'error'").select("user_id"), "user_id", "left_semi").select("event_id", "value")


@query("flt11_score_tier", "SELECT event_id, CASE WHEN value / 50 >= 0.6 THEN 'success' WHEN value / 50 >= 0.25 THEN 'warning' ELSE 'error' END AS tier FROM events")
def flt11(spark, sf):
    return table(spark, sf, "events").select("event_id", R.tier(F.col("value") / 50).alias("tier"))


@query("flt12_plot_filter", "WITH m AS (SELECT user_id, corr(value, event_id) AS corr, count(*) AS n FROM events GROUP BY ALL) SELECT user_id FROM m WHERE corr > 0.1 OR n > 500")
def flt12(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.corr("value", "event_id").alias("corr"), F.count("*").alias("n")).filter("corr > 0.1 OR n > 500").select("user_id")


@query("flt13_complexity", "SELECT CASE WHEN n_chars <= 200 THEN 'low' WHEN n_chars <= 900 THEN 'medium' ELSE 'high' END AS complexity, count(*) AS n FROM documents GROUP BY ALL")
def flt13(spark, sf):
    return docs(spark, sf).groupBy(R.complexity(F.col("n_chars")).alias("complexity")).agg(F.count("*").alias("n"))


@query("flt14_feature_mask", "SELECT vec_id, round(list_sum(list_transform(list_filter(list_zip(embedding, range(64)), lambda x: x[2] % 3 = 0), lambda x: CAST(x[1] AS DOUBLE))), 4) AS kept FROM embeddings")
def flt14(spark, sf):
    kept = F.filter("embedding", lambda x, i: i % 3 == 0)
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("kept"))


@query("flt15_feature_concat", "SELECT vec_id, CAST(len(embedding) + 2 AS INTEGER) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(label AS DOUBLE) AS last FROM embeddings")
def flt15(spark, sf):
    whole = F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(0.0), F.col("label").cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.size(whole).alias("dims"), F.round(whole[0], 6).alias("first"), F.element_at(whole, -1).alias("last"))


@query("flt16_progress", "SELECT user_id, count(*) FILTER (value > 10) AS scored, count(*) AS total, round(100.0 * (count(*) - count(*) FILTER (value > 10)) / nullif(count(*) FILTER (value > 10), 0), 6) AS eta FROM events GROUP BY ALL")
def flt16(spark, sf):
    scored = F.count_if(F.col("value") > 10)
    return table(spark, sf, "events").groupBy("user_id").agg(scored.alias("scored"), F.count("*").alias("total"), r6(F.try_divide(100.0 * (F.count("*") - scored), scored), "eta"))


@query("flt17_icon_tier", "SELECT event_id, CAST((p >= 20)::INT + (p >= 40)::INT + (p >= 60)::INT + (p >= 80)::INT + (p >= 95)::INT AS INTEGER) AS icon FROM (SELECT event_id, floor(value / 50 * 100 + 0.5) AS p FROM events)")
def flt17(spark, sf):
    return table(spark, sf, "events").select("event_id", R.icon_tier(F.col("value") / 50).alias("icon"))


@query("flt18_ready_batch", "SELECT event_id FROM (SELECT e.event_id FROM events e LEFT JOIN (SELECT event_id, true AS enhanced FROM events WHERE value > 5) x USING (event_id) WHERE e.event_type <> 'view' OR coalesce(enhanced, false) ORDER BY event_id LIMIT 16)")
def flt18(spark, sf):
    e = table(spark, sf, "events")
    done = e.filter("value > 5").select("event_id", F.lit(True).alias("enhanced"))
    return e.join(done, "event_id", "left").filter((F.col("event_type") != "view") | F.coalesce("enhanced", F.lit(False))).select("event_id").orderBy("event_id").limit(16)


@query("jn1_text_lookup", "WITH b AS (SELECT text, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) SELECT l.doc_id, b.source FROM labels l JOIN documents d USING (doc_id) JOIN b ON d.text = b.text")
def jn1(spark, sf):
    d = docs(spark, sf)
    b = R.first_by(d, ["text"], ["doc_id"]).select("text", F.col("source").alias("origin"))
    return table(spark, sf, "labels").join(d, "doc_id").join(b, "text").select("doc_id", F.col("origin").alias("source"))


@query("jn2_words_expressions", "SELECT DISTINCT split_part(a.p_name, ' ', 1) AS word, r.k FROM part a JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS k FROM part WHERE p_size > 20) r ON split_part(a.p_name, ' ', 1) = r.k")
def jn2(spark, sf):
    p = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"), "p_size")
    return p.select("word").distinct().join(p.filter("p_size > 20").select(F.col("word").alias("k")).distinct(), F.col("word") == F.col("k"))


@query("jn3_membership", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jn3(spark, sf):
    return docs(spark, sf).join(table(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("jn4_non_membership", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn4(spark, sf):
    return docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("jn5_keyed_embeddings", "SELECT d.doc_id, e.label, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def jn5(spark, sf):
    e = table(spark, sf, "embeddings")
    return docs(spark, sf).join(e, F.col("doc_id") == F.col("vec_id")).select("doc_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("jn6_position_join", "WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events WHERE event_type = 'click'), b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events WHERE event_type = 'view') SELECT user_id, count(*) AS n, round(sum(a.value * b.value), 4) AS dot FROM a JOIN b USING (user_id, pos) GROUP BY ALL")
def jn6(spark, sf):
    e = table(spark, sf, "events")
    side = lambda kind, name: numbered(e.filter(F.col("event_type") == kind).select("user_id", "event_id", F.col("value").alias(name)), ["user_id"], ["event_id"], "pos").drop("event_id")
    return side("click", "a").join(side("view", "b"), ["user_id", "pos"]).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("a") * F.col("b")), 4).alias("dot"))


@query("jn8_metadata_lookup", "SELECT c_custkey, n_name AS genre FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def jn8(spark, sf):
    n = table(spark, sf, "nation").filter("n_nationkey < 20")
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("n_name").alias("genre"))


@query("jn9_used_excluded", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def jn9(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("jn12_regex_join", "WITH p(id, pat) AS (VALUES (1, '^th'), (2, 'ing$'), (3, 'eau')), w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM documents) SELECT id, count(*) AS n FROM w JOIN p ON regexp_matches(word, pat) GROUP BY ALL")
def jn12(spark, sf):
    p = spark.createDataFrame([(1, "^th"), (2, "ing$"), (3, "eau")], "id int, pat string")
    w = docs(spark, sf).select(F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct()
    return R.pattern_hits(w, "word", p, "id", "pat").groupBy("id").agg(F.count("*").alias("n"))


@query("jn13_interval_join", "SELECT a.user_id, count(*) AS overlaps FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.event_id < a.event_id + CAST(a.value AS BIGINT) + 1 AND b.event_id + 20 > a.event_id GROUP BY ALL")
def jn13(spark, sf):
    e = table(spark, sf, "events")
    a = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("a0"), (F.col("event_id") + F.round("value").cast("long") + 1).alias("a1"))
    b = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("b0"), (F.col("event_id") + 20).alias("b1"))
    return overlapping(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1")).groupBy("left.user_id").agg(F.count("*").alias("overlaps"))


@query("jn14_score_attach", "SELECT d.doc_id, coalesce(l.quality, x.quality) AS score FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT source, quality FROM documents JOIN labels USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1) x ON d.source = x.source")
def jn14(spark, sf):
    d, l = docs(spark, sf).select("doc_id", "source"), table(spark, sf, "labels").select("doc_id", "quality")
    fallback = R.first_by(d.join(l, "doc_id"), ["source"], ["doc_id"]).select("source", F.col("quality").alias("other"))
    return d.join(l, "doc_id", "left").join(fallback, "source", "left").select("doc_id", F.coalesce("quality", "other").alias("score"))


@query("jn15_prefix_join", "WITH p AS (SELECT DISTINCT substr(p_type, 1, 5) AS prefix FROM part) SELECT p_partkey, prefix FROM part JOIN p ON starts_with(p_type, prefix) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY prefix) = 1")
def jn15(spark, sf):
    p = table(spark, sf, "part")
    prefixes = p.select(F.substring("p_type", 1, 5).alias("prefix")).distinct()
    joined = p.withColumn("__k", F.substring("p_type", 1, 5)).join(prefixes.withColumn("__k", F.substring("prefix", 1, 5)), "__k").filter(F.startswith("p_type", "prefix"))
    return R.first_by(joined.select("p_partkey", "prefix"), ["p_partkey"], ["prefix"])


@query("jn17_cell_texts", "SELECT d.doc_id, d.n_chars FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0 AND toxic = 1")
def jn17(spark, sf):
    return table(spark, sf, "labels").filter("quality = 0 AND toxic = 1").join(docs(spark, sf).select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars")


@query("agg1_group_bounds", "SELECT source, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS std, count(*) AS n, round(avg(n_chars) - 2 * stddev_samp(n_chars), 4) AS lower FROM documents GROUP BY ALL")
def agg1(spark, sf):
    m, s = F.avg("n_chars"), F.stddev_samp("n_chars")
    return docs(spark, sf).groupBy("source").agg(F.round(m, 4).alias("mean"), F.round(s, 4).alias("std"), F.count("*").alias("n"), F.round(m - 2 * s, 4).alias("lower"))


@query("agg2_value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY ALL")
def agg2(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"))


@query("agg3_group_totals", "SELECT lang, count(DISTINCT source) AS books, count(*) AS segments, count(quality) AS used, count(*) - count(quality) AS available FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def agg3(spark, sf):
    return docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").groupBy("lang").agg(F.countDistinct("source").alias("books"), F.count("*").alias("segments"), F.count("quality").alias("used"), (F.count("*") - F.count("quality")).alias("available"))


@query("agg4_normalised_counts", "WITH g AS (SELECT CASE WHEN trim(x) = '' THEN 'Unknown' WHEN lower(trim(x)) = 'es' THEN 'Es' ELSE trim(x) END AS genre FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE lang END AS x FROM documents)) SELECT genre, count(*) AS n, CASE WHEN count(*) >= 0.02 * sum(count(*)) OVER () THEN round(100.0 * count(*) / sum(count(*)) OVER (), 2) END AS percent FROM g GROUP BY ALL")
def agg4(spark, sf):
    x = F.trim(F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("lang")))
    g = docs(spark, sf).select(F.coalesce(F.when(F.lower(x) == "es", "Es").otherwise(F.nullif(x, F.lit(""))), F.lit("Unknown")).alias("genre")).groupBy("genre").agg(F.count("*").alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(W.partitionBy())
    return g.select("genre", "n", F.when(share >= 2, F.round(share, 2)).alias("percent"))


@query("agg5_extremes_with_ties", "SELECT l_orderkey, l_linenumber, l_partkey, 'earliest' AS which FROM lineitem WHERE l_shipdate = (SELECT min(l_shipdate) FROM lineitem) UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'latest' FROM lineitem WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem)")
def agg5(spark, sf):
    li = table(spark, sf, "lineitem")
    edge = F.broadcast(li.agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b")))  # one row
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    hit = li.join(edge, (F.col("l_shipdate") == F.col("a")) | (F.col("l_shipdate") == F.col("b")))
    which = F.filter(F.array(F.when(F.col("l_shipdate") == F.col("a"), "earliest"), F.when(F.col("l_shipdate") == F.col("b"), "latest")), lambda x: x.isNotNull())
    return hit.select(*keys, F.explode(which).alias("which"))


@query("agg6_dataset_statistics", "WITH w AS (SELECT source, doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents), s AS (SELECT coalesce(source, 'ALL') AS dataset, count(DISTINCT doc_id) AS size, count(*) AS tokens, count(DISTINCT word) AS vocabulary FROM w GROUP BY ROLLUP (source)) SELECT * FROM s")
def agg6(spark, sf):
    w = docs(spark, sf).select("source", "doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return w.rollup("source").agg(F.countDistinct("doc_id").alias("size"), F.count("*").alias("tokens"), F.countDistinct("word").alias("vocabulary")).select(F.coalesce("source", F.lit("ALL")).alias("dataset"), "size", "tokens", "vocabulary")


@query("agg7_length_summary", "SELECT lang, CAST(min(n_chars) AS INTEGER) AS low, CAST(max(n_chars) AS INTEGER) AS high, CAST(trunc(median(n_chars)) AS INTEGER) AS mid, CAST(trunc(avg(n_chars)) AS INTEGER) AS mean, CAST(trunc(2 * stddev_pop(n_chars)) AS INTEGER) AS spread FROM documents GROUP BY ALL")
def agg7(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(*[x.cast("int").alias(n) for n, x in (("low", F.min("n_chars")), ("high", F.max("n_chars")), ("mid", F.percentile("n_chars", 0.5)), ("mean", F.avg("n_chars")), ("spread", 2 * F.stddev_pop("n_chars")))])


@query("agg8_expression_lengths", "WITH e AS (SELECT p_name AS x FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part) SELECT CAST(len(string_split(x, ' ')) AS INTEGER) AS words, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM e GROUP BY ALL")
def agg8(spark, sf):
    p = table(spark, sf, "part")
    e = p.select(F.col("p_name").alias("x")).unionAll(p.select(F.split_part("p_name", F.lit(" "), F.lit(1))))
    return e.groupBy(F.size(F.split("x", " ")).alias("words")).agg(F.count("*").alias("n")).select("words", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy()), "share"))


@query("agg9_min_max", "SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER (PARTITION BY s_nationkey)) / nullif(max(s_acctbal) OVER (PARTITION BY s_nationkey) - min(s_acctbal) OVER (PARTITION BY s_nationkey), 0), 6) AS scaled FROM supplier")
def agg9(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", r6(R.min_max("s_acctbal", ["s_nationkey"]), "scaled"))


@query("agg10_ngram_frequencies", "WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS a FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS gram FROM w) SELECT gram, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY ALL HAVING count(*) >= 20")
def agg10(spark, sf):
    """A text's n-grams are sorted inside its row, and the last of equal ones counts the text; so rows are summed by
    n-gram alone and no pair of n-gram and text is shuffled."""
    a = F.transform("ts", lambda t: F.split(F.lower(t), " "))
    pairs = F.flatten(F.transform(a, lambda x: F.when(F.size(x) > 1, F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda p, q: F.concat_ws(" ", p, q))).otherwise(F.array().cast("array<string>"))))
    grams = docs(spark, sf).groupBy("doc_id").agg(F.collect_list("text").alias("ts")).select("doc_id", F.sort_array(pairs).alias("g"))
    each = X.unlisted(grams, X.shifted("g", 2))
    return each.groupBy(F.col("g0").alias("gram")).agg(F.count("*").alias("tf"), F.count_if(~F.col("g0").eqNullSafe(F.col("g1"))).alias("df")).filter("tf >= 20")


@query("agg11_histogram_shares", "SELECT source, least(length(text) // 1000, 20) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents GROUP BY 1, 2")
def agg11(spark, sf):
    h = docs(spark, sf).groupBy("source", F.least(F.floor(F.length("text") / 1000), F.lit(20)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("source")), 6))


@query("agg12_coverage", "SELECT event_type, round(count(*) FILTER (value > 10) / nullif(count(*) - (sum(user_id % 3) - count(*) FILTER (value > 10)), 0)::DOUBLE, 6) AS coverage FROM events GROUP BY ALL")
def agg12(spark, sf):
    m = F.count_if(F.col("value") > 10)
    return table(spark, sf, "events").groupBy("event_type").agg(r6(F.try_divide(m.cast("double"), F.count("*") - (F.sum(F.col("user_id") % 3) - m)), "coverage"))


MISS = "m AS (SELECT l_linenumber % 3 AS t, CAST(trunc(l_quantity) AS BIGINT) % 3 AS p, count(*) AS n FROM lineitem GROUP BY ALL)"


@query("agg13_miss_table", f"WITH {MISS}, x AS (SELECT t, p, n, sum(n) OVER () AS total FROM m) SELECT CAST(t AS BIGINT) AS t, p, CAST(p - t AS BIGINT) AS error, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS of_misses, round(100.0::DOUBLE * n / total, 6) AS of_all FROM x WHERE t <> p")
def agg13(spark, sf):
    m = _misses(spark, sf).withColumn("total", F.sum("n").over(W.partitionBy()))
    return m.filter("t <> p").select("t", "p", (F.col("p") - F.col("t")).alias("error"), "n", r6(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), "of_misses"), r6(100.0 * F.col("n") / F.col("total"), "of_all"))


def _misses(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 3).cast("long").alias("t"), (F.col("l_quantity").cast("long") % 3).alias("p")).agg(F.count("*").alias("n"))


@query("agg14_signed_errors", f"WITH {MISS} SELECT CAST(p - t AS BIGINT) AS error, CAST(sum(n) AS BIGINT) AS n FROM m WHERE p <> t GROUP BY ALL")
def agg14(spark, sf):
    return _misses(spark, sf).filter("t <> p").groupBy((F.col("p") - F.col("t")).alias("error")).agg(F.sum("n").alias("n"))


@query("agg15_latency", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(1000 / avg(value), 6) AS throughput FROM events GROUP BY ALL")
def agg15(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(r6(F.avg("value"), "mean"), r6(F.stddev_pop("value"), "std"), r6(1000 / F.avg("value"), "throughput"))


@query("agg16_mean_by_model", "SELECT event_type AS model, round(avg(value), 6) AS latency FROM events GROUP BY ALL ORDER BY latency")
def agg16(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(r6(F.avg("value"), "latency")).orderBy("latency")


@query("agg17_relative_throughput", "WITH g AS (SELECT user_id % 7 AS tokens, 1000 / avg(value) AS t FROM events GROUP BY ALL) SELECT tokens, round(t / max(t) OVER (), 6) AS relative FROM g")
def agg17(spark, sf):
    g = table(spark, sf, "events").groupBy((F.col("user_id") % 7).alias("tokens")).agg((1000 / F.avg("value")).alias("t"))
    return g.select("tokens", r6(F.col("t") / F.max("t").over(W.partitionBy()), "relative"))


@query("agg18_vocabulary", "SELECT count(DISTINCT w) AS vocabulary FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents)")
def agg18(spark, sf):
    return docs(spark, sf).select(F.explode(F.split(F.lower("text"), " ")).alias("w")).agg(F.countDistinct("w").alias("vocabulary"))


@query("agg19_balanced_weights", "SELECT doc_id, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*) OVER (PARTITION BY quality))::DOUBLE, 6) AS weight FROM labels")
def agg19(spark, sf):
    return R.balanced_weights(table(spark, sf, "labels"), "quality").select("doc_id", r6("weight"))


@query("agg20_pivot_first", "SELECT user_id AS model, " + ", ".join(f"arg_min(value, event_id) FILTER (event_type = '{k}') AS {k}" for k in ("click", "view", "error")) + " FROM events GROUP BY ALL")
def agg20(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("model")).pivot("event_type", ["click", "view", "error"]).agg(F.min_by("value", "event_id"))


@query("agg21_ranking", "SELECT user_id % 9 AS model, round(avg(value), 3) AS mean, round(max(value), 3) AS high, count(*) AS n FROM events GROUP BY ALL ORDER BY 2 DESC")
def agg21(spark, sf):
    return table(spark, sf, "events").groupBy((F.col("user_id") % 9).alias("model")).agg(F.round(F.avg("value"), 3).alias("mean"), F.round(F.max("value"), 3).alias("high"), F.count("*").alias("n")).orderBy(F.desc("mean"))


@query("agg22_one_against_rest", "WITH m AS (SELECT event_type AS model, avg(value) AS v FROM events GROUP BY ALL) SELECT round(avg(v) FILTER (model = 'view') - avg(v) FILTER (model <> 'view'), 6) AS difference, round(avg(v) FILTER (model = 'view') / avg(v) FILTER (model <> 'view'), 6) AS ratio FROM m")
def agg22(spark, sf):
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("v"))
    a, b = F.avg(F.when(F.col("model") == "view", F.col("v"))), F.avg(F.when(F.col("model") != "view", F.col("v")))
    return m.agg(r6(a - b, "difference"), r6(F.try_divide(a, b), "ratio"))


@query("smp1_balanced_sample", f"WITH d AS (SELECT doc_id, lang, source, {H} AS h FROM documents), a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY h) <= 3), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h) <= 20), c AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM b) ORDER BY h LIMIT (80 - (SELECT count(*) FROM b))) SELECT doc_id FROM b UNION ALL SELECT doc_id FROM c")
def smp1(spark, sf):
    return R.balanced_sample(docs(spark, sf), "lang", "source", "doc_id", 80, 3, 4).select("doc_id")


@query("smp2_preferential_sample", f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY CAST(source IN ('src1', 'src2') AS INTEGER), {H}) <= 12")
def smp2(spark, sf):
    return R.preferential_sample(docs(spark, sf).withColumn("old", F.col("source").isin("src1", "src2")), "lang", "old", "doc_id", 12).select("doc_id")


@query("smp3_halves", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= count(*) OVER (PARTITION BY source) // 2 THEN 1 ELSE 2 END AS half FROM documents")
def smp3(spark, sf):
    w = W.partitionBy("source")
    return docs(spark, sf).select("doc_id", F.when(F.row_number().over(w.orderBy("doc_id")) <= F.floor(F.count("*").over(w) / 2), 1).otherwise(2).alias("half"))


@query("smp4_stratified_split", f"SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {H}) <= ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY quality)) THEN 'test' ELSE 'train' END AS part FROM labels")
def smp4(spark, sf):
    return R.stratified_split(table(spark, sf, "labels"), "quality", "doc_id", 0.3).select("doc_id", "part")


@query("smp5_top_up", f"WITH p AS (SELECT doc_id, n_chars % 6 AS y FROM documents), c AS (SELECT y, count(*) // (1 + y % 2) AS n FROM p GROUP BY y), g AS (SELECT floor(avg(n) FILTER (y NOT IN (1, 5))) AS goal FROM c), k AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY {H}) AS rn FROM p WHERE y IN (1, 5)) SELECT doc_id, y FROM k JOIN c USING (y), g WHERE rn <= goal - n")
def smp5(spark, sf):
    p = docs(spark, sf).select("doc_id", (F.col("n_chars") % 6).alias("y"))
    c = p.groupBy("y").agg(F.count("*").alias("n")).withColumn("n", F.floor(F.col("n") / (1 + F.col("y") % 2)))
    return R.top_up(p, c, "y", [1, 5], "doc_id").select("doc_id", "y")


@query("smp6_label_swap", f"""WITH d AS (SELECT doc_id, n_chars % 6 AS y, coalesce(source IN ('src0', 'src1', 'src2'), false) AS test, coalesce(lang <> 'en', false) AS flagged FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY y, test, flagged ORDER BY {H}) AS rn, least(count(*) FILTER (test AND flagged) OVER (PARTITION BY y), count(*) FILTER (NOT test AND NOT flagged) OVER (PARTITION BY y)) AS n FROM d)
SELECT doc_id, y, CASE WHEN (test AND NOT flagged) OR (NOT test AND NOT flagged AND rn <= n) THEN 'test' ELSE 'train' END AS part FROM k WHERE NOT (test AND flagged AND rn > n)""")
def smp6(spark, sf):
    d = docs(spark, sf).select("doc_id", (F.col("n_chars") % 6).alias("y"), F.coalesce(F.col("source").isin("src0", "src1", "src2"), F.lit(False)).alias("test"), F.coalesce(F.col("lang") != "en", F.lit(False)).alias("flagged"))
    return R.label_swap(d, "y", "doc_id").select("doc_id", "y", "part")


@query("smp7_keep_membership", f"WITH old AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS part FROM labels WHERE doc_id < 300), new AS (SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {H}) <= ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY quality)) THEN 'test' ELSE 'train' END AS part FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM old)) SELECT * FROM old UNION ALL SELECT * FROM new")
def smp7(spark, sf):
    l = table(spark, sf, "labels")
    old = l.filter("doc_id < 300").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("part"))
    return old.unionByName(R.stratified_split(l.join(old, "doc_id", "left_anti"), "quality", "doc_id", 0.3).select("doc_id", "part"))


@query("smp8_stratified_folds", f"SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY {H}) - 1) % 5 AS INTEGER) AS fold FROM labels")
def smp8(spark, sf):
    return R.folds(table(spark, sf, "labels"), "quality", "doc_id").select("doc_id", "fold")


@query("smp8b_plain_folds", f"SELECT doc_id, CAST(CAST(('0x' || substr({H}, 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold FROM documents")
def smp8b(spark, sf):
    return R.folds(docs(spark, sf), None, "doc_id").select("doc_id", "fold")


@query("smp9_sample_per_dataset", f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY source ORDER BY {H}) <= 5")
def smp9(spark, sf):
    free = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_anti")
    return R.first_by(free, ["source"], [md5_order("doc_id")], 5).select("doc_id")


@query("ded1_exact_first_wins", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def ded1(spark, sf):
    return docs(spark, sf).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("ded2_drop_duplicates", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY text, source")
def ded2(spark, sf):
    return docs(spark, sf).groupBy(F.sha2("text", 256).alias("h"), "source").agg(F.min("doc_id").alias("doc_id")).select("source", "doc_id")


@query("ded3_heatmap_rows", "SELECT user_id, CAST(round(value) AS BIGINT) AS y, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, round(value) ORDER BY event_id % 100 DESC, event_id) = 1")
def ded3(spark, sf):
    e = table(spark, sf, "events").withColumn("y", F.round("value").cast("long"))
    return R.first_by(e, ["user_id", "y"], [F.desc(F.col("event_id") % 100), "event_id"]).select("user_id", "y", "event_id")


@query("set1_tagged_union", "SELECT 'part' AS tag, p_name AS name, CAST(NULL AS DOUBLE) AS balance FROM part UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier")
def set1(spark, sf):
    a = table(spark, sf, "part").select(F.lit("part").alias("tag"), F.col("p_name").alias("name"))
    b = table(spark, sf, "supplier").select(F.lit("supplier").alias("tag"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set2_difference", "SELECT DISTINCT source FROM documents EXCEPT SELECT DISTINCT source FROM documents WHERE lang = 'es' AND doc_id < 100")
def set2(spark, sf):
    d = docs(spark, sf)
    return d.select("source").distinct().subtract(d.filter("lang = 'es' AND doc_id < 100").select("source"))


@query("set3_union_subset", "SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def set3(spark, sf):
    l = table(spark, sf, "labels")
    return l.filter("quality = 1").select("doc_id").union(l.filter("toxic = 1").select("doc_id")).distinct()


@query("ord1_multi_key_sort", "SELECT doc_id, lang, n_chars FROM documents ORDER BY lang, n_chars DESC, doc_id")
def ord1(spark, sf):
    return docs(spark, sf).select("doc_id", "lang", "n_chars").orderBy("lang", F.desc("n_chars"), "doc_id")


@query("ord2_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def ord2(spark, sf):
    return docs(spark, sf).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("win3_sliding_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 4) AS three FROM events")
def win3(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(F.sum("value").over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(0, 2)), 4).alias("three"))


@query("win5_latest_per_key", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def win5(spark, sf):
    return R.first_by(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("win6_running_offsets", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents) SELECT doc_id, CAST(no - 1 AS INTEGER) AS line, CAST(coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l")
def win6(spark, sf):
    l = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    before = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return l.select("doc_id", "line", F.coalesce(F.sum(F.length("s")).over(before), F.lit(0)).alias("start"))


@query("win7_ecdf", "SELECT event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS share FROM events")
def win7(spark, sf):
    return cumulative_share(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value", "share").select("event_id", r6("share"))


@query("win8_rank", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS place FROM events")
def win8(spark, sf):
    return table(spark, sf, "events").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("place"))
