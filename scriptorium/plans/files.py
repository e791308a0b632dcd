"""Queries of sources and sinks: tables are written in a field format to the shared folder and read
back; the rows have to be those that went in."""

import uuid

from pyspark.sql import functions as F

from scriptorium.operators import cleaning as C
from scriptorium.session import shared_dir, table
from scriptorium.sources import readers as I
from scriptorium.sources import sheets as S
from scriptorium.sources import writers as O

from .base import query, r6


def place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("src1_source_scan", "SELECT doc_id, length(text) AS chars FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20")
def src1(spark, sf):
    return I.taken(table(spark, sf, "documents"), "doc_id", 20, 50).select("doc_id", F.length("text").cast("long").alias("chars"))


@query("src2_parquet", "SELECT c_custkey, c_acctbal FROM customer")
def src2(spark, sf):
    return I.parquet(spark, f"{sf}/customer.parquet").select("c_custkey", "c_acctbal")


@query("src3_required_columns", "SELECT doc_id, quality FROM labels")
def src3(spark, sf):
    return I.parquet(spark, f"{sf}/labels.parquet", required=("doc_id", "quality")).select("doc_id", "quality")


@query("src4_csv", "SELECT p_partkey, p_name, CASE WHEN p_size > 10 THEN p_retailprice END AS price FROM part")
def src4(spark, sf):
    path = place(spark, "csv")
    O.csv(table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price")), path)
    return I.csv(spark, path, "p_partkey long, p_name string, price double")


@query("src5_ratings_tsv", "SELECT l_orderkey AS task, CAST(l_linenumber AS INTEGER) AS annotator, CAST(max(trunc(l_quantity)) AS INTEGER) % 6 AS rating FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL UNION ALL SELECT l_orderkey, 0, CAST(count(*) % 6 AS INTEGER) FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey")
def src5(spark, sf):
    li, path = table(spark, sf, "lineitem").filter("l_linenumber <= 3"), place(spark, "tsv")
    wide = li.groupBy(F.col("l_orderkey").alias("segment_id")).agg(F.lit("a text").alias("text"), *[F.coalesce((F.max(F.when(F.col("l_linenumber") == k, F.col("l_quantity").cast("int"))) % 6).cast("string"), F.lit("none" if k == 2 else " ")).alias(f"annotator_{k}") for k in (1, 2, 3)], (F.count("*") % 6).alias("agreed_rating"), F.lit("7").alias("annotator_x"))
    O.csv(wide, path, sep="\t", null="")
    return I.ratings_tsv(spark, path)


@query("src6_excel", "SELECT p_partkey, p_name, CASE WHEN p_size > 10 THEN p_retailprice END AS price, p_size > 20 AS large FROM part")
def src6(spark, sf):
    path = place(spark, "sheets")
    S.workbooks(table(spark, sf, "part").select("p_name", F.lit("left out").alias("note"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price"), "p_partkey", (F.col("p_size") > 20).alias("large")), path)
    return S.excel(spark, path, "p_partkey long, p_name string, price double, large boolean")


@query("src7_text_lines", "SELECT md5(n_name) AS h FROM nation")
def src7(spark, sf):
    path = place(spark, "lines")
    table(spark, sf, "nation").select("n_name").write.text(path)
    return I.lines(spark, path).select(F.md5("value").alias("h"))


@query("src8_blank_line_records", "SELECT md5(n_name || chr(10) || r_name) AS h FROM nation JOIN region ON n_regionkey = r_regionkey")
def src8(spark, sf):
    path = place(spark, "records")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n.select(F.concat("n_name", F.lit("\n"), "r_name", F.lit("\n"))).write.text(path)
    return I.lines(spark, path, sep="\n\n").filter(F.trim("value") != "").select(F.md5(F.rtrim("value", F.lit("\n"))).alias("h"))


@query("src9_whole_texts", "SELECT r_regionkey % 2 AS kind, count(*) AS n FROM region GROUP BY ALL")
def src9(spark, sf):
    """A file for each region, half of them in Latin-1."""
    path = place(spark, "texts")
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.concat(F.lit("é "), "r_name").alias("t"))
    r.filter("k % 2 = 0").select("t", "k").repartition("k").write.partitionBy("k").text(f"{path}/utf8", lineSep="\n")
    r.filter("k % 2 = 1").select("t", "k").repartition("k").write.partitionBy("k").option("encoding", "ISO-8859-1").csv(f"{path}/latin1", quote="")
    files = I.whole_texts(spark, f"{path}/*/*/part-*")
    return files.filter(F.col("text").startswith("é ")).groupBy(F.col("path").contains("latin1").cast("int").alias("kind")).agg(F.count("*").alias("n"))


@query("src10_json_files", "SELECT n_nationkey AS id, n_name AS title FROM nation")
def src10(spark, sf):
    path = place(spark, "json")
    O.json(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")).repartition(25, "id"), path)
    return I.json_files(spark, path, "id int, title string", multi_line=False).select("id", "title")


@query("src11_tolerant_json", "SELECT count(*) AS files FROM region WHERE r_regionkey <> 3")
def src11(spark, sf):
    path = place(spark, "json")
    r = table(spark, sf, "region")
    body = F.when(F.col("r_regionkey") == 3, F.lit('{"id": ')).otherwise(F.to_json(F.struct(F.col("r_regionkey").alias("id"))))
    r.select(body.alias("v"), "r_regionkey").repartition(5, "r_regionkey").write.partitionBy("r_regionkey").text(path)
    files = spark.read.text(f"{path}/*/*.txt", wholetext=True)
    return files.filter(F.from_json("value", "id int, _bad string", {"columnNameOfCorruptRecord": "_bad"})["id"].isNotNull()).agg(F.count("*").alias("files"))


def _exports(spark, sf, path):
    """Nested and flat exports, wrapped and bare: a file for each line status."""
    li = table(spark, sf, "lineitem").filter("l_orderkey < 100")
    choice = lambda name, value: F.struct(F.lit(name).alias("from_name"), F.struct(F.array(value).alias("choices")).alias("value"))
    rating = (F.col("l_quantity").cast("int") % 6).cast("string")
    nested = li.filter("l_linestatus = 'O'").select("l_orderkey", F.struct(F.col("l_linenumber").alias("completed_by"), F.col("l_extendedprice").alias("lead_time"), F.array(choice("rating", rating), choice("visual_action", F.lit("true"))).alias("result")).alias("a"))
    tasks = nested.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list("a")).alias("annotations"))
    tasks.agg(F.to_json(F.struct(F.collect_list(F.struct("id", "annotations")).alias("tasks")))).write.text(f"{path}/nested")
    flat = li.filter("l_linestatus <> 'O'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("annotator"), F.col("l_extendedprice").alias("lead_time"), rating.alias("rating"))
    flat.agg(F.to_json(F.collect_list(F.struct("*")))).write.text(f"{path}/flat")
    return spark.read.text([f"{path}/nested", f"{path}/flat"], wholetext=True)


@query("src12_wrapped_exports", "SELECT l_orderkey AS id, l_linestatus = 'O' AS wrapped, count(*) FILTER (l_linestatus <> 'O') AS flat FROM lineitem WHERE l_orderkey < 100 GROUP BY l_orderkey, l_linestatus = 'O'")
def src12(spark, sf):
    path = place(spark, "exports")
    _exports(spark, sf, path)
    rows = I.exported(spark, [f"{path}/nested", f"{path}/flat"], "*.txt").withColumn("wrapped", F.col("file").contains("/nested/"))
    return rows.groupBy(F.get_json_object("task", "$.id").cast("long").alias("id"), "wrapped").agg(F.count_if(~F.col("wrapped")).alias("flat"))


@query("src13_nested_or_flat", "SELECT l_orderkey AS task, CAST(l_linenumber AS BIGINT) AS annotator, CAST(CAST(trunc(l_quantity) AS INTEGER) % 6 AS VARCHAR) AS rating, CASE WHEN l_linestatus = 'O' THEN 'true' ELSE '' END AS action FROM lineitem WHERE l_orderkey < 100")
def src13(spark, sf):
    path = place(spark, "exports")
    _exports(spark, sf, path)
    rows = I.annotations(spark, [f"{path}/nested", f"{path}/flat"], "*.txt")
    return rows.select("task", "annotator", "rating", F.coalesce(F.array_join("visual_action", ","), F.lit("")).alias("action"))


@query("src14_several_paths", "SELECT n_regionkey AS region, count(*) AS n FROM nation WHERE n_regionkey < 3 GROUP BY ALL")
def src14(spark, sf):
    path = place(spark, "several")
    for k in range(3):
        table(spark, sf, "nation").filter(F.col("n_regionkey") == k).select("n_regionkey").write.json(f"{path}/{k}")
    return I.json_files(spark, [f"{path}/{k}" for k in range(3)], "n_regionkey int", multi_line=False).groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))


@query("src15_page_texts", "SELECT user_id AS doc, string_agg(event_type, ' ' ORDER BY event_id) AS text FROM events GROUP BY ALL")
def src15(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.lit(0).alias("page"), F.col("event_id").alias("ord"), F.lit(0).alias("block"), F.floor(F.col("user_id")).alias("line"), F.col("event_type").alias("word"))
    return I.page_texts(e).select("doc", "text")


@query("src16_uploads")
def src16(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return I.uploads(docs).select("path", F.length("cleaned").alias("cleaned"), F.length("full").alias("full"), F.size("removed").alias("removed"))


@query("src17_file_names", "SELECT l_orderkey, l_linenumber, 'ridge_' || l_returnflag || '_lg' AS model, CASE WHEN l_linenumber % 3 = 0 THEN 'val' WHEN l_linenumber % 3 = 1 THEN 'test' ELSE 'train' END AS type, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber END AS trial, CAST(l_orderkey % 50 AS INTEGER) AS seed, strftime(l_shipdate, '%Y-%m-%d-%H-%M-%S') AS timestamp FROM lineitem")
def src17(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_linenumber")
    kind = F.when(k % 3 == 0, "val").when(k % 3 == 1, "test").otherwise("train")
    name = O.metric_file(F.concat(F.lit("ridge_"), "l_returnflag", F.lit("_lg")), kind, F.col("l_orderkey") % 50, F.col("l_shipdate"), F.when(k % 3 == 0, k))
    return li.select("l_orderkey", "l_linenumber", I.metric_name(I.stem(name)).alias("m")).select("l_orderkey", "l_linenumber", "m.model", "m.type", "m.trial", "m.seed", "m.timestamp")


@query("src18_learning_curve", "SELECT l_linenumber AS iter, round(avg(l_discount), 6) AS loss FROM lineitem GROUP BY ALL")
def src18(spark, sf):
    path = place(spark, "curve")
    O.csv(table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("iter")).agg(F.avg("l_discount").alias("loss")), path, sep="\t")
    return I.csv(spark, path, "iter int, loss double", sep="\t").select("iter", r6("loss"))


@query("snk1_parquet", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL")
def snk1(spark, sf):
    path = place(spark, "snk1")
    O.parquet(table(spark, sf, "supplier"), path, by=("s_nationkey",))
    return spark.read.parquet(path).groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("snk2_delimited", "SELECT s_suppkey, s_name FROM supplier")
def snk2(spark, sf):
    path = place(spark, "snk2")
    O.csv(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path, sep="\t")
    return I.csv(spark, path, "s_suppkey long, s_name string", sep="\t")


@query("snk3_json", "SELECT doc_id, md5(text) AS h FROM documents")
def snk3(spark, sf):
    path = place(spark, "snk3")
    O.json(table(spark, sf, "documents").select("doc_id", "text"), path)
    return spark.read.json(path, schema="doc_id long, text string").select("doc_id", F.md5("text").alias("h"))


@query("snk4_latest_results", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def snk4(spark, sf):
    path, e = place(spark, "snk4"), table(spark, sf, "events").select("user_id", "event_id", "value")
    O.appended(e.filter("event_id % 2 = 1"), path)
    O.appended(e.filter("event_id % 2 = 0"), path)
    return O.latest(spark.read.parquet(path), "user_id", "event_id").select("user_id", "value")


@query("snk5_metric_files", "SELECT l_returnflag || '_' || CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'test' END || '_' || l_linenumber || '_' || strftime(max(l_shipdate), '%Y-%m-%d-%H-%M-%S') || '.json' AS file FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
def snk5(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.max("l_shipdate").alias("at"))
    return g.select(O.metric_file(F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", "train").otherwise("test"), F.col("l_linenumber"), F.col("at")).alias("file"))


@query("snk6_merged_runs", "SELECT 'rate it' AS prompt, 40 AS tokens, count(*) FILTER (conv_id % 4 <> 0) AS models FROM (SELECT DISTINCT conv_id FROM conversations)")
def snk6(spark, sf):
    runs = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    model = F.struct(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("model_name"), F.when(F.col("conv_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.transform("texts", F.md5)).alias("outputs"))
    files = runs.select(F.col("conv_id").alias("file"), F.when(F.col("conv_id") % 2 == 0, "rate it").alias("prompt"), F.when(F.col("conv_id") % 3 == 0, 0).otherwise(40).alias("prompt_token_count"), F.array(model).alias("models"))
    return O.merged_runs(files).select("prompt", F.col("prompt_token_count").alias("tokens"), F.size("models").cast("long").alias("models"))


@query("snk7_latex", """WITH c AS (SELECT l_returnflag AS r, round(avg(l_discount) FILTER (l_linestatus = 'O'), 5) AS a, round(avg(l_tax) FILTER (l_linestatus = 'O'), 5) AS b FROM lineitem GROUP BY ALL),
t AS (SELECT r, a, b, a = max(a) OVER () AS ba, b = min(b) OVER () AS bb FROM c), f AS (SELECT r, ba, bb, printf('%.3f', a) AS a, printf('%.3f', b) AS b, chr(92) || 'textbf{' AS o FROM t)
SELECT r || ' & ' || coalesce(CASE WHEN ba THEN o || a || '}' ELSE a END, '--') || ' & ' || coalesce(CASE WHEN bb THEN o || b || '}' ELSE b END, '--') || ' ' || chr(92) || chr(92) AS line FROM f""")
def snk7(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[F.round(F.avg(F.when(F.col("l_linestatus") == "O", F.col(c))), 5).alias(c) for c in ("l_discount", "l_tax")])
    cells = g.select(F.col("l_returnflag").alias("row"), F.explode(F.array(F.struct(F.lit("1 acc").alias("column"), F.lit("acc").alias("metric"), F.col("l_discount").alias("value")), F.struct(F.lit("2 rmse").alias("column"), F.lit("rmse").alias("metric"), F.col("l_tax").alias("value")))).alias("x")).select("row", "x.*")
    return O.latex(cells).select("line")


@query("snk9_messages", "SELECT '{\"type\":\"batch\",\"content\":{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}}' AS message FROM region")
def snk9(spark, sf):
    return O.messages(table(spark, sf, "region").select("r_regionkey", "r_name"))


@query("snk10_parity", "SELECT count(*) AS rows, round(max(abs(l_discount / 3 * 3 - l_discount)), 6) AS largest, true AS equal FROM lineitem")
def snk10(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.col("l_discount").alias("a"))
    return O.parity(li, li.select("id", (F.col("a") / 3 * 3).alias("b")), "id", "a", "b").select("rows", r6("largest"), "equal")


@query("win6_removed_ranges")
def win6b(spark, sf):
    d = table(spark, sf, "documents")
    marked = C.marked(d).withColumn("plain", C.normalised("line"))
    return C.removed_ranges(marked).select("doc_id", F.length("full").alias("full"), F.size("removed").alias("removed"))
