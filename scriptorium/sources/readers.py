"""Readers of the field's file shapes: lexicons, ratings, annotation exports, metric and run files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of metric files, those with a trial first.
TRIAL_NAME = r"^(.+)_val_t(\d+)_(\d+)_(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})$"
METRIC_NAME = r"^(.+)_(train|test|val)_(\d+)_(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})$"
WRAPPERS = ("tasks", "results", "data")  # fixed values: keys under which an export may hold its list
AGREED = 0  # the annotator number of agreed ratings

TASK = """struct<id:bigint,data:map<string,string>,annotations:array<struct<id:bigint,completed_by:bigint,lead_time:double,created_at:string,updated_at:string,
result:array<struct<id:string,type:string,from_name:string,to_name:string,value:struct<choices:array<string>>>>>>,annotator:bigint,annotation_id:bigint,rating:string,
type:string,lead_time:double,created_at:string,updated_at:string,text:string,genre:string,segment_id:string>"""


def parquet(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    """SRC1-SRC3: a Parquet table that has to have the ``required`` columns."""
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return df


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", null: str = "NA") -> DataFrame:
    """SRC4, SRC18: delimited text with a header and a literal for null, read under ``schema``."""
    return spark.read.csv(path, header=True, sep=sep, nullValue=null, schema=schema, enforceSchema=False)


def ratings_tsv(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: ``task, annotator, rating`` of a wide ratings table: columns ``annotator_N`` and
    ``agreed_rating`` (annotator 0). Cells that aren't whole numbers are skipped, so are rows whose
    first column is none."""
    wide = spark.read.csv(path, header=True, sep="\t", inferSchema=False)
    number = {c: int(c[10:]) for c in wide.columns if c.startswith("annotator_") and c[10:].isdigit()} | {c: AGREED for c in wide.columns if c == "agreed_rating"}
    cells = F.array(*[F.struct(F.lit(n).alias("annotator"), F.trim(F.col(f"`{c}`")).try_cast("int").alias("rating")) for c, n in number.items()])
    rows = wide.select(F.col(wide.columns[0]).try_cast("bigint").alias("task"), F.explode(cells).alias("x"))
    return rows.select("task", "x.annotator", "x.rating").filter("task IS NOT NULL AND rating IS NOT NULL")


def lines(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """SRC7, SRC8: ``value`` per line, or per record between blank lines with ``sep="\\n\\n"``."""
    return spark.read.text(path, lineSep=sep)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: ``path, text`` per file: UTF-8 without its byte order mark, or Latin-1 where the bytes are
    no UTF-8."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", F.regexp_replace(text, "^﻿", "").alias("text"))


def json_files(spark: SparkSession, paths: str | list[str], schema: str, tolerant: bool = True, multi_line: bool = True) -> DataFrame:
    """SRC10, SRC11, SRC14: an object a file, from files, folders or globs, with ``file``. Files that
    are no JSON are skipped if ``tolerant``, else an error."""
    reader = spark.read.option("multiLine", multi_line).option("pathGlobFilter", "*.json")
    if not tolerant:
        return reader.option("mode", "FAILFAST").schema(schema).json(paths).select("*", F.col("_metadata.file_name").alias("file"))
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").json(paths)
    return rows.select("*", F.col("_metadata.file_name").alias("file")).filter("_corrupt IS NULL").drop("_corrupt")


def exported(spark: SparkSession, paths: str | list[str], names: str = "*.json") -> DataFrame:
    """SRC12: the task objects of export files, as text: a list, or a list under one of the wrapper keys
    (the first that holds one). A file with neither is an error."""
    files = spark.read.text(paths, wholetext=True, pathGlobFilter=names).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("v"))
    held = [F.get_json_object("v", f"$.{k}") for k in WRAPPERS]
    listed = F.when(F.ltrim("v").startswith("["), F.col("v"))
    for h in held:
        listed = F.coalesce(listed, F.when(F.ltrim(h).startswith("["), h))
    items = F.from_json(F.coalesce(listed, F.raise_error(F.concat(F.lit("no list of tasks in "), "file"))), "array<string>")
    return files.select("file", F.posexplode(items).alias("pos", "task")).filter(F.ltrim("task").startswith("{"))


def annotations(spark: SparkSession, paths: str | list[str], names: str = "*.json") -> DataFrame:
    """SRC12, SRC13: ``task, annotator, pos, lead_time, rating, visual_action`` per annotation. Whether a
    file is flat (a row for each annotation) or nested is told by its first object."""
    rows = exported(spark, paths, names).withColumn("t", F.from_json("task", TASK))
    flat = F.get_json_object("task", "$.annotations").isNull() & (F.get_json_object("task", "$.annotator").isNotNull() | F.get_json_object("task", "$.annotation_id").isNotNull())
    kinds = rows.groupBy("file").agg(F.min_by(flat, "pos").alias("flat"))
    known = rows.join(kinds, "file")
    one = known.filter("flat").select(F.col("t.id").alias("task"), F.col("t.annotator").alias("annotator"), "pos", F.col("t.lead_time").alias("lead_time"), F.col("t.rating").alias("rating"), F.lit(None).cast("array<string>").alias("visual_action"))
    choice = lambda name: F.filter("a.result", lambda r: r["from_name"] == name)
    many = known.filter("NOT flat").select(F.col("t.id").alias("task"), F.posexplode("t.annotations").alias("pos", "a"))
    many = many.select("task", F.col("a.completed_by").alias("annotator"), "pos", F.col("a.lead_time").alias("lead_time"), F.try_element_at(F.try_element_at(choice("rating"), F.lit(1))["value"]["choices"], F.lit(1)).alias("rating"), F.flatten(F.transform(choice("visual_action"), lambda r: r["value"]["choices"])).alias("visual_action"))
    return one.unionByName(many)


def metric_name(stem: Column) -> Column:
    """SRC17: struct of model, type, trial, seed, timestamp and the key without seed and time; null for
    other names."""
    trial = stem.rlike(TRIAL_NAME)
    part = lambda p, k: F.regexp_extract(stem, p, k)
    model = F.when(trial, part(TRIAL_NAME, 1)).otherwise(part(METRIC_NAME, 1))
    kind = F.when(trial, "val").otherwise(part(METRIC_NAME, 2))
    number = F.when(trial, part(TRIAL_NAME, 2).try_cast("int"))
    key = F.concat(model, F.lit("_"), kind, F.when(trial, F.concat(F.lit("_t"), number.cast("string"))).otherwise(""))
    fields = F.struct(model.alias("model"), kind.alias("type"), number.alias("trial"), F.when(trial, part(TRIAL_NAME, 3)).otherwise(part(METRIC_NAME, 3)).try_cast("int").alias("seed"), F.when(trial, part(TRIAL_NAME, 4)).otherwise(part(METRIC_NAME, 4)).alias("timestamp"), key.alias("common_key"))
    return F.when(trial | stem.rlike(METRIC_NAME), fields)


def stem(file: Column) -> Column:
    return F.regexp_replace(file, r"\.[^.]*$", "")


def page_words(spark: SparkSession, path: str, schema: str = "doc string, page int, ord int, block int, line int, x0 double, y0 double, x1 double, y1 double, word string") -> DataFrame:
    """SRC15: words of PDF pages, by a PDF library inside tasks where the workers have one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with pymupdf.open(stream=content, filetype="pdf") as pdf:
                    for k, page in enumerate(pdf):
                        words = sorted(page.get_text("words"), key=lambda w: (w[5], w[6], w[7]))
                        yield pd.DataFrame([(name, k, i, w[5], w[6], *map(float, w[:4]), w[4]) for i, w in enumerate(words)], columns=[c.split(" ")[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def page_texts(words: DataFrame) -> DataFrame:
    """SRC15, second part: ``doc, page, text``: a new line where block or line changes, else a space."""
    listed = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "block", "line", "word"))).alias("w"))
    apart = lambda w, i: F.when(i == 0, "").when((w["block"] == F.get("w", i - 1)["block"]) & (w["line"] == F.get("w", i - 1)["line"]), " ").otherwise("\n")
    return listed.select("doc", "page", F.array_join(F.transform("w", lambda w, i: F.concat(apart(w, i), w["word"])), "").alias("text"))


def uploads(texts: DataFrame) -> DataFrame:
    """SRC16: ``path, text, cleaned, full, removed`` of whole texts: paragraphs joined, cleaned by lines,
    normalised, and the ranges of dropped lines in the normalised text."""
    from scriptorium.functions import text as T
    from scriptorium.operators import cleaning as C
    from scriptorium.session import bounded_batches

    raw = texts.select("path", T.paragraphs_joined(F.col("text")).alias("text"))
    before = C.before_lines(raw, "path")
    bounded_batches(texts.sparkSession)
    marked = C.marked(before, "path").withColumn("plain", C.normalised("line"))
    gone = C.removed_ranges(marked, "path")
    return raw.join(C.cleaned(raw, "path").withColumnRenamed("text", "cleaned"), "path").join(gone, "path", "left")


def taken(rows: DataFrame, order: str, skip: int, take: int) -> DataFrame:
    """STR10, SRC1: a bounded read of a source: rows ``skip`` to ``skip + take`` in order."""
    return rows.orderBy(order).offset(skip).limit(take)
