"""Cleaning of raw texts by lines, segmentation, page joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from scriptorium.functions import text as T
from scriptorium.session import bounded_batches


def line_list(text: Column) -> Column:
    """CLN5: a text's trimmed non-empty lines as an array."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\u000b"))), lambda x: x != "")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """CLN5: trimmed non-empty lines with their number."""
    return docs.select(key, F.posexplode_outer(line_list(F.col(text))).alias("line_no", "line")).filter("line_no IS NOT NULL")


def metadata_line(line: Column, previous: Column) -> Column:
    """CLN7: front or back matter: not the end of a paragraph, no dialogue or question, a keyword, and
    few words or all upper case."""
    strong = previous.rlike(r"[.!?。:\"']$") | T.long_enough(previous)
    ends = line.rlike(r"[.!?。:\"']$") & F.coalesce((previous != "") & strong, F.lit(False))
    hits = T.keyword_hits(line)
    words = F.regexp_count(line, F.lit(" ")) + 1
    shouted = (line == F.upper(line)) & (line != F.lower(line))
    return ~ends & ~line.rlike(r"[!?\":]") & (hits >= 1) & ((words < 10 + hits) | shouted)


def marks(text: Column) -> Column:
    """CLN6-7 inside a text's row: its lines as structs ``line, prev, dropped``; the previous line counts even where it was
    dropped itself."""
    cased = F.transform(line_list(text), lambda x: F.struct(x.alias("line"), T.plain_case(x).alias("low")))
    nothing = F.array(F.lit(None).cast("struct<line:string,low:string>"))
    rated = lambda ls: F.zip_with(ls, F.slice(F.concat(nothing, ls), 1, F.size(ls)), lambda x, p: F.struct(x["line"].alias("line"), p["line"].alias("prev"), (T.dropped_line(x["line"], x["low"]) | metadata_line(x["line"], p["line"])).alias("dropped")))
    return F.get(F.transform(F.array(cased), rated), F.lit(0))  # so that the lines are formed once


def dealt(docs: DataFrame) -> DataFrame:
    """Texts over as many tasks as there are cores, where the source has fewer."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def marked(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """CLN6-7: a row for each line, with ``dropped``."""
    rows = dealt(docs).select(key, F.posexplode_outer(marks(F.col("text"))).alias("line_no", "x"))
    return rows.filter("line_no IS NOT NULL").select(key, "line_no", "x.*")


def before_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """CLN2: ``key, text`` before cleaning by lines. (A generator, as Spark would push conditions on the text below a
    projection and form it twice.)"""
    return dealt(docs).select(key, F.explode_outer(F.array(T.before_clean(F.col("text")))).alias("text"))


def by_lines(before: DataFrame, key: str = "doc_id") -> DataFrame:
    """CLN4-CLN9 of texts as CLN2 left them: those of ten characters at least become their kept lines joined again."""
    kept = F.array_join(F.transform(marks(F.col("text")), lambda x: F.when(x["dropped"], "\n").otherwise(x["line"])), "\n")
    return before.select(key, F.when(F.length("text") < 10, F.col("text")).when(F.col("text").isNotNull(), kept).alias("text"))


def cleaned(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """CLN2, CLN4-CLN9: ``key, text``: texts before cleaning by lines, and if they have ten characters
    at least, their kept lines joined again, with a line break in a dropped one's place. Null stays
    null; a text without lines is empty. A text stays in its row."""
    return by_lines(before_lines(docs, key), key)


def removed_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """CLN9: ``key, removed``: the numbers of a text's dropped lines."""
    before = before_lines(docs, key).filter(F.length("text") >= 10)
    found = before.select(key, F.explode_outer(F.array(marks(F.col("text")))).alias("ls")).filter(F.size("ls") > 0)
    numbered = F.transform("ls", lambda x, i: F.when(x["dropped"], i))
    return found.select(key, F.filter(numbered, lambda i: i.isNotNull()).alias("removed"))


def removed_ranges(marked_lines: DataFrame, key: str = "doc_id", plain: str = "plain") -> DataFrame:
    """WIN6: ``key, full, removed``: the joined normalised lines and where in them dropped lines lie."""
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    placed = marked_lines.withColumn("start", F.coalesce(F.sum(F.length(plain)).over(w), F.lit(0)).cast("int"))
    span = F.when(F.col("dropped") & (F.length(plain) > 0), F.struct("start", (F.col("start") + F.length(plain)).cast("int").alias("stop")))
    full = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", plain))), lambda x: x[plain]), "")
    return placed.groupBy(key).agg(full.alias("full"), F.array_sort(F.collect_list(span)).alias("removed"))


NORMALISED = re.compile(r"[\s\-‐‑‒–—]+")  # fixed value: what normalised text leaves out


@F.pandas_udf(Y.StringType())
def normalised(texts: pd.Series) -> pd.Series:
    """CLN10: NFKC, plain quotes, no white space and hyphens. Spark has no NFKC of its own."""
    return texts.str.normalize("NFKC").str.translate(str.maketrans("’“”", "'\"\"", "\r\ufeff")).str.replace(NORMALISED, "", regex=True)


def joined_pages(pages: DataFrame) -> DataFrame:
    """CLN11: ``doc_id, page, text``: a page is joined to the one before when that ends inside a
    sentence and this one goes on as a continuation."""
    w = W.partitionBy("doc_id").orderBy("page")
    open_end, goes_on = r"""(?U)[\w,;'–—-][")\]>]?\s*$""", r"""(?U)^\s*[\w,;("'–—-]"""
    starts = ~(F.coalesce(F.lag("text").over(w), F.lit(".")).rlike(open_end) & F.col("text").rlike(goes_on))
    run = F.sum(starts.cast("int")).over(w)
    return pages.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("page").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), " ").alias("text")).drop("run")


def pack(text: str, least: int = 150, most: int = 500) -> list[str]:
    """SEG1 for one text: units by empty line, line, sentence, word and character, the coarsest that
    fits, packed until ``least`` and never beyond ``most``."""
    levels = ("\n\n", "\n", ". ", " ")

    def units(t: str, k: int) -> Iterator[str]:
        if len(t) <= most:
            yield t
        elif k == len(levels):
            yield from (t[i : i + most] for i in range(0, len(t), most))
        else:
            parts = t.split(levels[k])
            for i, p in enumerate(parts):
                yield from units(p + (levels[k] if i + 1 < len(parts) else ""), k + 1)

    out, now = [], ""
    for u in units(text, 0):
        if now and (len(now) >= least or len(now) + len(u) > most):
            out.append(now)
            now = ""
        now += u
    if now:
        out.append(now)
    return [s for s in (x.strip() for x in out) if s]


@F.pandas_udf(Y.ArrayType(Y.StringType()))
def segments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: pack(t) if t else [])


def segmented(docs: DataFrame, first: int = 0, key: str = "doc_id") -> DataFrame:
    """SEG1-3: ``segment_id, doc_id, pos, text``; numbering starts at ``first``."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(key, F.posexplode(segments("text")).alias("pos", "text"))
    return rows.select(F.concat_ws("_", F.col(key).cast("string"), (F.col("pos") + first).cast("string")).alias("segment_id"), key, "pos", "text")
