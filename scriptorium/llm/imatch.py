"""I-Match fingerprints with DataFrame functions only.

The lexicon is the terms within a band of inverse document frequency. Each of several randomised
subsets of it gives one hash of a document: of its terms in that subset, distinct and sorted. The
likeness of two documents is the share of subsets whose hashes agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_side, written

#: The band: a term is in from 1 of 250 documents up to 1 of 10. With N documents of D distinct
#: terms on average, at most N D / (N / 250) = 250 D terms lie in it, whatever N is. The lexicon is
#: broadcast where it is as small as that and else joined by a shuffle.
LEAST, MOST = 0.004, 0.10
#: Subset k holds each term with probability 1 / 2 ** DEPTHS[k]; the first one holds all, so every term counts.
DEPTHS = (0, *(3, 4, 5, 6, 7, 8, 9, 10) * 4)
RANGES = 1024  # of ids at most


def terms(text: Column) -> Column:
    """Distinct words (letters and digits, lower case)."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(texts: DataFrame, least: float = LEAST, most: float = MOST, depths=DEPTHS) -> DataFrame:
    """``term, mask`` of the terms in the band, as 64-bit hashes: bit k says that subset k has it.
    Frequencies count all rows of ``texts``; terms in no subset are left out."""
    n = texts.count()
    df = texts.select(F.explode(terms(F.col("text"))).alias("t")).select(F.xxhash64("t").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.filter((F.col("df") >= least * n) & (F.col("df") <= max(most * n, 2)))
    bits = [F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(1 << d)) == 0, F.lit(1 << k)).otherwise(0).cast("long") for k, d in enumerate(depths)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return written(band.select("term", mask.alias("mask")).filter("mask <> 0"), "lexicon")


def ranged(docs: DataFrame) -> DataFrame:
    """``doc_id, text, range, late``: the rows dealt to ranges of ids, and behind each range a late
    copy of the first row of the next one (behind the last range, of the very first row)."""
    spark = docs.sparkSession
    n = min(RANGES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20_000)).first()[0] or []))
    at = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0))
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), at.cast("int").alias("range"))
    first = placed.groupBy("range").agg(F.min("doc_id").alias("head"))
    before = F.coalesce(F.lag("range").over(W.orderBy("range")), F.max("range").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = F.broadcast(written(first.select("range", "head", before.alias("to")), "heads").withColumnRenamed("range", "of"))  # a row per range
    both = placed.join(heads, (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    here = F.struct(F.col("range"), F.lit(0).alias("late"))
    there = F.struct(F.col("to").alias("range"), F.lit(1).alias("late"))
    return both.select("doc_id", "text", F.explode(F.when(F.col("of").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("p")).select("doc_id", "text", "p.range", "p.late")


def hashes(found: str, depths=DEPTHS) -> Column:
    """The hash of the sorted terms of each subset; null where there are none."""
    def one(k: int) -> Column:
        inside = F.filter(found, lambda x: x["mask"].bitwiseAND(F.lit(1 << k)) != 0)
        return F.when(F.size(inside) > 0, F.xxhash64(F.transform(inside, lambda x: x["term"])))

    return F.array(*[one(k) for k in range(len(depths))])


def text_form(found: str, whole: str) -> Column:
    """A fingerprint as text: a part for each subset, ``-`` for none; a document without any term of
    the lexicon has the hash of its text instead."""
    parts = F.transform(found, lambda x: F.coalesce(F.substring(F.lpad(F.lower(F.hex(x)), 16, "0"), 1, 8), F.lit("-")))
    empty = F.forall(found, lambda x: x.isNull())
    return F.when(empty, F.concat(F.lit("text "), F.lower(F.hex(whole)))).otherwise(F.array_join(parts, " "))


def likeness(a: str, b: str, text_a: str, text_b: str) -> Column:
    """Equal hashes among the subsets of which either document has terms; with none, 1 for equal
    texts and else 0."""
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() | p["y"].isNotNull())
    same = F.size(F.filter(pairs, lambda p: F.coalesce(p["x"] == p["y"], F.lit(False))))
    return F.when(F.size(pairs) > 0, same / F.size(pairs)).otherwise((F.col(text_a) == F.col(text_b)).cast("double"))


def fingerprints(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and their likenesses.

    Null is the empty text. Rows with a null ``doc_id`` come last; rows that share a ``doc_id`` are
    ordered by their texts; a single row is its own next one. Extra columns are ignored.

    The rows are shuffled once, by range of ids: the next text, the terms of a row and the next
    fingerprint all need rows of one range only.
    """
    words = small_side(lexicon(docs.select("text"), least, most))
    order = W.partitionBy("range").orderBy("late", F.asc_nulls_last("doc_id"), "text")
    size = F.length("text")
    cut = F.floor(size / 4).cast("int")
    following = ranged(docs).select("*", F.row_number().over(order).alias("pos"), F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"))
    edited = following.select("range", "pos", "late", "doc_id", size.cast("long").alias("n_chars"), "text", F.concat(F.col("text").substr(F.lit(1), size - cut), F.col("next").substr(F.lit(1), cut)).alias("edited"))
    hashed = edited.withColumns({"edited_sha256": F.sha2("edited", 256), "h": F.xxhash64("text"), "eh": F.xxhash64("edited")})
    carried = hashed.select("range", "pos", F.struct("late", "doc_id", "n_chars", "edited_sha256", "h", "eh").alias("row"), F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("text")))).alias("x"))
    # The empty term stands for the row itself, and keeps rows without a term of the lexicon.
    exploded = carried.select("range", "pos", F.when(F.col("x.v") == 0, F.col("row")).alias("row"), "x.v", F.explode(F.concat(F.array(F.lit("")), terms(F.col("x.text")))).alias("t"))
    hit = exploded.select("range", "pos", F.when(F.col("t") == "", F.col("row")).alias("row"), "v", (F.col("t") == "").alias("own_row"), F.when(F.col("t") != "", F.xxhash64("t")).otherwise(F.xxhash64("range", "pos", "v")).alias("term0")).join(words, F.col("term0") == F.col("term"), "left").filter("term IS NOT NULL OR own_row").withColumn("term", F.when(~F.col("own_row"), F.col("term")))
    entry = F.struct("term", "mask")
    grouped = hit.groupBy("range", "pos").agg(F.max("row").alias("row"), *[F.array_sort(F.collect_set(F.when(F.col("term").isNotNull() & (F.col("v") == v), entry))).alias(name) for v, name in ((0, "own"), (1, "other"))])
    made = grouped.select("range", "pos", "row.*", hashes("own").alias("f"), hashes("other").alias("g"))
    after = W.partitionBy("range").orderBy("pos")
    with_next = made.select("*", F.lead("f").over(after).alias("nf"), F.lead("h").over(after).alias("nh")).filter("late = 0")
    return with_next.select(
        "doc_id", "n_chars", "edited_sha256", text_form("f", "h").alias("fingerprint"), text_form("g", "eh").alias("edited_fingerprint"),
        likeness("f", "g", "h", "eh").alias("near_edited"), likeness("f", "nf", "h", "nh").alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
