"""Mixing sources to target weights, with DataFrame functions only.

Words per source are aggregated; each source gets a target by water-filling (weights, capped at
a multiple of its size); its documents are emitted ``floor(rate)`` times and once more with
probability equal to the fraction, drawn from a hash of the document's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cleared, row_of, small_side, unit_hash, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def word_count(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row per source: ``source, source_size, target``.

    ``sized`` has ``source`` and ``size``. Sources in code point order, null last, get the weights
    in turn. ``share`` of all words is dealt by weight; a source stops at ``most`` times its size
    and the excess is dealt among the others, until none is above. That fixed point is
    ``least(cap, level * weight)`` with one level for all, found by ordering the sources by
    cap / weight. Both windows run over one row per source, never over documents.
    """
    source = sized.groupBy("source").agg(F.sum("size").cast("double").alias("s"))
    ranked = source.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    weighed = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("s")).withColumn("ratio", F.col("cap") / F.col("w"))
    order, everything = W.orderBy("ratio", "rank"), W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (share * F.sum("s").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    stepped = weighed.withColumn("level", level)
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(chosen * F.col("w"), F.col("cap")))
    return stepped.select("source", F.col("s").cast("long").alias("source_size"), target.alias("target"))


def copies(rate: Column, seed: str = "mix") -> Column:
    """``floor(rate)`` and one more if the document's hash is below the fraction."""
    return (F.floor(rate) + F.when(unit_hash(F.lit(seed), "doc_id") < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def planned(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """``doc_id, size, source_size, target, copies``: a row per row of ``docs``.

    Null texts and texts without words have size 0; a source of size 0 has target and copies 0;
    null is a source of its own; rows that share a ``doc_id`` share their draw; other columns are
    ignored. An empty table gives an empty table.
    """
    sized = written(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    targets = small_side(written(source_targets(sized, **how), "targets").withColumnRenamed("source", "of"))
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    return sized.join(targets, sized["source"].eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", copies(rate, seed).alias("copies"))


def mixed(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as the mix takes it.

    Rows are counted and drawn as in :func:`planned`: those without words count 0 but are drawn at
    their source's rate, null is a source of its own, repeated rows share their draw, an empty table
    gives an empty table, and further columns, whatever their names, come back as they are.
    """
    with cleared(docs.sparkSession) as made:
        sized = written(docs.select("source", word_count().alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
        targets = written(source_targets(sized, **how), "targets")
        made.pop()  # a row per source, which the rows that are returned read
    rates = small_side(targets.select(F.col("source").alias("of"), F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate")))
    rows = docs.select("doc_id", "source", row_of(docs).alias("doc"))
    taken = rows.join(rates, rows["source"].eqNullSafe(F.col("of"))).select("doc", copies(F.col("rate"), seed).cast("int").alias("n")).filter("n > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: ``doc_id, size, source_size, target, taken``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return planned(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = {
    "op8_mixing": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source),
fill(step, source, s, w, target, full_up) AS (
  SELECT 0, source, s, w, 0.0::DOUBLE, false FROM src
  UNION ALL
  SELECT step + 1, source, s, w,
         CASE WHEN full_up THEN target ELSE least(2.0::DOUBLE * s, level * w) END,
         full_up OR level * w > 2.0::DOUBLE * s
  FROM (SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(CASE WHEN full_up THEN 2.0::DOUBLE * s END) OVER (), 0.0::DOUBLE))
               / nullif(coalesce(sum(CASE WHEN NOT full_up THEN w END) OVER (), 0.0::DOUBLE), 0) AS level FROM fill)
  WHERE step < (SELECT count(*) + 1 FROM src)),
goal AS (SELECT source, s, target FROM fill WHERE step = (SELECT max(step) FROM fill)),
rated AS (
  SELECT d.doc_id, d.size, g.s AS source_size, g.target, coalesce(g.target / nullif(g.s, 0), 0.0) AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
""",
}
