"""Registration of named queries with their DuckDB counterparts, and shared derivations.

The supplied tables stand in for the corpora of the field: line items are ratings and predictions,
documents are segments, their sources are books or genres.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``, with the SQL that has to give its rows."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to 6 digits, as both sides of a comparison are."""
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(name or c) if name or isinstance(c, str) else col


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as ratings: orders are tasks, line numbers annotators."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("annotator"), (F.col("l_quantity").cast("int") % 6).alias("rating"), F.col("l_extendedprice").alias("lead_time"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("ord")).groupBy("task", "annotator").agg(F.min_by(F.struct("rating", "lead_time"), "ord").alias("x")).select("task", "annotator", "x.rating", "x.lead_time")


RATINGS = """ratings AS (
  SELECT task, annotator, rating, lead_time FROM (
    SELECT l_orderkey AS task, l_linenumber AS annotator, CAST(trunc(l_quantity) AS INTEGER) % 6 AS rating, l_extendedprice AS lead_time,
           row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
    FROM lineitem) WHERE rn = 1)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as predictions: ``id, model, seed, split, y, p`` with labels 0 to 5."""
    li = table(spark, sf, "lineitem")
    y = (F.col("l_quantity").cast("int") % 6).alias("y")
    p = (F.col("l_quantity").cast("int") % 6 + F.round(F.col("l_discount") * 30, 2) - 1.5 + F.col("l_linenumber") * 0.01).alias("p")
    split = F.when(F.col("l_linestatus") == "O", "train").otherwise("test").alias("split")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("seed"), split, y, p)


PREDICTIONS = """preds AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS model, l_linenumber AS seed,
         CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'test' END AS split,
         CAST(trunc(l_quantity) AS INTEGER) % 6 AS y,
         CAST(trunc(l_quantity) AS INTEGER) % 6 + round(l_discount * 30, 2) - 1.5::DOUBLE + l_linenumber * 0.01::DOUBLE AS p
  FROM lineitem)"""


def md5_order(key: str, salt: str = "42") -> Column:
    """The order that stands for a shuffle: the same in any engine and at any partitioning."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{salt}")))
