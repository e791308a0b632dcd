"""Exact running sums and row numbers within few, huge groups.

A window by key puts all rows of a key into one task. Here rows are range-partitioned by key and
order, so a key spreads over as many partitions as its rows fill; each partition sums its own rows,
and what the earlier partitions of the key hold is added. The second pass sees a row for each key
and partition. Rows that compare equal are spread too: the last of the columns to sort by tells all
rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.session import cut, few

def running_sum(df: DataFrame, keys: list[str], order: list[str], what: Column | str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``what`` over the rows of the same ``keys`` up to this one.

    ``order`` names the columns to sort by; a leading minus reverses one, and nulls come last. Nulls
    among the keys are a key; a null ``what`` adds nothing. Rows equal in ``order`` are summed one after
    the other, in any order. No rows give none.
    """
    key_cols, by_cols = [f"key{i}_" for i in range(len(keys))], [f"by{i}_" for i in range(len(order))]
    value = F.coalesce(F.col(what) if isinstance(what, str) else what, F.lit(0)).alias("what_")
    held = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"), value, F.monotonically_increasing_id().alias("tie_"),
        *[F.col(k).alias(c) for k, c in zip(keys, key_cols)], *[F.col(o.lstrip("-")).alias(c) for o, c in zip(order, by_cols)],
    )
    sort = [F.desc_nulls_last(c) if o[0] == "-" else F.asc_nulls_last(c) for o, c in zip(order, by_cols)] + [F.asc("tie_")]
    placed = cut(held.repartitionByRange(*[F.asc_nulls_last(k) for k in key_cols], *sort).withColumn("part_", F.spark_partition_id()))
    inside = W.partitionBy("part_", *key_cols).orderBy(*sort).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = placed.select("row_", "part_", *key_cols, F.sum("what_").over(inside).alias("own_"))
    sums = placed.groupBy("part_", *key_cols).agg(F.sum("what_").alias("all_"))
    earlier = W.partitionBy(*key_cols).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(F.col("part_").alias("of_"), *[F.col(k).alias(f"{k}of") for k in key_cols], F.sum("all_").over(earlier).alias("before_"))
    offset = few(cut(before.filter("before_ IS NOT NULL")))
    same = F.col("part_") == F.col("of_")
    for k in key_cols:
        same &= F.col(k).eqNullSafe(F.col(f"{k}of"))
    return own.join(offset, same, "left").select("row_.*", (F.col("own_") + F.coalesce("before_", F.lit(0))).alias(name))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's number, from 1, among the rows of the same ``keys`` in ``order``."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), name)


def with_total(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: how many rows have the same ``keys`` (null is a key). Counts are formed before
    the shuffle and joined back."""
    counts = cut(df.groupBy(*[F.col(k).alias(f"of{i}_") for i, k in enumerate(keys)]).agg(F.count("*").alias(name)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"of{i}_"))
    return df.join(few(counts), same).select(*df.columns, name)


def cumulative_share(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the share of the rows of the same ``keys`` whose ``value`` is at most this
    one's; nulls are the largest. Rows are counted by key and value first, so only distinct values are
    ordered."""
    counts = cut(df.groupBy(*keys, value).agg(F.count("*").alias("n_")))
    upto = running_sum(counts, keys, [value], "n_", "upto_").drop("n_")
    totals = counts.groupBy(*[F.col(k).alias(f"of{i}_") for i, k in enumerate(keys)]).agg(F.sum("n_").alias("total_"))
    same, again = F.lit(True), F.col(value).eqNullSafe(F.col("value_of"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"of{i}_"))
        again &= F.col(k).eqNullSafe(F.col(f"key{i}_of"))
    shares = upto.join(few(cut(totals)), same).select(*[F.col(k).alias(f"key{i}_of") for i, k in enumerate(keys)], F.col(value).alias("value_of"), (F.col("upto_") / F.col("total_")).alias(name))
    return df.join(shares, again).select(*df.columns, name)
