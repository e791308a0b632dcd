"""Overlap join of intervals by buckets, for keys of any size.

Intervals fall into levels by length; a level's buckets are as long as its longest intervals, so an
interval touches two of them at most. Two levels meet in the buckets of the larger one. A pair is
taken in the bucket where its overlap begins and nowhere else, so copies at boundaries never count
twice. A key's intervals spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 3  # powers of two from one level of lengths to the next


def level(start: str, end: str) -> Column:
    """The exponent of the least bucket size, in steps, that is no shorter than the interval."""
    n = F.greatest(F.col(end) - F.col(start), F.lit(1)).cast("long")
    exact = F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))
    return (F.ceil(exact / STEP) * STEP).cast("int")


def _dealt(side: DataFrame, keys: list[str], start: str, end: str, others: list[int], mine: str, theirs: str, row: str) -> DataFrame:
    """A row for each level of the other side and each bucket that the interval touches there."""
    cols = side.select(F.struct(*side.columns).alias(row), *[F.col(k).alias(f"{row}_{i}") for i, k in enumerate(keys)], F.col(start).cast("long").alias(f"{row}_from"), F.col(end).cast("long").alias(f"{row}_to"), level(start, end).alias(mine))
    met = cols.filter(f"{row}_to >= {row}_from").withColumn(theirs, F.explode(F.array(*map(F.lit, others))))
    size = F.greatest(mine, theirs)
    at = lambda x: F.call_function("shiftright", x, size)
    last = F.greatest(F.col(f"{row}_to") - 1, F.col(f"{row}_from"))
    return met.withColumn("bucket", F.explode(F.sequence(at(F.col(f"{row}_from")), at(last))))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """``left, right``: as structs, the pairs of rows with equal ``keys`` whose spans (whole numbers; from
    the first up to but not including the second) overlap: each starts before the other ends.

    Rows with a null key or bound, or an end before their start, meet nothing. A span of no length
    overlaps those that hold it inside. Repeated rows give repeated pairs. Columns may have any names.
    """
    levels = [sorted(r["level"] for r in side.select(level(*span).alias("level")).distinct().collect() if r["level"] is not None) for side, span in ((left, left_span), (right, right_span))]  # 22 at most
    a = _dealt(left, keys, *left_span, levels[1] or [0], "i", "j", "left").filter("left_from IS NOT NULL AND left_to IS NOT NULL")
    b = _dealt(right, keys, *right_span, levels[0] or [0], "j", "i", "right").filter("right_from IS NOT NULL AND right_to IS NOT NULL")
    same = (a["i"] == b["i"]) & (a["j"] == b["j"]) & (a["bucket"] == b["bucket"])
    for k in range(len(keys)):
        same &= F.col(f"left_{k}") == F.col(f"right_{k}")
    begins = F.call_function("shiftright", F.greatest("left_from", "right_from"), F.greatest(a["i"], a["j"]))
    return a.join(b, same & (F.col("left_from") < F.col("right_to")) & (F.col("right_from") < F.col("left_to")) & (begins == a["bucket"])).select("left", "right")
