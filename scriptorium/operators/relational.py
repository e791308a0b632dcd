"""Filters, aggregates, samples and set operations that recur across the corpus jobs.

Where an order or a draw is needed it comes from keys and hashes, never from row positions, so every
result is the same at any partitioning. A cut of a global order is taken with ``orderBy().limit()``
(each task keeps its own best rows) rather than a window over one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import numbered, with_total


def first_by(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a given order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def book_filter(books: DataFrame, classes: list[str], banned: list[str], least_chars: int = 50_000) -> DataFrame:
    """FLT1: a class in ``locc`` (case-sensitive), no banned term in subjects or bookshelves, all years
    of ``issued`` from 1900 and of ``authors`` from 1850, and enough text."""
    years = lambda c, low: F.forall(F.coalesce(F.regexp_extract_all(F.col(c), F.lit(r"(\d{4})"), F.lit(1)), F.array().cast("array<string>")), lambda y: y.cast("int") >= low)
    has = lambda c, terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.coalesce(F.col(c), F.lit("")), t))
    lower = books.withColumns({"__s": F.lower("subjects"), "__b": F.lower("bookshelves")})
    keep = has("locc", classes) & ~has("__s", banned) & ~has("__b", banned) & years("issued", 1900) & years("authors", 1850) & (F.length("text") >= least_chars)
    return lower.filter(keep).drop("__s", "__b")


def length_window(text: str, least: int = 60, most: int = 500) -> Column:
    """FLT2: the lower bound tests the trimmed text, the upper one the text as it is."""
    return (F.length(F.trim(F.col(text))) >= least) & (F.length(text) <= most)


def skip_take(df: DataFrame, key: str, skip: int, take: int, accept: Column) -> DataFrame:
    """FLT3: skip counts raw rows, take counts accepted ones, both in order of a unique ``key``."""
    edge = df.orderBy(key).limit(skip).agg(F.max(key).alias("__edge"))
    rest = df.join(F.broadcast(edge), F.col("__edge").isNull() | (F.col(key) > F.col("__edge"))).drop("__edge")  # one row
    return rest.filter(accept).orderBy(key).limit(take)


def middle(items: Column) -> Column:
    """FLT5: the element at ``len // 2``."""
    return F.try_element_at(items, (F.floor(F.size(items) / 2) + 1).cast("int"))


def middle_lines(text: Column, n: int = 30) -> Column:
    """FLT6: ``n`` lines from ``max(0, lines // 2 - n // 2)`` on."""
    lines = F.split(text, "\n")
    start = F.greatest(F.floor(F.size(lines) / 2).cast("int") - n // 2, F.lit(0))
    return F.array_join(F.slice(lines, start + 1, n), "\n")


def year_of(*candidates: Column) -> Column:
    """FLT9: the first value that is a year: digits, a leading minus allowed."""
    return F.coalesce(*[F.when(c.rlike(r"^-?\d+$"), c.try_cast("int")) for c in candidates])


def tier(score: Column) -> Column:
    """FLT11."""
    return F.when(score >= 0.6, "success").when(score >= 0.25, "warning").otherwise("error")


def icon_tier(score: Column) -> Column:
    """FLT17: cuts of the percentage, rounded half up."""
    p = F.floor(score * 100 + 0.5)
    return sum(((p >= c).cast("int") for c in (40, 60, 80, 95)), (p >= 20).cast("int"))


def complexity(tokens: Column) -> Column:
    """FLT13."""
    return F.when(tokens <= 200, "low").when(tokens <= 900, "medium").otherwise("high")


def min_max(c: str, over: list[str] = ()) -> Column:
    """AGG9: scaled to 0..1; null without spread."""
    w = W.partitionBy(*over)
    return F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))


def min_max_of_all(df: DataFrame, c: str, name: str) -> DataFrame:
    """AGG9 without keys: the bounds are one row that meets all others."""
    bounds = df.agg(F.min(c).alias("low_"), F.max(c).alias("high_"))
    return df.crossJoin(F.broadcast(bounds)).select(*df.columns, F.try_divide(F.col(c) - F.col("low_"), F.col("high_") - F.col("low_")).alias(name))


def pattern_hits(df: DataFrame, column: str, patterns: DataFrame, key: str, pattern: str, most: int = 1_000) -> DataFrame:
    """JN12: ``df`` with ``key`` of each pattern that is found in ``column``, a row per hit. The patterns (a
    short list, ``most`` at most) become one expression per row, so nothing is joined."""
    rules = patterns.select(key, pattern).limit(most + 1).collect()
    if len(rules) > most:
        raise ValueError(f"more than {most} patterns")
    kind = patterns.schema[key].dataType
    hits = F.array(*[F.when(F.col(column).rlike(r[pattern]), F.lit(r[key]).cast(kind)) for r in rules if r[pattern] is not None])
    return df.select("*", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias(key))


def balanced_sample(df: DataFrame, group: str, item: str, key: str, total: int, per_item: int, groups: int, seed: str = "42") -> DataFrame:
    """SMP1: at most ``per_item`` rows of an item and ``total // groups`` of a group, then a top-up from
    what is left; the order within all is a hash of the key."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    hashed = df.withColumn("__h", h)
    first = first_by(first_by(hashed, [group, item], ["__h"], per_item), [group], ["__h"], total // groups)
    rest = hashed.join(first.select(key), key, "left_anti")
    short = total - first.count()
    return first.unionByName(rest.orderBy("__h").limit(max(short, 0))).drop("__h")


def preferential_sample(df: DataFrame, group: str, old: str, key: str, each: int, seed: str = "42") -> DataFrame:
    """SMP2: rows of new items first."""
    return first_by(df, [group], [F.col(old).cast("int"), F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))], each)


def hashed(df: DataFrame, key: str, seed: str) -> DataFrame:
    """``df`` with ``hash_``, the order that stands for a shuffle."""
    return df.withColumn("hash_", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))


def stratified_split(df: DataFrame, label: str, key: str, share: float, seed: str = "42") -> DataFrame:
    """SMP4: a column ``part``: the first ``ceil(share * n)`` rows of a label by hash are ``test``. Few
    labels hold all rows, so ranks are taken over range partitions."""
    ranked = with_total(numbered(hashed(df, key, seed), [label], ["hash_"], "rank_"), [label], "n_")
    return ranked.select(*df.columns, F.when(F.col("rank_") <= F.ceil(share * F.col("n_")), "test").otherwise("train").alias("part"))


def label_swap(rows: DataFrame, label: str, key: str, seed: str = "42") -> DataFrame:
    """SMP6: flagged rows of the test split change places with unflagged ones of the training split,
    as many of each label as both have; the flagged rows that remain in the test split are dropped.

    ``rows`` has booleans ``test`` and ``flagged``; the result has ``part``, for every other row.
    """
    ranked = numbered(hashed(rows, key, seed), [label, "test", "flagged"], ["hash_"], "rn").drop("hash_")
    n = rows.groupBy(F.col(label).alias("of")).agg(F.least(F.count_if(F.expr("test AND flagged")), F.count_if(F.expr("NOT test AND NOT flagged"))).alias("n"))
    joined = ranked.join(n, F.col(label).eqNullSafe(F.col("of"))).filter("NOT (test AND flagged AND rn > n)")
    part = F.when(F.expr("NOT flagged AND (test OR rn <= n)"), "test").otherwise("train")
    return joined.withColumn("part", part).drop("of", "n", "rn", "test", "flagged")


def top_up(pool: DataFrame, counts: DataFrame, label: str, rare: list[int], key: str, seed: str = "42") -> DataFrame:
    """SMP5: rows of ``pool`` that bring the rare labels to the mean count of the others."""
    goal = counts.agg(F.floor(F.avg(F.when(~F.col(label).isin(rare), F.col("n")))).alias("goal"))
    need = counts.filter(F.col(label).isin(rare)).crossJoin(goal).select(label, (F.col("goal") - F.col("n")).alias("need"))  # a row per label
    ranked = numbered(hashed(pool.filter(F.col(label).isin(rare)), key, seed), [label], ["hash_"], "rank_")
    return ranked.join(F.broadcast(need), label).filter("rank_ <= need").select(*pool.columns)


def folds(df: DataFrame, label: str | None, key: str, k: int = 5, seed: str = "42") -> DataFrame:
    """SMP8: fold numbers, stratified by a label if there is one; a plain fold is the hash itself."""
    h = hashed(df, key, seed)
    if label is None:
        return h.withColumn("fold", F.pmod(F.conv(F.substring("hash_", 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")).drop("hash_")
    return numbered(h, [label], ["hash_"], "rank_").select(*df.columns, ((F.col("rank_") - 1) % k).cast("int").alias("fold"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """AGG19: ``n / (labels * n_label)``."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    weights = counts.select(label, (F.sum("__n").over(W.partitionBy()) / (F.count("*").over(W.partitionBy()) * F.col("__n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)  # a row per label
