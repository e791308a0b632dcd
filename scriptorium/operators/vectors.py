"""The feature vector by layout: places of the extractors, assembly, and the way back.

Features are in long form (``doc_id, extractor, index, value``, zeros left out) or in arrays of places and values until a
text's rows are folded into one sparse vector; no step has a column per feature.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extractors in the vector's order with their sizes.
LAYOUT = {
    "quote_ratio": 1, "char_ngrams": 1000, "word_lengths": 15, "sliding_lengths": 15, "sentence_lengths": 27, "numeric_words": 1, "type_token": 1, "lexical_density": 1, "syllables": 2, "stopwords": 1, "articles": 2,
    "punctuation": 16, "contractions": 1, "case_positions": 9, "case_bigrams": 9, "fine_tags": 50, "tag_ngrams": 995, "tree_structure": 92, "tree_ngrams": 1319, "phrase_lengths": 14, "entities": 6, "events": 1, "supersense": 41,
    "tense": 4, "polysemy": 15, "concreteness": 21, "imageability": 11, "places": 1,
}
SIZE = sum(LAYOUT.values())
OFFSET = dict(zip(LAYOUT, accumulate(LAYOUT.values(), initial=0)))


def layout(spark: SparkSession, sizes: dict[str, int] = LAYOUT) -> DataFrame:
    """``extractor, offset, size``: a row per extractor."""
    starts = accumulate(sizes.values(), initial=0)
    return spark.createDataFrame([(name, start, size) for (name, size), start in zip(sizes.items(), starts)], "extractor string, offset int, size int")


def placed(rows: DataFrame, sizes: dict[str, int] = LAYOUT) -> DataFrame:
    """``doc_id, feature, value`` of ``doc_id, extractor, index, value``: zeros and nulls are left out. An
    unknown extractor, or an index outside its extractor's range, is an error."""
    known = F.broadcast(layout(rows.sparkSession, sizes))  # a row per extractor
    wrong = F.concat_ws(" ", F.lit("no place for"), "extractor", F.col("index").cast("string"))
    inside = F.col("offset").isNotNull() & F.col("index").between(0, F.col("size") - 1)
    place = F.when(inside, F.col("offset") + F.col("index")).otherwise(F.raise_error(wrong).cast("int"))
    joined = rows.filter("value <> 0").join(known, "extractor", "left")
    return joined.select("doc_id", place.cast("int").alias("feature"), F.col("value").cast("double").alias("value"))


def assembled(docs: DataFrame, features: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, size, indices, values``: the sparse vector of every document of ``docs``, in ascending
    order of the places; documents without features have empty arrays. A place that has two values
    is an error. A document's rows (at most ``size``) are folded in one shuffle by ``doc_id``; they are
    ``doc_id, feature, value``, or ``doc_id, pairs`` with arrays of both."""
    pairs = F.flatten(F.collect_list("pairs")) if "pairs" in features.columns else F.collect_list(F.struct("feature", "value"))
    each = features.groupBy("doc_id").agg(F.array_sort(pairs).alias("p")).withColumn("kinds", F.size(F.array_distinct(F.col("p.feature"))))
    sound = F.when(F.size("p") == F.col("kinds"), F.col("p")).otherwise(F.raise_error(F.concat(F.lit("two values for a place in "), F.col("doc_id").cast("string"))).cast("array<struct<feature:int,value:double>>"))
    joined = docs.select("doc_id").distinct().join(each.select("doc_id", sound.alias("p")), "doc_id", "left")
    pick = lambda name, kind: F.coalesce(F.transform("p", lambda x: x[name]), F.array().cast(f"array<{kind}>"))
    return joined.select("doc_id", F.lit(size).alias("size"), pick("feature", "int").alias("indices"), pick("value", "double").alias("values"))


def whole(docs: DataFrame, lists: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, size, indices, values`` as ``assembled`` has it, of one row of ``doc_id, indices, values`` for each of
    ``docs``, which stays in its place: only ids are looked through for one that is there twice, an error. Rows without an id
    are one empty vector."""
    twice = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").head(1)
    if twice:
        raise ValueError(f"two values for a place in {twice[0]['doc_id']}")
    none = docs.filter("doc_id IS NULL").select("doc_id").distinct().select("doc_id", F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values"))
    return lists.filter("doc_id IS NOT NULL").unionByName(none).select("doc_id", F.lit(size).alias("size"), "indices", "values")


def dense(size: Column | str = "size", indices: Column | str = "indices", values: Column | str = "values") -> Column:
    """The sparse vector as one array: runs of zeros between the values, in time that grows with the size."""
    size, indices, values = (F.col(c) if isinstance(c, str) else c for c in (size, indices, values))
    gap = lambda x, i: F.when(i == 0, x).otherwise(x - F.get(indices, i - 1) - 1)
    runs = F.transform(indices, lambda x, i: F.concat(F.array_repeat(F.lit(0.0), gap(x, i).cast("int")), F.array(F.get(values, i))))
    last = F.coalesce(F.element_at(F.when(F.size(indices) > 0, indices), -1), F.lit(-1))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(0.0), (size - last - 1).cast("int")))


def part(vector: Column | str, extractor: str, sizes: dict[str, int] = LAYOUT) -> Column:
    """An extractor's part of a dense vector."""
    starts = dict(zip(sizes, accumulate(sizes.values(), initial=0)))
    return F.slice(F.col(vector) if isinstance(vector, str) else vector, starts[extractor] + 1, sizes[extractor])


def without(vector: Column | str, dropped: list[str], sizes: dict[str, int] = LAYOUT) -> Column:
    """FLT14, ML8: a dense vector less the parts of some extractors; neighbours that stay are one slice."""
    if unknown := set(dropped) - set(sizes):
        raise ValueError(f"no such extractors: {sorted(unknown)}")
    runs, at = [], 0
    for name, size in sizes.items():
        if name not in dropped:
            runs = [*runs[:-1], (runs[-1][0], at + size)] if runs and runs[-1][1] == at else [*runs, (at, at + size)]
        at += size
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.concat(*[F.slice(vector, a + 1, b - a) for a, b in runs]) if runs else F.array().cast("array<double>")


def rows_of(vectors: DataFrame, sizes: dict[str, int] = LAYOUT) -> DataFrame:
    """The way back: ``doc_id, extractor, index, value`` of sparse vectors."""
    known = F.broadcast(layout(vectors.sparkSession, sizes))
    long = vectors.select("doc_id", F.explode(F.arrays_zip("indices", "values")).alias("x")).select("doc_id", F.col("x.indices").alias("feature"), F.col("x.values").alias("value"))
    inside = (F.col("feature") >= F.col("offset")) & (F.col("feature") < F.col("offset") + F.col("size"))
    return long.join(known, inside).select("doc_id", "extractor", (F.col("feature") - F.col("offset")).alias("index"), "value")
