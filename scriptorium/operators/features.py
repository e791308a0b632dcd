"""Per-document features over word tables, and the sequence operators of lexicons.

``words`` is ``doc_id, pos, word``. Extractors over it fold into one wide aggregate, so a document's
words are shuffled once whatever the number of features.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.session import cut, few

PUNCTUATION = (".", ",", "!", "?", ";", ":", "-", "'", "(", ")")


def words(docs: DataFrame, pattern: str = r"([\p{L}\p{N}']+)") -> DataFrame:
    """Words of a text in order; an annotator's token table takes this one's place."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("pos", "word"))


def texts_words(docs: DataFrame, pattern: str = r"([\p{L}\p{N}']+)") -> DataFrame:
    """``doc_id, words``: a text's words in order as one array. Rows that share a ``doc_id`` are one text's parts. Only
    the texts are shuffled: what follows by ``doc_id`` finds them dealt."""
    parts = docs.groupBy("doc_id").agg(F.collect_list("text").alias("ts"))
    return parts.select("doc_id", F.flatten(F.transform("ts", lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))).alias("words"))


def listed(table: DataFrame, column: str = "word", keys: list[str] = ("doc_id",)) -> DataFrame:
    """``keys, words`` of a table of words in order ``pos``; a table of that form already is left as it is."""
    if "words" in table.columns:
        return table
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(column).alias("x")))), lambda r: r["x"])
    return table.groupBy(*keys).agg(rows.alias("words"))


def unlisted(lists: DataFrame, each: Column, *names: str) -> DataFrame:
    """A row for each element of ``each``, an array of structs. (``outer``, as else Spark filters empty arrays first and
    forms them twice.)"""
    return lists.select(*names, F.posexplode_outer(each).alias("at", "x")).filter("at IS NOT NULL").select(*names, "at", "x.*")


def shifted(words: Column | str, most: int) -> Column:
    """Words with the next ones beside them: structs of ``g0`` to ``g(most - 1)``."""
    words = F.col(words) if isinstance(words, str) else words
    return F.arrays_zip(*[(words if k == 0 else F.slice(words, k + 1, F.greatest(F.size(words), F.lit(0)))).alias(f"g{k}") for k in range(most)])


def share(hit: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count("*")), F.lit(0.0))


def wide(table: DataFrame, most: int = 100_000) -> DataFrame:
    """FEA3, FEA7, FEA9, FEA11, FEA13: all rates of a text's words, in one aggregate by text.

    Syllables of the ``most`` frequent words are estimated once and travel with the tasks; those of rarer words are
    estimated where they stand.
    """
    lists = listed(table)
    kinds = F.size(F.array_distinct(F.transform("words", T.casefolded)))
    word, s = F.col("word"), F.coalesce("s", T.syllables(F.col("word")))
    every = unlisted(lists.select("doc_id", "words", kinds.alias("kinds")), F.transform("words", lambda w: F.struct(w.alias("word"))), "doc_id", "kinds").drop("at")
    frequent = every.groupBy("word").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "word").limit(most)
    known = F.broadcast(cut(frequent.select("word", T.syllables(word).alias("s"))))
    rated = every.join(known, "word", "left").select("doc_id", "kinds", "word", T.casefolded(word).alias("f"), s.alias("s"))
    n, size = F.count("*"), F.least(F.length("word"), F.lit(15))
    part = lambda hit: F.coalesce(F.try_divide(F.count_if(hit).cast("double"), n), F.lit(0.0))
    return rated.groupBy("doc_id").agg(
        n.alias("words"), *[part(size == k).alias(f"length_{k}") for k in range(1, 16)],
        F.try_divide(F.first("kinds").cast("double"), n).alias("type_token"),
        F.least(F.try_divide(F.sum("s").cast("double"), n) / 8, F.lit(1.0)).alias("syllables"), part(F.col("s") >= 3).alias("polysyllables"),
        part(F.col("f") == "the").alias("the"), part(F.col("f").isin("a", "an")).alias("a_an"), part(F.contains("word", F.lit("'"))).alias("contractions"),
    )


def type_token(table: DataFrame) -> DataFrame:
    """FEA7: ``doc_id, type_token``: different folded words out of the words."""
    lists = listed(table).filter(F.size("words") > 0)
    return lists.select("doc_id", (F.size(F.array_distinct(F.transform("words", T.casefolded))) / F.size("words")).alias("type_token"))


def sliding_lengths(table: DataFrame, n: int = 3, bins: int = 15) -> DataFrame:
    """FEA4: ``doc_id, bin, share`` of sums of three word lengths in a row. A text of fewer words has
    one short window; a sum under ``n`` falls into the last bin, as an index of -1 does."""
    lists = listed(table).select("doc_id", F.transform("words", lambda w: F.length(w)).alias("sizes")).filter(F.size("sizes") > 0)
    nexts = unlisted(lists.select("doc_id", "sizes", F.greatest(F.size("sizes") - n + 1, F.lit(1)).alias("d")), shifted("sizes", n), "doc_id", "d").filter(F.col("at") < F.col("d"))
    s = sum((F.coalesce(f"g{k}", F.lit(0)) for k in range(1, n)), F.coalesce("g0", F.lit(0)))
    place = F.floor((s - n) / n).cast("int")
    binned = nexts.select("doc_id", "d", F.when(place < 0, bins - 1).otherwise(F.least(place, F.lit(bins - 1))).alias("bin"))
    return binned.groupBy("doc_id", "bin").agg(F.count("*").alias("c"), F.first("d").alias("d")).select("doc_id", "bin", (F.col("c") / F.col("d")).alias("share"))


def case_positions(table: DataFrame, sentences: str = "sentence") -> DataFrame:
    """FEA14: shares of case class by place in the sentence (first, inner, last) among all words."""
    w = W.partitionBy("doc_id").orderBy("pos")
    first = F.coalesce(F.lag(sentences).over(w) != F.col(sentences), F.lit(True))
    last = F.coalesce(F.lead(sentences).over(w) != F.col(sentences), F.lit(True))
    placed = table.select("doc_id", T.case_class(F.col("word")).alias("case"), F.when(first, "first").when(last, "last").otherwise("inner").alias("place"), F.count("*").over(W.partitionBy("doc_id")).alias("n"))
    return placed.filter("case IS NOT NULL").groupBy("doc_id", "case", "place").agg((F.count("*") / F.first("n")).alias("share"))


def case_bigrams(table: DataFrame) -> DataFrame:
    """FEA15: pairs of neighbouring words by case, out of the number of words less one."""
    cases = listed(table).select("doc_id", F.size("words").alias("n"), F.transform("words", T.case_class).alias("cs"))
    pairs = unlisted(cases, shifted("cs", 2), "doc_id", "n").filter("g0 IS NOT NULL AND g1 IS NOT NULL")
    return pairs.groupBy("doc_id", F.col("g0").alias("a"), F.col("g1").alias("b")).agg((F.count("*") / (F.first("n") - 1)).alias("share"))


def ngrams(table: DataFrame, column: str, low: int, high: int, keys: list[str] = ("doc_id",)) -> DataFrame:
    """FEA17: counts of runs of ``column``, ``n`` of ``low`` to ``high`` in a row."""
    nexts = unlisted(listed(table, column, keys), shifted("words", high), *keys)
    runs = [F.when(F.col(f"g{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *[f"g{k}" for k in range(n)]).alias("gram"))) for n in range(low, high + 1)]
    return nexts.select(*keys, F.explode(F.filter(F.array(*runs), lambda x: x.isNotNull())).alias("x")).select(*keys, "x.n", "x.gram").groupBy(*keys, "n", "gram").agg(F.count("*").alias("count"))


def depths(edges: DataFrame) -> DataFrame:
    """``tree, node, depth`` of edges ``tree, node, head`` (a null head is a root, of depth 1), by pointer
    doubling: each node knows an ancestor and how far up it is, and asks that one for its own, so the
    known way doubles. A chain of n nodes takes log2(n) + 1 rounds, each a join and a checkpoint of the
    nodes that are still under way.

    Nodes under a head that isn't there have no depth. Nodes that never end are on a cycle, which is an error.
    """
    state = cut(edges.select("tree", "node", F.col("head").alias("up"), F.when(F.col("head").isNull(), 0).otherwise(1).alias("far")))
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    for _ in range(rounds):
        going = state.filter("up IS NOT NULL")
        if going.isEmpty():
            return state.select("tree", "node", (F.col("far") + 1).alias("depth"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"))
        moved = going.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"))
        state = cut(state.filter("up IS NULL").unionByName(moved))
    if not state.filter("up IS NOT NULL").isEmpty():
        raise ValueError("the edges have a cycle")
    return state.select("tree", "node", (F.col("far") + 1).alias("depth"))


def tree_shape(edges: DataFrame) -> DataFrame:
    """FEA18: ``tree, depth, width, branching`` of edges ``tree, node, head`` (a null head is the root): the
    deepest node's depth, the number of leaves and the most children of a node."""
    inner = edges.filter("head IS NOT NULL").groupBy("tree", F.col("head").alias("node")).agg(F.count("*").alias("children"))
    whole = depths(edges).join(inner, ["tree", "node"], "left")
    return whole.groupBy("tree").agg(F.max("depth").alias("depth"), F.count_if(F.col("children").isNull()).alias("width"), F.max(F.coalesce("children", F.lit(0))).alias("branching"))


def lexicon_spans(table: DataFrame, lexicon: DataFrame, most: int) -> DataFrame:
    """LEX1: ``doc_id, n, spans``: the number of words of each text that has any, and as an array its longest
    matches from left to right that don't overlap, as structs of ``start, stop, value``.

    Words that begin no entry are passed over first; then runs of up to ``most`` words meet the lexicon
    by an equi-join. The pick is a fold over a text's candidates in order, the longest of a place
    first. A text's first word is always kept, so that texts without matches stay.
    """
    known = few(lexicon.groupBy("expression").agg(F.max("value").alias("value")))
    parts = F.split("expression", " ")
    heads = few(known.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), " "))).alias("g0")).distinct().withColumn("begins", F.lit(True)))
    low = listed(table).select("doc_id", F.size("words").alias("size"), F.transform("words", T.casefolded).alias("w"))
    nexts = unlisted(low, shifted("w", most), "doc_id", "size").join(heads, "g0", "left").filter("begins OR at = 0")
    runs = [F.when(F.col(f"g{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *[f"g{k}" for k in range(n)]).alias("expression"))) for n in range(1, most + 1)]
    spans = nexts.select("doc_id", "size", "at", F.explode(F.filter(F.array(*runs), lambda x: x.isNotNull())).alias("x")).select("doc_id", "size", "at", "x.n", "x.expression")
    hits = spans.join(known.withColumn("hit", F.lit(True)), "expression", "left").filter("hit OR (at = 0 AND n = 1)")
    candidate = F.when(F.col("hit"), F.struct(F.col("at").alias("pos"), (-F.col("n")).alias("less"), F.col("value").cast("double").alias("value")))
    listing = hits.groupBy("doc_id").agg(F.first("size").alias("n"), F.array_sort(F.collect_list(candidate)).alias("c"))
    start = F.struct(F.lit(-1).alias("free"), F.array().cast("array<struct<start:int,stop:int,value:double>>").alias("out"))
    stop = lambda x: x["pos"] - x["less"] - 1
    span = lambda x: F.struct(x["pos"].alias("start"), stop(x).alias("stop"), x["value"].alias("value"))
    fold = F.aggregate("c", start, lambda s, x: F.when(x["pos"] > s["free"], F.struct(stop(x).alias("free"), F.concat(s["out"], F.array(span(x))).alias("out"))).otherwise(s), lambda s: s["out"])
    return listing.select("doc_id", "n", fold.alias("spans"))


def lexicon_matches(table: DataFrame, lexicon: DataFrame, most: int) -> DataFrame:
    """LEX1: ``doc_id, start, stop, value``: a row for each match. Places are positions, which count from 0."""
    return unlisted(lexicon_spans(table, lexicon, most), F.col("spans"), "doc_id").drop("at")


def concreteness(spans: DataFrame, bins: int = 20) -> DataFrame:
    """FEA26: ``doc_id, bin, share, mean`` of ``doc_id, n, spans``: matches by value, out of the words less those inside
    longer matches. The mean is that of exact decimals, so that it doesn't hang on the order of a sum."""
    value = F.col("value")
    rows = unlisted(spans, F.col("spans"), "doc_id", "n").withColumn("bin", F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int"))
    by_bin = rows.groupBy("doc_id", "bin").agg(F.first("n").alias("n"), F.count("*").alias("c"), F.sum(F.col("stop") - F.col("start")).alias("inside"), F.sum(value.cast("decimal(20,10)")).alias("s"), F.count("value").alias("k"))
    whole = by_bin.groupBy("doc_id").agg((F.first("n") - F.sum("inside")).alias("free"), F.try_divide(F.sum("s").cast("double"), F.sum("k")).alias("mean"), F.collect_list(F.struct("bin", "c")).alias("b"))
    return whole.select("doc_id", "free", "mean", F.explode("b").alias("x")).select("doc_id", "x.bin", F.try_divide(F.col("x.c").cast("double"), F.col("free")).alias("share"), "mean")


def ngram_selection(grams: DataFrame, docs: int, best: int | None = None, least: float | None = None) -> DataFrame:
    """LEX8: n-grams whose document share is nearest to a half, or at least ``least``."""
    rated = grams.groupBy("gram").agg(F.countDistinct("doc_id").alias("df")).withColumn("ratio", F.col("df") / docs)
    return rated.orderBy(F.abs(F.col("ratio") - 0.5), "gram").limit(best) if best else rated.filter(F.col("ratio") >= least)
