"""Features over annotation tables, and the passes of the preposition lexicon.

An annotator supplies ``tokens`` (``doc_id, pos, text, itext, lemma, tag, fine_tag, sentence, is_stop,
like_num, event, tense``), of which words are those not tagged as punctuation or symbols, and tables
of spans. Denominators are words unless said otherwise; texts without words have zeros.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from scriptorium.functions import text as T
from scriptorium.session import bounded_batches, few

# Tags of content words, the measured symbols in order, bins.
CONTENT = ("NOUN", "PROPN", "VERB", "ADJ", "ADV")
SYMBOLS = (".", ",", ":", ";", "!", "?", '"', "'", "(", ")", "-", "–", "—", "…", "/", "\\")
TENSES = ("Past", "Pres", "Fut")
SENSE_TAGS = {"NOUN": "n", "VERB": "v", "ADJ": "a", "ADV": "r"}
SENTENCE_BIN, LONGEST_SENTENCE, PHRASE_BINS, SENSE_BINS, VALUE_BINS = 3, 78, 14, 15, 10


def is_word(tag: str = "tag") -> Column:
    return ~F.col(tag).isin("PUNCT", "SYM")


def rates(tokens: DataFrame) -> DataFrame:
    """FEA6, FEA8, FEA10, FEA22, FEA24: one pass over the tokens for all rates of words."""
    word = is_word()
    n = F.count_if(word)
    part = lambda hit: F.coalesce(F.try_divide(F.count_if(word & hit).cast("double"), n), F.lit(0.0))
    tense = F.when(F.col("tense").isin(*TENSES), F.col("tense")).otherwise("none")
    return tokens.groupBy("doc_id").agg(
        n.alias("words"), part(F.col("like_num")).alias("numeric"), part(F.col("tag").isin(*CONTENT)).alias("lexical_density"), part(F.col("is_stop")).alias("stopwords"),
        part(F.col("event")).alias("events"), *[part(tense == t).alias(f"tense_{t.lower()}") for t in (*TENSES, "none")],
    )


def label_shares(labels: DataFrame, column: str, known: tuple[str, ...], totals: DataFrame) -> DataFrame:
    """FEA16, FEA21, FEA23: ``doc_id, label, share`` for every document of ``totals`` (``doc_id, n``) and
    every known label, by the rows of ``labels`` with it. Labels are a fixed, short list."""
    grid = totals.select("doc_id", "n", F.explode(F.array(*map(F.lit, known))).alias("label"))
    counts = labels.filter(F.col(column).isin(*known)).groupBy("doc_id", F.col(column).alias("label")).agg(F.count("*").alias("c"))
    return grid.join(counts, ["doc_id", "label"], "left").select("doc_id", "label", F.coalesce(F.try_divide(F.col("c").cast("double"), F.col("n")), F.lit(0.0)).alias("share"))


def punctuation(tokens: DataFrame, text: str = "text") -> DataFrame:
    """FEA12: shares of sixteen symbols among all tokens, a column each."""
    return tokens.groupBy("doc_id").agg(*[(F.count_if(F.col(text) == s) / F.count("*")).alias(f"p{k}") for k, s in enumerate(SYMBOLS)])


def sentence_lengths(docs: DataFrame, words: DataFrame) -> DataFrame:
    """FEA5: ``doc_id, bin, share, mean``: sentences by bins of three words (26, the last open), out of
    the last sentence's number plus one, and the mean length in parts of 78, 1 at most. A first sentence
    without words counts with length 0; a text without words is one such."""
    bins = LONGEST_SENTENCE // SENTENCE_BIN
    size = words.groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))
    whole = size.groupBy("doc_id").agg(F.min("sentence").alias("first"), F.max("sentence").alias("last"), F.sum("n").alias("total"))
    every = docs.select("doc_id").join(whole, "doc_id", "left").select("doc_id", F.coalesce("first", F.lit(-1)).alias("first"), (F.coalesce("last", F.lit(0)) + 1).alias("d"), F.coalesce("total", F.lit(0)).alias("total"))
    blank = every.filter("first <> 0").select("doc_id", F.lit(0).cast("long").alias("n"))
    binned = size.select("doc_id", "n").unionByName(blank).groupBy("doc_id", F.least(F.floor(F.col("n") / SENTENCE_BIN), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    return binned.join(every, "doc_id").select("doc_id", "bin", (F.col("c") / F.col("d")).alias("share"), F.least(F.col("total") / F.col("d") / LONGEST_SENTENCE, F.lit(1.0)).alias("mean"))


def phrase_lengths(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """FEA20: ``doc_id, bin, share``: the words in noun phrases of each length (14 and more are one bin)
    out of a text's words; bins count from 0."""
    b = F.least(F.col("length"), F.lit(PHRASE_BINS)).cast("int") - 1
    return chunks.groupBy("doc_id", b.alias("bin")).agg(F.sum("length").alias("s")).join(totals, "doc_id").select("doc_id", "bin", F.coalesce(F.try_divide(F.col("s").cast("double"), F.col("n")), F.lit(0.0)).alias("share"))


def senses(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """FEA25: ``doc_id, bin, share`` of words by their number of senses (``lemma, wn_pos, senses``), out of
    the words that have any; 15 and more are one bin."""
    wn = F.create_map(*[F.lit(x) for pair in SENSE_TAGS.items() for x in pair])
    rows = tokens.withColumn("wn_pos", F.element_at(wn, F.col("tag"))).filter("wn_pos IS NOT NULL").join(counts.filter("senses > 0"), ["lemma", "wn_pos"])
    binned = rows.groupBy("doc_id", (F.least(F.col("senses"), F.lit(SENSE_BINS)).cast("int") - 1).alias("bin")).agg(F.count("*").alias("c"))
    return binned.select("doc_id", "bin", (F.col("c") / F.sum("c").over(W.partitionBy("doc_id"))).alias("share"))


def lexicon_walk(tokens: DataFrame, lexicon: DataFrame, most: int) -> DataFrame:
    """JN11: ``doc_id, pos, n, value``: the longest lexicon entry from each token. An entry's words may be
    matched by a token's folded text or, where no entry goes on with that, by its lemma; the way isn't
    gone back. Starts by text and by lemma are both walked; of equal lengths the text's counts.

    Each step is an equi-join with the table of beginnings of entries.
    """
    words = F.split("expression", " ")
    heads = lexicon.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))).alias("head")).distinct()
    known = heads.join(lexicon.select(F.col("expression").alias("head"), "value"), "head", "left")
    w = W.partitionBy("doc_id").orderBy("pos")
    nexts = tokens.select("doc_id", "pos", F.col("itext").alias("t0"), F.col("lemma").alias("l0"), *[F.lead(c, k).over(w).alias(f"{s}{k}") for k in range(1, most) for c, s in (("itext", "t"), ("lemma", "l"))])
    starts = nexts.select("*", F.explode(F.array(F.struct(F.lit(0).alias("by"), F.col("t0").alias("head")), F.struct(F.lit(1).alias("by"), F.col("l0").alias("head")))).alias("s")).select(*nexts.columns, "s.*")
    now = starts.join(known, "head").withColumn("best", F.when(F.col("value").isNotNull(), F.struct(F.lit(1).alias("n"), "value"))).drop("value")
    done = []
    for k in range(1, most):
        by = lambda s: known.select(F.col("head").alias(f"h{s}"), F.col("value").alias(f"v{s}"), F.lit(True).alias(f"k{s}"))
        step = now.withColumn("ht", F.concat_ws(" ", "head", f"t{k}")).withColumn("hl", F.concat_ws(" ", "head", f"l{k}"))
        step = step.join(by("t"), "ht", "left").join(by("l"), "hl", "left")
        text = F.col("kt") & F.col(f"t{k}").isNotNull()
        lemma = F.col("kl") & F.col(f"l{k}").isNotNull()
        step = step.withColumn("go", F.when(text, F.struct(F.col("ht").alias("head"), F.col("vt").alias("value"))).when(lemma, F.struct(F.col("hl").alias("head"), F.col("vl").alias("value"))))
        kept = F.when(F.col("go.value").isNotNull(), F.struct(F.lit(k + 1).alias("n"), F.col("go.value").alias("value"))).otherwise(F.col("best")).alias("best")
        done.append(step.filter("go IS NULL").select("doc_id", "pos", "by", "best"))
        now = step.filter("go IS NOT NULL").select(*nexts.columns, "by", F.col("go.head").alias("head"), kept)
    done.append(now.select("doc_id", "pos", "by", "best"))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    top = F.max(F.struct(F.col("best.n").alias("n"), (-F.col("by")).alias("by"), F.col("best.value").alias("value")))
    return every.filter("best IS NOT NULL").groupBy("doc_id", "pos").agg(top.alias("m")).select("doc_id", "pos", "m.n", "m.value")


def prepositions(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """LEX2: ``doc_id, pos, n, value`` of three passes that share what is used up: entries of several
    words in the lexicon's order; patterns, found anywhere in a token; single words by text, else by
    lemma. A word with a value for one part of speech only has none as another.

    ``lexicon`` is ``ord, prep, imag, is_regex, pos_adp, pos_nonadp, n_words``, a short list; places are numbers in a
    row. The first pass marks what it uses up in the array of a document's tokens, so these are dealt once and
    no pass joins them by place.
    """
    bounded_batches(tokens.sparkSession)
    place = F.struct(F.col("pos").cast("long").alias("pos"), "itext", "lemma", "tag")
    lists = tokens.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(place)).alias("tokens"))
    marked = lists.select("doc_id", "tokens", _first_pass(of_several_words(lexicon))(F.transform("tokens", lambda t: t["itext"])).alias("marks"))
    rows = marked.select("doc_id", F.explode_outer(F.arrays_zip("tokens", "marks")).alias("x")).filter("x.marks.n IS NULL OR x.marks.n > 0").select("doc_id", "x.tokens.*", "x.marks.n", F.col("x.marks.value").alias("whole"))
    one = F.col("n").isNotNull()
    every = alone(rows, lexicon).select("doc_id", "pos", one.alias("kept"), F.coalesce("n", F.lit(1)).alias("n"), F.when(one, F.col("whole")).otherwise(F.col("alone")).cast("double").alias("value"))
    return every.filter("kept OR value IS NOT NULL").drop("kept")


def of_several_words(lexicon: DataFrame) -> list[tuple[list[str], float | None]]:
    """The entries of LEX2's first pass in order."""
    return [(r["prep"].split(" "), r["imag"]) for r in lexicon.filter("n_words > 1 AND is_regex = 0 AND size(split(prep, ' ')) = n_words").orderBy("ord").collect()]


def alone(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``tokens`` with ``alone``, the value of a token by LEX2's second and third pass, if it is still free."""
    patterns = lexicon.filter("is_regex = 1").orderBy("ord").select("prep", "imag").collect()
    found = F.lit(None).cast("double")
    for r in reversed(patterns):
        found = F.when(F.col("itext").rlike(r["prep"]), F.lit(float(r["imag"]))).otherwise(found)
    single = few(lexicon.filter("n_words = 1 AND is_regex = 0").select("prep", "imag", "pos_adp", "pos_nonadp"))
    named = lambda s: single.select(F.col("prep").alias(s), F.struct("imag", "pos_adp", "pos_nonadp").alias(f"{s}_v"))
    both = tokens.withColumn("by_pattern", found).join(named("itext"), "itext", "left").join(named("lemma"), "lemma", "left")
    v = F.coalesce("itext_v", "lemma_v")
    value = F.when(F.col("tag").eqNullSafe("ADP") & v["pos_adp"].isNotNull(), v["pos_adp"]).when(~F.col("tag").eqNullSafe("ADP") & v["pos_nonadp"].isNotNull(), v["pos_nonadp"]).when(v["pos_adp"].isNull() & v["pos_nonadp"].isNull(), v["imag"])
    return both.select(*[F.col(c) for c in tokens.columns], F.coalesce("by_pattern", value).cast("double").alias("alone"))


MARK = Y.ArrayType(Y.StructType([Y.StructField("n", Y.IntegerType()), Y.StructField("value", Y.DoubleType())]))


def first_pass(code: np.ndarray, number: dict[str, int], left: np.ndarray, entries: list[tuple[list[str], float | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n, value, missing`` for each of a block's words: the number of words and the value (or that it has none) where a
    run of an entry's words begins that was still free, 0 inside such a run, -1 where a word stays free. Entries in
    order, each from left to right. ``left`` is the number of the document's words from here on."""
    n, value = np.full(len(code), -1, np.int32), np.zeros(len(code))
    missing = np.zeros(len(code), bool)
    for words, worth in entries:
        if any(w not in number for w in words):
            continue
        size = len(words)
        hit = left >= size
        for k, w in enumerate(words):
            hit &= np.append(code[k:], np.full(min(k, len(code)), -1))[: len(code)] == number[w]
        for at in np.flatnonzero(hit):
            if (n[at : at + size] < 0).all():
                n[at : at + size] = 0
                n[at], value[at], missing[at] = size, worth or 0.0, worth is None
    return n, value, missing


def _first_pass(entries: list[tuple[list[str], float | None]]):
    """The marks of a batch of documents' words, as arrays; null where a word stays free."""

    @F.arrow_udf(MARK)
    def marks(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begins, kinds = np.append(0, np.cumsum(sizes)), pc.list_flatten(lists).dictionary_encode()
        number = {w: k for k, w in enumerate(kinds.dictionary.to_pylist())}
        code = pc.fill_null(kinds.indices, -1).to_numpy(zero_copy_only=False)
        left = np.repeat(begins[1:], sizes) - np.arange(len(code))
        n, value, missing = first_pass(code, number, left, entries)
        flat = pa.StructArray.from_arrays([pa.array(n, mask=n < 0), pa.array(value, mask=missing | (n <= 0))], ["n", "value"])
        return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), flat)

    return marks


def imageability(values: DataFrame, totals: DataFrame, bins: int = VALUE_BINS) -> DataFrame:
    """FEA27: ``doc_id, bin, share, mean`` of matched values out of the words. The mean is that of exact
    decimals, so that it doesn't hang on the order of a sum."""
    v = F.col("value")
    binned = values.groupBy("doc_id", F.least(F.floor(v * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("c"), F.sum(v.cast("decimal(20,10)")).alias("s"), F.count("value").alias("k"))
    whole = binned.groupBy("doc_id").agg((F.sum("s").cast("double") / F.sum("k")).alias("mean"), F.collect_list(F.struct("bin", "c")).alias("b"))
    rows = whole.join(totals, "doc_id").select("doc_id", "n", "mean", F.explode("b").alias("x"))
    return rows.select("doc_id", "x.bin", F.coalesce(F.try_divide(F.col("x.c").cast("double"), F.col("n")), F.lit(0.0)).alias("share"), "mean")


# Raw forms that are left out or merged, and those with optional endings or parts.
DROPPED_FORMS = ("on.the.oth.side(of)", "diag.opposite", "by(“walk.by”)")
PREFIXES = ("sub-", "over-", "inter-")
SUFFIXED = ("backward(s)", "forward(s)", "among(st)", "upward(s)", "toward(s)", "onward(s)", "outward(s)", "inward(s)")


def preposition_lexicon(raw: DataFrame) -> DataFrame:
    """LEX6: ``prep, imag, is_regex, pos_adp, pos_nonadp, n_words`` from raw ``form, value``: two forms of
    "among" become one with their mean, dots become spaces, optional endings and prefixes patterns,
    values 0..1; "outside", "on" and "to" get values by part of speech."""
    kept = raw.filter(F.col("form").isNotNull() & F.col("value").isNotNull() & ~F.col("form").isin(*DROPPED_FORMS))
    among = F.avg(F.when(F.col("form").isin("in.among(st)", "among"), F.col("value"))).over(W.partitionBy())
    merged = kept.withColumn("value", F.when(F.col("form") == "in.among(st)", among).otherwise(F.col("value"))).filter("form <> 'among'").withColumn("form", F.when(F.col("form") == "in.among(st)", "among(st)").otherwise(F.col("form")))
    spaced = F.replace(F.replace("form", F.lit("."), F.lit(" ")), F.lit("(of)"), F.lit(""))
    pattern = F.when(spaced.isin(*PREFIXES), F.concat(F.rtrim(spaced, F.lit("-")), F.lit(r"\w+"))).when(spaced.endswith("(st)"), F.replace(spaced, F.lit("(st)"), F.lit("(s|st)?"))).when(spaced.endswith("(s)"), F.replace(spaced, F.lit("(s)"), F.lit("(s)?"))).otherwise(spaced)
    low, high = F.min("value").over(W.partitionBy()), F.max("value").over(W.partitionBy())
    scaled = merged.select(pattern.alias("prep"), F.try_divide(F.col("value") - low, high - low).alias("imag"), spaced.isin(*PREFIXES, *SUFFIXED).cast("int").alias("is_regex"))
    of = lambda name: F.max(F.when(F.col("prep") == name, F.col("imag"))).over(W.partitionBy())
    joined = scaled.select("*", of("on (adv)").alias("adv"), of("to(inf)").alias("inf")).filter("prep NOT IN ('on (adv)', 'to(inf)')")
    name = F.when(F.col("prep") == "on (loc)", "on").otherwise(F.col("prep"))
    return joined.select(name.alias("prep"), "imag", "is_regex", F.when(name.isin("outside", "on", "to"), F.col("imag")).alias("pos_adp"), F.when(name == "on", F.col("adv")).when(name == "to", F.col("inf")).alias("pos_nonadp"), F.size(F.split(F.trim(name), r"\s+")).alias("n_words"))


def char_ngram_shares(docs: DataFrame, selected: DataFrame, low: int = 2, high: int = 5, most: int = 100_000) -> DataFrame:
    """FEA2: ``doc_id, gram, share``: occurrences of selected character n-grams of the folded text, out of
    all its n-grams. Totals come from the texts' lengths and are joined to the counts. Rows that share a
    ``doc_id`` are one text; null texts and texts without n-grams have no rows.

    Up to ``most`` selected n-grams travel with the tasks, which count them in numpy; more are joined.
    """
    folded = docs.select("doc_id", T.casefolded(F.col("text")).alias("t"))
    length = F.length("t")
    totals = folded.groupBy("doc_id").agg(F.sum(sum((F.greatest(length - n + 1, F.lit(0)) for n in range(low, high + 1)), F.lit(0))).alias("total"))
    chosen = selected.select("gram").filter(F.length("gram").between(low, high)).distinct()
    few = sorted(r["gram"] for r in chosen.limit(most + 1).collect())
    alphabet = sorted(set("".join(few)))
    if len(few) <= most and (len(alphabet) + 1) ** high < 1 << 63:
        counts = folded.select(F.col("doc_id").cast("long"), "t").mapInArrow(_gram_counter(few, alphabet, low, high), "doc_id long, gram string, n long")
    else:
        chars = folded.select("doc_id", T.characters(F.col("t")).alias("c"))
        counts = chars.select("doc_id", F.explode(T.array_ngrams(F.col("c"), low, high)).alias("gram")).join(chosen, "gram").withColumn("n", F.lit(1))
    summed = counts.groupBy("doc_id", "gram").agg(F.sum("n").alias("n"))
    return summed.join(totals, "doc_id").select("doc_id", "gram", (F.col("n") / F.col("total")).alias("share"))


def char_ngram_kinds(docs: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    """FEA2: ``doc_id, n, kinds``: how many character n-grams the folded text has, and how many different ones.
    Rows that share a ``doc_id`` are one text's parts; texts without n-grams have no row. N-grams are never rows:
    a task counts those of a block of texts in numpy."""
    bounded_batches(docs.sparkSession)
    parts = docs.select(F.col("doc_id").cast("long"), T.casefolded(F.col("text")).alias("t")).groupBy("doc_id").agg(F.collect_list("t").alias("ts"))
    return parts.mapInArrow(_kind_counter(low, high), "doc_id long, n long, kinds long").filter("n > 0")


def _kind_counter(low: int, high: int, block: int = 1 << 18):
    """Numbers of n-grams by text, for mapInArrow. An n-gram is a number of its text's place in the block and its
    characters' places in the block's alphabet; where that is too large, runs are numbered anew at each length."""

    def counted(ids, texts):
        owner = np.repeat([k for k, ts in enumerate(texts) for _ in ts], [len(t) for ts in texts for t in ts])
        part = np.repeat(np.arange(sum(map(len, texts))), [len(t) for ts in texts for t in ts])
        raw = np.frombuffer("".join(t for ts in texts for t in ts).encode("utf-32-le", "surrogatepass"), "<u4")
        seen = np.zeros(int(raw.max(initial=0)) + 1, bool)
        seen[raw] = True
        base = max(int(seen.sum()), 2)
        digit = (np.cumsum(seen, dtype=np.int64) - 1)[raw]
        n, kinds, value = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), digit
        for k in range(2, high + 1):
            if len(raw) < k:
                break
            value = value[: len(raw) - k + 1]
            if len(value) and int(value.max()) >= (1 << 62) // base // len(ids):
                value = np.unique(value, return_inverse=True)[1]
            value = value * base + digit[k - 1 :]
            if k < low:
                continue
            whole = part[: len(value)] == part[k - 1 :]
            top = int(value.max()) + 1
            if top > (1 << 62) // len(ids):
                value, top = np.unique(value, return_inverse=True)[1], len(value)
            mine = owner[: len(value)][whole]
            key = np.sort(mine * top + value[whole])
            n += np.bincount(mine, minlength=len(ids))
            kinds += np.bincount(key[np.append(True, key[1:] != key[:-1])] // top if len(key) else key, minlength=len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(kinds)], ["doc_id", "n", "kinds"])

    def run(batches):
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, ts in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append([t or "" for t in ts.as_py()])
                held += sum(map(len, texts[-1]))
                if held >= block:
                    yield counted(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield counted(ids, texts)

    return run


def char_ngram_pairs(docs: DataFrame, selected: DataFrame, offset: int, low: int = 2, high: int = 5) -> DataFrame:
    """FEA2: ``doc_id, pairs``: shares of the selected character n-grams (``gram, index``) inside a text's row, each at its
    index plus ``offset``. The selected ones travel with the tasks; a text is one row here."""
    bounded_batches(docs.sparkSession)
    index = {r["gram"]: offset + r["index"] for r in selected.select("gram", "index").collect() if low <= len(r["gram"]) <= high}
    grams = sorted(index)
    counter = _gram_counter(grams, sorted(set("".join(grams))), low, high)
    places = pa.array([index[g] for g in grams], pa.int32())

    def run(batches):
        for batch in batches:
            sizes = dict(zip(batch.column(0).to_pylist(), pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()))
            found = list(counter(iter([batch])))
            if not found:
                continue
            rows = pa.Table.from_batches(found).sort_by("doc_id").combine_chunks()
            ids = rows["doc_id"].to_numpy()
            begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.array([], np.int64)
            total = np.array([sum(max(sizes[i] - n + 1, 0) for n in range(low, high + 1)) for i in ids[begins].tolist()], np.int64)
            share = rows["n"].to_numpy() / np.repeat(total, np.diff(np.append(begins, len(ids))))
            place = pc.take(places, pc.index_in(rows["gram"], pa.array(grams, pa.string()))).combine_chunks()
            pairs = pa.StructArray.from_arrays([place, pa.array(share, pa.float64())], ["feature", "value"])
            yield pa.RecordBatch.from_arrays([pa.array(ids[begins]), pa.ListArray.from_arrays(pa.array(np.append(begins, len(ids)), pa.int32()), pairs)], ["doc_id", "pairs"])

    folded = docs.select(F.col("doc_id").cast("long"), T.casefolded(F.col("text")).alias("t"))
    return folded.mapInArrow(run, "doc_id long, pairs array<struct<feature:int,value:double>>")


def _gram_counter(grams: list[str], alphabet: list[str], low: int, high: int, block: int = 1 << 20):
    """Counts of ``grams`` by text, for mapInArrow. An n-gram is a number whose digits are places in the
    alphabet; 0 stands for all other characters, and so for what separates two texts."""
    base = len(alphabet) + 1
    letters = np.array([ord(c) for c in alphabet], np.uint32)
    number = {n: np.array([sum((alphabet.index(c) + 1) * base ** (n - 1 - k) for k, c in enumerate(g)) for g in grams if len(g) == n], np.int64) for n in range(low, high + 1)}
    name = {n: np.array([g for g in grams if len(g) == n], object) for n in number}

    def counted(ids, texts):
        raw = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(raw)]
        at = np.minimum(np.searchsorted(letters, raw), len(letters) - 1)
        digit = np.where(letters[at] == raw, at + 1, 0)
        ends = np.append(np.flatnonzero(np.diff(owner)), len(raw))
        digit[ends[:-1]] = 0  # what separates the texts
        for n in number:
            if len(raw) < n or not len(number[n]):
                continue
            value, whole = np.zeros(len(raw) - n + 1, np.int64), np.ones(len(raw) - n + 1, bool)
            for k in range(n):
                part = digit[k : len(raw) - n + 1 + k]
                value, whole = value * base + part, whole & (part > 0)
            order = np.argsort(number[n])
            place = np.minimum(np.searchsorted(number[n][order], value), len(order) - 1)
            hit = whole & (number[n][order][place] == value)
            key, times = np.unique(owner[: len(value)][hit] * len(order) + order[place[hit]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in key // len(order)], pa.int64()), pa.array(name[n][key % len(order)], pa.string()), pa.array(times, pa.int64())], ["doc_id", "gram", "n"])

    def run(batches):
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py() or ""
                if letters.size and len(t) >= low:
                    ids.append(i)
                    texts.append(t)
                    held += len(t)
                if held >= block:
                    yield from counted(ids, texts)
                    ids, texts, held = [], [], 0
            if texts:
                yield from counted(ids, texts)

    return run
