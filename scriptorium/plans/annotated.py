"""Queries of features over annotation tables and of the lexicons' passes.

No annotator runs here. Users' events stand in for a document's tokens: the kind of an event for a tag, its
number for what else an annotator would say. The operators take a real annotator's tables as they are.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.operators import annotations as A
from scriptorium.operators import features as X
from scriptorium.session import table

from .base import query, r6
from .texts import FOLD, WORDS, docs, word_lists

TAGS = {"view": "NOUN", "click": "VERB", "purchase": "ADP", "signup": "PUNCT", "error": "PRON"}
TOKENS = """tokens AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
  CASE event_type WHEN 'view' THEN 'NOUN' WHEN 'click' THEN 'VERB' WHEN 'purchase' THEN 'ADP' WHEN 'signup' THEN 'PUNCT' ELSE 'PRON' END AS tag,
  'w' || event_id % 6 AS itext, 'w' || event_id % 4 AS lemma, event_id, value FROM events)"""
N = "n AS (SELECT doc_id, count(*) FILTER (tag <> 'PUNCT') AS n FROM tokens GROUP BY doc_id)"


def tokens(spark, sf):
    e = table(spark, sf, "events")
    tag = F.lit("PRON")
    for kind, t in TAGS.items():
        tag = F.when(F.col("event_type") == kind, t).otherwise(tag)
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("doc_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("pos"), tag.alias("tag"), F.concat(F.lit("w"), (k % 6).cast("string")).alias("itext"),
        F.concat(F.lit("w"), (k % 4).cast("string")).alias("lemma"), (k % 5 == 0).alias("is_stop"), (k % 11 == 0).alias("like_num"), (k % 7 == 0).alias("event"),
        F.when(k % 4 == 0, "Past").when(k % 4 == 1, "Pres").when(k % 4 == 2, "Fut").alias("tense"), F.col("event_type").alias("fine_tag"), "event_id", "value",
    )


def totals(t):
    return t.groupBy("doc_id").agg(F.count_if(A.is_word()).alias("n"))


RATE = "round(coalesce(count(*) FILTER (tag <> 'PUNCT' AND {}) / nullif(count(*) FILTER (tag <> 'PUNCT'), 0)::DOUBLE, 0), 6)"


def _rate(name, column, condition):
    @query(name, f"WITH {TOKENS} SELECT doc_id, {RATE.format(condition)} AS share FROM tokens GROUP BY doc_id")
    def f(spark, sf):
        return A.rates(tokens(spark, sf)).select("doc_id", r6(F.col(column), "share"))

    return f


_rate("fea6b_numeric_words", "numeric", "event_id % 11 = 0")
_rate("fea8_lexical_density", "lexical_density", "tag IN ('NOUN', 'VERB')")
_rate("fea10_stopwords", "stopwords", "event_id % 5 = 0")
_rate("fea22_events", "events", "event_id % 7 = 0")


@query("fea24_tense", f"WITH {TOKENS} SELECT doc_id, {RATE.format('event_id % 4 = 0')} AS past, {RATE.format('event_id % 4 = 1')} AS pres, {RATE.format('event_id % 4 = 2')} AS fut, {RATE.format('event_id % 4 = 3')} AS other FROM tokens GROUP BY doc_id")
def fea24(spark, sf):
    r = A.rates(tokens(spark, sf))
    return r.select("doc_id", *[r6(F.col(f"tense_{t}"), n) for t, n in (("past", "past"), ("pres", "pres"), ("fut", "fut"), ("none", "other"))])


@query("fea7_type_token", f"WITH {WORDS} SELECT doc_id, round(count(DISTINCT {FOLD.format('word')}) / count(*)::DOUBLE, 6) AS share FROM words GROUP BY doc_id")
def fea7(spark, sf):
    return X.type_token(word_lists(spark, sf)).select("doc_id", r6(F.col("type_token"), "share"))


@query("fea11_articles", f"WITH {WORDS} SELECT doc_id, round(count(*) FILTER (lower(word) = 'the') / count(*)::DOUBLE, 6) AS definite, round(count(*) FILTER (lower(word) IN ('a', 'an')) / count(*)::DOUBLE, 6) AS indefinite FROM words GROUP BY doc_id")
def fea11(spark, sf):
    return X.wide(word_lists(spark, sf)).select("doc_id", r6(F.col("the"), "definite"), r6(F.col("a_an"), "indefinite"))


@query("fea13_contractions", f"WITH {WORDS} SELECT doc_id, round(count(*) FILTER (word LIKE '%''%') / count(*)::DOUBLE, 6) AS share FROM words GROUP BY doc_id")
def fea13(spark, sf):
    return X.wide(word_lists(spark, sf)).select("doc_id", r6(F.col("contractions"), "share"))


@query("fea16_fine_tags", f"WITH {TOKENS}, l AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'XX']) AS label), t AS (SELECT user_id AS doc_id, count(*) AS n FROM events GROUP BY ALL) SELECT t.doc_id, label, round((SELECT count(*) FROM events e WHERE e.user_id = t.doc_id AND e.event_type = label) / n::DOUBLE, 6) AS share FROM t, l")
def fea16(spark, sf):
    t = tokens(spark, sf)
    every = t.groupBy("doc_id").agg(F.count("*").alias("n"))
    return A.label_shares(t, "fine_tag", ("click", "error", "purchase", "signup", "view", "XX"), every).select("doc_id", "label", r6("share"))


@query("fea23_supersense", f"WITH {TOKENS}, {N}, l AS (SELECT unnest(['noun.act', 'noun.time', 'verb.motion']) AS label), s AS (SELECT doc_id, CASE event_id % 5 WHEN 0 THEN 'noun.act' WHEN 1 THEN 'noun.time' WHEN 2 THEN 'verb.motion' WHEN 3 THEN 'other' END AS label FROM tokens), c AS (SELECT doc_id, label, count(*) AS c FROM s GROUP BY ALL) SELECT n.doc_id, l.label, round(coalesce(c / nullif(n, 0)::DOUBLE, 0), 6) AS share FROM n CROSS JOIN l LEFT JOIN c ON c.doc_id = n.doc_id AND c.label = l.label")
def fea23(spark, sf):
    t, k = tokens(spark, sf), F.col("event_id") % 5
    s = t.select("doc_id", F.when(k == 0, "noun.act").when(k == 1, "noun.time").when(k == 2, "verb.motion").when(k == 3, "other").alias("sense"))
    return A.label_shares(s, "sense", ("noun.act", "noun.time", "verb.motion"), totals(t)).select("doc_id", "label", r6("share"))


@query("fea25_polysemy", f"WITH {TOKENS}, s AS (SELECT doc_id, CASE WHEN tag = 'NOUN' THEN CAST(right(lemma, 1) AS INTEGER) * 9 ELSE CAST(right(lemma, 1) AS INTEGER) END AS senses FROM tokens WHERE tag IN ('NOUN', 'VERB')), b AS (SELECT doc_id, least(senses, 15) - 1 AS bin, count(*) AS c FROM s WHERE senses > 0 GROUP BY ALL) SELECT doc_id, CAST(bin AS INTEGER) AS bin, round(c / sum(c) OVER (PARTITION BY doc_id), 6) AS share FROM b")
def fea25(spark, sf):
    counts = spark.createDataFrame([(f"w{k}", p, k * (9 if p == "n" else 1)) for k in range(4) for p in ("n", "v")], "lemma string, wn_pos string, senses int")
    return A.senses(tokens(spark, sf), F.broadcast(counts)).select("doc_id", "bin", r6("share"))


@query("fea5_sentence_lengths", r"""WITH d AS (SELECT doc_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) - 1 AS sentence FROM documents),
c AS (SELECT doc_id, sentence, len(regexp_extract_all(s, '[\p{L}\p{N}'']+')) AS n FROM d), w AS (SELECT * FROM c WHERE n > 0),
t AS (SELECT doc_id, min(sentence) AS f, max(sentence) + 1 AS d, sum(n) AS total FROM w GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(f, -1) AS f, coalesce(t.d, 1) AS d, coalesce(total, 0) AS total FROM documents LEFT JOIN t USING (doc_id)),
k AS (SELECT doc_id, n FROM w UNION ALL SELECT doc_id, 0 FROM e WHERE f <> 0),
b AS (SELECT doc_id, CAST(least(n // 3, 25) AS INTEGER) AS bin, count(*) AS c FROM k GROUP BY ALL)
SELECT doc_id, bin, round(c / d::DOUBLE, 6) AS share, round(least(total / d::DOUBLE / 78, 1), 6) AS mean FROM b JOIN e USING (doc_id)""")
def fea5b(spark, sf):
    s = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", r"\.")).alias("sentence", "s"))
    w = s.select("doc_id", "sentence", F.explode(F.regexp_extract_all("s", F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))).alias("word"))
    return A.sentence_lengths(docs(spark, sf), w).select("doc_id", "bin", r6("share"), r6("mean"))


MARKS = ".,:;!?\"'()-–—…/\\"


@query("fea12_punctuation", r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}'']+|[^\s\p{L}\p{N}]')) AS token FROM documents) SELECT doc_id, " + ", ".join(f"round(avg((token = chr({ord(c)}))::INT), 6) AS p{k}" for k, c in enumerate(MARKS)) + " FROM t GROUP BY doc_id")
def fea12b(spark, sf):
    t = X.words(docs(spark, sf), r"([\p{L}\p{N}']+|[^\s\p{L}\p{N}])").withColumnRenamed("word", "text")
    return A.punctuation(t).select("doc_id", *[r6(f"p{k}") for k in range(16)])


@query("fea20_phrase_lengths", f"WITH {TOKENS}, {N}, c AS (SELECT doc_id, least(event_id % 17 + 1, 14) - 1 AS bin, sum(event_id % 17 + 1) AS s FROM tokens WHERE tag = 'NOUN' GROUP BY ALL) SELECT c.doc_id, CAST(bin AS INTEGER) AS bin, round(s / n::DOUBLE, 6) AS share FROM c JOIN n USING (doc_id)")
def fea20b(spark, sf):
    t = tokens(spark, sf)
    chunks = t.filter("tag = 'NOUN'").select("doc_id", (F.col("event_id") % 17 + 1).alias("length"))
    return A.phrase_lengths(chunks, totals(t)).select("doc_id", "bin", r6("share"))


GRAMS = "sel AS (SELECT DISTINCT substr(lower(p_name), k, n) AS gram FROM part, range(1, 4) a(k), range(2, 6) b(n) WHERE length(substr(lower(p_name), k, n)) = n)"


@query("fea2_char_ngrams", f"WITH {GRAMS}, d AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS t FROM documents), g AS (SELECT doc_id, length(t) AS l, unnest(list_concat(list_concat(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))), list_concat(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4)), list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))))) AS gram FROM d) SELECT doc_id, gram, round(count(*) / any_value(greatest(l - 1, 0) + greatest(l - 2, 0) + greatest(l - 3, 0) + greatest(l - 4, 0))::DOUBLE, 8) AS share FROM g WHERE gram IN (SELECT gram FROM sel) GROUP BY ALL")
def fea2c(spark, sf):
    p = table(spark, sf, "part").select(F.lower("p_name").alias("t"))
    sel = p.select(F.explode(F.array(*[F.struct(F.substring("t", k, n).alias("gram"), F.lit(n).alias("n")) for k in (1, 2, 3) for n in (2, 3, 4, 5)])).alias("x")).filter(F.length("x.gram") == F.col("x.n")).select("x.gram").distinct()
    return A.char_ngram_shares(docs(spark, sf), sel).select("doc_id", "gram", F.round("share", 8).alias("share"))


LEX = [(0, "w1 w2", 0.9, 0, None, None, 2), (1, "w2 w3", 0.8, 0, None, None, 2), (2, "w3 w4 w5", 0.7, 0, None, None, 3), (3, "4", 0.6, 1, None, None, 1), (4, "w0", 0.5, 0, 0.1, 0.2, 1), (5, "w3", 0.4, 0, 0.3, None, 1), (6, "w1", 0.25, 0, None, None, 1)]
LEX_SCHEMA = "ord int, prep string, imag double, is_regex int, pos_adp double, pos_nonadp double, n_words int"
PREPS = f"""{TOKENS}, x AS (SELECT *, lead(itext) OVER w AS t1, lead(itext, 2) OVER w AS t2 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
a AS (SELECT doc_id, pos, 2 AS n, 0.9 AS value FROM x WHERE itext = 'w1' AND t1 = 'w2'),
ua AS (SELECT doc_id, pos + k AS pos FROM a, range(0, 2) r(k)),
b AS (SELECT x.doc_id, x.pos, 2 AS n, 0.8 AS value FROM x WHERE itext = 'w2' AND t1 = 'w3' AND NOT EXISTS (SELECT 1 FROM ua WHERE ua.doc_id = x.doc_id AND ua.pos IN (x.pos, x.pos + 1))),
ub AS (SELECT * FROM ua UNION ALL SELECT doc_id, pos + k FROM b, range(0, 2) r(k)),
c AS (SELECT x.doc_id, x.pos, 3 AS n, 0.7 AS value FROM x WHERE itext = 'w3' AND t1 = 'w4' AND t2 = 'w5' AND NOT EXISTS (SELECT 1 FROM ub WHERE ub.doc_id = x.doc_id AND ub.pos BETWEEN x.pos AND x.pos + 2)),
uc AS (SELECT * FROM ub UNION ALL SELECT doc_id, pos + k FROM c, range(0, 3) r(k)),
f AS (SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM uc WHERE uc.doc_id = t.doc_id AND uc.pos = t.pos)),
one AS (SELECT doc_id, pos, 1 AS n, CASE WHEN itext LIKE '%4%' THEN 0.6 ELSE CASE coalesce(CASE WHEN itext IN ('w0', 'w1', 'w3') THEN itext END, CASE WHEN lemma IN ('w0', 'w1', 'w3') THEN lemma END)
  WHEN 'w0' THEN CASE WHEN tag = 'ADP' THEN 0.1 ELSE 0.2 END WHEN 'w3' THEN CASE WHEN tag = 'ADP' THEN 0.3 END WHEN 'w1' THEN 0.25 END END AS value FROM f),
m AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM one WHERE value IS NOT NULL)"""


@query("lex2_preposition_passes", f"WITH {PREPS} SELECT doc_id, pos, CAST(n AS INTEGER) AS n, value::DOUBLE AS value FROM m")
def lex2(spark, sf):
    return A.prepositions(tokens(spark, sf), spark.createDataFrame(LEX, LEX_SCHEMA))


@query("fea27_imageability", f"WITH {PREPS}, {N}, g AS (SELECT doc_id, sum(value::DECIMAL(20, 10))::DOUBLE / count(*) AS mean FROM m GROUP BY ALL), h AS (SELECT doc_id, CAST(least(floor(value::DOUBLE * 10), 9) AS INTEGER) AS bin, count(*) AS c FROM m GROUP BY ALL) SELECT h.doc_id, bin, round(coalesce(c / nullif(n, 0)::DOUBLE, 0), 6) AS share, round(mean, 6) AS mean FROM h JOIN g USING (doc_id) JOIN n USING (doc_id)")
def fea27(spark, sf):
    t = tokens(spark, sf)
    return A.imageability(A.prepositions(t, spark.createDataFrame(LEX, LEX_SCHEMA)), totals(t)).select("doc_id", "bin", r6("share"), r6("mean"))


@query("jn11_text_or_lemma", f"""WITH {TOKENS}, x AS (SELECT *, lead(itext) OVER w AS t1, lead(lemma) OVER w AS l1 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT doc_id, pos, 0 AS l, itext AS h, t1, l1 FROM x UNION ALL SELECT doc_id, pos, 1, lemma, t1, l1 FROM x),
v AS (SELECT doc_id, pos, l, CASE WHEN h = 'w1' AND (t1 = 'w2' OR l1 = 'w2') THEN 2 WHEN h = 'w2' AND (t1 = 'w5' OR l1 = 'w5') THEN 2 WHEN h IN ('w1', 'w3') THEN 1 END AS n, h FROM s)
SELECT doc_id, pos, CAST(n AS INTEGER) AS n, CASE WHEN n = 2 AND h = 'w1' THEN 0.9 WHEN n = 2 THEN 0.8 WHEN h = 'w1' THEN 0.25 ELSE 0.4 END::DOUBLE AS value FROM v WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC, l) = 1""")
def jn11(spark, sf):
    lex = spark.createDataFrame([("w1 w2", 0.9), ("w2 w5", 0.8), ("w1", 0.25), ("w3", 0.4)], "expression string, value double")
    return A.lexicon_walk(tokens(spark, sf), lex, 2)


PLACES = ("the", "in the", "old town", "is")


@query("fea28_places", f"""WITH RECURSIVE {WORDS}, low AS (SELECT doc_id, pos, {FOLD.format('word')} AS w, lead({FOLD.format('word')}) OVER (PARTITION BY doc_id ORDER BY pos) AS w1 FROM words),
c AS (SELECT doc_id, pos, CASE WHEN (w = 'in' AND w1 = 'the') OR (w = 'old' AND w1 = 'town') THEN 2 ELSE 1 END AS n FROM low WHERE (w = 'in' AND w1 = 'the') OR (w = 'old' AND w1 = 'town') OR w IN ('the', 'is')),
k AS (SELECT c.*, CASE WHEN n = 1 AND EXISTS (SELECT 1 FROM c p WHERE p.doc_id = c.doc_id AND p.pos = c.pos - 1 AND p.n = 2) THEN 0 ELSE 1 END AS free FROM c),
t AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL) SELECT t.doc_id, round(coalesce((SELECT sum(free) FROM k WHERE k.doc_id = t.doc_id), 0) / n::DOUBLE, 6) AS share FROM t""")
def fea28b(spark, sf):
    lex = spark.createDataFrame([(p, 1.0) for p in PLACES], "expression string, value double")
    spans = X.lexicon_spans(word_lists(spark, sf), lex, 2)
    return spans.select("doc_id", r6(F.size("spans") / F.col("n"), "share"))


RAW = [("in.among(st)", 4.0), ("among", 6.0), ("on.top(of)", 7.0), ("sub-", 2.0), ("over-", 3.0), ("forward(s)", 3.5), ("outside", 5.0), ("on (loc)", 6.5), ("on (adv)", 2.5), ("to", 4.5), ("to(inf)", 1.0), ("diag.opposite", 9.0), ("by(“walk.by”)", 0.5), ("near", None), ("behind", 5.5)]
RAW_SQL = ", ".join(f"('{f}', {'NULL' if v is None else v}::DOUBLE)" for f, v in RAW)


@query("lex6_preposition_build", f"""WITH raw(form, v) AS (VALUES {RAW_SQL}), k AS (SELECT * FROM raw WHERE v IS NOT NULL AND form NOT IN ('on.the.oth.side(of)', 'diag.opposite', 'by(“walk.by”)')),
m AS (SELECT CASE WHEN form = 'in.among(st)' THEN 'among(st)' ELSE form END AS form, CASE WHEN form = 'in.among(st)' THEN (SELECT avg(v) FROM k WHERE form IN ('in.among(st)', 'among')) ELSE v END AS v FROM k WHERE form <> 'among'),
s AS (SELECT replace(replace(form, '.', ' '), '(of)', '') AS form, (v - (SELECT min(v) FROM m)) / ((SELECT max(v) FROM m) - (SELECT min(v) FROM m)) AS i FROM m),
o AS (SELECT CASE form WHEN 'sub-' THEN 'sub\\w+' WHEN 'over-' THEN 'over\\w+' WHEN 'among(st)' THEN 'among(s|st)?' WHEN 'forward(s)' THEN 'forward(s)?' WHEN 'on (loc)' THEN 'on' ELSE form END AS prep, i, form FROM s)
SELECT prep, round(i, 6) AS imag, CAST(form IN ('sub-', 'over-', 'among(st)', 'forward(s)') AS INTEGER) AS is_regex, round(CASE WHEN prep IN ('outside', 'on', 'to') THEN i END, 6) AS pos_adp, round(CASE prep WHEN 'on' THEN (SELECT i FROM s WHERE form = 'on (adv)') WHEN 'to' THEN (SELECT i FROM s WHERE form = 'to(inf)') END, 6) AS pos_nonadp, CAST(len(string_split(prep, ' ')) AS INTEGER) AS n_words FROM o WHERE form NOT IN ('on (adv)', 'to(inf)')""")
def lex6b(spark, sf):
    out = A.preposition_lexicon(spark.createDataFrame(RAW, "form string, value double"))
    return out.select("prep", r6("imag"), "is_regex", r6("pos_adp"), r6("pos_nonadp"), "n_words")


@query("win1_previous_line", "SELECT conv_id, turn, md5(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS h FROM conversations")
def win1(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).alias("h"))


@query("win2_next_starts", "SELECT conv_id, turn, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user', true) AS last FROM conversations")
def win2(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.lead("role").over(W.partitionBy("conv_id").orderBy("turn")) == "user", F.lit(True)).alias("last"))


@query("win4_token_ngrams", f"WITH {WORDS}, n AS (SELECT doc_id, word || ' ' || lead(word) OVER w AS gram FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, count(gram) AS n, count(DISTINCT gram) AS kinds FROM n GROUP BY doc_id HAVING count(gram) > 0")
def win4(spark, sf):
    g = X.ngrams(word_lists(spark, sf), "word", 2, 2)
    return g.groupBy("doc_id").agg(F.sum("count").alias("n"), F.count("*").alias("kinds"))
