"""Forms of the operators that stay bounded as tables grow, against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import annotations as A
from scriptorium.operators import features as X


@pytest.mark.parametrize("letters", ["ab", "aßé😀b ", "".join(chr(200 + 7 * k) for k in range(4000))])
def test_kinds_of_ngrams_are_counted_inside_tasks(spark, letters):
    """No n-gram is a row; parts of a text count together, and alphabets too large for one number."""
    rng = random.Random(len(letters))
    rows = [(k // 2, None if k == 7 else "".join(rng.choices(letters, k=rng.choice([0, 1, 4, 5, 300])))) for k in range(60)]
    want = {}
    for doc in {d for d, _ in rows}:
        grams = Counter(f[i : i + n] for d, t in rows if d == doc and t for f in [t.lower().replace("ß", "ss")] for n in range(2, 6) for i in range(len(f) - n + 1))
        if grams:
            want[doc] = (sum(grams.values()), len(grams))
    got = A.char_ngram_kinds(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Generate" not in got._jdf.queryExecution().analyzed().toString()
    assert {r["doc_id"]: (r["n"], r["kinds"]) for r in got.collect()} == want


def test_features_of_words_need_no_window(spark):
    """Texts are dealt once, and their words never; parts of a text count together."""
    docs = spark.createDataFrame([(1, "The cat in the hat. IN The"), (1, "the End"), (2, None), (3, "one")], "doc_id long, text string")
    lists = X.texts_words(docs)
    lex = spark.createDataFrame([("in the", 0.5), ("the", 0.25), ("in the hat", None), ("in", 1.0), ("in", 0.5), ("x y", 1.0)], "expression string, value double")
    made = {"wide": X.wide(lists), "pairs": X.case_bigrams(lists), "spans": X.lexicon_spans(lists, lex, 3), "kinds": X.type_token(lists), "sizes": X.sliding_lengths(lists)}
    for df in made.values():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
    spans = {r["doc_id"]: (r["n"], [tuple(s) for s in r["spans"]]) for r in made["spans"].collect()}
    assert spans == {1: (9, [(0, 0, 0.25), (2, 4, None), (5, 6, 0.5), (7, 7, 0.25)]), 3: (1, [])}
    assert {r["doc_id"]: round(r["type_token"], 4) for r in made["kinds"].collect()} == {1: round(5 / 9, 4), 3: 1.0}
    assert {r["doc_id"]: (r["words"], r["the"]) for r in made["wide"].collect()} == {1: (9, 4 / 9), 3: (1, 0.0)}
    assert {r["doc_id"]: r["syllables"] for r in X.wide(lists, most=1).collect()} == {r["doc_id"]: r["syllables"] for r in made["wide"].collect()}


def test_pairs_of_words_are_summed_by_pair_alone(spark, tmp_path):
    """counts and texts of a pair come out of one aggregate, without a row for each pair and text."""
    from scriptorium.plans import catalog

    spark.createDataFrame([(1, "a b a b " * 15), (1, "B a"), (2, "a b"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["agg10_ngram_frequencies"](spark, str(tmp_path))
    assert {(r["gram"], r["tf"], r["df"]) for r in got.collect()} == {("a b", 31, 2), ("b a", 30, 1)}
    assert "distinct" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rank_correlation_without_a_window_over_a_key(spark):
    """a key's rows are never in one task; ties, nulls and a key without spread."""
    from statistics import correlation

    from scriptorium.operators import metrics as M

    ranks = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    rng = random.Random(7)
    rows = [(k, rng.randrange(6), rng.choice([0.5, 1.25, None, rng.random()])) for k in ("a", "b", None) for _ in range(200)] + [("flat", 1, 0.5)] * 3
    df = spark.createDataFrame(rows, "model string, y int, p double")
    made = M.spearman(df, ["model"])
    got = {r["model"]: (r["n"], r["spearman"]) for r in made.collect()}
    for key in ("a", "b", None):
        mine = [(y, p) for m, y, p in rows if m == key and p is not None]
        assert got[key][0] == len(mine) and got[key][1] == pytest.approx(correlation(*(ranks(v) for v in zip(*mine))), abs=1e-9)
    assert got["flat"] == (3, None)
    assert "rank(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_marked_inside_their_text(spark):
    """no line is shuffled; the cheap tests before the patterns leave nothing out."""
    from scriptorium.functions import text as T
    from scriptorium.operators import cleaning as C

    odd = ["a COPYRİGHT b", "ıſbn 1234567890 and more", "WWW.x", "x.COM", "Kapitel", "see ACT iv", "12 13 14", "go on      7 ", "ıNDEX", "x ©", "HTTPſ://x", "plain words here", "parT ıı"]
    plain = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "doc_id int, line string")
    pattern = F.lit(False)
    for p in T.DROP_LINE.values():
        pattern = pattern | F.col("line").rlike(p)
    rows = plain.select("line", pattern.alias("want"), T.dropped_line(F.col("line")).alias("got")).collect()
    assert [r["line"] for r in rows if r["want"] != r["got"]] == [] and {r["want"] for r in rows} == {True, False}
    docs = spark.createDataFrame([(1, "First line of a text.\nISBN 1234567890.\n\nLast line of it"), (2, None), (3, "short"), (4, "            ")], "doc_id int, text string")
    for df in (C.cleaned(docs), C.removed_lines(docs), C.marked(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan and "Join" not in plan
    assert {r["doc_id"]: r["removed"] for r in C.removed_lines(docs).collect()} == {1: [1]}
    assert {r["doc_id"]: r["text"] for r in C.cleaned(docs).collect()} == {1: "First line of a text.\n\n\nLast line of it", 2: None, 3: "short", 4: ""}


def test_words_meet_segments_inside_a_row(spark, monkeypatch):
    """no word is kept in the shared folder, only numbers of odd documents; lines fold as they group."""
    from scriptorium.operators import geometry as G

    from .test_alignment import CASES, made

    parts, kept, cut = made(spark, CASES), [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: kept.append(df.columns) or cut(df))
    plan = G.aligned_rows(G.together(*parts))._jdf.queryExecution().optimizedPlan().toString()
    assert kept == [["doc"]] and "Window" not in plan
    lines = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.select("doc", "seg", "page", "block", "line", "top", "bottom", "left", "right").collect())
    assert lines(G.line_bounds_rows(G.together(*parts))) == lines(G.line_bounds(G.by_cursor(*parts)))


def test_prepositions_are_marked_inside_a_row(spark):
    """No join by place and no group per text; runs are used up in the lexicon's order."""
    tokens = spark.createDataFrame([(d, p, w, w, "ADP" if p % 2 else "NOUN") for d, ws in ((1, "in in the in the of x"), (2, "the")) for p, w in enumerate(ws.split())], "doc_id long, pos long, itext string, lemma string, tag string")
    lex = [(0, "in the", None, 0, None, None, 2), (1, "in in the", 0.5, 0, None, None, 3), (2, "x$", 0.25, 1, None, None, 1), (3, "of", 0.75, 0, 0.1, 0.2, 1), (4, "the", 0.4, 0, 0.3, None, 1), (5, "in", 1.0, 0, None, None, 1)]
    got = A.prepositions(tokens, spark.createDataFrame(lex, "ord int, prep string, imag double, is_regex int, pos_adp double, pos_nonadp double, n_words int"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "FlatMapGroupsInPandas" not in plan
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 1, 1.0), (1, 1, 2, None), (1, 3, 2, None), (1, 5, 1, 0.1), (1, 6, 1, 0.25)]


def test_parts_are_called_without_a_group_each(spark):
    """a part is a row; errors and wrong numbers of answers go to each of its requests."""
    from scriptorium.streaming import jobs as J

    def call(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return texts[1:] if "few" in texts else [t.upper() for t in texts]

    rows = spark.createDataFrame([(1, "a", 0, 0, "m"), (2, "b", 0, 0, "m"), (3, "bad", 0, 1, "m"), (4, "c", 0, 1, "m"), (5, "few", 1, 0, "m")], "id long, text string, slot long, part int, model string")
    got = J.answered(rows, call, ("model",), "id", "text")
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["answer"], r["error"]) for r in got.collect()) == [(1, "A", None), (2, "B", None), (3, None, "refused"), (4, None, "refused"), (5, None, "not as many answers as requests")]


class Held:
    """A state variable or a handle of a processor, as a plain object that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name.startswith("get") and name.endswith("State"):
                return self.__dict__.setdefault("made", {}).setdefault(args[0], Held())
            if name == "get":
                return self.value
            if name in ("put", "update"):
                self.value = args[0]
            return 0

        return call


def test_state_is_read_and_written_once_a_batch():
    """calls for state don't grow with a text's segments; a later segment replaces an earlier one."""
    import pandas as pd

    from scriptorium.streaming import live as L

    handle, work = Held(), L.Reselected(1.5, 8.0, 0.25)
    work.init(handle)
    frame = pd.DataFrame({"doc": 1, "id": range(500), "ord": range(500), "y": [k / 5 for k in range(500)], "score": [0.9] * 500})
    assert len(list(work.handleInputRows((1,), iter([frame, frame[:3].assign(score=None)]), Held()))) == 1
    assert work.segments.calls == 2 and [len(x) for x in work.segments.value] == [500] * 4 and work.segments.value[3][:4] == [None] * 3 + [0.9]


def test_answers_are_sent_by_frame_of_requests():
    """one frame of answers for a frame of requests, not one for each call."""
    import pandas as pd

    from scriptorium.streaming import live as L

    work = L.MicroBatched(lambda texts: [t.upper() for t in texts])
    work.init(Held())
    work.waiting.value = [(0, "a")]
    out = list(work.handleInputRows(("m", 0), iter([pd.DataFrame({"id": range(1, 1001), "text": "b"})]), Held()))
    assert [len(f) for f in out] == [992] and set(out[0]["size"]) == {16} and len(work.waiting.value) == 9


def test_a_stream_that_still_gets_rows_is_in_time():
    """the time limit is one without new rows."""
    from types import SimpleNamespace as N

    from scriptorium.streaming import live as L

    class Query:
        recentProgress, stopped = [], False
        exception = lambda self: None

        def stop(self):
            self.stopped = True

    query, looks = Query(), []

    def done():
        looks.append(1)
        query.recentProgress = [N(batchId=len(looks), numInputRows=1)]
        return len(looks) == 4

    assert L.kept_running(lambda: query, done, seconds=0.8) == 0 and query.stopped
    with pytest.raises(TimeoutError):
        L.kept_running(Query, lambda: False, seconds=0.5)


def test_tokens_of_the_feature_vector_are_neither_shuffled_nor_kept(spark):
    """one pass over a document's tokens for all extractors; what is shuffled is a row a document."""
    from scriptorium.plans import vector

    df = vector.vectors(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 2 and plan.count("Generate") <= 3


@pytest.mark.parametrize("rows, size", [(1, 1), (3, 4), (5, 1000)])
def test_blocks_of_the_feature_vector_hold_whole_documents(spark, rows, size):
    """wherever Arrow's batches end, a document counts as a whole; those without tokens, too."""
    import pyarrow as pa

    from scriptorium.operators import tallies as N
    from scriptorium.operators import vectors as V

    # text, tag, sentence, head, relation, value alone, entity, category
    said = {
        1: [("The", "DET", 0, 0, "r0", None, None, None), ("cat", "NOUN", 0, 1, "r1", 0.25, "cat", "C1"), ("in", "ADP", 0, 2, "r2", 0.5, None, None), (".", "PUNCT", 0, 1, "r3", None, None, None), ("cat", "NOUN", 1, 0, "r1", 0.25, "cat", "C0")],
        2: [], 3: [("in", "ADP", 1, 0, "r0", 0.5, None, None), ("the", "DET", 1, 1, "r1", None, None, None)], 4: [("!", "PUNCT", 0, 0, "r0", None, None, None)],
    }
    flat = [(d, *x) for d, xs in said.items() for x in (xs or [(None,) * 8])]
    column = lambda k, kind: pa.array([r[k] for r in flat], kind)
    nothing = lambda kind: pa.nulls(len(flat), kind)
    string, number = pa.string(), pa.int32()
    table = pa.table({
        "doc_id": column(0, pa.int64()), "text": column(1, string), "itext": pa.array([r[1] and r[1].lower() for r in flat], string), "tag": column(2, string), "fine_tag": column(5, string), "tense": nothing(string), "label": column(2, string),
        "relation": column(5, string), "coref": column(7, string), "cat": column(8, string), "sense": nothing(string), "is_stop": nothing(pa.bool_()), "like_num": nothing(pa.bool_()), "event": nothing(pa.bool_()), "sentence": column(3, number),
        "head": column(4, number), "chunk": nothing(number), "senses": nothing(number), "case": nothing(number), "syllables": pa.array([r[1] and 1 for r in flat], number), "alone": column(6, pa.float64()),
    })
    grams = {"tag": [("DET NOUN", 0), ("ADP DET", 1)], "node": [("DET NOUN", 0), ("DET NOUN ADP", 1)], "relation": [("r1", 2), ("r1 r2", 3)], "both": [("DET r1 NOUN", 4)]}
    run = N.vector_counter(grams, (("r0", "r1"), ("C0", "C1"), ()), {"in the": 0.9, "the": 0.3, "cat": None}, {"the": 1.0}, [(["in", "the"], 0.7)], 3, size)
    got = {r["doc_id"]: {p["feature"]: round(p["value"], 9) for p in r["pairs"]} for b in run(iter(table.to_batches(rows))) for r in b.to_pylist()}
    part = lambda d, name: {k - V.OFFSET[name]: v for k, v in got[d].items() if 0 <= k - V.OFFSET[name] < V.LAYOUT[name]}
    third = round(1 / 3, 9)
    assert list(got) == [1, 2, 3, 4] and got[2] == {V.OFFSET["sentence_lengths"]: 1.0}
    assert part(1, "tag_ngrams") == {0: 0.111111111} and part(3, "tag_ngrams") == {1: 1.0} and part(4, "tag_ngrams") == {}
    assert part(1, "tree_structure") == {0: 0.5, 2: 0.5, 18: 0.5, 19: 0.5, 36: 0.5, 37: 0.5}
    assert part(1, "tree_ngrams") == {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.5, 4: 1.0} and part(3, "tree_ngrams") == {2: 1.0}
    assert part(1, "concreteness") == {6: 0.25, 20: 0.3} and part(3, "concreteness") == {18: 1.0, 20: 0.9} and part(3, "places") == {0: 0.5}
    assert part(1, "imageability") == {2: 0.5, 5: 0.25, 10: third} and part(3, "imageability") == {7: 0.5, 10: 0.7}
    assert part(1, "entities") == {1: 0.25} and part(1, "fine_tags") == {0: 0.2, 1: 0.4} and part(1, "type_token") == {0: 0.75}
    assert part(1, "sentence_lengths") == {0: 0.5, 1: 0.5, 26: round(4 / 2 / 78, 9)} and part(3, "sentence_lengths") == {0: 1.0, 26: round(1 / 78, 9)}
    assert part(4, "punctuation") == {4: 1.0} and part(4, "word_lengths") == {}
    with pytest.raises(ValueError, match="outside its sentence"):
        list(run(iter(table.set_column(table.schema.get_field_index("head"), "head", pa.array([9] * len(flat), number)).to_batches())))
    with pytest.raises(ValueError, match="cycle"):
        list(run(iter(table.slice(6, 2).set_column(table.schema.get_field_index("head"), "head", pa.array([2, 1], number)).to_batches())))


WORDS = ["The", "the", "of", "to", "don't", "''", "'", "UPPER", "iPod", "Straße", "İx", "ΟΔΟΣ", "été", "Été", "Jean'Luc", "x2", "12", "²", "ǅ", "business", "created", "mias", "riet", "nation", "😀", "—", ".", "aßs", "K"]


def test_words_of_the_annotator_in_tasks_are_those_of_spark(spark):
    """what is said of a word inside a task is what Spark's own functions say."""
    import numpy as np
    import pyarrow as pa

    from scriptorium.functions import text as T
    from scriptorium.operators import annotators as R
    from scriptorium.operators import extractors as E

    w = F.col("w")
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(WORDS)], "k int, w string").select("k", T.casefolded(w), T.syllables(w), T.case_class(w), F.length(w)).orderBy("k").collect()
    assert R.casefolded(WORDS) == [r[1] for r in rows] and R.syllables(WORDS).tolist() == [r[2] for r in rows]
    assert [(None, "lower", "upper", "title")[k] for k in R.cases(pa.array(WORDS), WORDS)] == [r[3] for r in rows]
    texts = ["She said \"a 'b\" c' 'd' \"", "''x''", "", "'a\"b'\"c", "plain"]
    shares = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string").select("k", T.quoted_share(F.col("t"))).orderBy("k").collect()
    assert [R.quoted_share(x) for x in texts] == [r[1] or 0.0 for r in shares]
    lex = [(0, "tion$", 0.6, 1, None, None, 1), (1, "of", 0.5, 0, 0.1, 0.2, 1), (2, "the", 0.4, 0, 0.3, None, 1), (3, "to", 0.25, 0, None, None, 1), (4, "mia", 0.75, 0, None, None, 1)]
    lex = spark.createDataFrame(lex, "ord int, prep string, imag double, is_regex int, pos_adp double, pos_nonadp double, n_words int")
    said = [(k, form, form.removesuffix("s"), tag) for k, (form, tag) in enumerate((f, t) for f in R.casefolded(WORDS) for t in ("ADP", "NOUN"))]
    want = A.alone(spark.createDataFrame(said, "k int, itext string, lemma string, tag string"), lex).orderBy("k").collect()
    got = E.alone(lex)([s[1] for s in said], [s[2] for s in said], np.array([s[3] == "ADP" for s in said]))
    assert [None if np.isnan(v) else v for v in got] == [r["alone"] for r in want]


def test_tokens_made_in_tasks():
    """tokens, sentences and nodes of texts by a plain loop; words are remembered, and forgotten when there are too many."""
    import re

    import numpy as np

    from scriptorium.operators import annotators as R

    texts = ["One two. Three's ‘x’ 4..", "", "...", " a.b c\td😀é. ", "é", "No stop"]
    t, want = R.Tokens(texts), []
    for d, text in enumerate(texts):
        sentence = node = 0
        for pos, w in enumerate(re.findall(r"(?:[^\W_]|')+|(?:[^\w \t\n\f\r']|_)", text)):
            node += 1
            want.append((d, pos, sentence, node, w))
            if w == ".":
                sentence, node = sentence + 1, 0
    words = R.listed(t.words)
    assert list(zip(t.owner.tolist(), t.pos.tolist(), t.sentence.tolist(), t.node.tolist(), [words[k] for k in t.code])) == want
    calls = []
    memory = R.Memory(lambda ws: calls.append(ws) or {"n": np.array([len(w) for w in ws])}, most=3)
    assert [memory(x)["n"].tolist() for x in (["a", "bb"], ["bb", "ccc"], [], ["dd", "e"], ["a"])] == [[1, 2], [2, 3], [], [2, 1], [1]]
    assert calls == [["a", "bb"], ["ccc"], ["dd", "e"], ["a"]]


def test_vectors_stay_in_their_texts_row(spark, monkeypatch):
    """no token is a row, no vector is shuffled or kept in the shared folder; an id that is there twice is an error."""
    from scriptorium.operators import vectors as V
    from scriptorium.plans import catalog, vector

    kept, cut = [], vector.cut
    monkeypatch.setattr(vector, "cut", lambda df: kept.append(df.columns) or cut(df))
    for name in ("fea_vector", "fea_vector_parts"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan and "collect_list" not in plan
    assert kept == [["family", "gram", "n"]] * 2
    docs = spark.createDataFrame([(1,), (None,), (None,)], "doc_id long")
    lists = docs.selectExpr("doc_id", "array(3, 5) AS indices", "array(0.5D, 1D) AS values")
    assert sorted((r["doc_id"] or 0, r["size"], r["indices"], r["values"]) for r in V.whole(docs, lists, 9).collect()) == [(0, 9, [], []), (1, 9, [3, 5], [0.5, 1.0])]
    with pytest.raises(ValueError, match="two values"):
        V.whole(docs.unionAll(docs), lists)


def test_ngrams_of_characters_by_a_trie():
    """counts of selected n-grams that begin anywhere and don't go over a text's end."""
    from scriptorium.operators import annotators as R

    grams, texts = {"ab": 3, "abc": 1, "b ": 7, "bcabc": 4, "😀b": 5, "cc": 0}, ["abcabc ab ", "", "😀b", "ab", "c", "cabcabcc"]
    want = {(d, k): sum(t.startswith(g, i) for i in range(len(t))) for d, t in enumerate(texts) for g, k in grams.items()}
    assert dict(zip(zip(*(x.tolist() for x in R.CharacterGrams(grams).counts(texts)[:2])), R.CharacterGrams(grams).counts(texts)[2].tolist())) == {k: n for k, n in want.items() if n}
    assert [len(x) for x in R.CharacterGrams({}).counts(texts)] == [0, 0, 0]


def test_sums_of_parts_are_those_of_the_dense_vector(spark):
    """parts are summed on places and values; the dense vector's parts, and what a mask leaves, have the same sums."""
    from scriptorium.operators import vectors as V
    from scriptorium.plans import vector

    rng = random.Random(3)
    rows = [(d, sorted(rng.sample(range(V.SIZE), n))) for d, n in enumerate((0, 1, 40, 3000))]
    rows = [(d, V.SIZE, at, [rng.choice([0.5e-6, 1.5e-6, 0.25, -1.0, rng.random()]) for _ in at]) for d, at in rows]
    df = spark.createDataFrame(rows, "doc_id long, size int, indices array<int>, values array<double>")
    got = {(r["doc_id"], r["extractor"]): (r["places"], r["total"]) for r in df.select("doc_id", "indices", "values").mapInArrow(vector.sums_of_parts, "doc_id long, extractor string, places int, total long").collect()}
    dense, want = df.select("doc_id", V.dense().alias("v")).cache(), {}
    for name, part in {**{x: V.part("v", x) for x in V.LAYOUT}, "without n-grams": V.without("v", list(vector.DROPPED))}.items():
        for r in dense.select("doc_id", part.alias("p")).collect():
            some = [x for x in r["p"] if x]
            if some:
                want[r["doc_id"], name] = (len(some), sum(int(abs(x) * 1e6 + 0.5) * (1 if x > 0 else -1) for x in some))
    assert got == want and len(got) > 30


def test_outlines_are_drawn_inside_a_row(spark):
    """no word, line or polygon is shuffled or kept and a document is worked off once; the same outlines as by groups."""
    import numpy as np
    import pyarrow.compute as pc

    from scriptorium.operators import geometry as G
    from scriptorium.operators.geometry import Pages
    from scriptorium.plans import catalog

    from .test_alignment import CASES, made

    def read(rows):
        flat = lambda name: rows.column(name).flatten()
        begins = lambda name: np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(rows.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        boxes, size = flat("boxes"), np.ones(len(flat("boxes")))
        number = {n: boxes.field(n).to_numpy(zero_copy_only=False) for n in ("page", "ord", "block", "line", "x0", "y0", "x1", "y1")}
        return Pages(doc=rows.column("doc"), at=begins("boxes"), word=boxes.field("word"), **number, width=size * 500, height=size * 800, seg_at=begins("segments"), seg=flat("segments").field("seg").to_numpy(zero_copy_only=False), text=flat("segments").field("text"), full=rows.column("full"), removed=rows.column("removed"))

    parts = made(spark, CASES)
    docs = G.together(*parts)
    got = G.outlined(docs.select("doc", F.col("full").alias("text"), "boxes", "segments", "full", "removed"), read)
    pages = parts[0].select("doc", "page").distinct().select("doc", "page", F.lit(500.0).alias("width"), F.lit(800.0).alias("height"))
    rows = lambda df: sorted((r["doc"], r["seg"], r["page"], [[round(v, 9) for v in p] for p in r["polygon"]]) for r in df.collect())
    want = rows(G.drawn(G.line_bounds_rows(docs), pages))
    assert rows(got) == want and {r[0] for r in want} > {4, 5, 7}
    plan = catalog.QUERIES["geo2_outlines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan and "LogicalRDD" not in plan


def test_normalised_text_without_a_pattern():
    """every character, and texts at once, as the pattern has them."""
    import unicodedata

    import pyarrow as pa

    from scriptorium.operators import cleaning as C
    from scriptorium.operators import geometry as G

    def want(t):
        return C.NORMALISED.sub("", unicodedata.normalize("NFKC", t).translate(str.maketrans("’“”", "'\"\"", "\r﻿")))

    texts = ["".join(map(chr, range(a, min(a + 1000, 0x110000)))) for a in range(0, 0x110000, 1000) if not 0xD000 <= a < 0xE000]
    texts += [chr(k) for k in range(0x3000)] + ["a - b", "", "x́ é", "́", "one\0two"]
    assert [G.plain(t) for t in texts] == [want(t) for t in texts]
    assert G.plain_all(pa.array([*texts[1:300], None])).to_pylist() == [*map(want, texts[1:300]), ""]
    assert G.plain_all(pa.array(["e", "́a", "on-", None, "", "e"])).to_pylist() == ["e", "́a", "on", "", "", "e"] and G.plain_all(pa.array(["a\0b", "c-"])).to_pylist() == ["a\0b", "c"]
