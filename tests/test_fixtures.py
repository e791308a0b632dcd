"""Small cases with results worked out by hand, nulls and empty tables among them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import scorers as P
from scriptorium.functions import text as T
from scriptorium.operators import annotations as A
from scriptorium.operators import calibration as K
from scriptorium.operators import cleaning as C
from scriptorium.operators import features as X
from scriptorium.operators import geometry as G
from scriptorium.operators import selection as S
from scriptorium.sources import readers as I
from scriptorium.sources import writers as O


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_preprocessing(spark):
    assert column(spark, ["a\r’b“c”？！", None, ""], "string", T.preprocessed) == ["a'b\"c\"?!", None, ""]


def test_before_clean(spark):
    got = column(spark, ["  He went\nhome.\n\n12\n\nThen “No!”\nhe said ", "a\nb\ne", "Page 7.\nHey.", 'He said "go now.\nand left', None, ""], "string", T.before_clean)
    assert got == ['He went home.\n\nThen "No!"\nhe said', "a b e", "\nHey.", 'He said "go now. and left', None, ""]


@pytest.mark.parametrize("line", ["CHAPTER I", "12/03/1999", "12 He said hello.", "Visit example.com today", "The epilogue was long.", "* * * * *", "mix", "[a note]", "ISBN 0-306-40615-2", "© 1999 by me", "Intro ..... 7", "† see below"])
def test_dropped_lines(spark, line):
    assert column(spark, [line], "string", T.dropped_line) == [True]


def test_kept_lines(spark):
    assert column(spark, ["He read the paper.", "Émile était là", "Chapters are long", "in 1999 it was"], "string", T.dropped_line) == [False] * 4


def test_cleaned(spark):
    rows = [(1, "Preface.\nIt was a long and dark night in the town."), (2, "They sat in the old library for hours.\nHe read the preface."), (3, "Hi."), (4, None), (5, ""), (6, "CHAPTER I.\n12 notes."), (7, "First line here.\n* * * * * *\nLast line here.")]
    got = {r["doc_id"]: r["text"] for r in C.cleaned(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1] == "\n\nIt was a long and dark night in the town."
    assert got[2] == "They sat in the old library for hours.\nHe read the preface."
    assert got[3] == "Hi." and got[4] is None and got[5] == ""
    assert got[6] == "\n\n\n" and got[7] == "First line here.\n\n\nLast line here."


def test_removed_ranges(spark):
    rows = [(1, 0, "abc", False, "abc"), (1, 1, "I", True, "I"), (1, 2, "de", False, "de")]
    got = C.removed_ranges(spark.createDataFrame(rows, "doc_id int, line_no int, line string, dropped boolean, plain string")).first()
    assert got["full"] == "abcIde" and [tuple(x) for x in got["removed"]] == [(3, 4)]


def test_syllables(spark):
    # vowel groups: make 2 - .ake 1 = 1; social 2 - cial 1 + ia 1 = 2; mcs 0 + 2 = 2; prism 1 + ism 1; quietly 2 - uiet 1 + iet 1 + three vowels 1
    assert column(spark, ["make", "social", "mcs", "prism", "quietly", "", "rhythms", None], "string", T.syllables) == [1, 2, 2, 2, 3, 1, 1, None]


def test_normalised(spark):
    assert column(spark, ["ﬁ – “x” y-\nz", None], "string", lambda c: C.normalised(c)) == ['fi"x"yz', None]


def test_quotes(spark):
    assert column(spark, ['"ab" c', "don't say \"hi\"", ""], "string", T.quoted_share) == [pytest.approx(2 / 6), 0.0, 0.0]


def test_scores(spark):
    assert column(spark, [[0.2, 0.8], [1.0, 1.0, 2.0], [], [0.0, 0.0], [0.3]], "array<double>", T.expected_position) == [pytest.approx(0.8), pytest.approx(0.625), 0, 0, 1.0]
    texts = ['{"rating": 3}', "Rating: 4", "foo {bad} 7", '{"rating": 9}', '{"x": 1}', "4-5 6", "a-7", "score -35", None]
    assert column(spark, texts, "string", T.parsed_rating) == [3, 4, None, None, 1, None, None, 5, None]


def test_quantile_map(spark):
    train = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.2, 3), (0.9, 5), (None, 2), (float("nan"), 2), (0.5, None)], "s double, y int")
    asked = spark.createDataFrame([(0.05,), (0.2,), (1.0,), (None,)], "s double")
    got = {r["s"]: r["calibrated"] for r in K.quantile_map(train, "s", "y").predict(asked, "s").collect()}
    assert got == {0.05: 0.0, 0.2: 3.5, 1.0: 5.0, None: None}
    assert K.quantile_map(train.limit(0), "s", "y").predict(asked, "s").filter("calibrated IS NULL").count() == 4


def test_quantile_map_by_force(spark):
    rng = np.random.default_rng(3)
    s, y, q = rng.integers(0, 40, 300) / 7, rng.integers(0, 6, 300), rng.integers(-5, 50, 60) / 7
    train = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    got = {r["s"]: r["calibrated"] for r in K.quantile_map(train, "s", "y").predict(spark.createDataFrame([(float(x),) for x in set(q)], "s double"), "s").collect()}
    assert all(got[float(x)] == pytest.approx(np.quantile(y, (s <= x).mean())) for x in set(q))


def test_ordinal_is_monotone_and_near(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=600)
    y = np.clip(np.rint(2.5 + 2 * s), 0, 5).astype(int)
    train = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    model = K.ordinal_logistic(train, "s", "y")
    out = sorted((r["s"], r["calibrated"], r["y"]) for r in model.predict(train, "s").collect())
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(out, out[1:]))
    assert np.sqrt(np.mean([(c - t) ** 2 for _, c, t in out])) < 0.5 and model.thresholds == sorted(model.thresholds)


def test_isotonic(spark):
    train = spark.createDataFrame([(1.0, 0), (2.0, 2), (3.0, 1), (4.0, 5)], "s double, y int")
    got = {r["s"]: r["calibrated"] for r in K.isotonic(train, "s", "y").predict(spark.createDataFrame([(0.0,), (2.5,), (9.0,), (None,)], "s double"), "s").collect()}
    assert got == {0.0: 0.0, 2.5: 1.5, 9.0: 5.0, None: None}


def segments(spark, ys, scores):
    return spark.createDataFrame([(1, k, k, y, s) for k, (y, s) in enumerate(zip(ys, scores))], "doc int, id int, ord int, y double, score double")


def test_selection(spark):
    rows = segments(spark, [0.0, 1.0, 2.0, 3.0], [0.3, 0.9, 0.5, 0.8])
    assert sorted(r["id"] for r in S.selected(rows, 1.5, 8.0, 0.25).collect()) == [1, 3]
    assert S.most_selectable(rows, 1.5, 0.25).first()["most"] == 2
    # an unscored and a low one; out of order after the gap was left, a segment is free again
    rows = segments(spark, [0.0, 5.0, 1.0, 9.0], [0.9, 0.1, 0.9, None])
    assert S.most_selectable(rows, 1.5, 0.25).first()["most"] == 2
    assert S.selected(segments(spark, [0.0], [0.1])).count() == 0


def test_editors(spark):
    queue = spark.createDataFrame([(1, "p"), (1, "p"), (2, "q")], "id int, prompt string")
    assert [tuple(r) for r in S.toggled(queue).collect()] == [(2, "q")]
    changes = [(1, 1, 1, "open", None), (1, 1, 2, "update", True), (1, 1, 3, "open", None), (1, 2, 1, "update", True), (1, 2, 2, "close", None), (1, 3, 1, "open", None)]
    got = {r["id"]: r["has_image"] for r in S.editor_states(spark.createDataFrame(changes, "doc int, id int, at int, kind string, has_image boolean")).collect()}
    assert got == {1: True, 3: False}


def test_heatmap(spark):
    one = spark.range(1)
    p = one.select(G.heatmap_pixel(F.lit(0.5), F.lit(0.25), F.lit(1), 1.5, 100, 300, 3).alias("p"), G.heatmap_pixel(F.lit(0.5), F.lit(0.25), F.lit(3), 1.5, 100, 300, 3).alias("q")).first()
    assert tuple(p["p"]) == (50, 187.5) and p["q"] is None
    v = one.select(G.viewport(F.lit(100.0), F.lit(1000.0), F.lit(200.0)).alias("v"), G.inverse_pixel(F.lit(50.0), F.lit(150.0), F.lit(100.0), F.lit(200.0)).alias("i"), G.opacity(F.lit(1.0)).alias("a"), G.opacity(F.lit(0.0)).alias("b")).first()
    assert tuple(v["v"]) == (0.1, 0.2, 100, 200) and tuple(v["i"]) == (0.5, 0.75) and (v["a"], v["b"]) == (pytest.approx(0.8), 0.05)


def test_page_rows(spark):
    square = [[0.1, 0.1], [0.2, 0.2]]
    rows = [(2, {1: square}, 0.2), (1, {0: square, 4: []}, 0.9), (3, {0: square}, None)]
    got = G.page_rows(spark.createDataFrame(rows, "id int, polygons map<int,array<array<double>>>, score double")).collect()
    assert [(r["id"], r["page"]) for r in got] == [(1, 0), (2, 1)]


def test_placed_words():
    words = list(enumerate(["The", "cat", "(oops)", "CHAPTER", "satdown", "now."]))
    full = "ThecatCHAPTERsatdownnow."
    got = G.placed(words, ["The cat sat", "down now."], full, [(6, 13)])
    assert got == [(0, 0, 0.0, 1.0), (0, 1, 0.0, 1.0), (0, 4, 0.0, 3 / 7), (1, 4, 3 / 7, 1.0), (1, 5, 0.0, 1.0)]


def test_outline():
    box = G.outline([(10, 20, 30, 90)], 100, 100, padding=1)
    assert box == [pytest.approx((0.29, 0.09)), pytest.approx((0.29, 0.21)), pytest.approx((0.91, 0.21)), pytest.approx((0.91, 0.09))]
    # a step of 5 is smoothed outwards, one of 40 stays with its joint at the mean height
    assert G.smoothed([(30, 0), (30, 10), (25, 12), (25, 20)], True) == [(25, 0), (25, 10), (25, 12), (25, 20)]
    assert G.smoothed([(30, 0), (30, 10), (70, 12), (70, 20)], True) == [(30, 0), (30, 11.0), (70, 11.0), (70, 20)]


def test_sentence_lengths(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    words = spark.createDataFrame([(1, 0)] * 4 + [(1, 2)] * 3 + [(3, 1)] * 3, "doc_id int, sentence int")
    got = sorted((r["doc_id"], r["bin"], round(r["share"], 4), round(r["mean"], 4)) for r in A.sentence_lengths(docs, words).collect())
    assert got == [(1, 1, round(2 / 3, 4), round(7 / 3 / 78, 4)), (2, 0, 1.0, 0.0), (3, 0, 0.5, round(1.5 / 78, 4)), (3, 1, 0.5, round(1.5 / 78, 4))]


def test_phrases(spark):
    got = A.phrase_lengths(spark.createDataFrame([(1, 3)], "doc_id int, length int"), spark.createDataFrame([(1, 6)], "doc_id int, n int")).collect()
    assert [tuple(r) for r in got] == [(1, 2, 0.5)]


def test_lexicons(spark):
    tokens = spark.createDataFrame([(1, k, w, w) for k, w in enumerate(["ice", "cream", "ice"])], "doc_id int, pos int, itext string, lemma string")
    lex = spark.createDataFrame([("ice", 0.5), ("ice cream", 0.9)], "expression string, value double")
    got = sorted(tuple(r) for r in X.lexicon_matches(tokens.withColumnRenamed("itext", "word"), lex, 2).select("start", "stop", "value").collect())
    assert got == [(0, 1, 0.9), (2, 2, 0.5)]
    walk = spark.createDataFrame([(1, 0, "creams", "cream"), (1, 1, "iced", "ice"), (1, 2, "creams", "cream")], "doc_id int, pos int, itext string, lemma string")
    assert sorted((r["pos"], r["n"], r["value"]) for r in A.lexicon_walk(walk, lex, 2).collect()) == [(1, 2, 0.9)]


def test_prepositions(spark):
    tokens = spark.createDataFrame([(1, 0, "straightforward", "straightforward", "ADJ"), (1, 1, "on", "on", "ADV"), (1, 2, "to", "to", "NOUN")], "doc_id int, pos int, itext string, lemma string, tag string")
    lex = spark.createDataFrame([(0, "forward(s)?", 0.5, 1, None, None, 1), (1, "on", 0.7, 0, 0.7, 0.2, 1), (2, "to", 0.4, 0, 0.4, None, 1)], "ord int, prep string, imag double, is_regex int, pos_adp double, pos_nonadp double, n_words int")
    assert sorted((r["pos"], r["value"]) for r in A.prepositions(tokens, lex).collect()) == [(0, 0.5), (1, 0.2)]


def test_providers(spark):
    def shout(t):
        return t.upper()

    rows = spark.createDataFrame([(0, "valid", "string"), (1, "123", "int"), (2, "", "string"), (3, None, "string")], "k int, v string, kind string")
    got = [r["x"] for r in rows.select("k", P.attempted([("shout", shout)], F.col("kind"))(F.col("v")).alias("x")).orderBy("k").collect()]
    assert got[0]["ok"] and got[0]["value"] == "VALID" and "string" in got[1]["error"] and "empty" in got[2]["error"] and not got[3]["ok"]


def test_ratings_reader(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("segment_id\ttext\tannotator_1\tannotator_2\tannotator_x\tagreed_rating\n7\ta\t3\t\t1\t4\nbad\tb\t1\t1\t1\t1\n8\tc\tx\t5\t1\t\n")
    got = sorted(tuple(r) for r in I.ratings_tsv(spark, str(tmp_path / "r.tsv")).collect())
    assert got == [(7, 0, 4), (7, 1, 3), (8, 2, 5)]


def test_export_readers(spark, tmp_path):
    (tmp_path / "nested.json").write_text('{"results": [{"id": 1, "annotations": [{"completed_by": 2, "lead_time": 1.5, "result": [{"from_name": "rating", "value": {"choices": ["4"]}}, {"from_name": "visual_action", "value": {"choices": [" True "]}}]}]}]}')
    (tmp_path / "flat.json").write_text('[{"id": 5, "annotator": 1, "annotation_id": 9, "rating": "3"}]')
    got = sorted((r["task"], r["annotator"], r["rating"], r["visual_action"]) for r in I.annotations(spark, str(tmp_path)).collect())
    assert got == [(1, 2, "4", [" True "]), (5, 1, "3", None)]
    (tmp_path / "none.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="no list of tasks"):
        I.annotations(spark, str(tmp_path)).collect()


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}')
    (tmp_path / "b.json").write_text('{"id": ')
    assert [r["id"] for r in I.json_files(spark, str(tmp_path), "id int").collect()] == [1]


def test_file_names(spark):
    names = ["svm_minilm_val_t3_42_2026-03-01-13-25-08", "svm_lg_test_41_2026-03-01-13-25-08", "notes"]
    got = column(spark, names, "string", I.metric_name)
    assert tuple(got[0]) == ("svm_minilm", "val", 3, 42, "2026-03-01-13-25-08", "svm_minilm_val_t3") and got[1]["common_key"] == "svm_lg_test" and got[2] is None


def test_whole_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿é".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("é".encode("latin-1"))
    assert [r["text"] for r in I.whole_texts(spark, str(tmp_path)).collect()] == ["é", "é"]


def test_merging_different_prompts_is_an_error(spark):
    model = "array<struct<model_name:string,outputs:array<string>>>"
    runs = spark.createDataFrame([("a", "p", 0, [("m", ["1"]), ("n", [])]), ("b", None, 40, [("o", ["2"])])], f"file string, prompt string, prompt_token_count int, models {model}")
    got = O.merged_runs(runs).first()
    assert (got["prompt"], got["prompt_token_count"], [m["model_name"] for m in got["models"]]) == ("p", 40, ["m", "o"])
    other = runs.unionByName(spark.createDataFrame([("c", "q", 1, [])], runs.schema))
    with pytest.raises(Exception, match="different prompts"):
        O.merged_runs(other).collect()
    assert O.merged_runs(other, unsafe=True).first()["prompt"] == "p"


