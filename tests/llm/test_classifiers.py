"""op2 and op3: accuracy on the held-out fold, and odd rows."""

import zlib

from scriptorium.llm import langid, toxicity
from scriptorium.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_languages_of_the_held_out_fold(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_langid"](spark, SF).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    fold = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in fold) >= 0.97 * len(fold)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_codewords_differ_and_no_bit_is_constant():
    import numpy as np

    for n in (2, 4, 30):
        code = langid.codewords(n, np.random.default_rng(0))
        assert len({tuple(c) for c in code}) == n and (abs(code.sum(axis=0)) < n).all()


def test_language_of_odd_rows(odd, empty):
    model = langid.fit(["the cat and the dog", "le chat et le chien"] * 5, ["en", "fr"] * 5)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (1, 2, 3))
    assert langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit([], [])).collect()} == {"und"}
    assert langid.training_rows(empty) == ([], [])


def test_toxicity_of_the_held_out_fold(spark):
    """About a sixth of the rows marked toxic hold none of the words of the others."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, sf).collect()
    fold = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = ([r for r in fold if labels[r["doc_id"]] == y] for y in (1, 0))
    assert sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"]) for r in rows)


def test_a_word_said_again_and_again_counts_once():
    raw, _ = toxicity.cleaned(["Ha ha ha good ha"])
    assert raw.tobytes().split() == [b"ha", b"good", b"ha"]


def test_misspellings_share_ngrams():
    bad, good = ["you are a horrible idiot", "such an idiot indeed you are"] * 10, ["you are a lovely person", "what a nice day it is indeed"] * 10
    model = toxicity.fit(bad + good, [1] * 20 + [0] * 20)
    z = toxicity.log_odds(model, ["you are an idiiot", "you are a person"])
    assert z[0] > z[1]


def test_toxicity_of_odd_rows(spark, odd, empty):
    model = toxicity.fit(["bad bad words"] * 5 + ["good fine words"] * 5, [1] * 5 + [0] * 5)
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count() and len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.scored(empty, model).count() == 0 and toxicity.accepted(empty, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(*toxicity.training_rows(odd, labels)).bias < 0
    assert toxicity.accepted(odd, toxicity.fit([], [])).columns == odd.columns
    # A long text is scored by its worst window, wherever that stands.
    assert toxicity.log_odds(model, ["good fine words " * 500 + "bad bad words bad bad words bad bad"])[0] > 0 > toxicity.log_odds(model, ["good fine words " * 500])[0]
