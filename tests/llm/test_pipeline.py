"""The stages of the corpus pipeline against brute-force versions, on a small table."""

import re

import corpus_pipeline
from scriptorium.llm import lattice, pii, toxicity

SF = "/root/testdata/sf0.001"


def shingle_set(text, width=5):
    words = re.findall(r"[^ \t\n\r\x0b\x0c]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def test_near_duplicates_by_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i in sets if find(i) == i} and len(kept) < len(sets)


def test_every_stage_works_on_all_that_came(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(*toxicity.training_rows(docs, labels))
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    odds = toxicity.log_odds(model, [r["text"] for r in before])
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r, z in zip(before, odds) if z < 0}
    assert kept.columns == docs.columns

    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.mask_personal_data(spark, docs, SF).collect()}
    for r in before:
        text, want, at = r["text"], [], 0
        for a, k, b in pii.base_spans(text):
            if b > at:
                want += [text[at:a], f"<{pii.KINDS[k]}>"]
                at = b
        assert masked[r["doc_id"]] == "".join([*want, text[at:]])

    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(times) <= {r["doc_id"] for r in before} and max(times.values()) <= 2 and mixed.columns == docs.columns

    v = lattice.vocabulary()
    pieces = lattice.decoded(corpus_pipeline.encode_pieces(spark, docs, SF), v)
    assert {r["doc_id"]: r["text"] for r in pieces.collect()} == {r["doc_id"]: r["text"] for r in before}


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r["ids"] is not None for r in rows)
