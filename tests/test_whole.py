"""Queries and operators that have to cover every row, on small cases worked out by hand or by force."""

import __spark_entry__

SF = "/root/testdata/sf0.001"


def folded_ngrams(text):
    t = text.lower().replace("ß", "ss")
    return [t[i : i + n] for n in range(2, 6) for i in range(len(t) - n + 1)]


def test_ngrams_of_long_texts_are_counted(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r["doc_id"]: (r["n"], r["kinds"]) for r in __spark_entry__.queries()["fea2b_all_char_ngrams"](spark, SF).collect()}
    want = {i: folded_ngrams(t) for i, t in texts.items()}
    assert found == {i: (len(g), len(set(g))) for i, g in want.items() if g}
    assert any(len(texts[i]) > 400 for i in found)


def test_label_swap_returns_both_splits(spark):
    from scriptorium.operators import relational as R

    rows = [(1, 0, True, True), (2, 0, True, True), (3, 0, False, False), (4, 0, False, True), (5, 1, True, True), (6, 1, False, False), (7, 1, False, False), (8, None, True, False), (9, 2, True, True)]
    out = R.label_swap(spark.createDataFrame(rows, "doc_id long, y int, test boolean, flagged boolean"), "y", "doc_id").collect()
    part = {r["doc_id"]: r["part"] for r in out}
    one, other = sorted([part.get(1), part.get(2)], key=str)
    assert (one, other) == (None, "train")  # one of two swapped, the other dropped
    assert part[3] == "test" and part[4] == "train" and part[5] == "train" and part[8] == "test" and 9 not in part
    assert sorted([part[6], part[7]]) == ["test", "train"]


def test_label_swap_query_reads_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"] for r in __spark_entry__.queries()["smp6_label_swap"](spark, SF).collect()}
    missing = docs.filter(~docs["doc_id"].isin(list(got))).select("source", "lang").collect()
    assert all(r["source"] in ("src0", "src1", "src2") and r["lang"] != "en" for r in missing)


def test_wide_has_every_annotator(spark):
    from scriptorium.operators import ratings as A

    rows = [(t, a, a % 6) for t in (1, 2) for a in range(1, 1104) if t == 1 or a > 1100]
    got = {r["task"]: r.asDict() for r in A.wide(spark.createDataFrame(rows, "task long, annotator int, rating int")).collect()}
    assert len(got[1]) == 1104 and all(got[1][f"annotator_{a}"] == a % 6 for a in range(1, 1104))
    assert [k for k, v in got[2].items() if v is not None] == ["task", "annotator_1101", "annotator_1102", "annotator_1103"]


def test_trees_deeper_than_63_levels(spark):
    from scriptorium.operators import features as X

    edges = [(1, n, n - 1 if n > 1 else None) for n in range(1, 71)] + [(2, 1, None), (2, 2, 1), (2, 3, 1)]
    got = {r["tree"]: (r["depth"], r["width"], r["branching"]) for r in X.tree_shape(spark.createDataFrame(edges, "tree int, node int, head int")).collect()}
    assert got == {1: (70, 1, 1), 2: (2, 2, 2)}
