"""Stages and shared helpers on odd, empty and clashing tables, and in several threads."""

import threading
from collections import Counter
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from scriptorium.llm import common, mixing, pii

SF = "/root/testdata/sf0.001"


def exists(path):
    return Path(path.removeprefix("file:").replace("///", "/")).exists()


def test_the_mix_takes_what_the_plan_says(odd, empty, small):
    for docs in (odd, small):
        want = Counter()
        for r in mixing.planned(docs).collect():
            want[r["doc_id"]] += r["copies"]
        got = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
        assert +want == got
    assert mixing.mixed(empty).count() == 0 and mixing.mixed(empty).columns == empty.columns


def test_columns_of_any_name_come_back(odd):
    names = ["of", "rate", "n", "copy", "doc", "__of", "__rate", "__n", "__copy", "size", "target", "doc.id"]
    wide = odd.select("*", *[F.lit(70 + k).alias(n) for k, n in enumerate(names)])
    out = mixing.mixed(wide)
    assert out.columns == wide.columns
    assert all(list(r)[5:] == [70 + k for k in range(len(names))] for r in out.collect())
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in mixing.mixed(odd).collect())


def test_every_stage_on_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            if name != "pieces":
                assert out.columns == docs.columns
            if docs is empty:
                assert rows == []
            elif name in ("personal_data", "pieces"):
                assert len(rows) == odd.count()
            elif name in ("toxicity", "near_duplicates"):
                assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in odd.collect()} and rows


def test_scopes_of_two_threads_are_their_own(spark):
    """A table that one thread makes outlives the scope of another."""
    inside, leave, made = threading.Event(), threading.Event(), {}

    def other():
        with common.cleared(spark):
            made["other"] = common.written(spark.range(3), "other").inputFiles()[0]
            inside.set()
            leave.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    mine = common.written(spark.range(5), "mine")
    leave.set()
    thread.join(60)
    assert mine.count() == 5 and not exists(made["other"])


def test_masks_by_lookup_and_by_join(spark):
    """Few discovered instances travel with the tasks, more are joined; the texts are the same."""
    seeds = [(i, f"some words {i} please call me at +1 555 {1000000 + 7919 * i} soon") for i in range(60)]
    new = [(100, "then call me at 555-123-4567 today"), (101, "then call me at (017) 555-7713 today"), (101, None)]
    docs = spark.createDataFrame([*seeds, *new], "doc_id long, text string")
    looked_up, joined = (sorted(map(str, pii.masked(docs, most=n).collect())) for n in (1000, 1))
    assert looked_up == joined and any("<phone> today" in x for x in joined)


def test_rounds_that_alternate_end(spark):
    """However many rounds are allowed, discovery gives a result."""
    docs = spark.createDataFrame([(i, f"call me at +1 555 {1000000 + 7919 * i} soon, id {i}-{i}-77777") for i in range(40)], "doc_id long, text string")
    table = pii.found(docs)
    for rounds in (1, 2, 40):
        pii.discovered(table, rounds=rounds)
