"""Ranks, intervals, trees and feature vectors against plain loops, with keys that hold a third of all rows or more."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import annotations as A
from scriptorium.operators import features as X
from scriptorium.operators import vectors as V
from scriptorium.operators.intervals import overlapping
from scriptorium.operators.ranks import cumulative_share, numbered, running_sum


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, one value for many of them, nulls in key and value."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), None if i % 17 == 0 else rng.choice([1, 1, 2, 5, 9])) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, k string, v int").repartition(8)


def last(v):
    return (v is None, v or 0)


def test_numbers_in_huge_groups(skewed):
    rows, df = skewed
    got = {r["id"]: r["n"] for r in numbered(df, ["k"], ["-v", "id"], "n").collect()}
    want = {}
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        want |= {r[0]: n for n, r in enumerate(mine, 1)}
    assert got == want


def test_a_key_fills_several_partitions(spark, skewed):
    """No window task holds the hot key: its rows lie in as many partitions as the range partitioning makes."""
    _, df = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = df.repartitionByRange("k", "v", "id").withColumn("p", F.spark_partition_id()).filter("k = 'hot'")
        assert placed.select("p").distinct().count() > 2
        assert sorted(r["n"] for r in numbered(df.filter("k = 'hot'"), ["k"], ["v"], "n").collect()) == list(range(1, 1001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_and_shares(spark, skewed):
    rows, df = skewed
    sums = {r["id"]: r["s"] for r in running_sum(df, [], ["id"], "v", "s").collect()}
    total = 0
    for i, _, v in rows:
        total += v or 0
        assert sums[i] == total
    shares = {r["id"]: r["s"] for r in cumulative_share(df, ["k"], "v", "s").collect()}
    for key in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == key]
        for r in random.Random(1).sample(mine, 20):
            assert shares[r[0]] == pytest.approx(sum(last(x[2]) <= last(r[2]) for x in mine) / len(mine))
    empty = spark.createDataFrame([], "id long, k string, v int")
    assert numbered(empty, ["k"], ["v"], "n").count() == 0 and cumulative_share(empty, ["k"], "v", "s").count() == 0


def test_overlaps_of_intervals(spark):
    rng = random.Random(7)
    lengths = [0, 1, 2, 5, 30, 400, 5000]

    def some(n, names):
        rows = [(i, "hot" if i % 3 else rng.choice(["a", None]), rng.randrange(-3000, 9000)) for i in range(n)]
        rows = [(i, k, a, a + rng.choice(lengths)) for i, k, a in rows] + [(n, "hot", 5, 1), (n + 1, "hot", None, 4), (n + 2, "hot", 4, None)]
        return rows, spark.createDataFrame(rows, names)

    left, a = some(300, "id long, user string, i long, j long")
    right, b = some(250, "id long, user string, bucket long, left long")
    got = sorted((r["l"], r["r"]) for r in overlapping(a, b, ["user"], ("i", "j"), ("bucket", "left")).select(F.col("left.id").alias("l"), F.col("right.id").alias("r")).collect())
    good = lambda r: r[1] is not None and r[2] is not None and r[3] is not None and r[3] >= r[2]
    want = sorted((x[0], y[0]) for x in left for y in right if good(x) and good(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert got == want and len(want) > 1000


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    rounds, cut = [], X.cut
    monkeypatch.setattr(X, "cut", lambda df: rounds.append(1) or cut(df))
    chain = spark.range(1, 10_001).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("head"))
    star = spark.range(1, 3001).select(F.lit(2).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.lit(1)).alias("head"))
    lost = spark.createDataFrame([(3, 1, None), (3, 2, 1), (3, 8, 99)], "tree int, node long, head long")
    got = {r["tree"]: (r["depth"], r["width"], r["branching"]) for r in X.tree_shape(chain.unionByName(star).unionByName(lost)).collect()}
    assert got == {1: (10_000, 1, 1), 2: (2, 2999, 2999), 3: (2, 1, 1)} and len(rounds) <= 16
    with pytest.raises(ValueError):
        X.tree_shape(spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "tree int, node long, head long"))


def test_ngrams_in_numpy_and_by_join(spark):
    texts = [(1, "Straße straße"), (2, ""), (3, None), (4, "a"), (5, "abab\0abab"), (5, "ba"), (6, "日本語日本語🙂x"), (7, "x" * 3000 + "ab")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    grams = spark.createDataFrame([(g,) for g in ("ss", "ab", "ba", "aba", "日本", "語日本語", "🙂x", "xxxxx", "toolong", "z", "st", "\0a", "bb")], "gram string")
    want = {}
    for i in {t[0] for t in texts}:
        every = [t[k : k + n] for d, raw in texts if d == i and raw for t in [raw.lower().replace("ß", "ss")] for n in range(2, 6) for k in range(len(t) - n + 1)]
        for (g,) in grams.collect():
            if 2 <= len(g) <= 5 and every.count(g):
                want[(i, g)] = every.count(g) / len(every)
    for most in (100, 3):  # few, and too many to travel with the tasks
        got = {(r["doc_id"], r["gram"]): r["share"] for r in A.char_ngram_shares(docs, grams, most=most).collect()}
        assert got == pytest.approx(want)


def test_vector_layout(spark):
    assert V.SIZE == 3671 and len(V.LAYOUT) == 28 and V.OFFSET["char_ngrams"] == 1 and V.OFFSET["tree_ngrams"] == 2238 and V.OFFSET["places"] == 3670
    rows = [(1, "quote_ratio", 0, 0.5), (1, "char_ngrams", 0, 0.25), (1, "char_ngrams", 999, 0.125), (1, "tense", 3, 1.0), (1, "places", 0, 2.0), (2, "articles", 1, 0.0), (3, "tense", 0, None)]
    long = spark.createDataFrame(rows, "doc_id long, extractor string, index int, value double")
    docs = spark.createDataFrame([(1,), (2,), (2,), (3,)], "doc_id long")
    out = V.assembled(docs, V.placed(long))
    got = {r["doc_id"]: (r["size"], r["indices"], r["values"], r["d"], r["t"], r["w"]) for r in out.select("*", V.dense().alias("d")).select("*", V.part("d", "tense").alias("t"), V.without("d", ["char_ngrams", "places"]).alias("w")).collect()}
    assert got[1][:3] == (3671, [0, 1, 1000, 3622, 3670], [0.5, 0.25, 0.125, 1.0, 2.0])
    want = [0.0] * 3671
    for k, v in zip(*got[1][1:3]):
        want[k] = v
    assert got[1][3] == want and got[1][4] == want[3619:3623] and got[1][5] == want[:1] + want[1001:3670]
    assert got[2][1:3] == ([], []) and got[3][3] == [0.0] * 3671
    back = {(r["extractor"], r["index"], r["value"]) for r in V.rows_of(out).collect()}
    assert back == {(e, k, v) for d, e, k, v in rows if v}
    for bad in ((1, "tense", 4, 1.0), (1, "tense", -1, 1.0), (1, "unknown", 0, 1.0)):
        with pytest.raises(Exception, match="no place for"):
            V.placed(spark.createDataFrame([bad], long.schema)).collect()
    with pytest.raises(Exception, match="two values"):
        V.assembled(docs, V.placed(long.unionAll(long))).collect()
