"""GEO1: places by sums and intervals against the cursor, and which documents need the cursor."""

import random

from pyspark.sql import functions as F

from scriptorium.operators import geometry as G
from scriptorium.plans import selecting as P

SF = "/root/testdata/sf0.001"
BOXES = "doc long, page int, ord int, block int, line int, x0 double, y0 double, x1 double, y1 double, word string"


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select([f.split(" ")[0] for f in G.PLACED.split(", ")]).collect())


def made(spark, cases):
    words, segs, texts, gone = [], [], [], []
    for doc, (ws, ss, full, removed) in cases.items():
        words += [(doc, k // 3, k, 0, k // 3, 10.0 * k, 0.0, 10.0 * k + 8, 5.0, w) for k, w in enumerate(ws)]
        segs += [(doc, k, s) for k, s in enumerate(ss)]
        texts += [(doc, G.plain("".join(ws)) if full is None else full)]
        gone += [(doc, a, b) for a, b in removed]
    return [spark.createDataFrame(r, s) for r, s in ((words, BOXES), (segs, "doc long, seg long, text string"), (texts, "doc long, full string"), (gone, "doc long, start long, stop long"))]


CASES = {
    1: (["one", "two", "three", "four"], ["onetwo", "threefour"], None, []),
    2: (["on-", "e", "twothree", "—", "four"], ["one two", "three four"], None, []),  # a word over two segments, one that is nothing
    3: (["head", "one", "two", "foot"], ["one two"], None, [(0, 4), (10, 14)]),  # removed ranges
    4: (["one", "XX", "two"], ["one", "two"], "onetwo", []),  # a word that the text doesn't have
    5: (["one", "two"], ["one", "", "two"], None, []),  # an empty segment
    6: (["abcdef"], ["ab", "cd", "ef"], None, []),  # a word over three segments
    7: (["one", "twothree"], ["onetwo"], None, []),  # a word beyond the last segment
    8: (["one", "two"], ["one", "twothreefour"], None, []),  # words that end early
    9: (["one"], [], None, []), 10: ([], ["one"], "one", []), 11: (["one", "two", "three"], ["one two"], None, [(3, 3)]),
}


def test_sums_give_what_the_cursor_gives(spark):
    parts = made(spark, CASES)
    assert rows(G.aligned(*parts)) == rows(G.by_cursor(*parts))


def test_only_odd_documents_go_through_the_cursor(spark, monkeypatch):
    seen, cursor = [], G.by_cursor
    monkeypatch.setattr(G, "by_cursor", lambda words, *rest: seen.append({r["doc"] for r in words.select("doc").distinct().collect()}) or cursor(words, *rest))
    G.aligned(*made(spark, CASES)).count()
    assert seen == [{4, 5, 6, 7}]


def test_random_documents(spark):
    rng, cases = random.Random(9), {}
    for doc in range(30):
        ws = ["".join(rng.choice("abc'-é") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 40))]
        full = G.plain("".join(ws))
        removed = sorted((a, a + rng.randrange(0, 8)) for a in (rng.randrange(len(full)) for _ in range(rng.randrange(0, 3)))) if full else []
        at, left = 0, ""
        for w in map(G.plain, ws):
            if w and not any(x < at + len(w) and at < y for x, y in removed):
                left += w
            at += len(w)
        ends = sorted({0, len(left), *(rng.randrange(len(left) + 1) for _ in range(rng.randrange(0, 6)))})
        segs = [left[a:b] for a, b in zip(ends, ends[1:])]
        if doc % 7 == 0 and segs:
            segs[rng.randrange(len(segs))] += "z"
        cases[doc] = (ws, segs, None, removed)
    parts = made(spark, cases)
    assert rows(G.aligned(*parts)) == rows(G.by_cursor(*parts))


def test_whole_table(spark):
    parts = P._page(spark, SF)
    assert rows(G.aligned(*parts)) == rows(G.by_cursor(*parts))
    assert rows(G.aligned(*[x.filter(F.lit(False)) for x in parts])) == []
