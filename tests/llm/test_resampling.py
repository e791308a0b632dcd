"""op11 against a plain version, and its odd cases."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import resampling
from scriptorium.llm.registry import ORACLE, QUERIES
from tests.comparing import connection, difference

SF = "/root/testdata/sf0.001"


def features(text, longest=1):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def by_force(docs, target, percent, least_words, buckets, longest, seed=2024):
    docs = [(i, *features(t, longest)) for i, t in docs]
    corpus, goal = [0] * buckets, [0] * buckets
    for _, _, found in docs:
        for f in found:
            corpus[f % buckets] += 1
    for t in target:
        for f in features(t, longest)[1]:
            goal[f % buckets] += 1
    s, t = sum(corpus), sum(goal)
    gain = [math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(corpus, goal)]
    rows = []
    for i, words, found in docs:
        weight = sum(gain[f % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    take = percent * len(fit) // 100
    ranked = [(i, n, w, s, k + 1 if k < take else None) for k, (i, _, n, w, s) in enumerate(fit)]
    return sorted(map(str, ranked + [(i, n, w, s, None) for i, words, n, w, s in rows if words < least_words]))


@pytest.mark.parametrize("table, longest, least_words, percent", [("small", 1, 20, 10), ("small", 3, 5, 37), ("odd", 2, 0, 60), ("odd", 1, 2, 100)])
def test_draw_by_force(spark, request, monkeypatch, table, longest, least_words, percent):
    monkeypatch.setattr(resampling, "BLOCK", 700)  # texts in several portions
    docs, goal = request.getfixturevalue(table), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resampling.resampled(docs, goal, percent, least_words, 500, longest).collect()
    want = by_force([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in goal.collect()], percent, least_words, 500, longest)
    assert sorted(str(tuple(r)) for r in got) == want


def test_query_agrees_with_sql(spark):
    assert difference(QUERIES["op11_resampling"](spark, SF), connection(SF), ORACLE["op11_resampling"]) is None


def test_ties_empty_tables_and_clashing_names(spark, odd, empty):
    same = spark.createDataFrame([(7, "alpha beta gamma")] * 300 + [(k, "alpha beta gamma") for k in range(100)], "doc_id long, text string")
    ranks = sorted(r["rank"] for r in resampling.resampled(same, same, 50, 1).collect() if r["rank"])
    assert ranks == list(range(1, 201))
    assert resampling.resampled(empty, odd).count() == 0
    assert resampling.resampled(odd, empty, least_words=0).count() == odd.count()
    wide = odd.select("doc_id", "text", *[F.lit("x").alias(n) for n in ("score", "rank", "weight", "n_words", "at", "row_", "tie_")])
    assert sorted(map(str, resampling.resampled(wide, odd, 50, 0).collect())) == sorted(map(str, resampling.resampled(odd, odd, 50, 0).collect()))
