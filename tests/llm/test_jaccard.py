"""op5 against all pairs by brute force."""

import itertools
import random
import re

import pytest

from scriptorium.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width=4, percent=85):
    """``{doc_id: (size, least id)}`` with every pair tested."""
    sets = {i: shingle_set(t, width) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {i: (len(s), root(i)) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect() if r["doc_id"] is not None}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_documents_match_all_pairs(small, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert result(jaccard.linked(small, width, percent)) == brute(rows, width, percent)


def test_families_of_edited_copies(spark):
    """Chains, groups at the threshold, shared passages and more members than a tile holds."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    rows, i = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(5, 120))
        for _ in range(rng.randint(1, 12)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((i, " ".join(text)))
            base, i = (text if rng.random() < 0.5 else base), i + 1
    for _ in range(30):
        rows.append((i, " ".join(passage + rng.choices(vocabulary, k=40))))
        i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.linked(docs)) == brute(rows)


def test_more_members_than_a_tile(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_MEMBERS", 8)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(90):
        text = list(base)
        text[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.linked(docs)) == brute(rows)


def test_odd_rows(odd):
    rows = jaccard.linked(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert sum(r["doc_id"] is None and r["component_id"] is None for r in rows) == 2


def test_deduplicated_keeps_one(odd, empty):
    kept = jaccard.deduplicated(odd.withColumnRenamed("lang", "sig"))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "sig", "source", "n_chars"]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 8] and ids.count(None) == 2
    assert jaccard.deduplicated(empty).count() == 0 and jaccard.linked(empty).count() == 0


def test_deduplicated_by_text_and_not_by_id(spark):
    """Rows that share an id stay unless their own text is a copy; rows without an id take part."""
    rng = random.Random(7)
    text = lambda n=40: " ".join(f"w{k}" for k in rng.sample(range(5000), n))
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t: t + " more"
    rows = [(1, a), (9, near(a)), (9, b), (9, c), (None, d), (None, d), (None, near(d)), (None, near(b)), (None, e), (None, ""), (None, ""), (4, c), (7, ""), (7, "")]
    kept = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [(r["doc_id"], r["text"]) for r in kept]
    one = [x for x in got if x in ((None, d), (None, near(d)))]
    assert len(one) == 1
    assert sorted((x for x in got if x not in one), key=str) == sorted([(1, a), (9, b), (4, c), (None, e), (None, ""), (None, ""), (7, "")], key=str)
