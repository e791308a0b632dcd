"""op7 against fingerprints worked out in Python, with all documents' terms in sets."""

import hashlib
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import imatch

BREAK = regex.compile(r"[^\p{L}\p{N}]+")


def terms(text):
    return {t for t in BREAK.split(text.lower()) if t}


def subsets(term):
    """The subsets that hold a term: Spark's xxhash64 of the term's hash and the subset's number."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    first = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)
    return {k for k, d in enumerate(imatch.DEPTHS) if xxhash.xxh64_intdigest(k.to_bytes(4, "little"), first) % (1 << d) == 0}


def by_force(rows):
    """``doc_id, n_chars, edited_sha256, near_edited, near_next`` and the terms by subset of each row."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    df = Counter(t for _, text in rows for t in terms(text))
    band = {t for t, n in df.items() if imatch.LEAST * len(rows) <= n <= max(imatch.MOST * len(rows), 2)}
    inside = {t: subsets(t) for t in band}

    def marks(text):
        found = terms(text) & band
        return [frozenset(t for t in found if k in inside[t]) for k in range(len(imatch.DEPTHS))]

    def likeness(a, b, text_a, text_b):
        pairs = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else float(text_a == text_b)

    made, keys = [], []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, other, following = marks(text), marks(edited), marks(after)
        made.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(own, other, text, edited), 9), round(likeness(own, following, text, after), 9)))
        keys.append(((i, len(text)), tuple(own) if any(own) else text))
    return made, keys


@pytest.mark.parametrize("table", ["small", "odd"])
def test_fingerprints_by_force(request, table):
    docs = request.getfixturevalue(table)
    made, keys = by_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = imatch.fingerprints(docs).collect()
    assert sorted(map(str, made)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))) for r in got)
    same = Counter(Counter(k for _, k in keys).values())
    assert same == Counter(Counter(r["fingerprint"] for r in got).values())


def test_every_term_of_the_band_counts(spark):
    """Texts that differ in one term of the band have different fingerprints, whatever the term."""
    rows = [(k, f"shared words term{k // 2}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs).collect()}
    assert len(set(got.values())) == 100 and all(got[k] == got[k + 1] for k in range(0, 200, 2))


def test_empty_and_clashing_columns(odd, empty):
    assert imatch.fingerprints(empty).count() == 0
    names = ["range", "late", "pos", "row"]
    wide = odd.select("doc_id", "text", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    plain = sorted(map(str, imatch.fingerprints(odd).collect()))
    assert sorted(map(str, imatch.fingerprints(wide).collect())) == plain
