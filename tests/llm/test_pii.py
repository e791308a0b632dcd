"""op1: base spans against the patterns as stated, discovery, masks and odd rows."""

import hashlib
import re

from pyspark.sql import functions as F

from scriptorium.llm import pii
from scriptorium.llm.registry import QUERIES

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(out))


TRICKY = [
    "a@b.c@d.e", "@x.y x@ y@z. q@w-.e", "a.b@c.d.e-f.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567, +49..12 3456 7890 1", "++12345678901+12345678901",
    "12345678901234567890123456789012345678901234567890", "٣١٢٣.1.1.1 é@b.co", "a%b+c@d-e.f--g.", "0000.0.0.1 001.2.3.4", "1 2-3 4111111111111111",
]


def test_base_spans_match_the_patterns(small):
    for text in [*TRICKY, *(r["text"] for r in small.collect())]:
        assert pii.joined(pii.base_spans(text)) == brute(text), text[:100]


def test_query_covers_every_document(spark):
    rows = QUERIES["op1_pii"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [base.count(f"{k}:") for k in pii.KINDS]


def test_context_finds_identifiers_of_another_form(spark):
    """Phones without a plus stand behind the words that seeds stand behind."""
    seeds = [(i, f"some words {i} please call me at +1 555 {1000000 + 7919 * i} soon") for i in range(60)]
    docs = spark.createDataFrame([*seeds, (100, "whatever, call me at +1 555 77 x"), (101, "please call me at a@b.example soon"), (102, "plain words only")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.with_spans(docs).select("doc_id", pii.span_text("all").alias("spans"), "n_phone").collect()}
    assert all(rows[i]["spans"].startswith("phone:") for i in range(60)) and rows[102]["spans"] == ""


def test_new_shapes_behind_learned_words_are_found(spark):
    """No base phone can have these shapes; the words before them are those of base phones."""
    seeds = [(i, f"some words {i} please call me at +1 555 {1000000 + 7919 * i} soon") for i in range(60)]
    other = [(200 + i, f"see order number {i:03d}-{777 - i}-{4000 + i} for it") for i in range(5)] + [(300 + i, f"it weighs about {100000 + 37 * i} grams") for i in range(60)]
    new = [(100, "then call me at 555-123-4567 today"), (101, "then call me at (017) 555-7713 today"), (102, "then order number 555-123-9999 today"), (103, "please call me at a@b soon")]
    docs = spark.createDataFrame([*seeds, *other, *new], "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in pii.with_spans(docs).select("doc_id", pii.span_text("all").alias("spans")).collect()}
    assert rows[100] == "phone:16:28" and rows[101] == "phone:16:30"
    assert all(rows[i] == "" for i in [102, 103, *(i for i, _ in other)])
    assert {r["text"] for r in pii.masked(docs).filter("doc_id IN (100, 102)").collect()} == {"then call me at <phone> today", new[2][1]}


def test_masks(spark, odd, empty):
    docs = spark.createDataFrame([(1, "mail a.b@c.org now", "x")], "doc_id long, text string, kind string")
    assert pii.masked(docs).collect() == [(1, "mail <email> now", "x")]
    out = pii.masked(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.filter(F.col("doc_id") == 8).first()["text"] == "mail <email> or <ip> now"
    assert out.filter("doc_id = 8").first()["n_chars"] == len("mail <email> or <ip> now")
    assert pii.masked(empty).count() == 0
    assert pii.with_spans(odd).count() == odd.count() and pii.with_spans(empty).count() == 0
