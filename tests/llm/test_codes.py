"""op12 against plain loops over Python's integers, and its odd cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import codes
from scriptorium.llm.registry import ORACLE, QUERIES
from tests.comparing import connection, difference

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def by_force(rows, parts, entries, rounds):
    kept = sorted(((i, [math.floor(1024 * x) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[k * width : (k + 1) * width] for k in range(parts)] for _, v, _ in kept]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            held = {}
            for c in cut:
                held.setdefault(near(c[k], books[k])[1], []).append(c[k])
            for e, xs in held.items():
                books[k][e] = [sum(col) // len(xs) for col in zip(*xs)]
    out = []
    for (i, _, label), c in zip(kept, cut):
        found = [near(c[k], books[k]) for k in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    total = {l: sum(r[3] for r in out if r[1] == l) for l in {r[1] for r in out}}
    return sorted(str((*r, total[r[1]])) for r in out), ",".join(str(x) for b in books for e in b for x in e)


ODD = [
    (5, [0.5, -0.25, 1.0, 0.0, 2.0], 1), (5, [0.5, -0.25, 1.0, 0.0, 2.0], 1), (1, [0.1, 0.2, 0.3, 0.4, 0.5], None), (2, None, 1), (3, [], 1), (4, [0.1, None, 0.3, 0.4, 0.5], 2),
    (6, [0.1, float("nan"), 0.3, 0.4, 0.5], 2), (7, [0.1, float("inf"), 0.3, 0.4, 0.5], 2), (None, [0.0, 0.0, 0.0, 0.0, 0.0], None), (8, [1.0, 2.0], 3), (9, [200000.0, -200000.0, 0.0, 0.1, 0.0], 3), (9, [0.3, 0.3, 0.3, 0.3, 0.3], 3),
]


def check(table, parts, entries, rounds):
    out, books = codes.compressed(table, parts, entries, rounds)
    want, text = by_force([(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()], parts, entries, rounds)
    assert sorted(str(tuple(r)) for r in out.collect()) == want and codes.books_text(books) == text


@pytest.mark.parametrize("parts, entries, rounds", [(4, 3, 2), (1, 256, 1), (5, 2, 3)])
def test_odd_vectors_by_force(spark, parts, entries, rounds):
    check(spark.createDataFrame(ODD, VECTORS), parts, entries, rounds)


def test_supplied_vectors_by_force(spark):
    check(spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 150"), 4, 16, 3)


def test_copies_weigh_as_often(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [0.25, 0.5, 0.75, 1.0] if k % 3 else rng.normal(size=4).tolist(), k % 2) for k in range(600)]
    check(spark.createDataFrame(rows, VECTORS), 2, 8, 4)


def test_query_agrees_with_sql(spark):
    assert difference(QUERIES["op12_vector_codes"](spark, SF), connection(SF), ORACLE["op12_vector_codes"]) is None


def test_empty_tables_and_clashing_names(spark):
    empty = spark.createDataFrame([], VECTORS)
    out, books = codes.compressed(empty)
    assert out.count() == 0 and books.size == 0 and out.columns == ["vec_id", "label", "code", "error", "label_error"]
    table = spark.createDataFrame(ODD, VECTORS)
    wide = table.select("*", *[F.lit(k).alias(n) for k, n in enumerate(["row", "pos", "part", "p0", "error", "of"])])
    assert sorted(map(str, codes.compressed(wide)[0].collect())) == sorted(map(str, codes.compressed(table)[0].collect()))
