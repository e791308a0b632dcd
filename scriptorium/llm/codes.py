"""Product codes of vectors over integers: weighted Lloyd on the distinct parts.

Components become integers, and a vector is cut into parts. At each position equal parts are one
row with a weight; rounds of Lloyd's algorithm read these rows alone, a task adding up what each
entry of the codebook gets, so that a round shuffles a row per task and entry. In the end codes and
errors are joined back to the vectors by position and part. All sums and distances are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cleared, frugal, small_side, written
from .vectors import first_rows, matrix

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers up to which squared distances fit a long; components beyond are an error.
MOST = 1 << 28
#: Sums of products up to here are exact in doubles.
EXACT = 1 << 53
BLOCK = 4096  # rows whose distances to a codebook are held at a time


def integers(found: np.ndarray, parts: int) -> np.ndarray:
    """``rows x parts x width`` integers; vectors that don't divide evenly are filled up with zeros."""
    scaled = np.floor(found * SCALE)
    if scaled.size and np.abs(scaled).max() >= MOST:
        raise ValueError(f"components have to lie within {MOST // SCALE} of 0")
    width = -(-found.shape[1] // parts)
    out = np.zeros((len(found), parts * width), np.int64)
    out[:, : found.shape[1]] = scaled
    return out.reshape(len(found), parts, width)


def packed(part: np.ndarray) -> list[bytes]:
    """Each row as bytes, two for a number where all of the row's fit; equal rows, equal bytes."""
    short = (np.abs(part) < 1 << 15).all(axis=1)
    two, four = part.astype("<i2"), part.astype("<i4")
    return [(a if s else b).tobytes() for s, a, b in zip(short, two, four)]


def unpacked(parts: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(parts), width), np.int64)
    for k, b in enumerate(parts):
        out[k] = np.frombuffer(b, "<i2" if len(b) == 2 * width else "<i4")
    return out


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest of several, and the squared distance."""
    code, error = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for at in range(0, len(rows), BLOCK):
        part = rows[at : at + BLOCK]
        most = int(max(np.abs(part).max(initial=0), np.abs(book).max(initial=0)))
        if rows.shape[1] * (2 * most) ** 2 < EXACT:
            a, b = part.astype(float), book.astype(float)
            far = (b * b).sum(axis=1) - 2 * (a @ b.T) + (a * a).sum(axis=1)[:, None]
        else:
            far = np.stack([((part - entry) ** 2).sum(axis=1) for entry in book], axis=1)
        code[at : at + BLOCK] = far.argmin(axis=1)
        error[at : at + BLOCK] = far.min(axis=1)
    return code, error


def cut_up(table: DataFrame, dim: int, parts: int) -> DataFrame:
    """``row, vec_id, label, p0, p1, ...`` of each sound vector, as a table."""
    bounded_batches(table.sparkSession)
    names = ["row", "vec_id", "label", *(f"p{k}" for k in range(parts))]
    source = table.select(F.col("vec_id").cast("long"), "label", "embedding")

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            at, found = matrix(batch.column(2), dim)
            ints, took = integers(found, parts), pa.array(at)
            cols = [pa.array(packed(ints[:, k]), pa.binary()) for k in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(at)), pa.int64()), batch.column(0).take(took), batch.column(1).take(took), *cols], names)
            row += len(at)

    label = source.schema["label"].dataType.simpleString()
    return written(source.mapInArrow(frugal(run), f"row long, vec_id long, label {label}" + "".join(f", p{k} binary" for k in range(parts))), "vector-parts")


def by_position(cut: DataFrame, parts: int, *keep: str) -> DataFrame:
    """A row for each vector and position: ``pos, part`` and the columns of ``keep``."""
    return cut.select(*keep, F.posexplode(F.array(*[f"p{k}" for k in range(parts)])).alias("pos", "part"))


def updated(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round. ``distinct`` has ``pos, part, n``."""
    width = books.shape[2]
    shared = distinct.sparkSession.sparkContext.broadcast(books)  # parts x entries x width

    def run(batches):
        books = shared.value
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            pos, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            rows = unpacked(batch.column(1).to_pylist(), width)
            for k in np.unique(pos):
                own = np.flatnonzero(pos == k)
                code, _ = nearest(rows[own], books[k])
                np.add.at(counts[k], code, n[own])
                np.add.at(sums[k], code, rows[own] * n[own][:, None])
        k, e = np.nonzero(counts)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1) * width, pa.int32()), pa.array(sums[k, e].reshape(-1), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[k, e], pa.int64()), flat], ["pos", "entry", "n", "sums"])

    each = distinct.mapInArrow(frugal(run), "pos int, entry int, n long, sums array<long>")
    total = each.groupBy("pos", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = books.copy()  # unused entries stay
    for r in total.collect():  # a row per entry of the codebooks
        out[r["pos"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return out


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """``pos, part, code, error``: each distinct part with its nearest entry."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = shared.value
        for batch in batches:
            pos, rows = batch.column(0).to_numpy(), unpacked(batch.column(1).to_pylist(), books.shape[2])
            code, error = np.empty(len(pos), np.int64), np.empty(len(pos), np.int64)
            for k in np.unique(pos):
                own = np.flatnonzero(pos == k)
                code[own], error[own] = nearest(rows[own], books[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.int32()), pa.array(error, pa.int64())], ["pos", "part", "code", "error"])

    return distinct.select("pos", "part").mapInArrow(frugal(run), "pos int, part binary, code int, error long")


def compressed(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error, label_error`` for each sound vector of ``vec_id, embedding, label``,
    and the codebooks (``parts x entries x width``; ``entries`` is at most 256, two hex digits).

    Rows whose vector is null or holds null or non-finite components are dropped, as are vectors of
    another length than that of the least kept ``vec_id``, and empty ones. Rows that repeat are each
    returned and weigh as often; null ids are kept and come last, of repeated ids the lesser vector
    comes first. Null labels are one label. A table without sound vectors gives no rows. Other columns
    are ignored. Lengths that ``parts`` doesn't divide are filled up with zeros.
    """
    spark = table.sparkSession
    first = first_rows(table, 1)
    dim = len(first[0]) if first else 0
    start = first_rows(table, entries, dim) if first else []
    if not start:
        label = table.schema["label"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long, label_error long"), np.zeros((parts, 0, 0), np.int64)
    books = np.ascontiguousarray(integers(np.array(start), parts).transpose(1, 0, 2))
    with cleared(spark) as made:
        cut = cut_up(table, dim, parts)
        distinct = written(by_position(cut, parts).groupBy("pos", "part").agg(F.count("*").alias("n")), "distinct-parts")
        for _ in range(rounds):
            books = updated(distinct, books)
        back = by_position(cut, parts, "row", "vec_id", "label").join(coded(distinct, books), ["pos", "part"])
        digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == k, F.col("code"))))), 2, "0") for k in range(parts)]
        rows = written(back.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.concat(*digits).alias("code"), F.sum("error").alias("error")).drop("row"), "vector-codes")
        sums = written(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
        del made[-2:]  # codes and sums stay: the rows that are returned read them
    out = rows.join(small_side(sums), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "label", "code", "error", "label_error"), books


def books_text(books: np.ndarray) -> str:
    """All entries' numbers by part, entry and position, joined by commas."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, with the digest of the codebooks they were made by."""
    out, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, width: int = 16) -> str:
    """The same rounds, one after the other, over all pairs of a part and an entry."""
    near = """a{k} AS MATERIALIZED (
  SELECT v, p, (min({{'d': d, 'e': e}})).e AS e, min(d) AS d FROM (
    SELECT c.v, c.p, b.e, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comp c JOIN b{k} b ON c.p = b.p AND c.j = b.j GROUP BY c.v, c.p, b.e) GROUP BY v, p)"""
    step = """b{n} AS MATERIALIZED (
  SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT c.p, a.e, c.j, CAST(floor(sum(c.x)::DOUBLE / count(*)) AS BIGINT) AS x FROM comp c JOIN a{k} a ON c.v = a.v AND c.p = a.p GROUP BY c.p, a.e, c.j) m
  ON b.p = m.p AND b.e = m.e AND b.j = m.j)"""
    rounds = ",\n".join(x.format(k=k, n=k + 1) for k in range(ROUNDS) for x in (near, step))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id ASC NULLS LAST, embedding) - 1 AS v, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS MATERIALIZED (
  SELECT v, (i - 1) // {width} AS p, (i - 1) % {width} AS j, CAST(floor(1024 * embedding[i]::DOUBLE) AS BIGINT) AS x FROM kept, range(1, {parts * width + 1}) r(i)),
b0 AS MATERIALIZED (SELECT p, v AS e, j, x FROM comp WHERE v < {ENTRIES}),
{rounds},
{near.format(k=ROUNDS)},
done AS (
  SELECT v, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY v),
book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM done JOIN kept USING (v), book
"""


ORACLE = {"op12_vector_codes": _sql()}
