"""Resampling towards a target distribution by importance weights.

Words are hashed into buckets and counted in the corpus and in the target texts. A bucket's gain is
the logarithm of the ratio of the two shares; a document's weight is the mean gain of its features,
looked up in an array. Noise from a hash of the id is added, so that the highest scores are a draw
without replacement. Scores are integers: a histogram of them, summed from the highest down, gives
the rank at which each score begins and the score where the draw ends; within a score, rows are
numbered by ``doc_id``.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.ranks import numbered

from .common import bounded_batches, cleared, frugal, written

BUCKETS, LONGEST = 10_000, 1  # words of a feature at most
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
BLOCK = 1 << 20  # bytes of a text whose words are held at a time
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


class Places(dict):
    """The bucket of a feature; those met before are remembered, up to a bound."""

    def __init__(self, buckets: int, most: int = 1 << 17):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(text: str | None, places: Places, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each portion of a text the number of its words, and the buckets of the features that end in it."""
    raw, at, before = (text or "").encode("utf-8", "surrogatepass").lower(), 0, []
    while at < len(raw):
        to = min(len(raw), at + BLOCK)
        cut = BREAK.search(raw, to) if to < len(raw) else None
        to = cut.start() if cut else len(raw)
        words = WORD.findall(raw, at, to)
        found, run = list(map(places.__getitem__, words)), before + words
        for n in range(2, longest + 1):
            first = max(0, len(before) - n + 1)
            found += [places[b" ".join(run[k : k + n])] for k in range(first, len(run) - n + 1)]
        yield len(words), np.array(found, np.int64)
        before = run[len(run) - longest + 1 :] if longest > 1 else []
        at = to


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features of all rows of ``text`` by bucket: each task sums its own, the driver gets ``buckets`` rows."""
    bounded_batches(texts.sparkSession)

    def run(batches):
        places, sums = Places(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(text.as_py(), places, longest):
                    sums += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(frugal(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of the ratio of a bucket's shares, one added to each count, floored."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A thousandfold Gumbel variate of the id's hash, floored; a null id hashes as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each row, as a table."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches):
        gain = shared.value
        places = Places(len(gain))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = n = total = 0
                for more, found in features(text.as_py(), places, longest):
                    words, n, total = words + more, n + len(found), total + int(gain[found].sum())
                weight = total // n if n else 0
                rows.append((doc_id, words, n, weight, weight + noise(doc_id, seed)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "n_words", "n_features", "weight", "score"])

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), SCORED), "scores")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each row of ``docs``; ``rank`` is null for what
    isn't drawn towards the texts of ``target``.

    Null and empty texts have no features and weight 0, and are not drawn where ``least_words`` is
    over 0. Rows that repeat are each counted, scored and ranked; of rows with the same score and
    ``doc_id``, one with fewer features comes first, and null ids come last. Without target rows or without
    documents every share is that of the added ones. Other columns are ignored.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    table = scored(docs, gain, longest, seed)
    fit = F.col("n_words") >= least_words
    # Integer scores lie within a thousandfold logarithm of the counts: the histogram is bounded whatever the input.
    histogram = sorted(((r["score"], r["n"]) for r in table.filter(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    take, offsets, above = percent * sum(n for _, n in histogram) // 100, [], 0
    for score, n in histogram:
        if above >= take:
            break
        offsets.append((score, above))
        above += n
    columns = ["doc_id", "n_features", "weight", "score"]
    if not offsets:
        return table.select(*columns, F.lit(None).cast("long").alias("rank"))
    cutoff = offsets[-1][0]
    inside = fit & (F.col("score") >= cutoff)
    begins = F.broadcast(spark.createDataFrame(offsets, "at long, begin long"))  # as bounded as the histogram
    with cleared(spark) as made:
        place = numbered(table.filter(inside).select(*columns), ["score"], ["doc_id", "n_features", "weight"], "place")
        drawn = written(place.join(begins, F.col("score") == F.col("at")).select(*columns, (F.col("begin") + F.col("place")).alias("rank")), "drawn")
        made.pop()  # it stays with the scores, which the rows that are returned read
    return drawn.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank"))).unionAll(table.filter(~inside).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored towards the benchmark texts; the tenth that is drawn has ranks."""
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = {
    "op11_resampling": r"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bench AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
word AS MATERIALIZED (SELECT rid, unnest(ws) AS w FROM doc),
tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
kind AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda k: CAST(('0x' || substr(h, 2 * k + 1, 2)) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS b
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM word UNION SELECT w FROM bench)), tab),
s AS (SELECT b, count(*) AS n FROM word JOIN kind USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bench JOIN kind USING (w) GROUP BY b),
gain AS MATERIALIZED (
  SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM word) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM bench) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (b)),
mean AS (SELECT rid, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM word JOIN kind USING (w) JOIN gain USING (b) GROUP BY rid),
scored AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN mean USING (rid)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, weight) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
""",
}
