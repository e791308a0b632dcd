"""Toxicity by subword bags: hashed character n-gram vectors averaged into a linear softmax.

Vectors and softmax are trained jointly in numpy. A text is scored by its worst short window of
words, so a few toxic words count in a long text; unseen misspellings share n-grams with the words
that were seen. As the classifier is linear after the average, each n-gram's vector is reduced to
one number for scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytegrams import rolled
from .common import bounded_batches, frugal, label_fold, unit_hash

BITS = 17  # of a bucket
SIZES = range(3, 6)  # of the n-grams, in bytes, a word's two borders included
DIM = 8  # of a vector
WINDOW = 8  # words
SAMPLE_TOXIC = 1500  # toxic training rows at most
SAMPLE_CLEAN = 3000  # clean training rows at most
SAMPLE_CHARS = 10_000  # longer texts are left out of the training rows
BLOCK = 1 << 20  # bytes of text that are worked on at a time

SCORED = "doc_id long, held_out boolean, score double, predicted int"
#: Bytes to themselves if they can belong to a letter or are a digit, all others to a space.
LETTERS = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)


@dataclass
class Model:
    table: np.ndarray  # what each bucket adds to the log-odds, before the average
    bias: float


def cleaned(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in lower case with spaces for all but letters and digits, two spaces around each
    text; and where each text starts (one entry more than texts). A word said again and again in a row
    weighs as one: a window of a single word would be judged by that word alone."""
    parts = []
    for t in texts:
        words = (t or "").lower().split()
        parts.append(("  " + " ".join([w for w, last in zip(words, [None, *words]) if w != last])).encode("utf-8", "surrogatepass"))
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return LETTERS[np.frombuffer(b"".join(parts) + b"  ", np.uint8)], starts


def grams(raw: np.ndarray):
    """``(buckets, valid)`` for each n: an n-gram is valid if it lies in one word with its borders."""
    gaps = np.concatenate([[0], np.cumsum(raw == 32, dtype=np.int32)])
    for n, buckets in rolled(raw, SIZES, BITS):
        last = len(buckets)
        yield buckets, gaps[n - 1 : n - 1 + last] == gaps[1 : 1 + last]


def windows(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each window: runs of words of a text, each sharing half its words with
    the next; the border before a word counts to it."""
    space = raw == 32
    heads = np.flatnonzero(space[:-1] & ~space[1:])
    text = np.searchsorted(starts, heads, side="right") - 1
    first = np.searchsorted(text, np.arange(len(starts) - 1))
    rank = np.arange(len(heads)) - first[text]
    opens = np.flatnonzero(rank % (WINDOW // 2) == 0)
    counts = np.bincount(text, minlength=len(starts) - 1)
    stop = np.minimum(opens + WINDOW, (first + counts)[text[opens]])
    border = np.concatenate([heads, [len(raw)]])
    ends = np.where(stop < (first + counts)[text[opens]], border[np.minimum(stop, len(heads))], starts[text[opens] + 1])
    keep = (rank[opens] == 0) | (stop - opens > WINDOW // 2)
    return heads[opens][keep], ends[keep], text[opens][keep]


def log_odds(model: Model, texts: list[str | None]) -> np.ndarray:
    """The largest window's log-odds of each text; texts without words get the bias alone."""
    out = np.full(len(texts), -np.inf)
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held < BLOCK):
            held += len(texts[to] or "")
            to += 1
        raw, starts = cleaned(texts[at:to])
        total, count = np.zeros(len(raw) + 1), np.zeros(len(raw) + 1, np.int64)
        value, hits = np.zeros(len(raw), np.float64), np.zeros(len(raw), np.int64)
        for buckets, valid in grams(raw):
            value[: len(valid)] += np.where(valid, model.table[buckets], 0)
            hits[: len(valid)] += valid
        np.cumsum(value, out=total[1:])
        np.cumsum(hits, out=count[1:])
        a, b, which = windows(raw, starts)
        mean = (total[b] - total[a]) / np.maximum(count[b] - count[a], 1)
        np.maximum.at(out, at + which, mean)
        at = to
    return np.where(np.isinf(out), 0.0, out) + model.bias


def sample_grams(texts: list[str]):
    """The n-grams of the training texts in one array, in order of position; where each window and
    each text begins and ends in it, and the text of each window. Built from a few texts at a time,
    so that little but the result is held."""
    ids, lo, hi, which, doc_lo, doc_hi, base = [], [], [], [], [], [], 0
    for at in range(0, len(texts), 64):
        raw, starts = cleaned(texts[at : at + 64])
        a, b, text = windows(raw, starts)
        found = [(np.flatnonzero(valid), buckets[valid]) for buckets, valid in grams(raw)]
        pos = np.concatenate([x for x, _ in found])
        order = np.argsort(pos, kind="stable")
        pos = pos[order]
        ids.append(np.concatenate([x for _, x in found])[order])
        l, h = np.searchsorted(pos, a), np.searchsorted(pos, b)
        full = h > l
        lo.append(l[full] + base)
        hi.append(h[full] + base)
        which.append(text[full] + at)
        doc_lo.append(np.searchsorted(pos, starts[:-1]) + base)
        doc_hi.append(np.searchsorted(pos, starts[1:]) + base)
        base += len(pos)
    return tuple(map(np.concatenate, (ids, lo, hi, which, doc_lo, doc_hi)))


def fit(texts: list[str], labels: list[int], whole: int = 1, worst: int = 12, seed: int = 11) -> Model:
    """Some rounds on whole texts, then rounds on each text's worst windows under the model so far
    (two for a clean text). Without rows of both classes the model has no opinion above 0.5."""
    y = np.asarray(labels, int)
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 3.0 if labels and y[0] == 1 else -3.0)
    rng = np.random.default_rng(seed)
    ids, lo, hi, which, doc_lo, doc_hi = sample_grams(texts)
    e = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    u, c = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    ge, gu, gc = np.full((1 << BITS, DIM), 1e-6, np.float32), np.full_like(u, 1e-6), np.full_like(c, 1e-6)
    weight = np.array([len(y) / 2 / max(1, (y == k).sum()) for k in (0, 1)], np.float32)

    def step(lows, highs, target, rate):
        size = highs - lows
        flat = np.repeat(lows - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        g = ids[flat]
        seg = np.repeat(np.arange(len(size)), size)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        v = np.add.reduceat(e[g], first, axis=0) / size[:, None]
        z = v @ u + c
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = ((p - np.eye(2, dtype=np.float32)[target]) * weight[target][:, None]).astype(np.float32)
        slope = (d @ u.T) / size[:, None]
        used, back = np.unique(g, return_inverse=True)
        de = np.stack([np.bincount(back, weights=slope[seg, k]) for k in range(DIM)], axis=1).astype(np.float32)
        for x, s, dx, at in ((e, ge, de, used), (u, gu, v.T @ d, slice(None)), (c, gc, d.sum(axis=0), slice(None))):
            s[at] += dx * dx
            x[at] -= rate * dx / np.sqrt(s[at])

    for _ in range(whole):
        rows = rng.permutation(np.flatnonzero(doc_hi > doc_lo))
        for k in range(0, len(rows), 32):
            r = rows[k : k + 32]
            step(doc_lo[r], doc_hi[r], y[r], 0.1)
    edges = np.flatnonzero(np.diff(which, prepend=-1))
    for t in range(worst):
        table = e @ (u[:, 1] - u[:, 0])
        mean = np.concatenate([np.add.reduceat(np.append(table[ids[lo[k] : hi[k : k + 4096].max()]], 0), np.stack([lo[k : k + 4096], hi[k : k + 4096]], 1).ravel() - lo[k])[::2] for k in range(0, len(lo), 4096)]) / (hi - lo)
        ranked = np.lexsort((-mean, which))
        top = ranked[edges]
        clean = edges[(y[which[top]] == 0) & (np.append(edges[1:], len(which)) - edges > 1)]
        picked = rng.permutation(np.concatenate([top, ranked[clean + 1]]))
        for k in range(0, len(picked), 64):
            r = picked[k : k + 64]
            step(lo[r], hi[r], y[which[r]], 0.1)
    table = (e @ (u[:, 1] - u[:, 0])).astype(np.float32)
    model = Model(table, float(c[1] - c[0]))
    model.bias -= cut(log_odds(model, texts), y)
    return model


def cut(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds that split the training rows with the fewest errors: the middle of the widest
    gap among the best splits, so that rows like neither class stay where they are."""
    order = np.argsort(z, kind="stable")
    s, t = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(t == 1)]) + (t == 0).sum() - np.concatenate([[0], np.cumsum(t == 0)])
    best = [k for k in np.flatnonzero(errors == errors.min()) if 0 < k < len(s)]
    if not best:
        return 0.0
    k = max(best, key=lambda k: s[k] - s[k - 1])
    return float((s[k] + s[k - 1]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """A bounded sample of the labelled rows outside the held-out fold: at most ``toxic`` and
    ``clean`` ids of the two classes, those with the least hash, and of them the texts of at most ``chars`` characters.
    An id with several labels counts as toxic if one says so."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(label_fold() != 0).withColumn("u", unit_hash(F.lit("toxic"), "doc_id"))
    ids = known.filter("toxic = 1").orderBy("u", "doc_id").limit(toxic).unionAll(known.filter("toxic = 0").orderBy("u", "doc_id").limit(clean))
    taken = docs.filter(F.length("text").between(1, chars)).select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text").orderBy("doc_id", "text").limit(4 * (toxic + clean)).collect()
    return [r["text"] for r in taken], [int(r["toxic"]) for r in taken]


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Only ``text`` is an input. Null and empty texts get the score of a text without words; a null
    ``doc_id`` has a null ``held_out``; repeated rows are kept and extra columns ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        model = Model(**shared.value)
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(log_odds(model, batch.column(2).to_pylist()), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), (label_fold() == 0).alias("held_out"), "text").mapInArrow(frugal(run), SCORED)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    at = docs.columns.index("text")

    def run(batches):
        model = Model(**shared.value)
        for batch in batches:
            yield batch.filter(pa.array(log_odds(model, batch.column(at).to_pylist()) < 0))

    return docs.mapInArrow(frugal(run), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, fit(*training_rows(docs, labels)))
