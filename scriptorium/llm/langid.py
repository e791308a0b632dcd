"""Language identification by error-correcting output codes.

Each language has a codeword of bits. A linear classifier over hashed byte n-grams predicts each
bit; decoding takes the language whose codeword has the least logistic loss, every bit weighted by
how surely classifiers of it, fitted to a part of the training rows, are right about the rest. A small
margin flags the row as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytegrams import rolled
from .common import bounded_batches, label_fold, unit_hash

BITS = 13  # of a bucket
SIZES = range(1, 5)  # of the n-grams, in bytes
SAMPLE_ROWS = 400  # training rows of a language at most
SAMPLE_TOTAL = 8000  # training rows in all at most
SAMPLE_CHARS = 20_000  # longer texts are left out of the training rows
CODE_BITS = 15  # of a codeword at least
MARGIN = 0.2  # below this lead of the best language's probability a row is ambiguous
UNKNOWN = "und"

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit, summing to 1


def features(texts: list[str]) -> np.ndarray:
    """Square roots of the n-grams' relative frequencies, a row for each text (no text is cut)."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for row, text in zip(out, texts):
        raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, len(raw), 1 << 20):  # an n-gram belongs to the block in which it starts
            for n, buckets in rolled(raw[at : at + (1 << 20) + SIZES.stop - 2], SIZES, BITS):
                row += np.bincount(buckets[: 1 << 20], minlength=1 << BITS)
        np.sqrt(row / max(row.sum(), 1), out=row)
    return out


def codewords(n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` codewords: the best of some random draws by least distance between two words, with
    no bit equal for all."""
    bits = max(CODE_BITS, 2 * int(np.ceil(np.log2(max(n, 2)))) + 1)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, bits))
        if n > 1:
            same = np.abs(code.sum(axis=0)) == n
            code[rng.integers(n, size=bits), np.arange(bits)] *= np.where(same, -1, 1)
            gaps = ((bits - code @ code.T) / 2)[~np.eye(n, dtype=bool)]
            if gaps.min() > far:
                best, far = code, gaps.min()
        else:
            best = code
    return best


def train(x: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of all bits, by Adam on the weighted logistic loss."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        slope = (-y * share / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))).astype(np.float32)
        for k, (p, g) in enumerate(((w, x.T @ slope + decay * w), (b, slope.sum(axis=0)))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, b


def fit(texts: list[str], langs: list[str], steps: int = 300, decay: float = 1e-4, seed: int = 7) -> Model | None:
    """Train all bits jointly; None without rows. A bit's weight comes from classifiers of a tenth of its
    steps, fitted to two thirds of the rows: the mean probability that they give the right bit on the
    other rows, above one half (hits alone would hardly tell the bits apart)."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    codes = codewords(len(names), rng)
    x = features(texts)
    which = np.array([names.index(y) for y in langs])
    y = codes[which]
    share = (1.0 / np.bincount(which, minlength=len(names)) / len(names))[which][:, None].astype(np.float32)
    out = rng.permutation(len(which)) % 3 == 0
    if out.any() and not out.all():
        w, b = train(x[~out], y[~out], share[~out] / share[~out].sum(), max(1, steps // 10), decay)
        right = (share[out] / (1 + np.exp(np.clip(-y[out] * (x[out] @ w + b), -30, 30)))).sum(axis=0) / share[out].sum()
    else:
        right = np.ones(codes.shape[1])
    trust = np.maximum(right - 0.5, 0.01)
    w, b = train(x, y, share, steps, decay)
    return Model(names, codes.astype(np.float32), w, b, (trust / trust.sum()).astype(np.float32))


def predict(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """Language, probability and ambiguity of each text; null, empty and letterless texts (and all
    texts where nothing was learned) are unknown with score 0."""
    out = [(UNKNOWN, 0.0, True)] * len(texts)
    known = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
    for at in range(0, len(known), 128):
        rows = known[at : at + 128]
        f = features([texts[i] for i in rows]) @ model.weights + model.bias
        loss = np.logaddexp(0, -model.codes[None] * f[:, None]) @ (model.trust * len(model.trust))
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(p, axis=1)
        for i, row, top in zip(rows, p, order):
            lead = top[-1] - (top[-2] if len(top) > 1 else 0.0)
            out[i] = (model.langs[int(row.argmax())], float(min(1.0, top[-1])), bool(lead < MARGIN))
    return out


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """A bounded sample of the labelled rows outside the held-out fold: at most ``rows`` of a
    language and ``total`` in all, those with the least hash of their id among texts of at most
    ``chars`` characters."""
    fit_rows = docs.filter((label_fold() != 0) & F.col("lang").isNotNull() & (F.length("text") <= chars) & (F.length("text") > 0)).select("lang", "text", unit_hash(F.lit("lang"), "doc_id").alias("u"))
    counts = {r["lang"]: r["n"] for r in fit_rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(total).collect()}
    if not counts:
        return [], []
    each = max(1, min(rows, total // len(counts)))
    bound = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * each / n + 20 / n))])
    taken = fit_rows.filter(F.col("u") < F.coalesce(F.element_at(bound, F.col("lang")), F.lit(0.0))).orderBy("u", "lang", "text").limit(3 * each * len(counts) + 1000).collect()
    kept: dict[str, list[str]] = {}
    for r in taken:
        if len(kept.setdefault(r["lang"], [])) < each:
            kept[r["lang"]].append(r["text"])
    return [t for lang in sorted(kept) for t in kept[lang]], [lang for lang in sorted(kept) for _ in kept[lang]]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for each row of ``docs``.

    Only ``text`` is an input. Repeated rows are kept, extra columns ignored; a null ``doc_id`` has a
    null ``held_out``.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)

    def run(batches):
        model = Model(**shared.value) if shared.value else None
        for batch in batches:
            found = predict(model, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), (label_fold() == 0).alias("held_out"), "text").mapInArrow(run, PREDICTED)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(*training_rows(docs)))
