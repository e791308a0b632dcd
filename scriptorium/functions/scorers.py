"""Plug-ins: scorers, text getters and providers that fail over, as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Scorer = Callable[[list[str]], Iterable[float]]
SCORERS: dict[str, tuple[Callable[[], Scorer], int]] = {}


def scorer(name: str, batch: int = 32):
    """UDX1: register a factory of scorers. It is called once a worker task, so a model is loaded once;
    what it returns scores a batch of texts."""

    def put(factory):
        SCORERS[name] = (factory, batch)
        return factory

    return put


def score(name: str) -> Callable[[Column | str], Column]:
    """UDX1: the registered scorer as a function of a text column; null texts have null scores."""
    factory, batch = SCORERS[name]

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in parts:
            out = pd.Series([None] * len(texts), dtype="float64")
            rows = texts.index[texts.notna()].tolist()
            for k in range(0, len(rows), batch):
                out.loc[rows[k : k + batch]] = [float(x) for x in model(texts.loc[rows[k : k + batch]].tolist())]
            yield out

    return run


@scorer("length", batch=256)
def _by_length() -> Scorer:
    """A stand-in that needs no model: texts up to a thousand characters by their length."""
    return lambda texts: [min(len(t) / 1000, 1.0) for t in texts]


def in_candidate_order(candidates: list[str], labels: Column, scores: Column) -> Column:
    """SCR6: scores of a zero-shot classifier, which come sorted, in the order of the candidates."""
    return F.transform(F.array(*map(F.lit, candidates)), lambda c: F.try_element_at(scores, F.nullif(F.array_position(labels, c), F.lit(0)).cast("int")))


def hypotheses(template: str, candidates: list[str]) -> Column:
    """SCR6: what a classifier is asked for each candidate."""
    return F.array(*[F.lit(template.replace("{}", c)) for c in candidates])


def embedded(embedder: Callable[[list[str]], list[list[float]]], size: int, prefix: str = "") -> Callable[[Column | str], Column]:
    """SCR9: a text column's vectors, the first ``size`` numbers of each at length 1."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for texts in parts:
            v = np.asarray(embedder([prefix + (t or "") for t in texts]), np.float32).reshape(len(texts), -1)[:, :size]
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(v / np.where(norm == 0, 1, norm)))

    return run


def text_of(source: Column, getters: dict[str, Column]) -> Column:
    """UDX4: the text of a row by the getter of its source; null for unknown sources."""
    out = F.lit(None).cast("string")
    for name, getter in getters.items():
        out = F.when(source == name, getter).otherwise(out)
    return out


def attempted(providers: list[tuple[str, Callable[[str], str]]], kind: Column | None = None) -> Callable[[Column], Column]:
    """UDX3: ``struct<ok, value, error>`` of the first provider that succeeds for a text, tried in order;
    every row has a result, and no row's failure touches another's. Null and blank texts fail by
    themselves; ``kind`` says of what type the value was before it became a column of strings."""
    names = [n for n, _ in providers]
    calls = [f for _, f in providers]

    @F.pandas_udf("ok boolean, value string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            errors = []
            if t is None or not t.strip():
                rows.append((False, None, "text cannot be empty or whitespace"))
                continue
            for name, call in zip(names, calls):
                try:
                    rows.append((True, call(t), None))
                    break
                except Exception as e:  # a provider may fail in any way; the row says how
                    errors.append(f"{name}: {e}")
            else:
                rows.append((False, None, "all providers failed: " + "; ".join(errors) if errors else "no providers are available"))
        return pd.DataFrame(rows, columns=["ok", "value", "error"])

    def column(text: Column) -> Column:
        if kind is None:
            return run(text)
        wrong = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("value"), F.lit("text must be a string").alias("error"))
        return F.when(kind != "string", wrong).otherwise(run(text))

    return column
