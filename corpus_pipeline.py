"""A corpus pipeline: toxicity, near duplicates, personal data, mixing, tokenization.

``STAGES`` lists its stages in order. Each takes ``(spark, docs, sf_dir)`` and returns a DataFrame,
which is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import scriptorium.llm.jaccard as jaccard
import scriptorium.llm.lattice as lattice
import scriptorium.llm.mixing as mixing
import scriptorium.llm.pii as pii
import scriptorium.llm.toxicity as toxicity
from scriptorium.llm.common import cleared, discarded, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.fit(*toxicity.training_rows(docs, labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share five-word shingles (Jaccard 0.8), the one with the
    least id stays."""
    return jaccard.deduplicated(docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; ``n_chars`` counts the new text."""
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled piece ids of each document in place of its text."""
    return lattice.encoded(docs, lattice.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: A trained classifier and sampled segmentations have no SQL form; ``tests/llm/test_pipeline.py`` holds
#: the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's tables go when its output is written, and that goes
    when the next stage's is; the last stage's input stays for the rows that are returned."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with cleared(spark) as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            after = made.pop()
        if before:
            discarded(spark, before)
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
