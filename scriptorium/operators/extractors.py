"""All extractors of the feature vector over one annotated corpus.

``texts`` is ``doc_id, text``, and the annotator runs inside tasks over blocks of whole texts. Tokens are never rows of
Spark's: tasks count them inside whole documents (``tallies``), by n-grams that were selected before and lexicons that travel
with the tasks. A text's row becomes its vector's row, so vectors aren't shuffled either.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import bounded_batches

from . import annotations as A
from . import annotators as R
from . import tallies as N
from . import vectors as V

# The lengths of n-grams of characters.
CHARS = (2, 5)
LISTS = "indices array<int>, values array<double>"


@dataclass
class Corpus:
    """What an annotator and the lexicons supply. Lists that give places are ``gram, index`` tables, or
    tuples of labels in order.

    ``annotate`` gives the number of each token's text, and tokens in their texts' order: ``sentence, text, itext, lemma, tag,
    fine_tag, is_stop, like_num, event, tense``; ``head`` (a token's number in its sentence, from 1; null is a root), ``label``
    and ``relation`` of the edge to it; ``chunk``, the length of the noun phrase that begins here; ``coref, cat`` of the entity
    that does; ``sense`` and the number of ``senses``; ``case`` (1 lower, 2 upper, 3 title) and ``syllables``; and ``alone``, the
    value by LEX2's second and third pass (``annotators.Alone``).
    """

    texts: DataFrame  # doc_id, text
    annotate: Callable[[list[str]], tuple[np.ndarray, pa.Table]]
    expressions: DataFrame  # expression, value
    places: DataFrame  # expression, value
    prepositions: DataFrame  # as A.prepositions has it
    char_ngrams: DataFrame  # gram, index
    tag_ngrams: DataFrame  # gram, index
    tree_ngrams: DataFrame  # family, gram, index
    fine_tags: tuple[str, ...]
    categories: tuple[str, ...]
    supersenses: tuple[str, ...]
    longest: int = 3  # words of an expression


def alone(lexicon: DataFrame) -> R.Alone:
    """LEX2's second and third pass; entries travel with the tasks. Of several entries of a word the first counts."""
    patterns = [(r["prep"], float(r["imag"])) for r in lexicon.filter("is_regex = 1").orderBy("ord").select("prep", "imag").collect()]
    entries = lexicon.filter("n_words = 1 AND is_regex = 0").orderBy(F.desc("ord")).select("prep", "imag", "pos_adp", "pos_nonadp").collect()
    return R.Alone(patterns, {r["prep"]: tuple(r)[1:] for r in entries})


def pairs(texts: DataFrame, annotate: Callable[[list[str]], tuple[np.ndarray, pa.Table]]) -> DataFrame:
    """``family, gram, n`` of what n-grams are selected from: documents by pair of tags in a row (family ``tag``), and edges
    by their labels (``node``), relations and both."""
    bounded_batches(texts.sparkSession)
    return texts.select("doc_id", "text").mapInArrow(N.pair_counter(annotate), "family string, gram string, n long").groupBy("family", "gram").agg(F.sum("n").alias("n"))


def every(c: Corpus) -> DataFrame:
    """``doc_id, indices, values``: places of the layout in order and their values, a row for each row of ``texts``; what is 0
    is left out."""
    bounded_batches(c.texts.sparkSession)
    grams = {f: [] for f in ("node", "relation", "both")}
    for r in c.tree_ngrams.collect():  # as many as the layout has places
        grams[r["family"]].append((r["gram"], r["index"]))
    grams["tag"] = [(r["gram"], r["index"]) for r in c.tag_ngrams.collect()]
    chars = {r["gram"]: V.OFFSET["char_ngrams"] + r["index"] for r in c.char_ngrams.collect() if CHARS[0] <= len(r["gram"]) <= CHARS[1]}
    lexicon = lambda df: {r["expression"]: r["value"] for r in df.groupBy("expression").agg(F.max("value").cast("double").alias("value")).collect()}
    counter = N.text_counter(c.annotate, grams, (c.fine_tags, c.categories, c.supersenses), lexicon(c.expressions), lexicon(c.places), A.of_several_words(c.prepositions), c.longest)
    kind = c.texts.schema["doc_id"].dataType.simpleString()
    return c.texts.select("doc_id", "text").mapInArrow(N.character_lists(chars, *CHARS), f"doc_id {kind}, text string, {LISTS}").mapInArrow(counter, f"doc_id {kind}, {LISTS}")
