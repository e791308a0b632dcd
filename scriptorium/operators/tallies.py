"""Counts of the feature vector inside tasks: numpy over a block of whole documents' tokens, for mapInArrow.

Tokens come from an annotator that runs in the same task over the block's texts, or as a table (a row a token, a
document's rows in order). A row a document goes back, so no token is shuffled and none is a row of Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import annotations as A
from . import annotators as R
from . import vectors as V

CASES = ("lower", "upper", "title")
# The largest depth, branching and width that have a bin of their own.
DEPTH, BRANCHING, WIDTH = 17, 18, 56
DENSE = 1 << 22  # counters of a block that are held as a table


class Block:
    """Whole documents' tokens as arrays. A row without a text stands for a document without tokens."""

    def __init__(self, rows: pa.Table, owner: np.ndarray | None = None, docs: int = 0):
        """With ``owner``, the number of each token's document out of ``docs``, all rows are tokens."""
        if owner is None:
            ids, real = rows["doc_id"].to_numpy(), rows["text"].is_valid()
            first = np.append(True, ids[1:] != ids[:-1])
            self.ids, docs = ids[first], int(first.sum())
            owner, rows = (np.cumsum(first) - 1)[real.to_numpy()], rows.filter(real)
        self.owner, self.docs, self.rows = owner, docs, rows
        self.tokens = np.bincount(self.owner, minlength=self.docs)
        self.end = np.cumsum(self.tokens)[self.owner]
        self.sentence = self.number("sentence")
        change = np.append(True, (self.owner[1:] != self.owner[:-1]) | (self.sentence[1:] != self.sentence[:-1]))[: len(self.owner)]
        self.tree, self.begin = np.cumsum(change) - 1, np.flatnonzero(change)

    def number(self, name: str, missing: float = 0) -> np.ndarray:
        return pc.fill_null(self.rows[name], pa.scalar(missing, self.rows[name].type)).to_numpy()

    def of_label(self, name: str, f: Callable[[pa.Array], pa.Array], missing: float) -> np.ndarray:
        """``f`` of a column of labels, worked out for each different one if they are dictionary arrays."""
        column = self.rows[name]
        if not pa.types.is_dictionary(column.type):
            return pc.fill_null(f(column), missing).to_numpy()
        code, kinds = self._coded(column)
        return np.append(pc.fill_null(f(kinds), missing).to_numpy(zero_copy_only=False), missing)[code]

    @staticmethod
    def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        kinds = column.combine_chunks().dictionary_encode()
        kinds = kinds.combine_chunks() if isinstance(kinds, pa.ChunkedArray) else kinds
        return pc.fill_null(kinds.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), kinds.dictionary

    def place(self, name: str, known: list[str] | tuple[str, ...]) -> np.ndarray:
        """A label's place in a list, -1 if it isn't there."""
        return self.of_label(name, lambda labels: pc.index_in(labels, pa.array(known, pa.string())), -1)

    def codes(self, name: str) -> tuple[np.ndarray, pa.Array]:
        """Different values of a column by number, -1 for null."""
        return self._coded(self.rows[name])

    def above(self) -> np.ndarray:
        """The place of each token's head, -1 of a root. A head is a token's number in its sentence, from 1."""
        head, size = self.number("head"), np.diff(np.append(self.begin, len(self.owner)))
        if ((head < 0) | (head > size[self.tree])).any():
            raise ValueError("a head is outside its sentence")
        return np.where(head > 0, self.begin[self.tree] + head - 1, -1)


class Tally:
    """Values by document and place."""

    def __init__(self, docs: int):
        self.docs, self.found = docs, []

    def put(self, extractor: str, owner: np.ndarray, index: np.ndarray | int, value: np.ndarray) -> None:
        index = np.broadcast_to(index, owner.shape)
        if len(index) and not (0 <= index.min() and index.max() < V.LAYOUT[extractor]):
            raise ValueError(f"no place for {extractor} {index.min()} to {index.max()}")
        some = value != 0
        self.found.append((owner[some], V.OFFSET[extractor] + index[some], value[some]))

    def share(self, extractor: str, index: np.ndarray | int, owner: np.ndarray, over: np.ndarray | None, weight: np.ndarray | None = None) -> None:
        """Counts by document and place (or sums of ``weight``) out of ``over``, or of the document's sum."""
        size = V.LAYOUT[extractor]
        key = owner * size + index
        if self.docs * size <= DENSE and weight is None:
            whole = np.bincount(key)
            kinds = np.flatnonzero(whole)
            times = whole[kinds]
        else:
            kinds, back = np.unique(key, return_inverse=True)
            times = np.bincount(back, weight, len(kinds))
        mine = kinds // size
        total = np.bincount(mine, times, self.docs) if over is None else over
        some = total[mine] != 0
        self.put(extractor, mine[some], kinds[some] % size, times[some] / total[mine[some]])

    def ordered(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Where each document's values begin, with the end at last; places in order, and values. Two values for a place
        are an error."""
        owner, place, value = (np.concatenate(x) for x in zip(*self.found))
        key = owner * V.SIZE + place
        order = np.argsort(key, kind="stable")
        if (np.diff(key[order]) == 0).any():
            raise ValueError("two values for a place")
        begins = np.append(0, np.cumsum(np.bincount(owner, minlength=self.docs)))
        return pa.array(begins, pa.int32()), pa.array(place[order].astype(np.int32)), pa.array(value[order].astype(np.float64))

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        begins, place, value = self.ordered()
        pairs = pa.StructArray.from_arrays([place, value], ["feature", "value"])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(begins, pairs)], ["doc_id", "pairs"])

    def lists(self, ids: pa.Array) -> pa.RecordBatch:
        begins, place, value = self.ordered()
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(begins, place), pa.ListArray.from_arrays(begins, value)], ["doc_id", "indices", "values"])


def by_words(b: Block, t: Tally, word: np.ndarray, n: np.ndarray, code: np.ndarray, kinds: int) -> None:
    """FEA3-4, FEA6-11, FEA13-15, FEA22, FEA24 and FEA5: rates and runs of words."""
    owner, whole, sizes = b.owner[word], np.flatnonzero(n), b.of_label("text", pc.utf8_length, 0)[word].astype(np.int64)
    count = lambda hit: np.bincount(owner[hit], minlength=b.docs)[whole] / n[whole]
    rate = lambda name, index, hit: t.put(name, whole, index, count(hit))
    t.share("word_lengths", np.minimum(sizes, 15)[sizes > 0] - 1, owner[sizes > 0], n)
    different = np.unique(owner * kinds + code[word]) // max(kinds, 1)
    t.put("type_token", whole, 0, np.bincount(different, minlength=b.docs)[whole] / n[whole])
    syllables = b.number("syllables")[word]
    t.put("syllables", whole, 0, np.minimum(np.bincount(owner, syllables, b.docs)[whole] / n[whole] / 8, 1.0))
    rate("syllables", 1, syllables >= 3)
    articles = b.place("itext", ("the", "a", "an"))[word]
    rate("articles", 0, articles == 0)
    rate("articles", 1, articles > 0)
    rate("contractions", 0, b.of_label("text", lambda texts: pc.match_substring(texts, "'"), False)[word].astype(bool))
    for name, column in (("numeric_words", "like_num"), ("stopwords", "is_stop"), ("events", "event")):
        rate(name, 0, b.number(column, False)[word])
    rate("lexical_density", 0, b.place("tag", A.CONTENT)[word] >= 0)
    tense = b.place("tense", A.TENSES)[word]
    t.share("tense", np.where(tense < 0, len(A.TENSES), tense), owner, n)

    rank, at = np.arange(len(owner)) - (np.cumsum(n) - n)[owner], np.arange(len(owner))
    end, s = np.cumsum(n)[owner], sizes.copy()
    for k in (1, 2):
        s += np.where(at + k < end, np.append(sizes[k:], np.zeros(min(k, len(sizes)), np.int64)), 0)
    d = np.maximum(n - 2, 1)
    place, window = (s - 3) // 3, rank < d[owner]
    t.share("sliding_lengths", np.where(place < 0, 14, np.minimum(place, 14))[window], owner[window], d)

    case, sentence = b.number("case")[word], b.sentence[word]
    turn = np.append(True, (owner[1:] != owner[:-1]) | (sentence[1:] != sentence[:-1]))[: len(owner)]
    last = np.append(turn[1:], True)[: len(owner)]
    inside = np.where(turn, 0, np.where(last, 2, 1)) * 3 + case - 1
    t.share("case_positions", inside[case > 0], owner[case > 0], n)
    pair = (owner[1:] == owner[:-1]) & (case[1:] > 0) & (case[:-1] > 0)
    t.share("case_bigrams", ((case[:-1] - 1) * 3 + case[1:] - 1)[pair], owner[1:][pair], n - 1)

    held = np.bincount(b.tree[word], minlength=len(b.begin))
    mine, number, length = b.owner[b.begin][held > 0], b.sentence[b.begin][held > 0], held[held > 0]
    first, stop = np.full(b.docs, -1), np.ones(b.docs, np.int64)
    first[mine[::-1]] = number[::-1]
    stop[mine] = number + 1
    blank = np.flatnonzero(first != 0)
    top = A.LONGEST_SENTENCE // A.SENTENCE_BIN - 1
    t.share("sentence_lengths", np.append(np.minimum(length // A.SENTENCE_BIN, top), np.zeros(len(blank), np.int64)), np.append(mine, blank), stop)
    t.put("sentence_lengths", np.arange(b.docs), top + 1, np.minimum(n / stop / A.LONGEST_SENTENCE, 1.0))


class Grams:
    """Selected n-grams as numbers: digits are places in the lists of labels, the last one the lowest; 0 is any other."""

    def __init__(self, grams: list[tuple[str, int]], kinds: int = 1):
        parts = [(g.split(" "), k) for g, k in grams]
        self.labels = [sorted({w for p, _ in parts for w in p[j::kinds]}) for j in range(kinds)]
        self.base = max(map(len, self.labels), default=0) + 1
        self.longest = max((len(p) for p, _ in parts), default=0)
        if self.base**7 >= 1 << 63:
            raise ValueError("too many different labels in the selected n-grams")
        at = [{w: k + 1 for k, w in enumerate(ws)} for ws in self.labels]
        value = [sum(at[j % kinds][w] * self.base ** (len(p) - 1 - j) for j, w in enumerate(p)) for p, _ in parts]
        order = np.argsort(np.array(value, np.int64))
        self.values, self.index = np.array(value, np.int64)[order], np.array([k for _, k in parts], np.int64)[order]

    def found(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which numbers are selected ones, and their places."""
        if not len(self.values):
            return np.zeros(len(value), bool), value
        near = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
        return self.values[near] == value, self.index[near]


def tag_ngrams(b: Block, t: Tally, grams: Grams) -> None:
    """FEA17: runs of two to four tags, out of all such runs."""
    digit, at = b.place("tag", grams.labels[0]).astype(np.int64) + 1, np.arange(len(b.owner))
    value, sound, places, owners = digit, digit > 0, [], []
    for k in (1, 2, 3):
        after = np.append(digit[k:], np.zeros(min(k, len(digit)), np.int64))[: len(digit)]
        value, sound = value * grams.base + after, sound & (after > 0) & (at + k < b.end)
        hit, index = grams.found(np.where(sound, value, 0))
        places.append(index[hit])
        owners.append(b.owner[hit])
    total = sum(np.maximum(b.tokens - k, 0) for k in (1, 2, 3))
    t.share("tag_ngrams", np.concatenate(places), np.concatenate(owners), total)


def trees(b: Block, t: Tally, families: dict[str, Grams]) -> None:
    """FEA18-19: sentences by depth and by number of leaves, inner nodes by number of children, and paths from an
    ancestor down to a node: of labels (2 to 4 nodes), of relations (1 to 4 edges), of both (2 to 4 nodes)."""
    above = b.above()
    child, self_ = above >= 0, np.arange(len(above))
    up, far = np.where(child, above, self_), child.astype(np.int64)
    for _ in range(len(above).bit_length() + 1):  # by pointer doubling
        if not child[up].any():
            break
        far, up = far + far[up], up[up]
    else:
        raise ValueError("the edges have a cycle")
    children = np.bincount(above[child], minlength=len(above))
    if len(above):
        mine, depth, width = b.owner[b.begin], np.maximum.reduceat(far, b.begin), np.add.reduceat((children == 0).astype(np.int64), b.begin)
        bins = np.append(np.minimum(depth, DEPTH), DEPTH + BRANCHING + np.minimum(width, WIDTH))
        t.share("tree_structure", bins, np.append(mine, mine), np.bincount(mine, minlength=b.docs))
    t.share("tree_structure", DEPTH + np.minimum(children, BRANCHING)[children > 0], b.owner[children > 0], None)

    for family, grams in families.items():
        names = {"node": ("label",), "relation": ("relation",), "both": ("label", "relation")}[family]
        digits = [b.place(name, known).astype(np.int64) + 1 for name, known in zip(names, grams.labels)]
        value, sound, there, places, owners = np.zeros(len(above), np.int64), np.ones(len(above), bool), self_, [], []

        def take(digit, power):
            nonlocal value, sound
            value, sound = value + digit[there] * grams.base**power, sound & (digit[there] > 0)

        if family != "relation":
            take(digits[0], 0)
        for k in range(1, 5 if family == "relation" else 4):
            if family != "node":  # the edge to the next ancestor
                take(digits[-1], k - 1 if family == "relation" else 2 * k - 1)
            sound = sound & (above[there] >= 0)
            there = np.where(sound, above[there], there)
            if family != "relation":
                take(digits[0], k if family == "node" else 2 * k)
            hit, index = grams.found(np.where(sound, value, 0))
            places.append(index[hit])
            owners.append(b.owner[hit])
        t.share("tree_ngrams", np.concatenate(places), np.concatenate(owners), None)


def exact_mean(owner: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents with values and the means of these as exact decimals of ten digits, which no order of a sum changes."""
    kinds, back = np.unique(value, return_inverse=True)
    whole = np.array([int(Decimal(repr(float(v))).quantize(Decimal("1e-10"), ROUND_HALF_UP).scaleb(10)) for v in kinds], np.int64)
    total, n = np.zeros(docs, np.int64), np.bincount(owner, minlength=docs)
    np.add.at(total, owner, whole[back])
    some = np.flatnonzero(n)
    return some, np.array([int(x) / 10**10 / int(k) for x, k in zip(total[some], n[some])], np.float64)


def longest_matches(code: np.ndarray, number: dict[str, int], kinds: int, end: np.ndarray, known: dict[str, float | None], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LEX1: ``start, words, value`` of the longest matches from left to right that don't overlap. Runs whose words all stand
    at their place in some entry are looked up; of a place's entries the longest counts. The value of none is NaN. ``number``
    has the codes (out of ``kinds``) of entries' words that are there."""
    size, value = np.zeros(len(code), np.int64), np.zeros(len(code))
    for n in range(1, most + 1):
        entries = {tuple(number[w] for w in e): np.nan if v is None else float(v) for e, v in ((e.split(" "), v) for e, v in known.items()) if len(e) == n and all(w in number for w in e)}
        if not entries or len(code) < n:
            continue
        at = np.flatnonzero(np.arange(n, len(code) + n) <= end)
        for k in range(n):
            stands = np.zeros(kinds + 1, bool)  # the last one is that of null
            stands[[e[k] for e in entries]] = True
            at = at[stands[code[at + k]]]
        for a, run in zip(at.tolist(), zip(*[code[at + k].tolist() for k in range(n)])):
            if (v := entries.get(run)) is not None:
                size[a], value[a] = n, v
    out, free = [], 0
    hits = np.flatnonzero(size)
    for a, n in zip(hits.tolist(), size[hits].tolist()):
        if a >= free:
            out.append(a)
            free = a + n
    start = np.array(out, np.int64)
    return start, size[start], value[start]


def lexicons(b: Block, t: Tally, n: np.ndarray, code: np.ndarray, number: dict[str, int], kinds: int, expressions: dict, places: dict, several: list, most: int) -> None:
    """FEA26-28: matches by value out of the words, those of places, and prepositions by value."""
    start, size, value = longest_matches(code, number, kinds, b.end, expressions, most)
    some = n[b.owner[start]] > 0
    start, size, value = start[some], size[some], value[some]
    free, start, value = n - np.bincount(b.owner[start], size - 1, b.docs), start[~np.isnan(value)], value[~np.isnan(value)]
    t.share("concreteness", np.minimum(np.floor(value * 20), 19).astype(np.int64), b.owner[start], free)
    mine, mean = exact_mean(b.owner[start], value, b.docs)
    t.put("concreteness", mine, 20, mean)
    start = longest_matches(code, number, kinds, b.end, places, most)[0]
    t.share("places", 0, b.owner[start], n)

    used, whole, missing = A.first_pass(code, number, b.end - np.arange(len(code)), several)
    value = np.where(used < 0, b.number("alone", np.nan), np.where((used > 0) & ~missing, whole, np.nan))
    some = ~np.isnan(value) & (n[b.owner] > 0)
    owner, value = b.owner[some], value[some]
    t.share("imageability", np.minimum(np.floor(value * A.VALUE_BINS), A.VALUE_BINS - 1).astype(np.int64), owner, n)
    mine, mean = exact_mean(owner, value, b.docs)
    t.put("imageability", mine, A.VALUE_BINS, mean)


def spans(b: Block, t: Tally, n: np.ndarray, fine: tuple, categories: tuple, supersenses: tuple) -> None:
    """FEA12, FEA16, FEA20-21, FEA23, FEA25: labels of tokens and of the spans that begin with them."""
    for name, column, known, over in (("punctuation", "text", A.SYMBOLS, b.tokens), ("fine_tags", "fine_tag", fine, b.tokens), ("supersense", "sense", supersenses, n)):
        index = b.place(column, known)
        t.share(name, index[index >= 0], b.owner[index >= 0], over)
    length = b.number("chunk")
    t.share("phrase_lengths", np.minimum(length, A.PHRASE_BINS)[length > 0] - 1, b.owner[length > 0], n, length[length > 0])
    same, kinds = b.codes("coref")
    named = np.flatnonzero(same >= 0)
    first = named[np.unique(b.owner[named] * max(len(kinds), 1) + same[named], return_index=True)[1]]
    cat = b.place("cat", categories)[first]
    t.share("entities", cat[cat >= 0], b.owner[first][cat >= 0], n)
    senses = b.number("senses")
    t.share("polysemy", np.minimum(senses, A.SENSE_BINS)[senses > 0] - 1, b.owner[senses > 0], None)


def blocks(batches: Iterator[pa.RecordBatch], size: int = 1 << 17) -> Iterator[Block]:
    """Whole documents of about ``size`` rows together; a longer document is a block of its own."""
    held, n, most = [], 0, size
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        rows = pa.Table.from_batches(held)
        ids = rows["doc_id"].to_numpy()
        turns = np.flatnonzero(ids[1:] != ids[:-1])
        if len(turns):
            last = int(turns[-1]) + 1  # the last document may go on
            yield Block(rows.slice(0, last))
            held, n = rows.slice(last).to_batches(), rows.num_rows - last
        most = max(size, 2 * n)  # a long document is not looked through at each batch
    if n:
        yield Block(pa.Table.from_batches(held))


def token_counter(grams: dict, labels: tuple[tuple, tuple, tuple], expressions: dict, places: dict, several: list, most: int) -> Callable[[Block, Tally], None]:
    """Counts a block. ``grams`` has the selected n-grams by family, ``tag`` too."""
    families = {f: Grams(g, 2 if f == "both" else 1) for f, g in grams.items()}
    by_tag = families.pop("tag")
    said = pa.array(sorted({w for e in [*expressions, *places] for w in e.split(" ")} | {w for ws, _ in several for w in ws}), pa.string())

    def count(b: Block, t: Tally) -> None:
        word = b.rows["tag"].is_valid().to_numpy() & (b.place("tag", ("PUNCT", "SYM")) < 0)
        n, (code, kinds) = np.bincount(b.owner[word], minlength=b.docs), b.codes("itext")
        at = pc.index_in(said, kinds).to_pylist()
        number = {w: k for w, k in zip(said.to_pylist(), at) if k is not None}
        by_words(b, t, word, n, code, len(kinds))
        spans(b, t, n, *labels)
        tag_ngrams(b, t, by_tag)
        trees(b, t, families)
        lexicons(b, t, n, code, number, len(kinds), expressions, places, several, most)

    return count


def vector_counter(grams: dict, labels: tuple[tuple, tuple, tuple], expressions: dict, places: dict, several: list, most: int, size: int = 1 << 17) -> Callable:
    """``doc_id, pairs`` of all features that hang on tokens, of batches of an annotator's table."""
    count = token_counter(grams, labels, expressions, places, several, most)

    def run(batches):
        for b in blocks(batches, size):
            count(b, t := Tally(b.docs))
            yield t.batch(b.ids)

    return run


CHARACTERS = 1 << 19


def slices(batches: Iterator[pa.RecordBatch], most: int = CHARACTERS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of ``doc_id, text, ...`` whose texts have about ``most`` characters together, one row at least; and their texts."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")), at + 1)
            rows = batch.slice(at, stop - at)
            yield rows, [x or "" for x in rows.column("text").to_pylist()]
            at = stop


def character_lists(grams: dict[str, int], low: int, high: int) -> Callable:
    """FEA1-2: ``doc_id, text, indices, values`` of ``doc_id, text``: the share of what stands in quotes, and shares of
    n-grams (places by n-gram), each of all runs of ``low`` to ``high`` characters."""
    trie = R.CharacterGrams(grams)

    def run(batches):
        for rows, texts in slices(batches):
            t, all_ = Tally(len(texts)), np.arange(len(texts))
            folded = R.casefolded(texts)
            size = np.fromiter(map(len, folded), np.int64, len(texts))
            owner, place, times = trie.counts(folded)
            t.found.append((owner, place, times / sum(np.maximum(size - n + 1, 0) for n in range(low, high + 1))[owner]))
            t.put("quote_ratio", all_, 0, np.array([R.quoted_share(x) for x in texts]))
            lists = t.lists(rows.column("doc_id"))
            yield pa.RecordBatch.from_arrays([lists["doc_id"], rows.column("text"), lists["indices"], lists["values"]], ["doc_id", "text", "indices", "values"])

    return run


def text_counter(annotate: Callable[[list[str]], tuple[np.ndarray, pa.Table]], *known) -> Callable:
    """``doc_id, indices, values`` of ``doc_id, text, indices, values``: what hangs on tokens is added to what is there.
    ``known`` as ``token_counter`` has it."""
    count = token_counter(*known)

    def run(batches):
        for rows, texts in slices(batches):
            owner, tokens = annotate(texts)
            count(Block(tokens, owner, len(texts)), t := Tally(len(texts)))
            there = pc.list_value_length(rows.column("indices")).to_numpy(zero_copy_only=False)
            t.found.append((np.repeat(np.arange(len(texts)), there), pc.list_flatten(rows.column("indices")).to_numpy(), pc.list_flatten(rows.column("values")).to_numpy()))
            yield t.lists(rows.column("doc_id"))

    return run


def pair_counter(annotate: Callable[[list[str]], tuple[np.ndarray, pa.Table]]) -> Callable:
    """``family, gram, n`` of ``doc_id, text``: documents by pair of tags in a row (``tag``), and edges by their labels
    (``node``), relations and both."""

    def run(batches):
        for _, texts in slices(batches):
            owner, tokens = annotate(texts)
            yield pair_counts(Block(tokens, owner, len(texts)))

    return run


def pair_counts(b: Block) -> pa.RecordBatch:
    (tag, tags), (label, labels), (relation, relations) = ((code, kinds.to_pylist()) for code, kinds in map(b.codes, ("tag", "label", "relation")))
    pair = (b.owner[1:] == b.owner[:-1]) & (tag[1:] >= 0) & (tag[:-1] >= 0)
    size, above = len(tags) + 1, b.above()
    by_document = np.unique(b.owner[1:][pair] * size**2 + tag[:-1][pair] * size + tag[1:][pair])
    values, times = np.unique(by_document % size**2, return_counts=True)
    rows, n = [("tag", f"{tags[v // size]} {tags[v % size]}") for v in values.tolist()], times.tolist()
    child = np.flatnonzero((above >= 0) & (label >= 0) & (label[above] >= 0) & (relation >= 0))
    wide, edge = len(labels) + 1, len(relations) + 1
    values, times = np.unique((label[above[child]] * edge + relation[child]) * wide + label[child], return_counts=True)
    for v, c in zip(values.tolist(), times.tolist()):
        up, r, low = labels[v // wide // edge], relations[v // wide % edge], labels[v % wide]
        rows += [("node", f"{up} {low}"), ("relation", r), ("both", f"{up} {r} {low}")]
        n += [c] * 3
    family, gram = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(family, pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], ["family", "gram", "n"])
