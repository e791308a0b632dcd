"""Annotators that run inside tasks, as numpy and Arrow over a block of whole texts: tokens, and what hangs on a word alone.

An annotator is called with texts and returns the number of each token's text, and the tokens as a table. Labels are
dictionary arrays, so what is said of a word is formed once for each different word of a block.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scriptorium.functions import text as T

TITLE = r"^\P{L}*(\p{Lu}\p{Ll}*)(\P{L}+\p{Lu}\p{Ll}*)*\P{L}*$"
APART, WORD, OTHER = 0, 1, 2


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, once in a process. (Functions travel to the tasks by value, so what a module holds is new in each
    task, and nothing here may need the package there.)"""
    held = vars(sys).setdefault("_scriptorium_kept", {})
    if key not in held:
        held[key] = make()
    return held[key]


def classes() -> np.ndarray:
    return kept("classes", _classes)


def _classes() -> np.ndarray:
    """Of each code point, by the engine of SQL's patterns: letters, numbers and apostrophes make words, spaces part them, any
    other character is a token."""
    made, points = np.full(0x110000, OTHER, np.uint8), np.append(np.arange(0xD800), np.arange(0xE000, 0x110000))
    said = pa.array([chr(k) for k in points.tolist()])
    for kind, pattern in ((WORD, r"[\p{L}\p{N}']"), (APART, r"\s")):
        made[points[pc.match_substring_regex(said, pattern).to_numpy(zero_copy_only=False)]] = kind
    return made


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a space after each, and where each text begins, with the end at last."""
    raw = np.frombuffer("".join(f"{t} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return raw, np.append(0, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))))


class Tokens:
    """``owner`` (the number of the text), ``pos`` (from 0), ``sentence`` (from 0, each full stop ends one), ``node`` (from
    1 in its sentence) of each token; the different tokens as ``words``, and each one's place there as ``code``."""

    def __init__(self, texts: list[str]):
        raw, begins = characters(texts)
        kind = classes()[raw]
        word, other = kind == WORD, kind == OTHER
        before, after = np.append(False, word[:-1]), np.append(word[1:], False)
        start, stop = np.flatnonzero(word & ~before | other), np.flatnonzero(word & ~after | other) + 1
        first = np.searchsorted(start, begins)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(first))
        self.pos = np.arange(len(start)) - first[self.owner]
        stops = np.append(0, np.cumsum(raw == ord(".")))
        self.sentence = stops[start] - stops[begins[:-1]][self.owner]
        turn = np.append(True, (self.owner[1:] != self.owner[:-1]) | (self.sentence[1:] != self.sentence[:-1]))[: len(start)]
        self.node = np.arange(len(start)) - np.flatnonzero(turn)[np.cumsum(turn) - 1] + 1
        held = raw[kind != APART]
        wide = 1 + (held >= 0x80) + (held >= 0x800) + (held >= 0x10000).astype(np.int64)
        ends = np.append(0, np.cumsum(wide))[np.append(0, np.cumsum(stop - start))]
        data = held.astype(np.uint8).tobytes() if len(held) == ends[-1] else held.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        kinds = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        self.words, self.code = kinds.dictionary, kinds.indices.to_numpy()


class Memory:
    """What ``rule`` says of words (lists to arrays, a value a word; of numbers only), kept from block to block and from task to
    task of a process. It is all forgotten when there are more than ``most`` words."""

    def __init__(self, rule: Callable[[list[str]], dict[str, np.ndarray]], most: int = 1 << 17):
        self.rule, self.most, self.number, self.known = rule, most, {}, {}

    def __call__(self, words: list[str]) -> dict[str, np.ndarray]:
        if len(self.number) > self.most:
            self.number, self.known = {}, {}
        if new := [w for w in words if w not in self.number]:
            made = self.rule(new)
            self.known = {k: np.append(self.known[k], v) for k, v in made.items()} if self.known else made
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return {k: v[at] for k, v in self.known.items()} if self.known else self.rule(words)


def listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def labels(index: np.ndarray, names: list[str] | tuple[str, ...]) -> pa.DictionaryArray:
    return pa.DictionaryArray.from_arrays(pa.array(index.astype(np.int32), mask=index < 0), pa.array(names, pa.string()))


def casefolded(words: list[str]) -> list[str]:
    """LEX3."""
    return [w.lower().replace("ß", "ss") for w in words]


def hits(low: pa.Array, size: np.ndarray, patterns: tuple[str, ...]) -> np.ndarray:
    """As ``text.hits_of``: how many of ``patterns`` match, plain endings as lookups by length."""
    endings: dict[int, list[str]] = {}
    n = np.zeros(len(low), np.int64)
    for p in patterns:
        if p[0] == "." and p[-1] == "$" and p[1:-1].isalpha():
            endings.setdefault(len(p) - 2, []).append(p[1:-1])
        else:
            n += (pc.match_substring(low, p) if p.isalpha() else pc.match_substring_regex(low, p)).to_numpy(zero_copy_only=False)
    for k, found in endings.items():
        n += (size > k) & pc.is_in(pc.utf8_slice_codeunits(low, -k), pa.array(found)).to_numpy(zero_copy_only=False)
    return n


def syllables(words: list[str]) -> np.ndarray:
    """LEX4."""
    low = pa.array([w.lower() for w in words], pa.string())
    size = pc.utf8_length(low).to_numpy(zero_copy_only=False)
    groups = pc.count_substring_regex(low, "[aeiouy]+").to_numpy(zero_copy_only=False).astype(np.int64)
    return np.maximum(groups - hits(low, size, T.SYLLABLE_LESS) + hits(low, size, T.SYLLABLE_MORE), 1)


def cases(words: pa.Array, plain: list[str]) -> np.ndarray:
    """FEA14: 1 lower, 2 upper, 3 title, 0 none of them."""
    lettered = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
    lower, upper = (np.fromiter((w == f(w) for w in plain), bool, len(plain)) for f in (str.lower, str.upper))
    title = pc.match_substring_regex(words, TITLE).to_numpy(zero_copy_only=False)
    return np.where(lettered & lower, 1, np.where(lettered & upper, 2, np.where(title, 3, 0)))


class Alone:
    """LEX2's second and third pass: the value of a word that is still free, by patterns in order, and else by the entry of
    its form or lemma; NaN for none. ``single`` is ``imag, pos_adp, pos_nonadp`` by entry."""

    def __init__(self, patterns: list[tuple[str, float]], single: dict[str, tuple]):
        self.known = repr((patterns, sorted(single.items())))
        self.patterns, self.single = [(re.compile(p), v) for p, v in patterns], single

    def __call__(self, forms: list[str], lemmas: list[str], adposition: np.ndarray) -> np.ndarray:
        out = np.full(len(forms), np.nan)
        for k, (form, lemma, adp) in enumerate(zip(forms, lemmas, adposition.tolist())):
            value = next((v for p, v in self.patterns if p.search(form)), None)
            entry = self.single.get(form) or self.single.get(lemma)
            if value is None and entry:
                imag, with_adp, without = entry
                own = with_adp if adp else without
                value = own if own is not None else imag if with_adp is None and without is None else None
            if value is not None:
                out[k] = value
        return out


def quoted_share(text: str) -> float:
    """FEA1 of one text, 0 of an empty one: an opener closes with its own kind, and one that never does swallows the rest."""
    at, total, next_ = 0, 0, {'"': text.find('"'), "'": text.find("'")}
    while some := [(k, mark) for mark, k in next_.items() if k >= 0]:
        k, mark = min(some)
        close = text.find(mark, k + 1)
        if close < 0:
            break
        total, at = total + close - k - 1, close + 1
        next_ = {m: text.find(m, at) if 0 <= k < at else k for m, k in next_.items()}
    return total / len(text) if text else 0.0


class CharacterGrams:
    """Counts of selected n-grams of characters by a trie: a table of states by letter, 0 is where no n-gram goes on."""

    def __init__(self, grams: dict[str, int]):
        letters = sorted(set("".join(grams)))
        self.digit = np.zeros(0x110000, np.int32)
        self.digit[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.base, self.longest = len(letters) + 1, max(map(len, grams), default=0)
        states = {"": 1} | {p: k + 2 for k, p in enumerate(sorted({g[:n] for g in grams for n in range(1, len(g) + 1)}))}
        table, self.place = np.zeros((len(states) + 1, self.base), np.int32), np.full(len(states) + 1, -1, np.int64)
        for p, k in states.items():
            if p:
                table[states[p[:-1]], self.digit[ord(p[-1])]] = k
        for g, place in grams.items():
            self.place[states[g]] = place
        self.table = table.ravel()

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of the text, the n-gram's place and how often it is there."""
        raw, begins = characters(texts)
        digit = self.digit[raw]
        digit[begins[1:] - 1] = 0  # what separates the texts
        at, state, wide = np.flatnonzero(digit), 1, int(self.place.max(initial=-1)) + 1
        owner, keys = np.repeat(np.arange(len(texts)), np.diff(begins)), []
        for n in range(self.longest):
            at = at[: np.searchsorted(at, len(digit) - n)]
            state = self.table[(state[: len(at)] if n else 1) * self.base + digit[at + n]]
            at, state = at[state > 0], state[state > 0]
            place = self.place[state]
            keys.append((owner[at] * wide + place)[place >= 0])
        kinds, times = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
        return kinds // max(wide, 1), kinds % max(wide, 1), times
