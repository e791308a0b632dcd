"""Sampled segmentations against all segmentations of short texts, and lossless decoding of odd ones."""

from collections import Counter

import numpy as np

from scriptorium.llm import lattice as M

V = M.vocabulary()
N = 20_000


def ways(text: bytes, weight: dict[bytes, tuple[int, float]]):
    """Every segmentation into pieces, as ids, with the product of weights."""
    if not text:
        yield (), 1.0
    for k in range(1, len(text) + 1):
        if text[:k] in weight:
            i, w = weight[text[:k]]
            for rest, x in ways(text[k:], weight):
                yield (i, *rest), w * x


def test_samples_follow_the_weights():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=M.MODEL)
    weight = {V.spelling[i]: (int(i), float(w)) for i, w in zip(V.ids, V.weights) if not sp.is_byte(int(i))}
    lattices = M.Lattices(V)
    for text in (" there", "  an", "aaaa"):
        p = Counter()
        for ids, w in ways(text.encode(), weight):
            p[ids] += w
        total = sum(p.values())
        ids, edge = lattices.sample([text] * N, M.row_keys(list(range(N)), 1))
        got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:]))
        assert set(got) <= set(p)
        assert all(abs(got[k] / N - w / total) < 5 * np.sqrt(w / total / N) + 1e-3 for k, w in p.items()), text


def test_lossless_and_independent_of_blocks():
    texts = ["hello  world", "", " a", "▁x 中文字符串没有空格" * 3, "a" * 3000, "   " * 50 + "x", "naïve \n\t tab", "q" * 70_000, "ab " * 40_000]
    keys = M.row_keys(list(range(len(texts))), 1)
    ids, edge = M.Lattices(V).sample(texts, keys)
    for k, t in enumerate(texts):
        part = ids[edge[k] : edge[k + 1]]
        assert b"".join(V.spelling[i] for i in part).decode() == t
        alone, _ = M.Lattices(V).sample([t], keys[k : k + 1])
        assert alone.tolist() == part.tolist()


def test_pieces_of_several_spaces_are_drawn():
    ids, _ = M.Lattices(V).sample([" " * 64] * 50, M.row_keys(list(range(50)), 1))
    assert any(len(V.spelling[i]) > 1 for i in ids)
