"""Geometry of pages: words aligned to segments, outlines of segments, positions on a heatmap.

Words are ``doc, page, ord, block, line, x0, y0, x1, y1, word``; segments ``doc, seg, text``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from scriptorium.session import bounded_batches, cut, few

from .tallies import slices

GAP, PADDING, CLOSE = 12.0, 1.0, 2.0  # fixed values, in pixels: steps that are smoothed, padding, heights that are one
WIDTH, STRIP, HIGHEST = 56, 16, 2000  # of a heatmap: drawing and indicator strip, cap of the height

PLACED = "doc long, seg int, page int, ord int, block int, line int, x0 double, y0 double, x1 double, y1 double"


# Quotes made plain, and what else normalised text leaves out besides white space.
PLAIN = [("’", "'"), ("“", '"'), ("”", '"'), *((c, "") for c in "\ufeff-‐‑‒–—")]


def plain(text: str) -> str:
    """CLN10 for one text, without a pattern: white space goes by splitting at it."""
    if text.isascii():
        return "".join(text.split()).replace("-", "")
    text = unicodedata.normalize("NFKC", text)
    for old, new in PLAIN:
        text = text.replace(old, new)
    return "".join(text.split())


def placed(words: list[tuple], segments: list[str], full: str, removed: list[tuple[int, int]]) -> list[tuple]:
    """GEO1 for one document: (number of the segment, place of the word, part of the word's width from,
    to). Both texts are walked by a cursor each: words that the full text doesn't go on with, and
    words in removed ranges, are passed over; a word across the end of a segment is split by its
    characters; what the segment doesn't go on with is left out."""
    out, cursor, seg, inside = [], 0, 0, 0
    texts = [plain(s) for s in segments]
    for place, word in words:
        w = plain(word)
        if seg >= len(texts) or not w or not full.startswith(w, cursor):
            continue
        a, cursor = cursor, cursor + len(w)
        if any(x < cursor and a < y for x, y in removed):
            continue
        rest = len(texts[seg]) - inside
        if len(w) <= rest:
            if not texts[seg].startswith(w, inside):
                continue
            out.append((seg, place, 0.0, 1.0))
            inside += len(w)
            if inside == len(texts[seg]):
                seg, inside = seg + 1, 0
        elif seg + 1 < len(texts) and texts[seg][inside:] == w[:rest] and texts[seg + 1].startswith(w[rest:]):
            out += [(seg, place, 0.0, rest / len(w)), (seg + 1, place, rest / len(w), 1.0)]
            seg, inside = seg + 1, len(w) - rest
    return out


def by_cursor(words: DataFrame, segments: DataFrame, texts: DataFrame, removed: DataFrame) -> DataFrame:
    """GEO1 for documents whose texts differ somewhere: a document is one task's work, as a cursor runs through it."""
    ranges = removed.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("removed"))
    listed = segments.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda s: s["text"]).alias("segments"))
    side = texts.join(listed, "doc").join(ranges, "doc", "left").select(F.col("doc").alias("of"), "full", "segments", "removed")

    def run(key, boxes: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(side):
            boxes = boxes.sort_values(["page", "ord"], kind="stable").reset_index(drop=True)
            gone = [(r["start"], r["stop"]) for r in (side["removed"][0] if side["removed"][0] is not None else [])]
            for seg, k, a, b in placed(list(enumerate(boxes["word"])), list(side["segments"][0]), side["full"][0], gone):
                r = boxes.iloc[k]
                wide = r["x1"] - r["x0"]
                rows.append((key[0], seg, r["page"], r["ord"], r["block"], r["line"], r["x0"] + a * wide, r["y0"], r["x0"] + b * wide, r["y1"]))
        return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in PLACED.split(", ")])

    return words.groupBy("doc").cogroup(side.groupBy("of")).applyInPandas(run, PLACED)


BOX = ("page", "ord", "block", "line", "x0", "y0", "x1", "y1", "word")


def together(words: DataFrame, segments: DataFrame, texts: DataFrame, removed: DataFrame) -> DataFrame:
    """The four tables as a row for each document that has a text and segments: ``doc, boxes, segments, full, removed``,
    with its words, segments and removed ranges as arrays in order."""
    listed = lambda df, name, *cols: df.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    whole = texts.groupBy("doc").agg(F.max("full").alias("full")).join(listed(segments, "segments", "seg", "text"), "doc")
    return whole.join(listed(words, "boxes", *BOX), "doc", "left").join(listed(removed, "removed", "start", "stop"), "doc", "left")


def apart(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The way back: words, segments, texts and removed ranges of rows as ``together`` gives them."""
    rows = lambda c: docs.select("doc", F.explode(c).alias("x")).select("doc", "x.*")
    return rows("boxes"), rows("segments"), docs.select("doc", "full"), rows("removed")


def aligned(words: DataFrame, segments: DataFrame, texts: DataFrame, removed: DataFrame) -> DataFrame:
    """GEO1: the boxes of words (or parts of them) by segment. ``texts`` is ``doc, full`` (normalised),
    ``removed`` is ``doc, start, stop`` in it. See ``aligned_rows``."""
    return aligned_rows(together(words, segments, texts, removed))


def aligned_rows(docs: DataFrame) -> DataFrame:
    """GEO1 of documents as ``together`` has them: a row for each word (or part) in a segment.

    Where the words give the text and what is left of them the segments, a word's place is the sum of
    the lengths before it, and words meet segments as intervals. That is worked out inside the document's
    row, so no word is shuffled or kept. Only documents where something differs go through the cursor.
    """
    boxed, odd = met_rows(docs)
    return boxed.select("doc", F.explode_outer("met").alias("x")).filter("x IS NOT NULL").select("doc", "x.*").unionByName(by_cursor(*apart(odd)))


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are formed once a row. (A generator, as Spark would write a projection's arrays out inside
    the functions over elements, and form them again for each.)"""
    once = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("once")
    return df.select(*[c for c in df.columns if c not in columns], once).select(*[c for c in df.columns if c not in columns], "once.*")


def met_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc, met`` with the boxes by segment as an array, empty for odd documents; and the rows of the odd ones."""
    bounded_batches(docs.sparkSession)
    pick = lambda a, c: F.transform(F.col(a), lambda x: x[c])
    held = bound(docs, boxes=F.col("boxes"), segments=F.col("segments"))
    met = held.select("*", meeting(pick("boxes", "word"), pick("segments", "text"), F.col("full"), F.col("removed").cast("array<struct<start:bigint,stop:bigint>>")).alias("m"))
    numbers = cut(met.filter("m.odd").select("doc"))

    def box(h):
        b, wide = F.get("boxes", h["place"]), lambda b: b["x1"] - b["x0"]
        return F.struct(
            F.get("segments", h["of"])["seg"].cast("int").alias("seg"), b["page"].cast("int").alias("page"), b["ord"].cast("int").alias("ord"), b["block"].cast("int").alias("block"), b["line"].cast("int").alias("line"),
            (b["x0"] + h["a"] * wide(b)).alias("x0"), b["y0"].alias("y0"), (b["x0"] + h["b"] * wide(b)).alias("x1"), b["y1"].alias("y1"),
        )

    return met.select("doc", F.transform("m.hits", box).alias("met")), docs.join(few(numbers), "doc", "left_semi")


def plain_all(texts: pa.Array) -> pa.Array:
    """CLN10 of an array; nulls as empty ones. All at once with a character between them that stays and goes with no other."""
    kinds = texts.dictionary_encode()
    some = kinds.dictionary.to_numpy(zero_copy_only=False).tolist()
    if (whole := "\0".join(some)).count("\0") == len(some) - 1:
        made = plain(whole).split("\0")
    else:
        made = [plain(t) for t in some]
    return pc.fill_null(pa.array(made, pa.string()).take(kinds.indices), "")


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of an array of lists (null: an empty one) and where each list begins, with the end at last."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(lists), np.append(0, np.cumsum(sizes))


def _sums(n: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Running sums of each list's elements."""
    upto = np.append(0, np.cumsum(n))
    return upto[1:] - np.repeat(upto[begins[:-1]], np.diff(begins))


HIT = Y.StructType([Y.StructField("place", Y.IntegerType()), Y.StructField("of", Y.IntegerType()), Y.StructField("a", Y.DoubleType()), Y.StructField("b", Y.DoubleType())])


@F.arrow_udf(Y.StructType([Y.StructField("odd", Y.BooleanType()), Y.StructField("hits", Y.ArrayType(HIT))]))
def meeting(words: pa.Array, segments: pa.Array, full: pa.Array, removed: pa.Array) -> pa.Array:
    """Of a batch of documents: whether the cursor is needed, and else which word (or part of its width, from and to)
    lies in which segment, by places in their lists.

    It is needed where the words in order are no beginning of the text, or what is kept of them and the segments
    differ before one of them ends, or a segment is empty, or a word goes on beyond the last segment. A word over two
    segments that ends with the second leaves the cursor there, and the next word's box is cut at no width.
    """
    (raw, at), (raw_segments, seg_at) = _flat(words), _flat(segments)
    odd, counts, place, of, a, b = met(raw, at, raw_segments, seg_at, full, removed)
    hits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(of.astype(np.int32)), pa.array(a), pa.array(b)], ["place", "of", "a", "b"]))
    return pa.StructArray.from_arrays([pa.array(odd), hits], ["odd", "hits"])


def met(words: pa.Array, at: np.ndarray, segments: pa.Array, seg_at: np.ndarray, full: pa.Array, removed: pa.Array) -> tuple[np.ndarray, ...]:
    """``odd, counts`` by document, and its hits one after the other: ``place, of, a, b`` as ``meeting`` has them. ``at`` and
    ``seg_at`` are where each document's words and segments begin, with the end at last."""
    said, segs = plain_all(words), plain_all(segments)
    joined = lambda begins, parts: pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), parts), "").to_pylist()
    length = lambda parts: pc.utf8_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    n, size, docs = length(said), length(segs), len(full)
    whole, stop, gone = joined(at, said), _sums(n, at), np.zeros(len(n), bool)
    for d, ranges in enumerate(removed.to_pylist()):
        mine = slice(at[d], at[d + 1])
        for r in ranges or []:
            if r["start"] is not None and r["stop"] is not None and r["stop"] >= r["start"]:
                gone[mine] |= (stop[mine] - n[mine] < r["stop"]) & (r["start"] < stop[mine])
    rest = joined(at, pc.if_else(pa.array(gone), "", said)) if gone.any() else whole
    n = np.where(gone, 0, n)
    there = joined(seg_at, segs)
    total, longest = np.array([len(t) for t in there], np.int64), np.array([len(t) for t in rest], np.int64)
    base = np.append(0, np.cumsum(np.maximum(total, longest) + 1))[:-1]  # documents one after the other, with a place between them
    owner = np.repeat(np.arange(docs), np.diff(at))
    stop, seg_stop = _sums(n, at) + base[owner], _sums(size, seg_at) + np.repeat(base, np.diff(seg_at))
    start, seg_start = stop - n, seg_stop - size
    first = np.minimum(np.searchsorted(seg_stop, start, "right"), seg_at[1:][owner])
    last = np.minimum(np.searchsorted(seg_start, stop, "left"), seg_at[1:][owner])
    meets = np.where(n > 0, np.maximum(last - first, 0), 0)
    final = np.append(seg_stop, -1)[np.maximum(last - 1, 0)]
    end = base[owner] + total[owner]
    wrong = (meets > 2) | ((meets == 2) & (stop == final)) | ((n > 0) & (start < end) & (stop > end))
    odd = np.bincount(owner[wrong], minlength=docs) > 0
    odd |= np.bincount(np.repeat(np.arange(docs), np.diff(seg_at))[size == 0], minlength=docs) > 0
    odd |= [t is None or not t.startswith(w) or not (s.startswith(r) or r.startswith(s)) for t, w, s, r in zip(full.to_pylist(), whole, there, rest)]
    meets = np.where(odd[owner], 0, meets)
    word = np.repeat(np.arange(len(n)), meets)
    seg = np.repeat(first - np.append(0, np.cumsum(meets))[:-1], meets) + np.arange(len(word))
    share = lambda x: (x - start[word]) / n[word]
    counts = np.bincount(owner, meets, minlength=docs).astype(np.int64)
    return odd, counts, word - at[owner[word]], seg - seg_at[owner[word]], share(np.maximum(start[word], seg_start[seg])), share(np.minimum(stop[word], seg_stop[seg]))


def line_bounds(boxes: DataFrame) -> DataFrame:
    """GEO2, first part: ``top, bottom, left, right`` of each line of a segment on a page: from the
    leftmost word's left edge to the last word's right one; lines that run backwards are dropped."""
    out = boxes.groupBy("doc", "seg", "page", "block", "line").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.min("x0").alias("left"), F.max_by("x1", F.struct("x0", "ord")).alias("right"))
    return out.filter(F.col("right") >= F.col("left"))


def smoothed(points: list[tuple[float, float]], left: bool, gap: float = GAP) -> list[tuple[float, float]]:
    """GEO3: a side of an outline with small steps taken out. The smallest step goes first: its inner
    point, and the inner point's neighbour on the same vertical, move to the outer one. Then points
    that nearly repeat are dropped, and both ends of a step get their mean height."""
    x, y = [p[0] for p in points], [p[1] for p in points]
    outer = min if left else max
    for _ in range(2 * len(x)):
        step, i = min([(abs(b - a), i) for i, (a, b) in enumerate(pairwise(x)) if a != b], default=(gap + 1, 0))
        if step > gap:
            break
        to = outer(x[i], x[i + 1])
        inner, beyond = (i, i - 1) if x[i] != to else (i + 1, i + 2)
        if 0 <= beyond < len(x) and x[beyond] == x[inner]:
            x[beyond] = to
        x[inner] = to
    kept: list[list[float]] = []
    for p in zip(x, y):
        if not kept or p[0] != kept[-1][0] or abs(p[1] - kept[-1][1]) >= CLOSE:
            kept.append(list(p))
    for a, b in pairwise(kept):
        if a[0] != b[0]:
            a[1] = b[1] = (a[1] + b[1]) / 2
    return [tuple(p) for p in kept]


def outline(lines: list[tuple[float, float, float, float]], width: float, height: float, padding: float = PADDING, gap: float = GAP) -> list[tuple[float, float]]:
    """GEO2 for one segment on a page: down the left ends of its lines and up the right ones, as shares
    of the page, padded away from the centre and held to the page."""
    left, right = [], []
    for top, bottom, x, _ in lines:
        if not left or bottom > left[-1][1]:
            left += [(x, top), (x, bottom)]
    for top, bottom, _, x in reversed(lines):
        if not right or top < right[-1][1]:
            right += [(x, bottom), (x, top)]
    left, right = smoothed(left, True, gap), smoothed(right, False, gap)
    for a, i, b, j in ((left, -1, right, 0), (left, 0, right, -1)):
        mean = (a[i][1] + b[j][1]) / 2
        a[i], b[j] = (a[i][0], mean), (b[j][0], mean)
    xs, ys = zip(*((x / width, y / height) for x, y in left + right))

    def wide(v, size):
        centre, scale = sum(v) / len(v), 1 + 2 * padding / max((max(v) - min(v)) * size, 1e-6)
        return [min(1.0, max(0.0, centre + (x - centre) * scale)) for x in v]

    return list(zip(wide(xs, width), wide(ys, height)))


def outlines(boxes: DataFrame, pages: DataFrame, padding: float = PADDING, gap: float = GAP) -> DataFrame:
    """GEO2: ``doc, seg, page, polygon`` from boxes of words and ``doc, page, width, height``."""
    return drawn(line_bounds(boxes), pages, padding, gap)


def line_bounds_rows(docs: DataFrame) -> DataFrame:
    """GEO2, first part, of documents as ``together`` has them: lines are folded inside the document's row, where those
    of ``line_bounds`` are grouped. Odd documents' boxes are grouped."""
    boxed, odd = met_rows(docs)
    keys = lambda x: F.struct(x["seg"].alias("seg"), x["page"].alias("page"), x["block"].alias("block"), x["line"].alias("line"))
    box = lambda x: F.struct(keys(x).alias("k"), x["x0"].alias("x0"), x["ord"].alias("ord"), x["x1"].alias("x1"), x["y0"].alias("y0"), x["y1"].alias("y1"))
    rows = bound(boxed.select("doc", "met"), b=F.array_sort(F.transform("met", box))).drop("met").filter(F.size("b") > 0)
    starts = F.filter(F.transform("b", lambda x, i: F.when((i == 0) | (x["k"] != F.get("b", F.greatest(i - 1, F.lit(0)))["k"]), i)), lambda i: i.isNotNull())
    found = bound(rows, s=starts)

    def line(i, j):
        k, own = F.get("b", i)["k"], F.slice("b", i + 1, F.coalesce(F.get("s", j + 1), F.size("b")) - i)
        of = lambda c: F.transform(own, lambda x: x[c])
        return F.struct(*[k[c].alias(c) for c in ("seg", "page", "block", "line")], F.array_min(of("y0")).alias("top"), F.array_max(of("y1")).alias("bottom"), F.get("b", i)["x0"].alias("left"), F.element_at(own, -1)["x1"].alias("right"))

    found = found.select("doc", F.explode_outer(F.transform("s", line)).alias("x")).filter("x IS NOT NULL").select("doc", "x.*").filter(F.col("right") >= F.col("left"))
    return found.unionByName(line_bounds(by_cursor(*apart(odd))))


def drawn(bounds: DataFrame, pages: DataFrame, padding: float = PADDING, gap: float = GAP) -> DataFrame:
    """GEO2, second part: ``doc, seg, page, polygon`` of lines' bounds."""
    lines = bounds.groupBy("doc", "seg", "page").agg(F.array_sort(F.collect_list(F.struct("top", "block", "line", "bottom", "left", "right"))).alias("lines"))

    @F.pandas_udf("array<array<double>>")
    def draw(lines: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([[list(p) for p in outline([(r["top"], r["bottom"], r["left"], r["right"]) for r in rows], w, h, padding, gap)] for rows, w, h in zip(lines, width, height)])

    return lines.join(pages, ["doc", "page"]).select("doc", "seg", "page", draw("lines", F.col("width").cast("double"), F.col("height").cast("double")).alias("polygon"))


@dataclass
class Pages:
    """Documents of a block: their words by page and place, a box each, on pages of ``width`` and ``height`` (by word); their
    segments in order; normalised texts and removed ranges (lists of ``start, stop``). ``at`` and ``seg_at`` are where each
    one's words and segments begin, with the end at last."""

    doc: pa.Array
    at: np.ndarray
    word: pa.Array
    page: np.ndarray
    ord: np.ndarray
    block: np.ndarray
    line: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    width: np.ndarray
    height: np.ndarray
    seg_at: np.ndarray
    seg: np.ndarray
    text: pa.Array
    full: pa.Array
    removed: pa.Array


def in_order(keys: list[np.ndarray]) -> np.ndarray | slice:
    """The order by ``keys``, the first one counting most; all as it stands if it is the order already."""
    less, same = np.zeros(max(len(keys[0]) - 1, 0), bool), np.ones(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        less |= same & (k[:-1] < k[1:])
        same &= k[:-1] == k[1:]
    return slice(None) if (less | same).all() else np.lexsort(keys[::-1])


def turns(keys: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before."""
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))[: len(keys[0])])


def drawn_pages(p: Pages, padding: float = PADDING, gap: float = GAP) -> pa.RecordBatch:
    """GEO1-3 of a block: ``doc, seg, page, polygon``. Documents where something differs go through the cursor."""
    odd, counts, place, of, a, b = met(p.word, p.at, p.text, p.seg_at, p.full, p.removed)
    owner = np.repeat(np.arange(len(counts)), counts)
    more = []
    for d in np.flatnonzero(odd & (np.diff(p.at) > 0)).tolist():
        gone = [(r["start"], r["stop"]) for r in p.removed[d].as_py() or []]
        words, segs = p.word.slice(p.at[d], p.at[d + 1] - p.at[d]).to_pylist(), p.text.slice(p.seg_at[d], p.seg_at[d + 1] - p.seg_at[d]).to_pylist()
        more += [(d, k, seg, x, y) for seg, k, x, y in placed(list(enumerate(words)), segs, p.full[d].as_py() or "", gone)]
    if more:
        columns = [np.array(x) for x in zip(*more)]
        owner, place, of, a, b = (np.append(x, y) for x, y in zip((owner, place, of, a, b), columns))
    at = p.at[owner] + place
    seg, wide = p.seg[p.seg_at[owner] + of], p.x1[at] - p.x0[at]
    keys, x0, x1 = [owner, seg, p.page[at], p.block[at], p.line[at]], p.x0[at] + a * wide, p.x0[at] + b * wide
    order = in_order([*keys, x0, p.ord[at]])
    keys, x0, x1, at = [k[order] for k in keys], x0[order], x1[order], at[order]
    if not len(at):
        return pa.RecordBatch.from_arrays([p.doc.slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.list_(pa.list_(pa.float64())))], ["doc", "seg", "page", "polygon"])
    first = turns(keys)
    last, left = np.append(first[1:], len(at)) - 1, x0[first]
    right, top, bottom = x1[last], np.minimum.reduceat(p.y0[at], first), np.maximum.reduceat(p.y1[at], first)
    some = right >= left
    owner, seg, page, block, line = (k[first][some] for k in keys)
    top, bottom, left, right, at = top[some], bottom[some], left[some], right[some], at[first][some]
    order = in_order([owner, seg, page, top, block, line])
    owner, seg, page, top, bottom, left, right, at = (x[order] for x in (owner, seg, page, top, bottom, left, right, at))
    first = turns([owner, seg, page])
    lines, polygons = list(zip(top.tolist(), bottom.tolist(), left.tolist(), right.tolist())), []
    drawn: dict[tuple, list] = {}  # the same lines have the same outline
    for i, j, w, h in zip(first.tolist(), np.append(first[1:], len(owner)).tolist(), p.width[at[first]].tolist(), p.height[at[first]].tolist()):
        key = (*lines[i:j], w, h)
        if (polygon := drawn.get(key)) is None:
            polygon = drawn[key] = outline(lines[i:j], w, h, padding, gap)
        polygons.append(polygon)
    flat = np.array([x for polygon in polygons for point in polygon for x in point], np.float64)
    sizes = np.append(0, np.cumsum(np.fromiter(map(len, polygons), np.int64, len(polygons))))
    points = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2), pa.int32()), pa.array(flat))
    return pa.RecordBatch.from_arrays([p.doc.take(pa.array(owner[first])), pa.array(seg[first].astype(np.int32)), pa.array(page[first].astype(np.int32)), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), points)], ["doc", "seg", "page", "polygon"])


def outlined(docs: DataFrame, read: Callable[[pa.RecordBatch], Pages], padding: float = PADDING, gap: float = GAP) -> DataFrame:
    """GEO2 inside tasks: ``doc, seg, page, polygon`` of documents, a row each. ``read`` makes the pages of some rows, so no word,
    line or polygon is shuffled or kept, and a document is worked off once, odd or not. ``docs`` has ``doc, text`` first; rows
    without a document's number have no outlines."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for rows, _ in slices([batch]):
                yield drawn_pages(read(rows), padding, gap)

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.filter("doc IS NOT NULL").mapInArrow(run, f"doc {kind}, seg int, page int, polygon array<array<double>>")


def clamped(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def heatmap_pixel(x: Column, y: Column, page: Column, aspect: float, width: float, height: Column | float, pages: Column | int) -> Column:
    """GEO4: struct of canvas x and y; null beyond the last page."""
    tall = F.lit(float(aspect * width))
    place = F.struct(clamped(x * width, 0.0, float(width)).alias("x"), clamped(page * tall + y * tall, 0.0, height if isinstance(height, Column) else float(height)).alias("y"))
    return F.when(page < (pages if isinstance(pages, Column) else F.lit(pages)), place)


def viewport(scroll: Column, total: Column, seen: Column) -> Column:
    """GEO5: share and pixels of the top and height of what is seen; zeros without a height."""
    share = lambda c: F.when(total > 0, clamped(F.try_divide(c, total), 0.0, 1.0)).otherwise(0.0)
    return F.struct(share(scroll).alias("top"), share(seen).alias("height"), (share(scroll) * total).alias("top_pixels"), (share(seen) * total).alias("height_pixels"))


def inverse_pixel(x: Column, y: Column, width: Column, height: Column) -> Column:
    """GEO5: canvas pixels as shares; zeros without a canvas."""
    ok = (width > 0) & (height > 0)
    part = lambda v, size: F.when(ok, clamped(F.try_divide(clamped(v, 0.0, size), size), 0.0, 1.0)).otherwise(0.0)
    return F.struct(part(x, width).alias("x"), part(y, height).alias("y"))


def opacity(score: Column) -> Column:
    """GEO5: from 0.05 to 0.8 by score."""
    return 0.05 + (0.8 - 0.05) * score


def page_rows(highlights: DataFrame) -> DataFrame:
    """GEO6: ``id, page, polygon, score`` of scored highlights, ordered; empty polygons are dropped."""
    rows = highlights.filter("score IS NOT NULL").select("id", "score", F.explode("polygons").alias("page", "polygon"))
    return rows.filter(F.size("polygon") > 0).select("id", "page", "polygon", "score").orderBy("page", "id", "score")


def boxes(highlights: DataFrame, pages: DataFrame) -> DataFrame:
    """GEO8: polygons at the size of their page with bounding box (a pixel wider, one at least) and
    whether the highlight is on several pages. Pages that aren't shown have none."""
    rows = highlights.select("id", (F.size("polygons") > 1).alias("siblings"), F.explode("polygons").alias("page", "polygon")).filter(F.size("polygon") > 0).join(pages, "page")
    xs, ys = F.transform("polygon", lambda p: p[0] * F.col("width")), F.transform("polygon", lambda p: p[1] * F.col("height"))
    span = lambda v: F.greatest(F.array_max(v) - F.array_min(v), F.lit(1.0)) + 1
    return rows.select("id", "page", "siblings", F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), span(xs).alias("w"), span(ys).alias("h"))


def page_count(highlights: DataFrame, rendered: int) -> Column:
    """GEO10 as an aggregate over ``polygons``: the pages rendered or mentioned, one at least."""
    last = F.max(F.coalesce(F.array_max(F.map_keys("polygons")), F.lit(-1)))
    return F.greatest(F.coalesce(last, F.lit(-1)) + 1, F.lit(rendered), F.lit(1)).cast("int")


def canvas(highlights: DataFrame, rendered: int, aspect: float, width: int = WIDTH - STRIP, highest: int = HIGHEST) -> DataFrame:
    """GEO10: one row of ``pages, virtual_height, height, scale``."""
    virtual = F.ceil(F.col("pages") * aspect * width).cast("double")
    return highlights.agg(page_count(highlights, rendered).alias("pages")).select("pages", virtual.alias("virtual_height"), F.least(virtual, F.lit(float(highest))).alias("height"), F.when(virtual > 0, F.least(virtual, F.lit(float(highest))) / virtual).otherwise(1.0).alias("scale"))


def markers(highlights: DataFrame, editors: DataFrame, rendered: int, aspect: float, width: int = WIDTH - STRIP, highest: int = HIGHEST) -> DataFrame:
    """GEO9: ``id, page, y, has_image`` of open editors: the mean point of the first page that has a
    polygon, on the capped canvas."""
    size = F.broadcast(canvas(highlights, rendered, aspect, width, highest))
    first = highlights.select("id", F.explode("polygons").alias("page", "polygon")).filter(F.size("polygon") > 0).groupBy("id").agg(F.min(F.struct("page", "polygon")).alias("p")).select("id", "p.*")
    mean = lambda k: clamped(F.aggregate("polygon", F.lit(0.0), lambda a, p: a + p[k]) / F.size("polygon"), 0.0, 1.0)
    at = heatmap_pixel(mean(0), mean(1), F.col("page"), aspect, width, F.col("virtual_height"), F.col("pages"))
    return first.join(editors, "id").crossJoin(size).select("id", "page", (at["y"] * F.col("scale")).alias("y"), F.coalesce("has_image", F.lit(False)).alias("has_image")).filter("y IS NOT NULL")
