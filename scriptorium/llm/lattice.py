"""SentencePiece with sampled segmentations: forward filtering, backward sampling; lossless decoding.

A text is cut before each run of spaces into segments; a space is the word mark of the pieces. No
piece holds a space after another character, so none matches across such a cut, and runs of spaces
keep their own pieces. The pieces that match form a lattice over a segment, however long it is.
Forward filtering sums the weights of all paths to each position; backward sampling draws the last
piece of a position in proportion to these sums, then goes on from where it starts. The draws depend
on the row's key, the segment's place in the text and the step alone, so they don't change with
partitions, batches or retries. Characters without a piece, and the word mark itself where a text
has it, are spelled in byte pieces; decoding gives the very text back.

A worker's memory doesn't depend on the texts' number or length: lattices are built for a portion of
segments at a time, and the ones kept for words that come again are held to a number of edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, frugal
from .shingles import PLACE, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTES = 0x110000  # byte b is the symbol BYTES + b
#: The model ranks its pieces and has no probabilities. A piece of rank r weighs
#: (1 / (r + FIRST)) ** SHARPNESS, as frequencies by rank do; SCALE per character holds the sums of
#: long segments within floats and cancels out.
FIRST, SHARPNESS, SCALE = 10.0, 1.5, 64.0
HELD = 1 << 21  # edges that a task remembers
PORTION = 1 << 16  # characters whose lattices are built and sampled at a time
RESCALE = 32  # positions after which the sums of a long run are brought back to 1

STEP = 0xD1342543DE82EF95
RADIX = np.uint64(0x100000001B3)
FILTER_BITS = 19


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of the pieces' symbols, sorted
    ids: np.ndarray
    weights: np.ndarray
    lengths: list[int]  # that occur
    single: np.ndarray  # symbols that are pieces, sorted
    filter: np.ndarray  # by the upper bits of a hash: whether a piece may have it
    starts: np.ndarray  # likewise: whether a piece may go on after a run with this hash
    spelling: list[bytes]  # of each id


def rolling(symbols: np.ndarray, longest: int):
    """Hashes of the runs of 1, 2, ... symbols that start at each place."""
    s = symbols.astype(np.uint64) + np.uint64(1)
    h = s.copy()
    for n in range(1, longest + 1):
        if n > 1:
            if n > len(s):
                return
            h = h[:-1] * RADIX + s[n - 1 :]
        yield n, mix(h + np.uint64(n))


def vocabulary(path: str = MODEL) -> Vocabulary:
    """The pieces of a SentencePiece model file (read where this runs: on the driver)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found, spelling = {}, [b""] * sp.get_piece_size()
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte = int(piece[3:5], 16)
            found[(BYTES + byte,)] = (i, len(spelling))
            spelling[i] = bytes([byte])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            text = piece.replace("▁", " ")
            if " " in text.lstrip(" "):
                raise ValueError(f"piece {i} holds a space after another character: segments can't be cut at spaces")
            found[tuple(map(ord, text))] = (i, -sp.get_score(i))
            spelling[i] = text.encode()
    hashes = np.array([list(rolling(np.array(s), len(s)))[-1][1][0] for s in found], np.uint64)
    order = np.argsort(hashes)
    sizes = np.array([len(s) for s in found])
    ranks = np.array([r for _, r in found.values()], float)
    weights = (1 / (ranks + FIRST)) ** SHARPNESS * SCALE**sizes
    may = np.zeros(1 << FILTER_BITS, bool)
    may[hashes >> np.uint64(64 - FILTER_BITS)] = True
    begun = {s[:k] for s in found for k in range(1, len(s))}
    starts = np.zeros(1 << FILTER_BITS, bool)
    starts[np.array([list(rolling(np.array(s), len(s)))[-1][1][0] for s in begun], np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
    single = np.array(sorted(s[0] for s in found if len(s) == 1), np.uint32)
    return Vocabulary(hashes[order], np.array([i for i, _ in found.values()], np.int32)[order], weights[order], sorted(set(sizes.tolist())), single, may, starts, spelling)


class Lattices:
    """The lattices of segments, filtered forward, as one table of edges in order of their end.

    An edge has the cumulated probability of its end node's edges up to it, in 32 bits: of a node's
    edges, the first above u is the one drawn by u.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.longest = max(v.lengths)
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}  # the last node of each segment
        self.edges = self.nodes = 0
        self.first = np.empty(HELD // 4, np.int32)  # edge of each node
        self.cuts, self.starts, self.ids = np.empty(HELD, np.uint32), np.empty(HELD, np.int32), np.empty(HELD, np.int32)

    def put(self, first: np.ndarray, cuts: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
        for name, part, at in (("first", first, self.nodes), ("cuts", cuts, self.edges), ("starts", starts, self.edges), ("ids", ids, self.edges)):
            held = getattr(self, name)
            if at + len(part) > len(held):
                held = np.concatenate([held, np.empty(max(len(held), len(part)), held.dtype)])
                setattr(self, name, held)
            held[at : at + len(part)] = part
        self.nodes += len(first)
        self.edges += len(cuts)

    def add(self, segments: list[str]) -> None:
        v = self.v
        symbols = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(segments), dtype=np.int32), np.fromiter(map(len, segments), np.int64, len(segments)))
        at = np.minimum(np.searchsorted(v.single, symbols), len(v.single) - 1)
        bare = v.single[at] != symbols
        if bare.any():
            kinds, which = np.unique(symbols[bare], return_inverse=True)
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in kinds.tolist()]
            length, begun = np.array([len(x) for x in spelled]), np.cumsum([0, *map(len, spelled)])[:-1]
            times = np.ones(len(symbols), np.int64)
            times[bare] = length[which]
            wide, first = np.repeat(symbols, times), (np.cumsum(times) - times)[bare]
            raw = np.frombuffer(b"".join(spelled), np.uint8).astype(np.uint32)
            for k in range(int(length.max())):
                on = length[which] > k
                wide[first[on] + k] = BYTES + raw[begun[which[on]] + k]
            symbols, owner = wide, np.repeat(owner, times)
        count = np.bincount(owner, minlength=len(segments))
        stop = np.cumsum(count)
        begin = stop - count
        n, limit = len(symbols), np.repeat(stop, count).astype(np.int32)
        src, size_of, which = [], [], []
        spread = symbols.astype(np.uint64) + np.uint64(1)
        at, h = np.arange(n, dtype=np.int32), spread
        for size in range(1, self.longest + 1):
            if size > 1:
                on = v.starts[mixed >> np.uint64(64 - FILTER_BITS)] & (at + size <= limit[at])
                at = at[on]
                h = h[on] * RADIX + spread[at + size - 1]
            mixed = mix(h + np.uint64(size))
            maybe = np.flatnonzero(v.filter[mixed >> np.uint64(64 - FILTER_BITS)])
            k = np.minimum(np.searchsorted(v.hashes, mixed[maybe]), len(v.hashes) - 1)
            hit = v.hashes[k] == mixed[maybe]
            src.append(at[maybe[hit]])
            size_of.append(np.full(len(src[-1]), size, np.int32))
            which.append(k[hit].astype(np.int32))
        src, size_of, which = map(np.concatenate, (src, size_of, which))
        dst = src + size_of - 1
        order = np.argsort(dst, kind="stable")  # runs in order already, one for each size
        src, dst, which = src[order], dst[order], which[order]
        weight = v.weights[which]
        opens = src == begin[owner[src]]
        # Every path passes a node that no edge spans: the sums may start anew there.
        anew = np.cumsum(np.bincount(src, minlength=n) - np.bincount(dst, minlength=n)) == 0
        fresh = np.concatenate([[True], anew[:-1]])
        fresh[begin[count > 0]] = True
        run = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        # Forward: sums of the nodes that are the same number of symbols into their runs.
        sums, depth = np.zeros(n), dst - run[dst]
        by_depth = np.argsort(depth.astype(np.int16) if n < 1 << 15 or depth.max() < 1 << 15 else depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2 if len(depth) else 1))
        part = np.empty(len(src))
        for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            e = by_depth[a:b]
            if len(e) == 0:
                continue
            mass = np.where(fresh[src[e]], 1.0, sums[np.maximum(src[e] - 1, 0)]) * weight[e]
            first = np.flatnonzero(np.concatenate([[True], dst[e[1:]] != dst[e[:-1]]]))
            node = dst[e[first]]
            sums[node] = np.add.reduceat(mass, first)
            part[e] = mass / sums[dst[e]]
            if d % RESCALE == RESCALE - 1:
                whole = sums[node].copy()
                for k in range(min(self.longest, d + 1)):
                    sums[node - k] /= whole
        # Cumulated probabilities, edge by edge of a node, so that they depend on the node alone.
        head = np.concatenate([[True], dst[1:] != dst[:-1]]) if len(dst) else np.empty(0, bool)
        rank = np.arange(len(dst)) - np.maximum.accumulate(np.where(head, np.arange(len(dst)), 0))
        for r in range(1, int(rank.max()) + 1 if len(rank) else 0):
            e = np.flatnonzero(rank == r)
            part[e] += part[e - 1]
        cut = np.minimum(part * 2.0**32, 2.0**32 - 2).astype(np.uint32)
        cut[np.concatenate([head[1:], [True]]) if len(dst) else []] = np.uint32(2**32 - 1)
        for s, last in zip(segments, (stop - 1 + self.nodes).tolist()):
            self.places[s] = last
        self.put(np.flatnonzero(head) + self.edges, cut, np.where(opens, -1, src - 1 + self.nodes), v.ids[which])

    def draw(self, segments: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in order, and the number of each one's."""
        distinct = dict.fromkeys(segments)
        new = [s for s in distinct if s not in self.places]
        if self.edges + 8 * sum(map(len, new)) > HELD and self.edges:
            self.forget()
            new = list(distinct)
        if new:
            self.add(new)
        node = np.fromiter(map(self.places.__getitem__, segments), np.int64, len(segments))
        live, steps, drawn = np.arange(len(segments), dtype=np.int32), np.zeros(len(segments), np.int64), []
        while len(live):
            u = np.minimum(mix(seeds + np.uint64((len(drawn) + 1) * STEP % (1 << 64))) >> np.uint64(32), np.uint64(2**32 - 2)).astype(np.uint32)
            e = self.first[node]
            low = np.flatnonzero(self.cuts[e] <= u)
            while len(low):
                e[low] += 1
                low = low[self.cuts[e[low]] <= u[low]]
            drawn.append((live, self.ids[e]))
            steps[live] += 1
            node = self.starts[e]
            on = node >= 0
            live, node, seeds = live[on], node[on], seeds[on]
        last = np.cumsum(steps)
        out = np.empty(int(last[-1]) if len(last) else 0, np.int32)
        for k, (occurrence, ids) in enumerate(drawn):
            out[last[occurrence] - 1 - k] = ids
        return out, steps

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's begin (one entry more than texts)."""
        parts, count = [], np.zeros(len(texts), np.int64)
        for segments, pieces in portions(texts):
            row, ordinal, size = np.array(pieces, np.int64).T
            within = np.arange(len(segments)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ordinal, size)
            rows = np.repeat(row, size)
            ids, steps = self.draw(segments, mix(keys[rows] + mix(within.astype(np.uint64) * PLACE[0] + PLACE[1])))
            parts.append(ids)
            count += np.bincount(rows, weights=steps, minlength=len(texts)).astype(np.int64)
        return np.concatenate(parts or [np.empty(0, np.int32)]), np.concatenate([[0], np.cumsum(count)])


def segments_of(text: str) -> list[str]:
    """The text cut before each run of spaces."""
    if "  " in text:
        return re.findall(" *[^ ]+| +", text)
    first, *others = text.split(" ")
    return [first, *[" " + p for p in others]] if first else [" " + p for p in others]


def portions(texts: list[str], most: int = PORTION) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    """Segments of about ``most`` characters (of one at least), and the parts of texts that they come
    from as (text, number of the first segment in it, number of segments)."""
    out, pieces, held = [], [], 0
    for row, text in enumerate(texts):
        segments = segments_of(text)
        step = max(1, min(len(segments), most * len(segments) // max(len(text), 1)))
        for at in range(0, len(segments), step):
            part = segments[at : at + step]
            out += part
            pieces.append((row, at, len(part)))
            held += sum(map(len, part)) if step < len(segments) else len(text)
            if held >= most:
                yield out, pieces
                out, pieces, held = [], [], 0
    if out:
        yield out, pieces


def row_keys(ids: list[int | None], seed: int) -> np.ndarray:
    """A number for each row key; null has its own."""
    return mix(np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64) + np.uint64(seed) * PLACE[2] + np.where([i is None for i in ids], PLACE[3], np.uint64(0)))


def encoded(docs: DataFrame, v: Vocabulary, seed: int = 1) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``ids array<int>``: a sampled segmentation.

    A column that is named ids already gives way. Null texts have null ids, empty ones no ids. Rows that share a ``doc_id`` and a text share their
    ids.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(v))
    kept = [c for c in docs.columns if c not in ("text", "ids")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept], "ids array<int>"])

    def run(batches):
        lattices = Lattices(Vocabulary(**shared.value))
        for batch in batches:
            texts = batch.column(-1).to_pylist()
            flat, ends = lattices.sample([t or "" for t in texts], row_keys(batch.column(-2).to_pylist(), seed))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], lists], [*kept, "ids"])

    return docs.select(*kept, F.col("doc_id").cast("long").alias("__key"), F.col("text").alias("__text")).mapInArrow(frugal(run), schema)


def decoded(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """The columns of ``rows`` but ``ids``, and ``text``: exactly what was encoded.

    A column that is named text already gives way. Null ids have a null text, no ids an empty one;
    repeated rows are each returned, and no rows give none.
    """
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(v.spelling)
    kept = [c for c in rows.columns if c not in ("ids", "text")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept], "text string"])

    def run(batches):
        spelling = pa.array(shared.value, pa.binary())
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            pieces = pa.ListArray.from_arrays(ids.offsets, spelling.take(ids.values), mask=ids.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.binary_join(pieces, b"").cast(pa.string())], [*kept, "text"])

    return rows.select(*kept, "ids").mapInArrow(frugal(run), schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document segmented by sampling and decoded: ``doc_id, n_pieces, ids_sha256,
    text_sha256, decoded_sha256, lossless``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    v = vocabulary()
    coded = encoded(docs, v).select("doc_id", "text_sha256", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", ",").cast("string"), 256).alias("ids_sha256"), "ids")
    back = F.sha2("text", 256)
    return decoded(coded, v).select("doc_id", F.coalesce("n_pieces", F.lit(0).cast("long")).alias("n_pieces"), "ids_sha256", "text_sha256", back.alias("decoded_sha256"), F.col("text_sha256").eqNullSafe(back).alias("lossless"))
