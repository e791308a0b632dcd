"""Token ids packed into rows of fixed length by best-fit decreasing.

Each task tokenizes the documents it reads and packs them in windows of bounded size, so nothing is
shuffled and no task holds more than a window. A document longer than a row is cut into full rows
and a rest; nothing is dropped. A packed row is stored as binary columns: its ids (uint16, little
endian, padded), the cumulated lengths of its segments, and positions that restart in each segment.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pattern that belongs to the vocabulary: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256  # ends every document, and pads
ROW = 2048  # ids of a packed row
WINDOW_TOKENS, WINDOW_DOCS = 1 << 21, 1 << 13  # that are packed together at most

PACKED = "pack long, n_tokens long, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, rows array<long>, parts array<int>"


def ranks(path: str = RANKS) -> dict[bytes, int]:
    """A vocabulary file (read where this runs: on the driver)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def tokenizer(vocabulary: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})


class Capacities:
    """A segment tree over free lengths: how many rows have each; finds the least that suffices."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, free: int, n: int) -> None:
        at = free + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def fit(self, need: int) -> int | None:
        """The least free length of at least ``need`` that a row has."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """Rows of item numbers: longest items first (earlier ones first among equals), each into the
    row with the least free length that holds it. No item is longer than ``row``."""
    tree, rows, open_rows = Capacities(row), [], {}
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        free = tree.fit(need)
        if free is None:
            rows.append([])
            at, free = len(rows) - 1, row
        else:
            at = open_rows[free].pop()
            tree.add(free, -1)
        rows[at].append(item)
        if free > need:
            open_rows.setdefault(free - need, []).append(at)
            tree.add(free - need, 1)
    return rows


def pack(docs: list[tuple[int | None, int, np.ndarray]], row: int) -> Iterator[dict]:
    """Packed rows of ``(doc_id, row number, ids)``."""
    items = [(i, r, part, ids[at : at + row]) for i, r, ids in docs for part, at in enumerate(range(0, len(ids), row))]
    for chosen in best_fit([len(x[3]) for x in items], row):
        held = [items[k] for k in chosen]
        size = [len(x[3]) for x in held]
        ids, positions = np.full(row, END, "<u2"), np.zeros(row, "<u2")
        cu = np.cumsum([0, *size])
        for (_, _, _, part), at in zip(held, cu):
            ids[at : at + len(part)] = part
            positions[at : at + len(part)] = np.arange(len(part))
        yield {"n_tokens": int(cu[-1]), "ids": ids.tobytes(), "positions": positions.tobytes(), "cu_seqlens": cu.tolist(), "doc_ids": [x[0] for x in held], "rows": [x[1] for x in held], "parts": [x[2] for x in held]}


def packed(docs: DataFrame, vocabulary: dict[bytes, int], row: int = ROW, window_tokens: int = WINDOW_TOKENS, window_docs: int = WINDOW_DOCS) -> DataFrame:
    """The packed rows of ``doc_id, text``, as a table in the shared folder.

    ``rows`` numbers the rows of ``docs``, so documents that share an id stay apart; ``parts`` counts
    a document's pieces. Null and empty texts are the end id alone. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    if row > 65_535:
        raise ValueError("positions are stored in 16 bits")
    schema = pa.schema([("pack", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("positions", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))])

    def run(batches):
        from pyspark import TaskContext

        coder, number = tokenizer(shared.value), TaskContext.get().partitionId() << 33
        pack_number, held, tokens = number, [], 0

        def flush():
            nonlocal pack_number, held, tokens
            made = list(pack(held, row))
            for k in range(0, len(made), 512):
                some = [{"pack": pack_number + i, **x} for i, x in enumerate(made[k : k + 512], k)]
                yield pa.RecordBatch.from_pylist(some, schema)
            pack_number, held, tokens = pack_number + len(made), [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*coder.encode_ordinary(text or ""), END], "<u2")
                if held and (tokens + len(ids) > window_tokens or len(held) == window_docs):
                    yield from flush()
                held.append((doc_id, number, ids))
                number, tokens = number + 1, tokens + len(ids)
        if held:
            yield from flush()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACKED), "packed")


def unpacked(packs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, text`` of each packed document, put together from its pieces."""
    shared = packs.sparkSession.sparkContext.broadcast(vocabulary)
    at = F.posexplode("parts").alias("k", "part")
    cut = packs.select("ids", "cu_seqlens", "doc_ids", "rows", at).select(F.element_at("doc_ids", F.col("k") + 1).alias("doc_id"), F.element_at("rows", F.col("k") + 1).alias("row"), "part", F.expr("substring(ids, 2 * cu_seqlens[k] + 1, 2 * (cu_seqlens[k + 1] - cu_seqlens[k]))").alias("piece"))
    whole = cut.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("pieces")).select("doc_id", F.transform("pieces", lambda x: x["piece"]).alias("pieces"))

    def run(batches):
        coder = tokenizer(shared.value)
        for batch in batches:
            ids = (np.frombuffer(b"".join(p.as_py()), "<u2")[:-1].tolist() for p in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode_bytes(x).decode("utf-8", "surrogatepass") for x in ids], pa.string())], ["doc_id", "text"])

    return whole.mapInArrow(run, "doc_id long, text string")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenized and packed, the stored rows read back: a row per packed row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packs = packed(docs, ranks())
    return packs.select(
        "pack", "n_tokens", F.size("doc_ids").cast("long").alias("n_segments"), F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",", "null").alias("doc_ids"),
        F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"), F.array_join(F.transform("cu_seqlens", lambda x: x.cast("string")), ",").alias("cu_seqlens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"),
    )
