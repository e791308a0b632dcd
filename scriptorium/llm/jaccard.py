"""Exact Jaccard self-join over word shingles, by a grouped prefix join.

1. Documents with equal shingle sets are one class (by a 128-bit digest of the set).
2. Shingles are ordered by level of frequency, then by the frequency of their rarest word, then by
   hash. Frequencies are sums over all documents, by hash, in tables of fixed size: what shares a
   place gets a common sum, which keeps the order total and the same everywhere. Level 0 is what
   the noise of such sums hides; common passages come last. Two sets that reach the threshold share a shingle among the first ``n - ceil(t n) + 1``
   of each. Classes with the same prefix and size form one group, and groups are indexed by the
   shingles of their prefix.
3. A prefix shingle with more than one member is a block. Blocks with equal members count once.
   Groups that blocks connect are a family, and groups are expanded to members. A family is tested
   as a whole or block by block, whichever sends fewer sets. Either is dealt in tiles of bounded size; in a tile all intersections are counted and only a spanning
   forest of the links is emitted.
4. Components of the links, and then of the documents.

No step emits the pairs of a block, and no pair that reaches the threshold is left untested.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cleared, frugal, row_of, small_side, written
from .components import components
from .shingles import Powers, blocks, shingles, words

WIDTH, PERCENT = 4, 85  # words of a shingle; the least intersection in percent of the union
SHINGLE_BITS, WORD_BITS = 20, 19  # of the tables of frequencies
ENTRIES, CHUNK = (1 << SHINGLE_BITS) + (1 << WORD_BITS), 1 << 12  # of both; that travel together
TILE_MEMBERS, TILE_SHINGLES = 512, 1 << 21  # of a chunk of a family or block, on average
COLUMNS = 4096  # of a matrix product
SLICES = 4  # of the tiles, one after the other
EACH = 50  # shingles of a set for one more that its prefix has to share
DENSE = 32  # a shingle of at least 1 / DENSE of a tile's members goes to the matrix product


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    return np.unique(shingles(hashes, width))


def place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def facts(docs: DataFrame, width: int) -> DataFrame:
    """One pass over the texts, as a table: ``doc_id, n, sig`` of each row, and rows with
    ``chunk, counts`` instead: a part's frequencies in a chunk of the tables."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n long, sig binary, chunk int, counts binary"
    names = ["doc_id", "n", "sig", "chunk", "counts"]

    def run(batches):
        powers, freq = Powers(), np.zeros(ENTRIES, np.uint32)
        for batch in batches:
            texts, sizes, sigs = batch.column(1).to_pylist(), [], []
            for at, to in blocks(texts):
                hashes, edge = words(texts[at:to], powers)
                found = [shingle_set(hashes[a:b], width) for a, b in zip(edge[:-1], edge[1:])]
                freq += np.bincount(np.concatenate([place(x, SHINGLE_BITS) for x in found] + [place(hashes, WORD_BITS) + (1 << SHINGLE_BITS)]), minlength=ENTRIES).astype(np.uint32)
                sizes += map(len, found)
                sigs += [digest(x) if len(x) else None for x in found]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        for k, part in enumerate(freq.reshape(-1, CHUNK)):
            if part.any():
                counts = zlib.compress(part.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([counts], pa.binary())], names)

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), schema), "facts")


def frequencies(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The levels of shingles and the frequencies of words: ``ENTRIES`` sums, whatever the input."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    out = np.zeros(ENTRIES, np.uint32)
    parts = table.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
    for row in parts.mapInArrow(frugal(run), "chunk int, counts binary").collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.uint32)
    counts, word = out[: 1 << SHINGLE_BITS].astype(np.float64), out[1 << SHINGLE_BITS :]
    noise = counts.mean()
    return np.log2(np.maximum((counts - noise) / (4 * np.sqrt(noise) + 4), 1)).astype(np.uint8), word


def prefix(hashes: np.ndarray, level: np.ndarray, word: np.ndarray, width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle set, and its first shingles in the common order."""
    every, low = shingles(hashes, width), word[place(hashes, WORD_BITS)]
    if len(hashes) >= width:
        rarest = low[: len(every)].copy()
        for k in range(1, width):
            np.minimum(rarest, low[k : k + len(every)], out=rarest)
    else:
        rarest = low.min(keepdims=True)
    found, first = np.unique(every, return_index=True)
    n = len(found)
    order = np.lexsort((rarest[first], level[place(found, SHINGLE_BITS)]))
    return found, found[order[: n - -(-percent * n // 100) + 1 + n // EACH]]


def indexed(docs: DataFrame, order, width: int, percent: int) -> DataFrame:
    """``doc_id, sig, n, gid, tokens`` of each row with words."""
    schema = "doc_id long, sig binary, n long, gid long, tokens array<long>"

    def run(batches):
        powers = Powers()
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for at, to in blocks(texts):
                hashes, edge = words(texts[at:to], powers)
                for i, a, b in zip(ids[at:to], edge[:-1], edge[1:]):
                    if b > a:
                        found, tokens = prefix(hashes[a:b], *order.value, width, percent)
                        gid = int.from_bytes(hashlib.blake2b(len(found).to_bytes(8, "big") + tokens.tobytes(), digest_size=8).digest(), "big", signed=True)
                        rows.append((i, digest(found), len(found), gid, tokens.view(np.int64)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "sig", "n", "gid", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), schema)


def sets(docs: DataFrame, width: int) -> DataFrame:
    """``sig, items``: the shingle set of each row as sorted 64-bit numbers."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            texts, rows = batch.column(0).to_pylist(), []
            for at, to in blocks(texts):
                hashes, edge = words(texts[at:to], powers)
                for a, b in zip(edge[:-1], edge[1:]):
                    found = shingle_set(hashes[a:b], width)
                    rows.append((digest(found), found.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["sig", "items"])

    return docs.select("text").mapInArrow(frugal(run), "sig binary, items binary")


def forest(members: dict[bytes, np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links among ``members``, all pairs tested."""
    names, found = list(members), list(members.values())
    m = len(names)
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []

    def link(a: int, b: int) -> None:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((names[a], names[b]))

    size = np.array([len(x) for x in found])
    if m <= 6:
        for a in range(m):
            for b in range(a):
                if percent * max(size[a], size[b]) <= 100 * min(size[a], size[b]) and root(a) != root(b):
                    both = len(np.intersect1d(found[a], found[b], assume_unique=True))
                    if 100 * both >= percent * (size[a] + size[b] - both):
                        link(a, b)
        return out
    owner = np.repeat(np.arange(m), size)
    items, place, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    order = np.argsort(place, kind="stable")
    owner, ends = owner[order], np.cumsum(times)
    both = np.zeros((m, m), np.float32)
    dense = np.flatnonzero((times > 1) & (times * DENSE >= m))
    for at in range(0, len(dense), COLUMNS):
        part = dense[at : at + COLUMNS]
        grid = np.zeros((m, len(part)), np.float32)
        for k, c in enumerate(part):
            grid[owner[ends[c] - times[c] : ends[c]], k] = 1
        both += grid @ grid.T
    for c in np.flatnonzero((times > 1) & (times * DENSE < m)):
        some = owner[ends[c] - times[c] : ends[c]]
        both[some[:, None], some] += 1
    for a in range(1, m):
        row = both[a, :a].astype(np.int64)
        for b in np.flatnonzero(100 * row >= percent * (size[a] + size[:a] - row)):
            link(a, int(b))
    return out


def links(tiles: DataFrame, percent: int) -> DataFrame:
    """``u, v`` of the links in ``by, key, i, j, sig, items``, which come dealt and sorted by tile."""

    def run(batches):
        schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])
        now, members, out = None, {}, []
        for batch in batches:
            for *tile, sig, items in zip(*(c.to_pylist() for c in batch.columns)):
                if tile != now:
                    out += forest(members, percent)
                    now, members = tile, {}
                members[sig] = np.frombuffer(items, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], schema=schema)
            out = []
        out = forest(members, percent)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], schema=schema)

    return tiles.mapInArrow(frugal(run), "u binary, v binary")


def compatible(hits: DataFrame, percent: int) -> DataFrame:
    """``token, gid, n, of`` without the groups of a block whose size no other
    member of the block comes near enough to. Sizes fall into classes by a factor of the
    threshold, so two that can reach it are in the same or in neighbouring classes."""
    classed = hits.withColumn("c", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))))
    count = classed.groupBy("token", "c").agg(F.sum("of").alias("w"))
    around = count.select("token", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"), "w").groupBy("token", "c").agg(F.sum("w").alias("w")).filter("w > 1")
    return classed.join(around, ["token", "c"]).select("token", "gid", "n", "of")


def sharing(near: DataFrame, percent: int) -> DataFrame:
    """``near`` without the groups whose prefix shares fewer shingles with any others than a partner
    of the least possible size would ask for."""
    need = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / EACH)
    rich = near.groupBy("gid", "n").agg(F.count("*").alias("have")).filter(F.col("have") >= need).select("gid")
    return near.join(rich, "gid", "left_semi")


def pruned(leads: DataFrame, percent: int) -> DataFrame:
    """``token, gid, n, of``: a table of the blocks of ``gid, n, of, tokens``, without the groups that
    cannot reach a partner in them."""
    posted = leads.select("gid", "of", F.explode("tokens").alias("token"))
    shared = written(posted.groupBy("token").agg(F.sum("of").alias("m")).filter("m > 1").select("token"), "shared")
    hits = written(posted.select("token", "gid").join(small_side(shared), "token"), "hits")
    near = hits.join(leads.select("gid", "n", "of"), "gid")
    for _ in range(2):  # the few rows that the second round leaves out hold families together
        near = written(compatible(near, percent), "near")
        near = written(sharing(near, percent), "near")
    return near


def dealt(index: DataFrame, member: DataFrame) -> DataFrame:
    """``by, key, i, j, sig, doc_id``: the members of each tile. ``index`` has ``token, gid`` of the
    blocks, ``member`` has ``gid, sig, doc_id, n``; ``by`` says whether ``key`` is a family or a block.

    A family or block of k chunks has a tile for each two of them (and for each alone), so that any
    two members meet in one. Its members are dealt to chunks by hash.
    """
    tie = index.groupBy("token").agg(F.min("gid").alias("v"))
    family = components(index.select("token", F.col("gid").alias("u")).join(tie, "token").select("u", "v"))
    grouped = index.select("gid").distinct().join(family, F.col("gid") == F.col("node"), "left").select("gid", F.coalesce("least", "gid").alias("family"))
    members = written(grouped.join(member, "gid"), "members")
    sent = index.join(members.select("gid", "family"), "gid").groupBy("family").agg(F.count("*").alias("sent"))
    size = members.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("total")).join(sent, "family")
    k = F.greatest(F.ceil(F.col("m") / TILE_MEMBERS), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int")
    sizes = small_side(written(size.select("family", k.alias("k"), (k * F.col("m") <= F.col("sent")).alias("whole")), "families"))
    sized = members.join(sizes, "family")
    whole = sized.filter("whole").select(F.lit(0).alias("by"), F.col("family").alias("key"), "sig", "doc_id", "k")
    large = sized.filter("NOT whole").select("gid", "sig", "doc_id", "n")
    expanded = index.join(large, "gid")
    block = expanded.groupBy("token").agg(F.greatest(F.ceil(F.count("*") / TILE_MEMBERS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("k"))
    parts = expanded.join(block, "token").select(F.lit(1).alias("by"), F.col("token").alias("key"), "sig", "doc_id", "k")
    chunk = whole.unionAll(parts).withColumn("c", F.pmod(F.xxhash64("sig"), F.col("k")).cast("int"))
    return chunk.select("by", "key", "sig", "doc_id", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("d")).select("by", "key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "sig", "doc_id")


def joined(docs: DataFrame, table: DataFrame, rows: DataFrame, others: DataFrame, width: int, percent: int) -> DataFrame:
    """``u, v``: a table of links between classes, whose components are those of all links. ``rows``
    are the rows of ``table`` with a ``doc_id``, ``others`` those that an equal set stands for."""
    order = docs.sparkSession.sparkContext.broadcast(frequencies(table))
    with cleared(docs.sparkSession) as made:
        heads = written(indexed(docs.filter("doc_id IS NOT NULL"), order, width, percent).join(small_side(others), ["doc_id", "sig"], "left_anti"), "prefixes")
        same = written(rows.filter("sig IS NOT NULL").groupBy("doc_id", "sig").agg(F.count("*").alias("times")).filter("times > 1").select("doc_id", "sig"), "same")
        if not same.isEmpty():  # a row for each, as joins by group would pair the repeated ones
            held = small_side(same)
            once = heads.join(held, ["doc_id", "sig"], "left_semi").dropDuplicates(["doc_id", "sig"])
            heads = written(heads.join(held, ["doc_id", "sig"], "left_anti").unionByName(once), "prefixes")
        groups = small_side(written(heads.groupBy("gid").agg(F.min("sig").alias("lead"), F.countDistinct("sig").alias("of")).filter("of > 1"), "groups"))
        leads = heads.join(groups, "gid", "left").filter("lead IS NULL OR lead = sig").select("gid", "n", F.coalesce("of", F.lit(1)).cast("int").alias("of"), "tokens")
        with cleared(docs.sparkSession) as inner:
            near = pruned(leads, percent)
            inner.pop()  # the pruned blocks, which stay
        mark = F.xxhash64("gid")
        alike = near.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(mark).alias("x"), F.sum(mark % 2_147_483_647).alias("s"))
        chosen = written(alike.groupBy("m", "x", "s").agg(F.min("token").alias("token")).select("token"), "blocks")
        index = written(near.select("token", "gid").join(small_side(chosen), "token", "left_semi"), "block-groups")
        tiles = written(dealt(index, heads.select("gid", "sig", "doc_id", "n").dropDuplicates(["sig"])), "tiles")
        made.pop()  # the tiles, which stay: prefixes and blocks go before the sets are sent

    every = None
    for k in range(SLICES):  # the sets of a slice of the tiles at a time
        mine = tiles.filter(F.pmod(F.xxhash64("by", "key", "i", "j"), F.lit(SLICES)) == k)
        needed = small_side(written(mine.select("doc_id").distinct(), "needed"))
        held = sets(docs.join(needed, "doc_id", "left_semi"), width)
        placed = held.join(small_side(mine.drop("doc_id")), "sig").select("by", "key", "i", "j", "sig", "items")
        found = written(links(placed.repartition("by", "key", "i", "j").sortWithinPartitions("by", "key", "i", "j"), percent), "some-links")
        every = every.unionAll(found) if every is not None else found
    return written(every, "links")


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Null and empty texts and texts of white space have no shingles and stay alone. Rows with a null
    ``doc_id`` have the size of their set, a null component and no link. Rows that repeat are each
    returned. Other columns are ignored.
    """
    spark = docs.sparkSession
    table = facts(docs, width)
    every = table.filter("chunk IS NULL").select("doc_id", "n", "sig")
    rows = every.filter("doc_id IS NOT NULL")
    with cleared(spark) as made:
        classes = written(rows.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("of")), "classes")
        copies = classes.filter("of > 1").select("sig", "rep")
        others = written(rows.join(small_side(copies), "sig").filter("doc_id <> rep").select("doc_id", "sig").distinct(), "copies")
        with cleared(spark) as inner:
            edges = joined(docs, table, rows, others, width, percent)
            inner.pop()  # the links, which stay
        out = labelled(rows, classes, edges)
        made.pop()  # the labels, which stay as the facts do: the rows that are returned read both
    nameless = every.filter("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(nameless)


def labelled(rows: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of the classes that have links or copies; all other rows are alone."""
    part = components(edges)
    known = classes.join(part, classes["sig"] == part["node"], "left").select("sig", "rep", "of", "least")
    named = written(known.filter("least IS NOT NULL OR of > 1"), "named")
    roots = named.filter("least IS NOT NULL").groupBy("least").agg(F.min("rep").alias("component"))
    label = named.join(roots, "least", "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(small_side(written(label, "labels")), "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` of each component of texts, all columns kept: one with the least ``doc_id``
    (null comes last; of several texts with it, the one of the least hash).

    Rows are told apart by ``doc_id`` and text together, so rows that share a ``doc_id`` and hold
    different texts stay unless their own text is a copy, and rows without a ``doc_id`` take part.
    Texts without words are no copies; only where such rows share a ``doc_id`` and the text, one stays.
    """
    number = F.col("doc_id").cast("long")
    row = F.xxhash64(number, "text")
    loose = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    with cleared(docs.sparkSession) as made:
        keys = written(docs.select(row.alias("row"), number.alias("of"), loose.alias("loose")), "rows")
        with cleared(docs.sparkSession) as inner:
            found = written(linked(docs.select(row.alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias("row"), "component_id").distinct(), "components")
            inner.pop()  # the last one, which stays
        several = written(found.filter("component_id <> row").select("component_id").distinct(), "several")
        members = found.join(small_side(several), "component_id").join(keys.select("row", "of").distinct(), "row")
        ranked = written(members.select("component_id", "row", F.struct(F.col("of").isNull().alias("none"), "of", "row").alias("rank")), "members")
        first = written(ranked.groupBy("component_id").agg(F.min("rank").alias("first")).select("component_id", F.col("first.row").alias("first")), "firsts")
        gone = written(ranked.join(small_side(first), "component_id").filter("row <> first").select("row"), "gone")
        again = written(keys.filter("NOT loose").groupBy("row").agg(F.count("*").alias("times")).filter("times > 1").select("row"), "repeated")
        del made[-2:]  # the rows that go and those that repeat, a number each, stay: what is returned reads them
    marked = docs.select(row_of(docs).alias("doc"), row.alias("row"))
    kept = marked.join(small_side(gone), "row", "left_anti")
    if again.isEmpty():
        return kept.select("doc.*")
    once = kept.join(small_side(again), "row", "left_semi").groupBy("row").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return kept.join(small_side(again), "row", "left_anti").select("doc.*").unionByName(once.select("doc.*"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
