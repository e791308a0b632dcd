"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a long string of bits: on which side of orthogonal random directions it
lies, split at their medians. The tree is its strings in sorted order, and a prefix is a run of
them; what is deeper has more bits in common. Runs are halved bit by bit until they hold ``LEAF``
strings at most, so leaves have prefixes of various lengths, longer where vectors are dense.

A query descends in every tree to the leaf of its longest matching prefix. If the leaves of all trees
together hold too few candidates, it ascends in all trees at once, a bit at a time, and takes every
leaf below. Vectors and queries meet in Spark's shuffle by leaf, some trees at a time; cosines are
computed there and only the best go on.

Equal vectors are searched and indexed once, with the least ids of their rows: no more can be
among the nearest. Strings that are equal to the last bit and fill more than a leaf are dealt to
several tasks, and their queries visit each of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cleared, frugal, small_side, written
from .vectors import first_rows, matrix

NEAREST, EVERY = 5, 50  # neighbours of a query; rows whose id this divides are queries
TREES, BITS = 16, 64
LEAF = 4096  # strings of a leaf at most
LEAST, MOST = 1 << 15, 1 << 18  # candidates, over all trees, that a query ascends for, and up to which it does
AT_ONCE = 4  # trees whose vectors are shuffled together
SAMPLE = 4096  # vectors that the medians are taken from
SEED = 13
SPARE = 3  # neighbours of a leaf beyond those asked for, whose exact scores are compared


def units(found: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the largest component is brought to 1 first, so that no square overflows."""
    scaled = found / np.abs(found).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def distinct_vectors(table: DataFrame, dim: int, most: int) -> DataFrame:
    """``v, vec, ids``: a table of distinct sound vectors that aren't 0, by a digest, with the ``most`` least ids."""
    kept = components(table, dim)
    least = kept.withColumn("k", F.row_number().over(W.partitionBy("v").orderBy(F.asc_nulls_last("vec_id")))).filter(F.col("k") <= most)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("k", "vec_id"))), lambda x: x["vec_id"])
    return written(least.groupBy("v").agg(F.first("vec").alias("vec"), ids.alias("ids")), "vectors")


def components(table: DataFrame, dim: int) -> DataFrame:
    """``vec_id, v, vec``: the sound vectors of ``dim`` components that aren't 0, as bytes, and their digest."""
    bounded_batches(table.sparkSession)
    exact = "<f4" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"

    def run(batches):
        for batch in batches:
            at, found = matrix(batch.column(1), dim)
            full = found.any(axis=1)
            vec = [x.tobytes() for x in (found[full] + 0.0).astype(exact)]  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[full])), pa.array(vec, pa.binary())], ["vec_id", "vec"])

    return table.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(frugal(run), "vec_id long, vec binary").select("vec_id", F.unhex(F.md5("vec")).alias("v"), "vec")


def read(vecs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<f4" if vecs and len(vecs[0]) == 4 * dim else "<f8").reshape(len(vecs), dim).astype(np.float64)


def planted(vectors: DataFrame, dim: int, trees: int, bits: int, seed: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Directions (``trees x dim x bits``, orthogonal ``dim`` at a time) and their medians over a sample
    of bounded size: the vectors of least digest."""
    rng = np.random.default_rng(seed)
    turns = [np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-bits // dim))], axis=1)[:, :bits] for _ in range(trees)]
    some = units(read([r["vec"] for r in vectors.select("v", "vec").orderBy("v").limit(sample).collect()], dim))
    planes = np.stack(turns)
    return planes, np.median(np.einsum("nd,tdb->tnb", some, planes), axis=1)


def strings(vectors: DataFrame, dim: int, shared, trees: list[int], with_vec: bool = False) -> DataFrame:
    """``v, tree, key`` (and ``vec``): the bit string of each vector in each of ``trees``."""
    names = ["v", "tree", "key", *(["vec"] if with_vec else [])]

    def run(batches):
        planes, middle = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            unit = units(read(batch.column(1).to_pylist(), dim))
            for t in trees:
                bits = np.ascontiguousarray((unit @ planes[t] > middle[t]).astype(np.uint8) + 48)
                ends = pa.py_buffer((np.arange(n + 1) * bits.shape[1]).astype(np.int32))
                key = pa.Array.from_buffers(pa.string(), n, [None, ends, pa.py_buffer(bits)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, t, np.int32)), key, *([batch.column(1)] if with_vec else [])], names)

    return vectors.select("v", "vec").mapInArrow(frugal(run), "v binary, tree int, key string" + ", vec binary" * with_vec)


def counted(keys: DataFrame, total: int, bits: int, leaf: int) -> DataFrame:
    """``tree, level, prefix, n``: a table of the prefixes that a descent meets, from the whole tree
    (level 0) to the leaves, with the number of their strings.

    Cells a few bits deeper than even halves would need are counted first and rolled up; where a
    cell still holds more than a leaf, only its strings are counted on, some bits deeper.
    """
    spark = keys.sparkSession
    depth, found = min(bits, max(1, math.ceil(math.log2(max(1, total / leaf)))) + 4), []
    open_, upto = None, 0
    while True:
        held = keys if open_ is None else keys.join(small_side(open_), (keys["tree"] == open_["of"]) & (F.substring("key", 1, upto) == open_["prefix"]), "left_semi")
        cells = written(held.groupBy("tree", F.substring("key", 1, depth).alias("prefix")).agg(F.count("*").alias("n")), "cells")
        levels = cells.select("tree", "n", "prefix", F.explode(F.sequence(F.lit(upto + (open_ is not None)), F.lit(depth))).alias("level"))
        nodes = levels.groupBy("tree", "level", F.expr("substring(prefix, 1, level)").alias("prefix")).agg(F.sum("n").alias("n"))
        found.append(written(nodes, "nodes"))
        over = found[-1].filter((F.col("level") == depth) & (F.col("n") > leaf)).select(F.col("tree").alias("of"), "prefix")
        if depth == bits or over.isEmpty():
            break
        open_, upto, depth = written(over, "open"), depth, min(bits, depth + 12)
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    above = every.select(F.col("tree").alias("of"), (F.col("level") + 1).alias("below"), F.col("prefix").alias("start"), F.col("n").alias("around"))
    reached = every.join(above, (F.col("tree") == F.col("of")) & (F.col("level") == F.col("below")) & (F.expr("substring(prefix, 1, level - 1)") == F.col("start")), "left")
    return written(reached.filter((F.col("level") == 0) | (F.col("around") > leaf)).select("tree", "level", "prefix", "n"), "prefixes")


def visited(keys: DataFrame, nodes: DataFrame, leaves: DataFrame, least: int, most: int) -> DataFrame:
    """``v, tree, leaf``: the leaves that each query (a row of ``keys`` per tree) visits, as a table.

    Each tree's path holds the counts from the root to the leaf. All trees stand at the same level, or
    at their leaf where that is higher up: the deepest level with ``least`` candidates is taken, or
    the next one if that one has more than ``most``.
    """
    levels = [r["level"] for r in nodes.select("level").distinct().collect()]  # at most bits + 1
    steps = keys.select("v", "tree", "key", F.explode(F.array(*[F.lit(x) for x in sorted(levels)])).alias("level")).withColumn("prefix", F.expr("substring(key, 1, level)")).drop("key")
    met = steps.join(small_side(nodes), ["tree", "level", "prefix"])
    path = met.groupBy("v", "tree").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "n"))), lambda x: x["n"]).alias("path"), F.max("prefix").alias("leaf"))
    paths = written(path, "paths")  # prefixes of one string sort by length
    here = lambda p, x: F.element_at(p, F.least(x + 1, F.size(p)))
    each = paths.groupBy("v").agg(F.collect_list("path").alias("paths"), F.max(F.size("path")).alias("deep"))
    sums = F.transform(F.sequence(F.lit(0), F.col("deep") - 1), lambda x: F.aggregate("paths", F.lit(0).cast("long"), lambda acc, p: acc + here(p, x)))
    enough = F.size(F.filter("sums", lambda s: s >= least)) - 1  # sums fall from level to level
    level = F.greatest(enough, F.lit(0))
    above = F.element_at("sums", level + 1) > most
    chosen = each.withColumn("sums", sums).select("v", F.when(above, F.least(level + 1, F.col("deep") - 1)).otherwise(level).alias("level"))
    at = paths.join(chosen, "v").select("v", "tree", F.expr("substring(leaf, 1, level)").alias("top"))
    below = leaves.select("tree", "leaf", F.explode(F.sequence(F.lit(0), F.length("leaf"))).alias("level")).select("tree", "leaf", F.expr("substring(leaf, 1, level)").alias("top"))
    return written(at.join(small_side(written(below, "tops")), ["tree", "top"]).select("v", "tree", "leaf"), "visits")


def best(dealt: DataFrame, dim: int, most: int) -> DataFrame:
    """``q, v, score``: the ``most`` nearest vectors of each query in each leaf, at least. Rows come by
    leaf, vectors (kind 0) before queries (kind 1), ``most + SPARE`` of which are scored exactly."""

    def flush(unit, names, queries):
        rows = units(read([vec for _, vec in queries], dim))
        near = rows @ unit.T
        k = min(most + SPARE, len(names))
        out = []
        for (q, _), row, cosines in zip(queries, rows, near):
            top = np.argpartition(-cosines, k - 1)[:k]
            exact = (unit[top] * row).sum(axis=1)
            out += [(q, names[i], s) for i, s in zip(top, exact.tolist())]
        return out

    def run(batches):
        schema = pa.schema([("q", pa.binary()), ("v", pa.binary()), ("score", pa.float64())])
        now, names, vecs, unit, queries, out = None, [], [], None, [], []
        for batch in batches:
            for *leaf, kind, v, vec in zip(*(c.to_pylist() for c in batch.columns)):
                if leaf != now:
                    if queries:
                        out += flush(unit, names, queries)
                    now, names, vecs, unit, queries = leaf, [], [], None, []
                if kind == 0:
                    names.append(v)
                    vecs.append(vec)
                    continue
                if unit is None:
                    unit = units(read(vecs, dim))
                queries.append((v, vec))
                if len(queries) == 256:
                    out += flush(unit, names, queries)
                    queries = []
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], schema.field(k).type) for k in range(3)], schema=schema)
            out = []
        if queries:
            out = flush(unit, names, queries)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], schema.field(k).type) for k in range(3)], schema=schema)

    return dealt.mapInArrow(frugal(run), "q binary, v binary, score double")


def met(vectors: DataFrame, asked: DataFrame, dim: int, most: int, trees: int, bits: int, leaf: int, least: int, upto: int, seed: int) -> DataFrame:
    """``q, v, score``: a table of the vectors found near each vector of ``asked``, itself included."""
    spark = vectors.sparkSession
    total = vectors.count()
    trees = 1 if total <= leaf else trees  # every tree would be the same single leaf
    shared = spark.sparkContext.broadcast(planted(vectors, dim, trees, bits, seed))
    every = list(range(trees))
    with cleared(spark) as made:
        nodes = counted(strings(vectors, dim, shared, every), total, bits, leaf)
        ends = nodes.filter((F.col("n") <= leaf) | (F.col("level") == bits))
        leaves = written(ends.select("tree", F.col("prefix").alias("leaf"), F.ceil(F.col("n") / leaf).cast("int").alias("chunks")), "leaves")
        visits = visited(strings(asked, dim, shared, every), nodes, leaves, least, upto)
        depths = [r["d"] for r in leaves.select(F.length("leaf").alias("d")).distinct().collect()]  # at most bits + 1
        found = []
        for at in range(0, trees, AT_ONCE):
            group = every[at : at + AT_ONCE]
            own = small_side(leaves.filter(F.col("tree").isin(group)))
            prefix = F.explode(F.array(*[F.substring("key", 1, d) for d in sorted(depths)])) if len(depths) > 1 else F.substring("key", 1, depths[0])
            rows = strings(vectors, dim, shared, group, True).select("v", "tree", "vec", prefix.alias("leaf")).join(own, ["tree", "leaf"])
            placed = rows.select("tree", "leaf", F.pmod(F.xxhash64("v"), "chunks").cast("int").alias("chunk"), F.lit(0).alias("kind"), "v", "vec")
            wanted = visits.filter(F.col("tree").isin(group)).join(own, ["tree", "leaf"]).join(asked.select("v", "vec"), "v")
            queries = wanted.select("tree", "leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"), "v", "vec")
            dealt = placed.unionAll(queries).repartition("tree", "leaf", "chunk").sortWithinPartitions("tree", "leaf", "chunk", "kind")
            found.append(written(best(dealt, dim, most), "found"))
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        out = written(out.distinct(), "near")
        made.pop()
    return out


def neighbours(table: DataFrame, nearest: int = NEAREST, every: int = EVERY, trees: int = TREES, bits: int = BITS, leaf: int = LEAF, least: int = LEAST, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for each row whose ``vec_id`` is divisible
    by ``every``, by cosine, the nearest first, ties to the smaller id. Tables of up to ``leaf`` distinct
    vectors are searched whole.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do those of
    another length than that of the least ``vec_id`` with a sound one. Every row but the query's own is a
    candidate, so a row that repeats the query's is one, and each of the repeated rows is a query. Rows
    without an id are candidates, last among ties, and no queries. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = table.sparkSession
    first = first_rows(table.filter(F.exists("embedding", lambda x: x != 0)), 1)
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(first[0])
    with cleared(spark) as made:
        vectors = distinct_vectors(table, dim, nearest + 1)
        rows = written(components(table.filter(F.col("vec_id") % every == 0), dim).select("vec_id", "v"), "queries")
        asked = written(vectors.join(small_side(rows.select("v").distinct()), "v", "left_semi").select("v", "vec"), "asked")
        pairs = met(vectors, asked, dim, nearest + 1, trees, bits, leaf, least, most, seed)
        listed = pairs.join(vectors.select("v", "ids"), "v").select("q", "v", "score", F.explode("ids").alias("vec_id"))
        order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        top = listed.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= nearest + 1)
        entry = F.struct("k", "vec_id", "score", (F.col("q") == F.col("v")).alias("own"))
        lists = written(top.groupBy("q").agg(F.array_sort(F.collect_list(entry)).alias("found")), "lists")
        del made[-1]  # the lists stay, as the queries do: the rows that are returned read them
        made.remove(next(p for p in made if "/queries-" in p))
    # The first entry of the query's own vector and id is its own row.
    same = F.transform("found", lambda x: x["own"] & x["vec_id"].eqNullSafe(F.col("vec_id")))
    self_at = F.coalesce(F.array_position(same, F.lit(True)), F.lit(0))
    asking = rows.withColumnRenamed("v", "q").join(small_side(lists), "q").select("vec_id", "found", self_at.alias("self"))
    others = asking.select("vec_id", F.slice(F.filter("found", lambda x: x["k"] != F.col("self")), 1, nearest).alias("found"))
    out = others.select(F.col("vec_id").alias("query_id"), F.posexplode("found").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows found of every fiftieth vector."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
