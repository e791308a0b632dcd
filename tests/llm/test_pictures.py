"""op4: filters and cosine hashes against plain versions; op8 and op10 against DuckDB."""

import math
import random
import struct
import zlib

import numpy as np
import pytest

from scriptorium.llm import png
from scriptorium.llm.registry import ORACLE, QUERIES
from tests.comparing import connection, difference

SF = "/root/testdata/sf0.001"


def filtered(rows, kinds, step):
    """The rows of a picture under the given filters, byte by byte."""
    out = []
    for y, (row, kind) in enumerate(zip(rows, kinds)):
        line = []
        for x, v in enumerate(row):
            a = row[x - step] if x >= step else 0
            b = rows[y - 1][x] if y else 0
            c = rows[y - 1][x - step] if y and x >= step else 0
            near = min((abs(a + b - c - g), k) for k, g in enumerate((a, b, c)))[1]
            line.append((v - (0, a, b, (a + b) // 2, (a, b, c)[near])[kind]) % 256)
        out.append(line)
    return out


@pytest.mark.parametrize("step,colour", [(1, 0), (3, 2), (4, 6)])
def test_all_filters(step, colour):
    rng = random.Random(step)
    width, kinds = 9, [4, 3, 0, 1, 2, 4, 3, 4]
    rows = [[rng.randrange(256) for _ in range(width * step)] for _ in kinds]
    raw = b"".join(bytes([k, *line]) for k, line in zip(kinds, filtered(rows, kinds, step)))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, colour, 0, 0, 0)
    packed = zlib.compress(raw)
    file = png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"IDAT", packed[:20]) + png.chunk(b"IDAT", packed[20:]) + png.chunk(b"IEND", b"")
    assert png.decode(file).tobytes() == bytes(v for row in rows for v in row)


def plain_hash(picture):
    grey = picture.astype(float).mean(axis=2)
    for axis in (0, 1):  # each sample SIDE times, so that the parts hold whole samples
        n = grey.shape[axis]
        grey = np.moveaxis(np.repeat(grey, png.SIDE, axis), axis, 0).reshape(png.SIDE, n, -1).mean(axis=1)
        grey = np.moveaxis(grey, 0, axis)
    side = range(png.SIDE)
    wave = [[math.cos(math.pi * k * (2 * x + 1) / (2 * png.SIDE)) for x in side] for k in range(png.LOW)]
    low = [round(sum(grey[y, x] * wave[u][y] * wave[v][x] for y in side for x in side), 6) for u in range(png.LOW) for v in range(png.LOW)]
    middle = np.median(low[1:])
    return bytes(sum((low[8 * k + j] > middle) << (7 - j) for j in range(8)) for k in range(8))


def test_cosine_hash_by_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(25).collect()]
    for text in ["a", *texts]:
        picture = png.decode(png.encode(png.payload_of(text)[1]))
        assert png.cosine_hash(picture) == plain_hash(picture)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_duckdb(spark, name):
    assert difference(QUERIES[name](spark, SF), connection(SF), ORACLE[name]) is None
