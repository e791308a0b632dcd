"""PNG files in binary columns: a zlib writer and reader, numpy unfiltering, cosine hashes.

The payload of a text is its UTF-8 bytes followed by spaces up to a positive multiple of 192.
Each 192 bytes are one row of 64 RGB pixels with 8-bit samples, so the picture is the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW = 192
SIDE = 32  # of the grey picture that the cosine transform sees
LOW = 8  # its lowest frequencies that are kept, in each direction

MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, dct_hash binary"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text's bytes, and the padded payload."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" ")


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 6) -> bytes:
    """A PNG of 64 RGB pixels a row. Each row takes whichever of the filters none, sub and up
    leaves the least sum of absolute (signed) residues."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    left = np.zeros_like(rows)
    left[:, 3:] = rows[:, :-3]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    tried = np.stack([rows, rows - left, rows - above])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    out = np.empty((len(rows), ROW + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = tried[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """The chunks of a PNG; a bad signature, a cut or a wrong checksum raises ValueError."""
    view, at = memoryview(data), 8
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("the PNG is cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = view[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(data):
            raise ValueError("the PNG is cut short")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"wrong checksum in {kind!r}")
        yield kind, body
        at += 12 + size


def unfilter(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered ``rows`` (uint8, a row each); ``step`` bytes make a pixel."""
    out = np.empty_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        row = rows[y]
        if kind == 0:
            out[y] = row
        elif kind == 1:
            out[y] = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y] = row + above
        elif kind in (3, 4):
            pixels, over, done = row.reshape(-1, step).astype(np.int32), above.reshape(-1, step).astype(np.int32), np.zeros((len(row) // step, step), np.int32)
            a = c = np.zeros(step, np.int32)
            for x in range(len(pixels)):
                b = over[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                done[x] = a = (pixels[x] + guess) & 255
                c = b
            out[y] = done.astype(np.uint8).ravel()
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[y]
    return out


def decode(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey, RGB or RGBA PNG without interlacing, as (height, width, channels)."""
    head, packed = None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(bytes(body))
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or any(head[4:]):
        raise ValueError("only 8-bit grey, RGB and RGBA without interlacing are read")
    width, height, step = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != height * (width * step + 1):
        raise ValueError("the picture has another size than its header says")
    lines = raw.reshape(height, width * step + 1)
    return unfilter(lines[:, 1:], lines[:, 0], step).reshape(height, width, step)


def shrunk(grey: np.ndarray, n: int) -> np.ndarray:
    """Means over ``n`` equal parts of axis 0, each sample counted by its share in the part."""
    sums = np.vstack([np.zeros((1, grey.shape[1])), np.cumsum(grey, axis=0)])
    at = np.arange(n + 1) * (len(grey) / n)
    low = np.minimum(at.astype(int), len(grey) - 1)
    edge = sums[low] + (at - low)[:, None] * grey[low]
    return np.diff(edge, axis=0) * (n / len(grey))


def cosine_hash(picture: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies exceed their median (the mean aside)."""
    grey = picture.astype(np.float64).mean(axis=2)
    small = shrunk(shrunk(grey, SIDE).T, SIDE).T
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    wave = np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))
    low = np.round(wave @ small @ wave.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def png_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: the text of each row of ``docs`` stored as a PNG.

    Null is the empty text (a row of 192 spaces); a null ``doc_id`` and repeated rows are kept;
    other columns are ignored; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = [payload_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([encode(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, MEDIA)


def png_features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: the payload's digest and tail, the file's digest and a
    cosine-transform hash, as text and as a binary column. A damaged file raises ValueError."""
    bounded_batches(media.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for file in batch.column(2).to_pylist():
                picture = decode(file)
                payload = picture.tobytes()
                bits = cosine_hash(picture)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), bits.hex(), bits))
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "dct_hash"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a PNG and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return png_features(png_media(docs)).drop("dct_hash")
