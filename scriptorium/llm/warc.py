"""Web archives packaged in ZIP: a writer, and a reader by ranges.

An archive holds three stored members: ``archive/data.warc.gz`` (each record a gzip member of its
own), ``indexes/index.cdxj`` (a line per record with its offset and length) and
``datapackage.json``. Archives are files in the shared folder, or cells of a table. The reader finds
members through the central directory (ZIP64 included) and reads records by their ranges; no member is
extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import shared_dir
from scriptorium.sources.iterated import opened

from .common import bounded_batches, new_place, small_side, written

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
ARCHIVE_BYTES, FILE_BYTES = 1 << 20, 1 << 30  # of payload, after which an archive in a cell or in a file is closed
RUN_BYTES, TASK_BYTES = 1 << 22, 1 << 26  # that are read in one go, and by a task on average
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A directory entry whose 16 or 32-bit field is full has its value in the ZIP64 extra field.
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

ARCHIVES, FILES, RUNS = "archive string, content binary", "archive string, size long", "archive string, at long, lengths array<long>"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
FOUND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

Range = Callable[[int, int], bytes]


# --- ZIP ------------------------------------------------------------------------------------


def zip_directory(entries: list[tuple[bytes, int, int, int, int]], start: int, zip64: bool = False) -> bytes:
    """The central directory at ``start`` of ``(name, offset, checksum, size, flags)``, and its end records."""
    directory = bytearray()
    for path, at, crc, size, flags in entries:
        wide = zip64 or max(size, at) >= FULL32
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        short = FULL32 if wide else size
        directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45 if wide else 20, flags, 0, 0, 0x21, crc, short, short, len(path), len(extra), 0, 0, 0, 0, FULL32 if wide else at) + path + extra
    n, length = len(entries), len(directory)
    if zip64 or start >= FULL32 or n >= FULL16:
        directory += struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, start)
        directory += struct.pack("<4sIQI", b"PK\x06\x07", 0, start + length, 1)
        directory += struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, FULL16, FULL16, FULL32, FULL32, 0)
    else:
        directory += struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, length, start, 0)
    return bytes(directory)


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file with stored members; ``zip64`` forces the 64-bit forms, as sizes may."""
    out, entries = bytearray(), []
    for name, body in members:
        path, at, crc = name.encode(), len(out), zlib.crc32(body)
        wide = zip64 or max(len(body), at) >= FULL32
        size = FULL32 if wide else len(body)
        local = struct.pack("<HHQQ", 1, 16, len(body), len(body)) if wide else b""
        out += struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(path), len(local)) + path + local + body
        entries.append((path, at, crc, len(body), 0x800))
    return bytes(out) + zip_directory(entries, len(out), zip64)


class ZipStream:
    """A ZIP file with stored members, written from front to back: a member's checksum and size
    (always in 64 bits) follow its data, so nothing but the directory is held."""

    def __init__(self, put: Callable[[bytes], object]):
        self.put, self.at, self.entries = put, 0, []

    def add(self, data: bytes) -> None:
        self.put(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterator[bytes]) -> int:
        """Writes a member; its size."""
        path, start, crc = name.encode(), self.at, 0
        self.add(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0x808, 0, 0, 0x21, 0, FULL32, FULL32, len(path), 20) + path + struct.pack("<HHQQ", 1, 16, 0, 0))
        first = self.at
        for data in parts:
            crc = zlib.crc32(data, crc)
            self.add(data)
        size = self.at - first
        self.add(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))
        self.entries.append((path, start, crc, size, 0x808))
        return size

    def close(self) -> int:
        """Writes the directory; the size of the file."""
        self.add(zip_directory(self.entries, self.at))
        return self.at


def zip_members(read: Range, size: int) -> dict[str, tuple[int, int, int]]:
    """``{name: (offset of the data, length, method)}`` of a ZIP of ``size`` bytes, by ranges."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) - at < 22:
        raise ValueError("no end of central directory")
    _, _, _, n, length, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    if n == FULL16 or length == FULL32 or start == FULL32:
        where = tail_at + at - 20
        locator = read(where, 20) if where >= 0 else b""
        if locator[:4] == b"PK\x06\x07":
            end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, at, found = read(start, length), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, packed, plain = struct.unpack_from("<H", directory, at + 10)[0], *struct.unpack_from("<II", directory, at + 20)
        named, extra, note = struct.unpack_from("<HHH", directory, at + 28)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + named].decode()
        field, stop = at + 46 + named, at + 46 + named + extra
        while field + 4 <= stop:
            kind, long = struct.unpack_from("<HH", directory, field)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{long // 8}Q", directory, field + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            field += 4 + long
        local = read(offset, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        found[name] = (offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed, method)
        at = stop + note
    return found


# --- WARC -----------------------------------------------------------------------------------


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def urn_page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and len(urn) > 11 else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit keeps the HTTP head, whose Content-Length is the payload's."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    else:
        block += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def parsed(raw: bytes) -> dict:
    """A record's page, type and payload; a response whose digest is wrong raises ValueError."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]):
        raise ValueError("the record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    whole = warc["warc-type"] == "response"
    if whole and digest_of(payload) != digest:
        raise ValueError(f"wrong payload digest in {warc['warc-record-id']}")
    return {
        "page_id": urn_page(warc["warc-record-id"]), "url": warc["warc-target-uri"], "record_type": warc["warc-type"], "refers_to": urn_page(warc.get("warc-refers-to")),
        "payload_bytes": int(fields(http)["content-length"]), "payload_digest": digest, "payload": payload if whole else None,
    }


def unzipped(raw: bytes) -> bytes:
    """A record's gzip member, unpacked; damage raises ValueError."""
    try:
        return gzip.decompress(raw)
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError("a record's gzip member is damaged") from e


def one_line(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url or "")


def entry_of(url: str, payload: bytes, kind: str, offset: int, length: int) -> str:
    """A line of the index: what a record is and where it lies in the data member."""
    entry = {"url": url, "digest": digest_of(payload), "mime": "warc/revisit" if kind == "revisit" else "text/html", "filename": "data.warc.gz", "offset": offset, "length": length}
    return f"{url} {DATE} {json.dumps(entry)}"


def package_of(data: int, index: int) -> bytes:
    return json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA, "bytes": data}, {"path": INDEX, "bytes": index}]}).encode()


def packed_records(rows, index: list[str]) -> Iterator[bytes]:
    """The gzip member of each ``(page_id, url, payload, kind, refers_to)``; its line goes to ``index``."""
    at = 0
    for page_id, url, payload, kind, refers_to in rows:
        packed = gzip.compress(record(page_id, one_line(url), payload, kind, refers_to), 5, mtime=0)
        index.append(entry_of(one_line(url), payload, kind, at, len(packed)))
        at += len(packed)
        yield packed


def streamed(rows, put: Callable[[bytes], object]) -> int:
    """Writes the archive of ``(page_id, url, payload, kind, refers_to)`` rows record by record; its size.
    Only the index is held."""
    out, index = ZipStream(put), []
    data = out.member(DATA, packed_records(rows, index))
    lines = out.member(INDEX, ((x + "\n").encode() for x in sorted(index)))
    out.member(PACKAGE, iter([package_of(data, lines)]))
    return out.close()


def archive(rows: list[tuple]) -> bytes:
    """The archive of ``(page_id, url, payload, kind, refers_to)`` rows."""
    index: list[str] = []
    data = b"".join(packed_records(rows, index))
    lines = "".join(x + "\n" for x in sorted(index)).encode()
    return zip_stored([(DATA, data), (INDEX, lines), (PACKAGE, package_of(len(data), len(lines)))])


def record_places(read: Range, size: int) -> list[tuple[int, int]]:
    """``(offset in the file, length)`` of each record of an archive, in the order of its index; reads the
    tail, the directory, the members' headers and the index."""
    members = zip_members(read, size)
    for name in (DATA, INDEX):
        if name not in members or members[name][2] != 0:
            raise ValueError(f"{name} is missing or compressed")
    start, length, _ = members[DATA]
    places = []
    for line in read(*members[INDEX][:2]).splitlines():
        entry = json.loads(line.split(b" ", 2)[2])
        if entry["offset"] + entry["length"] > length:
            raise ValueError("the index points past its member")
        places.append((start + entry["offset"], entry["length"]))
    return places


def runs(places: list[tuple[int, int]], most: int) -> Iterator[tuple[int, list[int]]]:
    """Records that follow one another, as the offset of the first and all lengths: a run is read in
    one go and holds ``most`` bytes at most, or one record."""
    at, held = None, []
    for offset, length in sorted(places):
        if held and (offset != at + sum(held) or sum(held) + length > most):
            yield at, held
            held = []
        at = at if held else offset
        held.append(length)
    if held:
        yield at, held


def records(read: Range, size: int) -> Iterator[dict]:
    """The records of an archive, each by the range that its index names."""
    for at, length in record_places(read, size):
        yield parsed(unzipped(read(at, length)))


# --- Spark ----------------------------------------------------------------------------------


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload a page with a larger id has.

    Only ids and digests are shuffled. Groups are summed up before the shuffle, so a payload that a
    third of all pages share costs no more than any other.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keys = written(pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")), "page-keys")
    groups = keys.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("of")).filter("of > 1 AND refers_to IS NOT NULL").drop("of")
    return keys.join(small_side(written(groups, "page-groups")), "digest").filter("NOT (page_id <=> refers_to)").select("page_id", "digest", "refers_to").distinct()


def typed(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id, url, payload, kind, refers_to`` of each page."""
    again = small_side(written(revisits(pages, min_bytes), "revisits").select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("refers_to").alias("__to"), F.lit(True).alias("__again")))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    found = pages.select("page_id", "url", payload.alias("payload")).join(again, F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha1("payload") == F.col("__digest")), "left")
    kind: Column = F.when(F.col("__again"), "revisit").otherwise("response")
    return found.select("page_id", "url", "payload", kind.alias("kind"), F.col("__to").alias("refers_to"))


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``archive, content``: the archives of ``page_id, url, html``, written to the shared folder.

    Of pages with equal payloads of at least ``min_bytes``, the one with the largest ``page_id`` is
    a response and the others revisit it; all smaller ones are responses. Null html is the empty
    payload, a null url empty; a null ``page_id`` revisits if any equal page has an id; equal rows
    that repeat get the same type. Extra columns are ignored. An archive closes once it holds
    ``archive_bytes`` of payload.
    """
    bounded_batches(pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, rows = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                held += len(row[2])
                if held >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{seq:06d}"]), pa.array([archive(rows)], pa.binary())], ["archive", "content"])
                    seq, held, rows = seq + 1, 0, []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{seq:06d}"]), pa.array([archive(rows)], pa.binary())], ["archive", "content"])

    return written(typed(pages, min_bytes).mapInArrow(run, ARCHIVES), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives: any table with a binary ``content``, so also Spark's
    ``binaryFile`` source over real files. A damaged archive or record raises ValueError."""
    bounded_batches(archives.sparkSession)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                whole = memoryview(content.as_buffer())
                yield pa.RecordBatch.from_pylist(list(records(lambda at, n, whole=whole: bytes(whole[at : at + n]), len(whole))), FOUND)

    return archives.select("content").mapInArrow(run, RECORDS)


def opens(folder: str) -> bool:
    """Whether Arrow has a file system for ``folder``."""
    try:
        opened(folder)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def several(rows: Iterator[tuple], most: int) -> Iterator[Iterator[tuple]]:
    """``rows`` in turns that end once they hold ``most`` bytes of payload; each is used up before the next."""

    def turn(first: tuple) -> Iterator[tuple]:
        held, row = 0, first
        while row is not None:
            yield row
            held += len(row[2])
            row = next(rows, None) if held < most else None

    while (first := next(rows, None)) is not None:
        yield turn(first)


def store_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = FILE_BYTES) -> DataFrame:
    """``archive, size``: as :func:`write_archives`, but every archive is a file of the shared folder,
    written from front to back, so a task holds a record and an index, whatever ``archive_bytes``.

    Each attempt of a task writes files of its own, and the table names those of the attempts that
    counted; what a lost or repeated one left behind is never read. The shared folder has to be in a
    store that Arrow opens (local or shared file systems, HDFS, S3, GCS), else ValueError.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = new_place(spark, "archive-files")
    opened(folder)

    def run(batches):
        from pyspark import TaskContext

        store, place = opened(folder)
        store.create_dir(place, recursive=True)
        task = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for seq, turn in enumerate(several(rows, archive_bytes)):
            name = f"{task}-{seq:06d}.wacz"
            with store.open_output_stream(f"{place}/{name}") as out:
                size = streamed(turn, out.write)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], ["archive", "size"])

    return written(typed(pages, min_bytes).mapInArrow(run, FILES), "archives")


def stored_runs(files: DataFrame, most: int = RUN_BYTES) -> DataFrame:
    """``archive, at, lengths``: what :func:`read_stored` reads in one go, from the directories and
    indexes of ``archive, size`` alone; a row or none for records that follow one another. A size that
    is too small or a file without an archive raises ValueError."""

    def run(batches):
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = opened(path)
                with store.open_input_file(place) as f:
                    found = list(runs(record_places(lambda at, n, f=f: f.read_at(n, at), size), most))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["archive", "at", "lengths"])

    return files.select("archive", F.col("size").cast("long")).mapInArrow(run, RUNS)


def read_stored(files: DataFrame, most: int = RUN_BYTES) -> DataFrame:
    """The records of archives in files, ``archive, size``: a first pass reads directories and indexes and
    sends pointers, a second reads the runs of records, so one large archive is read by many tasks. No
    archive is held or extracted; a task holds ``most`` bytes, or one record. An empty table and archives
    without records have no rows; a row that repeats is read again; extra columns are ignored. A damaged
    archive or record raises ValueError.
    """
    spark = files.sparkSession
    pointers = written(stored_runs(files, most), "archive-runs")
    total = pointers.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))

    def run(batches):
        for batch in batches:
            for path, at, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = opened(path)
                with store.open_input_file(place) as f:
                    whole = f.read_at(sum(lengths), at)
                found, first = [], 0
                for n in lengths:
                    found.append(parsed(unzipped(whole[first : first + n])))
                    first += n
                yield pa.RecordBatch.from_pylist(found, FOUND)

    return pointers.repartition(parts, "archive", "at").mapInArrow(run, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back by ranges. Where Arrow opens no files in the shared
    folder's store, archives are cells of a table there, and ranges those of a cell."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = read_stored(store_archives(pages)) if opens(shared_dir(spark)) else read_archives(write_archives(pages))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 takes 5 bits a letter: 4 letters from each 5 of the 40 hexadecimal digits.
ORACLE = {
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS x FROM p),
d AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST(('0x' || substr(x, CAST(1 + 5 * (k // 4) AS INTEGER), 5)) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest
  FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY payload_digest) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY payload_digest) THEN NULL ELSE max(page_id) OVER (PARTITION BY payload_digest) END AS refers_to
FROM d
""",
}
