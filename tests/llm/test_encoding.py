"""op4, op6, op9, op10: exact round trips; odd rows."""

import base64
import hashlib
import zlib

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from scriptorium.llm import lattice, packing, png, warc
from scriptorium.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def by_id(df):
    return sorted(df.select("doc_id", "text").collect(), key=str)


def test_png_holds_every_text(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_media"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_png_of_odd_rows(odd, empty):
    rows = png.png_features(png.png_media(odd)).collect()
    assert len(rows) == odd.count() and {r["payload_bytes"] for r in rows if r["doc_id"] in (1, 2)} == {192}
    assert png.png_features(png.png_media(empty)).count() == 0


def test_damaged_png_is_refused():
    file = bytearray(png.encode(png.payload_of("some text")[1]))
    file[-20] ^= 1
    with pytest.raises(ValueError):
        png.decode(bytes(file))


def test_pieces_decode_to_the_very_text(spark, odd, empty, small):
    v = lattice.vocabulary()
    for docs in (odd, small):
        coded = lattice.encoded(docs, v)
        assert by_id(lattice.decoded(coded, v)) == by_id(docs)
        again = lattice.encoded(docs.repartition(5), v)
        assert sorted(map(str, again.select("doc_id", "ids").collect())) == sorted(map(str, coded.select("doc_id", "ids").collect()))
    assert lattice.decoded(lattice.encoded(empty, v), v).count() == 0
    clash = lattice.encoded(odd.withColumnRenamed("lang", "ids"), v)
    assert clash.columns == ["doc_id", "source", "n_chars", "ids"]
    other = lattice.encoded(small, v, seed=2).select("doc_id", "ids").collect()
    assert sorted(map(str, other)) != sorted(map(str, lattice.encoded(small, v).select("doc_id", "ids").collect()))


def test_packing_is_best_fit_decreasing_and_lossless(spark, odd, empty, small):
    free, out = [], []
    lengths = [7, 3, 5, 5, 2, 9, 1, 4, 10]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [k for k, f in enumerate(free) if f >= lengths[i]]
        k = min(fits, key=lambda k: free[k]) if fits else len(free)
        if not fits:
            free.append(10), out.append([])
        free[k] -= lengths[i]
        out[k].append(i)
    assert sorted(sum(lengths[i] for i in r) for r in packing.best_fit(lengths, 10)) == sorted(sum(lengths[i] for i in r) for r in out)
    words = packing.ranks()
    blank = F.coalesce("text", F.lit("")).alias("text")
    for docs in (odd, small):
        packs = packing.packed(docs, words, row=256)
        assert by_id(packing.unpacked(packs, words)) == by_id(docs.select("doc_id", blank))
        assert packs.filter("cu_seqlens[0] <> 0 OR element_at(cu_seqlens, -1) <> n_tokens OR length(ids) <> 512").count() == 0
    assert packing.packed(empty, words).count() == 0


FORMS = {"cells": (warc.write_archives, warc.read_archives), "files": (warc.store_archives, warc.read_stored)}


@pytest.mark.parametrize("form", FORMS)
def test_warc_of_odd_pages(spark, form):
    write, read = FORMS[form]
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", 1), (2, "u", "<p>x</p>", 2), (3, None, None, None), (4, "a b\n", "", 4), (5, "v", "é" * 300_000, 5), (5, "v", "é" * 300_000, 5), (None, "w", "alone", 6)], "page_id long, url string, html string, payload int")
    rows = read(write(pages)).collect()
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows}
    assert len(rows) == 7
    assert got == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "response", None)}
    digest = {r["page_id"]: r["payload_digest"] for r in rows}
    assert digest[1] == base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
    assert read(write(pages.limit(0))).count() == 0
    assert read(write(pages).limit(0)).count() == 0
    small = write(pages, archive_bytes=1)  # a page or two an archive
    assert small.select("archive").distinct().count() >= 6
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in read(small).collect()} == got


def test_warc_files_are_plain_archives(spark, tmp_path):
    """Python's own zip and gzip modules read what the tasks wrote; runs of records may hold one each."""
    import gzip
    import zipfile

    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k % 7}</p>" * (k + 1)) for k in range(100)], "page_id long, url string, html string").coalesce(2)
    files = warc.store_archives(pages)
    html = {r["page_id"]: r["html"].encode() for r in pages.collect()}
    seen = 0
    for r in files.collect():
        path = r["archive"].removeprefix("file://").removeprefix("file:")
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX, warc.PACKAGE]
            seen += gzip.decompress(z.read(warc.DATA)).count(b"WARC/1.1\r\n")
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    assert seen == 100
    for most in (1, 500, 1 << 22):
        rows = warc.read_stored(files, most).collect()
        assert {r["page_id"]: r["payload"] for r in rows if r["record_type"] == "response"}.items() <= html.items() and len(rows) == 100
    lengths = warc.stored_runs(files, 500).collect()
    assert all(sum(r["lengths"]) <= 500 or len(r["lengths"]) == 1 for r in lengths) and sum(len(r["lengths"]) for r in lengths) == 100


def test_warc_file_beyond_four_gigabytes(spark, tmp_path):
    """A sparse file whose members lie beyond 5 GiB: offsets are in ZIP64 fields, and only a little is read."""
    path, rows = tmp_path / "far.wacz", [(k, f"u{k}", b"x" * 1000 + str(k).encode(), "response", None) for k in range(50)]
    with open(path, "wb") as f:
        f.seek(5 << 30)
        out, index = warc.ZipStream(f.write), []
        out.at = 5 << 30
        out.member(warc.DATA, warc.packed_records(rows, index))
        out.member(warc.INDEX, iter(["".join(x + "\n" for x in index).encode()]))
        size = out.close()
    asked = []
    with open(path, "rb") as f:

        def read(at, n):
            asked.append(n)
            f.seek(at)
            return f.read(n)

        found = list(warc.records(read, size))
    assert [(r["page_id"], r["payload"]) for r in found] == [(k, body) for k, _, body, _, _ in rows]
    assert sum(asked) < 200_000 and size > 5 << 30
    files = spark.createDataFrame([(f"file://{path}", size)], "archive string, size long")
    assert sorted(r["page_id"] for r in warc.read_stored(files).collect()) == list(range(50))


def test_damaged_warc_files_are_errors(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "hello " * 100)], "page_id long, url string, html string")
    row = warc.store_archives(pages).filter("size > 0").first()
    with open(row["archive"].removeprefix("file://").removeprefix("file:"), "rb") as f:
        body = f.read()
    at = body.index(b"\x1f\x8b") + 40
    for name, data in (("cut", body[:-30]), ("flipped", body[:at] + bytes([body[at] ^ 255]) + body[at + 1 :])):
        (tmp_path / name).write_bytes(data)
        files = spark.createDataFrame([(f"file://{tmp_path / name}", len(data))], "archive string, size long")
        with pytest.raises(PythonException, match="ValueError"):
            warc.read_stored(files).collect()


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_members_by_ranges(zip64):
    data = warc.zip_stored([("a", b"x" * 1000), ("b/c", b"")], zip64)
    found = warc.zip_members(lambda at, n: data[at : at + n], len(data))
    assert {k: data[o : o + n] for k, (o, n, _) in found.items()} == {"a": b"x" * 1000, "b/c": b""}
