"""Sources with positions, and live sessions: replays, restarts, timers, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from scriptorium.operators import selection as S
from scriptorium.plans import streams as P
from scriptorium.plans.selecting import segments
from scriptorium.sources import iterated as I
from scriptorium.streaming import live as L

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Records in several files and row groups; a file that isn't one."""
    place = tmp_path_factory.mktemp("records")
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = 0
    for name, n in (("a", 250), ("b", 1), ("c", 0), ("d", 333)):
        pq.write_table(pa.table({"id": pa.array(range(at, at + n), pa.int64()), "text": pa.array([f"t{k}" for k in range(at, at + n)])}), place / f"{name}.parquet", row_group_size=100)
        at += n
    (place / "_notes.parquet").write_text("not a table")
    return str(place)


@pytest.mark.parametrize("skip, take", [(0, None), (0, 0), (99, 2), (250, 100), (580, 50), (600, 5)])
def test_records_by_position(spark, folder, skip, take):
    reader = I.registered(spark).read.format("records").option("path", folder).option("skip", skip)
    rows = (reader.option("take", take) if take is not None else reader).load().collect()
    want = list(range(584))[skip : None if take is None else skip + take]
    assert sorted((r["position"], r["id"], r["text"]) for r in rows) == [(k, k, f"t{k}") for k in want]


def test_partitions_are_bounded(folder):
    pieces = I.between(folder, 5, 500, most=30)
    assert all(p.rows <= 30 for p in pieces) and sum(p.rows for p in pieces) == 495
    assert [p.position for p in pieces] == sorted(p.position for p in pieces)


def test_a_stream_goes_on_after_a_stop(spark, folder, tmp_path):
    I.registered(spark)
    put = L.written_once(f"{tmp_path}/out")

    def run(take):
        reader = spark.readStream.format("records").option("path", folder).option("skip", 10)
        rows = (reader.option("take", take) if take else reader).load()
        q = rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["position"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run(123) == list(range(10, 133))
    assert run(None) == list(range(10, 584))
    assert run(None) == list(range(10, 584))


def test_datasets_share_a_source(spark):
    rng = random.Random(2)
    rows = [(k, rng.random() < 0.3, rng.random() < 0.5) for k in range(2000)]
    df = spark.createDataFrame(rows, "pos long, a boolean, b boolean")
    source, want = iter(rows), set()
    for name, n, ok in (("first", 50, 1), ("second", 70, 2), ("none", 0, 1), ("third", 5000, 1)):
        taken = 0
        while taken < n:
            row = next(source, None)
            if row is None:
                break
            if row[ok]:
                taken += 1
                want.add((row[0], name))
    got = I.shared_takes(df, "pos", {"first": 50, "second": 70, "none": 0, "third": 5000}, {"first": F.col("a"), "second": F.col("b"), "none": F.col("a"), "third": F.col("a")})
    assert {(r["pos"], r["dataset"]) for r in got.collect()} == want


def test_replayed_batches_are_written_once(spark, tmp_path):
    put, df = L.written_once(str(tmp_path / "out")), spark.range(10)
    put(df, 0)
    put(df, 1)
    put(df, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def messages(spark, rows):
    return spark.createDataFrame(rows, "session long, kind string, id long, n long").coalesce(1)


def test_flush_loop(spark):
    """Sessions that end, that are cancelled with results waiting, and that have none."""
    first = [(1, "start", None, 2), (2, "start", None, 1), (3, "start", None, 1), (4, "start", None, 5), (1, "segment", 10, None), (1, "segment", 11, None), (4, "segment", 40, None)]
    second = [(1, "success", None, None), (1, "segment", 12, None), (2, "success", None, None), (3, "segment", 30, None), (4, "segment", 41, None), (4, "cancel", None, None)]
    third = [(1, "success", None, None), (3, "success", None, None)]
    closed = lambda sent: sent.filter("kind <> 'batch'").count() >= 4
    out = P._lived(spark, [messages(spark, x) for x in (first, second, third)], L.flushed, closed, files=1).collect()
    ids = {s: sorted(i for r in out if r["session"] == s for i in r["ids"]) for s in (1, 2, 3, 4)}
    assert ids == {1: [10, 11, 12], 2: [], 3: [30], 4: [40, 41]}
    assert {r["session"]: r["kind"] for r in out if r["kind"] != "batch"} == {1: "success", 2: "success", 3: "success", 4: "cancelled"}
    for s in ids:  # the end comes last, and no number twice
        mine = sorted((r["seq"], r["kind"]) for r in out if r["session"] == s)
        assert [k for k, _ in mine] == list(range(len(mine))) and mine[-1][1] != "batch"


def test_micro_batches_by_count_or_time(spark):
    rows = [(k, f"t{k}", "busy" if k < 100 else "calm") for k in range(103)]
    df = spark.createDataFrame(rows, "id long, text string, model string").coalesce(1)
    calls = lambda texts: [t.upper() for t in texts] if "t101" not in texts else ["too few"]
    out = P._lived(spark, [df], lambda s: L.micro_batched(s, ["model"], calls), lambda sent: sent.count() >= 103, stop_at=0).collect()
    got = {r["id"]: r for r in out}
    assert len(out) == len(got) == 103 and max(r["size"] for r in out) == 16
    assert all(got[k]["answer"] == f"T{k}" and got[k]["error"] is None for k in range(100))
    assert sum(r["size"] == 16 for r in out) == 96  # six full calls, the rest by time
    assert {got[k]["answer"] for k in (100, 101, 102)} == {None} and "answers" in got[101]["error"]


def test_live_selection_is_that_of_the_whole_table(spark):
    rows = __spark_entry__.queries()["str9b_live_reselection"](spark, SF).collect()
    s = [r.asDict() for r in segments(spark, SF).collect()]
    for r in s:
        r["score"] = 0.99 if r["id"] % 50 == 0 else r["score"]
    for r in rows:
        mine = sorted((x for x in s if x["doc"] == r["doc"] and x["score"] is not None), key=lambda x: x["ord"])
        import numpy as np

        places = S.picks(np.array([float(x["y"]) for x in mine]), np.array([float(x["score"]) for x in mine]), S.MIN_GAP, S.MAX_GAP, S.MIN_SCORE)
        assert r["ids"] == ",".join(str(mine[k]["id"]) for k in places)
    assert {r["doc"] for r in rows} == {r["doc"] for r in s}
