"""Scoring sessions as streams: batches, flushes, sessions with a lifetime, completion, re-selection."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.operators import selection as S
from scriptorium.session import shared_dir

SIZES = {"minilm_svm": 32, "nli_roberta": 32, "random": 256, "browser": 16}  # fixed values: segments of a scorer's batch
LIFETIME = 3600  # seconds, fixed value: of a session without messages


def stream(spark: SparkSession, folder: str, name: str, files: int = 1) -> DataFrame:
    """STR1: the files of a table as they come, ``files`` a trigger."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", files).parquet(folder)


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder. ``append`` writes
    Parquet with checkpoints; other modes keep each key's last row, written per micro-batch."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda part, k: part.withColumn("__batch", F.lit(k)).write.mode("append").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema if mode == "append" else f"{df.schema.toDDL()}, __batch bigint").parquet(path)


def batched(segments: DataFrame, model: str, key: str = "doc", order: str = "ord") -> DataFrame:
    """STR1: segments with the number of the batch that a scorer gets them in."""
    return segments.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(key).orderBy(order)) - 1) / SIZES[model]).cast("int"))


def flushes(events: DataFrame, every: str = "1 second", late: str = "10 minutes", key: str = "user_id", at: str = "ts") -> DataFrame:
    """STR2: ``key, start, n, total``: results gathered since the last flush, by tumbling windows; a
    window is sent once the watermark has passed it. Works on streams and tables."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if events.isStreaming else timed
    return timed.groupBy(F.window(at, every).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")


SESSION = "user_id long, event_id long, ok boolean"


def with_lifetime(events: DataFrame, opener: str = "signup", seconds: int = LIFETIME) -> DataFrame:
    """STR3: ``user_id, event_id, ok``: whether a message finds its session: opened before, and with no
    gap beyond the lifetime since. State is one number a session and is dropped when it ends."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        found = []
        for at, event, kind in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["event_id"], rows["event_type"]):
            live = until is not None and at <= until
            if kind == opener or live:
                until = at + seconds * 1_000_000
            found.append((key[0], event, bool(live or kind == opener)))
        if until is not None:
            state.update((int(until),))
            state.setTimeoutTimestamp(max(int(until) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=["user_id", "event_id", "ok"])

    return timed.groupBy("user_id").applyInPandasWithState(run, SESSION, "until long", "append", GroupStateTimeout.EventTimeTimeout)


def with_lifetime_batch(events: DataFrame, opener: str = "signup", seconds: int = LIFETIME) -> DataFrame:
    """STR3 over a table: the same rows by windows. A session's stretch ends at a gap beyond the lifetime;
    within a stretch, messages count from the first opening one on."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    gap = timed.withColumn("new", F.coalesce(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > seconds * 1_000_000, F.lit(False)).cast("int"))
    run = gap.withColumn("stretch", F.sum("new").over(w))
    opened = F.max(F.col("event_type") == opener).over(W.partitionBy("user_id", "stretch").orderBy("ts", "event_id"))
    return run.select("user_id", "event_id", opened.alias("ok"))


def alive_only(work: DataFrame, sessions: DataFrame, key: str = "session") -> DataFrame:
    """STR4: work whose session still is there; to be called in ``foreachBatch`` with the sessions of
    that moment."""
    return work.join(sessions.select(key).distinct(), key, "left_semi")


def completion(events: DataFrame, key: str = "user_id", final: str = "purchase") -> DataFrame:
    """STR5: batches started and finished by session, as running counts."""
    return events.groupBy(key).agg(F.count("*").alias("started"), F.count_if(F.col("event_type") == final).alias("finished"))


def micro_batches(requests: DataFrame, keys: tuple[str, ...], at: str, order: str, size: int = 16, millis: int = 50) -> DataFrame:
    """STR6: requests with ``slot, part``: those of a group (same system, schema, seed) that come within
    the same ``millis`` share calls of up to ``size``."""
    slot = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (millis * 1000))
    rows = requests.withColumn("slot", slot)
    w = W.partitionBy(*keys, "slot").orderBy(at, order)
    return rows.withColumn("part", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def answered(batches: DataFrame, call: Callable[[list[str]], list[str]], keys: tuple[str, ...], order: str, text: str) -> DataFrame:
    """STR6: ``order, answer, error`` by one call for each group and part; an error goes to each of its
    requests. A part is one row while it is called, so a task calls for many of them from one batch."""
    lists = batches.groupBy(*keys, "slot", "part").agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(text).alias("t")))).alias("r"))

    def run(frames):
        for frame in frames:
            ids, texts = frame.column(0), frame.column(1).to_pylist()
            answers, errors = [], []
            for mine in texts:
                try:
                    out, error = list(call(mine)), None
                    if len(out) != len(mine):
                        raise ValueError("not as many answers as requests")
                except Exception as e:
                    out, error = [None] * len(mine), str(e)
                answers += out
                errors += [error] * len(mine)
            yield pa.RecordBatch.from_arrays([pc.list_flatten(ids), pa.array(answers, pa.string()), pa.array(errors, pa.string())], [order, "answer", "error"])

    return lists.select(F.transform("r", lambda x: x["o"]).alias("o"), F.transform("r", lambda x: x["t"]).alias("t")).mapInArrow(run, f"{order} long, answer string, error string")


def reselected(spark: SparkSession, known: DataFrame, changed: DataFrame) -> DataFrame:
    """STR9: the selection of documents that a micro-batch touches, from all their segments as they are
    now; a changed segment replaces the known one."""
    touched = changed.select("doc").distinct()
    old = known.join(touched, "doc", "left_semi").join(changed.select("doc", "id"), ["doc", "id"], "left_anti")
    return S.selected(old.unionByName(changed))
