"""Queries of the streaming forms: a stream over the events, read to its end."""

import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scriptorium.session import shared_dir, table
from scriptorium.sources import iterated as I
from scriptorium.streaming import jobs as J
from scriptorium.streaming import live as L

from .base import query, r6
from .selecting import SCAN, segments


@query("str1_batches", "SELECT user_id AS doc, event_id AS id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 32 AS INTEGER) AS batch FROM events")
def str1(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("id"), F.col("event_id").alias("ord"))
    return J.batched(e, "minilm_svm").select("doc", "id", "batch")


@query("str1b_file_stream", "SELECT event_id, event_type FROM events")
def str1b(spark, sf):
    return J.drained(J.stream(spark, sf, "events").select("event_id", "event_type"))


@query("str2_flushes", "SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def str2(spark, sf):
    out = J.flushes(table(spark, sf, "events"), "1 hour")
    return out.select("user_id", F.unix_seconds("start").alias("start"), "n", r6("total"))


@query("str2b_flushes_stream", "WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events) SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, count(*) AS n FROM events, m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= w GROUP BY ALL")
def str2b(spark, sf):
    """What a stream has sent by its end: windows that the watermark has passed."""
    return J.drained(J.flushes(J.stream(spark, sf, "events"), "1 hour")).select("user_id", F.unix_seconds("start").alias("start"), "n")


LIVES = """t AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 1 DAY, false)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stretch FROM t)
SELECT user_id, event_id, bool_or(event_type = 'signup') OVER (PARTITION BY user_id, stretch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ok FROM s"""


@query("str3_sessions", f"WITH {LIVES}")
def str3(spark, sf):
    return J.with_lifetime_batch(table(spark, sf, "events"), seconds=86400)


@query("str3b_sessions_stream", f"WITH {LIVES}")
def str3b(spark, sf):
    return J.drained(J.with_lifetime(J.stream(spark, sf, "events"), seconds=86400))


@query("str4_alive_only", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def str4(spark, sf):
    e = table(spark, sf, "events")
    return J.alive_only(e, e.filter("event_type = 'signup'"), "user_id").select("event_id")


@query("str5_completion", "SELECT user_id, count(*) AS started, count(*) FILTER (event_type = 'purchase') AS finished FROM events GROUP BY user_id")
def str5(spark, sf):
    rows = J.drained(J.completion(J.stream(spark, sf, "events")), "update")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("started", "finished"), "__batch").alias("v")).select("user_id", "v.*")


@query("str6_micro_batches", "WITH b AS (SELECT event_type, event_id, epoch_us(ts) // 3600000000 AS slot, ts FROM events), p AS (SELECT *, (row_number() OVER (PARTITION BY event_type, slot ORDER BY ts, event_id) - 1) // 16 AS part FROM b) SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type || ':' || count(*) OVER (PARTITION BY event_type, slot, part) END AS answer, CASE WHEN event_type = 'error' THEN 'refused' END AS error FROM p")
def str6(spark, sf):
    def call(kinds):
        if kinds[0] == "error":
            raise ValueError("refused")
        return [f"{k}:{len(kinds)}" for k in kinds]

    parts = J.micro_batches(table(spark, sf, "events"), ("event_type",), "ts", "event_id", millis=3_600_000)
    return J.answered(parts.withColumn("kind", F.col("event_type")), call, ("event_type",), "event_id", "kind")


CHANGED = SCAN.replace("(event_id * 7919 % 1000) / 1000.0::DOUBLE AS score", "CASE WHEN event_id % 50 = 0 THEN 0.99::DOUBLE ELSE (event_id * 7919 % 1000) / 1000.0::DOUBLE END AS score").replace("WHERE event_type <> 'error' GROUP", "WHERE event_type <> 'error' OR id % 50 = 0 GROUP")
TOUCHED = CHANGED.replace("WHERE event_type <> 'error' OR id % 50 = 0 GROUP", "WHERE (event_type <> 'error' AND doc % 5 <> 4 OR id % 50 = 0) AND doc IN (SELECT doc FROM seg WHERE id % 50 = 0) GROUP")


@query("str9_reselection", f"WITH RECURSIVE {TOUCHED} SELECT scan.doc, unnest(list_transform(kept, lambda j: ids[j])) AS id FROM scan JOIN l ON l.doc = scan.doc")
def str9(spark, sf):
    s = segments(spark, sf).filter("doc % 5 <> 4")
    changed = segments(spark, sf).filter("id % 50 = 0").withColumn("score", F.lit(0.99))
    return J.reselected(spark, s, changed)


@query("str10_bounded_read", "SELECT event_id FROM events ORDER BY event_id LIMIT 100 OFFSET 50")
def str10(spark, sf):
    from scriptorium.sources import readers

    return readers.taken(table(spark, sf, "events"), "event_id", 50, 100).select("event_id")


def _lived(spark, parts, run, done, stop_at=1, files=4):
    """The rows that a live stream sends for ``parts``, which come one after the other as files of a folder.
    It is stopped once, by an error after batch ``stop_at`` was written and before it was committed, and started again."""
    place = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{place}/in")
    put, attempts, busy = L.written_once(f"{place}/out"), [], threading.Lock()

    def sink(part, batch):
        with busy:  # a replay replaces files, so nobody may be reading them
            put(part, batch)
        if batch == stop_at:
            attempts.append(batch)
            if len(attempts) == 1:
                raise RuntimeError("stopped for the test")

    def start():
        source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{place}/in")
        return run(source).writeStream.foreachBatch(sink).option("checkpointLocation", f"{place}/state").trigger(processingTime="100 milliseconds").start()

    def sent():
        return spark.read.parquet(f"{place}/out").drop("batch")

    def all_sent():
        if len(attempts) < 2:  # the batch that was stopped is still to be replaced
            return False
        try:
            with busy:
                return bool(done(sent()))
        except AnalysisException:  # no batch yet
            return False

    with L.rocks(spark):
        L.kept_running(start, all_sent, restarts=1, seconds=600)
    return sent()


@query("str2c_flush_loop", "SELECT user_id AS session, count(*) AS results, count(DISTINCT event_id) AS kinds, CAST(1 AS BIGINT) AS closed FROM events GROUP BY user_id")
def str2c(spark, sf):
    """Each session's results, once each, whatever the flush; then its end."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("id"))
    users = e.select("session").distinct()
    row = lambda df, kind, n=None, i=None: df.select("session", F.lit(kind).alias("kind"), (F.col("id") if i else F.lit(None)).cast("long").alias("id"), F.lit(n).cast("long").alias("n"))
    parts = [row(users, "start", 2), row(e.filter("id % 2 = 0"), "segment", i=True), row(users, "success"), row(e.filter("id % 2 = 1"), "segment", i=True), row(users, "success")]
    total = users.count()
    out = _lived(spark, parts, L.flushed, lambda sent: sent.filter("kind = 'success'").count() >= total)
    ids = F.explode_outer("ids").alias("id")
    rows = out.select("session", "kind", ids)
    return rows.groupBy("session").agg(F.count("id").alias("results"), F.count_distinct("id").alias("kinds"), F.count_if(F.col("kind") == "success").alias("closed"))


@query("str6b_live_micro_batches", "SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN upper(event_type) END AS answer, CASE WHEN event_type = 'error' THEN 'refused' END AS error FROM events")
def str6b(spark, sf):
    def call(kinds):
        if "error" in kinds:
            raise ValueError("refused")
        return [k.upper() for k in kinds]

    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("text"), "event_type")
    total = e.count()
    out = _lived(spark, [e.filter("id % 2 = 0"), e.filter("id % 2 = 1")], lambda s: L.micro_batched(s, ["event_type"], call, lanes=3), lambda sent: sent.count() >= total)
    return out.select("id", "answer", "error")


@query("str9b_live_reselection", f"WITH RECURSIVE {CHANGED} SELECT scan.doc, array_to_string(list_transform(flatten(list(kept ORDER BY i)), lambda j: any_value(ids)[j]), ',') AS ids FROM scan JOIN l ON l.doc = scan.doc GROUP BY scan.doc")
def str9b(spark, sf):
    """The last selection of each document, after changes and a restart."""
    s = segments(spark, sf)
    changed = s.filter("id % 50 = 0").withColumn("score", F.lit(0.99))
    total = s.count() + changed.count()  # no document can have more changes than it has, so their sum tells that all has come
    done = lambda sent: sent.groupBy("doc").agg(F.max("changes").alias("c")).agg(F.sum("c").alias("c")).first()["c"] == total
    out = _lived(spark, [s.filter("id % 2 = 0"), s.filter("id % 2 = 1"), changed], L.reselections, done)
    last = out.groupBy("doc").agg(F.max_by("ids", "version").alias("ids"))
    return last.select("doc", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("src1b_record_source", "SELECT doc_id, md5(text) AS h FROM documents")
def src1b(spark, sf):
    """A stream over the record source that stops half way, fails once, and goes on from its checkpoint."""
    I.registered(spark)
    source, place, failed = f"{sf}/documents.parquet", f"{shared_dir(spark)}/records-{uuid.uuid4().hex}", []
    half = table(spark, sf, "documents").count() // 2
    put = L.written_once(f"{place}/out")

    def sink(part, batch):
        put(part, batch)
        if not failed:
            failed.append(batch)
            raise RuntimeError("stopped for the test")

    def start(take=None):
        reader = spark.readStream.format("records").option("path", source)
        rows = (reader.option("take", take) if take else reader).load().select("doc_id", F.md5("text").alias("h"))
        return rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{place}/state").trigger(processingTime="200 milliseconds").start()

    def sent():
        try:
            return spark.read.parquet(f"{place}/out").count()
        except AnalysisException:  # no batch yet
            return 0

    L.kept_running(lambda: start(half), lambda: bool(failed) and sent() >= half, restarts=1)
    total = table(spark, sf, "documents").count()
    L.kept_running(start, lambda: sent() >= total)
    return spark.read.parquet(f"{place}/out").select("doc_id", "h")


@query("src1c_shared_takes", """WITH a AS (SELECT *, sum((n_chars >= 500)::INT) OVER (ORDER BY doc_id) AS c FROM documents),
ea AS (SELECT min(doc_id) AS edge FROM a WHERE c >= 40), b AS (SELECT *, sum((lang = 'en')::INT) OVER (ORDER BY doc_id) AS k FROM documents WHERE doc_id > (SELECT edge FROM ea)),
eb AS (SELECT min(doc_id) AS edge FROM b WHERE k >= 25)
SELECT doc_id, 'long' AS dataset FROM a WHERE c <= 40 AND n_chars >= 500 UNION ALL SELECT doc_id, 'english' FROM b WHERE k <= 25 AND lang = 'en' UNION ALL SELECT doc_id, 'rest' FROM documents WHERE doc_id > (SELECT edge FROM eb)""")
def src1c(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    takes = {"long": 40, "english": 25, "rest": 1 << 40}
    return I.shared_takes(d, "doc_id", takes, {"long": F.col("n_chars") >= 500, "english": F.col("lang") == "en", "rest": F.lit(True)}).select("doc_id", "dataset")
