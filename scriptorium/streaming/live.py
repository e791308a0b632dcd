"""Live sessions with state and timers: flush loop, micro-batches by count or time, debounced re-selection.

State is kept by key in RocksDB and checkpointed; timers run on processing time, as the intervals are
those of people and services waiting. What is sent is written once for each micro-batch: a batch that is
replayed after a failure replaces its own rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from scriptorium.operators import selection as S

FLUSH, QUIET = 1000, 500  # milliseconds, fixed values: between two flushes, and without changes before a re-selection
CALL, WAIT = 16, 50  # fixed values: requests of a call at most, and milliseconds that the first one waits
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession):
    """State with several variables and timers needs RocksDB; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def written_once(path: str) -> Callable[[DataFrame, int], None]:
    """An idempotent sink for ``foreachBatch``: a folder for each batch id, which a replay replaces."""

    def put(part: DataFrame, batch: int) -> None:
        part.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return put


def kept_running(start: Callable[[], StreamingQuery], done: Callable[[], bool], restarts: int = 0, seconds: float = 120) -> int:
    """Runs a query until ``done``, starting it again from its checkpoint when it fails, up to ``restarts`` times;
    gives the number of restarts. A query without new rows for ``seconds`` that isn't done is an error; one that
    still gets rows may take as long as these need."""
    until, again, read = time.monotonic() + seconds, 0, None
    query = start()
    try:
        while time.monotonic() < until:
            fed = max((p.batchId for p in query.recentProgress if p.numInputRows), default=None)
            if (again, fed) != read:
                until, read = time.monotonic() + seconds, (again, fed)
            if query.exception() is not None:
                if again == restarts:
                    raise query.exception()
                again, query = again + 1, start()
            else:
                looked = time.monotonic()
                if done():
                    return again
                time.sleep(min(3 * (time.monotonic() - looked), 10))  # looking takes a quarter of the time at most
            time.sleep(0.3)
    finally:
        query.stop()
    raise TimeoutError("the stream was not done in time")


class Flushed(StatefulProcessor):
    """STR2: messages of a session ``session, kind, id, n`` in; ``session, seq, kind, ids`` out.

    ``start`` says how many batches the session has (``n``), ``segment`` is a result, ``success`` ends a batch and
    ``cancel`` the session. Results wait for the next flush; when all batches have ended and nothing waits any more,
    ``success`` is sent and the session closes. A cancelled session's results are sent at once, and it closes.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long")
        self.session = handle.getValueState("session", "batches long, ended long, seq long, ticking boolean")

    def _now(self) -> list:
        return list(self.session.get() or (None, 0, 0, False))

    def _sent(self, key, ids: list, now: list, closing: str | None) -> pd.DataFrame:
        rows = [(key[0], now[2] + k, kind, mine) for k, (kind, mine) in enumerate([("batch", ids)] * bool(ids) + [(closing, [])] * bool(closing))]
        now[2] += len(rows)
        return pd.DataFrame(rows, columns=["session", "seq", "kind", "ids"])

    def _close(self, now: list) -> None:
        self.waiting.clear()
        self.session.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, cancelled = self._now(), False
        for frame in rows:
            kinds = frame["kind"].tolist()
            results = [(int(i),) for kind, i in zip(kinds, frame["id"].tolist()) if kind == "segment"]
            if results:
                self.waiting.appendList(results)
            for kind, n in zip(kinds, frame["n"].tolist()):
                now[0] = int(n) if kind == "start" else now[0]
            now[1] += kinds.count("success")
            cancelled = cancelled or "cancel" in kinds
        if cancelled:
            ids = [r[0] for r in self.waiting.get()]
            self._close(now)
            yield self._sent(key, ids, now, "cancelled")
            return
        if not now[3]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + FLUSH)
            now[3] = True
        self.session.update(tuple(now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, ids = self._now(), [r[0] for r in self.waiting.get()]
        if now[0] is not None and now[1] >= now[0]:
            out = self._sent(key, ids, now, "success")
            self._close(now)
            yield out
            return
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + FLUSH)
        if ids:  # else there is nothing to send
            out = self._sent(key, ids, now, None)
            self.waiting.clear()
            self.session.update(tuple(now))
            yield out

    def close(self) -> None:
        pass


def flushed(messages: DataFrame) -> DataFrame:
    """STR2 on a stream of ``session, kind, id, n``."""
    return messages.select(F.col("session").cast("long"), "kind", F.col("id").cast("long"), F.col("n").cast("long")).groupBy("session").transformWithStateInPandas(Flushed(), "session long, seq long, kind string, ids array<long>", "append", "processingTime")


class MicroBatched(StatefulProcessor):
    """STR6: requests ``lane, id, text`` of a group in; ``id, answer, error, size`` out. Requests wait until there are
    ``most`` of them or the first has waited ``wait`` milliseconds, and then share a call; an error of the call goes to
    each of its requests."""

    def __init__(self, call: Callable[[list[str]], list[str]], most: int = CALL, wait: int = WAIT):
        self.call, self.most, self.wait = call, most, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, text string")
        self.timer = handle.getValueState("timer", "at long")

    def _answered(self, requests: list) -> list[tuple]:
        try:
            answers, error = self.call([t for _, t in requests]), None
            if len(answers) != len(requests):
                raise ValueError("not as many answers as requests")
        except Exception as e:  # it is the requests' answer
            answers, error = [None] * len(requests), str(e)
        return [(i, answer, error, len(requests)) for (i, _), answer in zip(requests, answers)]

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["id", "answer", "error", "size"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.waiting.get()]
        for frame in rows:
            held += zip(frame["id"].astype(int).tolist(), frame["text"].tolist())
            full = len(held) - len(held) % self.most
            out = [row for k in range(0, full, self.most) for row in self._answered(held[k : k + self.most])]
            held = held[full:]
            if out:  # a frame of answers for one of requests, as each is sent by itself
                yield self._frame(out)
        self.waiting.put(held) if held else self.waiting.clear()
        timer = self.timer.get()
        if held and timer is None:
            at = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(at)
            self.timer.update((at,))
        elif not held and timer is not None:
            self.handle.deleteTimer(timer[0])
            self.timer.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.waiting.get()]
        self.waiting.clear()
        self.timer.clear()
        if held:
            yield self._frame(self._answered(held))

    def close(self) -> None:
        pass


def micro_batched(requests: DataFrame, keys: list[str], call: Callable[[list[str]], list[str]], lanes: int = 1, most: int = CALL, wait: int = WAIT) -> DataFrame:
    """STR6 on a stream of ``id, text`` and ``keys``. A group is one queue; with more ``lanes`` a busy one is dealt to as
    many queues by its requests' ids."""
    laned = requests.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int")).select(*keys, "lane", F.col("id").cast("long"), "text")
    return laned.groupBy(*keys, "lane").transformWithStateInPandas(MicroBatched(call, most, wait), "id long, answer string, error string, size long", "append", "processingTime")


class Reselected(StatefulProcessor):
    """STR9: segments ``doc, id, ord, y, score`` in, a later one in place of an earlier one with its id;
    ``doc, version, changes, ids`` out, with the number of segments received so far. The first change is answered at once; those that follow wait until there was none
    for ``quiet`` milliseconds, and are answered together."""

    def __init__(self, low: float, high: float, least: float, quiet: int = QUIET):
        self.low, self.high, self.least, self.quiet = low, high, least, quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.segments = handle.getValueState("segments", "ids array<long>, ords array<long>, ys array<double>, scores array<double>")
        self.run = handle.getValueState("run", "version long, timer long, dirty boolean, changes long")

    def _known(self) -> dict:
        """A document's segments by id; they are one value, which is read and written once for a batch."""
        return {i: tuple(r) for i, *r in zip(*(self.segments.get() or ((), (), (), ())))}

    def _selection(self, key, version: int, changes: int, known: dict) -> pd.DataFrame:
        rows = sorted((ord_, i, y, score) for i, (ord_, y, score) in known.items() if score is not None)
        y, score = (np.array([np.nan if r[c] is None else r[c] for r in rows], float) for c in (2, 3))
        chosen = S.picks(y, score, self.low, self.high, self.least)
        return pd.DataFrame({"doc": [key[0]], "version": [version], "changes": [changes], "ids": [[rows[i][1] for i in chosen]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        version, timer, _, changes = self.run.get() or (0, None, False, 0)
        known = self._known()
        number = lambda column: [None if x != x else x for x in column.astype(float).tolist()]
        for frame in rows:
            changes += len(frame)
            known.update(zip(frame["id"].astype(int).tolist(), zip(frame["ord"].astype(int).tolist(), number(frame["y"]), number(frame["score"]))))
        self.segments.update((list(known), *(list(c) for c in zip(*known.values()))))
        at = timerValues.getCurrentProcessingTimeInMs() + self.quiet
        if timer is None:
            yield self._selection(key, version + 1, changes, known)
            self.run.update((version + 1, at, False, changes))
        else:
            self.handle.deleteTimer(timer)
            self.run.update((version, at, True, changes))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        version, _, dirty, changes = self.run.get()
        self.run.update((version + dirty, None, False, changes))
        if dirty:
            yield self._selection(key, version + 1, changes, self._known())

    def close(self) -> None:
        pass


def reselections(segments: DataFrame, min_gap: float = S.MIN_GAP, max_gap: float = S.MAX_GAP, least: float = S.MIN_SCORE, quiet: int = QUIET) -> DataFrame:
    """STR9 on a stream of ``doc, id, ord, y, score``; a document's largest ``version`` is its selection."""
    cols = segments.select(F.col("doc").cast("long"), F.col("id").cast("long"), F.col("ord").cast("long"), F.col("y").cast("double"), F.col("score").cast("double"))
    return cols.groupBy("doc").transformWithStateInPandas(Reselected(max(min_gap, S.LEAST_GAP), max_gap, least, quiet), "doc long, version long, changes long, ids array<long>", "append", "processingTime")
