"""What the operators share: the shared folder, cut lineages, checked broadcasts."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import shared_dir

#: Rows up to which a narrow table (a few numbers a row) may be broadcast.
BROADCAST_ROWS = 200_000


#: The open scopes of this thread or task; operators in other threads have their own.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def cleared(spark: SparkSession):
    """Deletes the tables that :func:`written` makes inside the block when it ends, but for those that
    are taken out of the list it gives: what outlives the block has to be written and taken out."""
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield made
    finally:
        _SCOPES.reset(token)
        for path in made:
            discarded(spark, path)


def discarded(spark: SparkSession, path: str) -> None:
    """Deletes a table of :func:`written` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Spark deletes a query's shuffle files when it ends, not when the driver collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which goes with the open scopes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES.get():
        scope.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: its lineage ends there, so a
    lost executor costs the reader nothing. The shuffle files of the write go with it, as nothing
    reads them again; the session's own setting holds for all other queries."""
    spark = df.sparkSession
    path = new_place(spark, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is (a shuffle join).

    ``df`` has to be cheap to count: pass a table from :func:`written`.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def row_of(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone; DuckDB's md5 gives the same."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def label_fold() -> Column:
    """``crc32(doc_id as text) mod 5``: rows with 0 are held out of training."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


#: Bytes of rows that Python gets at a time.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Hold Arrow batches to ``most`` bytes, so that a worker's memory doesn't depend on how long
    the texts are (a batch is at least one row). The setting stays for the session, as a plan is
    only run after the operator returned it; a lower one is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", spark.conf.get(key).strip().lower())
    if not found or int(found[1]) << 10 * " kmgtp".index(found[2] or " ") > most:
        spark.conf.set(key, str(most))


def frugal(run):
    """``run`` for mapInArrow, giving back to the machine at the end of a task what its worker's
    allocators hold: idle workers stay, and the executor's memory is for the next stage then."""

    def tidy(batches):
        import ctypes

        import pyarrow

        yield from run(batches)
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: it keeps its memory
            pass

    return tidy
