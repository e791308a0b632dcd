"""Session factory and the few settings that every query relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str = "scriptorium", cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cores))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the test tables; Spark's reader is the only way in, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Only a
    local session without that setting gets a temporary folder; elsewhere its absence is an error."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="scriptorium-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: lineage ends there."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, a lexicon or a row per group, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Hold Arrow batches to ``most`` bytes, so that a worker's memory doesn't depend on how long
    the texts are (a batch is at least one row). The setting stays for the session, as a plan is
    only run after the operator returned it; a lower one is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", spark.conf.get(key).strip().lower())
    if not found or int(found[1]) << 10 * " kmgtp".index(found[2] or " ") > most:
        spark.conf.set(key, str(most))
