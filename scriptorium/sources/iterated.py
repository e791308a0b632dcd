"""SRC1, STR10: record iterators as a data source, for batches and streams, with skip and take by position.

A source is a folder of Parquet files (or one file) in order of their names; a record's position is its
place in all of them. The driver reads footers only; each partition is a run of records of one row
group, read where Spark puts it. Positions are the stream's offsets, so a restart goes on where the
checkpoint says, and another dataset can go on where one has stopped. Later files need later names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructType

from scriptorium.operators.ranks import running_sum

ROWS = 1 << 17  # records of a partition at most


@dataclass
class Piece(InputPartition):
    """Records ``first`` to ``first + rows - 1`` of a row group; the first one's position is ``position``."""

    path: str
    group: int
    first: int
    rows: int
    position: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def groups(path: str) -> Iterator[Piece]:
    """The row groups of all files, in order."""
    store, place = opened(path)
    info = store.get_file_info(place)
    files = [info] if info.is_file else store.get_file_info(fs.FileSelector(place, recursive=True))
    position = 0
    for name in sorted(f.path for f in files if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._"):
        with store.open_input_file(name) as f:
            footer = pq.ParquetFile(f).metadata
        for g in range(footer.num_row_groups):
            rows = footer.row_group(g).num_rows
            yield Piece(name, g, 0, rows, position)
            position += rows


def between(path: str, start: int, end: int, most: int = ROWS) -> list[Piece]:
    """The records at positions ``start`` to ``end - 1``, ``most`` a partition."""
    out = []
    for p in groups(path):
        low, high = max(start, p.position), min(end, p.position + p.rows)
        out += [Piece(p.path, p.group, at - p.position, min(most, high - at), at) for at in range(low, high, most)]
    return out


def records(path: str, columns: list[str], piece: Piece) -> Iterator[pa.RecordBatch]:
    store, _ = opened(path)
    with store.open_input_file(piece.path) as f:
        at = 0
        for batch in pq.ParquetFile(f).iter_batches(batch_size=1024, row_groups=[piece.group], columns=columns):
            low, high = max(piece.first, at), min(piece.first + piece.rows, at + batch.num_rows)
            if low < high:
                part = batch.slice(low - at, high - low)
                places = pa.array(range(piece.position + low - piece.first, piece.position + high - piece.first), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, places], [*columns, "position"])
            at += batch.num_rows
            if at >= piece.first + piece.rows:
                return


class Records(DataSource):
    """``spark.read.format("records").option("path", ...)``, with the options ``skip`` and ``take`` (of raw
    records); the columns of the files and ``position``."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> StructType:
        store, _ = opened(self.options["path"])
        first = next(groups(self.options["path"]))
        with store.open_input_file(first.path) as f:
            return from_arrow_schema(pq.ParquetFile(f).schema_arrow, prefer_timestamp_ntz=True).add("position", LongType())

    def reader(self, schema: StructType) -> DataSourceReader:
        return Batch(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return Stream(self.options, schema)


class _Reader:
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], [n for n in schema.names if n != "position"]
        self.skip, self.take = int(options.get("skip", 0)), options.get("take")

    def end(self) -> int:
        total = sum(p.rows for p in groups(self.path))
        return min(total, self.skip + int(self.take)) if self.take is not None else total

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else records(self.path, self.columns, partition)  # None: there is nothing to read


class Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Piece]:
        return between(self.path, self.skip, self.end())


class Stream(_Reader, DataSourceStreamReader):
    """Offsets are positions; a micro-batch holds what has come since the last one."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"position": self.skip}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"position": max(self.end(), self.skip)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return between(self.path, start["position"], end["position"])


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Records)
    return spark


def shared_takes(source: DataFrame, order: str, takes: dict[str, int], accept: dict[str, Column]) -> DataFrame:
    """Datasets that draw on one iterator in turn: ``source`` with ``dataset``, for what each takes. A dataset goes on
    with the record after the last one that the earlier dataset looked at, passes over what it doesn't ``accept``,
    and stops when it has as many as ``takes`` says; so what one has passed over is gone for the next.

    Each cut is found by a running count over range partitions; no task sees a whole source.
    """
    rest, out = source, [source.filter(F.lit(False)).withColumn("dataset", F.lit(None).cast("string"))]
    for name, n in takes.items():
        if n <= 0:  # it doesn't look at any record
            continue
        counted = running_sum(rest, [], [order], F.coalesce(accept[name], F.lit(False)).cast("long"), "taken_")
        out.append(counted.filter((F.col("taken_") <= n) & accept[name]).select(*source.columns, F.lit(name).alias("dataset")))
        edge = counted.filter(F.col("taken_") >= n).agg(F.min(order).alias("edge_"))  # one row; null if the source ran out
        rest = rest.join(F.broadcast(edge), F.col(order) > F.col("edge_")).drop("edge_")
    return reduce(DataFrame.unionByName, out)
