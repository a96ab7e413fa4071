"""What the operators share: the shared folder, written tables, splits and text helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that part words: space and the ASCII controls from tab to carriage return.
#: It is also exactly what ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only if it has no more rows than this and few columns.
BROADCAST_ROWS = 100_000


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path in it): a path without a scheme is on the cluster's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the cluster's shared folder, ``spark.checkpoint.dir``; what is there is deleted when the application ends.

    Where the setting is missing, a local master, as in tests, gets a temporary folder for the session; on a cluster that
    would be lost to the executors, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("firmlake.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="firmlake-")
        spark.conf.set("firmlake.shared.dir", base)
    made = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, path = file_system(spark, made)
    fs.deleteOnExit(path)
    return str(fs.makeQualified(path).toString())


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries run within delete their shuffle files when they end, rather than when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read from there.

    Cuts the lineage: an executor lost later costs a re-read, not a recomputation. What was shuffled for it is deleted.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    with tidy(spark):
        out.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        fs, path = file_system(table.sparkSession, table._written_to)
        fs.delete(path, True)


def bounded_join(left: DataFrame, right: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``right`` broadcast only if a count of it proves it small; else a shuffled join.

    The shuffled join leaves hot keys to the adaptive skew-join rule. ``right`` should be a written table.
    """
    return left.join(F.broadcast(right) if right.count() <= rows else right, on, how)


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def crc_of(value, n: int) -> int:
    """The same in Python."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def map_rows(df: DataFrame, make: Callable[[], Callable[[tuple], tuple]], schema: T.StructType | str, rows: int = 512) -> DataFrame:
    """One output row for each input row. ``make()`` runs once a task and returns the row function."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, fn = to_arrow_schema(kind), make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = [fn(row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                columns = list(zip(*made, strict=True)) if made else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def flat_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: T.StructType | str) -> DataFrame:
    """Any number of output rows. ``make()`` runs once a task and returns a function from a batch to column dicts."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, fn = to_arrow_schema(kind), make()
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
        if hasattr(fn, "finish"):
            for columns in fn.finish():
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)
