"""Import of a signature corpus kept in a SQLite file: a data source that reads one table by ranges of build ids.

The file must be readable by the executors under the same path. Lists that such corpora keep as JSON text become arrays.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BUILDS = "id long, idf_version string, config_hash string, chip string, toolchain string, config_name string, config_text string, canon_version int, objdump_version string, created_at string"
FUNCTIONS = "build_id long, name string, component string, object string, origin string, vaddr long, size long, instruction_count long, digest string, canonical_text string, raw_text string, call_edges string, literals string, immediates string, indirect_calls long, branch_count long, prologue string, strings string"
TABLES = {"builds": ("id", BUILDS), "functions": ("build_id", FUNCTIONS)}
LISTS = {"call_edges": "array<string>", "literals": "array<long>", "immediates": "array<long>", "strings": "array<string>"}


class Ids(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__(None)
        self.low, self.high = low, high


class SqliteCorpus(DataSource):
    """Format ``sqlite_corpus``. Options: path, table (builds or functions), partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_corpus"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "functions")][1]

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table, self.most = options["path"], options.get("table", "functions"), int(options.get("partitions", 8))

    def rows(self, sql: str, *values) -> Iterator[tuple]:
        connection = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from connection.execute(sql, values)
        finally:
            connection.close()

    def partitions(self) -> list[Ids]:
        key = TABLES[self.table][0]
        low, high = next(self.rows(f"SELECT min({key}), max({key}) FROM {self.table}"))
        if low is None:
            return [Ids(0, 0)]
        step = max(1, -(-(high + 1 - low) // self.most))
        return [Ids(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: Ids) -> Iterator[tuple]:
        key, schema = TABLES[self.table]
        names = ", ".join(c.split()[0] for c in schema.split(", "))
        yield from self.rows(f"SELECT {names} FROM {self.table} WHERE {key} >= ? AND {key} < ?", partition.low, partition.high)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(builds, functions) as ``Corpus.add`` takes them: builds named by ``build_key``, lists as arrays."""
    spark.dataSource.register(SqliteCorpus)
    load = lambda table: spark.read.format("sqlite_corpus").option("table", table).load(path)
    key = lambda c: F.col(c).cast("string").alias("build_key")
    builds = load("builds").select(key("id"), "idf_version", "config_name", "config_text", "chip", "toolchain", "canon_version", "objdump_version")
    functions = load("functions").select(key("build_id"), *[F.from_json(c, LISTS[c]).alias(c) if c in LISTS else F.col(c) for c in (x.split()[0] for x in FUNCTIONS.split(", ")[1:])])
    return builds, functions
