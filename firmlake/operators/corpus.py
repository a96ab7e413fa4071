"""The signature corpus: a builds table, and a functions table in Parquet partitioned by chip, rules version and batch.

A batch is what one ``add`` wrote for a chip and rules version, any number of builds in few files. Plain Parquet has no row updates, so a build is
replaced or removed by writing the rest of its batch anew; stale builds are collected by whole batches. A build's id is a hash of its
natural key, so building it again replaces it, and nothing numbers builds centrally.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.errors import CorpusMissing, UsageError
from firmlake.functions.scalar import config_hash

PARTS = ["chip", "canon_version", "batch"]
KEY = ["idf_version", "config_hash", "chip", "toolchain", "canon_version"]
BUILDS = "build_id long, idf_version string, config_hash string, chip string, toolchain string, config_name string, config_text string, canon_version int, objdump_version string, created_at string"
FUNCTIONS = "name string, component string, object string, origin string, vaddr long, size long, instruction_count long, digest string, canonical_text string, raw_text string, call_edges array<string>, literals array<long>, immediates array<long>, indirect_calls long, branch_count long, prologue string, strings array<string>, chip string, canon_version int, build_id long"


def build_id() -> F.Column:
    return F.abs(F.xxhash64(*KEY) % (1 << 53))


def keyed_builds(rows: DataFrame) -> DataFrame:
    """Adds config_hash, of the normalised configuration, and build_id to rows that have the rest."""
    return rows.withColumn("config_hash", config_hash(F.coalesce("config_text", F.lit("")))).withColumn("build_id", build_id())


class Corpus:
    """Tables under a folder. ``functions`` is written with rows sorted by digest in each file, which is what lookups prune by."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, folder: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _table(self, name: str, schema: str) -> DataFrame:
        """The table with its batch; builds that have a folder of their own, as earlier versions wrote them, are read as well, their batch null."""
        kind = T._parse_datatype_string(schema)
        fields = [*kind.fields, T.StructField("batch", T.StringType())]
        rows = self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        if self._exists(f"batches/{name}"):
            rows = self.spark.read.schema(T.StructType(fields)).parquet(f"{self.path}/batches/{name}")
        if self._exists(name):
            rows = rows.unionByName(self.spark.read.schema(kind).parquet(f"{self.path}/{name}").withColumn("batch", F.lit(None).cast("string")))
        return rows

    def builds(self) -> DataFrame:
        return self._table("builds", BUILDS).drop("batch")

    def functions(self) -> DataFrame:
        return self._table("functions", FUNCTIONS).drop("batch")

    def _write(self, rows: DataFrame, path: str, *order: str) -> None:
        rows.sortWithinPartitions(*PARTS, *order).write.partitionBy(*PARTS).parquet(f"{self.path}/{path}")

    def add(self, builds: DataFrame, functions: DataFrame) -> None:
        """Insert builds (without id and hash) with their functions, ``functions`` naming builds by ``build_key``, as ``builds`` does.

        A build with the same natural key is replaced with all its functions, once the new ones are written whole; a write that fails
        leaves what was there.
        """
        keyed = keyed_builds(builds.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")))
        rows = functions.join(keyed.select("build_key", "build_id", "chip", "canon_version"), "build_key").drop("build_key")
        names = [f.name for f in T._parse_datatype_string(FUNCTIONS).fields]
        rows = rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast(T._parse_datatype_string(FUNCTIONS)[n].dataType).alias(n) for n in names])
        stage, batch = f"staged-{uuid.uuid4().hex}", uuid.uuid4().hex
        self._write(rows.withColumn("batch", F.lit(batch)), f"{stage}/functions", "digest")
        self._write(keyed.select(*[f.name for f in T._parse_datatype_string(BUILDS).fields]).withColumn("batch", F.lit(batch)), f"{stage}/builds")
        new = self.spark.read.schema(T.StructType([*T._parse_datatype_string(BUILDS).fields, T.StructField("batch", T.StringType())])).parquet(f"{self.path}/{stage}/builds")
        self._replace(new.select("build_id").distinct(), stage)

    def _replace(self, gone: DataFrame, stage: str) -> None:
        """Take the builds named by ``gone`` out, and bring in what is staged. The rest of their batches is staged first, so only what has been
        written whole takes the place of what was there."""
        held = self._table("builds", BUILDS).join(gone, "build_id", "left_semi")
        touched = [tuple(r) for r in held.where("batch IS NOT NULL").select(*PARTS).distinct().collect()]
        alone = held.where("batch IS NULL").select("chip", "canon_version", "build_id").distinct().collect()
        if touched:
            which = self.spark.createDataFrame(touched, "chip string, canon_version int, batch string")
            for name, schema, order in (("functions", FUNCTIONS, ["digest"]), ("builds", BUILDS, [])):
                rest = self._table(name, schema).join(F.broadcast(which), PARTS, "left_semi").join(gone, "build_id", "left_anti")
                self._write(rest, f"{stage}/rest/{name}", *order)
        for name in ("functions", "builds"):
            for r in alone:
                folder = f"{name}/chip={r.chip}/canon_version={r.canon_version}/build_id={r.build_id}"
                self._move(folder, f"{stage}/old/{folder}")
            for chip, version, batch in touched:
                folder = f"{name}/chip={chip}/canon_version={version}/batch={batch}"
                self._move(f"batches/{folder}", f"{stage}/old/{folder}")
                self._move(f"{stage}/rest/{folder}", f"batches/{folder}")
            if self._exists(f"{stage}/{name}"):
                kind = T._parse_datatype_string("chip string, canon_version int, batch string")
                made = self.spark.read.schema(T.StructType([*T._parse_datatype_string(BUILDS).fields[:1], *kind.fields])).parquet(f"{self.path}/{stage}/{name}")
                for chip, version, batch in (tuple(r) for r in made.select(*PARTS).distinct().collect()):
                    folder = f"{name}/chip={chip}/canon_version={version}/batch={batch}"
                    self._move(f"{stage}/{folder}", f"batches/{folder}")
        self._delete(stage)

    def _move(self, folder: str, to: str) -> None:
        if self._exists(folder):
            paths = [self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{f}") for f in (folder, to)]
            fs = paths[0].getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.mkdirs(paths[1].getParent())
            if not fs.rename(*paths):
                raise OSError(f"could not move {folder}")

    def current(self, chip: str, canon_version: int) -> DataFrame:
        """The chip's builds under the current rules; raises if there is none."""
        df = current_builds(self.builds(), chip, canon_version)
        if not df.limit(1).count():
            raise CorpusMissing(f"no build of {chip} under rules version {canon_version}; ingest an artifact folder first")
        return df

    def select_one(self, version: str | None = None, prefix: str = "", chip: str | None = None) -> int:
        """Id of the one build of a version, of a chip if given, whose config hash begins with prefix; raises unless it is exactly one."""
        builds = self.builds().where(F.col("chip") == chip) if chip else self.builds()
        found = prefixed(builds, prefix, version).select("build_id").limit(2).collect()
        if len(found) != 1:
            raise UsageError("no build matches" if not found else "more than one build matches: give a longer prefix, or the chip")
        return found[0].build_id

    def remove(self, build: int, dry: bool = True) -> int:
        """Functions of a build; unless dry, they and the build are removed."""
        n = self.functions().where(F.col("build_id") == build).count()
        if not dry:
            self._drop(self.builds().where(F.col("build_id") == build))
        return n

    def collect_stale(self, canon_version: int, dry: bool = True) -> tuple[int, int]:
        """(builds, functions) made under other rules; unless dry, they are removed."""
        stale = self.builds().where(F.col("canon_version") != canon_version)
        builds, n = stale.count(), self.functions().where(F.col("canon_version") != canon_version).count()
        if not dry:
            self._drop(stale)
        return builds, n

    def _drop(self, builds: DataFrame) -> None:
        self._replace(builds.select("build_id").distinct(), f"staged-{uuid.uuid4().hex}")


def current_builds(builds: DataFrame, chip: str, canon_version: int) -> DataFrame:
    return builds.where((F.col("chip") == chip) & (F.col("canon_version") == canon_version)).orderBy("idf_version", "config_name", "config_hash", "toolchain", "build_id")


def builds_for(builds: DataFrame, version: str, chip: str, toolchain: str | None = None) -> DataFrame:
    df = builds.where((F.col("idf_version") == version) & (F.col("chip") == chip))
    return (df.where(F.col("toolchain") == toolchain) if toolchain else df).orderBy("build_id")


def prefixed(builds: DataFrame, prefix: str, version: str | None = None) -> DataFrame:
    df = builds.where(F.col("config_hash").startswith(prefix))
    return df.where(F.col("idf_version") == version) if version else df


def counts_by_origin(functions: DataFrame) -> DataFrame:
    """(build_id, archive, linked, total) in one pass."""
    return functions.groupBy("build_id").agg(F.count_if(F.col("origin") == "archive").alias("archive"), F.count_if(F.col("origin") == "linked").alias("linked"), F.count("*").alias("total"))


def listing(builds: DataFrame, functions: DataFrame, canon_version: int, version: str | None = None) -> DataFrame:
    """Builds with counts, whether stale, and warnings; by version, chip and time."""
    df = builds.where(F.col("idf_version") == version) if version else builds
    df = df.join(counts_by_origin(functions), "build_id", "left").na.fill(0, ["archive", "linked", "total"])
    stale = F.col("canon_version") != canon_version
    warnings = F.array_compact(F.array(F.when(stale, "stale"), F.when(F.col("total") == 0, "empty")))
    return df.withColumns({"stale": stale, "warnings": warnings}).orderBy("idf_version", "chip", "created_at", "build_id")


def revision(builds: DataFrame) -> DataFrame:
    """One row: ``build:id@time`` for one build, else the start of a hash over all, in order of id."""
    one = F.concat(F.lit("build:"), F.col("build_id").cast("string"), F.lit("@"), F.col("created_at"))
    df = builds.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("build_id", one.alias("t")))), lambda x: x["t"]), ",").alias("t"))
    return df.select(F.when(F.col("n") == 1, F.col("t")).otherwise(F.left(F.sha2("t", 256), F.lit(16))).alias("revision"))
