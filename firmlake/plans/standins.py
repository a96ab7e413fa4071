"""Relations of the operators' shapes over tables that hold no firmware: functions, address space, call graph and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared folder, deleted when the application ends; a temporary one where none is set, as in tests."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions: non-blank lines of all documents, the digest of the lower-cased line."""
    docs = table(spark, sf_dir, "documents")
    df = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''")
    text = F.lower(F.trim("line"))
    return df.select(
        "doc_id",
        "pos",
        F.sha2(F.concat(F.lit("v3\n"), text), 256).alias("digest"),
        (F.col("doc_id") % 3).alias("build_id"),
        F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string")).alias("name"),
        F.col("source").alias("component"),
        F.when(F.col("doc_id") % 2 == 0, "linked").otherwise("archive").alias("origin"),
        (F.col("doc_id") % 4 == 0).alias("target"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where("target").select("doc_id", "pos", "digest")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest of the lines, restricted to digests that a target has, distinct."""
    from firmlake.operators.match import current_signatures

    builds = spark.range(3).select(F.col("id").alias("build_id"), F.lit("c").alias("chip"), F.lit(3).alias("canon_version"))
    return current_signatures(lines(spark, sf_dir).where("NOT target"), builds, "c", 3, targets(spark, sf_dir))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address space a user: events as functions."""
    empty = F.array().cast("array<string>")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("image"),
        F.col("event_id").alias("vaddr"),
        (16 + F.floor("value")).alias("size"),
        F.col("event_type").alias("component"),
        (F.col("event_type") != "signup").alias("identified"),
        F.when(F.col("event_type") == "error", F.array(F.lit("x"))).otherwise(empty).alias("ambiguous_with"),
        empty.alias("shared_components"),
    )


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from firmlake.operators.layout import anchors

    return anchors(members(spark, sf_dir))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), "p_name", "p_size")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") % 2500).alias("dst"))


def flow(calls: DataFrame, entries: DataFrame, hangs: DataFrame, shortcut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of functions that make their calls one after the other, in the order of the callees: (blocks, edges) as ``graph.noreturn`` takes them.

    After the last call, or at once without any, comes a return, but in functions that hang; in those with a shortcut another return is reached from the start.
    """
    from pyspark.sql import Window

    ordered = calls.withColumn("block", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).select(F.col("src").alias("fn"), "block", F.col("dst").alias("callee"))
    count = entries.select(F.col("entry").alias("fn")).join(ordered.groupBy("fn").agg(F.max("block").alias("n")), "fn", "left").select("fn", F.coalesce("n", F.lit(0)).alias("n"))
    nothing = F.lit(None).cast("long")
    first = count.select("fn", F.lit(0).alias("block"), nothing.alias("callee"), F.lit(False).alias("returns"))
    last = count.join(hangs.withColumn("hangs", F.lit(True)), F.col("fn") == F.col("entry"), "left").select("fn", (F.col("n") + 1).alias("block"), nothing.alias("callee"), F.col("hangs").isNull().alias("returns"))
    aside = shortcut.select(F.col("entry").alias("fn"), F.lit(-1).alias("block"), nothing.alias("callee"), F.lit(True).alias("returns"))
    blocks = first.union(ordered.withColumn("returns", F.lit(False))).union(last).union(aside)
    on = count.select("fn", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("src")).select("fn", "src", (F.col("src") + 1).alias("dst"))
    return blocks, on.union(shortcut.select(F.col("entry").alias("fn"), F.lit(0), F.lit(-1)))


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions a user: events in order, their class from the type."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    n = F.col("event_id")
    reg = F.concat(F.lit("a"), (n % 3).cast("string"))
    nothing = F.lit(None).cast("long")

    def by_kind(view, click, purchase, signup, error):
        return F.when(kind == "view", view).when(kind == "click", click).when(kind == "purchase", purchase).when(kind == "signup", signup).otherwise(error)

    return e.select(
        F.col("user_id").cast("string").alias("fn"),
        n.alias("addr"),
        F.lit(3).alias("size"),
        by_kind(*map(F.lit, ("l32r", "callx8", "call8", "beqz.n", "addi.n"))).alias("mnemonic"),
        by_kind(F.array(reg, F.lit("0x90")), F.array(reg), F.array(F.lit("0x40")), F.array(reg, F.lit("0x80")), F.array(reg, reg, F.lit("-32"))).alias("operands"),
        by_kind(*map(F.lit, ("literal_load", "call_indirect", "call", "branch", "normal"))).alias("cls"),
        by_kind(nothing, nothing, n + 64, n + 12, nothing).alias("target"),
        F.when((kind == "view") & (n % 4 != 0), n * 16).alias("literal_value"),
        F.lit(None).cast("string").alias("target_symbol"),
        F.lit(None).cast("string").alias("literal_text"),
    )


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds: one a (source, lang), its first document as configuration."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    first = docs.groupBy("source", "lang").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    ordinal = F.row_number().over(Window.orderBy("source", "lang"))
    from firmlake.functions.scalar import config_hash

    return first.select(
        ordinal.cast("long").alias("build_id"),
        F.col("source").alias("idf_version"),
        F.col("lang").alias("config_name"),
        config_hash(F.col("text")).alias("config_hash"),
        F.when(F.col("doc_id") % 2 == 0, "c0").otherwise("c1").alias("chip"),
        F.lit("t").alias("toolchain"),
        (3 - ordinal % 2).alias("canon_version"),
        F.col("doc_id").cast("string").alias("created_at"),
    )


# Overlapping bands over order prices; the last two are equally wide, so their order decides.
BANDS = {
    "m0": [("all", 0, 600_000), ("low", 0, 150_000), ("mid", 100_000, 260_000), ("half", 0, 300_000), ("twin_a", 200_000, 240_000), ("twin_b", 220_000, 260_000)],
    "m1": [("upper", 250_000, 600_000), ("tip", 400_000, 450_000)],
    "m2": [("floor", 0, 50_000)],
}
