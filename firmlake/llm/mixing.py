"""Mixing sources to target weights, with DataFrame functions only.

Word counts are summed by source; the sums give each source a target, the target a repetition rate, and each
document is taken floor(rate) times, plus once more with probability equal to the fraction, decided by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlake.llm.common import WORD, bounded_join, written

CAP = 3  # a source's target and a document's repetitions stop here
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = CAP, weight: Column | None = None) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target), one row a source.

    The targets share the sum of all sizes by weight. None exceeds ``cap`` times its source's size; what
    a capped source leaves is shared again by weight. Sorted by cap/weight, the capped sources come first, so
    one running sum finds them: a source is capped if its cap is at most its share of what those before it
    left. ``weight``: by default 1, 2, 3, repeating, in code-point order, a null source last. Sources
    of size zero get the target zero. The windows run over the table of sources, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("rank", F.row_number().over(by_name))
    df = df.withColumn("weight", ((F.col("rank") - 1) % 3 + 1 if weight is None else weight).cast("double"))
    df = df.withColumn("cap", F.col("source_size").cast("double") * cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns(
        {
            "total": F.sum(F.col("source_size")).over(everything).cast("double"),
            "before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    df = df.withColumn("capped", F.col("cap") * F.col("rest") <= F.col("weight") * (F.col("total") - F.col("before")))
    df = df.withColumns(
        {
            "held": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything),
            "open": F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything),
        }
    )
    share = F.col("weight") * (F.col("total") - F.col("held")) / F.nullif(F.col("open"), F.lit(0.0))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(share)
    return df.select("source", "source_size", "weight", target.alias("target"))


ADDED = ("_size", "_source_size", "_target", "_copies")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies, the times that the mix takes each row.

    A null text has size zero; a null source is a source. The decision hashes the seed, the id and the text, so
    reruns agree, and equal rows are decided alike. An empty table gives none. Of the input only the three named
    columns are looked at; all pass through, and where one has the name of an added column, that gets a further underscore.
    """
    names = {}
    for name in ADDED:
        names[name] = name
        while names[name] in docs.columns:
            names[name] = "_" + names[name]
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    # texts are counted again in the second pass: cheaper than moving them
    sized = row.withColumn("_size", word_count(F.col("_row")[text_col]))
    source = F.col("_row")[source_col]
    sums = sized.groupBy(source.alias("source")).agg(F.sum("_size").alias("source_size"))
    plan = written(targets(sums, cap), "mix-targets").select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    df = bounded_join(sized, plan, source.eqNullSafe(F.col("_source")), "left")
    rate = F.least(F.col("_target") / F.nullif(F.col("_source_size"), F.lit(0)), F.lit(float(cap)))
    text = [F.lit(seed), F.coalesce(F.col("_row")[id_col].cast("string"), F.lit("")), F.coalesce(F.col("_row")[text_col], F.lit(""))]
    chance = F.conv(F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    times = F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)
    df = df.withColumn("_copies", F.coalesce(times, F.lit(0)).cast("int"))
    return df.select("_row.*", *[F.col(k).alias(v) for k, v in names.items()])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``, whatever their names.

    Defined for all inputs as in ``copies``; rows taken zero times are absent.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source_of"))
    df = copies(rows, "_id", "_text", "_source_of", cap, seed).where("_copies > 0")
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share in the mix of all. Nulls, ties, repeated rows and an empty table as in ``copies``; each word of a very long
    text counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = copies(docs.select("doc_id", "text", "source"))
    return df.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM s),
w AS (SELECT *, ((rk - 1) % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap FROM r),
x AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS bef,
    sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
y AS (SELECT *, cap * rest <= weight * (total - bef) AS capped FROM x),
z AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER () AS held,
    sum(CASE WHEN capped THEN 0.0 ELSE weight END) OVER () AS op FROM y),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * (total - held) / nullif(op, 0) END AS target FROM z),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, least(t.target / nullif(t.source_size, 0), 3.0) AS rate,
    ('0x' || substr(sha256('mix-1|' || coalesce(d.doc_id::VARCHAR, '') || '|' || coalesce(d.text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS chance
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * coalesce(floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END, 0))::BIGINT AS taken FROM j
"""
