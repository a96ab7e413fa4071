"""Bounded samples of labelled rows for training, and models shipped to executors."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlake.llm.common import bounded_join, written


def sampled(rows: DataFrame, label: str, per_label: int, labels: int = 100, seed: str = "train-1", within: str | None = None) -> DataFrame:
    """About ``per_label`` rows of each label, for at most ``labels`` of them, the most frequent.

    Rows are chosen by a hash of all columns against the share of the label's count, so the choice does not depend
    on partitioning. With ``within``, shares are those of each (label, within) pair: at most per_label rows a pair.
    """
    keys = [label] + ([within] if within else [])
    counts = rows.where(F.col(label).isNotNull()).groupBy(*keys).count().orderBy(F.desc("count"), *keys).limit(labels).collect()
    take = None
    for r in counts:
        share = per_label / r["count"]
        here = F.lit(True)
        for k in keys:
            here = here & F.col(k).eqNullSafe(F.lit(r[k]))
        if share < 1:
            here = here & (F.xxhash64(F.lit(seed), *rows.columns).bitwiseAND(F.lit((1 << 53) - 1)) < F.lit(int(share * (1 << 53))))
        take = here if take is None else take | here
    return rows.where(take) if take is not None else rows.where("false")


def sampled_all(rows: DataFrame, label: str, per_label: int, labels: int, least: int, seed: str = "train-1") -> DataFrame:
    """About ``per_label`` rows of every label that isn't null, chosen as by ``sampled``.

    With more than ``labels`` of them, each has fewer rows in proportion, but about ``least`` if it has so many: no label is left out.
    """
    counts = written(rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n")), "labels")
    each = max(min(per_label, least), min(per_label, per_label * labels // max(counts.count(), 1)))
    hashed = F.xxhash64(F.lit(seed), *rows.columns).bitwiseAND(F.lit((1 << 53) - 1))
    share = (F.lit(float(each)) / F.col("_n") * F.lit(float(1 << 53))).cast("long")
    df = bounded_join(rows.withColumn("_hash", hashed), counts, F.col(label) == F.col("_label"), "inner")
    return df.where((F.col("_n") <= each) | (F.col("_hash") < share)).select(*rows.columns)


def within_bytes(rows: DataFrame, text: str, total: int, label: str | None = None, seed: str = "bytes-1") -> DataFrame:
    """Of a sample, rows of no more than ``total`` bytes of text, taken in the order of a hash; texts longer than a sixty-fourth of that are left out.

    With ``label``, each label may have an equal share, and keeps its first row if that is too long. The sample's rows, not its texts, must be bounded.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    df = rows.withColumns({"_size": size, "_order": F.xxhash64(F.lit(seed), *rows.columns)})
    if label is None:
        df = df.where(F.col("_size") <= total // 64)
        order, held = zip(*sorted(df.select("_order", "_size").collect()), strict=True) if df.limit(1).count() else ((), ())
        fits = [o for o, n in zip(order, itertools.accumulate(held), strict=True) if n <= total]
        return df.where(F.col("_order") <= fits[-1] if fits else F.lit(False)).select(*rows.columns)
    share = total // max(rows.select(label).distinct().count(), 1)
    by_label = Window.partitionBy(label).orderBy("_order", *[c for c in rows.columns if c != label])
    before = F.sum("_size").over(by_label.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_held", before).withColumn("_rank", F.row_number().over(by_label)).where((F.col("_held") <= share) | (F.col("_rank") == 1)).select(*rows.columns)
