"""Memory layout: runs of functions of one component, in address order, image by image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_ANCHOR = 24  # bytes below which a function doesn't anchor a run
UNCLAIMED = 2048  # bytes from which an unclaimed region is reported
BUCKETS = 64


def anchors(members: DataFrame, least: int = MIN_ANCHOR) -> DataFrame:
    """Adds ``anchor``: the component of an identified member that is unambiguous, of one component, and not tiny."""
    fit = F.col("identified") & (F.size("ambiguous_with") == 0) & (F.size("shared_components") == 0) & (F.col("size") >= least)
    name = F.coalesce(F.when(F.col("component") != "", F.col("component")), F.lit("(unattributed)"))
    return members.withColumn("anchor", F.when(fit, name))


def labelled(members: DataFrame) -> DataFrame:
    """(image, vaddr, size, identified, anchor) -> the same with region number and component.

    Equal neighbours, null beside null too, form a run; an unlabelled run between two of one component joins them. Region
    numbers count from 1 in an image.
    """
    by_addr = Window.partitionBy("image").orderBy("vaddr")
    df = members.withColumn("before", F.lag("anchor").over(by_addr)).withColumn("position", F.row_number().over(by_addr))
    new = (F.col("position") == 1) | ~F.col("anchor").eqNullSafe(F.col("before"))
    df = df.withColumn("run", F.sum(new.cast("int")).over(by_addr))
    runs = df.where(new).select("image", "run", F.col("anchor").alias("own"))
    by_run = Window.partitionBy("image").orderBy("run")
    runs = runs.withColumns({"p": F.lag("own").over(by_run), "n": F.lead("own").over(by_run)})
    runs = runs.withColumn("label", F.coalesce("own", F.when(F.col("p") == F.col("n"), F.col("p"))))
    runs = runs.withColumns({"was": F.lag("label").over(by_run), "at": F.row_number().over(by_run)})
    fresh = (F.col("at") == 1) | ~F.col("label").eqNullSafe(F.col("was"))
    runs = runs.withColumn("region", F.sum(fresh.cast("int")).over(by_run)).select("image", "run", "region", F.col("label").alias("region_component"), (F.col("own").isNull() & F.col("label").isNotNull()).alias("absorbed"))
    return df.join(runs, ["image", "run"]).drop("before", "position", "run")


def regions(members: DataFrame) -> DataFrame:
    """One row a region; its end is the last member's. ``inferred`` counts every member of an absorbed run."""
    last = F.max_by(F.col("vaddr") + F.col("size"), "vaddr")
    return labelled(members).groupBy("image", "region").agg(
        F.first("region_component").alias("component"),
        F.min("vaddr").alias("start"),
        last.alias("end"),
        F.count("*").alias("functions"),
        F.count_if("identified").alias("identified"),
        F.count_if("absorbed").alias("inferred"),
    )


def likely_components(members: DataFrame) -> DataFrame:
    """(image, vaddr, likely_component): unidentified members of labelled regions."""
    return labelled(members).where("NOT identified AND region_component IS NOT NULL").select("image", "vaddr", F.col("region_component").alias("likely_component"))


def unclaimed(layout: DataFrame, least: int = UNCLAIMED) -> DataFrame:
    """Large regions without a component, with the nearest labelled neighbour on either side."""
    by_region = Window.partitionBy("image").orderBy("region")
    before = F.last("component", ignorenulls=True).over(by_region.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("component", ignorenulls=True).over(by_region.rowsBetween(1, Window.unboundedFollowing))
    df = layout.withColumns({"before": before, "after": after, "bytes": F.col("end") - F.col("start")})
    return df.where((F.col("component").isNull()) & (F.col("bytes") >= least)).select("image", "start", "end", "bytes", "functions", "before", "after")


def bar(layout: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(image, bucket, symbol): what covers most of each of equal buckets of the image's span.

    A region with a component splits its bytes by its share of identified functions. Ties go to identified, then inferred. Sizes
    are compared in units of bytes times functions, in whole numbers where buckets are; only buckets that a region covers are made.
    """
    span = layout.groupBy("image").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    df = layout.join(span, "image").withColumn("step", F.greatest(F.ceil((F.col("high") - F.col("low")) / buckets), F.lit(1)))
    first = F.floor((F.col("start") - F.col("low")) / F.col("step"))
    final = F.floor((F.greatest(F.col("end") - 1, F.col("start")) - F.col("low")) / F.col("step"))
    df = df.withColumn("bucket", F.explode(F.sequence(first, final)))
    low = F.col("low") + F.col("bucket") * F.col("step")
    overlap = F.greatest(F.lit(0), F.least(F.col("end"), low + F.col("step")) - F.greatest(F.col("start"), low)).cast("double")
    share = F.when(F.col("component").isNotNull(), F.col("identified") / F.col("functions"))
    sums = df.groupBy("image", "bucket").agg(
        F.sum(F.coalesce(overlap * share, F.lit(0.0))).alias("known"),
        F.sum(F.coalesce(overlap * (1 - share), F.lit(0.0))).alias("inferred"),
        F.sum(F.when(F.col("component").isNull(), overlap).otherwise(0.0)).alias("none"),
    )
    most = F.greatest("known", "inferred", "none")
    symbol = F.when(most <= 0, " ").when(F.col("known") == most, "#").when(F.col("inferred") == most, "+").otherwise(".")
    return sums.select("image", "bucket", symbol.alias("symbol"))


def coverage(members: DataFrame) -> DataFrame:
    """(image, matched, total); the quotient is left to the reader, as roundings differ between engines."""
    return members.groupBy("image").agg(F.count_if("identified").alias("matched"), F.count("*").alias("total"))


def by_component(members: DataFrame) -> DataFrame:
    """(image, component, n, first): identified members by component, with the first one's address for a stable order."""
    name = F.coalesce(F.when(F.col("component") != "", F.col("component")), F.lit("(unattributed)"))
    return members.where("identified").groupBy("image", name.alias("component")).agg(F.count("*").alias("n"), F.min("vaddr").alias("first"))
