"""Exact matching of digests against a multi-build signature corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.functions.scalar import describe_build


def current_signatures(functions: DataFrame, builds: DataFrame, chip: str, canon_version: int, digests: DataFrame | None = None) -> DataFrame:
    """(digest, name, component, origin, build_id) of the chip's builds under the current rules.

    Five columns are read. ``digests`` restricts the scan to keys in use, as a semi-join; the adaptive planner broadcasts what is
    small. Builds are filtered first: where the tables are partitioned by chip and version, whole folders are skipped.
    """
    current = builds.where((F.col("chip") == chip) & (F.col("canon_version") == canon_version)).select("build_id")
    rows = functions.select("digest", "name", "component", "origin", "build_id").join(current, "build_id", "left_semi")
    if digests is not None:
        rows = rows.join(digests.select("digest").distinct(), "digest", "left_semi")
    return rows


def preferred(signatures: DataFrame) -> DataFrame:
    """One row a digest: the preferred signature, its rivals, components it shares, and the builds that have its name.

    A linked copy is preferred to an archive's, then the smallest name; ties go to the smallest build, then component, null
    first. A component is shared if one build files the preferred name under several; renames between builds don't
    count. Null and empty components are ignored there.
    """
    # signatures are read once: by name and build, by name, by digest, each level combining before it shuffles
    by_build = signatures.groupBy("digest", "name", "build_id").agg(
        F.min(F.struct((F.col("origin") != "linked").alias("o"), F.col("component").alias("c"), F.col("origin").alias("origin"))).alias("m"),
        F.collect_set(F.when(F.col("component") != "", F.col("component"))).alias("cs"),
    )
    by_name = by_build.groupBy("digest", "name").agg(
        F.min(F.struct("m.o", F.col("build_id").alias("b"), "m.c", "m.origin")).alias("m"),
        F.array_sort(F.collect_set("build_id")).alias("source_ids"),
        F.flatten(F.collect_list(F.when(F.size("cs") > 1, F.col("cs")))).alias("shared"),
    )
    order = F.struct("m.o", F.col("name").alias("n"), "m.b", "m.c")
    best = F.struct("name", F.col("m.c").alias("component"), "m.origin", "source_ids", "shared")
    df = by_name.groupBy("digest").agg(F.min_by(best, order).alias("best"), F.collect_set("name").alias("names"))
    shared = F.array_sort(F.array_distinct(F.filter("best.shared", lambda c: ~c.eqNullSafe(F.col("best.component")))))
    ambiguous = F.array_remove(F.array_sort("names"), F.col("best.name"))
    return df.select(
        "digest",
        F.col("best.name").alias("name"),
        F.col("best.component").alias("component"),
        F.col("best.origin").alias("origin"),
        F.when(F.size(ambiguous) == 0, 1.0).otherwise(0.5).alias("confidence"),
        ambiguous.alias("ambiguous_with"),
        shared.alias("shared_components"),
        F.col("best.source_ids").alias("source_ids"),
    )


def identify(targets: DataFrame, hits: DataFrame) -> DataFrame:
    """All targets with what is known of their digest; ``identified`` is false where nothing is."""
    return targets.join(hits.withColumn("identified", F.lit(True)), "digest", "left").withColumn("identified", F.coalesce("identified", F.lit(False)))


def signature_lists(signatures: DataFrame) -> DataFrame:
    """(digest, signatures): every distinct signature of a digest, by name, linked first, then build; of one build the first component."""
    rows = signatures.groupBy("digest", "name", "origin", "build_id").agg(F.min("component").alias("component"))
    item = F.struct("name", (F.col("origin") != "linked").alias("o"), F.coalesce("build_id", F.lit(-1)).alias("build_id"), "origin", "component")
    return rows.groupBy("digest").agg(F.array_sort(F.collect_list(item)).alias("signatures")).withColumn("signatures", F.transform("signatures", lambda s: s.dropFields("o")))


def with_builds(lists: DataFrame, builds: DataFrame) -> DataFrame:
    """The signatures of lists with version, configuration and a label of their build; those of unknown builds are left out."""
    about = builds.select("build_id", "idf_version", "config_name", describe_build(F.col("idf_version"), F.col("config_name"), F.col("config_hash")).alias("label"))
    rows = lists.select("digest", F.posexplode("signatures").alias("at", "s")).select("digest", "at", "s.*").join(about, "build_id")
    item = F.struct("at", "name", "origin", "build_id", "component", "idf_version", "config_name", "label")
    return rows.groupBy("digest").agg(F.array_sort(F.collect_list(item)).alias("signatures")).withColumn("signatures", F.transform("signatures", lambda s: s.dropFields("at")))


def first_and_more(rows: DataFrame, k: int, order: list) -> DataFrame:
    """The first k rows in an order, ranked, each with the number of rows beyond them. Only k rows are ever ranked in one place."""
    from pyspark.sql import Window

    top = rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top.select("rank", *rows.columns, F.greatest(rows.agg(F.count("*")).scalar() - k, F.lit(0)).alias("more"))


def top_with_other(counts: DataFrame, label: str, k: int, unit: str) -> DataFrame:
    """(rank, label, n, share): the k largest, ties by label, the rest as one row that says how many it holds, and each one's share of all.

    The k are taken first, so no task sees more than these; the rest is the difference of sums. Labels must be distinct.
    """
    from pyspark.sql import Window

    order = [F.desc("n"), F.asc(label)]
    top = counts.select(label, "n").orderBy(*order).limit(k)
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("labels"))
    total = whole.select("n").scalar()
    ranked = top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), label, "n")
    held, rest = F.coalesce(top.agg(F.sum("n")).scalar(), F.lit(0)), F.col("labels") - k
    other = F.concat(F.lit("other ("), rest.cast("string"), F.lit(f" {unit}(s))")).alias(label)
    beyond = whole.where(rest > 0).select(F.lit(k + 1).alias("rank"), other, (F.col("n") - held).alias("n"))
    return ranked.unionByName(beyond).withColumn("share", F.col("n") / total)


def duplicate_digests(functions: DataFrame) -> DataFrame:
    """Digests under more than one name."""
    return functions.groupBy("digest").agg(F.countDistinct("name").alias("names")).where("names > 1")


def carry_components(linked: DataFrame, archived: DataFrame) -> DataFrame:
    """Linked functions with the component of the last archive, by (path, member, ord), that defines their name."""
    last = archived.groupBy("name").agg(F.max_by("component", F.struct("path", "member", "ord")).alias("component"))
    return linked.drop("component").join(last, "name", "left")
