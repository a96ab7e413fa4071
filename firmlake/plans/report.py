"""The text of a symbols run: lines by image, made by expressions, so that a report of many images is a table like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlake.functions.scalar import grouped_digits, hex_address, percent
from firmlake.operators import layout

LISTED, UNCLAIMED, COMPONENTS, VERSIONS, BUILDS = 20, 12, 12, 10, 12


def padded(value: Column, width: int) -> Column:
    return F.format_string(f"%{width}s", value)


def ranked(counts: DataFrame, whole: DataFrame, k: int, unit: str) -> DataFrame:
    """(image, label, n) and (image, matched) -> (image, at, line): the k largest, the rest as one, each with its share."""
    order = Window.partitionBy("image").orderBy(F.desc("n"), "label")
    df = counts.withColumn("at", F.least(F.row_number().over(order), F.lit(k + 1)))
    df = df.groupBy("image", "at").agg(F.min("label").alias("label"), F.sum("n").alias("n"), F.count("*").alias("held"))
    label = F.when(F.col("at") > k, F.concat(F.lit("other ("), F.col("held").cast("string"), F.lit(f" {unit}(s))"))).otherwise(F.col("label"))
    line = F.concat(F.lit("    "), label, F.lit("  "), grouped_digits(F.col("n")), F.lit("  "), percent(F.col("n"), F.col("matched")))
    return df.join(whole.select("image", "matched"), "image").select("image", "at", line.alias("line"))


def bars(regions: DataFrame) -> DataFrame:
    """(image, line): a symbol for each of the buckets, a blank where nothing is."""
    held = layout.bar(regions).groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "symbol"))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(layout.BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(" "))), "")
    return held.select("image", F.concat(F.lit("["), line, F.lit("]")).alias("line"))


def matched_line() -> Column:
    """The line of ``matched`` and ``total``, an image's functions."""
    whole = F.concat(grouped_digits(F.col("matched")), F.lit(" of "), grouped_digits(F.col("total")), F.lit(" functions ("), percent(F.col("matched"), F.col("total")), F.lit(")"))
    return F.concat(F.lit("matched: "), whole)


def lines(out: dict[str, DataFrame]) -> DataFrame:
    """(image, part, at, line) of the tables of ``symbols``, in order of the first three."""
    identified = out["identified"].withColumnRenamed("image_id", "image")
    unidentified = out["unidentified"].withColumnRenamed("image_id", "image")
    coverage, parts = out["coverage"], []

    def part(df: DataFrame, line: Column, at: Column | None = None, head: str | None = None) -> None:
        k = len(parts)
        parts.append(df.select("image", F.lit(k).alias("part"), (F.lit(0) if at is None else at).cast("long").alias("at"), line.alias("line")))
        if head:
            parts[-1] = parts[-1].unionByName(df.select("image").distinct().select("image", F.lit(k).alias("part"), F.lit(-1).cast("long").alias("at"), F.lit(head).alias("line")))

    part(coverage, matched_line())
    rivals = F.when(F.size("ambiguous_with") > 0, F.concat(F.lit(" (+"), F.size("ambiguous_with").cast("string"), F.lit(" ambiguous name(s))"))).otherwise("")
    where = F.coalesce(hex_address(F.col("file_offset")), F.lit("-"))
    sources = F.coalesce(F.nullif(F.array_join("sources", ", "), F.lit("")), F.lit("unknown"))
    part(identified, F.concat_ws("  ", hex_address(F.col("entry")), where, padded(F.col("size"), 5), F.concat("name", rivals), sources), F.col("entry"), "identified: address, offset, size, symbol, sources")
    clear = identified.groupBy("image").agg(F.count("*").alias("matched"), F.count_if(F.size("ambiguous_with") > 0).alias("ambiguous"))
    split = [F.concat(grouped_digits(n), F.lit(f" {word} ("), percent(n, F.col("matched")), F.lit(")")) for n, word in ((F.col("matched") - F.col("ambiguous"), "unambiguous"), (F.col("ambiguous"), "ambiguous"))]
    part(clear, F.concat(F.lit("ambiguity: "), split[0], F.lit(", "), split[1]))
    components = out["by_component"].select("image", F.col("component").alias("label"), "n")
    hits = identified.select("image", "entry", F.explode("source_ids").alias("build_id")).join(out["labels"], "build_id")
    versions = hits.groupBy("image", F.col("idf_version").alias("label")).agg(F.countDistinct("entry").alias("n"))
    builds = hits.groupBy("image", F.col("label")).agg(F.count("*").alias("n"))
    for counts, k, unit, head in ((components, COMPONENTS, "component", "by component:"), (versions, VERSIONS, "version", "by version:"), (builds, BUILDS, "build", "by build:")):
        part(ranked(counts, clear, k, unit), F.col("line"), F.col("at"), head)
    part(bars(out["regions"]), F.col("line"), head="layout: # identified, + inferred, . unclaimed")
    open_ = layout.unclaimed(out["regions"]).withColumn("at", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("bytes"), "start"))).where(F.col("at") <= UNCLAIMED)
    near = F.concat(F.coalesce("before", F.lit("-")), F.lit(" | "), F.coalesce("after", F.lit("-")))
    part(open_, F.concat_ws("  ", hex_address(F.col("start")), hex_address(F.col("end")), padded(grouped_digits(F.col("bytes")), 7), padded(grouped_digits(F.col("functions")), 5), near), F.col("at"), "unclaimed: start, end, bytes, functions, neighbours")
    by_size = Window.partitionBy("image").orderBy(F.desc("size"), F.desc("in_degree"), "entry")
    all_of = Window.partitionBy("image")
    dark = unidentified.withColumns({"at": F.row_number().over(by_size), "n": F.count("*").over(all_of)}).where(F.col("at") <= LISTED + 1)
    known = F.coalesce("callees_known", F.array().cast("array<string>"))
    calls = F.concat(F.array_join(F.slice(known, 1, 4), ", "), F.when(F.size(known) > 4, F.concat(F.lit(", +"), (F.size(known) - 4).cast("string"))).otherwise(""))
    row = F.concat_ws("  ", hex_address(F.col("entry")), where, padded(grouped_digits(F.col("size")), 6), padded(F.col("in_degree"), 3), F.coalesce("likely_component", F.lit("-")), F.coalesce(F.nullif(calls, F.lit("")), F.lit("-")))
    part(dark, F.when(F.col("at") <= LISTED, row).otherwise(F.concat(F.lit("... "), grouped_digits(F.col("n") - LISTED), F.lit(" more"))), F.col("at"), "unidentified: address, offset, size, callers, likely component, known calls")
    part(out["warnings"].select("image", F.posexplode("warnings").alias("at", "text")), F.concat(F.lit("warning: "), F.col("text")), F.col("at"))
    return reduce(DataFrame.unionByName, parts).orderBy("image", "part", "at")
