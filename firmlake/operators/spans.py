"""Addresses: ceilings, owners, ranges, regions and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ceilings(starts: DataFrame) -> DataFrame:
    """(image, start, span_end) -> ceiling: the next start, or the span's end."""
    following = F.lead("start").over(Window.partitionBy("image").orderBy("start"))
    return starts.withColumn("ceiling", F.least(following, F.col("span_end")))


def owners(instructions: DataFrame, starts: DataFrame) -> DataFrame:
    """(image, addr) and (image, start) -> (image, addr, owner): the last start at or before, by one window over both."""
    both = instructions.select("image", "addr", F.lit(1).alias("kind")).union(starts.select("image", F.col("start").alias("addr"), F.lit(0).alias("kind")))
    earlier = Window.partitionBy("image").orderBy("addr", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("kind") == 0, F.col("addr")), ignorenulls=True).over(earlier)
    return both.withColumn("owner", owner).where("kind = 1").select("image", "addr", "owner")


def contiguous_ranges(pieces: DataFrame) -> DataFrame:
    """(key, start, end) -> maximal ranges, a new one wherever a piece doesn't begin at the end of the one before."""
    order = Window.partitionBy("key").orderBy("start")
    df = pieces.withColumn("new", F.coalesce(F.lag("end").over(order) != F.col("start"), F.lit(True)).cast("int"))
    df = df.withColumn("range", F.sum("new").over(order))
    return df.groupBy("key", "range").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("range")


def longest_run(rows: DataFrame, condition) -> DataFrame:
    """(key, addr, size) -> (key, longest): bytes of the longest run of rows that meet the condition; zero if none does."""
    order = Window.partitionBy("key").orderBy("addr")
    df = rows.withColumn("hit", F.coalesce(condition, F.lit(False)))
    df = df.withColumn("island", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(order))
    runs = df.groupBy("key", "island").agg(F.sum(F.when(F.col("hit"), F.col("size")).otherwise(0)).alias("bytes"))
    return runs.groupBy("key").agg(F.max("bytes").alias("longest"))


def region_array(regions: list[tuple[str, int, int]]):
    """Regions (name, low, high) as one array column; they are few, and their order breaks ties."""
    return F.array(*[F.struct(F.lit(high - low).cast("long").alias("span"), F.lit(k).alias("ord"), F.lit(name).alias("name"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high")) for k, (name, low, high) in enumerate(regions)])


def smallest_region(addr, regions: list[tuple[str, int, int]]):
    """Name of the smallest region that holds the address, of equals the first; null if none does."""
    holding = F.filter(region_array(regions), lambda r: (r["low"] <= addr) & (addr < r["high"]))
    return F.array_min(holding)["name"]


def map_candidates(addresses: DataFrame, maps: dict[str, list[tuple[str, int, int]]]) -> DataFrame:
    """(key, addr) -> (key, map, hits, seen): of the non-zero addresses, how many each address map names."""
    tests = [F.count_if(smallest_region(F.col("addr"), regions).isNotNull()).alias(name) for name, regions in maps.items()]
    counted = addresses.where("addr <> 0").groupBy("key").agg(F.count("*").alias("seen"), *tests)
    return counted.unpivot(["key", "seen"], list(maps), "map", "hits").where("hits > 0").select("key", "map", "hits", "seen")


def merge_candidates(declared: DataFrame, covered: DataFrame) -> DataFrame:
    """(key, map, score, evidence) of two sources -> one row a map: scores added, evidence in order of source."""
    both = declared.withColumn("src", F.lit(0)).unionByName(covered.withColumn("src", F.lit(1)))
    merged = both.groupBy("key", "map").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list(F.struct("src", "evidence"))).alias("e"), F.min("src").alias("src"))
    return merged.select("key", "map", "score", F.transform("e", lambda x: x["evidence"]).alias("evidence"), "src")
