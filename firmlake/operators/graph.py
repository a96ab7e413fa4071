"""Call-graph operators over (src, dst) edges. Multi-edges and self-edges are kept."""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_edges(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Edges whose destination is an entry."""
    return edges.join(entries.select(F.col("entry").alias("dst")), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, in_degree, out_degree), zero where there is no edge; edges to unknown entries don't count."""
    edges = known_edges(edges, entries)
    into = edges.groupBy(F.col("dst").alias("entry")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("entry")).agg(F.count("*").alias("out_degree"))
    return entries.select("entry").join(into, "entry", "left").join(out, "entry", "left").na.fill(0, ["in_degree", "out_degree"])


def known_callees(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(src, callees): distinct names of identified destinations, sorted. ``names``: (entry, name)."""
    named = edges.join(names.withColumnRenamed("entry", "dst"), "dst")
    return named.groupBy("src").agg(F.array_sort(F.collect_set("name")).alias("callees"))


def reachable(edges: DataFrame, seeds: DataFrame, levels: int | None = None) -> DataFrame:
    """(node, level): nodes that a seed leads to, within so many edges if given, at their least level.

    A step joins only what the step before found for the first time. Steps run until one finds nothing, and each is checkpointed, so the plan
    doesn't grow with them.
    """
    edges = settled(edges.select("src", "dst").distinct())
    found = last = settled(seeds.select(F.col("entry").alias("node"), F.lit(0).alias("level")).distinct())
    level = 0
    while levels is None or level < levels:
        level += 1
        reached = last.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        last = settled(reached.join(found.select("node"), "node", "left_anti").select("node", F.lit(level).alias("level")))
        if last.isEmpty():
            break
        found = found.union(last)
    return found


def noreturn(blocks: DataFrame, edges: DataFrame, passes: int = 6) -> DataFrame:
    """(fn, block, callee, returns) and (fn, src, dst) block edges -> (entry, noreturn), block 0 being the entry.

    A function never returns if flow from its entry reaches no block that returns, a block that ends in a call of a function that never
    returns leading nowhere. Found pass by pass, as the first pass knows only functions that hang by themselves, until nothing changes. A
    function's blocks are one row, so a pass is one join.
    """
    of = lambda df, *columns: df.groupBy("fn").agg(F.collect_list(F.struct(*columns)).alias(columns[0] + "s"))
    rows = settled(of(blocks, "block", "callee", "returns").join(of(edges, "src", "dst"), "fn", "left"))
    calls = settled(blocks.where("callee IS NOT NULL").select("fn", "callee").distinct())
    kind = rows.schema["fn"].dataType.simpleString()

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for held, hops, gone in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                ends = {b["block"] for b in held if b["callee"] is not None and b["callee"] in set(gone or ())}
                onward = defaultdict(list)
                for e in hops or ():
                    if e["src"] not in ends:
                        onward[e["src"]].append(e["dst"])
                seen, todo = {0}, [0]
                while todo:
                    fresh = set(onward[todo.pop()]) - seen
                    seen |= fresh
                    todo += fresh
                out.append(not any(b["returns"] for b in held if b["block"] in seen))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_())], ["entry", "noreturn"])

    known, found, silent = -1, None, calls.select("callee").where("false")
    for _ in range(passes):
        gone = calls.join(silent, "callee", "left_semi").groupBy("fn").agg(F.collect_list("callee").alias("gone"))
        found = settled(rows.join(gone, "fn", "left").select("fn", "blocks", "srcs", "gone").mapInArrow(flow, f"entry {kind}, noreturn boolean"))
        silent = found.where("noreturn").select(F.col("entry").alias("callee"))
        now = silent.count()
        if now == known:
            break
        known = now
    return found


def settled(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the cluster's shared folder: later steps read them instead of their history."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="firmlake-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
