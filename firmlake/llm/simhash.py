"""SimHash near-duplicates: fingerprints of word shingles, joined exactly within a Hamming radius by vantage-point trees.

Every branch of the tree has a vantage point of its own, one of the sample's fingerprints there, and parts at the median of their
distances to it. Distances at a level count the bits of that level's slice of the fingerprint alone, so that the levels' bounds
add up: by the triangle inequality a fingerprint on one side of a median is at least so many bits from any on the other,
and a branch is pruned once what the way to it needs exceeds the radius. A leaf is a shard: each fingerprint lives in one
and is queried in shards whose boundary its ball overlaps, of two shards one in the other. In a shard pairs are compared exactly.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm import shingles as overlap
from firmlake.llm.common import bounded_join, map_rows, written
from firmlake.llm.components import components, local_roots

SEED = 42
WIDTH = 3  # words in a shingle
RADIUS = 2  # differing bits of a link
SHARD = 1 << 14  # fingerprints that live in a shard, about
DEEPEST = 16  # levels of the tree; beyond 2 ** 30 fingerprints shards grow, and are compared a tile at a time like any other
SAMPLE = 16  # fingerprints a leaf of the sample that the tree grows from, 1024 at least: 8 MB at most, on the driver
TRIED = 16  # of them, as vantage points of a branch
TILE = 2048  # rows of a block of comparisons


def shingles(text: str | None, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles in parts, repeats included. Empty, blank and null texts: none. Fewer words: the whole sequence is the one shingle."""
    import xxhash

    words = text.encode(errors="replace").lower().split() if text else []
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(joined, SEED)], np.uint64)
        return
    ends = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    n = len(words) - width + 1
    spans = zip(ends, itertools.islice(ends, width, None))
    for at in range(0, n, 1 << 14):
        size = min(1 << 14, n - at)
        yield np.fromiter((digest(joined[a : b - 1], SEED) for a, b in itertools.islice(spans, size)), np.uint64, size)


def vote(parts: Iterable[np.ndarray]) -> int:
    """64 bits, unsigned, each the majority's of all hashes; without any, zero."""
    count, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits, unsigned. Empty, blank and null texts: 0. Fewer words than a shingle: the whole sequence is the one shingle."""
    return vote(shingles(text, width))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def slices(levels: int) -> list[tuple[int, int]]:
    """(shift, bits) of each level's slice."""
    cuts = [64 * i // levels for i in range(levels + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def part(points: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return (points >> np.uint64(shift)) & np.uint64((1 << bits) - 1)


def grown(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(vantage point's slice, median distance) of each branch, in heap order.

    Of the points tried in a branch the one counts whose distances part it most evenly; without any, all go one way.
    """
    point, cut = np.zeros((1 << levels) - 1, np.uint64), np.full((1 << levels) - 1, 64, np.int64)
    held = {0: sample}
    for level, (shift, bits) in enumerate(slices(levels) if levels else []):
        for node in range((1 << level) - 1, (2 << level) - 1):
            here = held.pop(node)
            x = part(here, shift, bits)
            best = len(x) + 1
            for v in np.unique(x[:TRIED]):
                d = np.bitwise_count(x ^ v)
                middle = int(np.median(d))
                for m in (middle - 1, middle):
                    uneven = abs(int((d <= m).sum()) * 2 - len(x))
                    if uneven < best:
                        best, point[node], cut[node] = uneven, v, m
            inside = np.bitwise_count(x ^ point[node]) <= cut[node]
            held[2 * node + 1], held[2 * node + 2] = here[inside], here[~inside]
    return point, cut


def leaves(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): each point's own leaf, and all leaves that may hold a point within the radius."""
    point, cut = tree
    row, node, home, left = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool), np.full(len(points), radius)
    levels = (len(cut) + 1).bit_length() - 1
    for shift, bits in slices(levels) if levels else []:
        d = np.bitwise_count(part(points[row], shift, bits) ^ point[node]).astype(np.int64)
        inside = d <= cut[node]
        rest = left - np.where(inside, cut[node] + 1 - d, d - cut[node])
        far = np.nonzero(rest >= 0)[0]
        node = np.concatenate([2 * node + 2 - inside, (2 * node + 1 + inside)[far]])
        row, home, left = np.concatenate([row, row[far]]), np.concatenate([home, np.zeros(len(far), bool)]), np.concatenate([left, rest[far]])
    return row, node - len(cut), home


def shard_rows(points: DataFrame, tree: tuple[np.ndarray, np.ndarray], radius: int) -> DataFrame:
    """(fp) -> (shard, query, fp): the fingerprint in its own leaf, and as a query in leaves that its ball overlaps, of each two leaves in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 1 << 14):
                fps = every[at : at + (1 << 14)]
                row, leaf, home = leaves(fps.view(np.uint64), tree, radius)
                own = np.zeros(len(fps), np.int64)
                own[row[home]] = leaf[home]
                pick = home | (((own[row] + leaf) % 2 == 1) == (own[row] < leaf))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[pick]), pa.array(~home[pick]), pa.array(fps[row[pick]])], ["shard", "query", "fp"])

    return points.mapInArrow(run, "shard long, query boolean, fp long")


def shard_links(rows: DataFrame, radius: int) -> DataFrame:
    """Rows grouped by shard, its own points before queries -> edges (a, b) that connect all that is linked there."""

    def link(own: np.ndarray, others: np.ndarray, same: bool):
        """Star edges of the components of own and others; pairs are folded a tile at a time."""
        nodes = own if same else np.concatenate([own, others])
        root = np.arange(len(nodes))
        for i in range(0, len(own), TILE):
            for j in range(i if same else 0, len(others), TILE):
                a, b = np.nonzero(np.bitwise_count(own[i : i + TILE, None] ^ others[None, j : j + TILE]) <= radius)
                ends = np.stack([root[a + i], root[b + j + (0 if same else len(own))]])
                ends = np.unique(ends[:, ends[0] != ends[1]], axis=1)
                if ends.shape[1]:
                    heads, at = np.unique(ends, return_inverse=True)
                    at = at.reshape(2, -1)
                    up = np.arange(len(nodes))
                    up[heads] = heads[local_roots(len(heads), at[0], at[1])]
                    root = up[root]
        moved = np.nonzero(root != np.arange(len(nodes)))[0]
        return nodes[moved].view(np.int64), nodes[root[moved]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, own = None, [], None

        def flush():
            nonlocal own, parts
            points = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            parts = []
            if own is None:
                own = points
                return link(own, own, True)
            return link(own, points, False)

        for batch in batches:
            shards, queries, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.nonzero((shards[1:] != shards[:-1]) | (queries[1:] != queries[:-1]))[0] + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(shards)]):
                if shards[a] != shard or (queries[a] and own is None):
                    if shard is not None and (own is None or parts):
                        made = flush()
                        if len(made[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["a", "b"])
                    if shards[a] != shard:
                        shard, own, parts = shards[a], None, []
                        if queries[a]:  # queries only: nothing lives here
                            own = np.zeros(0, np.uint64)
                parts.append(fps[a:b].view(np.uint64))
                if own is not None and sum(map(len, parts)) >= 1 << 16:
                    made = flush()
                    if len(made[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["a", "b"])
        if shard is not None and (own is None or parts):
            made = flush()
            if len(made[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["a", "b"])

    return rows.repartition(F.col("shard")).sortWithinPartitions("shard", "query").mapInArrow(run, "a long, b long")


def depth(n: int) -> int:
    """Levels for n points: deeper trees make smaller shards and more queries. The links found are the same."""
    return min(DEEPEST, max(0, -(-n // SHARD) - 1).bit_length())


def point_links(points: DataFrame, radius: int = RADIUS, levels: int | None = None) -> DataFrame:
    """Distinct (fp long) -> edges (a, b) that connect all points linked to another."""
    levels = depth(points.count()) if levels is None else levels
    sample = np.zeros(0, np.uint64)
    if levels:
        sample = points.orderBy(F.xxhash64("fp")).limit(max(1024, SAMPLE << levels)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    return shard_links(shard_rows(points, grown(sample, levels), radius), radius)


def linked_points(points: DataFrame, radius: int = RADIUS, levels: int | None = None) -> DataFrame:
    """Distinct (fp long) -> (node, root) for those linked to another."""
    return components(point_links(points, radius, levels))


def groups(prints: DataFrame, radius: int = RADIUS, levels: int | None = None, further: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, fp), a written table -> (fp, root, component_id, members), for each fingerprint that more than one row has or that is linked.

    component_id is the smallest doc_id reachable; null if all are null. ``further`` makes more edges of the written ones.
    """
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    if further is None:
        roots = linked_points(points.select("fp"), radius, levels)
    else:
        roots = components(further(written(point_links(points.select("fp"), radius, levels), "links")))
    roots = roots.withColumnRenamed("node", "fp")
    points = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    points = written(points, "rooted")
    heads = written(points.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members")).where("members > 1"), "heads")
    return written(points.join(heads, "root").select("fp", "root", "component_id", "members"), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row a document: (doc_id, fingerprint in hex, component_id).

    Null, empty and blank texts have the fingerprint zero and are linked like any other. Repeated rows and ids
    give repeated rows. A null id never is a component's id unless all its ids are null.
    """

    def make():
        return lambda row: (row[0], signed(fingerprint(row[1], width)))

    kind = docs.schema[id_col].dataType.simpleString()
    prints = written(map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, fp long"), "fingerprints")
    found = groups(prints, radius).select("fp", "component_id")
    df = bounded_join(prints, found.withColumn("found", F.lit(True)), "fp", "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, percent: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id.

    Texts are linked if their fingerprints are within the radius and, with ``percent``, if the Jaccard similarity of
    their sets of shingles is so much or more, which two fingerprints of 64 bits can't tell (see ``shingles``). Null, empty and blank texts are copies of one another.
    If rows repeat that id, the one with the smallest hash of all columns stays. A group without any id keeps
    one row as well. Columns and other rows are untouched; an empty table stays empty.
    """

    @F.pandas_udf("long")
    def prints_of(texts):
        return texts.map(lambda t: signed(fingerprint(t, width))).astype("int64")

    def hashes(text: str | None) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *shingles(text, width)])

    row = docs.select(F.struct(*docs.columns).alias("_row"))
    own_id = F.col("_row")[id_col]
    marked = row.withColumns({"_fp": prints_of(F.col("_row")[text_col]), "_whole": F.xxhash64("_row")})
    if percent is None:
        prints = written(marked.select(own_id.alias("doc_id"), F.col("_fp").alias("fp"), F.col("_whole").alias("whole")), "fingerprints")
        found = groups(prints.select("doc_id", "fp"), radius)
    else:
        texts = row.select(own_id.alias("doc_id"), F.xxhash64("_row").alias("whole"), F.col("_row")[text_col].alias("text"))
        prints = written(overlap.signatures(texts, hashes, lambda every: vote(every[i : i + TILE] for i in range(0, len(every), TILE))), "fingerprints")
        found = groups(prints.select("doc_id", "fp"), radius, further=lambda near: overlap.links(prints, near, texts.select("whole", "text"), hashes, percent))
        prints = prints.select("doc_id", "fp", "whole")
    # the row that stays: smallest id, then smallest hash; rows equal beyond that are dropped below
    heads = bounded_join(prints, found, "fp", "inner").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = written(heads.groupBy("root").agg(F.min(F.struct("whole", "fp")).alias("m"), F.count("*").alias("n")), "kept")
    twins = heads.where("n > 1").limit(1).count() > 0
    keep = bounded_join(found, heads.select("root", F.col("m.whole").alias("_keep"), F.col("m.fp").alias("_keep_fp")), "root", "inner")
    keep = written(keep.select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), F.col("component_id").alias("_component"), "_keep", "_keep_fp"), "keep")
    df = bounded_join(marked, keep, "_fp", "left")
    stays = F.col("_root").isNull() | (own_id.eqNullSafe(F.col("_component")) & (F.col("_whole") == F.col("_keep")) & (F.col("_fp") == F.col("_keep_fp")))
    df = df.where(stays)
    if twins:  # only rows equal in every column can be left over
        alone = df.where("_root IS NULL")
        df = alone.unionByName(df.where("_root IS NOT NULL").dropDuplicates(["_root"]))
    return df.select("_row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component, at three words and two bits. Null, empty and blank texts have fingerprint zero and are
    linked like any other; repeated rows give repeated rows; an empty table gives none."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
