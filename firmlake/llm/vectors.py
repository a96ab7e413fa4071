"""Embedding near-dedup: an exact cosine join by pigeonhole over subspaces of rotated vectors.

Unit vectors with cosine >= c are at most t = 2 - 2c apart in squared distance. A random rotation spreads that
distance evenly; cut into blocks of dimensions, at least one block holds no more than its proportional share of
t. Each block is range-joined under its share: a k-d tree over all its coordinates, grown from a sample, deals the
vectors to shards of like size, each vector living in one leaf and queried in the leaves that its range touches. In a shard, rows
are put in the order of a further k-d tree, and runs of them are compared only if their boxes are within the share. The
union of the candidates is verified with the whole vectors, in double precision, where they meet; a pair that several
blocks find counts in the first.

Bounds: a task holds one shard's own rows, SHARD components or about, and a stretch of queries; pairs are folded to counts and
roots as they are found. The trees that are sent to all tasks have at most 2 ** DEEPEST leaves a block; shards of larger tables
are cut into tiles instead.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.llm.common import bounded_join, written
from firmlake.llm.components import components, local_roots

COSINE = 0.95
BLOCK = 16  # dimensions of a block
SHARD = 1 << 22  # vector components that live in a shard, about: 65,536 vectors of 64 dimensions
DEEPEST = 12  # levels of the tree that deals shards
SPREAD = 64  # shards below which each is cut into TILES, so that small tables use a cluster too
TILES = 5  # odd, so that every two tiles of a shard meet in one of them, and all have the same to do
SAMPLE = 1 << 22  # components of the sample that trees grow from: 32 MB at most, on the driver
RUN = 1024  # rows compared at a time
STRETCH = 1 << 13  # queries read at a time
SLACK = 1e-6  # added to squared distances that only select candidates
ROUGH = 1e-5  # more of it where single precision screens
CLOSE = 1e-9  # distances this close to a bound are computed again, in an order that doesn't depend on what else is at hand
SEED = 7


@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same wherever it is made; kept by the process."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int) -> list[tuple[int, int]]:
    n = max(1, round(dim / BLOCK))
    return list(itertools.pairwise([dim * i // n for i in range(n + 1)]))


def share(cosine: float, dim: int, block: int) -> float:
    """The squared distance that some block of a linked pair doesn't exceed."""
    a, b = blocks(dim)[block]
    return (2 - 2 * cosine) * (b - a) / dim + SLACK


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows to length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def decoded(column, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dim)


# trees that deal shards


def grown(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, value) of each inner node in heap order: the widest coordinate of what is there, cut at its median."""
    axis, cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    held = {0: np.arange(len(points))}
    for node in range(len(axis)):
        rows = held.pop(node)
        if len(rows):
            x = points[rows]
            axis[node] = int(x.std(0).argmax())
            cut[node] = float(np.median(x[:, axis[node]]))
        right = points[rows, axis[node]] >= cut[node]
        held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
    return axis, cut


def leaves(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray], limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): each row's own leaf, and all leaves whose box is within ``limit`` of it in squared distance."""
    axis, cut = tree
    row, node, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
    away = np.zeros((len(x), x.shape[1]))  # squared distance to the node's box, by coordinate
    for _ in range((len(axis) + 1).bit_length() - 1):
        j = axis[node]
        past = x[row, j] - cut[node]
        right = past >= 0
        far = away.copy()
        far[np.arange(len(row)), j] = past * past
        touched = np.nonzero(far.sum(1) <= limit)[0]
        node = np.concatenate([2 * node + 1 + right, (2 * node + 2 - right)[touched]])
        row, home, away = np.concatenate([row, row[touched]]), np.concatenate([home, np.zeros(len(touched), bool)]), np.concatenate([away, far[touched]])
    return row, node - len(axis), home


def plan(vectors: DataFrame, kind: str, shard: int, deepest: int, tiles: int | None) -> dict[int, tuple[int, list]]:
    """{dimensions: (tiles, a tree a block)}, by the number of vectors of each length."""
    size = np.dtype(kind).itemsize
    out = {}
    for r in vectors.groupBy((F.octet_length("vector") / size).cast("int").alias("dim")).count().collect():
        dim, cuts = r["dim"], blocks(r["dim"])
        rows = max(shard // dim, 1)
        depth = min(deepest, max(0, (-(-r["count"] // rows) - 1).bit_length()))
        few = TILES if len(cuts) << depth < SPREAD else 1
        each = tiles or max(few, -(-r["count"] // (rows << depth)) | 1)
        trees = [(np.zeros(0, np.int64), np.zeros(0))] * len(cuts)
        if depth:
            most = max(min(SAMPLE // dim, 16 << depth), 1 << depth)
            sample = vectors.where(F.octet_length("vector") == dim * size).orderBy(F.xxhash64("node")).limit(most).select("vector").toPandas()["vector"]
            turned = unit(decoded(sample, dim, kind)) @ rotation(dim)
            trees = [grown(turned[:, a:b], depth) for a, b in cuts]
        out[dim] = each, trees
    return out


KEY = ["dim", "block", "leaf", "tile"]


def shard_rows(vectors: DataFrame, kind: str, plans: dict, cosine: float) -> DataFrame:
    """(node, copies, vector binary) -> the same by (dim, block, leaf, tile): in its own tile of its own leaf, and, as a query, wherever it may meet others.

    Of two leaves one is asked by the other's rows, of two tiles of a leaf likewise, so a pair meets once in a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "query", "node", "copies", "vector"]
        for batch in (b.slice(at, STRETCH) for b in batches for at in range(0, b.num_rows, STRETCH)):
            node, copies, raw = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            dims = np.array([len(v) for v in raw]) // np.dtype(kind).itemsize
            for dim in np.unique(dims).tolist():
                here = np.nonzero(dims == dim)[0]
                tiles, trees = plans[dim]
                turned = unit(decoded(raw[here], dim, kind)) @ rotation(dim)
                group = ((node[here].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % tiles
                for k, (a, b) in enumerate(blocks(dim)):
                    row, leaf, home = leaves(turned[:, a:b], trees[k], share(cosine, dim, k) + SLACK)
                    own = np.zeros(len(here), np.int64)
                    own[row[home]] = leaf[home]
                    asks = (((own[row] + leaf) % 2 == 1) == (own[row] < leaf)) & ~home
                    for tile in range(tiles):
                        before = (group[row] - tile) % tiles
                        lives = home & (before == 0)
                        pick = np.nonzero(lives | asks | (home & (before > 0) & (before <= tiles // 2)))[0]
                        at, n = here[row[pick]], len(pick)
                        whole = lambda x: pa.array(np.full(n, x, np.int64))  # noqa: B023, E731
                        columns = [whole(dim), whole(k), pa.array(leaf[pick]), whole(tile), pa.array(~lives[pick]), pa.array(node[at]), pa.array(copies[at]), pa.array(raw[at], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.mapInArrow(run, "dim long, block long, leaf long, tile long, query boolean, node long, copies long, vector binary")


# pairs within a shard


class Side:
    """Rows to compare in one block, in the order of a k-d tree, cut into runs with their boxes."""

    def __init__(self, node: np.ndarray, copies: np.ndarray, raw: np.ndarray, dim: int, block: int):
        x = unit(raw)
        a, b = blocks(dim)[block]
        part = (x @ rotation(dim)[:, a:b]).astype(np.float32)
        order, starts, todo = [], [0], [np.arange(len(x))]
        while todo:
            rows = todo.pop()
            if len(rows) <= RUN:
                order.append(rows)
                starts.append(starts[-1] + len(rows))
                continue
            here = part[rows]
            j = int(np.ptp(here, axis=0).argmax())
            middle = np.argpartition(here[:, j], len(rows) // 2)
            todo += [rows[middle[len(rows) // 2 :]], rows[middle[: len(rows) // 2]]]
        order = np.concatenate(order)
        self.node, self.copies, self.x, part = node[order], copies[order], x[order], part[order]
        self.turned = self.x @ rotation(dim)
        self.runs = [slice(*c) for c in itertools.pairwise(starts)]
        self.low, self.high = (np.stack([f(part[r], 0) for r in self.runs]) if len(x) else np.zeros((0, b - a), np.float32) for f in (np.min, np.max))
        # so that one product gives half the negative squared distance
        half, one = -(part * part).sum(1, keepdims=True) / 2, np.ones((len(part), 1), np.float32)
        self.left, self.right = np.concatenate([part, half, one], 1), np.concatenate([part, one, half], 1)


def gaps(p: Side, q: Side, x: np.ndarray, y: np.ndarray, dim: int, block: int, bound: float) -> np.ndarray:
    """Squared distances of pairs in a block; those close to the bound computed so that every task finds the same."""
    a, b = blocks(dim)[block]
    d = ((p.turned[x, a:b] - q.turned[y, a:b]) ** 2).sum(1)
    for i in np.nonzero(np.abs(d - bound) < CLOSE)[0].tolist():
        low, high = (p.x[x[i]], q.x[y[i]]) if p.node[x[i]] < q.node[y[i]] else (q.x[y[i]], p.x[x[i]])
        d[i] = sum(sum((u - v) * w for u, v, w in zip(low.tolist(), high.tolist(), column.tolist(), strict=True)) ** 2 for column in rotation(dim)[:, a:b].T)
    return d


class Fold:
    """Links found so far among n rows: counts, and the least row that each is joined to."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.links, self.root = copies, np.zeros(len(copies), np.int64), np.arange(len(copies))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        n = len(self.copies)
        self.links += np.bincount(a, self.copies[b], n).astype(np.int64) + np.bincount(b, self.copies[a], n).astype(np.int64)
        ends = np.stack([self.root[a], self.root[b]])
        ends = ends[:, ends[0] != ends[1]]
        if ends.shape[1]:
            heads, at = np.unique(ends, return_inverse=True)
            at = at.reshape(2, -1)
            up = np.arange(n)
            up[heads] = heads[local_roots(len(heads), at[0], at[1])]
            self.root = up[self.root]


def compare(own: Side, other: Side | None, dim: int, block: int, cosine: float) -> tuple[np.ndarray, ...] | None:
    """Links between own and other rows (None: among its own): nodes and their number of links, and star edges (a, b)."""
    q = other or own
    bound, n = share(cosine, dim, block), len(own.node)
    fold = Fold(own.copies if other is None else np.concatenate([own.copies, q.copies]))
    box = np.maximum(own.low[:, None] - q.high[None], q.low[None] - own.high[:, None])
    meet = (np.maximum(box, 0).astype(np.float64) ** 2).sum(2) <= bound + ROUGH
    least = np.float32(-(bound + ROUGH) / 2)
    found = False
    for i, j in zip(*np.nonzero(meet), strict=True):
        if other is None and j < i:
            continue
        near = np.flatnonzero(own.left[own.runs[i]] @ q.right[q.runs[j]].T >= least)
        x, y = np.divmod(near, q.runs[j].stop - q.runs[j].start)
        x, y = x + own.runs[i].start, y + q.runs[j].start
        if other is None and i == j:
            x, y = x[x < y], y[x < y]
        for s in range(0, len(x), 1 << 15):  # verified a stretch at a time
            a, b = x[s : s + (1 << 15)], y[s : s + (1 << 15)]
            keep = np.einsum("ij,ij->i", own.x[a], q.x[b]) >= cosine
            a, b = a[keep], b[keep]
            keep = gaps(own, q, a, b, dim, block, bound) <= bound
            for c in range(block):
                keep &= gaps(own, q, a, b, dim, c, share(cosine, dim, c)) > share(cosine, dim, c)
            if keep.any():
                found = True
                fold.add(a[keep], b[keep] + (0 if other is None else n))
    if not found:
        return None
    nodes = own.node if other is None else np.concatenate([own.node, q.node])
    some, moved = np.nonzero(fold.links)[0], np.nonzero(fold.root != np.arange(len(nodes)))[0]
    return nodes[some], fold.links[some], nodes[moved], nodes[fold.root[moved]]


def shard_links(rows: DataFrame, kind: str, cosine: float) -> DataFrame:
    """-> (a, b, links): b null and links a count of a's, or an edge a-b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, parts = None, None, []

        def flush():
            nonlocal own, parts
            if not parts:
                return
            node, copies, raw = (np.concatenate(c) for c in zip(*parts, strict=True))
            side, parts = Side(node, copies, decoded(raw, key[0], kind), key[0], key[1]), []
            made = compare(own or side, side if own else None, key[0], key[1], cosine)
            own = own or side
            if made:
                n, m = len(made[0]), len(made[2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([made[0], made[2]])), pa.array(np.concatenate([np.zeros(n, np.int64), made[3]]), mask=np.arange(n + m) < n), pa.array(np.concatenate([made[1], np.zeros(m, np.int64)]))],
                    ["a", "b", "links"],
                )

        alone = False  # queries only: nothing lives here
        for batch in batches:
            *keys, query, node, copies, raw = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = query[1:] != query[:-1]
            for k in keys:
                new = new | (k[1:] != k[:-1])
            for a, b in itertools.pairwise([0, *(np.nonzero(new)[0] + 1).tolist(), len(query)]):
                now = tuple(int(k[a]) for k in keys)
                if now != key:
                    yield from flush()
                    key, own, alone = now, None, bool(query[a])
                elif query[a] and own is None and not alone:
                    yield from flush()
                if not alone:
                    parts.append((node[a:b], copies[a:b], raw[a:b]))
                    if own is not None and sum(len(p[0]) for p in parts) >= STRETCH:
                        yield from flush()
        yield from flush()

    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "query").mapInArrow(run, "a long, b long, links long")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shard: int = SHARD, deepest: int = DEEPEST, tiles: int | None = None) -> DataFrame:
    """One row a vector: (vec_id, n_links, component_id, kept).

    Vectors that are null, empty or zero, or hold null or non-finite components, and those without an id, link with
    nothing: n_links 0, component_id their own id. Vectors of different lengths do not link. Equal vectors
    are one class while joining and count as links of each other. Repeated rows and ids count as vectors. An empty table gives an empty
    one; other columns, whatever their names, are not looked at. ``shard``, ``deepest`` and ``tiles`` set how the work is dealt, not what is found.
    """
    kind = "<f4" if isinstance(table.schema[vector_col].dataType, T.ArrayType) and table.schema[vector_col].dataType.elementType == T.FloatType() else "<f8"
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    key = F.when(fine, F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(SEED), F.col("v")).alias("y")))
    keyed = rows.withColumn("key", key)
    classes = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def packed(batches):
        for batch in batches:
            values = batch.column(2)
            data, size = values.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes(), np.dtype(kind).itemsize
            ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False)) * size
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([data[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])], pa.binary())], ["node", "copies", "vector"])

    vectors = classes.select("node", "copies", "v").mapInArrow(packed, "node long, copies long, vector binary")
    plans = plan(vectors, kind, shard, deepest, tiles)
    found = written(shard_links(shard_rows(vectors, kind, plans, cosine), kind, cosine), "links")
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = classes.select("key", "node", "least", "copies").join(links, "node", "left").join(roots, "node", "left")
    classes = written(classes.withColumn("root", F.coalesce("root", "node")), "rooted")
    heads = written(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("n")).where("n > 1"), "heads")
    known = classes.join(heads, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    df = bounded_join(keyed.drop("v"), written(known, "known"), "key", "left")
    df = df.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return df.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component; all rows defined as in ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS least FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(links, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(least, v.vec_id)) AS component_id, v.vec_id <= coalesce(least, v.vec_id) AS kept FROM v LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
