"""Removal of repeated passages: every byte covered by a string of LENGTH bytes that also starts earlier.

All suffixes of all texts would be far too many to move, so each window of LENGTH bytes is represented by one suffix
in it, chosen by content alone: the one whose first GRAM bytes have the least hash (the leftmost of equals). Equal
windows choose equal suffixes, at the same place in them, so windows can only repeat where chosen suffixes begin alike.

1. A filter keeps the chosen suffixes whose first GRAM bytes may begin another one as well, by a hash of these: the others
   can't be part of a repetition. Only hashes and places move for this.
2. Splitters, quantiles of the leading bytes of the suffixes that are left, range-partition them into buckets, each with its block: all
   bytes of the windows that chose it.
3. A bucket sorts its suffixes by multikey quicksort, eight bytes a key. Neighbours with GRAM bytes in common form a group;
   of equal blocks all but the first are repeated throughout, and of equal windows in blocks that differ all but the first.
   Splitters are whole leading keys, and suffixes of one key never part, so no group reaches across a boundary, but for
   those of more than GROUP suffixes: their windows are dealt one by one, and compared with their neighbours in order.

Hashes only choose, filter and bring candidates together; what counts as equal is equal in its bytes. What repeats within one batch
of documents is settled there, so a passage that a third of all documents share is moved once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import discard, written

LENGTH = 100
GRAM = 40
SPAN = LENGTH - GRAM + 1  # grams of a window
PIECE = 1 << 20  # windows of a text handled at a time
BATCH = 8 << 20  # bytes of texts whose repetitions are settled at once
FILTERED = 400_000  # suffixes that a task of the filter holds, about
BUCKET = 12 << 20  # bytes of blocks of a bucket, about
GROUP = 4_000  # suffixes of a group up to which they are compared in one place
CHUNK = 4_096  # blocks whose windows are compared at a time, and whole groups at least
NO_ID = (1 << 63) - 1  # documents without an id come last

_rng = np.random.default_rng(20)
TABLES = _rng.integers(0, 1 << 64, (2, 256), np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of the two bases and of their inverses, once a process."""
    if not _powers:
        n = PIECE + 2 * LENGTH + 1
        for x in (*BASES, *INVERSES):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def prefix_sums(data: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLES[which][data] * powers()[which][: len(data)], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def hashes(sums: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the bytes from start to end, wherever they are."""
    return (sums[end] - sums[start]) * powers()[2 + which][start]


def keys_at(data: np.ndarray, place: np.ndarray, n: int) -> list[np.ndarray]:
    """The n keys of eight bytes each that follow the places, as numbers that order as the bytes do."""
    out = []
    for k in range(n):
        key = np.zeros(len(place), np.uint64)
        for j in range(8 * k, 8 * k + 8):
            key = key << np.uint64(8) | data[place + j]
        out.append(key)
    return out


def chosen(data: np.ndarray):
    """Chosen suffixes of a piece: (place, first window, last window, gram hash, block hash, first key)."""
    n = len(data) - LENGTH + 1
    one, two = prefix_sums(data, 0), prefix_sums(data, 1)
    grams = len(data) - GRAM + 1
    gram = mixed((one[GRAM:] - one[:grams]) * powers()[2][:grams])
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:  # least of 2, 4, ... in a row
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[SPAN - width : SPAN - width + n])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(place[1:] != place[:-1])[0] + 1])
    last = np.append(first[1:] - 1, n - 1)
    place = place[first]
    block = hashes(two, 1, first, last + LENGTH)
    block = mixed(block + (((place - first) << 8) | (last - first)).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return place, first, last, gram[place], block, keys_at(data, place, 1)[0]


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Rows in the order of the keys: sorted by the first, then only what ties by the next, and so on."""
    order = np.argsort(keys[0], kind="stable")
    if len(keys) == 1 or len(order) < 2:
        return order
    x = keys[0][order]
    same = x[1:] == x[:-1]
    tied = np.nonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))[0]
    if len(tied):
        group = np.cumsum(np.concatenate([[True], ~same]))[tied]
        rows = order[tied]
        inner = multikey_order([k[rows] for k in keys[1:]])
        order[tied] = rows[inner[np.argsort(group[inner], kind="stable")]]
    return order


def pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        yield at, data[at : at + PIECE + LENGTH - 1]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals; those that touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.nonzero(new)[0][1:] - 1, len(end) - 1)]


def batches_of(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """(id, twin, bytes, ...) rows of a batch, some MB of text at a time, in the order of documents."""
    rows, size = [], 0
    for row in zip(*batch.columns, strict=True):
        key, twin, text, *rest = (c.as_py() for c in row)
        data = (text or "").encode(errors="replace")
        rows.append((NO_ID if key is None else key, twin, data, *rest))
        size += len(data)
        if size >= BATCH:
            yield sorted(rows, key=lambda r: r[:2])
            rows, size = [], 0
    if rows:
        yield sorted(rows, key=lambda r: r[:2])


CHOSEN = "gram long, key long, id long, twin long, at long"
FOUND = "id long, twin long, start long, end long, mode int, key long, off int"  # mode: 0 repeated, 1 compare by block, 2 by window


def suffix_rows(docs: DataFrame) -> DataFrame:
    """(id, twin, text) -> chosen suffixes: gram hash, first key, document, and packed place and windows; and what is
    settled already, with at = -1, as start and end in the place of hash and key."""
    names = [f.split()[0] for f in CHOSEN.split(", ")]

    def run(batches):
        for batch in batches:
            for rows in batches_of(batch):
                parts, owner = [], []
                for i, (_, _, data) in enumerate(rows):
                    for at, piece in pieces(np.frombuffer(data, np.uint8)):
                        place, first, last, gram, block, key = chosen(piece)
                        parts.append((place + at, first + at, last + at, gram, block, key))
                        owner.append(np.full(len(place), i))
                if not parts:
                    continue
                place, first, last, gram, block, key = (np.concatenate(p) for p in zip(*parts, strict=True))
                owner = np.concatenate(owner)
                order = multikey_order([gram, block, owner, place])
                alike = np.nonzero(repeated(gram[order], block[order]))[0]
                texts = [r[2] for r in rows]
                a, b, own, other = first[order[alike]], first[order[alike - 1]], owner[order[alike]], owner[order[alike - 1]]
                size = last[order[alike]] + LENGTH - a
                same = [texts[i][x : x + n] == texts[j][y : y + n] for i, j, x, y, n in zip(own.tolist(), other.tolist(), a.tolist(), b.tolist(), size.tolist(), strict=True)]
                again = np.sort(order[alike[np.array(same, bool)]])  # rows are in the order of documents, then places
                keep = np.ones(len(order), bool)
                keep[again] = False
                ids, twins = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
                at = (place[keep] << 16) | ((place - first)[keep] << 8) | (place - last)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(gram[keep].view(np.int64)), pa.array(key[keep].view(np.int64)), pa.array(ids[owner[keep]]), pa.array(twins[owner[keep]]), pa.array(at)], names)
                if len(again):
                    cuts = np.searchsorted(owner[again], np.arange(len(rows) + 1))
                    out = []
                    for i in np.unique(owner[again]).tolist():
                        mine = again[cuts[i] : cuts[i + 1]]
                        start, end = merged(first[mine], last[mine] + LENGTH)
                        out.append((np.full(len(start), i), start, end))
                    own, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), pa.array(ids[own]), pa.array(twins[own]), pa.array(np.full(len(own), -1))], names)

    return docs.mapInArrow(run, CHOSEN)


def filtered(rows: DataFrame, tasks: int) -> DataFrame:
    """Chosen suffixes -> repeated intervals (mode 0), and those suffixes whose gram hash another has."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    def found(key, twin, start, end, mode, lead, off):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(twin), pa.array(start), pa.array(end), pa.array(mode.astype(np.int32)), pa.array(lead), pa.array(off.astype(np.int32))], names)

    def run(batches):
        parts = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            settled = columns[4] < 0
            if settled.any():
                start, end, key, twin, _ = (c[settled] for c in columns)
                none = np.zeros(len(key), np.int64)
                yield found(key, twin, start, end, none, none, none)
            if not settled.all():
                parts.append([c[~settled] for c in columns])
        if not parts:
            return
        gram, lead, key, twin, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.argsort(gram, kind="stable")
        starts = np.nonzero(np.append(True, gram[order][1:] != gram[order][:-1]))[0]
        size = np.diff(np.append(starts, len(gram)))
        size = np.repeat(size, size)
        order, size = order[size > 1], size[size > 1]
        lead, key, twin, at = (c[order] for c in (lead, key, twin, at))
        place, off = at >> 16, (at >> 8) & 255
        yield found(key, twin, place - off, place - (at & 255), np.where(size > GROUP, 2, 1), lead, off)

    spread = F.when(F.col("at") < 0, F.xxhash64("id", "gram")).otherwise(F.col("gram"))
    return rows.repartition(tasks, spread).mapInArrow(run, FOUND)


MOVED = "bucket int, off int, id long, twin long, start long, block binary"  # off: -1 a single window, -2 repeated, its size as the block's


def block_rows(docs: DataFrame, splitters: np.ndarray, singles: int) -> DataFrame:
    """(id, twin, text, ranges) -> suffixes with their blocks, by bucket; windows one by one, by their bytes; and what is settled at once."""
    names = [f.split()[0] for f in MOVED.split(", ")]

    def run(batches):
        from zlib import crc32

        for batch in batches:
            for rows in batches_of(batch):
                seen, out = set(), []
                for key, twin, data, ranges in rows:
                    for r in sorted(ranges, key=lambda r: r["start"]):
                        start, off = r["start"], r["off"]
                        if r["mode"] == 1:
                            block = data[start : r["end"] + LENGTH]
                            if (off, block) in seen:
                                out.append((0, -2, key, twin, start, len(block).to_bytes(8, "little")))
                            else:
                                seen.add((off, block))
                                out.append((int(np.searchsorted(splitters, r["key"], "right")), off, key, twin, start, block))
                            continue
                        for at in range(start, r["end"] + 1):
                            window = data[at : at + LENGTH]
                            if (-1, window) in seen:
                                out.append((0, -2, key, twin, at, LENGTH.to_bytes(8, "little")))
                            else:
                                seen.add((-1, window))
                                out.append((len(splitters) + 1 + crc32(window) % singles, -1, key, twin, at, window))
                        if len(out) > 1 << 16:
                            yield moved(out)
                            out = []
                if out:
                    yield moved(out)

    def moved(rows):
        bucket, off, key, twin, start, block = zip(*rows, strict=True)
        bucket = np.array(bucket)
        none = np.array(off) == -2
        bucket[none] = np.arange(none.sum()) % (len(splitters) + 1)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((bucket, off, key, twin, start, block), kinds, strict=True)], names)

    return docs.mapInArrow(run, MOVED)


def repeated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows have both keys of the row before."""
    return np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])[: len(a)]


def blocks_compared(blocks: list[bytes], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks in the order of documents -> (row, start, end) of windows that an earlier block, or place of the same, has."""
    size = np.array([len(b) for b in blocks])
    whole = b"".join(blocks)
    data = np.frombuffer(whole, np.uint8)
    windows = size - LENGTH + 1
    owner = np.repeat(np.arange(len(blocks)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(size) - size, windows) + inside
    w = []
    for k in (0, 1):
        values = np.empty(len(at), np.uint64)
        for a in range(0, len(data), PIECE):  # sums are taken a piece at a time, so powers stay bounded
            low, high = np.searchsorted(at, [a, a + PIECE])
            piece = data[a : a + PIECE + LENGTH]
            values[low:high] = hashes(prefix_sums(piece, k), k, at[low:high] - a, at[low:high] - a + LENGTH)
        w.append(mixed(values))
    order = multikey_order([*w, np.arange(len(at))])
    alike = np.nonzero(repeated(w[0][order], w[1][order]))[0]
    places, before = at[order[alike]].tolist(), at[order[alike - 1]].tolist()
    if all(whole[x : x + LENGTH] == whole[y : y + LENGTH] for x, y in zip(places, before, strict=True)):
        again = np.sort(order[alike])
    else:  # hashes of different windows agree: by their bytes alone
        seen: set[bytes] = set()
        again = np.array([i for i, x in enumerate(at.tolist()) if (v := whole[x : x + LENGTH]) in seen or seen.add(v)], np.int64)
    begin = start[owner[again]] + inside[again]
    new = np.concatenate([[True], (owner[again][1:] != owner[again][:-1]) | (begin[1:] != begin[:-1] + 1)])[: len(again)]
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(again)) - 1
    return owner[again][first], begin[first], begin[last[: len(first)]] + LENGTH


def bucket_spans(rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """A bucket's suffixes -> (id, twin, start, end) of what is repeated in them."""
    off, ids, twins, start = (rows.column(c).to_numpy() for c in ("off", "id", "twin", "start"))
    blocks = rows.column("block").to_pylist()
    size = np.array([len(b) for b in blocks])
    keys = keys_at(np.frombuffer(b"".join(blocks), np.uint8), np.cumsum(size) - size + off, GRAM // 8)
    equal = np.fromiter(map(hash, blocks), np.int64, len(blocks))  # brings equal blocks together
    order = multikey_order([*keys, equal, off, ids, twins, start])
    # neighbours with all keys in common begin alike
    near = np.append(False, np.all([k[order][1:] == k[order][:-1] for k in keys], 0))
    line = order.tolist()
    again = np.array([n and off[i] == off[j] and blocks[i] == blocks[j] for n, i, j in zip(near.tolist(), line, line[-1:] + line[:-1], strict=True)], bool)
    done = order[again]
    yield ids[done], twins[done], start[done], start[done] + size[done]
    group = np.cumsum(~near)
    rest, group = order[~again], group[~again]
    many = np.repeat(c := np.unique(group, return_counts=True)[1], c) > 1
    rest, group = rest[many], group[many]
    rest = rest[(inner := multikey_order([group, ids[rest], twins[rest], start[rest]]))]
    group = group[inner]
    cuts = np.append(np.nonzero(np.append(True, group[1:] != group[:-1]))[0], len(group)) if len(group) else np.zeros(1, np.int64)
    at = 0
    while at < len(cuts) - 1:  # whole groups, CHUNK blocks or so at a time
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + CHUNK, "right")) - 1)
        part = rest[cuts[at] : cuts[to]]
        own, begin, end = blocks_compared([blocks[i] for i in part.tolist()], start[part])
        yield ids[part[own]], twins[part[own]], begin, end
        at = to


def spans_compared(rows: DataFrame, buckets: int, singles: bool) -> DataFrame:
    """Buckets -> repeated intervals. Single windows come in the order of their bytes, then of documents, and are compared as they pass."""
    names = ["id", "twin", "start", "end"]

    def run(batches):
        held, last = [], None

        def spans(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            off, ids, twins, start = (batch.column(k).to_numpy() for k in (1, 2, 3, 4))
            done = off == -2
            if done.any():
                size = np.array([int.from_bytes(b, "little") for b in batch.column(5).filter(pa.array(done)).to_pylist()])
                yield spans(ids[done], twins[done], start[done], start[done] + size)
            alone = np.nonzero(off == -1)[0]
            if len(alone):
                windows = batch.column(5).take(pa.array(alone)).to_pylist()
                again = alone[np.array([w == v for w, v in zip(windows, [last, *windows[:-1]], strict=True)], bool)]
                last = windows[-1]
                yield spans(ids[again], twins[again], start[again], start[again] + LENGTH)
            held.append(batch.filter(pa.array(off >= 0)))
        if sum(b.num_rows for b in held):
            for found in bucket_spans(pa.Table.from_batches(held).combine_chunks()):
                yield spans(*found)

    dealt = rows.repartitionById(buckets, "bucket")
    if singles:
        one = F.col("off") == -1
        dealt = dealt.sortWithinPartitions(F.when(one, F.col("block")), F.when(one, F.col("id")), F.when(one, F.col("twin")), F.when(one, F.col("start")))
    return dealt.mapInArrow(run, "id long, twin long, start long, end long")


def repeats(docs: DataFrame) -> DataFrame:
    """(id, twin, text) -> (id, twin, spans): repeated intervals, unmerged, for documents that have some."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = written(filtered(suffix_rows(docs), max(1, round(size * 2 / (SPAN + 1) / FILTERED))), "suffixes")
    width = F.col("end") - F.col("start")
    moved, single = found.agg(F.sum(F.when(F.col("mode") == 1, width + LENGTH)), F.sum(F.when(F.col("mode") == 2, (width + 1) * LENGTH))).first()
    buckets, singles = max(1, (moved or 0) // BUCKET), -(-(single or 0) // BUCKET)
    splitters = np.zeros(0, np.int64)
    if buckets > 1:
        quantiles = F.percentile_approx("key", F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), 20 * buckets)
        splitters = np.unique(np.array(found.where("mode = 1").agg(quantiles).first()[0], np.int64))
    ranges = found.where("mode > 0").groupBy("id", "twin").agg(F.collect_list(F.struct("start", "end", "mode", "key", "off")).alias("ranges"))
    rows = block_rows(docs.join(ranges, ["id", "twin"]).select("id", "twin", "text", "ranges"), splitters, max(1, singles))
    rest = spans_compared(rows, len(splitters) + 1 + singles, singles > 0)
    spans = found.where("mode = 0").select("id", "twin", "start", "end").unionByName(rest)
    spans = written(spans.groupBy("id", "twin").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    discard(found)
    return spans


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, twin, text, doc_id): twin tells texts of one id apart; 0 where ids don't repeat. doc_id is null where the id is."""
    own = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(own, F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"), own.alias("doc_id"))
    alone = rows.groupBy("id").count().where("count > 1").limit(1).count() == 0
    return rows.select("id", (F.lit(0).cast("long") if alone else F.xxhash64("text")).alias("twin"), "text", "doc_id")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, n_bytes, spans, kept): merged removed intervals, in bytes, and the bytes that remain.

    Texts shorter than LENGTH, empty and null ones (no bytes) lose nothing. Documents without an id come after all
    others. Rows of one id are one document if their texts are equal, and get the same result; else they are ordered by a hash.
    """
    rows = keyed(docs, id_col, text_col)
    spans = repeats(rows.drop("doc_id"))
    joined = rows.join(spans, ["id", "twin"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, sizes, cuts, kept = [], [], [], []
                for key, text, found in zip(*part.columns, strict=True):
                    data = (text.as_py() or "").encode(errors="replace")
                    start = end = np.zeros(0, np.int64)
                    if found.is_valid:
                        v = found.values
                        start, end = merged(*(x.to_numpy(zero_copy_only=False) for x in v.flatten()))
                    out, last = [], 0
                    for a, b in zip(start.tolist(), end.tolist(), strict=True):
                        out.append(data[last:a])
                        last = b
                    ids.append(key.as_py())
                    sizes.append(len(data))
                    cuts.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                    kept.append(b"".join(out) + data[last:])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cuts, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of every document, and the digest of what is kept; all rows defined as in ``removed``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = removed(docs)
    return df.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
pc AS (SELECT doc_id, q, n, substr(h, (800 * q + 1)::INT, 998) AS s FROM (SELECT doc_id, h, n, unnest(range(0, (n - 100) // 400 + 1)) AS q FROM n WHERE n >= 100)),
w AS (SELECT doc_id, 400 * q + o AS p, row_number() OVER (PARTITION BY md5(substr(s, (2 * o + 1)::INT, 200)) ORDER BY doc_id, 400 * q + o) > 1 AS again
  FROM (SELECT doc_id, q, s, unnest(range(0, least(400, n - 99 - 400 * q))) AS o FROM pc)),
r AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM w WHERE again),
i AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM r GROUP BY doc_id, g),
j AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM i),
k AS (SELECT doc_id, a, b, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS s FROM j), s AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM k GROUP BY doc_id, s),
l AS (SELECT s.doc_id, b, n, lead(a) OVER (PARTITION BY s.doc_id ORDER BY a) AS nxt FROM s JOIN n ON n.doc_id = s.doc_id),
t AS (SELECT doc_id, b AS a, coalesce(nxt, n) AS b FROM l UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id),
x AS (SELECT t.doc_id, string_agg(substr(h, (2 * a + 1)::INT, (2 * (b - a))::INT), '' ORDER BY a) AS kept FROM t JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT n.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM n LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""
