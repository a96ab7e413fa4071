"""LM scoring: word counts over the corpus, and prediction by partial matching over bytes.

The model is a byte-context trie of depth four, pretrained on the training documents. A byte is coded in its
longest known context; a byte that this context has not seen costs an escape, and is coded in the next shorter one
with the bytes already ruled out excluded, down to the uniform distribution. As the model is fixed while documents are
scored, a byte's code length depends on the byte and the four before it only. It is tabulated for the most frequent contexts and
sent to all tasks; for all others that occur it is computed from written tables of all counts, and joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import bounded_join, crc_mod, flat_arrow, written

DEPTH = 4  # bytes of the longest context
MARK = b"\xff"  # never part of UTF-8: stands before a text, DEPTH times, and after it
CONTEXTS = 40_000  # contexts of DEPTH bytes that are sent to all tasks, the most frequent; the others' code lengths are joined
FREQUENT = 100_000  # words whose counts are broadcast, at most; the others' are joined
FLUSH = 200_000  # words, and sequences times four, that a task tallies before it hands them on
ADD = 0.1


def framed(text: str | None) -> np.ndarray:
    return np.frombuffer(MARK * DEPTH + (text or "").encode(errors="replace") + MARK, np.uint8)


def sequences(data: np.ndarray) -> np.ndarray:
    """Every byte but the leading marks, with the DEPTH before it, as one number."""
    n, code = len(data) - DEPTH, np.zeros(len(data) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        code = code << 8 | data[k : k + n]
    return code


class _Tally:
    """Words and byte sequences of the texts, in bounded parts."""

    def __init__(self):
        self.words: Counter = Counter()
        self.parts: list[np.ndarray] = []
        self.code, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.size = self.ends = 0

    def _words(self) -> Iterator[dict]:
        if self.words:
            yield {"word": list(self.words.keys()), "code": [None] * len(self.words), "n": list(self.words.values())}
            self.words = Counter()

    def _fold(self) -> None:
        if self.parts:
            code, n = np.unique(np.concatenate(self.parts), return_counts=True)
            both, at = np.unique(np.concatenate([self.code, code]), return_inverse=True)
            self.code, self.n = both, np.bincount(at, np.concatenate([self.n, n])).astype(np.int64)
            self.parts, self.size = [], 0

    def _sequences(self) -> Iterator[dict]:
        self._fold()
        if len(self.code):
            yield {"word": [None] * len(self.code), "code": self.code, "n": self.n}
        self.code, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, batch) -> Iterator[dict]:
        for text in batch.column(0):
            text = text.as_py()
            self.ends += 1
            self.words.update((text or "").encode().lower().split())
            self.parts.append(sequences(framed(text)))
            self.size += len(self.parts[-1])
            if len(self.words) > FLUSH:
                yield from self._words()
            if self.size > 1 << 21:
                self._fold()
                if len(self.code) > 4 * FLUSH:
                    yield from self._sequences()

    def finish(self) -> Iterator[dict]:
        yield from self._words()
        yield from self._sequences()
        if self.ends:
            yield {"word": [None], "code": [-1], "n": [self.ends]}


def corpus_counts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Over all texts: (word binary, n), and (code, n) of byte sequences, with the number of texts under -1. Written tables."""
    parts = flat_arrow(texts, _Tally, "word binary, code long, n long")
    every = written(parts.groupBy("word", "code").agg(F.sum("n").alias("n")), "counts")
    return every.where("word IS NOT NULL").select("word", "n"), every.where("word IS NULL").select("code", "n")


def suffix_counts(code: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the sequences' last order + 1 bytes, from those of longer ones."""
    short = code & np.int64((1 << 8 * (order + 1)) - 1)
    keys, at = np.unique(short, return_inverse=True)
    return keys, np.bincount(at, n, len(keys))


def mixed(dense: Iterator[np.ndarray]) -> np.ndarray:
    """Probabilities of all 256 bytes, a row a context, from their counts in it and in ever shorter ones.

    Escape estimation: a context with q different bytes in n occurrences leaves q / (n + q) to all others. Excluded bytes are left
    out of the counts of shorter contexts; a context that isn't known, or whose bytes are all excluded, is skipped.
    """
    p = left = out = None
    for counts in dense:
        if p is None:
            p, left, out = np.zeros(counts.shape), np.ones(len(counts)), np.zeros(counts.shape, bool)
        counts[out] = 0
        kinds = (counts > 0).sum(1)
        whole = np.maximum(counts.sum(1) + kinds, 1)
        p += counts * np.where(kinds > 0, left / whole, 0)[:, None]
        left = np.where(kinds > 0, left * kinds / whole, left)
        out |= counts > 0
    rest = (~out).sum(1)
    p += np.where(out, 0, (left / np.maximum(rest, 1))[:, None])
    return p / p.sum(1, keepdims=True)  # if no byte is left to escape to, what escapes kept is given back


class Trie:
    """Known contexts by length, and log10 probabilities of each byte by context.

    ``short``: counts of sequences of DEPTH bytes, ``deep``: of DEPTH + 1, ``shorter``: of 1, 2 and so on, which are
    sums of ``short`` if not given. Rows of the table are contexts, the empty one first,
    then by length; columns are the bytes seen, and one for each of the others. ``longer`` leads from a context's row to that of the context
    longer by one byte to the left, or, if that isn't known, to the same row.
    """

    def __init__(self, short: tuple[np.ndarray, np.ndarray], deep: tuple[np.ndarray, np.ndarray], *shorter: tuple[np.ndarray, np.ndarray]):
        self.grams = {}
        for order in range(DEPTH + 1):
            keys, counts = deep if order == DEPTH else shorter[order] if order < len(shorter) else suffix_counts(*short, order)
            at = np.argsort(keys, kind="stable")
            self.grams[order] = keys[at] >> 8, keys[at] & 255, counts[at]
        self.rows = {k: np.unique(self.grams[k][0]) if k else np.zeros(1, np.int64) for k in range(DEPTH + 1)}
        self.start = np.cumsum([0] + [len(self.rows[k]) for k in range(DEPTH + 1)])
        seen = np.unique(np.append(self.grams[0][1], MARK[0]))
        self.column = np.full(256, len(seen), np.int64)
        self.column[seen] = np.arange(len(seen))
        rest = np.setdiff1d(np.arange(256), seen)
        self.shown = np.append(seen, rest[:1]) if len(rest) else seen
        self.longer = np.repeat(np.arange(self.start[-2], dtype=np.int32)[:, None], len(seen) + 1, 1)
        for k in range(1, DEPTH + 1):
            top, below = self.rows[k] >> 8 * (k - 1), self.rows[k] & ((1 << 8 * (k - 1)) - 1)
            at = np.searchsorted(self.rows[k - 1], below)
            at = np.minimum(at, len(self.rows[k - 1]) - 1)
            known = self.rows[k - 1][at] == below
            self.longer[self.start[k - 1] + at[known], self.column[top[known]]] = self.start[k] + np.nonzero(known)[0]
        self.table = self._table()
        self.grams = self.rows = None

    def _dense(self, order: int, contexts: np.ndarray) -> np.ndarray:
        """Counts of all 256 bytes after each of the contexts."""
        names, counts = self.grams[order][0], np.zeros((len(contexts), 256))
        low, high = np.searchsorted(names, contexts), np.searchsorted(names, contexts, "right")
        at = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())
        counts[np.repeat(np.arange(len(contexts)), high - low), self.grams[order][1][at]] = self.grams[order][2][at]
        return counts

    def _table(self) -> np.ndarray:
        table = np.zeros((self.start[-1], self.column.max() + 1), np.float32)
        for order in range(DEPTH + 1):
            for at in range(0, len(self.rows[order]), 1024):
                these = self.rows[order][at : at + 1024]
                p = mixed(self._dense(k, these & ((1 << 8 * k) - 1)) for k in range(order, -1, -1))
                table[self.start[order] + at :][: len(these), : len(self.shown)] = np.log10(p[:, self.shown])
        return table

    def _rows(self, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """In parts, the first position, the row of each byte's longest known context, and the table's entries."""
        for at in range(0, len(data) - DEPTH, 1 << 16):
            x = self.column[data[at : at + (1 << 16) + DEPTH]]
            n = len(x) - DEPTH
            row = self.longer[0, x[DEPTH - 1 : DEPTH - 1 + n]]
            for k in range(2, DEPTH + 1):
                going = row >= self.start[k - 1]  # contexts that were known so far
                longer = self.longer[np.where(going, row, 0), x[DEPTH - k : DEPTH - k + n]]
                row = np.where(going, longer, row)
            yield at, row, self.table[row, x[DEPTH:]]

    def score(self, data: np.ndarray) -> float:
        """log10 probability of a framed text, its end included, as if no context were known but the trie's."""
        return sum(float(logs.sum(dtype=np.float64)) for _, _, logs in self._rows(data))

    def split(self, data: np.ndarray) -> tuple[float, np.ndarray]:
        """The part of a framed text's score that is due to bytes whose context of DEPTH bytes is known, and the sequences of all others."""
        total, others = 0.0, [np.zeros(0, np.int64)]
        for at, row, logs in self._rows(data):
            known = row >= self.start[DEPTH]
            total += float(logs[known].sum(dtype=np.float64))
            if not known.all():
                others.append(sequences(data[at : at + len(row) + DEPTH])[~known])
        return total, np.concatenate(others)


def low_bytes(column, k: int):
    """The last k bytes of a sequence or context."""
    return column.bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))


def orders(counts: DataFrame) -> list[DataFrame]:
    """Of (code, n): by order, the counts of all sequences of order + 1 bytes. Written tables but for the longest, which should be one."""
    out = [counts.where("code >= 0")]
    for order in range(DEPTH - 1, -1, -1):
        out.append(written(out[-1].groupBy(low_bytes(F.col("code"), order + 1).alias("code")).agg(F.sum("n").alias("n")), "order"))
    return out[::-1]


def pretrained(grams: list[DataFrame], contexts: int = CONTEXTS) -> Trie:
    """The trie of the most frequent contexts and of all that they end with; counts of these are whole.

    What comes to the driver is bounded by ``contexts``, for each order."""
    context = F.shiftrightunsigned("code", 8)
    best = grams[DEPTH].groupBy(context.alias("context")).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "context").limit(contexts)
    best = written(best.select("context"), "contexts")
    parts = []
    for order, rows in enumerate(grams):
        ends = best.select(low_bytes(F.col("context"), order).alias("context")).distinct()
        part = rows.withColumn("context", context).join(F.broadcast(ends), "context", "left_semi").select("code", "n").toPandas()
        parts.append((part["code"].to_numpy(np.int64), part["n"].to_numpy(np.float64)))
    return Trie(parts[DEPTH - 1], parts[DEPTH], *parts[: DEPTH - 1])


def code_lengths(codes: DataFrame, grams: list[DataFrame]) -> DataFrame:
    """Distinct (code) -> (code, log), the log10 probability of the last byte after the others, from the counts of all orders."""
    context, byte = F.shiftrightunsigned("code", 8), low_bytes(F.col("code"), 1)
    df = codes.groupBy(context.alias("context")).agg(F.collect_list(byte).alias("asked"))
    for order, rows in enumerate(grams):
        seen = F.collect_list(F.shiftleft("n", 8).bitwiseOR(byte)).alias(f"seen{order}")
        seen = written(rows.groupBy(context.alias(f"context{order}")).agg(seen), "contexts")
        df = bounded_join(df, seen, low_bytes(F.col("context"), order) == F.col(f"context{order}"), "left")
    df = df.select("context", "asked", *(f"seen{k}" for k in range(DEPTH, -1, -1)))

    def dense(lists: pa.Array) -> np.ndarray:
        lengths, flat = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        counts = np.zeros((len(lists), 256))
        counts[np.repeat(np.arange(len(lists)), lengths), flat & 255] = flat >> 8
        return counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                logs = np.log10(mixed(dense(c) for c in part.columns[2:])).astype(np.float32).astype(np.float64)
                row = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy(zero_copy_only=False))
                asked = part.column(1).flatten().to_numpy(zero_copy_only=False)
                code = part.column(0).to_numpy(zero_copy_only=False)[row] << 8 | asked
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(logs[row, asked])], ["code", "log"])

    return written(df.mapInArrow(run, "code long, log double"), "lengths")


def frequent_words(words: DataFrame, most: int) -> dict[bytes, int]:
    """At most so many of the most frequent words, of up to 256 bytes, by a threshold from a histogram of counts; ties stay out together."""
    words = words.where(F.length("word") <= 256)
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    held, least = 0, None
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    if least is None:
        return {}
    rows = words.where(step >= least).toArrow()
    return dict(zip((bytes(w) for w in rows["word"].to_pylist()), rows["n"].to_pylist(), strict=True))


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, contexts: int = CONTEXTS) -> DataFrame:
    """One row a document: (doc_id, n_tokens, n_known, train_tokens, base_score, score).

    ``training``: a condition, the rows to learn from. Tokens are words and one end a text. base_score sums
    log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens; score is the model's log10 probability of the text's bytes and its end. Null texts
    count as empty: one token, the end. ``frequent`` and ``contexts`` bound what is sent to all tasks; results don't depend on them. Without training rows all counts are zero and bytes are uniform.
    """
    spark = docs.sparkSession
    words, codes = corpus_counts(docs.where(training).select(text_col))
    grams = orders(codes)
    trie = pretrained(grams, contexts)
    ends = int(codes.where("code < 0").agg(F.sum("n")).first()[0] or 0)
    total, kinds = words.agg(F.sum("n"), F.count("*")).first()
    total, kinds = int(total or 0) + ends, int(kinds) + (ends > 0)
    sent = spark.sparkContext.broadcast((trie, {w: float(np.log10(n + ADD)) for w, n in frequent_words(words, frequent).items()}, float(np.log10(ends + ADD)), ends > 0))

    class Score:
        def __init__(self):
            self.trie, self.known, self.end, self.ended = sent.value

        def __call__(self, batch) -> Iterator[dict]:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {k: [] for k in ("id", "n_tokens", "n_known", "sum_log", "score", "words", "times", "codes", "code_times")}
                for key, text in zip(part.column(0), part.column(1), strict=True):
                    text = text.as_py() or ""
                    tally = Counter(text.encode().lower().split())
                    sum_log, n_known, rare, times = self.end, int(self.ended), [], []
                    get = self.known.get
                    for w, n in tally.items():
                        x = get(w)
                        if x is None:
                            rare.append(w)
                            times.append(n)
                        else:
                            sum_log += n * x
                            n_known += n
                    known, others = self.trie.split(framed(text))
                    for k, v in zip(out, (key.as_py(), tally.total() + 1, n_known, sum_log, known, rare, times, *np.unique(others, return_counts=True)), strict=True):
                        out[k].append(v)
                yield out

    kind = docs.schema[id_col].dataType.simpleString()
    rows = flat_arrow(docs.select(id_col, text_col), Score, f"id {kind}, n_tokens long, n_known long, sum_log double, score double, words array<binary>, times array<long>, codes array<long>, code_times array<long>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + ADD)).alias("more_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    others = rows.select("row", F.explode(F.arrays_zip("codes", "code_times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.code_times").alias("times"))
    others = bounded_join(others, code_lengths(others.select("code").distinct(), grams), "code", "left")
    others = others.groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    rows = rows.drop("words", "times", "codes", "code_times").join(written(rare, "rare"), "row", "left").join(written(others, "others"), "row", "left")
    base = F.col("sum_log") + F.coalesce("more_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + ADD * (kinds + 1))))
    return rows.select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the counts of nine tenths of them; nulls, empty tables and repeated rows as in ``score``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod("doc_id", 10) == 0
    df = score(docs, ~held_out)
    return df.withColumn("held_out", crc_mod("doc_id", 10) == 0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
