"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of two rows of a table of BUCKETS, those that the word and its beginning are hashed to; there is no
vocabulary. Filters one, two and three words wide run over the whole text; each filter's maximum goes into a logistic output. All
start at random. Training is on all labelled texts, whole: they are dealt to shards by a hash, tasks train on their shards, and what
they learn is averaged after each pass. Thresholds are calibrated on all that is kept back, for each language as guessed from the text
alone, and scores are shifted so that 0.5 is the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.llm.common import crc_mod, flat_arrow, map_rows, tidy, written

SHARD_ROWS, SHARD_BYTES = 4096, 4 << 20  # labelled documents, and bytes of their buckets, that one shard has on average
PLACES = 1 << 25  # bits of the filter that leaves out documents without a label before they move; what it lets through wrongly, the join drops
BUCKETS = 1 << 16  # embedding rows; a bucket fits two bytes
WIDTHS, FILTERS, SIZE, BEGIN = (1, 2, 3), 8, 16, 5
EPOCHS, RATE, DROP, START = 5, 0.1, 0.3, 0.1  # DROP: share of words left out at random while training; START: deviation of the first embeddings
WINDOW = 1 << 13  # words convolved at a time
BATCH = 8  # documents a step
STEP = 256  # parts of a unit that kept-back logits are counted by
SCALE = 1 << 20  # parts of a unit that averages are summed in, as whole numbers, so that their order doesn't matter
ENOUGH, SHARE = 8, 64  # positives kept back that a language needs for a threshold of its own: so many, and that part of all; the rest share one

# ASCII letters and digits, and all bytes of other characters, stay; the rest parts words
PARTS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def hashed(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word and of each word's first BEGIN bytes, the latter marked."""
    words = text.lower().encode(errors="replace").translate(PARTS).split() if text else []
    n = len(words)
    return np.fromiter(map(crc32, words), np.int64, n) % buckets, np.fromiter([crc32(w[:BEGIN], 1) for w in words], np.int64, n) % buckets


class Model:
    """Embeddings, filters and output; ``spoken``: log probability of each bucket by language, ``thresholds``: logits, one a language."""

    def __init__(self, embeddings, kernels, bias, out, out_bias, spoken, thresholds):
        self.embeddings, self.kernels, self.bias, self.out, self.out_bias = embeddings, kernels, bias, out, out_bias
        self.spoken, self.thresholds = spoken, thresholds
        self.projected = None

    def score(self, text: str | None) -> float:
        """Probability, shifted so that the threshold of the text's guessed language is 0.5."""
        logit, language = self.logit(text)
        x = logit - self.thresholds[language]
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

    def logit(self, text: str | None) -> tuple[float, int]:
        return self.of(*hashed(text, len(self.embeddings)))

    def of(self, words: np.ndarray, begins: np.ndarray) -> tuple[float, int]:
        """The logit and the guessed language of a text's buckets."""
        if self.projected is None:  # each row through each filter's columns, once
            self.projected = np.concatenate([self.embeddings @ k for kernel in self.kernels for k in kernel], 1).astype(np.float32)
        peak, spoken, n = np.full((len(WIDTHS), FILTERS), -np.inf, np.float32), np.zeros(self.spoken.shape[1]), len(words)
        reach = max(WIDTHS) - 1
        for at in range(0, max(n, 1), WINDOW):
            a, b = words[at : at + WINDOW + reach], begins[at : at + WINDOW + reach]
            x = self.projected[a] + self.projected[b]
            x = np.concatenate([x, np.zeros((reach + (not n), x.shape[1]), np.float32)])
            m, column = max(1, min(WINDOW, n - at)), 0
            for k, width in enumerate(WIDTHS):
                y = 0
                for j in range(width):
                    y = y + x[j : j + m, column : column + FILTERS]
                    column += FILTERS
                peak[k] = np.maximum(peak[k], y.max(0))
            spoken += self.spoken[a[: min(WINDOW, n - at)]].sum(0)
        hidden = np.maximum(peak + self.bias, 0).ravel()
        return float(hidden @ self.out + self.out_bias), int(spoken.argmax())


class Network:
    """What is trained: embeddings, the last row zero for what is beyond a text, and dense weights, each with Adagrad's memory.

    Of all filters the columns stand side by side: ``kernels[j]`` meets the word j places on, zero for narrower filters.
    """

    def __init__(self, seed: int = 3, buckets: int = BUCKETS):
        rng, n = np.random.default_rng(seed), len(WIDTHS) * FILTERS
        self.embeddings = np.append(rng.normal(0, START, (buckets, SIZE)), np.zeros((1, SIZE)), 0).astype(np.float32)
        width = np.repeat(WIDTHS, FILTERS)
        self.within = (np.arange(max(WIDTHS))[:, None] < width)[:, None, :]
        kernels = rng.normal(0, 1, (max(WIDTHS), SIZE, n)) / np.sqrt(width * SIZE) * self.within
        self.dense = np.concatenate([kernels.ravel(), np.zeros(n), rng.normal(0, 0.3, n), [0.0]]).astype(np.float32)
        self.memory, self.dense_memory = np.full_like(self.embeddings, 0.01), np.full_like(self.dense, 0.01)
        self.touched = np.zeros(buckets + 1, np.int64)

    def parts(self, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views of kernels, biases, output and the output's bias."""
        n = len(WIDTHS) * FILTERS
        k = max(WIDTHS) * SIZE * n
        return dense[:k].reshape(max(WIDTHS), SIZE, n), dense[k : k + n], dense[k + n : k + 2 * n], dense[-1:]

    def copy(self) -> Network:
        out = object.__new__(Network)
        out.within, out.touched = self.within, np.zeros_like(self.touched)
        out.embeddings, out.dense, out.memory, out.dense_memory = (x.copy() for x in (self.embeddings, self.dense, self.memory, self.dense_memory))
        return out

    def peaks(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over the places ``at`` of each of n texts laid end to end, and the first place that has it."""
        kernels, reach = self.parts(self.dense)[0], max(WIDTHS) - 1
        every = np.concatenate(list(kernels), 1)
        filters = kernels.shape[2]
        peak, where = np.full((n, filters), -np.inf, np.float32), np.zeros((n, filters), np.int64)
        for s in range(0, len(at), WINDOW):
            here, own = at[s : s + WINDOW], doc[s : s + WINDOW]
            low, high = here[0], here[-1] + 1 + reach
            x = (self.embeddings[a[low:high]] + self.embeddings[b[low:high]]) @ every
            z = sum(x[j : len(x) - reach + j, j * filters : (j + 1) * filters] for j in range(reach + 1))[here - low]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            docs = own[first]
            most = np.maximum.reduceat(z, first)
            held = np.where(z == most[np.searchsorted(docs, own)], -np.arange(len(z))[:, None], -len(z))
            place = here[-np.maximum.reduceat(held, first)]
            better = most > peak[docs]
            peak[docs], where[docs] = np.where(better, most, peak[docs]), np.where(better, place, where[docs])
        return peak, where

    def step(self, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray) -> None:
        """One step of Adagrad on the logistic loss of some texts."""
        reach, none = max(WIDTHS) - 1, len(self.embeddings) - 1
        gap = [np.full(reach + (not len(a)), none) for a, _ in texts]
        a, b = (np.concatenate([x for t, g in zip(texts, gap, strict=True) for x in (t[k], g)]) for k in (0, 1))
        lengths = np.array([len(t[0]) + len(g) for t, g in zip(texts, gap, strict=True)])
        doc = np.repeat(np.arange(len(texts)), lengths - reach)
        at = np.arange(len(doc)) + doc * reach
        peak, where = self.peaks(a, b, at, doc, len(texts))
        kernels, bias, out, out_bias = self.parts(self.dense)
        raw = peak + bias
        hidden = np.maximum(raw, 0)
        d = (1 / (1 + np.exp(-np.clip(hidden @ out + out_bias, -50, 50))) - y) * weight
        grad = d[:, None] * out * (raw > 0)
        change = np.zeros_like(self.dense)
        to_kernels, to_bias, to_out, to_out_bias = self.parts(change)
        rows, back = [], []
        for j in range(reach + 1):
            ra, rb = a[where + j], b[where + j]
            to_kernels[j] = np.einsum("df,dfs->sf", grad, self.embeddings[ra] + self.embeddings[rb]) * self.within[j]
            some = (grad != 0) & self.within[j] & (ra != none)  # what is beyond the text has no embedding to learn
            deltas = (grad[:, :, None] * kernels[j].T)[some]
            rows += [ra[some], rb[some]]
            back += [deltas, deltas]
        to_kernels += 1e-5 * kernels
        to_bias[:], to_out[:], to_out_bias[:] = grad.sum(0), d @ hidden + 1e-5 * out, d.sum()
        found, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.zeros((len(found), SIZE), np.float32)
        np.add.at(total, inverse, np.concatenate(back))
        self.memory[found] += total * total
        self.embeddings[found] -= RATE * total / np.sqrt(self.memory[found])
        self.touched[found] += 1
        self.dense_memory += change * change
        self.dense -= RATE * change / np.sqrt(self.dense_memory)

    def learn(self, examples: list[tuple[bytes, int]], weight: np.ndarray, passes: int, seed: int) -> Network:
        """A copy trained on examples (packed buckets, label), in an order and with words left out by the seed."""
        own, rng = self.copy(), np.random.default_rng(seed)
        for _ in range(passes):
            order = rng.permutation(len(examples))
            for i in range(0, len(order), BATCH):
                texts, y = [], np.array([examples[k][1] for k in order[i : i + BATCH]], np.float32)
                for k in order[i : i + BATCH]:
                    a, b = unpacked(examples[k][0])
                    stay = rng.random(len(a)) >= DROP
                    texts.append((a[stay], b[stay]))
                own.step(texts, y, weight[y.astype(int)])
        return own

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights, memory) as rows: the embeddings, then the dense ones, filled up with zeros."""
        pad = -len(self.dense) % SIZE
        return tuple(np.concatenate([x, np.append(y, np.zeros(pad, np.float32)).reshape(-1, SIZE)]) for x, y in ((self.embeddings, self.dense), (self.memory, self.dense_memory)))

    def averaged(self, at: np.ndarray, rows: np.ndarray) -> Network:
        """A copy with the rows of ``table`` at some places, of weights and memory side by side, replaced by others."""
        tables, out = self.table(), self.copy()
        for k, x in enumerate(tables):
            x[at] = rows[:, k * SIZE : (k + 1) * SIZE]
        (out.embeddings, dense), (out.memory, memory) = ((x[: len(self.embeddings)], x[len(self.embeddings) :].ravel()[: len(self.dense)]) for x in tables)
        out.dense, out.dense_memory = dense.copy(), memory.copy()
        return out

    def model(self, spoken: np.ndarray, thresholds: np.ndarray) -> Model:
        kernels, bias, out, out_bias = (x.astype(float) for x in self.parts(self.dense))
        split = [kernels[:w, :, k * FILTERS : (k + 1) * FILTERS] for k, w in enumerate(WIDTHS)]
        return Model(self.embeddings[:-1].astype(float), split, bias.reshape(len(WIDTHS), FILTERS), out, float(out_bias[0]), spoken, thresholds)


def packed(text: str | None) -> bytes:
    return np.concatenate(hashed(text)).astype("<u2").tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, "<u2").astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def padded(embeddings: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A text's embeddings, with as many zero rows behind it that every filter fits at its last word, or at least once."""
    return np.concatenate([embeddings[a] + embeddings[b], np.zeros((max(WIDTHS) - 1 + (not len(a)), embeddings.shape[1]))])


def threshold(counts: list[tuple[int, int, int]]) -> float:
    """The logit that parts labels with the best F1, from (logit in units of STEP, documents, those labelled 1); in the middle of the gap around it."""
    step, n, y = (np.array(c, np.int64) for c in zip(*sorted(counts, reverse=True), strict=True))
    if not y.any():
        return (int(step[0]) + 1) / STEP + 1
    best = int((2 * np.cumsum(y) / (np.cumsum(n) + y.sum())).argmax())
    return (int(step[best]) + int(step[best + 1]) + 1) / 2 / STEP if best + 1 < len(step) else int(step[best]) / STEP - 1


def encoded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, j, toxic, lang, back, buckets): every labelled text, whole, as its buckets; ``back``: kept back from training.

    Null labels, ids with contradicting labels and null texts don't count. Rows equal in text, label and language count once: k and j are a hash of these.
    """
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other AND toxic IN (0, 1)")
    marks = written(marks.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "marks")
    rows = prepared(docs, marks).join(marks.hint("merge"), "doc_id", "inner").select("buckets", "lang", "toxic")  # by shuffle at any size: texts don't move, only buckets

    def make():
        def one(row):
            raw = row[0]
            digest = blake2b(raw + f"|{row[2]}|{row[1]}".encode(errors="replace"), digest_size=16).digest()
            k, j = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
            return k, j, row[2], row[1], crc32(raw[: len(raw) // 2]) % 4 == 0, raw

        return one

    return written(map_rows(rows, make, "k long, j long, toxic int, lang string, back boolean, buckets binary").dropDuplicates(["k", "j"]), "labelled")


def prepared(docs: DataFrame, marks: DataFrame, rows: int = 512) -> DataFrame:
    """(doc_id, lang, buckets) of all documents with a text that ``marks`` has, and a few others: ids pass a filter of PLACES bits, made of hashes of the marks' ids."""
    kind, sent = docs.schema["doc_id"].dataType, None
    if kind == marks.schema["doc_id"].dataType:  # ids of different types hash differently; then all documents pass
        bits = np.zeros(PLACES // 8, np.uint8)
        at = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)) + 1
        for r in marks.groupBy(F.bitmap_bucket_number(at).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator():
            part = np.frombuffer(r.bits, np.uint8)
            first = (r["at"] - 1) * len(part)
            bits[first : first + len(part)] = part[: PLACES // 8 - first]
        sent = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        def pack(batch) -> Iterator[dict]:
            if sent is not None:
                at = batch.column(3).to_numpy()
                batch = batch.take(pa.array(np.flatnonzero(sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids, langs, texts = (c.to_pylist() for c in part.columns[:3])
                yield {"doc_id": ids, "lang": langs, "buckets": [packed(t) for t in texts]}

        return pack

    given = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).alias("place"))
    return flat_arrow(given, make, T.StructType([given.schema["doc_id"], given.schema["lang"], T.StructField("buckets", T.BinaryType())]))


def fit(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> Model:
    """Train on all rows of ``docs`` (doc_id, text, lang) that ``labels`` (doc_id, toxic) marks; see ``encoded``.

    ``lang`` teaches only the guess of a text's language. With labels of one kind or none, nothing is ever called toxic. A shard's rows, their order
    and what is kept back go by hashes and averages are of whole numbers, so reruns agree. The driver holds weights and counts by bucket,
    whose size is fixed.
    """
    rows = encoded(docs, labels)
    counts = {(r.back, r.toxic): r for r in rows.groupBy("back", "toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("buckets")).alias("bytes")).collect()}
    number = lambda back, toxic: counts[back, toxic].n if (back, toxic) in counts else 0
    net, train = Network(), [number(False, y) for y in (0, 1)]
    if not all(train):
        return net.model(np.zeros((BUCKETS, 1)), np.full(1, np.inf))
    shards = max(-(-sum(train) // shard_rows), -(-sum(counts[False, y].bytes for y in (0, 1)) // shard_bytes))
    weight = 0.5 * sum(train) / np.array(train)
    with tidy(rows.sparkSession):
        held = rows.where("NOT back").withColumn("shard", F.pmod("k", F.lit(shards))).repartition(shards, "shard")  # what is grouped next; the rows move once
        held = written(held.groupBy("shard").agg(F.collect_list(F.struct("k", "j", "toxic", "buckets")).alias("rows")), "shards")
        for k in range(EPOCHS if shards > 1 else 1):
            net = net.averaged(*learned(held, net, weight, 1 if shards > 1 else EPOCHS, k))
        names = languages(rows, number(True, 1))
        spoken = spoken_by(rows, names)
        model = net.model(spoken, np.zeros(len(names) + 1))
        return calibrated(model, rows.where("back") if number(True, 1) >= ENOUGH else rows)


def learned(shards: DataFrame, net: Network, weight: np.ndarray, passes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, rows): rows of the network's table that any shard changed, averaged over the shards by how often each changed them.

    They come to the driver as Arrow columns of floats; as row objects they would take many times the room in both of its processes.
    """
    sent = shards.sparkSession.sparkContext.broadcast(net)

    class Learner:
        def __init__(self):
            self.n = self.sums = None

        def __call__(self, batch) -> Iterator[dict]:
            for shard, held in zip(*batch.columns, strict=True):
                examples = [(r["buckets"], r["toxic"]) for r in sorted(held.as_py(), key=lambda r: (r["k"], r["j"]))]
                own = sent.value.learn(examples, weight, passes, seed * 1_000_003 + shard.as_py())
                table = np.concatenate(own.table(), 1)
                n = np.append(own.touched, np.full(len(table) - len(own.touched), len(examples)))
                if self.n is None:
                    self.n, self.sums = np.zeros(len(n), np.int64), np.zeros(table.shape, np.int64)
                some = np.flatnonzero(n)
                self.n[some] += n[some]
                self.sums[some] += np.rint(table[some].astype(float) * n[some, None] * SCALE).astype(np.int64)
            return iter(())

        def finish(self) -> Iterator[dict]:
            some = np.flatnonzero(self.n) if self.n is not None else np.zeros(0, int)
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                yield {"at": part, "n": self.n[part], "v": list(self.sums[part])}

    found = flat_arrow(shards, Learner, "at int, n long, v array<long>")
    total = found.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(2 * SIZE)])
    found = total.select("at", *[(F.col(f"v{k}") / (F.col("n") * F.lit(float(SCALE)))).cast("float").alias(f"v{k}") for k in range(2 * SIZE)]).toArrow()
    sent.destroy()
    return found["at"].to_numpy(), np.stack([found[f"v{k}"].to_numpy() for k in range(2 * SIZE)], 1)


def languages(rows: DataFrame, positives: int) -> list[str]:
    """Languages with a threshold of their own: at most SHARE of them."""
    found = rows.where("back AND toxic = 1 AND lang <> ''").groupBy("lang").agg(F.count("*").alias("n"))
    return sorted(r.lang for r in found.where(F.col("n") >= max(ENOUGH, -(-positives // SHARE))).collect())


def spoken_by(rows: DataFrame, names: list[str]) -> np.ndarray:
    """Log probability of each bucket by language, all others as the last; of buckets never seen zero."""

    class Tally:
        def __init__(self):
            self.tally = np.zeros((BUCKETS, len(names) + 1), np.int64)

        def __call__(self, batch) -> Iterator[dict]:
            for lang, raw in zip(*batch.columns, strict=True):
                lang = lang.as_py()
                np.add.at(self.tally[:, names.index(lang) if lang in names else -1], unpacked(raw.as_py())[0], 1)
            return iter(())

        def finish(self) -> Iterator[dict]:
            at, k = np.nonzero(self.tally)
            yield {"at": at, "k": k, "n": self.tally[at, k]}

    found = flat_arrow(rows.select("lang", "buckets"), Tally, "at int, k int, n long").groupBy("at", "k").agg(F.sum("n").alias("n")).toArrow()
    tally = np.zeros((BUCKETS, len(names) + 1))
    tally[found["at"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
    spoken = np.log((tally + 1) / (tally + 1).sum(0))
    spoken[tally.sum(1) == 0] = 0
    return spoken


def calibrated(model: Model, rows: DataFrame) -> Model:
    """Thresholds from all of some rows, counted by their logits in parts of STEP: one a language with ENOUGH positives, one for all together for the others."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        def one(row):
            logit, guess = sent.value.of(*unpacked(row[1]))
            return guess, math.floor(logit * STEP), row[0]

        return one

    found = map_rows(rows.select("toxic", "buckets"), make, "guess int, step long, toxic int").groupBy("guess", "step").agg(F.count("*").alias("n"), F.sum("toxic").alias("y")).collect()
    sent.destroy()
    whole = {}
    for r in found:
        n, y = whole.get(r.step, (0, 0))
        whole[r.step] = n + r.n, y + r.y
    model.thresholds[:] = threshold([(x, *c) for x, c in whole.items()])
    for k in range(len(model.thresholds) - 1):
        own = [(r.step, r.n, r.y) for r in found if r.guess == k]
        if sum(y for *_, y in own) >= ENOUGH:
            model.thresholds[k] = threshold(own)
    return model


def forward(model: Model, a: np.ndarray, b: np.ndarray) -> float:
    """The logit of a text's buckets, all at once."""
    x = padded(model.embeddings, a, b)
    n = len(x) - max(WIDTHS) + 1
    peak = np.stack([sum(x[j : j + n] @ k[j] for j in range(len(k))).max(0) for k in model.kernels])
    return float(np.maximum(peak + model.bias, 0).ravel() @ model.out + model.out_bias)


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents whose labels may be learned: crc32 of the id modulo 5 is not 0."""
    return docs.where(crc_mod("doc_id", 5) != 0).select("doc_id", "text", "lang")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of whole texts; null texts count as empty, which get the score of no word."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS times the filters

    def make():
        own = sent.value

        def one(row):
            score = own.score(row[2])
            return row[0], row[1], score, int(score >= 0.5)

        return one

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text"), make, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those that the model calls toxic; columns untouched, whatever their names. Null texts count as empty, and
    rows with null ids, repeated rows and ties at 0.5 are judged by their text like any other."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fine(texts):
        return texts.map(lambda t: sent.value.score(t) < 0.5).astype(bool)

    return docs.where(fine(F.col("text")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table scored by a model of the labelled rows outside the held-out fifth. Empty and null texts get
    the score of no word; repeated rows the same score; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(training_rows(docs), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
