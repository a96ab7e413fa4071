"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to four letters of lower-cased words, marked at their ends, are hashed to a fixed number of
columns. Document frequencies come from all training documents. Weights are trained by follow-the-regularised-leader
with an L1 and an L2 penalty, which keeps most of them at zero; probabilities are sharpened or softened by a
temperature fitted on training documents that the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import crc_mod, flat_arrow, map_rows
from firmlake.llm.sampling import sampled_all, within_bytes

COLUMNS = 1 << 15  # hashed n-grams
SIZES = (1, 2, 3, 4)
PER_LANGUAGE = 600  # documents of a language that weights are trained on; the bound of the sample
LANGUAGES = 100  # languages beyond which each has fewer documents in the sample
LEAST = 30  # but about so many
BYTES = 24 << 20  # of the sample's texts, all together, an equal share a language; one document a language at least
WINDOW = 1 << 16  # characters turned into n-grams at a time
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-3
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def counts(text: str | None, columns: int = COLUMNS) -> np.ndarray | None:
    """How often each hashed n-gram occurs, dense; None if the text is null or has no letter.

    Anything but letters counts as one word boundary. N-grams are taken over the whole text.
    """
    if not text:
        return None
    total, letter = np.zeros(columns, np.int64), False
    for at in range(0, len(text), WINDOW):
        # a stretch takes the last characters of the one before along, so no n-gram is lost
        low = text[at : at + WINDOW].lower()
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = (points >= 97) & (points <= 122)
        if not low.isascii():
            other = np.nonzero(points >= 128)[0]
            kinds, where = np.unique(points[other], return_inverse=True)
            letters[other] = np.array([chr(k).isalpha() for k in kinds.tolist()], bool)[where]
        if at == 0:
            carry = np.zeros(1, np.uint32)
        letter = letter or bool(letters.any())
        points = np.concatenate([carry, np.where(letters, points, 0).astype(np.uint32)])
        new = len(carry)
        if at + WINDOW >= len(text):
            points = np.concatenate([points, np.zeros(1, np.uint32)])
        keep = np.ones(len(points), bool)
        keep[new:] = (points[new:] != 0) | (points[new - 1 : -1] != 0)
        fresh = np.cumsum(keep)[new - 1]
        points = points[keep]
        mixed = (points.astype(np.uint64) + np.uint64(1)) * SEEDS[0]
        code, found = np.zeros(len(points), np.uint64), []
        for n in SIZES:
            code = mixed if n == 1 else code[:-1] * SEEDS[1] + mixed[n - 1 :]
            # only n-grams that end in this stretch
            first = max(0, int(fresh) - n + 1)
            part = code[first:]
            found.append((part ^ (part >> np.uint64(29))) * SEEDS[2] >> np.uint64(40))
        total += np.bincount((np.concatenate(found) % np.uint64(columns)).astype(np.int64), minlength=columns)
        carry = points[-(max(SIZES) - 1) :]
    return total if letter else None


def weigh(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a count vector: 1 + log of the count, times idf, to length one."""
    at = np.nonzero(found)[0]
    value = (1 + np.log(found[at])) * idf[at]
    norm = np.sqrt((value * value).sum())
    return at, value / norm if norm else value


def document_frequencies(texts: DataFrame, columns: int = COLUMNS) -> tuple[np.ndarray, int]:
    """Of how many texts each column is part, over all of them; and how many texts with letters there are."""

    class Tally:
        def __init__(self):
            self.df, self.n = np.zeros(columns, np.int64), 0

        def __call__(self, batch) -> Iterator[dict]:
            for text in batch.column(0):
                found = counts(text.as_py(), columns)
                if found is not None:
                    self.df += found > 0
                    self.n += 1
            return iter(())

        def finish(self) -> Iterator[dict]:
            at = np.nonzero(self.df)[0]
            yield {"at": np.append(at, -1), "n": np.append(self.df[at], self.n)}

    rows = flat_arrow(texts, Tally, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    df, n = np.zeros(columns, np.int64), 0
    for at, value in zip(rows["at"].to_numpy(), rows["n"].to_numpy(), strict=True):
        if at < 0:
            n = int(value)
        else:
            df[at] = value
    return df, n


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, columns: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (columns + 1, classes), the last row a bias, by FTRL-proximal with elastic-net penalties."""
    z, n = np.zeros((columns + 1, classes)), np.zeros((columns + 1, classes))
    order = np.random.default_rng(5)

    def weights(zs, ns):
        return np.where(np.abs(zs) <= L1, 0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, value, label = examples[i]
            at, value = np.append(at, columns), np.append(value, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = value[:, None] * p[None, :]
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
            n[at] = grown
    return weights(z, n)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes the labels likeliest; 1 if there is nothing to fit on."""
    if not len(labels):
        return 1.0
    best, least = 1.0, np.inf
    for t in np.exp(np.linspace(np.log(0.02), np.log(20), 200)):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        loss = -(s[np.arange(len(labels)), labels] - np.log(np.exp(s).sum(1))).mean()
        if loss < least - 1e-12:
            best, least = float(t), loss
    return best


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, columns: int = COLUMNS) -> dict:
    """A model from all rows (text, lang): document frequencies over all, weights from a bounded sample of features.

    Every language is learned, however many there are. A fifth of the sample, by a hash, sets the temperature; a language that has
    no other rows is trained on these. Rows with a null lang or text don't count, and texts without a letter teach nothing.
    Without rows nothing is learned.
    """
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    df, n = document_frequencies(rows.select("text"), columns)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)

    def make():
        def one(row):
            found = counts(row[0], columns)
            at, value = weigh(found, idf) if found is not None else (np.zeros(0, int), np.zeros(0))
            return row[1], row[2], at.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()

        return one

    chosen = within_bytes(sampled_all(rows.select("text", "lang"), "lang", per_language, LANGUAGES, LEAST), "text", BYTES, "lang").select("text", "lang", (F.crc32(F.col("text").cast("binary")) % 5 == 0).alias("kept_back"))
    features = [(r[0], r[1], np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32).astype(float)) for r in map_rows(chosen, make, "lang string, kept_back boolean, at binary, value binary").collect()]
    features.sort(key=lambda f: (f[0], f[1], f[2].tobytes(), f[3].tobytes()))
    names = sorted({f[0] for f in features})
    if not names:
        return {"names": [], "idf": idf, "weights": np.zeros((columns + 1, 0)), "temperature": 1.0}
    code = {x: i for i, x in enumerate(names)}
    seen = [(at, v, code[x]) for x, back, at, v in features if not back and len(at)]
    held = [(at, v, code[x]) for x, back, at, v in features if back and len(at)]
    trained = {x for *_, x in seen}
    seen += [f for f in held if f[2] not in trained]
    weights = train(seen, len(names), columns)
    scores = np.array([v @ weights[at] + weights[-1] for at, v, _ in held]).reshape(-1, len(names))
    return {"names": names, "idf": idf, "weights": weights, "temperature": temperature(scores, np.array([x for *_, x in held], int))}


def predict(model: dict, text: str | None) -> tuple[str, float]:
    """(language, its probability). Texts that are null or have no letter: ``und``, 1.0; also if nothing was learned, with 0.0."""
    found = counts(text, len(model["idf"]))
    if found is None:
        return "und", 1.0
    if not model["names"]:
        return "und", 0.0
    at, value = weigh(found, model["idf"])
    s = (value @ model["weights"][at] + model["weights"][-1]) / model["temperature"]
    p = np.exp(s - s.max())
    p /= p.sum()
    best = int(p.argmax())
    return model["names"][best], float(p[best])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the two thirds that aren't held out. Null texts and those without a letter are ``und``;
    equal texts get equal answers; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod("doc_id", 3) == 1
    model = fit(docs.where(~held_out).select("text", "lang"))
    sent = spark.sparkContext.broadcast(model)  # of fixed size: columns times languages

    def make():
        own = sent.value

        def one(row):
            return row[0], row[1], *predict(own, row[2])

        return one

    return map_rows(docs.select("doc_id", held_out.alias("held_out"), "text"), make, "doc_id long, held_out boolean, lang_pred string, score double")
