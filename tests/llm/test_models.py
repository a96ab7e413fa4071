"""The trained operators: held-out accuracy, and plain versions of what is defined exactly."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from firmlake.llm import language, scoring, toxicity

DATA = "/root/testdata/sf0.01"


def test_ngrams_do_not_depend_on_windows(monkeypatch):
    text = "Hello, wörld! ab 12 " * 40
    want = language.counts(text)
    for window in (7, 50):
        monkeypatch.setattr(language, "WINDOW", window)
        assert (language.counts(text) == want).all()
    assert language.counts("12 !") is None and language.counts(None) is None


def test_language(spark, odd):
    rows = language.op5_language(spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    held = rows.join(truth, "doc_id").where("held_out")
    assert held.where("lang_pred = lang").count() > 0.97 * held.count()
    model = language.fit(odd.select("text", "lang"))
    assert language.predict(model, "") == ("und", 1.0) and language.predict(model, "a b")[0] == "en"
    assert language.predict(language.fit(odd.where("false").select("text", "lang")), "abc") == ("und", 0.0)


def test_all_languages_are_learned(spark):
    """Of 130 languages the rarest as well; two words tell them apart."""
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(130)]
    rows = [(f"{w * 3} {w[::-1] * 4} " * (i + 1), f"l{k:03}") for k, w in enumerate(words) for i in range(1 + (k < 100))]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), columns=1 << 12)
    assert model["names"] == [f"l{k:03}" for k in range(130)]
    assert sum(language.predict(model, text)[0] == lang for text, lang in rows) > 0.9 * len(rows)


def test_language_weights_are_those_of_plain_descent(monkeypatch):
    """Follow-the-regularised-leader coordinate by coordinate, as published, on the same order of examples."""
    monkeypatch.setattr(language, "L1", 0.05)
    rng = np.random.default_rng(8)
    examples = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4), int(rng.integers(3))) for _ in range(60)]
    found = language.train(examples, 3, 12, epochs=2)
    z, n = [[0.0] * 3 for _ in range(13)], [[0.0] * 3 for _ in range(13)]

    def weight(i, k):
        if abs(z[i][k]) <= language.L1:
            return 0.0
        return -(z[i][k] - math.copysign(language.L1, z[i][k])) / ((language.BETA + math.sqrt(n[i][k])) / language.ALPHA + language.L2)

    order = np.random.default_rng(5)
    for _ in range(2):
        for e in order.permutation(60).tolist():
            at, value, label = [*examples[e][0].tolist(), 12], [*examples[e][1].tolist(), 1.0], examples[e][2]
            scores = [sum(v * weight(i, k) for i, v in zip(at, value, strict=True)) for k in range(3)]
            whole = sum(map(math.exp, scores))
            w = {(i, k): weight(i, k) for i in at for k in range(3)}
            for i, v in zip(at, value, strict=True):
                for k in range(3):
                    g = v * (math.exp(scores[k]) / whole - (k == label))
                    sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / language.ALPHA
                    z[i][k] += g - sigma * w[i, k]
                    n[i][k] += g * g
    assert np.allclose(found, [[weight(i, k) for k in range(3)] for i in range(13)], atol=1e-9)
    assert (found == 0).any() and (found != 0).any()


def test_language_predictions_are_plain(spark, odd):
    """Probabilities of a fitted model by sums over the n-grams of each text."""
    model = language.fit(odd.select("text", "lang"), columns=1 << 10)
    for text in ("a b c", "é word", "word " * 30000):
        found = language.counts(text, 1 << 10)
        value = {c: (1 + math.log(n)) * model["idf"][c] for c, n in enumerate(found.tolist()) if n}
        norm = math.sqrt(sum(v * v for v in value.values()))
        s = [(sum(v / norm * model["weights"][c, k] for c, v in value.items()) + model["weights"][-1, k]) / model["temperature"] for k in range(len(model["names"]))]
        p = [math.exp(x - max(s)) for x in s]
        best = p.index(max(p))
        got = language.predict(model, text)
        assert got[0] == model["names"][best] and abs(got[1] - p[best] / sum(p)) < 1e-9


def test_a_sample_of_few_bytes_has_all_languages(spark):
    from firmlake.llm.sampling import within_bytes

    rows = spark.createDataFrame([("x" * (10 + k), f"l{k % 7}") for k in range(70)] + [("y" * 5000, "long")], "text string, lang string")
    held = within_bytes(rows, "text", 8 * 200, "lang").collect()
    assert {r.lang for r in held} == {f"l{k}" for k in range(7)} | {"long"}
    assert all(sum(len(r.text) for r in held if r.lang == f"l{k}") <= 200 for k in range(7))
    some = within_bytes(rows, "text", 6400).collect()
    assert 0 < sum(len(r.text) for r in some) <= 6400 and some == within_bytes(rows, "text", 6400).collect()
    assert within_bytes(rows.where("false"), "text", 100).count() == 0


def test_scores(spark, odd):
    df = odd.select("doc_id", "text")
    rows = df.collect()
    tally = Counter()
    for r in rows:
        if zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 10:
            tally.update((r.text or "").encode().lower().split())
            tally[None] += 1
    n, v = sum(tally.values()), len(tally)
    from firmlake.llm.common import crc_mod

    for frequent in (0, 100):
        got = defaultdict(list)
        for r in scoring.score(df, crc_mod("doc_id", 10) != 0, frequent=frequent).collect():
            got[r.doc_id].append(r)
        for r in rows:
            words = [*(r.text or "").encode().lower().split(), None]
            base = sum(math.log10((tally[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
            for g in got[r.doc_id]:
                assert (g.n_tokens, g.n_known, g.train_tokens) == (len(words), sum(tally[w] > 0 for w in words), n)
                assert abs(g.base_score - base) < 1e-6 * abs(base) and g.score < 0
    assert scoring.score(df.where("false"), F.lit(True)).count() == 0
    assert scoring.score(df, F.lit(False)).count() == 10


def test_partial_matching():
    docs, depth = ["the cat sat on the mat", "the dog sat", "a cat and a dog", ""], scoring.DEPTH
    codes = np.concatenate([scoring.sequences(scoring.framed(d)) for d in docs])
    deep = np.unique(codes, return_counts=True)
    short = np.unique(codes & ((1 << 8 * depth) - 1), return_counts=True)
    trie = scoring.Trie(*((c, n.astype(float)) for c, n in (short, deep)))
    after = defaultdict(Counter)
    for d in docs:
        b = scoring.framed(d)
        for i in range(depth, len(b)):
            for k in range(depth + 1):
                after[bytes(b[i - k : i])][b[i]] += 1

    def probability(context, symbol):
        k, seen, left = depth, set(), 1.0
        while k and bytes(context[-k:]) not in after:
            k -= 1
        p = np.zeros(256)
        for j in range(k, -1, -1):
            counts = {s: n for s, n in after[bytes(context[len(context) - j :])].items() if s not in seen}
            if counts:
                whole = sum(counts.values()) + len(counts)
                for s, n in counts.items():
                    p[s] = left * n / whole
                left *= len(counts) / whole
                seen |= set(counts)
        rest = [s for s in range(256) if s not in seen]
        p[rest] = left / len(rest)
        assert abs(p.sum() - 1) < 1e-9
        return p[symbol]

    for d in [*docs, "zebra the cät", "the the the mat on"]:
        b = scoring.framed(d)
        want = sum(math.log10(probability(b[i - depth : i], b[i])) for i in range(depth, len(b)))
        assert abs(trie.score(b) - want) < 1e-4


def test_scores_use_all_contexts(spark):
    """However few contexts are sent to the tasks, a score is that of the trie of all counts; some contexts occur in scored texts only."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    training, depth = F.col("doc_id") % 3 != 0, scoring.DEPTH
    texts = {r.doc_id: r.text for r in docs.collect()}
    codes = np.concatenate([scoring.sequences(scoring.framed(t)) for k, t in texts.items() if k % 3])
    deep = np.unique(codes, return_counts=True)
    short = np.unique(codes & ((1 << 8 * depth) - 1), return_counts=True)
    trie = scoring.Trie(*((c, n.astype(float)) for c, n in (short, deep)))
    for contexts in (1, 500, 1 << 20):
        got = {r.doc_id: r.score for r in scoring.score(docs, training, contexts=contexts).collect()}
        assert got.keys() == texts.keys()
        assert all(abs(got[k] - trie.score(scoring.framed(t))) < 1e-3 for k, t in texts.items())


def plain(model, texts):
    """Scores word by word: every filter at every word, the words behind the end being zero."""
    for text in texts:
        words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text.lower()).split()
        rows = [model.embeddings[zlib.crc32(w.encode()) % toxicity.BUCKETS] + model.embeddings[zlib.crc32(w.encode()[:5], 1) % toxicity.BUCKETS] for w in words]
        size = model.embeddings.shape[1]
        rows += [np.zeros(size)] * (2 + (not words))
        logit = model.out_bias
        for k, kernel in enumerate(model.kernels):
            for f in range(kernel.shape[2]):
                peak = max(sum(float(rows[i + j] @ kernel[j, :, f]) for j in range(len(kernel))) for i in range(len(rows) - 2))
                logit += max(peak + model.bias[k, f], 0) * model.out[k * kernel.shape[2] + f]
        got, language = model.logit(text)
        assert abs(got - logit) < 1e-3 * max(1, abs(logit))
        assert abs(toxicity.forward(model, *toxicity.hashed(text)) - logit) < 1e-6 * max(1, abs(logit))
        assert abs(model.score(text) - 1 / (1 + math.exp(model.thresholds[language] - got))) < 1e-9
    assert sum(len(t.split()) for t in texts) > 2 * toxicity.WINDOW  # the longest takes several windows


def test_toxicity(spark, odd):
    rng = np.random.default_rng(1)
    bad, words = ["idiot", "trash", "scum"], [f"w{k}" for k in range(400)]
    rows = []
    for k in range(900):
        text = list(rng.choice(words, 60))
        if k % 5 == 0:
            for _ in range(3):
                text.insert(int(rng.integers(60)), str(rng.choice(bad)) + str(rng.choice(["", "!", "."])))
        rows.append((k, " ".join(text), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 AS int) AS toxic")
    model = toxicity.fit(toxicity.training_rows(docs), labels)
    held = toxicity.scored(docs, model).where("held_out").collect()
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)
    plain(model, ["", "idiot", "w1 Idiot! w2 trash", "é", " ".join(r[1] for r in rows) + " scum"])
    assert toxicity.scored(odd, model).count() == 10 and toxicity.accepted(odd, model).columns == odd.columns
    none = toxicity.fit(odd.select("doc_id", "text", "lang"), labels.where("false"))
    assert {r.predicted for r in toxicity.scored(odd, none).collect()} == {0}


def test_toxicity_learns_from_all_labelled_texts(spark):
    """However many and long they are; shards and reruns on other partitions give the same model."""
    rows = [(k, f"w{k % 50} v{k % 31} {'scum' if k % 2 else 'fine'} u{k}", "en") for k in range(4000)] + [(4001, "long words " * 60_000 + "scum", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    found = toxicity.encoded(docs, labels)
    assert found.count() == 4001 and found.selectExpr("max(octet_length(buckets))").first()[0] == 4 * 120_001
    models = [toxicity.fit(d, labels, shard_rows=800) for d in (docs, docs.repartition(7))]
    assert (models[0].embeddings == models[1].embeddings).all() and (models[0].thresholds == models[1].thresholds).all()
    assert sum((models[0].score(text) >= 0.5) == k % 2 for k, text, _ in rows[::50] + rows[-1:]) > 0.97 * 81


def test_toxicity_moves_buckets_of_labelled_documents_once(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('word', id % 700, ' some more') AS text", "'en' AS lang")
    docs = docs.union(spark.sql("SELECT CAST(null AS long), 'word1', 'en' UNION ALL SELECT 4, CAST(null AS string), 'en' UNION ALL SELECT 8, 'again', null"))
    marks = spark.range(0, 400, 4).selectExpr("id AS doc_id", "int(id % 8 = 0) AS toxic")
    want = sorted((r.doc_id, r.lang or "", toxicity.packed(r.text)) for r in docs.where("doc_id < 400 AND doc_id % 4 = 0 AND text IS NOT NULL").collect())
    found = toxicity.prepared(docs, marks)
    assert found.columns == ["doc_id", "lang", "buckets"]
    rows = sorted((r.doc_id, r.lang or "", bytes(r.buckets)) for r in found.collect())
    assert len(want) == 101 and set(want) <= set(rows) and len(rows) < 120
    other = toxicity.prepared(docs, marks.selectExpr("string(doc_id) AS doc_id", "toxic"))  # hashed differently, so nothing is left out
    assert other.count() == 2001

    plans, written = {}, toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or written(df, name))
    toxicity.fit(docs, marks, shard_rows=40)
    moved = [line for line in plans["labelled"].split("\n") if "Exchange" in line]
    assert moved and "Broadcast" not in "".join(moved) and plans["shards"].count("Exchange hash") == 1


def test_toxicity_sends_weights_to_the_driver_as_columns(spark, monkeypatch):
    """Averages are those of the shards' tables by how often a row was changed, and no weights come to the driver as row objects."""
    shards = spark.createDataFrame([(s, [(i, s, i % 2, toxicity.packed(f"w{i} w{i + s} same")) for i in range(6)]) for s in range(3)], "shard int, rows array<struct<k:long,j:long,toxic:int,buckets:binary>>").repartition(3)
    net, weight, kind, sizes = toxicity.Network(), np.ones(2), type(shards), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: sizes.append(len(rows := collect(df))) or rows)
    at, rows = toxicity.learned(shards, net, weight, 1, 5)
    toxicity.spoken_by(spark.createDataFrame([("en", toxicity.packed("a b c"))], "lang string, buckets binary"), ["en"])
    assert sizes == []
    n, sums = np.zeros(len(net.table()[0])), 0
    for s in range(3):
        own = net.learn([(toxicity.packed(f"w{i} w{i + s} same"), i % 2) for i in range(6)], weight, 1, 5_000_015 + s)
        times = np.append(own.touched, np.full(len(n) - len(own.touched), 6))
        n, sums = n + times, sums + np.concatenate(own.table(), 1) * times[:, None]
    assert sorted(at) == np.flatnonzero(n).tolist() and rows.dtype == np.float32
    assert np.allclose(rows, sums[at] / n[at, None], atol=1e-5)
    assert np.array_equal(net.averaged(at, rows).table()[0][at], rows[:, : toxicity.SIZE])
