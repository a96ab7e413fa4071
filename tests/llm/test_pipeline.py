import hashlib
import re

import corpus_pipeline
from firmlake.llm import mixing, pieces, secrets, simhash

DATA = "/root/testdata/sf0.001"


def shingle_set(text):
    words = re.sub(r"[A-Z]+", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark):
    """Each stage on what the one before it kept, against a plain version where there is one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "secrets", "mixing", "pieces"]
    kept = corpus_pipeline.toxicity(spark, docs, DATA).cache()
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() <= docs.count()

    one = corpus_pipeline.simhash(spark, kept, DATA).cache()
    prints = {r.doc_id: simhash.fingerprint(r.text, 5) for r in kept.collect()}
    runs = {r.doc_id: shingle_set(r.text) for r in kept.collect()}
    root = {i: i for i in prints}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and ((prints[a] ^ prints[b]).bit_count() <= 2 or 5 * len(runs[a] & runs[b]) >= 4 * len(runs[a] | runs[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i in ids if find(i) == i)

    clean = corpus_pipeline.secrets(spark, one, DATA).cache()
    auto = secrets.automaton()
    texts = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        assert r.text == secrets.redact(texts[r.doc_id], secrets.scan(texts[r.doc_id], auto))

    mixed = corpus_pipeline.mixing(spark, clean, DATA).cache()
    times = {r.doc_id: r._copies for r in mixing.copies(clean).collect()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in times.items() if v} and mixed.columns == docs.columns

    last = corpus_pipeline.pieces(spark, mixed, DATA).collect()
    model = pieces.loaded(pieces.model_path())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in last[:40]:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, model.encode(texts[r.doc_id]))).encode()).hexdigest()
    assert len(last) == mixed.count()


def test_run(spark):
    rows = [tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert rows and sorted(rows) == sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect())
