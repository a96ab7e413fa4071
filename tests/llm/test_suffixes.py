import hashlib
import random

import numpy as np

from firmlake.llm import suffixes as S


def brute(docs):
    seen, out = set(), {}
    for key, text in sorted(docs):
        data = (text or "").encode()
        hit = bytearray(len(data))
        for j in range(len(data) - 99):
            w = data[j : j + 100]
            if w in seen:
                hit[j : j + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, h in zip(data, hit, strict=True) if not h)
        out[key] = (len(data), sum(hit), sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit)), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


def documents():
    rng = random.Random(4)
    parts = ["the ", "and ", "x", "quick brown ", "é", "  ", "\n"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))) for i in range(100)]
    shared = "".join(rng.choice("abcdefg ") for _ in range(400))
    for i in range(100, 180):
        a, b = sorted(rng.sample(range(401), 2))
        q = rng.choice(docs)[1]
        docs.append((i, q[: rng.randint(0, len(q))] + shared[a:b] * rng.choice([1, 1, 2]) + rng.choice(["a" * 150, "", q])))
    return docs


def test_brute_force(spark, monkeypatch):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs)
    assert result(S.removed(df)) == want
    monkeypatch.setattr(S, "BUCKET", 2000)  # many buckets
    for group in (4000, 3, 0):  # and groups too large for one place
        monkeypatch.setattr(S, "GROUP", group)
        assert result(S.removed(df)) == want


def test_only_bytes_make_windows_equal(monkeypatch):
    rng = random.Random(1)
    blocks = [bytes(rng.choice(b"ab") for _ in range(rng.randint(100, 140))) for _ in range(30)]
    blocks += [b[k:] + b for b, k in zip(blocks[:15], range(15), strict=True)]
    start = np.zeros(len(blocks), np.int64)
    seen, want = set(), set()
    for i, b in enumerate(blocks):
        for j in range(len(b) - 99):
            want |= {(i, j + k) for k in range(100)} if b[j : j + 100] in seen else set()
            seen.add(b[j : j + 100])
    for hashed in (S.mixed, lambda x: x & np.uint64(1)):  # and where hashes of all sorts of windows agree
        monkeypatch.setattr(S, "mixed", hashed)
        found = zip(*(x.tolist() for x in S.blocks_compared(blocks, start)), strict=True)
        assert {(i, k) for i, a, b in found for k in range(a, b)} == want


def test_order_of_suffixes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    places = rng.permutation(2960)
    order = S.multikey_order(S.keys_at(data, places, 5))
    suffixes = [data[p : p + 40].tobytes() for p in places[order].tolist()]
    assert suffixes == sorted(suffixes)


def test_pieces_of_long_texts(monkeypatch):
    data = np.frombuffer(("".join(t for _, t in documents()) * 2).encode(), np.uint8)
    whole = {(int(g), int(p - f)) for p, f, g in zip(*(S.chosen(data)[k] for k in (0, 1, 3)), strict=True)}
    monkeypatch.setattr(S, "PIECE", 500)
    places = set()
    for at, piece in S.pieces(data):
        place, first, last, gram, *_ = S.chosen(piece)
        places |= {w for f, e in zip(first, last, strict=True) for w in range(at + f, at + e + 1)}
        assert {int(g) for g in gram} <= {g for g, _ in whole}
    assert places == set(range(len(data) - 99))


def test_odd_rows(odd, spark):
    rows = S.removed(spark.createDataFrame([((1 << 63) - 1, "x")], "doc_id long, text string")).collect()
    assert [r.doc_id for r in rows] == [(1 << 63) - 1]
    rows = S.removed(odd).collect()
    assert len(rows) == 10 and sum(r.doc_id is None for r in rows) == 1
    assert {len(r.kept) for r in rows if r.n_bytes == 25000} == {5}
    assert S.removed(odd.where("false")).count() == 0
