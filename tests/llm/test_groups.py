"""SimHash and embedding groups against all pairs."""

import numpy as np

from firmlake.llm import shingles, simhash, vectors
from firmlake.llm.components import components, local_roots


def test_components(spark):
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(500, 500), (7, 6)]
    nodes = sorted({x for e in edges for x in e})
    at = {n: k for k, n in enumerate(nodes)}
    root = local_roots(len(nodes), *(np.array([at[e[k]] for e in edges]) for k in (0, 1)))
    want = {n: nodes[root[k]] for n, k in at.items() if root[k] != k}
    for local in (0, 1000):
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), local=local).collect()}
        assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint(spark):
    for words in ("foo bar baz", "foo bar", "Foo  BAR\tbaz"):
        joined = " ".join(words.lower().split())
        assert simhash.signed(simhash.fingerprint(words)) == spark.sql(f"SELECT xxhash64('{joined}') AS h").first().h
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def test_fingerprint_of_many_words():
    """The vote of all shingles, bit by bit."""
    import xxhash

    rng = np.random.default_rng(6)
    for n, width in ((4, 3), (57, 3), (200, 5), (40_000, 3)):
        words = [str(w) for w in rng.choice(["Tick", "tock", "é", "x", "clock", "TICK"], n)]
        text = "  ".join(words) + "\n"
        low = [w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in words]
        shingles = [xxhash.xxh64_intdigest(" ".join(low[i : i + width]).encode(), 42) for i in range(n - width + 1)]
        want = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in shingles) > len(shingles))
        assert simhash.fingerprint(text, width) == want


def test_tree_parts_evenly():
    rng = np.random.default_rng(7)
    points = rng.integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64) << np.uint64(1)
    row, leaf, home = simhash.leaves(points, simhash.grown(points[:1024], 5), 2)
    sizes = np.bincount(leaf[home], minlength=32)
    assert len(row[home]) == 20_000 and sizes.max() < 4 * sizes.mean() and len(np.unique(simhash.grown(points[:1024], 5)[0])) > 5


def test_points(spark):
    rng = np.random.default_rng(1)
    points = [int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.int64)]
    for x in points[:150]:
        y = x
        for _ in range(int(rng.integers(1, 6))):
            for b in rng.choice(63, int(rng.integers(1, 4)), replace=False):
                y ^= 1 << int(b)
            points.append(y)
    points = np.array(sorted(set(points)), np.int64)
    near = np.bitwise_count(points.view(np.uint64)[:, None] ^ points.view(np.uint64)[None]) <= 2
    root = local_roots(len(points), *np.nonzero(near))
    want = {int(p): int(points[r]) for p, r in zip(points, root, strict=True) if p != points[r]}
    for levels in (0, 4, 8, 16):
        found = simhash.linked_points(spark.createDataFrame([(int(p),) for p in points], "fp long"), 2, levels)
        assert {r.node: r.root for r in found.collect()} == want


def test_odd_documents(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {3}
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 7)} == {0}
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 5, 6]
    assert simhash.near_duplicates(odd.where("false")).count() == 0 == simhash.deduplicated(odd.where("false")).count()


def all_pairs(rows):
    """(links, least id reachable) of each vector, by comparing every pair."""
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    return near.sum(1), local_roots(len(rows), *np.nonzero(near))


def vectors_near(rng, dim, n, spread):
    """Vectors of which most are near another, by very different distances; some are the same."""
    base = rng.normal(size=(n, dim))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    for k in range(n, 2 * n):
        v = base[k % (n // 3)] + rng.normal(size=dim) * rng.choice(spread)
        rows.append((k, [float(x) for x in v * rng.choice([1, 3])]))
    return rows


def test_vectors(spark):
    rows = vectors_near(np.random.default_rng(3), 24, 120, [0, 0.1, 0.25, 0.35])
    links, root = all_pairs(rows)
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] + [1.0] * 23), (904, [1.0]), (905, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    for k in range(len(rows)):
        assert got[k] == (int(links[k]), int(root[k]), bool(root[k] == k))
    assert all(got[k][:2] == (0, k) for k, _ in odd)
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_vectors_however_they_are_dealt(spark):
    """Trees as deep as leaves of a few vectors, and shards cut into tiles; with clashing columns and repeated ids."""
    rows = vectors_near(np.random.default_rng(4), 64, 500, [0.05, 0.15, 0.2, 0.25, 0.3])
    links, root = all_pairs([(k, np.array(v, np.float32)) for k, v in rows])
    df = spark.createDataFrame([(k, v, 1, "x", 2) for k, v in rows], "vec_id long, embedding array<float>, node long, key string, copies int").repartition(3)
    want = {k: (int(links[k]), int(root[k])) for k, _ in rows}
    for shard, deepest, tiles in ((1 << 22, 12, None), (64 * 4, 12, None), (64 * 30, 2, 3), (64 * 200, 12, 1)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, shard=shard, deepest=deepest, tiles=tiles).collect()}
        assert got == want, (shard, deepest, tiles)
    twice = vectors.near_duplicates(df.union(df.where("vec_id < 3"))).where("vec_id = 0").collect()
    x = np.array([rows[k][1] for k in range(3)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert [r.n_links for r in twice] == [int(links[0]) + int((x[0] @ x.T >= 0.95).sum())] * 2


def test_leaves_hold_all_that_is_near():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    tree = vectors.grown(x[:500], 7)
    row, leaf, home = vectors.leaves(x, tree, 0.5)
    own = dict(zip(row[home].tolist(), leaf[home].tolist(), strict=True))
    asked = set(zip(row.tolist(), leaf.tolist(), strict=True))
    assert len(own) == 3000 and len(asked) == len(row) < 3000 * 100
    d = ((x[:200, None] - x[None]) ** 2).sum(2)
    assert all((i, own[j]) in asked for i, j in zip(*(k.tolist() for k in np.nonzero(d <= 0.5)), strict=True))


def test_deduplicated_by_similarity(spark, odd, monkeypatch):
    """Against all pairs; leader by leader and in one step."""
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for size in (8, 40, 90, 200):
        for _ in range(6):
            base = [str(w) for w in rng.integers(0, 5000, size)]
            passage = [str(w) for w in range(size)]
            for k in range(6):
                words = list(base)
                for at in rng.choice(size, k * size // 150 + (k == 5), replace=False):
                    words[int(at)] = "x" + str(n)
                rows.append((n, " ".join(words)))
                n += 1
            rows.append((n, " ".join(passage + base)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, rows[3][1].upper()), (n + 3, "a b"), (n + 4, "a b c")]
    sets = {i: {w[k : k + 5] for w in [tuple((t or "").lower().split())] for k in range(max(1, len(w) - 4))} - {()} for i, t in rows}
    prints = {i: simhash.fingerprint(t, 5) for i, t in rows}
    ids = list(sets)
    a, b = np.array([(i, j) for i in ids for j in ids if i < j and ((prints[i] ^ prints[j]).bit_count() <= 2 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]).T
    root = local_roots(len(ids), a, b)
    want = sorted(int(i) for i in np.unique(root))
    far = [(i, j) for i, j in zip(a, b, strict=True) if (prints[i] ^ prints[j]).bit_count() > 2]
    assert len(far) > 20 and 30 < len(want) < len(ids) - 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (shingles.PAIRS, 0):
        monkeypatch.setattr(shingles.links, "__defaults__", (most,))
        got = simhash.deduplicated(docs, width=5, percent=80)
        assert sorted(r.doc_id for r in got.collect()) == want
    kept = simhash.deduplicated(odd, width=5, percent=80)
    assert kept.columns == odd.columns and kept.count() == 4
    assert simhash.deduplicated(odd.limit(0), width=5, percent=80).count() == 0


def test_sets_joined_against_all_pairs():
    rng = np.random.default_rng(11)
    for _ in range(20):
        base = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(5)]
        sets = []
        for _ in range(int(rng.integers(1, 50))):
            one = base[int(rng.integers(0, 5))].copy()
            k = int(rng.integers(0, 1 + len(one) // 4))
            one[rng.choice(len(one), k, replace=False)] = rng.integers(0, 1000, k)
            sets.append(np.unique(one).astype(np.uint64))
        names, own = np.unique(rng.integers(-50, 50, len(sets)) * 1000003, return_inverse=True)
        for percent in (50, 80, 100):
            met = [(own[i], own[j]) for i in range(len(sets)) for j in range(i) if shingles.alike(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), percent)]
            root = local_roots(len(names), *np.array(met, int).reshape(-1, 2).T)
            a, b = shingles.joined(sets, names[own], percent)
            assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {int(names[k]): int(names[r]) for k, r in enumerate(root) if k != r}


def test_no_table_of_pairs(spark, monkeypatch):
    """Texts that share bands but aren't alike: no table grows with the square of their number."""
    common, rows = [f"c{k}" for k in range(60)], []
    for k in range(150):
        rows.append((k, " ".join(common + [f"x{k}y{j}" for j in range(20)])))
    made = []

    def counting(df, name, *rest):
        out = plain(df, name, *rest)
        made.append((name, out.count()))
        return out

    plain = shingles.written
    monkeypatch.setattr(shingles, "written", counting)
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), width=5, percent=80)
    assert kept.count() == len(rows) and dict(made)["sids"] == 150
    assert max(n for _, n in made) < 30 * 150
