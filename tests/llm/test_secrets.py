import random
import re

from firmlake.llm import secrets as S


def plain(text):
    found = [(m.start(), "assign", m.end()) for m in re.finditer(S.ASSIGN.pattern.decode(), text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], S.KINDS.index(s[1])))


def test_base_spans():
    auto, rng = S.automaton(), random.Random(1)
    parts = ["abcdef0123456789", "abcdef0123456789abcdef01", "a", "9", "g", "é", " ", "token=", 'Password: "', "ſecret=", "apiKey=abcdef", "AKIA", "ABCDEFGHIJKLMNOPQRST", "\n", "passwd:"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [s for s in S.scan(text, auto) if s[1] in S.KINDS[:3]] == plain(text), text


def test_checksums():
    auto = S.automaton()
    body = b"A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"ghp_{body.decode()}{S.base62_crc(body).decode()}"
    assert ("github") in [k for _, k, _ in S.scan(f"x {good} y", auto)]
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert "github" not in [k for _, k, _ in S.scan(bad, auto)]
    assert S.redact("é token=abcdefg.", S.scan("é token=abcdefg.", auto)) == "é [assign]"


def test_rows(spark, odd):
    rows = S.find_secrets(odd).collect()
    assert len(rows) == 10 and all(not r.spans for r in rows)
    df = spark.createDataFrame([(1, "key password=hunter22!", 21, "m"), (2, "nothing", 99, None)], "doc_id long, text string, n_chars long, _masked string")
    out = S.clean(df).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars, r._masked) for r in out] == [("key [assign]!", 13, "m"), ("nothing", 99, None)]
    assert S.clean(odd).columns == odd.columns and S.clean(odd.where("false")).count() == 0
