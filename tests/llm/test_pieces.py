import random

import pytest

from firmlake.llm.pieces import Pieces, digests, encoded, model_path


@pytest.fixture(scope="module")
def both():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = model_path()
    with open(path, "rb") as f:
        return Pieces(f.read()), sentencepiece.SentencePieceProcessor(model_file=path)


def test_same_as_the_library(both):
    ours, theirs = both
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "é", "日本", "😀", "\t", "▁", "\x02", "\x03", "\x00", "ing", "tion", "THE", "0", "12", "   ", " ", "ﬁ", "<s>", "<0x0A>", "ß", ".", "\r\n", "a" * 30, " " * 40, "Entwicklung", "antidisestablishmentarianism"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        ids = ours.encode(text)
        assert ids == theirs.encode(text), text
        assert ours.both(text)[1] == theirs.decode(ids) == ours.decode(ids), text


def test_real_texts(spark, both):
    ours, theirs = both
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in encoded(rows).collect():
        assert list(r.ids) == theirs.encode(texts[r.doc_id]) and r.decoded == theirs.decode(list(r.ids))


def test_odd_rows(odd):
    rows = digests(odd).collect()
    assert len(rows) == 10 and {r.n_tokens for r in rows if r.doc_id is None} == {0}
    assert digests(odd.where("false")).count() == 0
