import glob
import hashlib

import pytest

from firmlake.llm import media as M
from firmlake.llm.common import shared_dir


def test_png_round_trip():
    for text in ("", "x", "é" * 500, "a" * 192, "b" * 193):
        payload, n = M.padded(text)
        assert len(payload) % 192 == 0 and len(payload) >= 192 and n == len(text.encode())
        assert M.decoded(M.encoded(payload)) == payload
    damaged = bytearray(M.encoded(payload))
    damaged[60] ^= 1
    with pytest.raises(Exception):
        M.decoded(bytes(damaged))


def test_rows(odd):
    out = M.features(M.stored(odd)).collect()
    assert len(out) == 10
    by_text = {r.payload_sha256: (r.media_sha256, r.feature, r.tail_crc32) for r in out}
    assert all(by_text[r.payload_sha256] == (r.media_sha256, r.feature, r.tail_crc32) for r in out)
    assert sum(r.doc_id is None for r in out) == 1
    assert hashlib.sha256(b"word " * 5000 + b" " * 152).hexdigest() in by_text
    assert M.features(M.stored(odd.where("false"))).count() == 0


def test_ranges_and_damage(spark):
    folder = shared_dir(spark, "media-test")
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(cast(id AS string), 200) AS text").repartition(3)
    assert sum(r.members for r in M.write_archives(docs, folder, limit=20_000).collect()) == 300
    spark.dataSource.register(M.ArchiveSource)

    def read(**options):
        reader = spark.read.format("media_archive")
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.load(folder)

    for size in (1000, 7777, 1 << 20):  # each member is read once, whatever the ranges
        assert read(range=size).select("archive", "offset").distinct().count() == read(range=size).count() == 300
    path = sorted(glob.glob(M.filesystem(folder)[1] + "/*.zip"))[0]
    member = read().where(f"archive = '{path}'").orderBy("offset").first()
    with open(path, "r+b") as f:
        f.seek(member.offset + 30 + len(member.member) + 70)
        byte = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([byte[0] ^ 255]))
    rows = read(mode="permissive").collect()
    assert len(rows) == 300 and [r.member for r in rows if r.error] == [member.member]
    with pytest.raises(Exception, match="member"):
        read().collect()


def test_values_are_plain(spark, odd):
    """Every value of the query's rows, computed from the text by a version without archives or images."""
    import hashlib
    import math
    import zlib
    from collections import Counter

    rows = {}
    for r in M.features(M.stored(odd)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for d in odd.select("doc_id", "text").collect():
        data = (d.text or "").encode()
        size = max(192, math.ceil(len(data) / 192) * 192)
        payload = data.ljust(size, b" ")
        for r in rows[None if d.doc_id is None else str(d.doc_id)]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            image = M.encoded(payload)
            start = image.index(b"IDAT") + 4
            lines = zlib.decompress(image[start : start + int.from_bytes(image[start - 8 : start - 4], "big")])
            assert b"".join(lines[k + 1 : k + 193] for k in range(0, len(lines), 193)) == payload and not any(lines[::193])
            assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
            mean = sum(payload) / size
            std = math.sqrt(sum((b - mean) ** 2 for b in payload) / size)
            entropy = -sum(n / size * math.log2(n / size) for n in Counter(payload).values())
            parts = dict(p.split("=") for p in r.feature.split(";"))
            assert int(parts["rows"]) == size // 192 and all(abs(float(parts[k]) - v) < 1e-3 for k, v in (("mean", mean), ("std", std), ("entropy", entropy)))


def test_archives_outside_the_manifest_are_not_read(spark, odd):
    from pyspark.sql import functions as F

    df = M.stored(odd.select("doc_id", "text"))
    folder = M.filesystem(df.select(F.col("archive")).first().archive)[1].rsplit("/", 1)[0]
    some = sorted(glob.glob(folder + "/*.zip"))[0]
    with open(some, "rb") as f, open(some.replace(".zip", "-lost.zip"), "wb") as g:
        g.write(f.read())
    assert df.count() == odd.count()
