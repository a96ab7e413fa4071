from pyspark.sql import functions as F

from firmlake.errors import CorpusMissing
from firmlake.operators import canon
from firmlake.operators.corpus import Corpus, listing
from firmlake.plans import symbols as S
from firmlake.sources import elf, export, harvest
from firmlake.streaming.ingest import ingest
from tests import fixtures as X
import pytest
import struct

LEAF = bytes.fromhex("3641001df0000000")
OTHER = bytes.fromhex("3641000c121df000")  # entry, movi.n, retw.n


def program_with_symbols(functions):
    """A linked program: .text at 0x40080000 and a symbol table, by hand."""
    text, symbols, names = b"", b"\0" * 16, b"\0"
    for name, body, size in functions:
        symbols += struct.pack("<IIIBBH", len(names), 0x40080000 + len(text), size, 0x12, 0, 1)
        names += name.encode() + b"\0"
        text += body
    sections = [("", b"", 0, 0, 0, 0, 0), (".text", text, 1, 6, 0x40080000, 0, 0), (".symtab", symbols, 2, 0, 0, 3, 16), (".strtab", names, 3, 0, 0, 0, 0)]
    strings = b"\0" + b"".join(s[0].encode() + b"\0" for s in sections[1:]) + b".shstrtab\0"
    sections.append((".shstrtab", strings, 3, 0, 0, 0, 0))
    body, heads, at = b"", b"", 52
    for name, data, kind, flags, addr, link, step in sections:
        heads += struct.pack("<10I", strings.find(name.encode() + b"\0") if name else 0, kind, flags, addr, at if data else 0, len(data), link, 0, 1, step)
        body += data
        at += len(data)
    return struct.pack("<16sHHIIIIIHHHHHH", b"\x7fELF\x01\x01\x01", 2, 94, 1, 0x40080000, 0, at, 0, 52, 0, 0, 40, len(sections), len(sections) - 1) + body + heads


def build(spark, corpus, functions, config="CONFIG_A=y", version="v5.4"):
    files = spark.createDataFrame([("app/x.elf", bytearray(program_with_symbols(functions)))], "path string, content binary")
    found = harvest.signatures(harvest.harvested(files)).withColumn("build_key", F.lit("b"))
    about = spark.createDataFrame([("b", version, "default", config, "esp32", "gcc", canon.VERSION, None)], "build_key string, idf_version string, config_name string, config_text string, chip string, toolchain string, canon_version int, objdump_version string")
    corpus.add(about, found)


def test_symbols(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    with pytest.raises(CorpusMissing):
        corpus.current("esp32", canon.VERSION)
    build(spark, corpus, [("leaf", LEAF, 5), ("other", OTHER, 7)])
    build(spark, corpus, [("leaf", LEAF, 5)], config="# note\nCONFIG_A=y\n")  # the same build again: replaced
    assert corpus.builds().count() == 1 and [r.name for r in corpus.functions().collect()] == ["leaf"]
    build(spark, corpus, [("leaf", LEAF, 5)], version="v5.5")
    rows = listing(corpus.builds(), corpus.functions(), canon.VERSION).collect()
    assert [(r.idf_version, r.linked, r.stale, r.warnings) for r in rows] == [("v5.4", 1, False, []), ("v5.5", 1, False, [])]

    data = X.image(code=LEAF + OTHER + bytes(48), entry=0x400D0020)
    files = spark.createDataFrame([("img", bytearray(data))], "path string, content binary")
    files = files.union(files.selectExpr("'copy' AS path", "content"))
    analysis = S.analysed(files, memo=f"file://{tmp_path}/memo")
    assert analysis["boundaries"].count() >= 2
    out = S.symbols(analysis, corpus, "esp32")
    found = out["identified"].collect()
    assert [(r.entry, r.name, r.confidence, len(r.source_ids)) for r in found] == [(0x400D0020, "leaf", 1.0, 2)]
    assert 0x400D0028 in [r.entry for r in out["unidentified"].collect()]
    cov = out["coverage"].first()
    assert cov.matched == 1 and cov.total == len(found) + out["unidentified"].count()

    assert any("70 %" in w for w in out["warnings"].first().warnings)

    one = export.elf_files(analysis["segments"]).first()
    sections = {s.name: s for s in elf.Elf(bytes(one.elf)).sections}
    assert sections[".flash.text"].data.startswith(LEAF) and sections[".flash.text"].addr == 0x400D0020
    assert '"command":"flash-info"' in export.envelope(analysis["parsed"].drop("image_id"), "flash-info").first().json

    which = corpus.select_one("v5.5")
    assert corpus.remove(which) == 1 and corpus.builds().count() == 2
    assert corpus.remove(which, dry=False) == 1 and corpus.builds().count() == 1
    assert corpus.collect_stale(canon.VERSION + 1) == (1, 1)
    assert corpus.collect_stale(canon.VERSION + 1, dry=False) == (1, 1) and corpus.builds().count() == 0


def test_rows_of_functions_do_not_grow_with_builds(spark, tmp_path):
    """Lists of a digest's builds and rivals stay out of what is kept a function, and join it whole where they are asked for."""
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    about = spark.range(30).selectExpr("concat('b', id) build_key", "concat('v', id % 3) idf_version", "'default' config_name", "string(id) config_text", "'esp32' chip", "'gcc' toolchain", f"{canon.VERSION} canon_version", "string(null) objdump_version")
    files = spark.createDataFrame([("img", bytearray(X.image(code=LEAF + OTHER + bytes(48), entry=0x400D0020)))], "path string, content binary")
    analysis = S.analysed(files, memo=f"file://{tmp_path}/memo")
    digest = analysis["forms"].where("fn LIKE '%:1074593824'").first().digest
    corpus.add(about, about.selectExpr("build_key", "concat('f', int(substr(build_key, 2)) % 5) name", "'linked' origin", f"'{digest}' digest"))
    out = S.symbols(analysis, corpus, "esp32")
    kept = [line for line in out["coverage"]._jdf.queryExecution().analyzed().toString().split("\n") if "LogicalRDD" in line]
    assert kept and not any(c in line for line in kept for c in ("source_ids", "signatures", "ambiguous_with"))
    found = out["identified"].collect()
    assert [(r.name, r.rivals, r.builds, len(r.ambiguous_with), len(r.source_ids), len(r.signatures)) for r in found] == [("f0", 4, 6, 4, 6, 30)]
    assert out["summary"].first().versions == 3


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(X.image())
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        (tmp_path / "in/b.bin").write_bytes(X.image())
        (tmp_path / "in/c.bin").write_bytes(X.dump())
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.input_kind for r in rows) == ["app_partition", "flash_dump"]


def test_named_edges(spark):
    caller = bytes.fromhex("3641004500001df0")  # entry, call0 to base + 8 from base + 3, retw.n
    files = spark.createDataFrame([("app/x.elf", bytearray(program_with_symbols([("caller", caller, 8), ("leaf", LEAF, 5)])))], "path string, content binary")
    rows = harvest.harvested(files)
    edges = {r.name: list(r.call_edges) for r in harvest.signatures(rows, names=harvest.function_names(files)).collect()}
    assert edges == {"caller": ["leaf"], "leaf": []}


def test_memo(spark, tmp_path):
    memo = f"file://{tmp_path}/memo"
    one = spark.createDataFrame([("a", bytearray(X.image(code=LEAF + bytes(56))))], "path string, content binary")
    two = one.union(spark.createDataFrame([("b", bytearray(X.image(code=LEAF * 2 + bytes(48))))], one.schema))
    assert S.remembered(one, memo).count() == 1
    assert S.remembered(two, memo).count() == 2 and spark.read.parquet(memo).count() == 2


def test_command_line(spark, tmp_path, capsys):
    from firmlake import __main__ as cli

    (tmp_path / "x.bin").write_bytes(X.image())
    assert cli.main(["--out", str(tmp_path / "json"), "flash-info", str(tmp_path / "x.bin")]) == 0
    assert '"chip":"esp32"' in spark.read.text(str(tmp_path / "json")).first().value
    assert cli.main(["--data", str(tmp_path), "symbols", str(tmp_path / "x.bin")]) == 6
    assert cli.main(["--data", str(tmp_path), "corpus", "gc"]) == 0


def test_command_line_from_artifacts_to_report(spark, tmp_path, capsys):
    from firmlake import __main__ as cli
    from firmlake.sources import synthetic

    for key, chip in ((1, "esp32"), (2, "esp32")):
        for path, content in synthetic.build(key):
            target = tmp_path / f"art{key}" / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(content)
    (tmp_path / "art1/objdump_version.txt").write_text("GNU objdump (crosstool-NG esp-13.2.0) 2.41\nmore\n")
    (tmp_path / "art1/sdkconfig.out").write_text("CONFIG_A=y\n")
    (tmp_path / "art1/bundled_idf.txt").write_text("ESP_IDF_VERSION_MAJOR=5\nESP_IDF_VERSION_MINOR=4\n")
    (tmp_path / "art1/arduino-libs.txt").write_text("Name Version Location\nWi Fi 1.2 user\nX 3 user\n")
    (tmp_path / "art1/stray.elf").write_bytes(b"not below app")
    data = ["--data", str(tmp_path / "data")]
    assert cli.main([*data, "corpus", "ingest", str(tmp_path / "art1")]) == 0
    assert "warning" not in capsys.readouterr().out
    assert cli.main([*data, "corpus", "ingest", str(tmp_path / "art2")]) == 7  # no version
    assert cli.main([*data, "corpus", "ingest", str(tmp_path / "art2"), "--version", "v9"]) == 0
    assert "no resolved configuration" in capsys.readouterr().out
    corpus = Corpus(spark, f"{tmp_path}/data/corpus")
    rows = {r.idf_version: r for r in corpus.builds().collect()}
    assert (rows["v5.4.0"].toolchain, rows["v9"].toolchain) == ("esp-13.2.0/binutils-2.41", "unknown")
    assert rows["v5.4.0"].config_text == "CONFIG_A=y\n\nlibrary Wi Fi@1.2\nlibrary X@3"
    (tmp_path / "x.bin").write_bytes(synthetic.image(b"text", 6))
    assert cli.main([*data, "symbols", str(tmp_path / "x.bin")]) == 0
    text = capsys.readouterr().out
    for part in ("matched: 3 of 7 functions (42.9%)", "0x400d0020", "open_1 (+1 ambiguous name(s))", "by version:", "[", "unidentified:", "warning: less than half"):
        assert part in text, part
    listing = tmp_path / "l.txt"
    listing.write_text("400d0020:\t004136        \tentry\ta1, 32\n400d0023:\tf01d  \tretw.n\n")
    assert cli.main([*data, "symbols", str(tmp_path / "x.bin"), "--listing", str(listing)]) == 0
    assert "matched: 1 of 1 functions" in capsys.readouterr().out
    assert cli.main([*data, "corpus", "rm", "--version", "v9", "--chip", "esp32s3", "--yes"]) == 7
    assert cli.main([*data, "corpus", "rm", "--version", "v9", "--chip", "esp32", "--yes"]) == 0 and corpus.builds().count() == 1
    assert cli.main([*data, "symbols", str(tmp_path / "x.bin"), "--chip", "esp32s2"]) == 6


def test_a_failed_write_leaves_the_build(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    build(spark, corpus, [("leaf", LEAF, 5)])
    broken = spark.createDataFrame([("b", "f")], "build_key string, name string").withColumn("size", F.raise_error(F.lit("lost")).cast("long"))
    about = spark.createDataFrame([("b", "v5.4", "default", "CONFIG_A=y", "esp32", "gcc", canon.VERSION, None)], "build_key string, idf_version string, config_name string, config_text string, chip string, toolchain string, canon_version int, objdump_version string")
    with pytest.raises(Exception, match="lost"):
        corpus.add(about, broken)
    assert [r.name for r in corpus.functions().collect()] == ["leaf"] and corpus.builds().count() == 1


def test_sqlite_import(spark, tmp_path):
    import sqlite3

    from firmlake.sources import sqlite_corpus

    path = str(tmp_path / "c.sqlite")
    c = sqlite3.connect(path)
    kinds = {"string": "TEXT", "long": "INTEGER", "int": "INTEGER"}
    for table, (_, schema) in sqlite_corpus.TABLES.items():
        c.execute(f"CREATE TABLE {table} ({', '.join(f'{n} {kinds[k]}' for n, k in (x.split() for x in schema.split(', ')))})")
    for k in (1, 2, 9):
        c.execute("INSERT INTO builds VALUES (?, 'v5', 'h', 'esp32', 'gcc', ?, 'A=y', 3, NULL, 't')", (k, f"c{k}"))
        c.execute("INSERT INTO functions VALUES (?, 'f', NULL, NULL, 'linked', 4, 5, 2, 'd', 'ret', 'ret', '[\"CALL\"]', '[1, 2]', '[]', 0, 0, 'call0', '[]')", (k,))
    c.commit()
    c.close()
    builds, functions = sqlite_corpus.read(spark, path)
    assert builds.count() == 3
    rows = functions.orderBy("build_key").collect()
    assert [(r.build_key, list(r.literals), list(r.call_edges)) for r in rows] == [(str(k), [1, 2], ["CALL"]) for k in (1, 2, 9)]


def test_many_builds_in_few_files(spark, tmp_path):
    """Files don't grow with builds; one of many is replaced, removed or collected, the others stay; folders of earlier versions are read."""
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    about = spark.range(300).selectExpr("concat('b', id) build_key", "concat('v', id) idf_version", "'default' config_name", "'' config_text", "'esp32' chip", "'gcc' toolchain", f"if(id % 2 = 0, {canon.VERSION}, 2) canon_version", "string(null) objdump_version")
    found = spark.range(600).selectExpr("concat('b', id % 300) build_key", "concat('f', id) name", "id size", "string(id) digest")
    corpus.add(about, found)
    files = len(list((tmp_path / "corpus").rglob("*.parquet")))
    assert files < 60 and corpus.builds().count() == 300 and corpus.functions().count() == 600
    corpus.add(about.where("build_key = 'b4'"), found.where("name = 'f4'"))
    assert corpus.builds().count() == 300 and corpus.functions().count() == 599
    assert corpus.remove(corpus.select_one("v6"), dry=False) == 2
    assert corpus.builds().count() == 299 and sorted(r.name for r in corpus.functions().where("name IN ('f4', 'f304', 'f6', 'f306', 'f8')").collect()) == ["f4", "f8"]
    assert corpus.collect_stale(canon.VERSION, dry=False) == (150, 300) and corpus.builds().count() == 149 and corpus.functions().count() == 297
    old = Corpus(spark, f"file://{tmp_path}/old")
    for name, rows in (("builds", corpus.builds()), ("functions", corpus.functions())):
        rows.where("pmod(build_id, 20) = 0").write.partitionBy("chip", "canon_version", "build_id").parquet(f"{tmp_path}/old/{name}")
    n = old.builds().count()
    version = old.builds().first().idf_version
    assert n and old.remove(old.select_one(version), dry=False) == 2 - (version == "v4") and old.builds().count() == n - 1
    old.add(about.where("canon_version <> 2"), found)
    assert old.builds().count() == 150 and old.functions().count() == 300


def test_files_are_harvested_once(spark, monkeypatch):
    """Forms take what is said of their functions along, and names are read once; what follows reads both from tables."""
    plans, settled = [], harvest.graph.settled
    monkeypatch.setattr(harvest.graph, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settled(df))
    files = spark.createDataFrame([("app/x.elf", bytearray(program_with_symbols([("leaf", LEAF, 5), ("other", OTHER, 7)])))], "path string, content binary")
    found = harvest.signatures(harvest.harvested(files), names=harvest.function_names(files))
    assert [p.count("MapInArrow") for p in plans] == [1, 1] and "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.name, r.origin, r.vaddr, r.component) for r in found.collect()} == {("app/x.elf", "leaf", "linked", 0x40080000, None), ("app/x.elf", "other", "linked", 0x40080008, None)}


def test_images_are_analysed_while_the_corpus_is_made(spark, monkeypatch):
    """Each waits for the other to have begun, and what either raises is raised."""
    from threading import Barrier

    from firmlake.plans import workload

    both = Barrier(2, timeout=20)
    monkeypatch.setattr(S, "analysed", lambda files, memo: both.wait() is None or {"parsed": spark.createDataFrame([("x", "p")], "image_id string, path string")})
    monkeypatch.setattr(workload, "_corpus", lambda *_: both.wait() is None or "corpus")
    monkeypatch.setattr(S, "symbols", lambda analysis, corpus: corpus)
    found, paths = workload._symbols(spark, "/root/testdata/sf0.001")
    assert found == "corpus" and [tuple(r) for r in paths.collect()] == [("x", "p")]
    monkeypatch.setattr(S, "analysed", lambda files, memo: both.wait() is None or {}["gone"])
    with pytest.raises(KeyError, match="gone"):
        workload._symbols(spark, "/root/testdata/sf0.001")


def test_bytes_of_images_move_once_to_their_recovery(spark):
    from firmlake.sources import recover

    rows = spark.createDataFrame([], "image_id string, entry_addr long, index int, load_addr long, executable boolean, region string, file_offset long, data binary")
    assert recover.recovered(rows)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_the_line_of_matches_is_that_of_the_report(spark):
    from firmlake.plans import report

    counts = [("a", 1, 3), ("b", 0, 1234), ("c", 1234, 1234)]
    found = spark.createDataFrame(counts, "image string, matched long, total long").select("image", report.matched_line().alias("line"))
    assert dict(found.collect()) == {"a": "matched: 1 of 3 functions (33.3%)", "b": "matched: 0 of 1,234 functions (0.0%)", "c": "matched: 1,234 of 1,234 functions (100.0%)"}
