import struct

from firmlake.sources import decode, recover

BASE = 0x40080000
LEAF = bytes.fromhex("3641001df0")


def recovered(data, *more, entry=None):
    places = recover.Places([(BASE, data, True, "iram", 0), *more]).explore(entry)
    bodies, rejected = places.bodies()
    return places, {b["entry"] - BASE: b for b in bodies.rows()}, rejected


def test_prologue_scan_and_wrong_register():
    _, found, _ = recovered(LEAF)
    assert list(found) == [0] and found[0]["origins"] == ["prologue_scan"] and found[0]["size"] == 5
    _, found, rejected = recovered(bytes.fromhex("364b001df0"))
    assert not found and rejected == 1


def test_padding_parts_functions():
    _, found, _ = recovered(LEAF + bytes(3) + LEAF)
    assert {k: v["size"] for k, v in found.items()} == {0: 5, 8: 5}
    _, found, _ = recovered(LEAF + bytes(67))
    assert found[0]["span_end"] == BASE + 5
    _, found, _ = recovered(bytes.fromhex("364100") + bytes(17) + LEAF)
    assert found[0]["size"] <= 5 and 20 in found


def test_calls_and_pointers_seed():
    _, found, _ = recovered(bytes.fromhex("3641004500001df00df0"))
    assert "direct_call" in found[8]["origins"] and found[0]["callees"] == [BASE + 8]
    _, found, _ = recovered(LEAF + bytes(3) + LEAF, (0x3FFB0000, struct.pack("<I", BASE + 8), False, "dram", 64))
    assert "pointer" in found[8]["origins"]


def test_reached_is_the_sum_of_ranges():
    _, found, _ = recovered(LEAF, entry=BASE)
    f = found[0]
    assert f["reached"] == sum(r["end"] - r["start"] for r in f["ranges"]) == f["size"] and "image_entry" in f["origins"]


def test_decoder():
    i = decode.builtin(BASE + 3, bytes.fromhex("450000"))[0]
    assert (i["mnemonic"], i["target"], i["cls"]) == ("call0", BASE + 8, "call")
    assert [x["mnemonic"] for x in decode.builtin(0, bytes.fromhex("3641001df00df03df0"))] == ["entry", "retw.n", "ret.n", "nop.n"]
    assert decode.builtin(0, bytes.fromhex("364100"))[0]["operands"] == ["a1", "32"]
    assert [x["cls"] for x in decode.builtin(0, b"\x04\xff")] == ["data", "data"]
    sizes = sum(x["size"] for x in decode.builtin(0, bytes(range(256)) * 4))
    assert sizes == 1024


def test_c_string():
    assert decode.c_string(b"hello world\0", 0) == "hello world"
    assert decode.c_string(b"hey\0", 0) is None and decode.c_string(b"no end here", 0) is None and decode.c_string(b"bad\x01char\0", 0) is None


def test_grouped(spark):
    rows = [("i", BASE, 0, BASE, True, "iram", 0, bytearray(LEAF + bytes(3) + LEAF)), ("j", None, 0, BASE, True, "iram", 0, bytearray(LEAF))]
    df = recover.recovered(spark.createDataFrame(rows, "image_id string, entry_addr long, index int, load_addr long, executable boolean, region string, file_offset long, data binary")).cache()
    found = recover.boundaries(df)
    assert {(r.image_id, r.entry - BASE): r.confidence for r in found.collect()} == {("i", 0): "high", ("i", 8): "high", ("j", 0): "high"}
    assert recover.instructions(df).count() == 6
    stats = recover.statistics(found, spark.createDataFrame([("i", True, 13), ("j", True, 5)], "image_id string, executable boolean, length long"))
    assert {r.image_id: (r.total, r.windowed_prologues, r.bytes_executable) for r in stats.collect()} == {"i": (2, 2, 13), "j": (1, 1, 5)}


def test_listing(spark):
    lines = ["40080000:\t004136        \tentry\ta1, 32", "40080003:\t000045\tcall0\t0x40080008 <fn>", "40080006:\tffff81\tl32r\ta8, 0x40007c50 (0x3ffae014)", "40080009:\tf01d\tretw.n", "Disassembly of section .text:"]
    rows = decode.read_listing(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("addr").collect()
    assert [(r.mnemonic, r.size, r.cls) for r in rows] == [("entry", 3, "entry"), ("call0", 3, "call"), ("l32r", 3, "literal_load"), ("retw.n", 2, "return")]
    assert bytes(rows[0].raw) == bytes.fromhex("364100") and rows[0].operands == ["a1", "32"]
    assert (rows[1].target, rows[1].target_symbol, rows[1].operands) == (0x40080008, "fn", ["0x40080008"])
    assert (rows[2].target, rows[2].literal_value, rows[2].operands) == (0x40007C50, 0x3FFAE014, ["a8", "0x40007c50"])


def word(value, size=3):
    return value.to_bytes(size, "little")


def call0(at, to):
    return word(5 | ((to - (at & ~3) - 4) // 4 & 0x3FFFF) << 6)


def l32r(reg, at, to):
    return word(1 | reg << 4 | ((to - (at + 3 & ~3)) // 4 & 0xFFFF) << 8)


def test_immediate_branches_stand_for_constants():
    signed = [-1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 32, 64, 128, 256]
    unsigned = [32768, 65536, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 32, 64, 128, 256]
    for name, low, table in (("beqi", 0x26, signed), ("bnei", 0x66, signed), ("blti", 0xA6, signed), ("bgei", 0xE6, signed), ("bltui", 0xB6, unsigned), ("bgeui", 0xF6, unsigned)):
        for field, value in enumerate(table):
            i = decode.builtin(BASE, word(low | 3 << 8 | field << 12 | 6 << 16))[0]
            assert (i["mnemonic"], i["operands"][0], int(i["operands"][1], 0), i["target"]) == (name, "a3", value, BASE + 10)


def test_instructions_of_the_usual_options():
    """Encodings as the architecture's manual gives them, field by field."""
    r = lambda op2, op1, r, s, t: word(op2 << 20 | op1 << 16 | r << 12 | s << 8 | t << 4)
    expected = {
        r(7, 4, 2, 1, 3): "extui a2 a3 1 8", r(0, 1, 2, 3, 4): "slli a2 a3 28", r(3, 1, 2, 3, 4): "srai a2 a4 19", r(4, 1, 2, 3, 4): "srli a2 a4 3",
        r(8, 2, 2, 3, 4): "mull a2 a3 a4", r(8, 3, 2, 3, 4): "moveqz a2 a3 a4", r(11, 3, 2, 3, 4): "movgez a2 a3 a4", r(0, 0, 2, 0, 12): "memw", r(0, 0, 2, 0, 0): "isync",
        r(0, 0, 4, 1, 15): "break 1 15", r(0, 3, 14, 6, 2): "rsr.ps a2", r(1, 3, 14, 6, 2): "wsr.ps a2", r(6, 1, 0, 3, 2): "xsr.sar a2", r(1, 3, 14, 2, 2): "wsr.intset a2",
        r(14, 3, 2, 14, 7): "rur.threadptr a2", r(15, 3, 14, 7, 2): "wur.threadptr a2", r(6, 0, 2, 0, 3): "neg a2 a3", r(6, 0, 2, 1, 3): "abs a2 a3", r(4, 0, 15, 3, 2): "nsau a2 a3",
        r(2, 3, 2, 3, 1): "sext a2 a3 8", r(4, 0, 0, 3, 0): "ssr a3", r(4, 0, 4, 5, 1): "ssai 21", r(0, 0, 1, 3, 2): "movsp a2 a3", r(0, 0, 6, 3, 2): "rsil a2 3",
        r(12, 2, 2, 3, 4): "quou a2 a3 a4", r(0, 10, 2, 3, 4): "add.s f2 f3 f4", r(15, 10, 2, 3, 4): "rfr a2 f3", r(1, 0, 2, 3, 4): "and a2 a3 a4", r(4, 9, 12, 1, 4): "s32e a4 a1 -16",
        word(2 | 3 << 4 | 4 << 8 | 15 << 12 | 2 << 16): "s32ri a3 a4 8", word(2 | 3 << 4 | 4 << 8 | 11 << 12 | 2 << 16): "l32ai a3 a4 8", word(2 | 3 << 4 | 4 << 8 | 14 << 12 | 2 << 16): "s32c1i a3 a4 8",
        word(2 | 3 << 4 | 3 << 8 | 10 << 12 | 232 << 16): "movi a3 0x3e8", word(3 | 2 << 4 | 1 << 8 | 4 << 12 | 1 << 16): "ssi f2 a1 4", word(2 | 1 << 4 | 1 << 8 | 13 << 12 | 255 << 16): "addmi a1 a1 0xffffff00",
        word(4 | 7 << 20 | 4 << 16 | 3 << 8 | 5 << 4): "mul.aa.ll a3 a5",
    }
    for data, text in expected.items():
        (i,) = decode.builtin(0, data)
        assert " ".join([i["mnemonic"], *i["operands"]]) == text and i["cls"] == "normal"
    assert [i["cls"] for i in decode.builtin(0, word(0x16 | 0 << 6 | 3 << 8)) + decode.builtin(0, word(0x76 | 1 << 12 | 2 << 8 | 4 << 16))] == ["branch", "branch"]


def test_measures_of_a_branching_function():
    body = bytes.fromhex("364100") + word(0x16 | 2 << 8 | 1 << 12) + bytes.fromhex("0c121df0")  # beqz over one instruction
    _, found, _ = recovered(body)
    f = found[0]
    assert (f["size"], f["basic_blocks"], f["edges"], f["indirect_calls"], f["callees"], f["never_returns"]) == (10, 3, 2, 0, [], False)


def switch(tail=bytes.fromhex("0c121df0")):
    return bytes.fromhex("364100") + word(0xA0 | 4 << 8) + tail


def test_a_switch_claims_its_arms_up_to_the_next_function():
    _, found, _ = recovered(switch() + bytes(2) + LEAF)
    f = found[0]
    assert (f["size"], f["reached"], f["reached_stretched"], f["indirect_calls"], f["never_returns"]) == (10, 6, 10, 1, False) and 12 in found


def test_a_pool_that_others_read_ends_a_switch():
    arms = bytes.fromhex("0c120c22")
    start = 16
    code = switch(arms) + bytes(2) + b"\x11\x22\x33\x44" + bytes.fromhex("364100")
    code += l32r(8, BASE + start + 3, BASE + 12) + bytes.fromhex("1df0")
    _, found, _ = recovered(code)
    assert found[0]["span_end"] == BASE + 10 and found[start]["size"] == 8
    own = bytes.fromhex("364100") + l32r(8, BASE + 3, BASE + 0) + word(0xA0 | 4 << 8) + bytes.fromhex("0c12") + b"\x01\x02\x03\x04" + bytes(1) + LEAF
    _, found, _ = recovered(own)  # a pool that the function reads itself doesn't end it
    assert found[0]["span_end"] == BASE + 15


def test_called_places_in_the_dark_are_no_functions():
    # the second function calls into the arms of the first one's switch, which nothing has verified
    code = switch(bytes.fromhex("0c12" + "0c120c220c32")) + bytes(2)
    at = len(code)
    code += bytes.fromhex("364100") + call0(BASE + at + 3, BASE + 8) + bytes.fromhex("1df0")
    _, found, rejected = recovered(code)
    assert sorted(found) == [0, at] and rejected == 1 and found[at]["callees"] == [BASE + 8]


def test_calls_of_what_never_returns_end_a_body():
    hang = bytes.fromhex("364100") + word(6 | (-4 & 0x3FFFF) << 6) + bytes(2)  # a jump to itself
    caller = bytes.fromhex("364100") + call0(BASE + 11, BASE) + bytes.fromhex("0c120c22")  # only the call, then what nobody reaches
    wraps = bytes.fromhex("364100") + call0(BASE + 23, BASE + 8) + bytes.fromhex("0c12")
    _, found, _ = recovered(hang + caller + bytes(2) + wraps)
    assert [found[k]["never_returns"] for k in (0, 8, 20)] == [True, True, True] and found[8]["size"] == 6
    branching = bytes.fromhex("364100") + word(0x16 | 2 << 8 | 2 << 12) + call0(BASE + 14, BASE) + bytes.fromhex("1df0")
    _, found, _ = recovered(hang + branching)  # calls it on one path, returns on the other
    assert not found[8]["never_returns"] and found[8]["size"] == 11


def grades(spark, data, *more):
    rows = [("i", None, 0, BASE, True, "iram", 0, bytearray(data)), *more]
    images = recover.recovered(spark.createDataFrame(rows, "image_id string, entry_addr long, index int, load_addr long, executable boolean, region string, file_offset long, data binary"))
    return images, {r.entry - BASE: r for r in recover.boundaries(images).collect()}


def test_grades_and_reasons(spark):
    code = bytes.fromhex("364100") + call0(BASE + 3, BASE + 16) + bytes.fromhex("1df0") + bytes(8) + bytes.fromhex("3a220df0") + bytes(4)
    code += bytes.fromhex("364100") + bytes.fromhex("0c12") + bytes(3)  # runs into padding
    images, found = grades(spark, code)
    assert found[0].confidence == "high" and found[0].confidence_reasons == ["prologue found by scanning", "windowed prologue"]
    assert found[16].confidence == "medium" and found[16].confidence_reasons == ["target of a direct call", "no prologue: begins with add.n"]
    assert found[24].confidence == "medium" and found[24].confidence_reasons[-1] == "ends on movi.n"
    assert {(r.origin, r.n) for r in recover.seeds_by_origin(images).collect()} == {("prologue_scan", 2), ("direct_call", 1)}
    data = switch(b"\xff" * 8 + bytes.fromhex("1df0"))
    _, found = grades(spark, data)
    assert found[0].confidence == "medium" and "8 bytes in a row are not code" in found[0].confidence_reasons


def test_literals_and_strings(spark):
    code = struct.pack("<I", 0x3FFB0000) + bytes.fromhex("364100") + l32r(8, BASE + 7, BASE) + bytes.fromhex("1df0")
    images, _ = grades(spark, code, ("i", None, 1, 0x3FFB0000, False, "dram", 64, bytearray(b"hello there\0")))
    row = next(r for r in recover.instructions(images).collect() if r.cls == "literal_load")
    assert (row.literal_value, row.literal_text) == (0x3FFB0000, "hello there")


def test_decoding_by_ranges(spark):
    rows = spark.createDataFrame([("x", BASE, bytearray(LEAF)), ("y", 0, bytearray(b"\x3d\xf0")), ("z", 0, None)], "key string, vaddr long, data binary")
    assert sorted((r.key, r.addr, r.mnemonic) for r in decode.decode_ranges(rows).collect()) == [("x", BASE, "entry"), ("x", BASE + 3, "retw.n"), ("y", 0, "nop.n")]


def test_object_listing(spark):
    text = ["4:\tf03d\tnop.n", "00000000 <first>:", "   0:\tf03d\tnop.n", "00000004  <gone>:", "   4:\tf03d\tnop.n", "   6:\tf00d\tret.n", "x", "00000010 <gone>:", "  10:\tf00d\tret.n", "00000020 <empty>:"]
    rows = [(path, k, line) for path in ("a.o", "b.o") for k, line in enumerate(text[: 10 if path == "a.o" else 6])]
    got = decode.read_object_listing(spark.createDataFrame(rows, "path string, n int, value string"), "path", "n").orderBy("path", "n")
    assert [(r.path, r.symbol, r.addr, r.mnemonic) for r in got.collect()] == [("a.o", "first", 0, "nop.n"), ("a.o", "gone", 16, "ret.n"), ("b.o", "first", 0, "nop.n"), ("b.o", "gone", 4, "nop.n"), ("b.o", "gone", 6, "ret.n")]


def test_small_images_are_dealt_to_tasks(spark):
    from pyspark.sql import functions as F

    rows = [(f"i{k}", BASE, 0, BASE, True, "iram", 0, bytearray(LEAF + bytes(3) + LEAF)) for k in range(40)]
    segments = spark.createDataFrame(rows, "image_id string, entry_addr long, index int, load_addr long, executable boolean, region string, file_offset long, data binary")
    found = recover.recovered(segments).select("image_id", F.size("raw").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert sorted((r.image_id, r.n) for r in found) == sorted((f"i{k}", 2) for k in range(40))
    assert len({r.task for r in found}) > 1


def test_images_that_share_code_are_explored_once(monkeypatch):
    explore, seen, explored = recover.Places.explore, [], recover.Explored()
    monkeypatch.setattr(recover.Places, "explore", lambda self, entry: seen.append(entry) or explore(self, entry))
    code = bytes.fromhex("20000d40 364100 81feff e00800 1df0")  # the literal, and a function that reads it

    def image(literal, data, offset):
        places = recover.Places([(BASE, struct.pack("<I", literal) + code[4:], True, "iram", offset), (0x3FFB0000, data, False, "dram", 64)])
        found = explored(places, BASE + 4)
        row, rows = recover.located(places, *found["bodies"][0])
        return row["file_offset"], [(i["literal_value"], i["literal_text"]) for i in rows if i["cls"] == "literal_load"]

    assert image(0x3FFB0000, b"the first\0", 32) == (36, [(0x3FFB0000, "the first")])
    assert image(0x3FFB0000, b"the other\0", 96) == (100, [(0x3FFB0000, "the other")]) and len(seen) == 1
    assert image(0x3FFB0004, b"the first\0", 32) == (36, [(0x3FFB0004, "first")]) and len(seen) == 2  # other code
    image(0x3FFB0000, struct.pack("<I", BASE + 12), 32)
    assert len(seen) == 3  # a further seed


def test_what_is_remembered_of_code_is_bounded(monkeypatch):
    monkeypatch.setattr(recover, "SHARED", 64)
    explored = recover.Explored()
    for k in range(8):
        explored(recover.Places([(BASE, LEAF + bytes([0] * 10 + [k]), True, "iram", 0)]), BASE)
    assert 0 < explored.held == sum(len(seed) for _, seed in explored.found) <= 64
