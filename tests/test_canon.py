"""The canonical plan against a plain walk, on random functions."""

import random

from firmlake.operators import canon
from pyspark.sql import functions as F
from firmlake.functions import scalar


def walk(rows):
    """A register machine: what each register was last loaded with, and on which line."""
    rows = sorted(rows, key=lambda r: r["addr"])
    while len(rows) > 1 and rows[-1]["mnemonic"].lower() in scalar.PADDING:
        rows.pop()
    lines, held, loaded, edges, targets, open_calls, numbers = [], {}, {}, [], [], 0, []
    for r in rows:
        m, ops, cls = r["mnemonic"], list(r["operands"]), r["cls"]
        if m.lower().endswith(".n") and m.lower()[:-2] in scalar.NARROW:
            m = m.lower()[:-2]
        if m == "or" and len(ops) == 3 and ops[1] == ops[2]:
            m, ops = "mov", ops[:2]
        reg = r["operands"][0] if r["operands"] else None
        if cls == "literal_load":
            if ops:
                ops[-1] = "LIT"
                loaded[reg] = len(lines)
                held[reg] = r["literal_value"]
        elif cls == "call":
            if ops:
                ops[-1] = "CALL"
            edges.append(r["target_symbol"] or "CALL")
            targets += [r["target"]] if r["target"] is not None else []
        elif cls == "call_indirect":
            value, line = held.pop(reg, None), loaded.pop(reg, None)
            near = line is not None and line == len(lines) - 1
            if near:
                lines.pop()
                m, ops = "call" + (r["mnemonic"][5:] or "8"), ["CALL"]
            if value is not None:
                targets.append(value)
            if value is not None or near:
                edges.append("CALL")
            else:
                open_calls += 1
        elif cls in ("branch", "jump", "loop"):
            if r["target"] is not None and ops:
                ops[-1] = f"{r['target'] - r['addr']:+d}"
        else:
            numbers += [int(o, 0) for o in ops if o.lstrip("+-").isdigit() or o.startswith("0x")]
            if reg is not None:
                held.pop(reg, None)
                loaded.pop(reg, None)
        if m == "nop" or (m == "mov" and ops == ["a1", "a1"]):
            continue
        lines.append(" ".join([m, *ops]).strip())
    return "\n".join(lines), edges, targets, open_calls, numbers


def random_function(rng, fn):
    rows, addr = [], 0x1000
    for _ in range(rng.randint(1, 14)):
        reg = rng.choice(["a1", "a2", "a8"])
        kind = rng.choice(["l32r", "l32r", "callx8", "callx8", "call8", "beqz.n", "addi", "or", "nop", "nop.n", "mov.n", "retw.n", "j", "ill"])
        row = {"fn": fn, "addr": addr, "size": 3, "mnemonic": kind, "operands": [], "cls": "normal", "target": None, "literal_value": None, "target_symbol": None, "literal_text": None}
        if kind == "l32r":
            row |= {"operands": [reg, "0x90"], "cls": "literal_load", "literal_value": rng.choice([None, 0xBEEF, 7])}
        elif kind == "callx8":
            row |= {"operands": [reg], "cls": "call_indirect"}
        elif kind == "call8":
            row |= {"operands": ["0x40"], "cls": "call", "target": rng.choice([None, 0x40]), "target_symbol": rng.choice([None, "foo"])}
        elif kind in ("beqz.n", "j"):
            row |= {"operands": [reg, "0x90"][kind == "j" :], "cls": "branch" if kind != "j" else "jump", "target": rng.choice([None, addr + 8, addr - 8])}
        elif kind == "addi":
            row |= {"operands": [reg, reg, rng.choice(["-32", "0x10", "5"])]}
        elif kind in ("or", "mov.n"):
            other = rng.choice([reg, "a1", "a2"])
            row |= {"operands": [reg, other, rng.choice([other, "a2"])] if kind == "or" else [reg, other]}
        elif kind == "retw.n":
            row |= {"cls": "return"}
        rows.append(row)
        addr += rng.choice([2, 3])
    return rows


def test_random_functions(spark):
    rng = random.Random(5)
    functions = {f"f{k}": random_function(rng, f"f{k}") for k in range(400)}
    names = [c.split()[0] for c in canon.SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for rows in functions.values() for r in rows], canon.SCHEMA)
    for r in canon.forms(df).collect():
        text, edges, targets, open_calls, numbers = walk(functions[r.fn])
        assert (r.canonical_text, list(r.call_edges), list(r.call_targets), r.indirect_calls, list(r.immediates)) == (text, edges, targets, open_calls, numbers), r.fn


def test_position_and_version(spark):
    def at(base, hop):
        rows = [("entry", ["a1", "32"], "entry", None), ("beqz", ["a2", "0x1"], "branch", base + hop), ("nop", [], "normal", None), ("retw.n", [], "return", None)]
        return [(f"{base}-{hop}", base + 3 * k, 3, m, o, c, t, None, None, None) for k, (m, o, c, t) in enumerate(rows)]

    df = spark.createDataFrame(at(100, 9) + at(5000, 9) + at(100, 12), canon.SCHEMA)
    d = {r.fn: r for r in canon.forms(df).collect()}
    assert d["100-9"].digest == d["5000-9"].digest != d["100-12"].digest and d["100-9"].prologue == "windowed"
    assert canon.forms(df, "other").where("fn = '100-9'").first().digest != d["100-9"].digest


def test_scalars(spark):
    df = spark.createDataFrame([("0x10", "-32", "012", "0", "lib/libfoo.a", "obj/main.c.o", "GNU objdump (crosstool-NG esp-13.2.0) 2.41\nCopyright")], "a string, b string, c string, d string, e string, f string, g string")
    r = df.select(*[scalar.operand_number(F.col(c)).alias(c) for c in "abcd"], scalar.component_of(F.col("e")).alias("e"), scalar.component_of(F.col("f")).alias("f"), scalar.toolchain_id(F.col("g")).alias("g")).first()
    assert tuple(r) == (16, -32, None, 0, "foo", "main.c", "esp-13.2.0/binutils-2.41")
    r = spark.sql("SELECT X'0102030405' AS c, 100L AS base").select(scalar.word_at(F.col("c"), F.col("base"), F.lit(101)).alias("w"), scalar.word_at(F.col("c"), F.col("base"), F.lit(102)).alias("x"), scalar.hex_address(F.lit(0x80000000)).alias("h")).first()
    assert (r.w, r.x, r.h) == (0x05040302, None, "0x80000000")
    text = "B=y\n# CONFIG_X is not set\n\n  A=n \n"
    assert spark.createDataFrame([(text,)], "t string").select(scalar.normalized_config(F.col("t")).alias("t")).first().t == "A=n\nB=y\n"
    v = spark.createDataFrame([("VERSION_MAJOR=5\nVERSION_MINOR=4\nVERSION_PATCH=1",), ("x",)], "t string").select(scalar.bundled_version(F.col("t")).alias("v"))
    assert [x.v for x in v.collect()] == ["v5.4.1", None]
