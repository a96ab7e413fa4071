"""Instruction decoding: a listing reader, and a built-in decoder of the Xtensa base set and its usual options.

A decoder is a function of (address, bytes) that gives instructions as dicts. Bytes that a decoder doesn't know become data,
never guesses. Operands are printed as the usual disassemblers print them: registers, absolute addresses, and numbers in
decimal within a byte's magnitude and as 32-bit hexadecimal beyond it, so that forms of both agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.functions.scalar import CLASSES, NOT_BRANCHES, mnemonic_class

Decoder = Callable[[int, bytes], list[dict]]
INSTRUCTION = "addr long, size int, mnemonic string, operands array<string>, cls string, target long, literal_value long, target_symbol string"

_CLASS = {m: cls for cls, members in CLASSES.items() for m in members}

# Fixed values of the encoding: op1, op2, name and operands of the three-register formats. Operands: r, s, t are address registers by
# field, with f or b before the field floating-point or boolean ones; = marks a field that must hold this value.
REGISTERS = """
0 1 and r s t|0 2 or r s t|0 3 xor r s t|0 6 neg r t s=0|0 6 abs r t s=1
0 8 add r s t|0 9 addx2 r s t|0 10 addx4 r s t|0 11 addx8 r s t|0 12 sub r s t|0 13 subx2 r s t|0 14 subx4 r s t|0 15 subx8 r s t
1 0 slli r s left|1 1 slli r s left|1 2 srai r t right|1 3 srai r t right|1 4 srli r t ns|1 6 xsr t special
1 8 src r s t|1 9 srl r t s=0|1 10 sll r s t=0|1 11 sra r t s=0|1 12 mul16u r s t|1 13 mul16s r s t
2 0 andb br bs bt|2 1 andbc br bs bt|2 2 orb br bs bt|2 3 orbc br bs bt|2 4 xorb br bs bt|2 6 saltu r s t|2 7 salt r s t
2 8 mull r s t|2 10 muluh r s t|2 11 mulsh r s t|2 12 quou r s t|2 13 quos r s t|2 14 remu r s t|2 15 rems r s t
3 0 rsr t special|3 1 wsr t special|3 2 sext r s t7|3 3 clamps r s t7|3 4 min r s t|3 5 max r s t|3 6 minu r s t|3 7 maxu r s t
3 8 moveqz r s t|3 9 movnez r s t|3 10 movltz r s t|3 11 movgez r s t|3 12 movf r s bt|3 13 movt r s bt|3 14 rur r user_st|3 15 wur t user_rs
8 0 lsx fr s t|8 1 lsxu fr s t|8 4 ssx fr s t|8 5 ssxu fr s t|9 0 l32e t s window|9 4 s32e t s window
10 0 add.s fr fs ft|10 1 sub.s fr fs ft|10 2 mul.s fr fs ft|10 4 madd.s fr fs ft|10 5 msub.s fr fs ft|10 6 maddn.s fr fs ft|10 7 divn.s fr fs ft
10 8 round.s r fs nt|10 9 trunc.s r fs nt|10 10 floor.s r fs nt|10 11 ceil.s r fs nt|10 12 float.s fr s nt|10 13 ufloat.s fr s nt|10 14 utrunc.s r fs nt
10 15 mov.s fr fs t=0|10 15 abs.s fr fs t=1|10 15 const.s fr ns t=3|10 15 rfr r fs t=4|10 15 wfr fr s t=5|10 15 neg.s fr fs t=6|10 15 div0.s fr fs t=7
10 15 recip0.s fr fs t=8|10 15 sqrt0.s fr fs t=9|10 15 rsqrt0.s fr fs t=10|10 15 nexp01.s fr fs t=11|10 15 mksadj.s fr fs t=12|10 15 mkdadj.s fr fs t=13
10 15 addexp.s fr fs t=14|10 15 addexpm.s fr fs t=15
11 1 un.s br fs ft|11 2 oeq.s br fs ft|11 3 ueq.s br fs ft|11 4 olt.s br fs ft|11 5 ult.s br fs ft|11 6 ole.s br fs ft|11 7 ule.s br fs ft
11 8 moveqz.s fr fs t|11 9 movnez.s fr fs t|11 10 movltz.s fr fs t|11 11 movgez.s fr fs t|11 12 movf.s fr fs bt|11 13 movt.s fr fs bt
"""
# Fixed values of the encoding: r, name and operands where op1 and op2 are 0 (system), and where they are 0 and 4 (shift amounts).
SYSTEM = """
1 movsp t s|2 isync s=0 t=0|2 rsync s=0 t=1|2 esync s=0 t=2|2 dsync s=0 t=3|2 excw s=0 t=8|2 memw s=0 t=12|2 extw s=0 t=13|2 nop s=0 t=15
3 rfe s=0 t=0|3 rfue s=1 t=0|3 rfde s=2 t=0|3 rfwo s=4 t=0|3 rfwu s=5 t=0|3 rfi ns t=1|3 rfme s=0 t=2
4 break ns nt|5 syscall s=0 t=0|5 simcall s=1 t=0|6 rsil t ns|7 waiti ns t=0|8 any4 bt bs|9 all4 bt bs|10 any8 bt bs|11 all8 bt bs
"""
SHIFTS = "0 ssr s t=0|1 ssl s t=0|2 ssa8l s t=0|3 ssa8b s t=0|4 ssai amount|6 rer t s|7 wer t s|8 rotw turn s=0|14 nsa t s|15 nsau t s"
# Fixed values of the encoding: r, name, operands and the unit of the offset, of memory accesses of either register file.
MEMORY = {0: ("l8ui", 1), 1: ("l16ui", 2), 2: ("l32i", 4), 4: ("s8i", 1), 5: ("s16i", 2), 6: ("s32i", 4), 9: ("l16si", 2), 11: ("l32ai", 4), 14: ("s32c1i", 4), 15: ("s32ri", 4)}
FLOAT_MEMORY = {0: "lsi", 4: "ssi", 8: "lsiu", 12: "ssiu"}
CACHE = {0: "dpfr", 1: "dpfw", 2: "dpfro", 3: "dpfwo", 4: "dhwb", 5: "dhwbi", 6: "dhi", 7: "dii", 12: "ipf", 14: "ihi", 15: "iii"}
# Fixed values of the encoding: branches by field, and the constants that the four-bit field of immediate branches stands for.
ZERO = ["beqz", "bnez", "bltz", "bgez"]
IMMEDIATE = ["beqi", "bnei", "blti", "bgei"]
COMPARE = ["bnone", "beq", "blt", "bltu", "ball", "bbc", "bbci", "bbci", "bany", "bne", "bge", "bgeu", "bnall", "bbs", "bbsi", "bbsi"]
SIGNED_CONSTANTS = [-1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 32, 64, 128, 256]
UNSIGNED_CONSTANTS = [32768, 65536, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 32, 64, 128, 256]
BOOLEAN_OR_LOOP = {0: "bf", 1: "bt", 8: "loop", 9: "loopnez", 10: "loopgtz"}
# Fixed values of the encoding: numbers and names of special and user registers; a range counts on from its first name's number.
SPECIAL = """0 lbeg lend lcount sar br litbase|12 scompare1|16 acclo acchi|32 m0 m1 m2 m3|72 windowbase windowstart|83 ptevaddr|89 mmid rasid itlbcfg dtlbcfg
96 ibreakenable memctl cacheattr atomctl|104 ddr|128 ibreaka0 ibreaka1|144 dbreaka0 dbreaka1|160 dbreakc0 dbreakc1|176 configid0 epc1 epc2 epc3 epc4 epc5 epc6 epc7
192 depc|194 eps2 eps3 eps4 eps5 eps6 eps7|208 configid1 excsave1 excsave2 excsave3 excsave4 excsave5 excsave6 excsave7|224 cpenable|226 interrupt intclear intenable
230 ps vecbase exccause debugcause ccount prid icount icountlevel excvaddr|240 ccompare0 ccompare1 ccompare2|244 misc0 misc1 misc2 misc3"""
USER = {231: "threadptr", 232: "fcr", 233: "fsr"}

SPECIAL_NAMES = {int(first) + k: name for part in SPECIAL.replace("\n", "|").split("|") for first, *names in [part.split()] for k, name in enumerate(names)}


def class_of(mnemonic: str) -> str:
    m = mnemonic.lower()
    if m.startswith("."):
        return "data"
    return _CLASS.get(m) or ("branch" if m.startswith("b") and m not in NOT_BRANCHES else "normal")


def signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) & 1 else x


def number(x: int) -> str:
    return str(x) if -256 < x < 256 else hex(x & 0xFFFFFFFF)


#: How an operand that isn't a plain register is read from the word.
FIELDS = {
    "ns": lambda w: w >> 8 & 15,
    "nt": lambda w: w >> 4 & 15,
    "t7": lambda w: (w >> 4 & 15) + 7,
    "left": lambda w: 32 - (w >> 4 & 15 | w >> 16 & 16),
    "right": lambda w: w >> 8 & 15 | w >> 16 & 16,
    "window": lambda w: (w >> 12 & 15) * 4 - 64,
    "amount": lambda w: w >> 8 & 15 | w & 16,
    "turn": lambda w: signed(w >> 4 & 15, 4),
}
PLACES = {"r": 12, "s": 8, "t": 4}


def _table(text: str, keys: int) -> dict[tuple[int, ...], list[tuple[str, list[str], list[tuple[int, int]]]]]:
    """{fields: [(name, operands, (shift, value) of the fields that are given)]} of a table as above."""
    out: dict = {}
    for entry in text.strip().replace("\n", "|").split("|"):
        words = entry.split()
        operands = [w for w in words[keys + 1 :] if "=" not in w]
        given = [(PLACES[w[0]], int(w[2:])) for w in words[keys + 1 :] if "=" in w]
        out.setdefault(tuple(map(int, words[:keys])), []).append((words[keys], operands, given))
    return out


_REGISTERS, _SYSTEM, _SHIFTS = _table(REGISTERS, 2), _table(SYSTEM, 1), _table(SHIFTS, 1)


def _filled(w: int, found: list | None):
    """The first entry whose given fields agree, its operands printed."""
    for name, operands, given in found or ():
        if all(w >> at & 15 == value for at, value in given):
            out = []
            for o in operands:
                if o in PLACES:
                    out.append(f"a{w >> PLACES[o] & 15}")
                elif o in FIELDS:
                    out.append(number(FIELDS[o](w)))
                elif o == "special":
                    code = w >> 8 & 255
                    register = "intset" if (code, name) == (226, "wsr") else SPECIAL_NAMES.get(code, str(code))
                    name = f"{name}.{register}"
                elif o.startswith("user"):
                    code = w >> 4 & 255 if o == "user_st" else w >> 8 & 255
                    name = f"{name}.{USER.get(code, f'u{code}')}"
                else:
                    out.append(f"{o[0]}{w >> PLACES[o[1]] & 15}")
            return name, out, None
    return None


def _multiply(w: int):
    """The 16-bit multiply-accumulate option: halves by two bits, what is done by two more, where operands come from by op2."""
    op1, op2 = w >> 16 & 15, w >> 20
    half = ("ll", "hl", "lh", "hh")[op1 & 3]
    first, second = (f"m{w >> 14 & 1}", f"a{w >> 8 & 15}"), (f"m{2 + (w >> 6 & 1)}", f"a{w >> 4 & 15}")
    if op2 in (2, 3, 6, 7) and (op1 >> 2 or op2 == 7):
        pair = {2: "dd", 3: "ad", 6: "da", 7: "aa"}[op2]
        return f"{('umul', 'mul', 'mula', 'muls')[op1 >> 2]}.{pair}.{half}", [x[kind == "a"] for x, kind in zip((first, second), pair, strict=True)], None
    if op2 in (0, 1, 4, 5) and op1 >> 2 == 2:
        pair = "dd" if op2 < 4 else "da"
        return f"mula.{pair}.{half}.{('ldinc', 'lddec')[op2 & 1]}", [f"m{w >> 12 & 3}", f"a{w >> 8 & 15}", first[0], second[pair == "da"]], None
    if op2 in (8, 9) and op1 == 0:
        return ("ldinc", "lddec")[op2 & 1], [f"m{w >> 12 & 3}", f"a{w >> 8 & 15}"], None
    return None


def narrow(w: int, at: int):
    """(mnemonic, operands, target) of a 16-bit word; None if unknown."""
    op, t, s, r = (w >> k & 15 for k in (0, 4, 8, 12))
    if op in (8, 9):
        return ("l32i.n", "s32i.n")[op - 8], [f"a{t}", f"a{s}", number(r * 4)], None
    if op == 10:
        return "add.n", [f"a{r}", f"a{s}", f"a{t}"], None
    if op == 11:
        return "addi.n", [f"a{r}", f"a{s}", str(t or -1)], None
    if op == 12 and t < 8:
        v = t << 4 | r
        return "movi.n", [f"a{s}", str(v - 128 if v >= 96 else v)], None
    if op == 12:
        to = at + 4 + ((t & 3) << 4 | r)
        return ("beqz.n", "bnez.n")[t >> 2 & 1], [f"a{s}", hex(to)], to
    if op == 13 and r == 0:
        return "mov.n", [f"a{t}", f"a{s}"], None
    if op == 13 and r == 15:
        if t == 2:
            return "break.n", [str(s)], None
        name = {0: "ret.n", 1: "retw.n", 3: "nop.n", 6: "ill.n"}.get(t) if s == 0 else None
        return (name, [], None) if name else None
    return None


def _leaving(w: int):
    """Returns and calls through registers, where op1, op2 and r are 0."""
    m, n, s = w >> 6 & 3, w >> 4 & 3, w >> 8 & 15
    if w == 0:
        return "ill", [], None
    if m == 2 and n < 2 and s == 0:
        return ("ret", "retw")[n], [], None
    if (m, n) == (2, 2):
        return "jx", [f"a{s}"], None
    return (f"callx{4 * n}", [f"a{s}"], None) if m == 3 else None


def wide(w: int, at: int):
    """(mnemonic, operands, target) of a 24-bit word; None if unknown."""
    op, t, s, r, op1, op2 = (w >> k & 15 for k in (0, 4, 8, 12, 16, 20))
    byte = signed(w >> 16, 8)
    if op == 0:
        if (op1, op2) == (0, 0):
            return _filled(w, _SYSTEM.get((r,))) if r else _leaving(w)
        if (op1, op2) == (0, 4):
            return _filled(w, _SHIFTS.get((r,)))
        if op1 in (4, 5):
            return "extui", [f"a{r}", f"a{t}", str(s | (op1 & 1) << 4), str(op2 + 1)], None
        return _filled(w, _REGISTERS.get((op1, op2)))
    if op == 1:
        to = (at + 3 & ~3) + (((w >> 8) - 0x10000) << 2)
        return "l32r", [f"a{t}", hex(to)], to
    if op == 2:
        if r in MEMORY:
            return MEMORY[r][0], [f"a{t}", f"a{s}", number((w >> 16) * MEMORY[r][1])], None
        if r == 7 and t in CACHE:
            return CACHE[t], [f"a{s}", number((w >> 16) * 4)], None
        if r == 10:
            return "movi", [f"a{t}", number(signed(s << 8 | w >> 16, 12))], None
        if r in (12, 13):
            return ("addi", "addmi")[r - 12], [f"a{t}", f"a{s}", number(byte << 8 * (r - 12))], None
        return None
    if op == 3 and r in FLOAT_MEMORY:
        return FLOAT_MEMORY[r], [f"f{t}", f"a{s}", number((w >> 16) * 4)], None
    if op == 4:
        return _multiply(w)
    if op == 5:
        to = (at & ~3) + (signed(w >> 6, 18) << 2) + 4
        return f"call{4 * (t & 3)}", [hex(to)], to
    if op == 6:
        n, m = t & 3, t >> 2
        if n == 0:
            to = at + 4 + signed(w >> 6, 18)
            return "j", [hex(to)], to
        if n == 1:
            to = at + 4 + signed(w >> 12, 12)
            return ZERO[m], [f"a{s}", hex(to)], to
        to = at + 4 + byte
        if n == 2:
            return IMMEDIATE[m], [f"a{s}", number(SIGNED_CONSTANTS[r]), hex(to)], to
        if m >= 2:
            return ("bltui", "bgeui")[m - 2], [f"a{s}", number(UNSIGNED_CONSTANTS[r]), hex(to)], to
        if m == 0:
            return "entry", [f"a{s}", number((w >> 12) * 8)], None
        if r in BOOLEAN_OR_LOOP:
            to = to if r < 2 else at + 4 + (w >> 16)
            return BOOLEAN_OR_LOOP[r], [f"{'b' if r < 2 else 'a'}{s}", hex(to)], to
        return None
    if op == 7:
        to = at + 4 + byte
        other = str(t | (r & 1) << 4) if r in (6, 7, 14, 15) else f"a{t}"
        return COMPARE[r], [f"a{s}", other, hex(to)], to
    return None


def builtin(at: int, data: bytes) -> list[dict]:
    """Instructions from an address on, one after the other; a byte of data where none is known."""
    out, here = [], 0
    while here < len(data):
        op = data[here] & 15
        size = 3 if op < 8 else 2 if op < 14 else 1
        found = None
        if size > 1 and here + size <= len(data):
            found = (narrow if size == 2 else wide)(int.from_bytes(data[here : here + size], "little"), at + here)
        if found is None:
            size, found = 1, (".byte", [f"0x{data[here]:02x}"], None)
        name, operands, to = found
        out.append({"addr": at + here, "size": size, "mnemonic": name, "operands": operands, "cls": class_of(name), "target": to, "literal_value": None, "target_symbol": None})
        here += size
    return out


def decode_ranges(ranges: DataFrame, decoder: Decoder = builtin) -> DataFrame:
    """(key, vaddr, data) -> one row an instruction, each range decoded from its own start."""
    kind = T._parse_datatype_string(f"key string, {INSTRUCTION}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for batch in batches:
            for key, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pylist([{"key": key} | i for i in decoder(at, data or b"")], schema=schema)

    return ranges.select(F.col("key").cast("string"), "vaddr", "data").mapInArrow(run, kind)


def read_listing(lines: DataFrame, column: str = "value") -> DataFrame:
    """Disassembly text -> instructions, by expressions alone; other lines vanish.

    The bytes are printed as a word and reversed to memory order. An address operand may carry the value found there
    and a symbol; these become columns and the operand is the bare address.
    """
    pattern = r"^\s*([0-9a-fA-F]+):\t([0-9a-fA-F ]+?)\s*\t(\S+)(?:\s+(.*))?$"
    annotated = r"^(0x[0-9a-fA-F]+|\d+)(?:\s*\((0x[0-9a-fA-F]+)\))?(?:\s*<([^>]+)>)?$"
    part = lambda k: F.regexp_extract(column, pattern, k)
    df = lines.where(F.col(column).rlike(pattern)).withColumns({"_word": F.regexp_replace(part(2), " ", ""), "_text": part(4), "mnemonic": part(3), "addr": F.conv(part(1), 16, 10).cast("long")})
    df = df.where((F.length("_word") > 0) & (F.length("_word") % 2 == 0))
    operands = F.when(F.col("_text") == "", F.array().cast("array<string>")).otherwise(F.transform(F.split("_text", ","), lambda x: F.btrim(x)))
    df = df.withColumns({"_ops": operands, "cls": mnemonic_class(F.col("mnemonic"))})
    last = F.coalesce(F.get("_ops", F.size("_ops") - 1), F.lit(""))
    known = F.col("cls").isin("call", "jump", "branch", "loop", "literal_load") & last.rlike(annotated)
    number = lambda x: F.when(x.startswith("0x"), F.conv(F.substring(x, 3, 16), 16, 10)).otherwise(x).cast("long")
    piece = lambda k: F.when(known & (F.regexp_extract(last, annotated, k) != ""), F.regexp_extract(last, annotated, k))
    return df.select(
        *[c for c in lines.columns if c != column],
        "addr",
        (F.length("_word") / 2).cast("int").alias("size"),
        F.unhex(F.array_join(F.reverse(F.regexp_extract_all("_word", F.lit("(..)"))), "")).alias("raw"),
        "mnemonic",
        F.when(known, F.concat(F.slice("_ops", F.lit(1), F.size("_ops") - 1), F.array(piece(1)))).otherwise(F.col("_ops")).alias("operands"),
        "cls",
        number(piece(1)).alias("target"),
        number(piece(2)).alias("literal_value"),
        piece(3).alias("target_symbol"),
    )


def read_object_listing(lines: DataFrame, key: str, order: str, column: str = "value") -> DataFrame:
    """As ``read_listing``, with the ``symbol`` whose heading each line of an object's listing stands below.

    ``key`` names the object, ``order`` the line within it. Lines above the first heading vanish; of headings
    with one name in an object the last counts.
    """
    name = F.regexp_extract(F.btrim(column), r"^[0-9a-fA-F]+\s+<(.+)>:$", 1)
    before = Window.partitionBy(key).orderBy(order)
    df = lines.withColumns({"symbol": F.when(name != "", name), "_head": F.when(name != "", F.col(order))})
    df = df.withColumns({"symbol": F.last("symbol", True).over(before), "_below": F.last("_head", True).over(before)})
    df = df.withColumn("_last", F.max("_head").over(Window.partitionBy(key, "symbol"))).where("_below = _last")
    return read_listing(df.drop("_head", "_below", "_last"), column)


def listed(instructions: DataFrame) -> Decoder:
    """A decoder that looks instructions of ``read_listing`` up by address; bytes that the listing doesn't cover are data.

    The listing comes to the driver and goes to the tasks, so it should be one image's."""
    names = [c.split()[0] for c in INSTRUCTION.split(", ")]
    known = {r["addr"]: r.asDict() for r in instructions.select(*names).collect()}

    def decode(at: int, data: bytes) -> list[dict]:
        out, here = [], 0
        while here < len(data):
            found = known.get(at + here)
            if found is None or here + found["size"] > len(data):
                found = {"addr": at + here, "size": 1, "mnemonic": ".byte", "operands": [f"0x{data[here]:02x}"], "cls": "data", "target": None, "literal_value": None, "target_symbol": None}
            out.append(dict(found))
            here += found["size"]
        return out

    return decode


def c_string(data: bytes, at: int, most: int = 128) -> str | None:
    """Printable text of five or more characters that ends within so many bytes; null for anything else."""
    end = data.find(b"\0", at, at + most)
    raw = data[at:end] if end >= 0 else b""
    return raw.decode() if len(raw) >= 5 and all(32 <= b < 127 or b in b"\t\r\n" for b in raw) else None
