"""Scalar functions on columns. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Instruction names of the architecture, by class.
CLASSES = {
    "call": ["call0", "call4", "call8", "call12"],
    "call_indirect": ["callx0", "callx4", "callx8", "callx12"],
    "return": ["ret", "ret.n", "retw", "retw.n", "rfe", "rfi", "rfwo", "rfwu", "rfde"],
    "jump": ["j", "j.l"],
    "jump_indirect": ["jx"],
    "loop": ["loop", "loopnez", "loopgtz"],
    "entry": ["entry"],
    "literal_load": ["l32r"],
}
NOT_BRANCHES = ["break", "break.n"]
# Mnemonics whose narrow encoding folds onto the wide one.
NARROW = ["add", "addi", "beqz", "bnez", "break", "l32i", "mov", "movi", "nop", "ret", "retw", "s32i"]
PADDING = ["nop", "nop.n", ".byte", ".short", ".word", "ill", "ill.n"]


def mnemonic_class(mnemonic: Column) -> Column:
    """Class of an instruction name. Names that begin with a dot are data; unlisted ones beginning with b are branches."""
    m = F.lower(mnemonic)
    out = F.when(m.startswith("."), F.lit("data"))
    for name, members in CLASSES.items():
        out = out.when(m.isin(members), F.lit(name))
    return out.when(m.startswith("b") & ~m.isin(NOT_BRANCHES), F.lit("branch")).otherwise(F.lit("normal"))


def fold_mnemonic(mnemonic: Column) -> Column:
    """The wide name of a narrow encoding; other names keep their case."""
    m = F.lower(mnemonic)
    wide = F.regexp_replace(m, r"\.n$", "")
    return F.when(m.endswith(".n") & wide.isin(NARROW), wide).otherwise(mnemonic)


def displacement(target: Column, addr: Column) -> Column:
    return F.format_string("%+d", target - addr)


def operand_number(token: Column) -> Column:
    """An integer operand with an optional sign and 0x, 0o or 0b prefix; null for anything else, leading-zero decimals too."""
    t = F.lower(F.btrim(token))
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    body = F.regexp_replace(t, r"^[+-]", "")

    def based(pattern: str, base: int):
        return F.when(body.rlike(pattern), sign * F.conv(F.substring(body, 3, 64), base, 10).cast("long"))

    return F.coalesce(
        based(r"^0x[0-9a-f]+$", 16),
        based(r"^0o[0-7]+$", 8),
        based(r"^0b[01]+$", 2),
        F.when(body.rlike(r"^([1-9][0-9]{0,17}|0+)$"), sign * body.try_cast("long")),
    )


def tagged_digest(text: Column, tag: str) -> Column:
    """SHA-256 of a tag line and the text, so that forms made under other rules never compare equal."""
    return F.sha2(F.concat(F.lit(tag + "\n"), text), 256)


def normalized_config(text: Column) -> Column:
    """Configuration lines stripped, without blank ones and comments, sorted, with a final newline."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    lines = F.array_sort(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def config_hash(text: Column) -> Column:
    return F.sha2(normalized_config(text), 256)


def component_of(path: Column) -> Column:
    """``x`` for an archive named libx.a; else the file name without its suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    lib = F.regexp_extract(name, r"^lib(.+)\.a$", 1)
    return F.when(lib != "", lib).otherwise(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"))


def toolchain_id(banner: Column) -> Column:
    """``build/binutils-version`` from the first line of a tool's version banner, the build as in its brackets without the name of the
    kit that made it; a banner without such brackets is its own id, trimmed."""
    first = F.btrim(F.regexp_extract(banner, r"^([^\n]*)", 1), F.lit(" \t\r"))
    pattern = r"\(([^)]*)\)\s*([0-9][\w.]*)"
    build = F.regexp_replace(F.regexp_extract(first, pattern, 1), r"^crosstool-NG\s+", "")
    return F.when(first.rlike(pattern), F.concat(build, F.lit("/binutils-"), F.regexp_extract(first, pattern, 2))).otherwise(first)


def bundled_version(text: Column) -> Column:
    """``vA.B.C`` from KEY=digits lines of the three version parts; null if one of the first two is missing, C zero if it is."""
    parts = [F.nullif(F.regexp_extract(text, rf"(?m)VERSION_{k}\s*=\s*(\d+)", 1), F.lit("")) for k in ("MAJOR", "MINOR", "PATCH")]
    return F.concat(F.lit("v"), parts[0], F.lit("."), parts[1], F.lit("."), F.coalesce(parts[2], F.lit("0")))


def hex_address(addr: Column) -> Column:
    return F.format_string("0x%08x", addr.cast("long"))


def named(code: Column, names: dict[int, str], width: int = 2) -> Column:
    """The code's name, or its hexadecimal form."""
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, F.format_string(f"0x%0{width}x", code.cast("long")))


def word_at(content: Column, base: Column, addr: Column) -> Column:
    """Little-endian 32-bit word at an address of a segment; null out of bounds."""
    at = (addr - base).cast("int")
    inside = (addr >= base) & (addr + 4 <= base + F.length(content))
    pair = [F.substring(content, at + 1 + k, F.lit(1)) for k in range(4)]
    value = F.conv(F.concat(*[F.hex(p) for p in reversed(pair)]), 16, 10).cast("long")
    return F.when(inside, value)


def cache_key(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(32))


def describe_build(version: Column, config: Column, config_hash_: Column) -> Column:
    return F.concat_ws("/", version, config, F.left(config_hash_, F.lit(12)))


def grouped_digits(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", F.lit(100.0) * part / F.nullif(whole, F.lit(0)))


def lower_grade(a: Column, b: Column) -> Column:
    """The lower of two confidence grades."""
    rank = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    return F.when(rank(a) <= rank(b), a).otherwise(b)
