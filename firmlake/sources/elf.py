"""ELF32 little-endian files and ar archives, read and written."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from firmlake.errors import ParseError

SECTION = struct.Struct("<10I")
SYMBOL = struct.Struct("<IIIBBH")
SEGMENT = struct.Struct("<8I")
PAGE = 4096


@dataclass(frozen=True)
class Sec:
    name: str
    kind: int
    flags: int
    addr: int
    offset: int
    size: int
    link: int
    step: int
    data: bytes

    @property
    def allocated(self) -> bool:
        return bool(self.flags & 2)

    @property
    def code(self) -> bool:
        return bool(self.flags & 4)


def string_at(table: bytes, at: int) -> str:
    end = table.find(b"\0", at)
    return table[at : end if end >= 0 else len(table)].decode(errors="replace")


class Elf:
    """Sections and symbols of a file; raises ParseError if it isn't one."""

    def __init__(self, data: bytes):
        if data[:6] != b"\x7fELF\x01\x01":
            raise ParseError("not a 32-bit little-endian ELF file")
        _, self.machine, _, self.entry, _, table, _, _, _, _, step, count, names = struct.unpack_from("<HHIIIIIHHHHHH", data, 16)
        raw = [SECTION.unpack_from(data, table + k * step) for k in range(count)] if table else []
        body = lambda r: b"" if r[1] == 8 else data[r[4] : r[4] + r[5]]
        strings = body(raw[names]) if raw else b""
        self.sections = [Sec(string_at(strings, r[0]), r[1], r[2], r[3], r[4], r[5], r[6], r[9], body(r)) for r in raw]

    def symbols(self) -> list[dict]:
        """Named symbols, in table order; ``section`` is the owner's name, null for special indexes."""
        rows = []
        for table in (s for s in self.sections if s.kind == 2):
            strings = self.sections[table.link].data if table.link < len(self.sections) else b""
            for at in range(0, len(table.data) - SYMBOL.size + 1, table.step or SYMBOL.size):
                name, value, size, info, _, owner = SYMBOL.unpack_from(table.data, at)
                if label := string_at(strings, name):
                    rows.append({"name": label, "value": value, "size": size, "type": info & 15, "bind": info >> 4, "section": self.sections[owner].name if owner < len(self.sections) else None})
        return rows

    def functions(self) -> list[dict]:
        """Sized function symbols by value, then name."""
        return sorted((s for s in self.symbols() if s["type"] == 2 and s["size"]), key=lambda s: (s["value"], s["name"]))

    def extracted(self) -> list[dict]:
        """Functions with their bytes. Of one name the first with bytes in a code section counts; those without don't use the name up.

        Sections are found by name, of one name the last, as symbols name them so. In relocatable files values are offsets, else addresses.
        """
        by_name = {s.name: s for s in self.sections}
        seen, rows = set(), []
        for f in self.functions():
            s = by_name.get(f["section"])
            if f["name"] in seen or s is None or not s.code:
                continue
            at = f["value"] - s.addr
            if at < 0 or at + f["size"] > len(s.data):
                continue
            seen.add(f["name"])
            rows.append(f | {"data": s.data[at : at + f["size"]]})
        return rows


def ar_members(data: bytes) -> list[tuple[str, bytes]]:
    """(name, content) of a System V archive with GNU long names; the symbol index is left out."""
    if data[:8] != b"!<arch>\n":
        raise ParseError("not an ar archive")
    at, names, out = 8, b"", []
    while data[at + 58 : at + 60] == b"`\n" and data[at + 48 : at + 58].strip().isdigit():
        raw, size = data[at : at + 16].decode("ascii", "replace").rstrip(), int(data[at + 48 : at + 58])
        body = data[at + 60 : at + 60 + size]
        at += 60 + size + size % 2
        if raw == "//":
            names = body
        elif raw not in ("/", "/SYM64/", "__.SYMDEF"):
            if raw[:1] == "/" and raw[1:].isdigit():
                tail = names[int(raw[1:]) :]
                ends = [tail.find(e) for e in (b"/\n", b"\n", b"\0") if e in tail]
                raw = tail[: ends[0] if ends else len(tail)].decode(errors="replace")
            out.append((raw.rstrip("/"), body))
    return out


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen[n] = seen.get(n, -1) + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def program(parts: list[tuple[str, int, bytes, bool]], entry: int, machine: int = 94) -> bytes:
    """An executable of (name, address, bytes, executable) parts: a load segment and a named section each, file offsets
    congruent to addresses by page, no symbols."""
    if not parts:
        raise ParseError("nothing to write")
    blobs, at = [], 52 + 32 * len(parts)
    for _, addr, data, _ in parts:
        at += (addr - at) % PAGE
        blobs.append((at, data))
        at += len(data)
    names = b"\0" + b"".join(n.encode() + b"\0" for n, *_ in parts) + b".shstrtab\0"
    strings_at = at
    headers_at = (at + len(names) + 3) // 4 * 4
    out = bytearray(headers_at + 40 * (len(parts) + 2))
    struct.pack_into("<16sHHIIIIIHHHHHH", out, 0, b"\x7fELF\x01\x01\x01", 2, machine, 1, entry, 52, headers_at, 0, 52, 32, len(parts), 40, len(parts) + 2, len(parts) + 1)
    name_at = 1
    for k, ((name, addr, data, code), (where, _)) in enumerate(zip(parts, blobs, strict=True)):
        SEGMENT.pack_into(out, 52 + 32 * k, 1, where, addr, addr, len(data), len(data), 5 if code else 6, PAGE)
        SECTION.pack_into(out, headers_at + 40 * (k + 1), name_at, 1, 6 if code else 3, addr, where, len(data), 0, 0, 4, 0)
        out[where : where + len(data)] = data
        name_at += len(name.encode()) + 1
    SECTION.pack_into(out, headers_at + 40 * (len(parts) + 1), name_at, 3, 0, 0, strings_at, len(names), 0, 0, 1, 0)
    out[strings_at : strings_at + len(names)] = names
    return bytes(out)


def loader(parts: list[tuple[int, bytes, bool]], entry: int = 0, machine: int = 94) -> bytes:
    """An executable of (address, bytes, executable) parts with load segments alone; empty parts are left out."""
    whole = bytearray(program([("", addr, data, code) for addr, data, code in parts if data], entry, machine))
    ends = [SEGMENT.unpack_from(whole, 52 + 32 * k) for k in range(struct.unpack_from("<H", whole, 44)[0])]
    struct.pack_into("<I", whole, 32, 0)
    struct.pack_into("<HHH", whole, 46, 0, 0, 0)
    return bytes(whole[: max(s[1] + s[4] for s in ends)])


def sectioned(parts: list[tuple[str, int, bytes, bool]], symbols: list[tuple[str, int, int, int, str]] = (), entry: int = 0, machine: int = 94, relocatable: bool = False) -> bytes:
    """A file of named sections (name, address, bytes, code) without load segments, for tools that go by sections, with
    symbols (name, value, size, type, section) if given. In a relocatable file addresses are zero and values are offsets."""
    index = {name: k + 1 for k, (name, *_) in enumerate(parts)}
    heads = [(name, 1, 6 if code else 3, 0 if relocatable else addr, data, 0, 0) for name, addr, data, code in parts]
    if symbols:
        names, table = b"\0", bytes(SYMBOL.size)
        for name, value, size, kind, owner in symbols:
            table += SYMBOL.pack(len(names), value, size, 0x10 | kind, 0, index[owner])
            names += name.encode() + b"\0"
        heads += [(".symtab", 2, 0, 0, table, len(heads) + 2, SYMBOL.size), (".strtab", 3, 0, 0, names, 0, 0)]
    strings = b"\0" + b"".join(h[0].encode() + b"\0" for h in heads) + b".shstrtab\0"
    heads.append((".shstrtab", 3, 0, 0, strings, 0, 0))
    body, rows, name_at = b"", bytes(SECTION.size), 1
    for name, kind, flags, addr, data, link, step in heads:
        body += bytes(-len(body) % 4)
        rows += SECTION.pack(name_at, kind, flags, addr, 52 + len(body), len(data), link, 0, 4, step)
        body += data
        name_at += len(name.encode()) + 1
    body += bytes(-len(body) % 4)
    return struct.pack("<16sHHIIIIIHHHHHH", b"\x7fELF\x01\x01\x01", 1 if relocatable else 2, machine, 1, entry, 0, 52 + len(body), 0, 52, 0, 0, 40, len(heads) + 1, len(heads)) + body + rows
