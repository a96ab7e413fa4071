"""Images, dumps, archives and programs made of table rows, so that parsing, recovery and harvesting can run over tables that hold no firmware."""

from __future__ import annotations

import hashlib
import struct

import numpy as np

DROM, IROM = 0x3F400020, 0x400D0020
SLOT = 32  # bytes from one function to the next

#: Code of one slot each: a leaf; a branch over an instruction; a loop; a literal read and called through; a dispatch through a
#: register, with an arm that nothing reaches; a call of a function without a prologue, which follows.
SHAPES = [bytes.fromhex(h.replace(" ", "")) for h in ("364100 1df0", "364100 161200 0c12 1df0", "364100 768301 1b22 1df0", "20000d40 364100 81feff e00800 1df0", "364100 a00400 0c12 1df0", "364100 c50000 1df0 0000000000000000 3a22 0df0")]


def code(functions: int) -> bytes:
    return b"".join(SHAPES[k % len(SHAPES)].ljust(SLOT, b"\0") for k in range(functions))


def descriptor(version: str) -> bytes:
    return struct.pack("<II8x32s32s16s16s32s", 0xABCD5432, 1, version.encode(), b"synthetic", b"12:00:00", b"Jan  1 2026", b"v5.4") + bytes(range(32)) + bytes(80)


def image(payload: bytes, functions: int) -> bytes:
    """An application image: the payload as read-only data, that many small functions as code."""
    parts = [(DROM, payload + bytes(-len(payload) % 4)), (IROM, code(functions))]
    head = struct.pack("<BBBBIB3sHBHH4sB", 0xE9, len(parts), 2, 0x2F, IROM, 0xEE, bytes(3), 0, 0, 0, 0xFFFF, bytes(4), 1)
    body = head + b"".join(struct.pack("<II", a, len(d)) + d for a, d in parts)
    checksum = 0xEF
    for _, data in parts:
        checksum ^= int(np.bitwise_xor.reduce(np.frombuffer(data, np.uint8))) if data else 0
    body += bytes(15 - len(body) % 16) + bytes([checksum])
    return body + hashlib.sha256(body).digest()


def dump(key: int, payload: bytes) -> bytes:
    """A flash dump. By the key: its table moved, or its first sector missing; one factory slot, or two slots of the same or of different
    content; a further slot beyond its end."""
    first = image(descriptor(f"v{key}") + payload, key % 3 + 1)
    slots = [("factory", 0, first)] if key % 2 else [("ota_0", 0x10, first), ("ota_1", 0x11, first if key % 4 == 0 else image(descriptor(f"v{key}") + payload + b"!", 1))]
    rows, at, parts = [("nvs", 1, 2, 0xA000, 0x4000), ("coredump", 1, 3, 0xE000, 0x2000)], 0x10000, []
    for label, sub, data in slots:
        size = -(-len(data) // 8192) * 8192
        rows.append((label, 0, sub, at, size))
        parts.append((at, data))
        at += size
    if key % 5 == 0:
        rows.append(("spare", 0, 0x20, at, 0x10000))
    table = b"".join(struct.pack("<2sBBII16sI", b"\xaa\x50", kind, sub, where, size, label.encode(), 0) for label, kind, sub, where, size in rows) + b"\xeb\xeb" + b"\xff" * 30
    out = bytearray(b"\xff" * at)
    for where, data in [(0x9000 if key % 3 == 1 else 0x8000, table), *parts]:
        out[where : where + len(data)] = data
    return bytes(out[0x1000 if key % 3 == 2 else 0 :])


def named_program(functions: list[tuple[str, int, int]], base: int, text: bytes, relocatable: bool) -> bytes:
    """An object file or a program with one code section and function symbols (name, offset, size)."""
    from firmlake.sources.elf import sectioned

    return sectioned([(".text", base, text, True)], [(n, base + o, s, 2, ".text") for n, o, s in functions], entry=base, relocatable=relocatable)


def archive(members: list[tuple[str, bytes]]) -> bytes:
    """A System V archive; long names go into a table."""
    names, out = b"", b""
    for name, data in members:
        label = name + "/"
        if len(label) > 16:
            label, names = f"/{len(names)}", names + name.encode() + b"/\n"
        out += f"{label:<16}{0:<12}{0:<6}{0:<6}{'100644':<8}{len(data):<10}`\n".encode() + data + b"\n" * (len(data) % 2)
    table = f"{'//':<16}{'':<32}{len(names):<10}`\n".encode() + names + b"\n" * (len(names) % 2) if names else b""
    return b"!<arch>\n" + table + out


def build(key: int) -> list[tuple[str, bytes]]:
    """(path, content) of a build's artifacts: an archive of two objects, and a program that links their functions under the same names.

    The objects hold symbols that don't count as well: one without a size, one beyond the section, and a name that was there before.
    """
    leaf, branch, loop = SHAPES[0], SHAPES[1], SHAPES[2]
    first = named_program([(f"open_{key % 7}", 0, 5), ("empty", 0, 0), ("beyond", 4, 400), (f"open_{key % 7}", 8, 10)], 0, leaf.ljust(8, b"\0") + branch, True)
    second = named_program([(f"step_{key}", 0, 10)], 0, loop, True)
    caller = bytes.fromhex("364100c500001df0").ljust(16, b"\0") + leaf  # calls the leaf
    program = named_program([("main", 0, 8), (f"open_{key % 7}", 16, 5)], 0x40080000, caller, False)
    return [(f"b{key}/archives/lib{'net' if key % 2 else 'core'}.a", archive([("a.o", first), (f"a_rather_long_name_{key}.o", second)])), (f"b{key}/app/app.elf", program)]
