"""Inputs built from the layout tables alone, independently of the parsers."""

import hashlib
import struct

CHIPS = {
    "esp32": (0x0000, [0x3F400020, 0x400D0020, 0x40080000]),
    "esp32s2": (0x0002, [0x3F000020, 0x40080020, 0x40024000]),
    "esp32s3": (0x0009, [0x3C000020, 0x42000020, 0x40378000]),
    "esp32c3": (0x0005, [0x3C000020, 0x42000020]),
}


def padded(text: str, n: int) -> bytes:
    return text.encode().ljust(n, b"\0")


def descriptor(version="1.0.0") -> bytes:
    return struct.pack("<II8x", 0xABCD5432, 0) + padded(version, 32) + padded("hello_world", 32) + padded("12:00:00", 16) + padded("Jan  1 2026", 16) + padded("v5.4", 32) + bytes(range(32)) + bytes(80)


def image(chip="esp32", corrupt=False, hashed=True, described=True, version="1.0.0", entry=0x400D0100, code=None, rev=0) -> bytes:
    number, bases = CHIPS[chip]
    datas = [(descriptor(version) if described else bytes(256)) + b"some read-only text\0" * 4, code or bytes.fromhex("364100") + bytes(61), bytes.fromhex("0df0") * 32][: len(bases)]
    out = struct.pack("<BBBBIB3sHBHH4sB", 0xE9, len(bases), 2, 0x2F, entry, 0xEE, b"\0" * 3, number, rev // 100, 0, 0xFFFF, b"\0" * 4, int(hashed))
    checksum = 0xEF
    for base, data in zip(bases, datas, strict=True):
        out += struct.pack("<II", base, len(data)) + data
        for b in data:
            checksum ^= b
    out += bytes(15 - len(out) % 16) + bytes([checksum ^ (0xFF if corrupt else 0)])
    return out + hashlib.sha256(out).digest() if hashed else out


DEFAULT = [("nvs", 1, 2, 0x9000, 0x6000), ("phy_init", 1, 1, 0xF000, 0x1000), ("factory", 0, 0, 0x10000, 0x100000)]
OTA = [("nvs", 1, 2, 0x9000, 0x4000), ("otadata", 1, 0, 0xD000, 0x2000), ("phy_init", 1, 1, 0xF000, 0x1000), ("ota_0", 0, 0x10, 0x10000, 0x100000), ("ota_1", 0, 0x11, 0x110000, 0x100000)]


def table(rows, checksum=True) -> bytes:
    out = b"".join(struct.pack("<2sBBII16sI", b"\xaa\x50", kind, sub, at, size, padded(label, 16), 0) for label, kind, sub, at, size in rows)
    return out + (b"\xeb\xeb" + b"\xff" * 30 if checksum else b"")


def dump(rows=DEFAULT, images=None, boot=False, at=0x8000, chip="esp32", size=None) -> bytes:
    images = images or {}
    parts = [(at, table(rows))] + [(o, images.get(label, image(chip))) for label, kind, _, o, _ in rows if kind == 0]
    if boot:
        parts.append((0x1000, image(chip, described=False, entry=0x40080000)))
    end = size or max(o + len(d) for o, d in parts)
    out = bytearray(b"\xff" * end)
    for o, d in parts:
        if o < end:
            out[o : o + len(d)] = d[: end - o]
    return bytes(out)
