"""Secret scans: a keyword automaton finds where to look, anchored expressions look there, checksums confirm.

Kinds, in the order in which they are listed: assign, access, hex (the base), then github and npm, tokens whose
last six characters are the CRC-32 of the rest in base 62.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import map_rows

# The patterns of the contract and of public token formats.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "github", "npm")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
}


def base62_crc(body: bytes) -> bytes:
    """The CRC-32 of body in base 62, six digits."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r : r + 1] + out
    return out


@functools.cache
def automaton():
    """Of all keywords; once a process."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            auto.add_word(word, (kind, len(word)))
    auto.make_automaton()
    return auto


def hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Runs of at least MIN_HEX hexadecimal digits. Such a run covers two of every 12 bytes' first ones in a row, so only these are looked at."""
    probe, out, done = data[:: MIN_HEX // 2], [], 0
    for hit in HEX.finditer(probe):
        if hit.end() - hit.start() < 2:
            continue
        at = hit.start() * (MIN_HEX // 2)
        end = (hit.end() - 1) * (MIN_HEX // 2)
        while at <= end:
            if at < done:
                at = done
                if at > end:
                    break
            found = HEX.match(data, at)
            if not found:
                at += 1
                continue
            begin = at
            while begin > done and data[begin - 1] in b"0123456789abcdef":
                begin -= 1
            if found.end() - begin >= MIN_HEX:
                out.append((begin, found.end()))
            done = at = found.end()
    return out


def scan(text: str | None, auto) -> list[tuple[int, str, int]]:
    """Spans (start, kind, end) in code points, by start, then kind as listed."""
    if not text:
        return []
    data = text.encode()
    hits: dict[str, list[int]] = {}
    for end, (kind, size) in auto.iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(end + 1 - size)
    found = [(a, "hex", b) for a, b in hex_runs(data)]
    done = 0
    for at in sorted(hits.get("assign", ())):
        if at >= done and (m := ASSIGN.match(data, at)):
            done = m.end()
            if len(m[2]) >= MIN_ASSIGN:
                found.append((m.start(), "assign", m.end()))
    done = 0
    for at in hits.get("access", ()):
        if at >= done and (m := ACCESS.match(data, at)):
            done = m.end()
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((m.start(), "access", m.end()))
    for kind, pattern in (("github", GITHUB), ("npm", NPM)):
        for at in hits.get(kind, ()):
            if (m := pattern.match(data, at)) and base62_crc(m[1]) == m[2]:
                found.append((m.start(), kind, m.end()))
    if not found:
        return []
    if not text.isascii():  # byte offsets to code points, from one offset to the next
        points, at, seen = {}, 0, 0
        for byte in sorted({x for a, _, b in found for x in (a, b)}):
            seen += len(data[at:byte].decode())
            at = byte
            points[byte] = seen
        found = [(points[a], kind, points[b]) for a, kind, b in found]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def redact(text: str | None, spans: list[tuple[int, str, int]]) -> str | None:
    """The text with each span, or union of overlapping spans, replaced by the first one's kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, spans, redacted): spans as structs (start, kind, end) in code points, end exclusive.

    Whole texts are scanned. Null and empty texts have no spans; a null text stays null. Repeated rows give
    repeated rows. The base kinds' spans are what leftmost non-overlapping matching of each kind gives.
    """

    def make():
        auto = automaton()

        def one(row):
            spans = scan(row[1], auto)
            return row[0], spans, redact(row[1], spans)

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, spans array<struct<start:int,kind:string,end:int>>, redacted string")


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in the text; every row stays.

    Null texts stay null; empty, very long and repeated ones are treated like any other, and an empty table stays empty. A column n_chars, if there is one, becomes the new text's length where the text changed. Other columns are untouched.
    """

    @F.pandas_udf("string")
    def masked(texts):
        auto = automaton()
        return texts.map(lambda t: None if t is None else redact(t, scan(t, auto)))

    new = docs.select(F.struct(*docs.columns).alias("_row"))
    new = new.withColumn("_masked", masked(F.col("_row")[text_col]))
    columns = {c: F.col("_row")[c] for c in docs.columns}
    if "n_chars" in columns:
        changed = ~F.col("_masked").eqNullSafe(columns[text_col])
        columns["n_chars"] = F.when(changed, F.length("_masked").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    columns[text_col] = F.col("_masked")
    return new.select(*[v.alias(c) for c, v in columns.items()])


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans: whole texts, null ones as empty; repeated rows give repeated rows, an empty table none."""

    def make():
        auto = automaton()

        def one(row):
            spans = scan(row[1], auto)
            base = [s for s in spans if s[1] in KINDS[:3]]
            n = [sum(s[1] == k for s in base) for k in KINDS[:3]]
            return row[0], *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        return one

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
