"""SentencePiece encoding and decoding of merge-type (BPE) models, without the library.

In a merge-type model the encoding of each prefix of a text has one last token: the longest candidate that ends
there and is compatible with the last token before it, two tokens being compatible if encoding their
concatenation gives just these two. A table of last tokens over all prefixes, filled from the matches of an
automaton, thus holds the whole encoding, recovered from the end backwards.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from firmlake.llm.common import map_rows

SPACE = "▁"  # fixed value: what the format writes for a space
CACHE = 150_000  # chunks kept in each of two generations; bounds memory, not results
CACHE_CHARS = 6_000_000  # of chunks, ids and decoded texts kept in each
PAIRS = 1_000_000  # remembered pair tests


def read_model(data: bytes) -> dict:
    """The pieces, their scores and types, and the settings that matter, from the serialized protocol buffer."""

    def fields(buf: bytes):
        at = 0

        def varint():
            nonlocal at
            shift = value = 0
            while True:
                b = buf[at]
                at += 1
                value |= (b & 127) << shift
                if b < 128:
                    return value
                shift += 7

        while at < len(buf):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            else:
                size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
                yield tag >> 3, buf[at : at + size]
                at += size

    import struct

    model = {"pieces": [], "model_type": 1, "byte_fallback": False, "dummy_prefix": True, "trim": True, "escape": True, "charsmap": b"", "suffix": False}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            model["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, 1)))
        elif number == 2:
            spec = dict(fields(value))
            model |= {"model_type": spec.get(3, 1), "byte_fallback": bool(spec.get(35, 0)), "suffix": bool(spec.get(24, 0))}
        elif number == 3:
            spec = dict(fields(value))
            model |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "trim": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    return model


class Pieces:
    """Encoder and decoder of one model. NORMAL pieces only are merged; other characters fall back to bytes."""

    def __init__(self, data: bytes):
        import ahocorasick

        model = read_model(data)
        ok = model["model_type"] == 2 and model["byte_fallback"] and model["dummy_prefix"] and not model["trim"] and model["escape"] and not model["charsmap"] and not model["suffix"]
        if not ok or any(kind in (4, 5) for _, _, kind in model["pieces"]):
            raise ValueError("only merge-type models with byte fallback, a dummy prefix and the identity normalizer are supported")
        self.text = [p for p, _, _ in model["pieces"]]
        self.kind = [k for _, _, k in model["pieces"]]
        self.id = {p: i for i, (p, _, k) in enumerate(model["pieces"]) if k == 1}
        self.score = {p: s for p, s, k in model["pieces"] if k == 1}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model["pieces"]) if k == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.automaton = ahocorasick.Automaton()
        self.single = {p: i for p, i in self.id.items() if len(p) == 1}
        for p, i in self.id.items():
            if len(p) > 1 and self.merged(p) == [p]:  # pieces that encoding their own text doesn't give are never tokens
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        # a text may be cut before a space that follows another character, and around line ends, if no piece says otherwise
        self.cut = all(SPACE not in p.lstrip(SPACE) for p in self.id) and not any("\n" in p for p in self.id)
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}
        self.held = 0
        self.pairs: dict[int, bool] = {}
        self.plain = [p.replace(SPACE, " ") if k == 1 else None for p, _, k in model["pieces"]]

    def merged(self, text: str) -> list[str]:
        """What merging the best-scored adjacent pair, the leftmost of equals, over and over leaves. For short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether encoding left + right gives just these two."""
        return self.merged(left + right) == [left, right]

    def token_ids(self, chunk: str) -> list[int]:
        """Last tokens of all prefixes, then backwards.

        Matches come by their end, longest first; the first that fits the token before it is the prefix's
        last token. Where none fits it is the last character alone.
        """
        n = len(chunk)
        last, start_of = [-1] * (n + 1), list(range(-1, n))
        pairs, single = self.pairs, self.single
        for end, (size, token) in self.automaton.iter(chunk):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    before = single.get(chunk[start - 1], -1)
                key = before << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    left = self.text[before] if before >= 0 else chunk[start - 1]
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = self.compatible(left, self.text[token])
                    if before >= 0:
                        pairs[key] = fits
                if not fits:
                    continue
            last[end], start_of[end] = token, start
        out, at = [], n
        while at:
            token = last[at]
            if token < 0:
                token = single.get(chunk[at - 1], -1)
            if token >= 0:
                out.append(token)
            else:
                out += [self.byte_id[b] for b in reversed(chunk[at - 1].encode())]
            at = start_of[at]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text. Null and empty texts have none."""
        return [int(x) for x in self.both(text)[0].split(",") if x]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids: pieces joined, runs of byte pieces read as UTF-8, the dummy space dropped at the start."""
        out, pending = [], bytearray()
        for i in ids:
            if (byte := self.byte_of.get(i)) is not None:
                pending.append(byte)
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            if self.kind[i] == 1:
                out.append(self.text[i])
            elif self.kind[i] == 2:
                out.append(" ⁇ ")
        if pending:
            out.append(pending.decode(errors="replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if first and text.startswith(" ") else text

    def known(self, key: str) -> tuple[str, str]:
        """(ids, each after a comma; decoded text) of a cached chunk. A key is a word after a space, or a tagged other chunk."""
        found = self.old.get(key)
        if found is None:
            chunk = key[1:] if key[:1] in "\x02\x03" else SPACE + key
            ids = self.token_ids(chunk) if chunk else []
            words = [self.plain[i] for i in ids]
            found = "".join([f",{i}" for i in ids]), self.decode(ids, first=False) if None in words else "".join(words)
        size = len(key) + len(found[0]) + len(found[1])
        if size > CACHE_CHARS // 64:  # rare enough to be encoded again
            return found
        if len(self.young) >= CACHE or self.held + size > CACHE_CHARS:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = found
        self.held += size
        return found

    def both(self, text: str | None) -> tuple[str, str]:
        """(ids, each after a comma; the text decoded from them)."""
        if not text:
            return "", ""
        if not self.cut:
            ids = self.token_ids(SPACE + text.replace(" ", SPACE))
            return "".join(f",{i}" for i in ids), self.decode(ids)
        keys = None
        if not ("\x02" in text or "\x03" in text or SPACE in text or "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " "):
            # plain texts: words after single spaces; what follows a line end has no space
            keys = text.replace("\n", " \x03\n \x02").split(" ") if "\n" in text else text.split(" ")
        else:
            keys = ["\x03" + c for c in re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", SPACE + text.replace(" ", SPACE))]
        ids, words = [], []
        get, known = self.young.get, self.known
        for key in keys:
            found = get(key) or known(key)
            ids.append(found[0])
            words.append(found[1])
        decoded = "".join(words)
        return "".join(ids), decoded[1:] if decoded[:1] == " " else decoded


_loaded: dict[str, Pieces] = {}


def loaded(path: str, data: bytes | None = None) -> Pieces:
    """The model, once a worker process."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = Pieces(f.read())
    return _loaded[path]


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc id, ids, decoded): every whole text's ids, and the text decoded from them.

    Null and empty texts have no ids and the empty text. Repeated rows give repeated rows. ``path``: the model, on every executor.
    """
    path = model_path(path)

    def make():
        model = loaded(path)

        def one(row):
            ids, text = model.both(row[1])
            return row[0], [int(x) for x in ids.split(",") if x], text

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, text), whatever other columns there are.

    Whole texts, however long. Null and empty texts have no ids and the empty text's digests; null ids and repeated rows pass through; an
    empty table gives none."""
    path = model_path(path)

    def make():
        model = loaded(path)

        def one(row):
            ids, text = model.both(row[1])
            return row[0], ids.count(","), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

        return one

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; all rows defined as in ``digests``."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
