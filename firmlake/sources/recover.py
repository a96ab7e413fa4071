"""Function boundaries of images: what is decoded from where, which starts hold, what belongs to each, and how sure that is.

An image is one task's work. Its executable bytes are laid end to end; what is known of them stands in arrays with one entry a
byte, a place being an index into these. Instructions are admitted a frontier of decoded runs at a time; windows between
starts, basic blocks and what flow reaches in them come out of array operations over all functions at once. Grades and
reasons are Column expressions over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.sources.decode import Decoder, builtin, c_string

VERSION = "2"
ROUNDS, CHUNK, PASSES = 40, 256, 6
REPORT, PENALTY = 0.90, 0.50
TOGETHER = 512  # instructions of recovered images handed on together, or as many more as an image has
SHARED = 1 << 16  # bytes of code whose exploration a task remembers
GAP = 8  # places between segments, so that nothing runs from one into the next
STACK_OPENERS = ["addi", "addmi", "s32i", "s32i.n", "movi", "mov.n"]

KINDS = ["none", "normal", "call", "call_indirect", "return", "jump", "jump_indirect", "loop", "entry", "literal_load", "branch", "data", "illegal"]
KIND = {k: i for i, k in enumerate(KINDS)}
#: How a seed was found, as bits, the most telling first.
ORIGINS = {"image_entry": 1, "direct_call": 2, "prologue_scan": 4, "pointer": 8}

RAW = "entry long, file_offset long, size long, ranges array<struct<start:bigint,end:bigint>>, span_end long, reached long, reached_stretched long, region string, is_thunk boolean, origins array<string>, basic_blocks int, edges int, indirect_calls int, callees array<long>, never_returns boolean, decoded int, head string, head_cls string, tail string, tail_cls string, longest_data long"
CODE = "image_id string, fn long, addr long, size int, mnemonic string, operands array<string>, cls string, target long, literal_value long, target_symbol string, literal_text string"


def among(kind: np.ndarray, *names: str) -> np.ndarray:
    held = np.zeros(len(KINDS), bool)
    held[[KIND[n] for n in names]] = True
    return held[kind]


class Places:
    """The executable bytes of an image, each with what starts there. Segments are (load address, bytes, executable, region, file offset)."""

    def __init__(self, segments: list[tuple[int, bytes, bool, str | None, int]], decoder: Decoder = builtin):
        self.segments, self.decoder, self.rounds = segments, decoder, 0
        self.code = sorted((s for s in segments if s[2] and s[1]), key=lambda s: s[0])
        lengths = np.array([len(s[1]) for s in self.code], np.int64)
        self.base = np.array([s[0] for s in self.code], np.int64)
        self.first = np.cumsum(np.append(0, lengths + GAP))[:-1]
        self.last = self.first + lengths
        n = int(self.last[-1]) + GAP if self.code else 0
        self.bytes = np.zeros(n, np.uint8)
        for s, at in zip(self.code, self.first, strict=True):
            self.bytes[at : at + len(s[1])] = np.frombuffer(s[1], np.uint8)
        self.size, self.kind, self.seed = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        self.target = np.full(n, -1, np.int64)  # addresses
        self.opens, self.wall = np.zeros(n, bool), np.zeros(n, bool)  # a frame is opened on a1; flow ends on purpose

    def place(self, addr: np.ndarray) -> np.ndarray:
        """Places of addresses; -1 for those outside. Where segments overlap, the lowest counts."""
        out = np.full(len(addr), -1, np.int64)
        for base, low, high in zip(self.base, self.first, self.last, strict=True):
            inside = (out < 0) & (addr >= base) & (addr < base + high - low)
            out[inside] = addr[inside] - base + low
        return out

    def address(self, place: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.first, place, "right") - 1
        return place - self.first[k] + self.base[k] if len(self.code) else place

    def end_of(self, place: np.ndarray) -> np.ndarray:
        """Where the segment ends that holds a place."""
        return self.last[np.searchsorted(self.first, place, "right") - 1] if len(self.code) else place

    # what is decoded

    def mark(self, addr: np.ndarray, origin: str) -> np.ndarray:
        """Record seeds: aligned executable addresses. Returns their places."""
        at = self.place(addr[addr % 4 == 0])
        at = np.unique(at[at >= 0])
        self.seed[at] |= ORIGINS[origin]
        return at

    def planted(self, entry: int | None) -> np.ndarray:
        """Seeds that need no decoding: the entry point, bytes that may open a frame, and words that point into code."""
        found = [self.mark(np.array([] if entry is None else [entry], np.int64), "image_entry")]
        for base, low, high in zip(self.base, self.first, self.last, strict=True):
            body = self.bytes[low : max(low, high - 2)]
            found.append(self.mark(base + np.nonzero(body == 0x36)[0], "prologue_scan"))
        low, high = self.base.min(initial=1 << 32), (self.base + self.last - self.first).max(initial=0)
        for _, data, *_ in self.segments:
            words = np.frombuffer(data, "<u4", len(data) // 4)
            words = words[(words >= low) & (words < high)]
            found.append(self.mark(np.unique(words).astype(np.int64), "pointer"))
        return np.unique(np.concatenate(found))

    def runs(self, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Straight runs decoded from places: (run, place, size, kind, target, opens), by run, then place."""
        rows: list[tuple] = []
        for k, (at, place, end) in enumerate(zip(self.address(starts).tolist(), starts.tolist(), self.end_of(starts).tolist(), strict=True)):
            for i in self.decoder(at, self.bytes[place : min(place + CHUNK, end)].tobytes()):
                kind = KIND["illegal"] if i["mnemonic"] in ("ill", "ill.n") else KIND[i["cls"]]
                opens = i["cls"] == "entry" and [o.strip().lower() for o in i["operands"][:1]] == ["a1"]
                rows.append((k, place + i["addr"] - at, i["size"], kind, -1 if i["target"] is None else i["target"], opens))
        return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 6

    def explore(self, entry: int | None) -> Places:
        """Decode from all seeds and from all that flow leads to, a frontier at a time."""
        frontier, tried = self.planted(entry), np.zeros(len(self.size), bool)
        while len(frontier) and self.rounds < ROUNDS:
            self.rounds += 1
            tried[frontier] = True
            run, place, size, kind, target, opens = self.runs(frontier)
            # a run is cut before what is known, data or illegal, and after what doesn't go on
            bar = (self.size[place] > 0) | among(kind, "data", "illegal")
            ends = among(kind, "jump", "return", "jump_indirect")
            after = np.append(False, ends[:-1] & (run[1:] == run[:-1])) if len(run) else ends
            cuts = np.cumsum(bar | after)
            past = cuts - np.append(0, cuts)[np.searchsorted(run, run)]  # without those in earlier runs
            self.wall[place[bar & (past == 1) & ~after & (kind == KIND["illegal"]) & (self.size[place] == 0)]] = True
            taken = past == 0
            last = np.searchsorted(run, np.unique(run), "right") - 1
            onward = [(place + size)[last[taken[last] & ~ends[last]]]]
            at = place[taken]
            self.size[at], self.kind[at], self.target[at], self.opens[at] = size[taken], kind[taken], target[taken], opens[taken].astype(bool)
            to, kind = target[taken], kind[taken]
            onward.append(self.mark(to[(kind == KIND["call"]) & (to >= 0)], "direct_call"))
            onward.append(self.place(to[among(kind, "branch", "loop", "jump") & (to >= 0)]))
            frontier = np.unique(np.concatenate(onward))
            frontier = frontier[(frontier >= 0) & (frontier < len(self.size))]
            frontier = frontier[~tried[frontier] & (self.size[frontier] == 0) & (frontier < self.end_of(frontier))]
        return self

    # which starts hold

    def starts(self) -> tuple[np.ndarray, int]:
        """(starts, seeds that are none): the entry point and true prologues; called places that nothing speaks against.

        Against a called place speaks that it is inside an instruction, or inside a function whose body can't be known
        whole, as it dispatches through a table.
        """
        code, inside = np.nonzero(self.size)[0], np.zeros(len(self.size), bool)
        for k in range(1, int(self.size.max(initial=1))):
            inside[code[self.size[code] > k] + k] = True
        seeds = np.nonzero(self.seed)[0]
        sure = seeds[(self.seed[seeds] & 1 > 0) | (self.opens[seeds] & ~inside[seeds])]
        body = Bodies(self, sure, np.zeros(len(self.size), bool))
        k = np.searchsorted(sure, seeds, "right") - 1
        dark = (k >= 0) & (seeds > np.append(sure, 0)[k])
        if len(sure):
            dark &= body.switch[k] & (seeds < body.span[k])
        called = seeds[(self.seed[seeds] & 2 > 0) & ~inside[seeds] & ~dark]
        held = np.union1d(sure, called)
        return held, len(seeds) - len(held)

    def bodies(self) -> tuple[Bodies, int]:
        """Bodies between the starts that hold, with calls of what never returns as ends: found anew until no more such functions come to light."""
        starts, rejected = self.starts()
        silent = np.zeros(len(self.size), bool)
        for _ in range(PASSES):
            body = Bodies(self, starts, silent)
            now = np.zeros(len(self.size), bool)
            now[starts[body.silent]] = True
            if np.array_equal(now, silent):
                break
            silent = now
        return body, rejected

    # data

    def word(self, addr: int) -> int | None:
        """The 32-bit word at an address of any segment, the first that holds it."""
        s = next((s for s in self.segments if s[0] <= addr < s[0] + len(s[1])), None)
        at = addr - s[0] if s else 0
        return int.from_bytes(s[1][at : at + 4], "little") if s and at + 4 <= len(s[1]) else None

    def text(self, addr: int) -> str | None:
        """The string in the first data segment that holds the address."""
        s = next((s for s in self.segments if not s[2] and s[0] <= addr < s[0] + len(s[1])), None)
        return c_string(s[1], addr - s[0]) if s else None


class Bodies:
    """What belongs to the functions at some starts, calls of ``silent`` places being ends. Arrays with one entry a start.

    A function's window reaches from its start to the next or to its segment's end; what flow leads to beyond isn't its own.
    """

    def __init__(self, places: Places, starts: np.ndarray, silent: np.ndarray):
        self.places, self.starts = places, starts
        n = len(starts)
        self.top = np.minimum(np.append(starts[1:], len(places.size)), places.end_of(starts)) if n else starts
        # instructions in windows, and what each leads to
        at = np.nonzero(places.size)[0]
        owner = np.searchsorted(starts, at, "right") - 1
        held = (owner >= 0) & (at < np.append(self.top, 0)[owner])
        self.at, self.owner = at, owner = at[held], owner[held]
        self.kind, self.next = places.kind[at], at + places.size[at]
        self.to = places.place(places.target[at])
        hops = among(self.kind, "jump", "branch", "loop") & (places.target[at] >= 0)
        falls = ~among(self.kind, "jump", "return", "jump_indirect") & ~((self.kind == KIND["call"]) & (self.to >= 0) & silent[self.to])
        self.hops, self.falls = hops, falls
        self._reach(n)
        self._measure(n)

    def _own(self, place: np.ndarray) -> np.ndarray:
        """Whether a place that an instruction leads to is in its own window."""
        low, high = np.append(self.starts, 0)[self.owner], np.append(self.top, 0)[self.owner]
        return (place >= low) & (place < high)

    def _reach(self, n: int) -> None:
        at, index = self.at, np.full(len(self.places.size) + GAP, -1, np.int64)
        index[at] = np.arange(len(at))
        jump = np.where(self.hops & (self.to >= 0) & self._own(self.to), self.to, -1)
        fall = np.where(self.falls & self._own(self.next), self.next, -1)
        jump_to, fall_to = np.where(jump >= 0, index[jump], -1), np.where(fall >= 0, index[fall], -1)
        # blocks: instructions that follow each other, cut where any flow comes in, or does anything but go on
        i = np.arange(len(at))
        leads = np.zeros(len(at) + 1, bool)
        leads[:1] = True
        leads[index[self.starts[index[self.starts] >= 0]]] = True
        leads[jump_to[jump_to >= 0]] = True
        straight = (fall_to == i + 1) & (jump < 0)
        leads[i[~straight] + 1] = True
        leads[fall_to[(fall_to >= 0) & ~straight]] = True
        leads = leads[:-1]
        block = np.cumsum(leads) - 1
        last = np.append(np.nonzero(leads)[0][1:], len(at)) - 1 if len(at) else i
        reached = np.zeros(len(last), bool)
        frontier = np.unique(block[index[self.starts[index[self.starts] >= 0]]]) if len(at) else i
        while len(frontier):
            reached[frontier] = True
            ends = last[frontier]
            onward = np.concatenate([jump_to[ends], fall_to[ends]])
            frontier = np.unique(block[onward[onward >= 0]])
            frontier = frontier[~reached[frontier]]
        self.body = reached[block] if len(at) else np.zeros(0, bool)
        # flow to where nothing is known, unless it ends there on purpose
        missing = np.zeros(n, bool)
        for place, found in ((jump, jump_to), (fall, fall_to)):
            lost = self.body & (place >= 0) & (found < 0)
            missing[self.owner[lost][~self.places.wall[place[lost]]]] = True
        self.missing, self.jump = missing, jump

    def _measure(self, n: int) -> None:
        b = np.nonzero(self.body)[0]
        own, kind = self.owner[b], self.kind[b]
        tally = lambda mask: np.bincount(own[mask], minlength=n)
        self.count = np.bincount(own, minlength=n)
        self.flow = self.starts.copy()
        np.maximum.at(self.flow, own, self.next[b])
        self.switch = tally(kind == KIND["jump_indirect"]) > 0
        self.silent = (self.count > 0) & (tally(kind == KIND["return"]) == 0) & ~self.switch & ~self.missing
        self.thunk = (self.count == 1) & (tally(kind == KIND["jump"]) == 1)
        self.indirect = tally(among(kind, "call_indirect", "jump_indirect"))
        forks = among(kind, "branch", "loop")
        self.edges = tally(self.hops[b]) + tally(forks)
        heads = np.zeros(len(self.places.size) + GAP, bool)
        heads[self.starts] = True
        heads[self.jump[b][self.jump[b] >= 0]] = True
        after = self.next[b][forks]
        heads[after[after < np.append(self.top, 0)[own[forks]]]] = True
        self.blocks = tally(heads[self.at[b]])
        # the extent: flow's end, or, where some of the body can't be known, as far as nothing else claims
        self.span = self.flow.copy()
        more = (self.switch | self.missing) & (self.count > 0) & (self.flow < self.top)
        if more.any():
            self.span[more] = self._extent(more)
        # runs of bytes that flow reached
        new = np.append(True, (own[1:] != own[:-1]) | (self.next[b][:-1] != self.at[b][1:]))[: len(b)]
        self.range_first, self.range_owner = self.at[b][new], own[new]
        self.range_last = self.next[b][np.append(np.nonzero(new)[0][1:], len(b)) - 1] if len(b) else self.range_first

    def _extent(self, more: np.ndarray) -> np.ndarray:
        """To the top, or the first pool of literals before it that only other functions read; without zero bytes at its end."""
        reads = self.places
        at = np.nonzero(reads.kind == KIND["literal_load"])[0]
        pool = reads.place(reads.target[at])
        at, pool = at[pool >= 0], pool[pool >= 0]
        window = lambda x: np.where(x < np.append(self.top, 0)[k := np.searchsorted(self.starts, x, "right") - 1], k, -1)
        mine = np.unique(pool[(window(at) == window(pool))])
        foreign = np.setdiff1d(pool, mine)
        flow, stop = self.flow[more], self.top[more]
        k = np.searchsorted(foreign, flow)
        stop = np.minimum(stop, np.append(foreign, len(reads.size))[k])
        solid = np.maximum.accumulate(np.where(reads.bytes > 0, np.arange(len(reads.bytes)), -1))
        return np.maximum(flow, solid[stop - 1] + 1)

    def rows(self) -> list[dict]:
        """One raw boundary a function that has a body."""
        address, out = self.places.address, []
        entry = address(self.starts)
        shift = entry - self.starts
        first, last = self.range_first + shift[self.range_owner], self.range_last + shift[self.range_owner]
        cut = np.searchsorted(self.range_owner, np.arange(len(entry) + 1))
        called = (self.kind == KIND["call"]) & self.body & (self.places.target[self.at] >= 0)
        calls_of = np.searchsorted(self.owner[called], np.arange(len(entry) + 1))
        calls = self.places.target[self.at[called]]
        for k in np.nonzero(self.count)[0].tolist():
            ranges = [{"start": a, "end": b} for a, b in zip(first[cut[k] : cut[k + 1]].tolist(), last[cut[k] : cut[k + 1]].tolist(), strict=True)]
            reached, end = sum(r["end"] - r["start"] for r in ranges), int(self.span[k] + shift[k])
            stretched = reached + end - ranges[-1]["end"]
            ranges[-1]["end"] = end
            bits = int(self.places.seed[self.starts[k]])
            out.append(
                {"entry": int(entry[k]), "size": end - int(entry[k]), "ranges": ranges, "span_end": end, "reached": reached, "reached_stretched": stretched, "is_thunk": bool(self.thunk[k])}
                | {"origins": sorted(o for o, bit in ORIGINS.items() if bits & bit), "basic_blocks": int(self.blocks[k]), "edges": int(self.edges[k]), "indirect_calls": int(self.indirect[k])}
                | {"callees": np.unique(calls[calls_of[k] : calls_of[k + 1]]).tolist(), "never_returns": bool(self.silent[k])}
            )
        return out


class Explored:
    """What was found of images, by their code and seeds, on which all of it depends: those that share them are explored once.

    Only the latest are kept, up to ``SHARED`` bytes of code.
    """

    def __init__(self):
        self.found, self.held = {}, 0

    def __call__(self, places: Places, entry: int | None) -> dict:
        """rounds, seeds_rejected, seeds, and the bodies with their instructions."""
        places.planted(entry)
        key = tuple((base, data, region) for base, data, _, region, _ in places.code), places.seed.tobytes()
        if key not in self.found:
            body, rejected = places.explore(entry).bodies()
            seeds = [{"origin": o, "n": int((places.seed & bit > 0).sum())} for o, bit in ORIGINS.items()]
            made = {"rounds": places.rounds, "seeds_rejected": rejected, "seeds": seeds, "bodies": [decoded(places, r) for r in body.rows()]}
            if len(places.bytes) > SHARED:
                return made
            self.found[key], self.held = made, self.held + len(places.bytes)
            while self.held > SHARED:
                first = next(iter(self.found))
                self.held -= len(first[1])  # seeds are one a byte
                del self.found[first]
        return self.found[key]


def decoded(places: Places, row: dict) -> tuple[dict, list[dict]]:
    """The boundary with what grades go by, and its instructions decoded over the whole extent."""
    at = int(places.place(np.array([row["entry"]]))[0])
    k = int(np.searchsorted(places.first, at, "right")) - 1
    code = places.decoder(row["entry"], places.bytes[at : at + row["size"]].tobytes())
    ends = {f"{name}{part}": code[i][key] if code else None for name, i in (("head", 0), ("tail", -1)) for part, key in (("", "mnemonic"), ("_cls", "cls"))}
    data = np.array([i["size"] if i["cls"] == "data" else 0 for i in code], np.int64)
    total = np.cumsum(data)
    longest = int((total - np.maximum.accumulate(np.where(data == 0, total, 0))).max(initial=0))
    return row | ends | {"region": places.code[k][3], "decoded": len(code), "longest_data": longest}, code


def located(places: Places, row: dict, code: list[dict]) -> tuple[dict, list[dict]]:
    """The boundary with its place in the file, and its instructions with literals read, which go by the image's other bytes."""
    at = int(places.place(np.array([row["entry"]]))[0])
    k, rows = int(np.searchsorted(places.first, at, "right")) - 1, []
    for i in code:
        value = i["literal_value"]
        if i["cls"] == "literal_load" and value is None and i["target"] is not None:
            value = places.word(i["target"])
        text = places.text(value) if i["cls"] == "literal_load" and value is not None else None
        rows.append(i | {"fn": row["entry"], "literal_value": value, "literal_text": text})
    return row | {"file_offset": places.code[k][4] + at - int(places.first[k])}, rows


def recovered(segments: DataFrame, decoder: Decoder = builtin) -> DataFrame:
    """(image_id, entry_addr, seg index, load_addr, executable, region, file_offset, data) -> one row an image: raw boundaries and instructions.

    An image without executable bytes, or with nothing recovered, has empty lists. Images are dealt to as many tasks as there are shuffle
    partitions, as their recovery costs far more than their bytes tell the planner.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    one = f"image_id string, rounds int, seeds_rejected int, seeds array<struct<origin:string,n:bigint>>, raw array<struct<{_typed(RAW)}>>, code array<struct<{_typed(CODE)}>>"
    kind = T._parse_datatype_string(one)
    schema, tasks = to_arrow_schema(kind), int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def one_image(name: str, rows: list[dict], explored: Explored) -> dict:
        rows = sorted(rows, key=lambda r: r["index"])
        places = Places([(r["load_addr"], r["data"] or b"", bool(r["executable"]), r["region"], r["file_offset"]) for r in rows], decoder)
        found = explored(places, rows[0]["entry_addr"])
        made = [located(places, row, code) for row, code in found["bodies"]]
        return {"image_id": name, "raw": [r for r, _ in made], "code": [{"image_id": name} | i for _, code in made for i in code]} | {k: found[k] for k in ("rounds", "seeds_rejected", "seeds")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explored = Explored()
        for batch in batches:
            made = []
            for name, parts in zip(*batch.columns, strict=True):
                made.append(one_image(name.as_py(), parts.as_py(), explored))
                if sum(len(m["code"]) for m in made) >= TOGETHER:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=schema)

    part = F.struct("entry_addr", "index", "load_addr", "executable", "region", "file_offset", "data")
    images = segments.repartition(tasks, "image_id").groupBy("image_id").agg(F.collect_list(part).alias("parts"))  # bytes move once
    return images.mapInArrow(run, kind)


def _typed(schema: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields)


# grades

TOLD = {"image_entry": "entry point of the image", "direct_call": "target of a direct call", "prologue_scan": "prologue found by scanning", "pointer": "pointer into code"}


def doubts() -> list[tuple[Column, Column]]:
    """(reason, whether it lowers the grade), the reason null where it doesn't apply."""
    share = F.col("reached_stretched") / F.col("size")
    opener, left = F.col("head").isin(STACK_OPENERS), F.col("tail_cls").isin("return", "jump", "jump_indirect")
    no_head = ~((F.col("head_cls") == "entry") | opener)
    return [
        (F.when(no_head, F.concat(F.lit("no prologue: begins with "), F.col("head"))), no_head),
        (F.when(~left, F.concat(F.lit("ends on "), F.col("tail"))), ~left),
        (F.when(share < REPORT, F.format_string("flow reached %d of %d bytes", F.col("reached_stretched"), F.col("size"))), share < PENALTY),
        (F.when(F.col("longest_data") > 3, F.format_string("%d bytes in a row are not code", F.col("longest_data"))), F.col("longest_data") > 3),
    ]


def graded(raw: DataFrame) -> DataFrame:
    """Raw boundaries with ``confidence`` and ``confidence_reasons``. Only what couldn't be decoded at all is low."""
    origin = F.coalesce(*[F.when(F.array_contains("origins", o), F.lit(text)) for o, text in TOLD.items()])
    opened = F.when(F.col("head_cls") == "entry", F.lit("windowed prologue")).when(F.col("head").isin(STACK_OPENERS), F.format_string("call0 prologue (%s)", F.col("head")))
    found = doubts()
    reasons = F.array_compact(F.array(origin, opened, *[reason for reason, _ in found]))
    lowered = found[0][1]
    for _, lower in found[1:]:
        lowered = lowered | lower
    blank = F.col("decoded") == 0
    grade = F.when(blank, "low").when(lowered, "medium").otherwise("high")
    return raw.withColumns({"confidence": grade, "confidence_reasons": F.when(blank, F.array(F.lit("nothing could be decoded"))).otherwise(reasons)})


def boundaries(images: DataFrame) -> DataFrame:
    """(image_id, entry, size, ...): one graded row a function."""
    facts = ["decoded", "head", "head_cls", "tail", "tail_cls", "longest_data"]
    return graded(images.select("image_id", "rounds", "seeds_rejected", F.inline("raw"))).drop(*facts)


def instructions(images: DataFrame) -> DataFrame:
    return images.select(F.inline("code"))


def statistics(rows: DataFrame, executable: DataFrame) -> DataFrame:
    """One row an image: counts by grade, thunks, bytes claimed, reached and executable, prologue kinds."""
    has = lambda start: F.exists("confidence_reasons", lambda r: r.startswith(start))
    df = rows.groupBy("image_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("confidence") == g).alias(f"{g}_confidence") for g in ("high", "medium", "low")],
        F.count_if("is_thunk").alias("thunks"),
        F.sum("size").alias("bytes_in_functions"),
        F.sum("reached_stretched").alias("bytes_reached"),
        F.sum("reached").alias("bytes_by_flow"),
        F.count_if(has("windowed")).alias("windowed_prologues"),
        F.count_if(has("call0")).alias("call0_prologues"),
    )
    return df.join(executable.where("executable").groupBy("image_id").agg(F.sum("length").alias("bytes_executable")), "image_id", "left")


def cautions(rows: DataFrame, executable: DataFrame) -> DataFrame:
    """(image_id, cautions): what makes an image's boundaries doubtful: rounds used up, little code claimed, many low grades."""
    used = rows.groupBy("image_id").agg(F.max("rounds").alias("rounds"))
    df = statistics(rows, executable).join(used, "image_id")
    told = F.array(
        F.when(F.col("rounds") >= ROUNDS, F.lit(f"code was still being found after {ROUNDS} rounds; functions are missing")),
        F.when(F.col("bytes_in_functions") < 0.7 * F.col("bytes_executable"), F.lit("less than 70 % of the executable bytes are claimed; a low match rate may be due to that")),
        F.when(F.col("low_confidence") > 0.1 * F.col("total"), F.lit("more than a tenth of the boundaries are of low confidence and can't match")),
    )
    return df.select("image_id", F.array_compact(told).alias("cautions"))


def seeds_by_origin(images: DataFrame) -> DataFrame:
    """(image_id, origin, n): how many places each way of seeding found, confirmed or not; one place may count under several."""
    return images.select("image_id", F.inline("seeds")).where("n > 0")
