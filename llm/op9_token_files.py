"""9. Token-id files coded by an adaptive, context-mixing range coder.

A file is a table of blocks in document order. A block holds up to `BLOCK` ids and is coded on
its own, from a fresh model, so blocks can be read, checked and lost one by one. Its record:

    magic "TIB1", count (4 bytes), crc32 of the ids (4), crc32 of the body (4), body

(little-endian; ids count as unsigned 32-bit integers in both sums). The body codes each id as one
symbol, with odds that mix four predictions:

* order 2: counts of up to four ids that followed the two ids before, the rarest gives way;
* order 1: the same after the id before;
* order 0: how often each id came in the block, counted again whenever a quarter more has come;
* static odds for every id, half uniform and half falling with its length in bits.

Their weights are learned as the block goes: one for order 0, one for the static odds, and one for
each of the other orders and how often its context has been seen, raised or lowered by how much
likelier than the mixture that prediction made the id. The range lists the ids of orders 2 and 1
first, each once and with the sum of what orders 0 to 2 give it, then those of order 0, then all. Contexts
are hashed into `_ROWS` rows for each order.

Blocks of a task are coded side by side: every step of the coder is a few array operations
over all of them. Ranges are integers; weights are single floats that are only added, multiplied, divided and
compared one by one in a fixed order, which IEEE 754 rounds alike, so writer and reader agree everywhere.

A part of the file is what one task codes: a range of document ids of about `PART_BYTES` of text (at
least as many parts as the session has shuffle partitions), so their number grows with the table.

Defined cases: a null text is empty and gives the end id alone; documents are in order of their id
(nulls first, then equal ids by their texts); repeated rows are documents of their own; an empty
table gives an empty file. A damaged block raises an error that names it.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.arrays import slices
from llm.tables import documents
from playbill.session import new_work_dir

MODEL, END = "byte_bpe_50k.json", 2
BLOCK = 4096
# Blocks that are coded side by side.
LANES = 2048
# Words whose ids a worker keeps: their letters and 32 for each word.
KNOWN = 1 << 24
# White space as Unicode defines it.
_SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
MAGIC = b"TIB1"
FILE = "part int, block int, record binary, doc_id long, first long, n_tokens long"
# Text of a part; the reader sends one row per part to its tasks (12 bytes: 38 MB for 100 TB).
PART_BYTES = 32 << 20
_ROWS_BITS = 11
_ROWS = 1 << _ROWS_BITS
_ROW = np.dtype("V16")
# Counts of single ids by their last bits, for ids that another order names.
_COMMON = 1 << 11
_SEEN, _FULL = 8, 250
# What the weights are scaled to in all.
_SCALE = 1 << 35
# Least and largest weight of a prediction.
_LEAST, _MOST = np.float32(1 / 64), np.float32(16)
_SLOTS = np.arange(8, dtype=np.int8)[:, None]
_FOUR = np.arange(4, dtype=np.uint16)[:, None]
# Static odds: half of them uniform, half spread evenly over the lengths of an id in bits.
_OCTAVES = np.array([0, *(1 << k for k in range(16))])
_WIDE = np.diff(np.r_[_OCTAVES, 1 << 16])
_OCTAVE_OF = np.repeat(np.arange(17), _WIDE)
_STATIC_EACH = 8 + (1 << 19) // 17 // _WIDE
_STATIC_FROM = np.cumsum(_STATIC_EACH * _WIDE) - _STATIC_EACH * _WIDE
_STATIC_ALL = int((_STATIC_EACH * _WIDE).sum())
_ONES = (1 << 64) - 1
_16, _48 = np.uint64(16), np.uint64(48)
_WORD, _NARROW = np.uint64(1 << 48), np.uint64(1 << 44)


class _Model:
    """State of the predictors of every lane, and the range of the id to come. `ranges` and `learn` are
    all that the writer and the reader share, and `ranges` does not look at the id to come. Lanes from
    `m` on have ended."""

    def __init__(self, lanes: int):
        # Of orders 2 and 1: four ids and their counts for each row.
        self.rows = np.zeros(2 * lanes * _ROWS, _ROW)
        self.counts = np.zeros(lanes * _COMMON, np.uint16)
        self.weights = np.ones(2 * lanes * _SEEN, np.float32)
        self.others = np.ones((2, lanes), np.float32)
        self.first = np.arange(2 * lanes).reshape(2, lanes) * _ROWS
        self.own = np.arange(2 * lanes).reshape(2, lanes) * _SEEN
        self.lanes = np.arange(lanes)
        self.own_counts = self.lanes * _COMMON
        self.key = np.zeros((2, lanes), np.uint32)
        self.t = self.size = 0

    def recount(self, ids: np.ndarray) -> None:
        """Order 0 from here on: `ids` so far, in order for each lane, with the start and the length of every run of equal ones."""
        self.size, m = ids.shape
        self.known = self.start = self.length = None  # frees what was counted before
        kind = np.int32 if m <= 1 << 14 else np.int64
        known = ids.T.astype(kind, order="C")
        known.sort(axis=1)
        known += (self.lanes[:m, None] << 16).astype(kind)
        self.known = known.reshape(-1)
        if self.size:
            starts = np.flatnonzero(np.r_[True, self.known[1:] != self.known[:-1]]).astype(kind)
            lengths = np.diff(np.r_[starts, kind(len(self.known))])
            self.start, self.length = np.repeat(starts, lengths), np.repeat(lengths, lengths)

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each of `ids`, a row per step: its place among the ids of order 0 and how often it is there."""
        steps, m = ids.shape
        place, often = np.zeros((2, steps, m), np.int32)
        bits = steps.bit_length()
        for a in range(0, m if self.size else 0, 256):  # lanes at a time, which bounds the keys held
            lanes = self.lanes[a : min(a + 256, m), None]
            keys = (ids[:, a : a + 256].T + (lanes << 16) << bits) + np.arange(steps)
            keys.sort(axis=1)
            step = keys & ((1 << bits) - 1)
            keys >>= bits
            at = np.searchsorted(self.known, keys.astype(self.known.dtype).reshape(-1)).reshape(keys.shape)
            np.minimum(at, len(self.known) - 1, out=at)
            place[step, lanes] = at - lanes * self.size
            often[step, lanes] = np.where(self.known[at] == keys, self.length[at], 0)
        return place, often

    def ranges(self, m: int) -> np.ndarray:
        """(11, m) running sums of the odds: four ids of order 2, four of order 1, all ids of order 0, all there are."""
        mixed = self.key[:, :m] * np.uint32(0x85EBCA6B)
        self.at = self.first[:, :m] + (mixed >> np.uint32(32 - _ROWS_BITS))
        rows = self.rows.take(self.at).view(np.uint16).reshape(2, m, 8)
        self.seen = np.ascontiguousarray(rows.transpose(0, 2, 1))
        ids, often = self.seen[:, :4], self.seen[:, 4:]
        total = often[:, 0] + often[:, 1]
        total += often[:, 2]
        total += often[:, 3]
        self.total = np.maximum(total, 1).astype(np.float32)
        self.place = self.own[:, :m] + np.minimum(total, _SEEN - 1)
        self.w = self.weights.take(self.place)
        use = self.w * (total > 0)
        zero, rest = self.others[:, :m]
        scale = use[0] + use[1]
        if self.size:
            scale += zero
        scale += rest
        scale = np.float32(_SCALE) / scale
        use *= scale
        use /= self.total
        mass = often * use[:, None]
        some = often > 0
        # An id of both orders stands with order 2.
        for k in range(4):
            same = ids[1] == ids[0, k]
            same &= some[0, k]
            same &= some[1]
            more = mass[1] * same
            mass[0, k] += more[0] + more[1] + (more[2] + more[3])
            some[1] &= ~same
        if self.size:
            common = self.counts.take((ids & np.uint16(_COMMON - 1)) + self.own_counts[:m]) * some
            mass += common * (zero * scale / np.float32(self.t))
            # What order 0 gives to these eight is not given to them once more.
            twice = np.add.reduce(common.reshape(8, m), axis=0, dtype=np.uint16) / np.float32(self.t)
            twice *= twice
            zero = zero * np.maximum(np.float32(1) - twice, _LEAST)
        mass *= some
        run = np.zeros((11, m), np.int64)
        run[1:9] = mass.reshape(8, m)
        for k in range(2, 9):
            run[k] += run[k - 1]
        self.each = np.maximum((zero * scale / np.float32(max(self.size, 1))).astype(np.int64), 1)
        self.unit = (rest * scale / np.float32(_STATIC_ALL)).astype(np.int64)
        np.add(run[8], self.each * self.size, out=run[9])
        np.add(run[9], self.unit * _STATIC_ALL, out=run[10])
        self.run = run
        return run

    def symbol(self, m: int, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids in whose odds the targets lie, with their places and numbers in order 0 where it holds them."""
        lanes = self.lanes[:m]
        slot = np.add.reduce(self.run[1:9] <= target, axis=0, dtype=np.int64)
        ids = self.seen[:, :4].reshape(8, m)[np.minimum(slot, 7), lanes].astype(np.int64)
        place, often = np.zeros((2, m), np.int64)
        far = np.flatnonzero(target >= self.run[9])
        spot = (target[far] - self.run[9, far]) // self.unit[far]
        octave = np.searchsorted(_STATIC_FROM, spot, "right") - 1
        ids[far] = (_OCTAVES[octave] + (spot - _STATIC_FROM[octave]) // _STATIC_EACH[octave])
        near = np.flatnonzero((slot == 8) & (target < self.run[9]))
        if len(near):
            first = near * self.size
            at = first + np.minimum((target[near] - self.run[8, near]) // self.each[near], self.size - 1)
            ids[near], place[near], often[near] = self.known[at] & 0xFFFF, self.start[at] - first, self.length[at]
        return ids, place, often

    def span(self, m: int, ids: np.ndarray, place: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the odds of `ids`."""
        self.hit = self.seen[:, :4] == ids.astype(np.uint16)
        self.hit &= self.seen[:, 4:] > 0
        self.any = self.hit[:, 0] | self.hit[:, 1] | self.hit[:, 2] | self.hit[:, 3]
        slots = self.hit.reshape(8, m)
        slot = np.add.reduce(slots[1:4] * _SLOTS[1:4], axis=0, dtype=np.int64)
        slot += np.add.reduce(slots[4:] * _SLOTS[4:], axis=0, dtype=np.int64) * ~self.any[0]
        octave = _OCTAVE_OF[ids]
        here, lanes = self.any[0] | self.any[1], self.lanes[:m]
        at = slot * m + lanes
        flat = self.run.reshape(-1)
        start = flat.take(at)
        at += m
        size = flat.take(at) - start
        self.static = _STATIC_EACH[octave]
        far = (_STATIC_FROM[octave] + (ids - _OCTAVES[octave]) * self.static) * self.unit
        held = often > 0
        start = np.where(here, start, np.where(held, self.run[8] + place * self.each, self.run[9] + far))
        size = np.where(here, size, np.where(held, often * self.each, self.static * self.unit))
        return start, size

    def learn(self, m: int, ids: np.ndarray, size: np.ndarray) -> None:
        """The id that came and its odds."""
        likely = (self.run[10] / size).astype(np.float32)
        likely *= np.float32(1 / 16)
        often = self.seen[:, 4:]
        chosen = often * self.hit
        came = (chosen[:, 0] + chosen[:, 1] + (chosen[:, 2] + chosen[:, 3])) / self.total
        came *= likely
        np.minimum(came, np.float32(0.5), out=came)
        came += np.float32(15 / 16)
        came *= self.w
        self.weights[self.place] = np.minimum(np.maximum(came, _LEAST, out=came), _MOST, out=came)
        at = (ids & (_COMMON - 1)) + self.own_counts[:m]
        common = self.counts.take(at)
        self.counts[at] = common + np.uint16(1)
        came = np.empty((2, m), np.float32)
        np.multiply(common, np.float32(1 / max(self.t, 1)), out=came[0])
        np.multiply(self.static, np.float32(1 / _STATIC_ALL), out=came[1], casting="unsafe")
        came *= likely
        np.minimum(came, np.float32(0.5), out=came)
        came += np.float32(15 / 16)
        others = self.others[:, :m]
        first = 0 if self.size else 1
        others[first:] *= came[first:]
        np.minimum(np.maximum(others, _LEAST, out=others), _MOST, out=others)
        # The rarest of the four gives way to an id that is not among them.
        rank = (often << 2) + _FOUR
        least = np.minimum(np.minimum(rank[:, 0], rank[:, 1]), np.minimum(rank[:, 2], rank[:, 3]))
        fresh = rank == least[:, None]
        fresh &= ~self.any[:, None]
        np.copyto(self.seen[:, :4], ids.astype(np.uint16), where=fresh)
        often *= ~fresh
        often += fresh
        often += self.hit
        most = often.max(axis=1)
        if most.max() > _FULL:
            often >>= (most > _FULL)[:, None]
        self.rows[self.at] = np.ascontiguousarray(self.seen.transpose(0, 2, 1)).view(_ROW)[..., 0]
        # Contexts of what follows.
        new = ids.astype(np.uint32)
        own = new * np.uint32(0x27D4EB2F)
        self.key[0, :m] = own + self.key[1, :m] * np.uint32(0x165667B1) + np.uint32(0x3C6EF372)
        self.key[1, :m] = own + np.uint32(0x1B873593)
        self.t += 1


class _Range:
    """Range coder of 64 bits, one lane per block; words of 16 bits leave it. A range that is narrow
    but lies across a word's edge keeps its larger side."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.high = np.full(lanes, _ONES, np.uint64)

    def part(self, m: int, total: np.ndarray) -> np.ndarray:
        self.each = (self.high[:m] - self.low[:m]) // total.astype(np.uint64)
        return self.each

    def narrow(self, m: int, start: np.ndarray, size: np.ndarray) -> None:
        low, high = self.low[:m], self.high[:m]
        low += self.each * start.astype(np.uint64)
        np.add(low, self.each * size.astype(np.uint64) - np.uint64(1), out=high)
        lanes = np.flatnonzero(((low ^ high) < _WORD) | ((high - low) < _NARROW))
        while len(lanes):
            a, b = low[lanes], high[lanes]
            edge = b >> _48 << _48
            across = np.flatnonzero(edge > a)
            if len(across):
                x, y, e = a[across], b[across], edge[across]
                upper = y - e >= e - x
                a[across], b[across] = np.where(upper, e, x), np.where(upper, y, e - np.uint64(1))
            self.word(lanes, a)
            a <<= _16
            b <<= _16
            b |= np.uint64(0xFFFF)
            low[lanes], high[lanes] = a, b
            lanes = lanes[((a ^ b) < _WORD) | ((b - a) < _NARROW)]

    def word(self, lanes: np.ndarray, low: np.ndarray) -> None:
        raise NotImplementedError


class _Writer(_Range):
    def __init__(self, lanes: int, room: int):
        super().__init__(lanes)
        self.out = np.zeros((lanes, room), ">u2")
        self.n = np.zeros(lanes, np.int64)

    def word(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.n[lanes]
        if at.max() >= self.out.shape[1]:
            self.out = np.pad(self.out, ((0, 0), (0, self.out.shape[1])))
        self.out[lanes, at] = low >> _48
        self.n[lanes] = at + 1

    def close(self) -> list[bytes]:
        """The words, and the fewest bytes that stay in the range whatever follows them is taken for zeros."""
        bodies = []
        for i, (low, high, n) in enumerate(zip(self.low.tolist(), self.high.tolist(), self.n.tolist())):
            size = next(k for k in range(9) if -(-low >> 64 - 8 * k) << 64 - 8 * k <= high)
            bodies.append(self.out[i, :n].tobytes() + (-(-low >> 64 - 8 * size)).to_bytes(size, "big"))
        return bodies


class _Reader(_Range):
    def __init__(self, bodies: list[bytes]):
        super().__init__(len(bodies))
        self.data = np.zeros((len(bodies), max(map(len, bodies)) // 2 + 6), ">u2")
        raw = self.data.view(np.uint8)
        for i, b in enumerate(bodies):
            raw[i, : len(b)] = np.frombuffer(b, np.uint8)
        self.code = np.zeros(len(bodies), np.uint64)
        for k in range(4):
            self.code = self.code << _16 | self.data[:, k].astype(np.uint64)
        self.n = np.full(len(bodies), 4)

    def target(self, m: int, total: np.ndarray) -> np.ndarray:
        return np.minimum(((self.code[:m] - self.low[:m]) // self.part(m, total)).astype(np.int64), total - 1)

    def word(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = np.minimum(self.n[lanes], self.data.shape[1] - 1)
        self.code[lanes] = self.code[lanes] << _16 | self.data[lanes, at].astype(np.uint64)
        self.n[lanes] += 1


def _longest_first(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Lanes by falling size, and for every step the number of lanes that still go on."""
    size = np.array(sizes)
    order = np.argsort(-size, kind="stable")
    steps = np.arange(int(size.max(initial=0)))
    return order, len(size) - np.searchsorted(np.sort(size), steps, "right")


def _counted(t: int) -> int:
    """When order 0 is counted again after step t."""
    return t + max(8, t // 4)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Bodies of blocks of ids below 65536."""
    order, going = _longest_first([len(b) for b in blocks])
    ids = np.zeros((len(going), len(blocks)), np.int32)
    for lane, i in enumerate(order.tolist()):
        ids[: len(blocks[i]), lane] = blocks[i]
    model, out, until = _Model(len(blocks)), _Writer(len(blocks), len(going) + 8), 0
    for t, m in enumerate(going.tolist()):
        if t == until:
            since, until = t, _counted(t)
            model.recount(ids[:t, :m])
            places, often = model.found(ids[t:until, :m])
        now = ids[t, :m]
        run = model.ranges(m)
        start, size = model.span(m, now, places[t - since, :m], often[t - since, :m])
        out.part(m, run[10])
        out.narrow(m, start, size)
        model.learn(m, now, size)
    bodies: list[bytes] = [b""] * len(blocks)
    for i, body in zip(order.tolist(), out.close()):
        bodies[i] = body
    return bodies


def decode_blocks(bodies: list[bytes], counts: list[int]) -> list[np.ndarray]:
    if not bodies:
        return []
    order, going = _longest_first(counts)
    ids = np.zeros((len(going), len(bodies)), np.int32)
    model, src, until = _Model(len(bodies)), _Reader([bodies[i] for i in order.tolist()]), 0
    for t, m in enumerate(going.tolist()):
        if t == until:
            until = _counted(t)
            model.recount(ids[:t, :m])
        run = model.ranges(m)
        now, place, often = model.symbol(m, src.target(m, run[10]))
        start, size = model.span(m, now, place, often)
        src.narrow(m, start, size)
        model.learn(m, now, size)
        ids[t, :m] = now
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(bodies)
    for lane, i in enumerate(order.tolist()):
        out[i] = ids[: counts[i], lane].astype(np.int64)
    return out


def pack(ids: np.ndarray, body: bytes) -> bytes:
    raw = ids.astype("<u4").tobytes()
    return MAGIC + struct.pack("<III", len(ids), zlib.crc32(raw), zlib.crc32(body)) + body


def unpack(records: list[bytes]) -> list[np.ndarray]:
    """Ids of every record; both checksums are verified."""
    heads = []
    for k, r in enumerate(records):
        if r[:4] != MAGIC or len(r) < 16 or zlib.crc32(r[16:]) != struct.unpack("<I", r[12:16])[0]:
            raise ValueError(f"block {k} of this batch is damaged")
        heads.append(struct.unpack("<II", r[4:12]))
    out = decode_blocks([r[16:] for r in records], [h[0] for h in heads])
    for k, (ids, (_, crc)) in enumerate(zip(out, heads)):
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k} of this batch does not decode to what was written")
    return out


@lru_cache(maxsize=1)
def _word_pattern() -> re.Pattern:
    """`public_tokenizers.PATTERN` with its classes spelled out, which `re` looks up at once for 16 bits. Larger code
    points and those that Python does not know are in no class: a text that holds some is not spelled by its words."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "C": []}
    names = "".join("S" if chr(c) in _SPACE else "C" if (k := unicodedata.category(chr(c))) == "Cn" else k[0] if k[0] in "LN" else "O" for c in range(0x10000))
    for run in re.finditer(r"L+|N+|C+", names):
        kinds[run[0][0]].append(f"\\U{run.start():08x}-\\U{run.end() - 1:08x}")
    L, N, C = ("".join(kinds[k]) for k in "LNC")
    C += "\\U00010000-\\U0010ffff"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{_SPACE}{L}{N}{C}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class _Encoder:
    """Ids by the library. Where it cuts texts by `public_tokenizers.PATTERN`, it is asked once for each
    word that a task meets (until `KNOWN` is full), else and for texts with special strings for the whole text."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        cut = spec["pre_tokenizer"] or {}
        self.by_word = (spec["normalizer"] is None and (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) == ("ByteLevel", True, False)
                        and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {}
        self.room = KNOWN

    def ask(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}H", *ids) for ids in (c.ids for c in self.library.encode_batch_fast(texts, add_special_tokens=False))]

    def words(self, text: str) -> list[str] | None:
        if not self.by_word or any(s in text for s in self.special):
            return None
        found = _word_pattern().findall(text)
        return found if sum(map(len, found)) == len(text) else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 16-bit integers."""
        words = [self.words(t) for t in texts]
        met = set().union(*(w for w in words if w is not None))
        fresh = list(met.difference(self.known))
        self.room -= sum(map(len, fresh)) + 32 * len(fresh)
        if self.room < 0:
            self.known.clear()
            self.room, fresh = KNOWN - sum(map(len, met)) - 32 * len(met), list(met)
        self.known.update(zip(fresh, self.ask(fresh)))
        whole = iter(self.ask([t for t, w in zip(texts, words) if w is None]))
        return [next(whole) if w is None else b"".join(map(self.known.__getitem__, w)) for w in words]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def token_ids(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, ids): ids of every whole text with the end id, as little-endian unsigned 16-bit integers."""
    picked = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        last = np.array([end], "<u2").tobytes()
        encoder = _encoder(path or public_tokenizers.path(MODEL))  # of the machine that runs the task
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                coded = encoder.encode(part.column("text").fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([c + last for c in coded], pa.binary())], ["doc_id", "ids"])

    return picked.mapInArrow(run, "doc_id long, ids binary")


def write_token_files(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> None:
    """Writes the file under `path`: rows of kind `blocks` (part, block, record) and of kind `docs` (part, doc_id,
    first, n_tokens, and the block that holds the first id). Parts follow the order of ids."""
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if parts is None:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(-(-size // PART_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Texts are dealt, not their ids: finding the ranges reads the rows once more, and must not tokenize them.
    ordered = token_ids(texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "record", "doc_id", "first", "n_tokens"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        part = TaskContext.get().partitionId()
        state = {"first": 0, "block": 0}
        waiting: list[tuple[int, np.ndarray]] = []
        rest: list[np.ndarray] = []

        def rows(cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        def code() -> Iterator[pa.RecordBatch]:
            if waiting:
                bodies = encode_blocks([w[1] for w in waiting])
                none = [None] * len(bodies)
                yield rows([[part] * len(bodies), [w[0] for w in waiting], [pack(w[1], b) for w, b in zip(waiting, bodies)], none, none, none])
                waiting.clear()

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            if rest and (final or sum(map(len, rest)) >= BLOCK):
                flat = np.concatenate(rest)
                rest.clear()
                for a in range(0, len(flat), BLOCK):
                    piece = flat[a : a + BLOCK]
                    if len(piece) < BLOCK and not final:
                        rest.append(piece)
                        break
                    waiting.append((state["block"], piece))
                    state["block"] += 1
                    if len(waiting) >= LANES:
                        yield from code()

        for batch in batches:
            docs: list[tuple] = []
            for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                one = np.frombuffer(raw, "<u2")
                docs.append((part, state["first"] // BLOCK, None, d, state["first"], len(one)))
                state["first"] += len(one)
                rest.append(one)
                yield from cut(False)
            if docs:
                yield rows(list(map(list, zip(*docs))))
        yield from cut(True)
        yield from code()

    made = ordered.mapInArrow(run, FILE)
    both = made.withColumn("kind", F.when(F.col("record").isNull(), "docs").otherwise("blocks"))
    both.write.partitionBy("kind").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids (little-endian unsigned 32-bit integers)
    and the place of its first one in the whole file."""
    rows = spark.read.schema(FILE + ", kind string").parquet(path)
    # One row per part: their number is fixed by the writer, not by the documents.
    sizes = rows.where("kind = 'docs'").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    parts = (rows.where("kind = 'docs'").agg(F.max("part")).first()[0] or 0) + 1
    ordered = rows.drop("kind").repartitionById(parts, F.col("part")).sortWithinPartitions("part", "block", F.col("record").isNull(), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple] = []
        records: list[bytes] = []
        state = {"part": None, "at": 0, "ids": np.zeros(0, np.int64)}

        def flush() -> Iterator[pa.RecordBatch]:
            fresh = unpack(records)
            records.clear()
            ids = np.concatenate([state["ids"], *fresh])
            out, k = [], 0
            while k < len(docs) and docs[k][1] + docs[k][2] <= state["at"] + len(ids):
                d, first, n = docs[k]
                out.append((state["part"], d, first, n, ids[first - state["at"] : first - state["at"] + n].astype("<u4").tobytes()))
                k += 1
            del docs[:k]
            keep = docs[0][1] if docs else state["at"] + len(ids)
            state["ids"], state["at"] = ids[keep - state["at"] :], keep
            if out:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], ["part", "doc_id", "first", "n_tokens", "ids"])

        for batch in batches:
            for p, record, d, first, n in zip(*(batch.column(c).to_pylist() for c in ("part", "record", "doc_id", "first", "n_tokens"))):
                if p != state["part"]:
                    yield from flush()
                    state.update(part=p, at=0, ids=np.zeros(0, np.int64))
                if record is None:
                    docs.append((d, first, n))
                else:
                    records.append(record)
                    if len(records) >= LANES:
                        yield from flush()
        yield from flush()

    read = ordered.mapInArrow(run, "part int, doc_id long, first long, n_tokens long, ids binary")
    return read.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_work_dir(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
