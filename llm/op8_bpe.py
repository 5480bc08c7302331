"""8. BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one possible last token. An automaton over
the vocabulary with suffix links lists the tokens that end at a place, longest first;
the first one that is compatible with the last token of the prefix before it is stored.
Following those tokens back from the word's end gives the ids.

Two tokens are compatible when no merge would ever cross the border between them. Going
back in time along the right edge of the first and the left edge of the second, each
pair of neighbours that lived together is looked up: a merge of theirs that comes before
both were used up rules the pair out.

Defined cases: a null text is empty (no ids, empty text); rows pass through one to one;
special strings inside a text are their own id. `ids` are little-endian unsigned 32-bit
integers, end to end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.arrays import slices
from llm.tables import documents
from llm.wordpieces import PairTable, Vocabulary, symbols

MODEL = "word_bpe_49k.json"
# Words whose ids one Python worker remembers.
REMEMBERED = 150_000
_NEVER = np.iinfo(np.int64).max


class Coder:
    """The vocabulary with its automaton and the two edges of every token."""

    def __init__(self, path: str):
        self.vocab = v = Vocabulary(path)
        self.born = np.full(v.size, -1, np.int64)
        self.first, self.last = np.zeros((2, v.size), np.int64)
        self.born[v.made[::-1]] = np.arange(len(v.made))[::-1]
        at = v.made
        self.first[at], self.last[at] = v.left[self.born[at]], v.right[self.born[at]]
        texts: dict[int, tuple[int, ...]] = {int(t): (s,) for s, t in enumerate(v.symbol_ids)}
        for a, b, m in zip(v.left.tolist(), v.right.tolist(), v.made.tolist()):
            texts.setdefault(m, texts[a] + texts[b])
        self.length = np.zeros(v.size, np.int64)
        for token, text in texts.items():
            self.length[token] = len(text)
        self._automaton(self._reached(texts))

    def _reached(self, texts: dict[int, tuple[int, ...]]) -> dict[int, tuple[int, ...]]:
        """Tokens that the merges can end with: those whose two parts are compatible but
        for the merge that makes the token itself."""
        v = self.vocab
        at = np.array(sorted(m for m in texts if self.born[m] >= 0), np.int64)
        fine = self.compatible(self.first[at], self.last[at], self.born[at])
        return {t: s for t, s in texts.items() if self.born[t] < 0 or t in set(at[fine].tolist())} if not fine.all() else texts

    def _automaton(self, texts: dict[int, tuple[int, ...]]) -> None:
        step: dict[int, int] = {}
        ends, depth, parent, symbol = [-1], [0], [0], [0]
        for token, text in texts.items():
            node = 0
            for s in text:
                key = node * 512 + s
                if key not in step:
                    step[key] = len(ends)
                    ends.append(-1)
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    symbol.append(s)
                node = step[key]
            ends[node] = token
        link, longest, shorter = [0] * len(ends), list(ends), [-1] * len(ends)
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            at = link[parent[node]]
            if parent[node]:
                while at and at * 512 + symbol[node] not in step:
                    at = link[at]
                link[node] = step.get(at * 512 + symbol[node], 0)
            below = longest[link[node]]
            shorter[node] = below
            longest[node] = ends[node] if ends[node] >= 0 else below
        keys = np.fromiter(step.keys(), np.int64, len(step))
        self._to = np.r_[np.fromiter(step.values(), np.int64, len(step)), -1]
        self._step = PairTable(keys // 512, keys % 512, 512)
        self._link, self._longest = np.array(link), np.array(longest)
        # The next shorter token with the same end, by token.
        self._shorter = np.full(self.vocab.size, -1, np.int64)
        for node, token in enumerate(ends):
            if token >= 0:
                self._shorter[token] = shorter[node]

    def compatible(self, one: np.ndarray, two: np.ndarray, but: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE leaves the border between each pair of tokens; `but`: a merge to overlook."""
        fine = np.ones(len(one), bool)
        at, a, b = np.arange(len(one)), one.copy(), two.copy()
        a_ends, b_ends = np.full((2, len(one)), _NEVER)
        if but is not None:
            a_ends, b_ends = but.copy(), but - 1
        while len(at):
            rank = self.vocab.rank(a, b)
            crossed = (rank < len(self.vocab.made)) & (rank < a_ends) & (rank <= b_ends)
            fine[at[crossed]] = False
            born_a, born_b = self.born[a], self.born[b]
            undo_a = born_a > born_b
            on = ~crossed & (undo_a | (born_b >= 0))
            at, a, b, a_ends, b_ends, undo_a = at[on], a[on], b[on], a_ends[on], b_ends[on], undo_a[on]
            a_ends, b_ends = np.where(undo_a, born_a[on], a_ends), np.where(undo_a, b_ends, born_b[on])
            a, b = np.where(undo_a, self.last[a], a), np.where(undo_a, b, self.first[b])
        return fine

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, word offsets)."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        order = sorted(range(len(words)), key=lambda i: -len(words[i].encode("utf-8", "surrogatepass")))
        flat, offsets = symbols([words[i] for i in order])
        length, base = np.diff(offsets), offsets[:-1]
        last = np.full(len(flat), -1, np.int64)
        count = np.zeros(len(flat), np.int64)
        state = np.zeros(len(words), np.int64)
        for i in range(int(length[0])):
            n = int(np.searchsorted(-length, -i, "left"))  # words longer than i
            state = self._next(state[:n], flat[base[:n] + i])
            token, row = self._longest[state], np.arange(n)
            while len(row):
                before = i - self.length[token]
                fine = before < 0
                check = np.flatnonzero(~fine)
                place = base[row[check]] + before[check]
                fine[check] = (last[place] >= 0) & self.compatible(np.maximum(last[place], 0), token[check])
                here = base[row[fine]] + i
                last[here] = token[fine]
                count[here] = np.where(before[fine] < 0, 0, count[np.maximum(base[row[fine]] + before[fine], 0)]) + 1
                token, row = self._shorter[token[~fine]], row[~fine]
                token, row = token[token >= 0], row[token >= 0]
        total = count[offsets[1:] - 1]
        ends = np.cumsum(total)
        ids = np.zeros(int(ends[-1]), np.int64)
        row, place, slot = np.arange(len(words)), offsets[1:] - 1, ends - 1
        while len(row):
            ids[slot] = last[place]
            place = place - self.length[last[place]]
            on = place >= base[row]
            row, place, slot = row[on], place[on], slot[on] - 1
        # Back to the order of `words`.
        back = np.argsort(np.array(order))
        starts, size = (ends - total)[back], total[back]
        out = np.r_[0, np.cumsum(size)]
        return ids[np.repeat(starts - out[:-1], size) + np.arange(len(ids))], out

    def _next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int64)
        at, state = np.arange(len(state)), state.copy()
        while len(at):
            to = self._to[self._step.find(state, symbol[at])]
            hit = to >= 0
            out[at[hit]] = to[hit]
            on = ~hit & (state > 0)
            at, state = at[on], self._link[state[on]]
        return out


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _fields(df: DataFrame, keep: tuple[str, ...], more: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), more])


def encode_texts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """`keep` columns of `df` with n_tokens and `ids`."""
    path = path or public_tokenizers.path(MODEL)
    picked = df.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        special = {s: int(i).to_bytes(4, "little") for s, i in code.vocab.specials.items()}
        known: dict[str, bytes] = {}
        for batch in batches:
            for part in slices(batch, "_text"):
                split = [code.vocab.words(t) for t in part.column("_text").fill_null("").to_pylist()]
                fresh = set().union(*split) - known.keys() - special.keys()
                if len(known) + len(fresh) > REMEMBERED:
                    known, fresh = {}, set().union(*split) - special.keys()
                fresh = list(fresh)
                ids, at = code.encode(fresh)
                raw, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
                known.update(zip(fresh, (raw[a:b] for a, b in zip(at, at[1:]))))
                known.update(special)
                out = [b"".join(map(known.__getitem__, ws)) for ws in split]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())],
                    [*keep, "n_tokens", "ids"])

    return picked.mapInArrow(run, _fields(picked, keep, "n_tokens long, ids binary"))


def decode_ids(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """`keep` columns of `df` with the `text` that its ids stand for: the tokens as the file
    writes them, with one space between two, as the file names no decoder. Null ids give null."""
    path = path or public_tokenizers.path(MODEL)
    picked = df.select(*keep, F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = np.array(coder(path).vocab.text, object)
        for batch in batches:
            for part in slices(batch, "_ids"):
                out = [None if x is None else " ".join(text[np.frombuffer(x, "<u4")].tolist()) for x in part.column("_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "text"])

    return picked.mapInArrow(run, _fields(picked, keep, "text string"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(documents(spark, sf_dir))
    decoded = decode_ids(coded, keep=("doc_id", "n_tokens", "ids"))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
