"""11. Cross-tokenizer alignment by sparse products of token-byte incidences.

Tokenizer A is a byte-level BPE file, read by `tokenizers` or by `tiktoken`, which gives the same
ids faster where merges follow the ids; B is a sentencepiece model. Both spell " " + text in bytes.
With A and B the incidences of tokens and bytes (rows of CSR matrices):

* the rows of A.B' (Gustavson) are the overlap links: pairs of tokens that share bytes, and how many;
* overlap links whose two ends fall together cut the text into groups;
* with GA and GB the incidences of tokens and groups, GA.GB' holds the links inside a group.

A pair of ids that ends together spells one string that ends in the other, so whatever the corpus,
there are no more such pairs than (A id, B id) with one a suffix of the other, at most
twice the bytes of both vocabularies. The table of corpus-wide counts is that small, and is sent to the tasks.

Defined cases: texts that are null, empty or not spelled back by both tokenizers have no tokens (zeros and
an empty `groups_sha256`); strings of special tokens are plain text; repeated rows count and are returned
each; a null id is an id like any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.arrays import ragged, slices
from llm.csr import CSR
from llm.tables import documents, stored
from llm.wordpieces import byte_letters

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Runs of white space that tiktoken's pattern engine does not stand.
_LONG_SPACE = re.compile(r"\s{50000}")
SEPARATORS = ",|;"
# Id pairs a task counts before it hands them on.
PAIRS = 1_000_000
# Bytes of text that are aligned at a time.
SLICE = 250_000


def _path(model: str) -> str:
    """A file's place on the machine that asks: a name of the tokenizers' folder, or a path."""
    return model if os.path.isabs(model) else public_tokenizers.path(model)


class _Bytes:
    """The bytes that every id of a vocabulary stands for."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.r_[0, np.cumsum(self.length)]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.first[ids], self.length[ids])]


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        value = {c: b for b, c in enumerate(byte_letters())}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(map(value.__getitem__, token))
        self.bytes = _Bytes(tokens)
        self._path, self._library = path, None
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self._fast = None
        if made == sorted(made) and len(set(made)) == len(made) and len(made) + 256 == len(vocab):
            self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                           mergeable_ranks={t: i for i, t in enumerate(tokens) if t})

    @property
    def library(self) -> Tokenizer:
        if self._library is None:
            self._library = Tokenizer.from_file(self._path)
            self._library.encode_special_tokens = True
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def encode(self, text: str) -> np.ndarray:
        if self._fast is None or _LONG_SPACE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
        return self._fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class Pieces:
    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            tokens.append(bytes([int(piece[3:-1], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = _Bytes(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> tuple[ByteBPE, Pieces]:
    return ByteBPE(_path(a)), Pieces(_path(b))


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    first = np.r_[0, np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))]
    return (np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)), first


class Alignment:
    """The tokens of both sides of some texts, their links and groups, as arrays over all texts.

    `a`, `b`: ids; `a_first`, `b_first`: first token of every text plus the total.
    """

    def __init__(self, models: tuple[ByteBPE, Pieces], texts: list[str | None]):
        model_a, model_b = models
        spaced = [" " + t if t else "" for t in texts]
        raw_a = [model_a.encode(t) if t else [] for t in spaced]
        raw_b = model_b.encode([t or "" for t in texts])
        raw_b = [r if t else [] for r, t in zip(raw_b, spaced)]
        good = self._spelled(model_a.bytes, raw_a, spaced) & self._spelled(model_b.bytes, raw_b, spaced)
        self.a, self.a_first = _flat([r if g else [] for r, g in zip(raw_a, good)])
        self.b, self.b_first = _flat([r if g else [] for r, g in zip(raw_b, good)])
        size_a, size_b = model_a.bytes.length[self.a], model_b.bytes.length[self.b]
        self.a_bytes = CSR.of_owner(np.repeat(np.arange(len(self.a)), size_a), len(self.a))
        self.b_bytes = CSR.of_owner(np.repeat(np.arange(len(self.b)), size_b), len(self.b))
        # Links that end together, and with them the groups they close.
        link_a, link_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, col, _ in self.overlaps():
            together = self.a_bytes.first[row + 1] == self.b_bytes.first[col + 1]
            link_a.append(row[together])
            link_b.append(col[together])
        self.link_a, self.link_b = np.concatenate(link_a), np.concatenate(link_b)
        groups = len(self.link_a)
        self.a_groups = CSR.of_owner(np.searchsorted(self.link_a, np.arange(len(self.a))), groups)  # group x token
        self.b_groups = CSR.of_owner(np.searchsorted(self.link_b, np.arange(len(self.b))), groups)

    @staticmethod
    def _spelled(vocabulary: _Bytes, rows: list, texts: list[str]) -> np.ndarray:
        """Which texts their tokens spell, byte by byte."""
        ids, first = _flat(rows)
        want = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.r_[0, np.cumsum(vocabulary.length[ids])][first]
        size = np.fromiter(map(len, want), np.int64, len(want))
        got = vocabulary.spelled(ids)
        if np.array_equal(np.diff(ends), size) and got.tobytes() == b"".join(want):
            return np.ones(len(texts), bool)
        return np.array([got[ends[k] : ends[k + 1]].tobytes() == w for k, w in enumerate(want)], bool)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (A token, B token, bytes that both cover), in order of the text."""
        for row, block in self.a_bytes.product(self.b_bytes.transposed()):
            yield row + np.repeat(np.arange(block.rows), np.diff(block.first)), block.at, block.value

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (A token, B token, 1) inside one group."""
        for row, block in self.a_groups.transposed().product(self.b_groups):
            yield row + np.repeat(np.arange(block.rows), np.diff(block.first)), block.at, block.value

    def n_shared(self) -> np.ndarray:
        """How many shared-group links every text has: the size of the product, without making it."""
        run = np.r_[0, np.cumsum(self.a_groups.transposed().expanded(self.b_groups))]
        return run[self.a_first[1:]] - run[self.a_first[:-1]]

    def link_first(self) -> np.ndarray:
        """First link (and group) of every text plus the total."""
        return np.searchsorted(self.link_a, self.a_first)

    def group_texts(self, digits: _Digits) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` for every text."""
        # All tokens group by group, A's before B's.
        order = np.argsort(np.r_[np.repeat(np.arange(self.a_groups.rows), np.diff(self.a_groups.first)) * 2,
                                 np.repeat(np.arange(self.b_groups.rows), np.diff(self.b_groups.first)) * 2 + 1], kind="stable")
        mark = np.zeros(len(order), np.int64)  # a comma, unless last of a group's side
        mark[self.link_a], mark[len(self.a) + self.link_b] = 1, 2
        flat, ends = digits.write(np.r_[self.a, self.b][order], mark[order])
        cut = np.r_[0, ends][self.a_first + self.b_first]
        return [flat[s : max(e - 1, s)] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]


class _Digits:
    """Ids in decimal, each followed by one of `SEPARATORS`."""

    def __init__(self, ids: int):
        wide = len(str(ids)) + 1
        words = [f"{i}{s}".ljust(wide, "\0").encode() for s in SEPARATORS for i in range(ids)]
        self._ids, self._table = ids, np.frombuffer(b"".join(words), np.uint8).reshape(-1, wide)

    def write(self, ids: np.ndarray, mark: np.ndarray) -> tuple[bytes, np.ndarray]:
        rows = self._table[mark * self._ids + ids]
        used = rows != 0
        return rows[used].tobytes(), np.cumsum(used.sum(1))


@lru_cache(maxsize=2)
def _digits(ids: int) -> _Digits:
    return _Digits(ids)


def _kinds(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]


def align(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), a: str = MODEL_A, b: str = MODEL_B) -> DataFrame:
    """`keep` columns with n_a, n_b, n_groups, n_links, n_shared, groups_sha256 and `links`: the id pair of
    every link that ends together, as a binary of unsigned little-endian numbers a * (ids of B) + b."""
    picked = df.select(*keep, F.col(text).alias("_text"))
    names = [*keep, "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = tokenizers(a, b)
        width = len(models[1].bytes.length)
        digits = _digits(max(len(models[0].bytes.length), width))
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                al = Alignment(models, part.column("_text").to_pylist())
                groups = [hashlib.sha256(g).hexdigest() if g else "" for g in al.group_texts(digits)]
                pairs = (al.a[al.link_a] * width + al.b[al.link_b]).astype("<u8")
                cut = al.link_first()
                links = [pairs[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:])]
                n = pa.array(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(np.diff(al.a_first)), pa.array(np.diff(al.b_first)), n, n,
                     pa.array(al.n_shared()), pa.array(groups, pa.string()), pa.array(links, pa.binary())], names)

    return picked.mapInArrow(run, ", ".join([*_kinds(picked, keep), "n_a long, n_b long, n_groups long, n_links long, n_shared long",
                                             "groups_sha256 string, links binary"]))


def link_rows(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), a: str = MODEL_A, b: str = MODEL_B,
              shared: bool = False) -> DataFrame:
    """One row per overlap link, or per shared-group link: `keep` columns, the tokens' places and ids
    (a_at, a_id, b_at, b_id) and `weight` (bytes that both cover, or 1)."""
    picked = df.select(*keep, F.col(text).alias("_text"))
    names = [*keep, "a_at", "a_id", "b_at", "b_id", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = tokenizers(a, b)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                al = Alignment(models, part.column("_text").to_pylist())
                for i, j, weight in al.shared() if shared else al.overlaps():
                    row = np.searchsorted(al.a_first, i, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c).take(pa.array(row)) for c in keep), pa.array(i - al.a_first[row]), pa.array(al.a[i]),
                         pa.array(j - al.b_first[row]), pa.array(al.b[j]), pa.array(weight)], names)

    return picked.mapInArrow(run, ", ".join([*_kinds(picked, keep), "a_at long, a_id long, b_at long, b_id long, weight long"]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of all rows hold an id pair. A task adds up its own links first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

        for batch in batches:
            found, times = np.unique(_links(batch.column("links"))[0], return_counts=True)
            both = np.r_[pairs, found]
            pairs, of = np.unique(both, return_inverse=True)
            counts = np.bincount(of, np.r_[counts, times], len(pairs)).astype(np.int64)
            if len(pairs) > PAIRS:
                yield out()
                pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(pairs):
            yield out()

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of all rows, first pair of every row plus the total)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), "<u8").astype(np.int64), (offsets - offsets[0]) // 8


def score_links(aligned: DataFrame, keep: tuple[str, ...] = ("doc_id",), b: str = MODEL_B) -> DataFrame:
    """`aligned` (stored rows of `align`) with n_best and count_sum in place of `links`."""
    width = len(tokenizers(MODEL_A, b)[1].bytes.length)
    counts = pair_counts(aligned).withColumn("b", F.col("pair") % width)
    most = F.max("n").over(W.partitionBy("b"))
    # Bounded by the vocabularies, see above.
    table = counts.select("pair", "n", (F.col("n") == most).alias("best")).toArrow().sort_by("pair")
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    rest = tuple(c for c in aligned.columns if c != "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        best = best.astype(np.int64)
        for batch in batches:
            links, first = _links(batch.column("links"))
            at = np.searchsorted(pair, links)
            sums = []
            for value in (best, n):
                run = np.r_[0, np.cumsum(value[at])]
                sums.append(pa.array(run[first[1:]] - run[first[:-1]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *sums], [*rest, "n_best", "count_sum"])

    return aligned.select(*rest, "links").mapInArrow(run, ", ".join([*_kinds(aligned, rest), "n_best long, count_sum long"]))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = stored(align(documents(spark, sf_dir)), "alignment")
    return score_links(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
