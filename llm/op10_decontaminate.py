"""10. Benchmark decontamination: BM25 index of test items, block-max WAND, verification.

The test items are the index, the training texts are the queries. A text is read in
passages of `PASSAGE` words, a new one every `STEP` words; for longer items both are doubled
until some passage holds a whole copy wherever it starts (`passage_for`). Items of one passage
length make an index. Impacts are BM25 weights, with counts over all items, divided by
the item's score against itself, so one threshold serves all items. For each passage:

1. the sum of its terms' largest impacts bounds every item's score (one running sum per text);
2. where that reaches the threshold, the sums of block maxima bound each block of items;
3. postings are scored only in blocks whose bound reaches it; all items above it are candidates.

A candidate counts when the words around the passage hold enough of the item's question
and of its answer: runs of three words, or of as many as a shorter part has. The question ends at the
item's last question mark, or else after three quarters of its words. Words are runs of letters, marks
and numbers; in scripts written without spaces every character is a word.

An index shard holds at most `ITEMS` items and `WORDS` words (or one item), which bounds what a
task is sent. Shards that stay below both together share one reading of the texts; with more
items the texts are read once per such group.

Defined cases: null or wordless texts and items never match; repeated rows give repeated results; items
with one id are looked up one by one; an empty index or table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.arrays import mix, ragged, slices
from llm.shingles import letter_words
from llm.tables import documents, table

PASSAGE, STEP, BLOCK, ITEMS, WORDS = 64, 24, 8, 5_000, 320_000
# Postings and block cells that are scored at a time.
CELLS = 4_000_000
THRESHOLD, QUESTION, ANSWER = 0.6, 0.6, 0.5
K1, B = 1.2, 0.75
# The question marks of several scripts.
QUESTION_MARKS = "?？؟;"


GRAM = 3


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of n words in a row."""
    if len(words) < n or not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k, factor in zip(range(n), (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        out += words[k : len(words) - n + 1 + k] * np.uint64(factor)
    return mix(out)


class Part(NamedTuple):
    """A question or an answer: the distinct runs of `n` words in it. One of fewer than `GRAM` words is
    a run of its own length."""

    n: int
    runs: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray) -> Part:
        n = min(GRAM, len(words))
        return cls(n, np.unique(grams(words, n)))

    def share(self, words: np.ndarray) -> float:
        """The share of the part's runs that are among those of `words`; 1 for an empty part."""
        return float(np.isin(self.runs, grams(words, self.n)).mean()) if len(self.runs) else 1.0


def passage_for(words: int) -> tuple[int, int]:
    """Length of the passages, and of the step between them, for an item of so many words: a copy
    that starts up to a step after a passage's start still ends inside of it."""
    k = 0
    while words > ((PASSAGE - STEP) << k) + 1:
        k += 1
    return PASSAGE << k, STEP << k


class Counts(NamedTuple):
    """Over all items with words: their number and mean length, and in how many each term is."""

    items: int
    length: float
    terms: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Counts:
        length, terms, df = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a in range(0, len(texts), ITEMS):
            words, at = letter_words(pa.array(texts[a : a + ITEMS], pa.string()))
            length.append(np.diff(at))
            found = np.unique(np.concatenate([np.unique(words[b:e]) for b, e in zip(at, at[1:])]), return_counts=True)
            terms.append(found[0])
            df.append(found[1])
        length = np.concatenate(length)
        distinct, of = np.unique(np.concatenate(terms), return_inverse=True)
        some = length > 0
        return cls(int(some.sum()), float(length[some].mean()) if some.any() else 1.0, distinct,
                   np.bincount(of, np.concatenate(df), len(distinct)))


class Index:
    """Postings with impacts, block maxima, and each item's question and answer."""

    def __init__(self, ids: list[int], texts: list[str], counts: Counts, passage: int = PASSAGE, step: int = STEP):
        self.passage, self.step = passage, step
        words, at = letter_words(pa.array(texts, pa.string()))
        rows = [words[a:b] for a, b in zip(at, at[1:])]
        kept = [k for k, r in enumerate(rows) if len(r)]
        self.ids = np.array([ids[k] for k in kept], np.int64)
        rows = [rows[k] for k in kept]
        self.parts = [self._halves(texts[k], r) for k, r in zip(kept, rows)]
        n = len(rows)
        self.words = sum(map(len, rows))
        length = np.array([len(r) for r in rows], np.float64)
        cells = [np.unique(r, return_counts=True) for r in rows]
        term = np.concatenate([c[0] for c in cells]) if n else np.zeros(0, np.uint64)
        tf = np.concatenate([c[1] for c in cells]) if n else np.zeros(0)
        item = np.repeat(np.arange(n), [len(c[0]) for c in cells])
        self.terms, of = np.unique(term, return_inverse=True)
        df = counts.df[np.searchsorted(counts.terms, self.terms)]
        idf = np.log1p((counts.items - df + 0.5) / (df + 0.5))
        impact = idf[of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / counts.length))
        impact /= np.bincount(item, impact, n)[item]
        order = np.lexsort((item, of))
        self.item, self.impact = item[order], impact[order]
        self.first = np.searchsorted(of[order], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.impact, self.first[:-1]) if n else np.zeros(0)
        # Block maxima of every term.
        block = of[order] * (n // BLOCK + 1) + self.item // BLOCK
        new = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if n else np.zeros(0, np.int64)
        self.block = (self.item // BLOCK)[new]
        self.block_most = np.maximum.reduceat(self.impact, new) if n else np.zeros(0)
        self.block_first = np.searchsorted(of[order][new], np.arange(len(self.terms) + 1))

    @staticmethod
    def _halves(text: str, words: np.ndarray) -> tuple[Part, Part]:
        mark = max(text.rfind(c) for c in QUESTION_MARKS)
        cut = len(letter_words(pa.array([text[: mark + 1]]))[0]) if mark >= 0 else 0
        if not 0 < cut < len(words):
            cut = max(1, len(words) * 3 // 4)
        return Part.of(words[:cut]), Part.of(words[cut:])

    def search(self, term: np.ndarray, first: np.ndarray, least: float) -> Iterator[tuple[int, int, int, float]]:
        """(row, passage start, item, score) of every item at `least` or more. `term`: index of each
        word's term, -1 for none; `first`: first word of every row plus the total."""
        n = np.diff(first)
        count = np.where(n > 0, np.maximum(0, -(-(n - self.passage) // self.step)) + 1, 0)
        row = np.repeat(np.arange(len(n)), count)
        start = first[row] + ragged(np.zeros(len(n), np.int64), count) * self.step
        end = np.minimum(start + self.passage, first[row + 1])
        # 1. The whole passage's bound; a term that comes twice only loosens it.
        most = np.where(term >= 0, self.most[term], 0.0)
        if self.passage > PASSAGE:
            most[self._again(term, first)] = 0.0
        run = np.r_[0.0, np.cumsum(most)]
        live = np.flatnonzero(run[end] - run[start] >= least - 1e-9)
        if len(live):
            size = np.r_[0, np.cumsum(np.where(term >= 0, np.diff(self.first)[term], 0))]
            cells = np.cumsum(size[end[live]] - size[start[live]] + len(self.ids) // BLOCK + 1)
            for some in np.split(live, np.flatnonzero(np.diff(cells // CELLS)) + 1):
                yield from self._score(term, row, start, end, some, least)

    def _again(self, term: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Words whose term came before in the same step of their row. Passages begin with a step, so
        the first one counts in every passage that has the word."""
        known = np.flatnonzero(term >= 0)
        row = np.searchsorted(first, known, "right") - 1
        before = np.r_[0, np.cumsum(-(-np.diff(first) // self.step))]
        step = before[row] + (known - first[row]) // self.step
        again = np.ones(len(known), bool)
        again[np.unique(step * len(self.terms) + term[known], return_index=True)[1]] = False
        return known[again]

    def _score(self, term: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, live: np.ndarray, least: float):
        at = ragged(start[live], end[live] - start[live])
        owner = np.repeat(np.arange(len(live)), end[live] - start[live])
        owner, at = owner[term[at] >= 0], at[term[at] >= 0]
        pair = np.unique(owner * len(self.terms) + term[at])
        owner, t = pair // len(self.terms), pair % len(self.terms)
        # 2. Block bounds.
        blocks = len(self.ids) // BLOCK + 1
        size = self.block_first[t + 1] - self.block_first[t]
        places = ragged(self.block_first[t], size)
        bound = np.bincount(np.repeat(owner, size) * blocks + self.block[places], self.block_most[places], len(live) * blocks)
        open_ = bound >= least - 1e-9
        some = np.flatnonzero(open_.reshape(len(live), blocks).any(1)[owner])
        owner, t = owner[some], t[some]
        # 3. Scores inside open blocks.
        size = self.first[t + 1] - self.first[t]
        places = ragged(self.first[t], size)
        owner = np.repeat(owner, size)
        inside = open_[owner * blocks + self.item[places] // BLOCK]
        cell, of = np.unique(owner[inside] * len(self.ids) + self.item[places[inside]], return_inverse=True)
        score = np.bincount(of, self.impact[places[inside]], len(cell))
        for c in np.flatnonzero(score >= least - 1e-9).tolist():
            p = live[cell[c] // len(self.ids)]
            yield int(row[p]), int(start[p]), int(cell[c] % len(self.ids)), float(score[c])

    def hits(self, words: np.ndarray, first: np.ndarray, least: float, question: float, answer: float) -> Iterator[tuple[int, dict]]:
        """(row, verified item), by row and place in the index."""
        if not len(self.terms) or not len(words):
            return
        term = np.searchsorted(self.terms, words)
        term[term == len(self.terms)] = 0
        term = np.where(self.terms[term] == words, term, -1)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for row, start, item, score in self.search(term, first, least):
            near = words[max(first[row], start - self.passage) : min(first[row + 1], start + 2 * self.passage)]
            q, a = (part.share(near) for part in self.parts[item])
            if q >= question and a >= answer:
                best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), (score, q, a))
        for (row, item), (score, q, a) in sorted(best.items()):
            yield row, {"item_id": int(self.ids[item]), "score": score, "question": q, "answer": a}


def groups(sizes: list[tuple[int, int]]) -> list[slice]:
    """Cuts (items, words) into runs of at most `ITEMS` items and `WORDS` words, or of one entry."""
    out, at, items, words = [], 0, 0, 0
    for k, (i, w) in enumerate(sizes):
        if k > at and (items + i > ITEMS or words + w > WORDS):
            out.append(slice(at, k))
            at, items, words = k, 0, 0
        items, words = items + i, words + w
    return [*out, slice(at, len(sizes))] if sizes else out


def build(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list[Index]:
    """Index shards, by passage length and in order of their items' ids."""
    picked = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text)
    rows = sorted((r[0], r[1]) for r in picked.toLocalIterator())
    counts = Counts.of([t for _, t in rows])
    by_length: dict[tuple[int, int], list[tuple[int, tuple[int, str]]]] = {}
    for row in rows:
        words = len(letter_words(pa.array([row[1]], pa.string()))[0])
        by_length.setdefault(passage_for(words), []).append((words, row))
    return [Index(*map(list, zip(*(r for _, r in of[cut]))), counts, *length)
            for length, of in sorted(by_length.items()) for cut in groups([(1, w) for w, _ in of])]


def mark(df: DataFrame, indexes: list[Index], text: str = "text", name: str = "hits", least: float = THRESHOLD,
         question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """`df` with `name`: array of (item_id, score, question, answer) of the items a text holds."""
    hit = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])
    kind = "array<struct<item_id: long, score: double, question: double, answer: double>>"

    def scan(frame: DataFrame, some: list[Index], column: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    words, first = letter_words(part.column(text))
                    found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                    for index in some:
                        for row, one in index.hits(words, first, least, question, answer):
                            found[row].append(one)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(hit))], [*part.schema.names, column])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
        return frame.mapInArrow(run, f"{fields}, `{column}` {kind}")

    together = [indexes[cut] for cut in groups([(len(x.ids), x.words) for x in indexes])] or [[]]
    names = [f"{name}_{k}" for k in range(len(together))]
    out = reduce(lambda frame, pair: scan(frame, *pair), zip(together, names), df)
    return out.select(*df.columns, F.array_sort(F.flatten(F.array(*names))).alias(name))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    marked = mark(docs, build(table(spark, sf_dir, "benchmark")))
    return marked.select("doc_id", F.explode("hits").alias("h")).select(
        "doc_id", "h.item_id", "h.score", F.col("h.question").alias("question_overlap"), F.col("h.answer").alias("answer_overlap"))
