"""1. Token counts by rank-synchronous array merging.

Distinct words of a slice of texts become one ragged array of symbols. In every round
each word finds the lowest rank among its adjacent pairs and all words apply theirs at
once; words without a known pair leave. What survives is counted. A later pair always
has a higher rank than the merge that made its parts, so rounds and the one-by-one
order agree.

Defined cases: a null text counts as empty (0 tokens); rows pass through one to one,
repeated ones too; a special string inside a text is one token, as the library takes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.arrays import slices, utf8
from llm.tables import documents
from llm.wordpieces import Vocabulary, symbols

MODEL = "word_bpe_49k.json"
LIMIT = 2048
# Words whose counts one Python worker remembers.
REMEMBERED = 500_000


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_counts(vocab: Vocabulary, words: list[str]) -> np.ndarray:
    """The number of tokens of every word."""
    if not words:
        return np.zeros(0, np.int64)
    flat, offsets = symbols(words)
    ids = vocab.symbol_ids[flat]
    lengths = np.diff(offsets)
    counts = lengths.copy()
    word = np.repeat(np.arange(len(words)), lengths)
    none = len(vocab.made)
    while len(ids) > 1:
        joined = word[1:] == word[:-1]
        rank = np.full(len(ids), none)
        at = np.flatnonzero(joined)
        rank[at] = vocab.rank(ids[at], ids[at + 1])
        starts = np.flatnonzero(np.r_[True, ~joined])
        lowest = np.minimum.reduceat(rank, starts)
        size = np.diff(np.r_[starts, len(ids)])
        # Words without a pair are done.
        active = np.repeat(lowest < none, size)
        ids, word, rank = ids[active], word[active], rank[active]
        low = np.repeat(lowest[lowest < none], size[lowest < none])
        take = rank == low
        # In a run of one repeated pair every second place merges, from the left.
        again = np.flatnonzero(take[1:] & take[:-1] & (word[1:] == word[:-1])) + 1
        if len(again):
            run = np.zeros(len(take), np.int64)
            place = np.flatnonzero(take)
            fresh = np.r_[True, (place[1:] != place[:-1] + 1) | (word[place[1:]] != word[place[:-1]])]
            first = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
            run[place] = place - first
            take &= run % 2 == 0
        ids[take] = vocab.made[rank[take]]
        gone = np.r_[False, take[:-1]] if len(take) else take
        np.subtract.at(counts, word[gone], 1)
        ids, word = ids[~gone], word[~gone]
    return counts


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None,
                 limit: int = LIMIT) -> DataFrame:
    """`keep` columns of `df` with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    path = path or public_tokenizers.path(MODEL)
    picked = df.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(path), {}
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part.column("_text").fill_null("").to_pylist()
                split = [vocab.words(t) for t in texts]
                fresh = list(set().union(*split) - known.keys() - vocab.specials.keys())
                if len(known) + len(fresh) > REMEMBERED:
                    known = {}
                    fresh = list(set().union(*split) - vocab.specials.keys())
                known.update(zip(fresh, merge_counts(vocab, fresh).tolist()))
                known.update(dict.fromkeys(vocab.specials, 1))
                n = np.array([sum(map(known.__getitem__, ws)) for ws in split], np.int64)
                size = np.diff(utf8(part.column("_text"))[1])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(size), pa.array(n), pa.array(n > limit)],
                    [*keep, "n_bytes", "n_tokens", "over_limit"])

    kinds = [f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep]
    return picked.mapInArrow(run, ", ".join([*kinds, "n_bytes long", "n_tokens long", "over_limit boolean"]))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
