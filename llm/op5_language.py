"""5. Language ID by hierarchical discrimination.

First the language family, then, inside it, one-versus-one linear support vector machines
between its languages. Features are the shares of hashed byte trigrams of the whole text
(letters in lower case, everything else a space), weighted by how rare they are.

Learning reads at most `SAMPLE` labelled texts per language, in hash order of their id;
prediction covers every row. Families are a fixed table; a language outside it is a family
of its own.

Defined cases: `und` with score 0 for a text that is null or has no letter, or when nothing
could be learned; rows pass through one to one; equal votes go to the larger sum of margins, then
to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.arrays import slices, utf8
from llm.tables import documents
from playbill.operators.keyed import top_per

SAMPLE, BINS, UNKNOWN = 600, 4096, "und"
# Families of languages.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn mr ne pa gu",
    "semitic": "ar he mt am",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def trigram_counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed trigrams, one row per text and `BINS` columns."""
    column = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    data, offsets = utf8(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar(" ", pa.large_string()),
                                                     pa.scalar("", pa.large_string())))
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    data = np.where(letter, data, 32).astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    gram = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    # One row's grams only, and none that is mostly space.
    good = (row[:-2] == row[2:]) & ((data[1:-1] != 32) | (data[:-2] != 32) & (data[2:] != 32))
    bin_of = (gram[good] * np.uint32(2654435761)) >> np.uint32(32 - int(BINS).bit_length() + 1)
    flat = row[:-2][good] * BINS + bin_of
    return np.bincount(flat, minlength=(len(offsets) - 1) * BINS).reshape(-1, BINS).astype(np.float32)


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


@dataclass
class Machine:
    """A linear machine between classes `one` (positive) and `two`."""

    one: str
    two: str
    weights: np.ndarray
    bias: float


def train(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge machine with L2 penalty, by accelerated gradient steps. The bias is a weight of its own,
    so that `x` is never copied."""
    y = y.astype(x.dtype)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)

    def back(errors: np.ndarray) -> np.ndarray:
        return np.r_[errors @ x, errors.sum()].astype(x.dtype)

    # The largest curvature, by power steps.
    v = np.ones(x.shape[1] + 1, x.dtype)
    for _ in range(15):
        v = back(share * (x @ v[:-1] + v[-1]))
        v /= np.linalg.norm(v) or 1.0
    rate = x.dtype.type(1 / (1 + 2 * cost * float(v @ back(share * (x @ v[:-1] + v[-1])))))
    w = ahead = np.zeros(x.shape[1] + 1, x.dtype)
    for k in range(rounds):
        gap = np.maximum(1 - y * (x @ ahead[:-1] + ahead[-1]), 0)
        new = ahead - rate * (ahead - x.dtype.type(2 * cost) * back(share * gap * y))
        ahead, w = new + x.dtype.type(k / (k + 3)) * (new - w), new
    return w[:-1], float(w[-1])


def one_versus_one(x: np.ndarray, labels: np.ndarray) -> list[Machine]:
    out = []
    for one, two in combinations(sorted(set(labels)), 2):
        rows = (labels == one) | (labels == two)
        w, b = train(x if rows.all() else x[rows], np.where(labels[rows] == one, 1, -1))
        out.append(Machine(one, two, w, b))
    return out


class Model:
    """Scale of the features, machines between families, and machines inside each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs, object)
        self.langs = sorted(set(langs))
        self.scale = (1 / np.sqrt(x.mean(0, dtype=np.float64) + 1e-5) if len(x) else np.ones(BINS)).astype(np.float32)
        x = x * self.scale
        families = np.array([family_of(n) for n in langs], object)
        self.members = {f: sorted(set(names[families == f])) for f in sorted(set(families))}
        self.top = one_versus_one(x, families)
        self.inside = {f: one_versus_one(x[families == f], names[families == f]) for f in self.members}

    @staticmethod
    def _vote(x: np.ndarray, classes: list[str], machines: list[Machine]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winning class, its confidence)."""
        votes, margins = np.zeros((2, len(x), len(classes)))
        worst = np.full((len(x), len(classes)), 40.0)
        for m in machines:
            margin = x @ m.weights + m.bias
            for name, side in ((m.one, margin), (m.two, -margin)):
                c = classes.index(name)
                votes[:, c] += side >= 0
                margins[:, c] += side
                worst[:, c] = np.minimum(worst[:, c], side)
        best = np.argmax(votes + 1e-6 * np.tanh(margins), axis=1)
        return best, 1 / (1 + np.exp(-3 * worst[np.arange(len(x)), best]))

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.full(len(counts), UNKNOWN, object), np.zeros(len(counts))
        if not self.langs:
            return lang, score
        x = shares(counts) * self.scale
        families = list(self.members)
        family, sure = self._vote(x, families, self.top)
        for i, f in enumerate(families):
            rows = np.flatnonzero(family == i)
            if len(rows):
                best, within = self._vote(x[rows], self.members[f], self.inside[f])
                lang[rows] = np.array(self.members[f], object)[best]
                score[rows] = sure[rows] * within
        return lang, score


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """The ids of the first `per_language` labelled rows of every language in hash order, as (doc_id, lang).

    The languages' counts give a hash below which about twice as many rows lie, so that only those are
    shuffled, however many tasks read the table.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(
        "doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    least = F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.col("n"))
    below = counts.select("lang", (least * 2.0**64 - 2.0**63).alias("cut"))
    near = known.join(F.broadcast(below), "lang").where(F.col("h").cast("double") <= F.col("cut"))
    return top_per(near, ["lang"], ["h", "doc_id"], per_language).select("doc_id", "lang").distinct()


def fit(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    """Learns from `text` and `lang` of rows that are not held out. The driver gets at most
    `per_language` feature rows of `BINS` numbers for each language."""
    picked = sample(docs, per_language)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = trigram_counts(part.column("text"))
                keep = x.sum(1) > 0
                rows = [r.astype("<f4").tobytes() for r in shares(x)[keep]]
                yield pa.RecordBatch.from_arrays([part.column("lang").filter(pa.array(keep)), part.column("doc_id").filter(pa.array(keep)),
                                                  pa.array(rows, pa.binary())], ["lang", "doc_id", "x"])

    rows = texts.mapInArrow(features, "lang string, doc_id long, x binary").toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("x", "ascending")]).combine_chunks()
    x = np.frombuffer(utf8(rows.column("x"))[0], "<f4").reshape(-1, BINS)
    return Model(x, rows.column("lang").to_pylist())


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep` columns of `df` with the predicted language and its score."""
    source = text if text in keep else "_text"
    picked = df.select(*keep, *([F.col(text).alias(source)] if source == "_text" else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source):
                column = part.column(source)
                lang, score = model.predict(trigram_counts(column))
                worded = pc.match_substring_regex(column.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
                lang, score = np.where(worded, lang, UNKNOWN), np.where(worded, score, 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score)],
                                                 [*keep, *names])

    kinds = [f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep]
    return picked.mapInArrow(run, ", ".join([*kinds, f"`{names[0]}` string, `{names[1]}` double"]))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
