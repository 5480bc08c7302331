"""2. Toxicity by a weighted finite-state grammar over clauses.

Words become classes: insult, threat verb, intent, target, copula, negation, reported
speech, anything else. Three transducers read a clause word by word: one marks what stands
after a negation, one what is reported speech, one weights insults and threats by the target
they are aimed at ("you idiot", "they are all vermin", "we will hurt you"). They are composed into
one table (state x class -> state, weight, excused) and every clause that holds an insult or
threat runs through it.

A text's score comes from its clauses' weights, summed and weighed against the number of its
clauses. An insult without a target stays below the threshold on its own; a threat with intent and
target passes it. What is denied or reported adds `MOST_EXCUSED` at most, however often, so that it
never makes a text toxic.

Insults are a fixed list plus what labelled texts teach: words and word stems of 4 to 6
letters that mark toxic texts. Their weight is a lower bound of their smoothed log-odds, at most
that of an insult; the rule is the same at every sample size and bears some wrong labels. Learning reads at most
`SAMPLE_TOXIC` + `SAMPLE_CLEAN` labelled texts (in hash order of their id) and keeps at most
`LEXICON` entries; scoring covers every row and whole texts.

Defined cases: a null or empty text scores the grammar's floor; rows pass through one to
one; without any usable label only the fixed list counts; a doc with several label rows
is toxic if one says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.arrays import SpanHash, run_starts, slices, utf8
from llm.tables import documents, table

SAMPLE_TOXIC, SAMPLE_CLEAN, LEXICON = 6_000, 12_000, 4_096
STEMS = (4, 5, 6)
THRESHOLD = 0.7
# A sign of toxic texts must be in 1 % of them (3 at least), and its log-odds less `ERRORS`
# standard errors must reach this.
LEAST_SHARE, LEAST_COUNT, LEAST_ODDS, ERRORS = 0.01, 3, 2.0, 1.0

KINDS = 8
OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, COPULA = range(KINDS)
# The words of the grammar's classes.
WORDS = {
    INSULT: ("idiot moron loser scum trash clown stupid pathetic worthless disgusting imbecile vermin filth "
             "dummkopf abschaum versager trottel imbécile crétin ordure minable estúpido imbécil escoria inútil").split(),
    THREAT: ("kill hurt destroy beat hunt burn shoot stab crush punish töten verletzen vernichten umbringen "
             "tuer frapper détruire brûler matar golpear destruir quemar").split(),
    INTENT: "will gonna shall must should deserve deserves going werde werden vais allons voy vamos".split(),
    TARGET: ("you your you're he she they they're them him her his their those these people "
             "du dich dein euch ihr tu toi vous ustedes usted tú").split(),
    NEGATION: "not never no isn't aren't wasn't don't doesn't didn't cannot nobody without nicht kein keine nie pas jamais nunca".split(),
    REPORT: "said says wrote called calls quoted quote claimed reported allegedly heard sagte schrieb écrit dijo escribió".split(),
    COPULA: "is are am was were be you're they're bist seid sind êtes sont eres son".split(),
}
_INSULT_WEIGHT, _AIMED, _THREAT_WEIGHT = 2.2, 2.0, 4.4
_EXCUSE, MOST_EXCUSED = 0.2, 0.8
_REACH = 2  # words that may stand between a target or intent and what it goes with
_CLAUSE_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?;\n"])


def _negation(state: int, kind: int) -> tuple[int, bool]:
    """States 0 (plain) to 3 (a negation stands up to three words back); whether this word is denied."""
    return (3 if kind == NEGATION else max(state - 1, 0)), state > 0


def _reported(state: int, kind: int) -> tuple[int, bool]:
    """State 1: after a verb of saying in the same clause."""
    return (1 if kind == REPORT or state else 0), state > 0


_NOTHING, _TARGET, _IS, _INTENDS, _THREATENS = 0, 1, 2, 3 + _REACH, 4 + 2 * _REACH
AIMS = 5 + 3 * _REACH


def _aimed(state: int, kind: int) -> tuple[int, float]:
    """States: nothing; a target; a target and its copula; an intent; a threat that waits for its
    target. The last three hold for `_REACH` other words, one state for each word gone by."""
    if kind == INSULT:
        aimed = state == _TARGET or _IS <= state < _INTENDS
        return state, _AIMED if aimed else 1.0
    if kind == THREAT:
        return (_THREATENS if _INTENDS <= state < _THREATENS else _NOTHING), 0.0
    if kind == TARGET:
        return _TARGET, _THREAT_WEIGHT if state >= _THREATENS else 0.0
    if kind == COPULA and state == _TARGET:
        return _IS, 0.0
    if kind == INTENT:
        return _INTENDS, 0.0
    last = state in (_NOTHING, _TARGET, _INTENDS - 1, _THREATENS - 1, AIMS - 1)
    return (_NOTHING if last else state + 1), 0.0


def compose() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, weight, excused) by composed state and class."""
    states = [(n, r, a) for n in range(4) for r in range(2) for a in range(AIMS)]
    place = {s: i for i, s in enumerate(states)}
    step, weight, excused = (np.zeros((len(states), KINDS), t) for t in (np.int64, np.float64, np.bool_))
    for i, (n, r, a) in enumerate(states):
        for kind in range(KINDS):
            (n2, denied), (r2, told), (a2, w) = _negation(n, kind), _reported(r, kind), _aimed(a, kind)
            step[i, kind], weight[i, kind], excused[i, kind] = place[n2, r2, a2], w, denied or told
    return step, weight, excused


@dataclass
class Words:
    """The words of a slice: hashes, byte places, row, clause; and hashes of their stems."""

    hashes: np.ndarray
    row: np.ndarray
    clause: np.ndarray
    stems: list[tuple[np.ndarray, np.ndarray]]  # (word index, hash) by stem length


def read_words(column: pa.Array) -> Words:
    data, offsets = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, [])
    letter = (data >= 128) | ((data >= 97) & (data <= 122)) | (data == 39)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(letter & (np.r_[True, ~letter[:-1]] | edge[:-1]))
    end = np.flatnonzero(letter & (np.r_[~letter[1:], True] | edge[1:])) + 1
    spans = SpanHash(data)
    ends = _CLAUSE_ENDS[data]
    clause = np.cumsum(ends | edge[:-1])[start]
    row = np.searchsorted(offsets, start, "right") - 1
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    nth = np.searchsorted(chars, start)
    chars = np.r_[chars, np.full(max(STEMS) + 1, len(data))]
    stems = []
    for k in STEMS:
        stop = chars[nth + k]
        long = np.flatnonzero(stop < end)
        # Another seed of the hash's length term keeps stems apart from whole words.
        stems.append((long, ~spans.spans(start[long], stop[long])))
    return Words(spans.spans(start, end), row, clause, stems)


def _word_hashes(words: list[str]) -> np.ndarray:
    return read_words(pa.array([" ".join(words)])).hashes


def learn_insults(labelled: DataFrame, text: str, toxic: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, weights) of the words and stems that mark toxic texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                words = read_words(part.column("_text"))
                label = part.column("_toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                sign = np.concatenate([words.hashes, *(h for _, h in words.stems)])
                row = np.concatenate([words.row, *(words.row[i] for i, _ in words.stems)])
                order = np.lexsort((row, sign))
                sign, row = sign[order], row[order]
                new = np.flatnonzero(np.r_[True, (sign[1:] != sign[:-1]) | (row[1:] != row[:-1])]) if len(sign) else order
                sign, yes = sign[new], label[row[new]]
                at = run_starts(sign)
                if len(at):
                    n = np.diff(np.r_[at, len(sign)])
                    t = np.add.reduceat(yes, at)
                    yield pa.RecordBatch.from_arrays([pa.array(sign[at].view(np.int64)), pa.array(t), pa.array(n - t)], ["sign", "t", "c"])

    rows = labelled.select(F.col(text).alias("_text"), F.col(toxic).cast("int").alias("_toxic"))
    totals = rows.agg(F.coalesce(F.sum("_toxic"), F.lit(0)), F.count(F.lit(1))).first()
    n_toxic, n_clean = int(totals[0]), int(totals[1] - totals[0])
    if not n_toxic or not n_clean:
        return np.zeros(0, np.uint64), np.zeros(0)
    least = max(LEAST_COUNT, int(np.ceil(LEAST_SHARE * n_toxic)))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log((t / (n_toxic + 1)) / (c / (n_clean + 1))) - ERRORS * F.sqrt(1 / t + 1 / c)
    found = (rows.mapInArrow(count, "sign long, t long, c long").groupBy("sign").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
             .where((F.col("t") >= least) & (odds >= LEAST_ODDS))
             .select("sign", odds.alias("w")).orderBy(F.desc("w"), "sign").limit(LEXICON).collect())
    sign = np.array([r[0] for r in found], np.int64).view(np.uint64)
    order = np.argsort(sign)
    return sign[order], np.minimum(np.array([r[1] for r in found])[order], _INSULT_WEIGHT)


class Grammar:
    def __init__(self, signs: np.ndarray, weights: np.ndarray):
        """`signs`: learned insults, sorted."""
        fixed = [(h, kind) for kind, words in WORDS.items() for h in _word_hashes(words)]
        both = {int(h): (kind, _INSULT_WEIGHT if kind == INSULT else 1.0) for h, kind in fixed}
        both.update({int(h): (INSULT, float(w)) for h, w in zip(signs, weights) if both.get(int(h), (INSULT,))[0] == INSULT})
        keys = np.array(sorted(both), np.uint64)
        self.keys = keys
        self.kinds = np.array([both[int(k)][0] for k in keys])
        self.weights = np.array([both[int(k)][1] for k in keys])
        self.step, self.out, self.excused = compose()

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, at, -1)

    def clauses(self, column: pa.Array) -> list[tuple[int, float]]:
        """(row, weight) of every clause that matches."""
        return [(row, plain + excused) for row, plain, excused in self.matches(read_words(column))]

    def matches(self, words: Words) -> list[tuple[int, float, float]]:
        """(row, weight, weight of what is denied or reported) of every clause that matches."""
        entry = self._find(words.hashes)
        kind = np.where(entry >= 0, self.kinds[entry], OTHER)
        weight = np.where(entry >= 0, self.weights[entry], 0.0)
        for index, hashes in words.stems:
            stem = self._find(hashes)
            hit = stem >= 0
            at, w = index[hit], self.weights[stem[hit]]
            fresh = (kind[at] == OTHER) | ((kind[at] == INSULT) & (weight[at] < w))
            kind[at[fresh]], weight[at[fresh]] = INSULT, w[fresh]
        loud = np.unique(words.clause[(kind == INSULT) | (kind == THREAT)])
        first = np.searchsorted(words.clause, loud)
        last = np.searchsorted(words.clause, loud, "right")
        out = []
        for a, b in zip(first.tolist(), last.tolist()):
            state, total, before = 0, [0.0, 0.0], a
            for i in (np.flatnonzero(kind[a:b]) + a).tolist():
                for _ in range(min(i - before, 4)):  # no state outlasts so many words of no class
                    state = self.step[state, OTHER]
                k = kind[i]
                w = self.out[state, k] * (weight[i] if k == INSULT else 1.0)
                total[int(self.excused[state, k])] += w * (_EXCUSE if self.excused[state, k] else 1.0)
                state, before = self.step[state, k], i + 1
            if any(total):
                out.append((int(words.row[a]), *total))
        return out


def clause_counts(words: Words, rows: int) -> np.ndarray:
    """Clauses with words of each row."""
    return np.bincount(words.row[np.flatnonzero(np.diff(words.clause, prepend=-1))], minlength=rows)


def score_of(plain: np.ndarray, excused: np.ndarray, clauses: np.ndarray) -> np.ndarray:
    """Scores by the summed weights of texts and the number of their clauses."""
    total = (plain + np.minimum(excused, MOST_EXCUSED)) / (1 + np.log1p(clauses / 50) / 5)
    return 1 / (1 + np.exp(3.0 - 1.25 * np.minimum(total, 40)))


def score_texts(df: DataFrame, grammar: Grammar, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of `df` with score (0 to 1), predicted and n_clauses (clauses that match)."""
    picked = df.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                words = read_words(part.column("_text"))
                plain, excused, n = np.zeros(part.num_rows), np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
                for row, one, other in grammar.matches(words):
                    plain[row] += one
                    excused[row] += other
                    n[row] += 1
                score = score_of(plain, excused, clause_counts(words, part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(n)],
                    [*keep, "score", "predicted", "n_clauses"])

    kinds = [f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep]
    return picked.mapInArrow(run, ", ".join([*kinds, "score double, predicted int, n_clauses long"]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learns from labelled texts that are not held out."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic")))
    counts = {r[0]: r[1] for r in known.groupBy("_toxic").agg(F.count(F.lit(1))).collect()}

    def sample(label: int, most: int) -> DataFrame:
        """The first `most` rows by hash. A cut-off from their number keeps all but about 1.2 times as
        many, or 400 more, out of the sort."""
        share = (1.2 * most + 400) / max(counts.get(label, 0), 1)
        rows = known.where(F.col("_toxic") == label)
        if share < 1:
            rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        return rows.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(most)

    picked = sample(1, SAMPLE_TOXIC).unionByName(sample(0, SAMPLE_CLEAN))
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows of two numbers.
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # Copies count once: one text for each label and four smallest word hashes.
    hashes = F.array_sort(F.array_distinct(F.transform(F.split("text", r"\s+"), lambda w: F.xxhash64(w))))
    texts = texts.withColumn("_key", F.slice(hashes, 1, 4))
    return Grammar(*learn_insults(texts.dropDuplicates(["_key", "_toxic"]), "text", "_toxic"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_clauses")
