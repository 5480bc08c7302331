"""The clause grammar of operator 2 against a slow reading of its rules, and the cases it must tell apart."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import op2_toxicity as op2

FIXED = op2.Grammar(np.zeros(0, np.uint64), np.zeros(0))
KIND = {w: k for k, words in op2.WORDS.items() for w in words}


def slow(text):
    """(weight, weight of what is denied or reported) by looking back from each word, without states."""
    plain = excused = 0.0
    for clause in re.split(r"[.!?;\n]", text.lower()):
        words = re.findall(r"[a-z'\u0080-￿]+", clause)
        kinds = [KIND.get(w, op2.OTHER) for w in words]

        def back(i, wanted, stop):
            """The nearest earlier word of `wanted` with at most two plain words between; `stop` kinds end the search."""
            gap = 0
            for j in range(i - 1, -1, -1):
                if kinds[j] in wanted:
                    return j
                if kinds[j] in stop:
                    return None
                gap += kinds[j] != op2.INSULT
                if gap > 2:
                    return None
            return None

        for i, kind in enumerate(kinds):
            denied = any(k == op2.NEGATION for k in kinds[max(0, i - 3) : i])
            told = op2.REPORT in kinds[:i]
            weight = 0.0
            breaks = (op2.THREAT, op2.INTENT, op2.TARGET)
            if kind == op2.INSULT:
                j = i - 1
                while j >= 0 and kinds[j] == op2.INSULT:
                    j -= 1
                at_once = j >= 0 and kinds[j] == op2.TARGET
                c = next((j for j in range(i - 1, -1, -1) if kinds[j] == op2.COPULA and is_copula(kinds, j)), None)
                near = c is not None and not any(k in breaks for k in kinds[c + 1 : i]) and sum(
                    k != op2.INSULT for k in kinds[c + 1 : i]) <= 2
                weight = op2._INSULT_WEIGHT * (op2._AIMED if at_once or near else 1.0)
            elif kind == op2.TARGET:
                t = back(i, (op2.THREAT,), (op2.INTENT, op2.TARGET))
                if t is not None and back(t, (op2.INTENT,), (op2.THREAT, op2.TARGET)) is not None:
                    weight = op2._THREAT_WEIGHT
            if denied or told:
                excused += 0.2 * weight
            else:
                plain += weight
    return plain, excused


def is_copula(kinds, j):
    """A copula right behind a target, insults between them aside."""
    j -= 1
    while j >= 0 and kinds[j] == op2.INSULT:
        j -= 1
    return j >= 0 and kinds[j] == op2.TARGET


def fast(text):
    found = FIXED.matches(op2.read_words(pa.array([text])))
    return sum(f[1] for f in found), sum(f[2] for f in found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([w[0] for w in op2.WORDS.values()] + ["plain", "word", ".", "are", "you"]), max_size=14))
def test_automaton_equals_the_rules(words):
    text = " ".join(words)
    assert fast(text) == pytest.approx(slow(text))


CASES = [
    ("Please take out the trash.", 0), ("The clown made the children laugh.", 0), ("You took out the trash.", 0),
    ("He is not an idiot. She is not stupid.", 0), ("Not an idiot. " * 40, 0), ("He said you are scum. " * 40, 0),
    ("They wrote we will hurt you.", 0), ("We will beat the eggs with sugar for you.", 0), ("", 0),
    ("I will kill you.", 1), ("You idiot!", 1), ("You are all vermin.", 1), ("These people are filth", 1),
    ("An idiot came. A moron left.", 1), ("Du Versager", 1),
]


def test_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in op2.score_texts(docs, FIXED).collect()}
    assert got == {**{i: want for i, (_, want) in enumerate(CASES)}, 99: 0}


def test_the_sum_is_weighed_against_the_clauses(spark):
    docs = spark.createDataFrame([(n, "Some idiot. A moron. " + "Kind words here. " * n) for n in (0, 50, 5000)] * 2,
                                 "doc_id long, text string")
    rows = op2.score_texts(docs, FIXED).collect()
    score = {r.doc_id: r.score for r in rows}
    assert len(rows) == 6 and score[0] > score[50] > score[5000] and all(r.n_clauses == 2 for r in rows)
    assert score[0] >= 0.7 > score[5000]


def test_a_few_wrong_labels_change_little(spark):
    rows = [(i, f"word{'abcdefgh'[i % 8]} thing{'klmnopq'[i % 7]} house{i}" + (" zorbal zorbin" if i % 5 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    wrong = spark.createDataFrame([(i, int(i % 5 == 0) ^ int(i % 47 == 0)) for i, _ in rows], "doc_id long, toxic int")
    for labels in (clean, wrong):
        out = op2.score_texts(docs, op2.fit(docs, labels)).collect()
        assert all(r.predicted == int(r.doc_id % 5 == 0) for r in out)
