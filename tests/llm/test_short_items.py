"""Operator 10 on short items, short answers and scripts without spaces."""

import numpy as np
import pyarrow as pa
import pytest

from llm import op10_decontaminate as op10
from llm.shingles import letter_words
from tests.llm.conftest import prose


def hits(spark, make_docs, items, rows):
    indexes = op10.build(spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, h.item_id) for r in op10.mark(make_docs(rows), indexes).collect() for h in r.hits}


def plain_words(text):
    words, _ = letter_words(pa.array([text], pa.string()))
    return words


def found(item, text):
    """The two checks as they are stated, over every window of a text: BM25 is left to the others."""
    words, whole = plain_words(item).tolist(), plain_words(text).tolist()
    cut = len(plain_words(item[: item.rfind("?") + 1])) if "?" in item else 0
    cut = cut if 0 < cut < len(words) else max(1, len(words) * 3 // 4)

    def share(part):
        n = min(3, len(part))
        runs = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)} if n else set()
        there = {tuple(whole[k : k + n]) for k in range(len(whole) - n + 1)}
        return np.mean([r in there for r in runs]) if runs else 1.0

    return share(words[:cut]) >= op10.QUESTION and share(words[cut:]) >= op10.ANSWER


@pytest.mark.parametrize("answer", ["Paris", "The Vltava", "The river Vltava", "Upon the river Vltava, of course"])
def test_answers_of_any_length(spark, make_docs, answer):
    item = f"Which one is it that lies {prose(1, 8)} to the west of {prose(2, 3)}? {answer}"
    question = item[: item.index("?") + 1]
    rows = [(1, prose(3, 80) + " " + item + " " + prose(4, 90)), (2, prose(5, 40) + " " + question + " " + prose(6, 60)), (3, item.upper()),
            (4, prose(7, 30) + " " + answer + " " + prose(8, 30)), (5, prose(9, 200))]
    got = hits(spark, make_docs, [(k, prose(50 + k, 20) + "? " + prose(80 + k, 2)) for k in range(5)] + [(9, item)], rows)
    assert {d for d, k in got if k == 9} == {1, 3}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
def test_items_of_one_to_five_words(spark, make_docs, size):
    item = " ".join(f"zyx{k}" for k in range(size))
    rows = [(1, prose(1, 100) + " " + item + " " + prose(2, 100)), (2, item), (3, prose(3, 100)), (4, " ".join(reversed(item.split())) + "q")]
    got = hits(spark, make_docs, [(7, item), (8, prose(9, 12))], rows)
    assert {d for d, k in got if k == 7} == {1, 2}


@pytest.mark.parametrize("item, around", [
    ("日本の首都はどこですか？東京です", "昔々あるところに{}おじいさんとおばあさんがいました"), ("中国最长的河流是哪一条？长江", "他说了一句话{}然后就离开了那个地方"),
    ("ประเทศไทยมีเมืองหลวงชื่ออะไร กรุงเทพ", "เขาพูดว่า{}แล้วเดินจากไป")])
def test_scripts_without_spaces(spark, make_docs, item, around):
    rows = [(1, around.format(item)), (2, item), (3, around.format("")), (4, prose(1, 50))]
    got = hits(spark, make_docs, [(7, item), (8, prose(9, 12))], rows)
    assert {d for d, k in got if k == 7} == {1, 2}


def test_marks_of_any_script_separate_words():
    assert plain_words("“One”—two… ¿three?").tolist() == plain_words("one two three").tolist()
    assert len(plain_words("東京 tower")) == 3 and len(plain_words("naïve café")) == 2
    words, first = letter_words(pa.array(["ab", "cd", None, "", "é"]))
    assert first.tolist() == [0, 1, 2, 2, 2, 3] and len(words) == 3


def test_every_verbatim_item_is_found_and_checks_agree_with_brute_force(spark, make_docs):
    rng = np.random.default_rng(3)
    items = [(k, prose(500 + k, int(rng.integers(4, 25))) + "? " + prose(700 + k, int(rng.integers(1, 6)))) for k in range(25)]
    rows = []
    for k, (_, item) in enumerate(items):
        words = item.split()
        cut = len(words) if k % 3 else max(1, len(words) - 2)
        rows.append((k, prose(900 + k, 120) + " " + " ".join(words[:cut]) + " " + prose(950 + k, 120)))
    got = hits(spark, make_docs, items, rows)
    texts = dict(rows)
    for d, k in got:
        assert found(items[k][1], texts[d])
    assert {(k, k) for k in range(25) if k % 3} <= got
    # A candidate that the checks refuse is no hit, and one that they accept is, if BM25 has it.
    assert all(((k, k) in got) <= found(items[k][1], texts[k]) for k in range(25))
