import numpy as np
import pyarrow as pa
import pytest

from llm import op2_toxicity as op2
from llm import op5_language as op5
from tests.llm.conftest import prose


def test_grammar_weighs_clauses():
    g = op2.Grammar(np.zeros(0, np.uint64), np.zeros(0))

    def total(text):
        return sum(w for _, w in g.clauses(pa.array([text])))

    assert total("a kind word for you") == 0
    assert total("you are an idiot") > total("some idiot") > total("not an idiot") > 0
    assert total("she said some idiot came") < total("some idiot came")
    assert total("we will hurt you") > 0 and total("it may hurt") == 0
    assert total("no. an idiot") == total("an idiot")  # a clause ends at its stop


def test_learned_stems_and_held_out_rows(spark, make_docs):
    rows = [(i, prose(i, 60) + (f" zorb{'abcdefg'[i % 7]} zorb{'hijklmn'[i % 7]}" if i % 4 == 0 else "")) for i in range(240)]
    docs = make_docs([*rows, (900, None), (901, ""), (902, "Zorbq ZORBX")])
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i, _ in rows] + [(900, None, 1), (None, 0, 1), (5, 0, None)],
                                   "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in op2.score_texts(docs, op2.fit(docs, labels)).collect()}
    assert len(out) == 243 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert all(out[i].predicted == (i % 4 == 0) for i, _ in rows)
    assert out[902].predicted == 1 and out[900].predicted == 0 and out[900].score == out[901].score


def test_without_labels_or_rows(spark, make_docs):
    docs, labels = make_docs([(1, "you idiot, moron")]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op2.score_texts(docs, op2.fit(docs, labels)).first().predicted == 1
    assert op2.score_texts(make_docs([]), op2.fit(make_docs([]), labels)).collect() == []
    model = op5.fit(make_docs([]))
    assert [tuple(r) for r in op5.identify(docs, model).collect()] == [(1, "und", 0.0)]


@pytest.fixture(scope="module")
def languages(spark):
    syllables = {"en": "th er on an re he in ed", "de": "sch ung ein ich der und ge", "fr": "eau que ion les ou ai é", "es": "ción ado os la que ña ía"}
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for lang, parts in syllables.items():
        for _ in range(60):
            rows.append((i, " ".join("".join(rng.choice(parts.split(), rng.integers(1, 4))) for _ in range(40)), lang))
            i += 1
    rows += [(1000, None, "en"), (1001, "", "fr"), (1002, "12 !?", "de"), (None, "the there", "en"), (1003, "thereon", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_by_family(languages):
    model = op5.fit(languages)
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"]} and len(model.top) == 1
    out = op5.identify(languages, model, keep=("doc_id", "lang")).where("doc_id < 1000").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)
    rest = {r.doc_id: (r.lang_pred, r.score) for r in op5.identify(languages, model).where("doc_id >= 1000 and doc_id < 1003").collect()}
    assert rest == {1000: ("und", 0.0), 1001: ("und", 0.0), 1002: ("und", 0.0)}


def test_one_language_needs_no_machine(languages):
    only = languages.where("lang = 'fr'")
    out = op5.identify(only, op5.fit(only)).where("doc_id < 1000").collect()
    assert {r.lang_pred for r in out} == {"fr"}
