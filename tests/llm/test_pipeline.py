import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from llm import op10_decontaminate as op10
from tests.llm.conftest import prose
from tests.llm.test_duplicates import shingles


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_passages_are_found_wherever_they_are(spark, make_docs):
    items = [(k, " ".join(f"i{k}w{j}" if j % 3 else "the" for j in range(12 + 4 * k))) for k in range(8)] + [(90, None), (91, ""), (92, "?!")]
    rng = np.random.default_rng(1)
    rows, want = [], set()
    for i in range(40):
        words = prose(i, int(rng.integers(0, 400))).split()
        for k in set(rng.integers(0, 8, i % 3).tolist()):
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = items[k][1].upper().split()
            want.add((i, k))
        rows.append((i, " ".join(words)))
    indexes = op10.build(bench(spark, items))
    docs = make_docs([*rows, (70, None), (71, ""), (72, " ".join(items[7][1].split()[:10]))])
    marked = op10.mark(docs, indexes, name="score_2")
    got = {(r.doc_id, h.item_id) for r in marked.collect() for h in r.score_2}
    # An item that another one was put inside of may be missed; none here is.
    assert got == want and marked.count() == 43
    assert op10.mark(docs.limit(0), indexes).collect() == []
    assert all(r.hits == [] for r in op10.mark(docs, op10.build(bench(spark, []))).collect())


def test_shards_find_the_same(spark, make_docs, monkeypatch):
    items = [(k, prose(k, 30)) for k in range(7)]
    docs = make_docs([(k, prose(100 + k, 50) + " " + items[k % 7][1]) for k in range(10)])
    whole = {(r.doc_id, h.item_id) for r in op10.mark(docs, op10.build(bench(spark, items))).collect() for h in r.hits}
    monkeypatch.setattr(op10, "ITEMS", 3)
    parts = op10.build(bench(spark, items))
    assert len(parts) == 3
    assert whole == {(r.doc_id, h.item_id) for r in op10.mark(docs, parts).collect() for h in r.hits} >= {(k, k % 7) for k in range(10)}


def test_block_bounds_lose_nothing(spark):
    items = [(k, prose(k, 40)) for k in range(30)]
    index = op10.build(bench(spark, items))[0]
    texts = [prose(k % 30, 40) if k < 10 else prose(k, 90) for k in range(40)]
    import pyarrow as pa

    from llm.shingles import letter_words
    words, first = letter_words(pa.array(texts))
    term = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    term = np.where(index.terms[term] == words, term, -1)
    for least in (0.2, 0.6):
        got = {(r, s, i) for r, s, i, _ in index.search(term, first, least)}
        want = set()
        for r in range(len(texts)):
            for s in range(first[r], first[r] + max(0, -(-(first[r + 1] - first[r] - op10.PASSAGE) // op10.STEP)) * op10.STEP + 1, op10.STEP):
                score = np.zeros(len(items))
                for t in set(term[s : min(s + op10.PASSAGE, first[r + 1])].tolist()) - {-1}:
                    score[index.item[index.first[t] : index.first[t + 1]]] += index.impact[index.first[t] : index.first[t + 1]]
                want |= {(r, s, int(i)) for i in np.flatnonzero(score >= least - 1e-9)}
        assert got == want


def test_long_items_are_found_wherever_they_are(spark, make_docs):
    rng = np.random.default_rng(7)
    sizes = [10, 30, 42, 60, 82, 110, 130, 150, 300, 1000]
    items = [(k, prose(k, n // 2) + "? " + " ".join(f"i{k}w{j}" if j % 3 else "the" for j in range(n - n // 2))) for k, n in enumerate(sizes)]
    rows, want = [], set()
    for i in range(60):
        words, k = prose(1000 + i, int(rng.integers(0, 3000))).split(), i % len(sizes)
        at = int(rng.integers(0, len(words) + 1))
        words[at:at] = items[k][1].upper().split()
        rows.append((i, " ".join(words)))
        want.add((i, k))
    marked = op10.mark(make_docs(rows), op10.build(bench(spark, items)))
    hits = [(r.doc_id, h) for r in marked.collect() for h in r.hits]
    assert {(i, h.item_id) for i, h in hits} == want
    assert all(h.score > 1 - 1e-9 and h.question == h.answer == 1 for _, h in hits)


def test_repeats_within_a_step_do_not_hide_an_item(spark):
    items = [(k, prose(k, 200)) for k in range(12)]
    index = op10.build(bench(spark, items))[0]
    import pyarrow as pa

    from llm.shingles import letter_words
    words, first = letter_words(pa.array([prose(k, 5) + " " + prose(k % 12, 150) + " " + prose(50 + k, 300 * (k % 2)) for k in range(20)] + [""]))
    term = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    term = np.where(index.terms[term] == words, term, -1)
    assert index.passage > 200
    for least in (0.3, 0.6, 0.9):
        got = {(r, s, i) for r, s, i, _ in index.search(term, first, least)}
        want = set()
        for r, (a, b) in enumerate(zip(first, first[1:])):
            for s in range(a, a + max(0, -(-(b - a - index.passage) // index.step)) * index.step + (b > a), index.step):
                score = np.zeros(len(items))
                for t in set(term[s : min(s + index.passage, b)].tolist()) - {-1}:
                    score[index.item[index.first[t] : index.first[t + 1]]] += index.impact[index.first[t] : index.first[t + 1]]
                want |= {(r, s, int(i)) for i in np.flatnonzero(score >= least - 1e-9)}
        assert got == want


def test_pipeline_stage_by_stage(spark, make_docs, messy, tmp_path):
    item = "which " + prose(77, 30) + "? " + prose(78, 10)
    extra = make_docs([(50, prose(60, 80)), (51, item + " " + prose(61, 50)), (52, prose(62, 50) + " " + prose(60, 80))])
    docs = messy.unionByName(extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark, [(1, item)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, at, str(tmp_path))
        if name != "encode":
            assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        at = seen[name] = spark.read.parquet(str(tmp_path / name))
    ids = lambda name: sorted(r.doc_id for r in seen[name].collect() if r.doc_id is not None)
    assert ids("language") == [1, 5, 6, 7, 8, 9, 9, 10, 11, 13, 14, 50, 51, 52]
    assert ids("jaccard") == [1, 5, 9, 9, 10, 11, 13, 50, 51, 52]
    kept = {r.doc_id: r.text for r in seen["suffixes"].collect()}
    assert prose(60, 80) in kept[50] and len(kept[52]) < len(prose(62, 50)) + 100 and kept[1] == prose(1, 120)
    assert 51 not in ids("decontaminate") and set(ids("jaccard")) - {51} == set(ids("decontaminate"))
    assert ids("encode") == ids("decontaminate")
    assert not any(shingles(r.text) and r.n_chars != len(r.text) for r in seen["suffixes"].collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["encode"].count()


def test_empty_pipeline(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark, []).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.lit(True)).collect() == []
