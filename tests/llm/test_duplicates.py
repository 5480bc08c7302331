import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import components as cc
from llm import op4_embeddings as op4
from llm import op6_suffix as op6
from llm import op7_jaccard as op7
from llm import tables
from llm.suffixes import common_prefixes, suffix_arrays
from tests.llm.conftest import prose


def closed(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [*zip(range(30), range(1, 31)), *((100, int(x)) for x in range(200, 260)), *rng.integers(300, 360, (40, 2)).tolist()]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame([(int(a), int(b)) for a, b in links], "a long, b long"), "a", "b").collect()}
    want = closed(400, links)
    used = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in used}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(150)]
    for base in (3, 40):
        rows += [(200 + base + k, (np.array(rows[base][1]) + 0.25 * rng.standard_normal(24)).tolist()) for k in range(25)]
    rows += [(500 + k, rows[7][1]) for k in range(4)] + [(600, None), (601, [0.0] * 24), (602, []), (603, [float("nan")] * 24), (604, [None, 1.0]),
             (605, [2 * x for x in rows[7][1]]), (None, rows[7][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("w", F.lit(1))
    got = [tuple(r) for r in op4.near_copies(frame).where("vec_id is not null").collect()]
    assert len(got) == len(rows) - 1
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in fine])
    links = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))
    degree = np.bincount(links.ravel(), minlength=len(fine))
    label = closed(len(fine), links.tolist())
    want = {i: (int(degree[k]), min(fine[m][0] for m in range(len(fine)) if label[m] == label[k])) for k, (i, _) in enumerate(fine)}
    want.update({i: (0, i) for i, _ in rows if i is not None and i not in want})
    assert {i: (n, c) for i, n, c in got} == want
    assert op4.near_copies(frame.limit(0)).collect() == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((400, 64))
    other -= (other * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * other / np.linalg.norm(other, axis=1, keepdims=True)
    for n in (500, 50_000):
        size, filters = op4.plan(n)
        met = np.zeros(len(x), bool)
        for seed in range(op4.CODES):
            height = op4.cap_height(64, size, filters, seed)
            both = set(zip(*map(np.ndarray.tolist, op4.decode(x, size, height, seed)))) & set(zip(*map(np.ndarray.tolist, op4.decode(y, size, height, seed))))
            met[[r for r, _ in both]] = True
        assert met.mean() >= 0.97


def test_hot_filters_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(op4, "CHUNK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(32)
    rows = [(i, (base + 0.05 * rng.standard_normal(32)).tolist()) for i in range(120)]
    out = op4.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(119, 0)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def check_jaccard(docs):
    rows = {r.doc_id: shingles(r.text) for r in docs.collect() if r.doc_id is not None}
    ids = sorted(rows)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if rows[ids[a]] and rows[ids[b]]
             and 100 * len(rows[ids[a]] & rows[ids[b]]) >= 75 * len(rows[ids[a]] | rows[ids[b]])]
    label = closed(len(ids), links)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in op7.similar_documents(docs).collect() if r.doc_id is not None]
    assert {g[0]: g[1:] for g in got} == {i: (len(rows[i]), ids[label[k]]) for k, i in enumerate(ids)}
    assert len(got) == docs.where("doc_id is not null").count()


def test_jaccard_of_messy_rows(messy):
    check_jaccard(messy)
    assert op7.similar_documents(messy.limit(0)).collect() == []


def test_jaccard_with_frequent_columns(make_docs):
    rng = np.random.default_rng(8)
    base, line = prose(50, 90).split(), prose(51, 70)
    rows = []
    for i in range(90):  # a group of near copies that is larger than FREQUENT, at all distances
        words = list(base)
        for at in rng.integers(0, 90, rng.integers(0, 5)):
            words[at] = f"w{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, line + " " + prose(200 + i, int(rng.integers(5, 60)))) for i in range(80)]  # one passage in many texts
    rows += [(300 + i, prose(900 + i // 2, 40 + i)) for i in range(40)]
    check_jaccard(make_docs(rows))


def test_suffix_arrays_of_many_lanes():
    rng = np.random.default_rng(0)
    for trial in range(60):
        lanes = [[*rng.integers(1, 4, rng.integers(0, 30)).tolist() * (1 + trial % 3), 0] for _ in range(rng.integers(1, 9))]
        lanes.sort(key=lambda t: -len(t))
        size, text = np.array([len(t) for t in lanes]), np.concatenate(lanes).astype(np.int64)
        sa = suffix_arrays(text, size, np.full(len(lanes), 4))
        shared = common_prefixes(text, size, sa)
        at = 0
        for t in lanes:
            want = sorted(range(len(t)), key=lambda i: t[i:])
            assert sa[at : at + len(t)].tolist() == want
            for k in range(1, len(t)):
                x, y = t[want[k] :], t[want[k - 1] :]
                assert shared[at + k] == next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            at += len(t)


def cut(rows, width=100):
    seen, out = set(), {}
    for i, text in sorted(set((i, t or "") for i, t in rows if i is not None)):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - width + 1):
            w = raw[k : k + width]
            if w in seen:
                gone[k : k + width] = True
            seen.add(w)
        out[i] = hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()
    return out


def test_repeats_against_brute_force(make_docs, messy, monkeypatch):
    monkeypatch.setattr(op6, "SHARD", 6)
    passage = prose(70, 30)
    rows = [(i, prose(300 + i, 10 + i % 40) + " " + passage[i % 3 :] + " " + prose(700 + i, 20)) for i in range(40)]
    rows += [(50, "ab" * 400), (51, "b" + "ab" * 100), (52, "ü" * 200), (53, passage * 3)]
    for docs in (messy, make_docs(rows)):
        pairs = [(r.doc_id, r.text) for r in docs.collect()]
        got = op6.without_repeats(docs).collect()
        assert len(got) == len(pairs)
        want = cut(pairs)
        for r in got:
            if r.doc_id is not None:
                assert hashlib.sha256(r.kept).hexdigest() == want[r.doc_id], r.doc_id
                assert sum(s.length for s in r.spans) == r.n_bytes - len(r.kept)
    assert op6.without_repeats(messy.limit(0)).collect() == []


def test_a_passage_with_many_neighbours_is_split(make_docs, monkeypatch):
    """Shards of hundreds of distinct segments go through pieces and windows; none is sorted whole."""
    monkeypatch.setattr(op6, "SHARD", 3)
    most = []
    sort = op6.shard_repeats
    monkeypatch.setattr(op6, "shard_repeats", lambda segs, width: most.append(
        segs.groupBy("shard").count().agg(F.max("count")).first()[0] or 0) or sort(segs, width))
    passage = prose(71, 40)
    rows = [(i, prose(1000 + i, 3) + passage[i % 7 : 120 + i % 90] + prose(2000 + i, 3 + i % 4)) for i in range(150)]
    rows += [(200 + i, "ab" * (60 + i) + passage[:40]) for i in range(12)] + [(300, "x" * 500), (301, "x" * 300 + passage[:150])]
    got = {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in op6.without_repeats(make_docs(rows)).collect()}
    assert got == cut(rows)
    assert len(most) == 2 and max(most) <= 3


def test_joins_with_counts_read_stored_tables(spark, make_docs, monkeypatch):
    """A join meets its counts as files, not as an aggregate of the same exchange, so a hot anchor can be split."""
    plans = []
    keep = op6.stored

    def note(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return keep(df, label)

    monkeypatch.setattr(op6, "stored", note)
    op6.without_repeats(make_docs([(i, prose(i % 3, 60)) for i in range(9)])).collect()
    joined = [(label, plan) for label, plan in plans if label in ("segments", "piece_shards")]
    assert len(joined) == 2 and all("Join" in plan and "Aggregate" not in plan for _, plan in joined)


def test_columns_with_the_same_rows_become_one(spark):
    cells = [(d, h) for h, rows in {1: (5, 7), 2: (5, 7), 3: (5, 7, 9), 4: (5, 8, 9), 5: (6, 6), 6: (7, 7), 7: (5,), 8: (5, 8, 9)}.items() for d in rows]
    got = op7.merged_columns(spark.createDataFrame(cells, "doc_id long, h long")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 2), (3, 3, 1), (4, 3, 2), (5, 2, 1), (6, 2, 1)]


def test_a_stored_count_lets_spark_split_a_hot_column(spark):
    """The join of cells with their columns reads both sides from files, right before its exchange."""
    cells = spark.range(1000).selectExpr("id as doc_id", "id % 3 as h")
    columns = op7.stored(op7.merged_columns(cells), "columns")
    plan = op7.stored(cells, "shared").join(columns.hint("merge"), "h")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 2


@pytest.mark.parametrize("kind", ["long", "string"])
def test_among_keeps_all_keys_and_few_other_rows(spark, kind):
    rows = spark.range(20_000).selectExpr(f"cast(id as {kind}) as d", "id as v").union(spark.sql(f"select cast(null as {kind}), -1L"))
    keys = spark.range(7, 20_000, 40).selectExpr(f"cast(id as {kind}) as d").union(spark.sql(f"select cast(7 as {kind})"))
    got = tables.among(rows, keys, "d")
    assert got.columns == ["d", "v"]
    found = sorted(r.v for r in got.collect())
    assert set(range(7, 20_000, 40)) <= set(found) and len(found) == len(set(found)) < 510
    assert tables.among(rows, keys.limit(0), "d").collect() == []


def test_jaccard_moves_no_text_that_it_does_not_need(make_docs, monkeypatch):
    """Texts are filtered before the join with the ids needed, copies are looked up behind the join that drops most
    cells, and a turn without pairs reads no sets."""
    plans, checked, keep, verify = {}, [], op7.stored, op7.verify

    def note(df, label):
        plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(op7, "stored", note)
    monkeypatch.setattr(op7, "verify", lambda *a: checked.append(1) or verify(*a))
    base = prose(70, 80)
    check_jaccard(make_docs([(1, base), (2, base), (3, base + " more"), *((10 + i, prose(80 + i, 60)) for i in range(20))]))
    assert "LeftAnti" not in plans["shared"] and plans["shared"].index("LeftOuter") < plans["shared"].index("Inner")
    joins = [line for line in plans["sets"].splitlines() if "Join" in line]
    assert len(joins) == 2 and "_bucket" not in joins[0] and "_bucket" in joins[1]
    assert len(checked) == 1
