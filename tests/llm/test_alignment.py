import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm import op11_alignment as op
from llm.csr import CSR
from llm.tables import stored


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(libraries, text):
    """Ids and byte ranges of both sides, straight from the libraries; None without tokens."""
    a, b = libraries
    if not text:
        return None
    models = op.tokenizers(op.MODEL_A, op.MODEL_B)
    sides = []
    for ids, model in ((a.encode(" " + text, add_special_tokens=False).ids, models[0]), (b.encode(text), models[1])):
        ends = np.cumsum(model.bytes.length[ids]).tolist()
        if model.bytes.spelled(np.array(ids)).tobytes() != (" " + text).encode():
            return None
        sides.append((ids, [0, *ends[:-1]], ends))
    return sides


def expected(libraries, texts):
    links, rows, counts = [], [], Counter()
    for text in texts:
        sides = plain(libraries, text)
        if sides is None:
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        (a, _, ea), (b, _, eb) = sides
        ends = [e for e in ea if e in set(eb)]
        mine = [(a[ea.index(e)], b[eb.index(e)]) for e in ends]
        groups, i, j = [], 0, 0
        for e in ends:
            k, m = ea.index(e) + 1, eb.index(e) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        rows.append((len(a), len(b), len(ends), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(mine)
        counts.update(mine)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(na, nb, g, len(mine), sum(counts[p] == most[p[1]] for p in mine), sum(counts[p] for p in mine), sha)
            for (na, nb, g, sha), mine in zip(rows, links)]


TEXTS = ["The cat sat on the mat.", "naïve café — 東京 is a city 🙂🙂", "<|endoftext|> and <s> are text", None, "", " ", "  two  spaces\n\ttab",
         "a▁b stays apart", "x", "\x00nul", "aaaa" * 50, "The cat sat on the mat.", "don't 1234567 !!??", " " * 60000 + "end"]


def test_alignment_equals_the_libraries(spark, make_docs, libraries):
    rows = [*enumerate(TEXTS), (None, TEXTS[0])]
    got = op.score_links(stored(op.align(make_docs(rows)), "t")).collect()
    want = expected(libraries, [t for _, t in rows])
    by_id = {(r.doc_id): r for r in got}
    assert len(got) == len(rows)
    for (i, _), w in zip(rows, want):
        r = by_id[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, i


def test_long_white_space_goes_through_the_library(libraries):
    model = op.tokenizers(op.MODEL_A, op.MODEL_B)[0]
    text = "x" + " " * 60000 + "end"
    assert model.encode(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids


def test_messy_and_empty_tables(spark, messy, make_docs, libraries):
    rows = messy.select("doc_id", "text").collect()
    got = op.score_links(stored(op.align(messy, keep=("doc_id", "ids", "score")), "t")).collect()
    want = expected(libraries, [r.text for r in rows])
    key = lambda r: (r is None, r)
    assert sorted(((g.doc_id, g.n_a, g.n_links, g.count_sum, g.groups_sha256) for g in got), key=lambda t: (key(t[0]), t[1:])) == sorted(
        ((r.doc_id, w[0], w[3], w[5], w[6]) for r, w in zip(rows, want)), key=lambda t: (key(t[0]), t[1:]))
    assert op.score_links(stored(op.align(make_docs([])), "t")).collect() == []


@pytest.mark.parametrize("shared", [False, True])
def test_link_rows_by_brute_force(spark, make_docs, libraries, shared):
    texts = TEXTS[:13]
    want = []
    for i, text in enumerate(texts):
        sides = plain(libraries, text)
        if sides is None:
            continue
        (a, sa, ea), (b, sb, eb) = sides
        common = sorted(set(ea) & set(eb))
        group = lambda e: np.searchsorted(common, e)
        for x in range(len(a)):
            for y in range(len(b)):
                both = min(ea[x], eb[y]) - max(sa[x], sb[y])
                if shared and group(ea[x]) == group(eb[y]):
                    want.append((i, x, a[x], y, b[y], 1))
                elif not shared and both > 0:
                    want.append((i, x, a[x], y, b[y], both))
    got = op.link_rows(make_docs(enumerate(texts)), shared=shared).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    if shared:
        counted = {r.doc_id: r.n_shared for r in op.align(make_docs(enumerate(texts))).collect()}
        assert counted == {i: sum(w[0] == i for w in want) for i in range(len(texts))}


def test_product_by_brute_force():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 3, (17, 9)) * (rng.random((17, 9)) < 0.4), rng.integers(0, 4, (9, 13)) * (rng.random((9, 13)) < 0.5)

    def sparse(m):
        row, col = np.nonzero(m)
        return CSR(np.searchsorted(row, np.arange(len(m) + 1)), col, m[row, col], m.shape[1])

    for cells in (1, 7, 10_000):
        out = np.zeros((17, 13), np.int64)
        for first, block in sparse(x).product(sparse(y), cells):
            for r in range(block.rows):
                for p in range(block.first[r], block.first[r + 1]):
                    out[first + r, block.at[p]] += block.value[p]
        assert (out == x @ y).all()
    back = sparse(x).transposed().transposed()
    assert (back.at == sparse(x).at).all() and (back.first == sparse(x).first).all()


def test_pairs_that_end_together_are_bounded_by_the_vocabularies(spark, make_docs):
    """Of two ids that end together one spells a suffix of the other."""
    models = op.tokenizers(op.MODEL_A, op.MODEL_B)
    width = len(models[1].bytes.length)
    pairs = [r.pair for r in op.pair_counts(op.align(make_docs(enumerate(TEXTS)))).collect()]
    for p in pairs:
        a, b = (m.bytes.spelled(np.array([i])).tobytes() for m, i in zip(models, divmod(p, width)))
        assert a.endswith(b) or b.endswith(a)
