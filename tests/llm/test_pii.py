import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from llm import op13_pii as op

# The base patterns as they are stated, for Python's engine.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for place, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), place, m.end()))
    return sorted(out)


def based(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.base for r in op.mark(rows, keep=("i",)).collect()}
    return [[tuple(s) for s in got[i]] for i in range(len(texts))]


CASES = [
    None, "", "nothing here", "a@b.c", "a@b.c._x@y.z", "a@b.c@d.e", "x a@b b@c.d.", "é😀 a@b.co é b@c.io", "a@b.c.d..e a@-.-",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 000000001.2.3.0255 1.2.3.", "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111",
    "+1 (017) 555-7713, +30 210 1234567. +1 ((((((", "+1 5 +44 20 7946 0958) x", "1-2-3-4", "mail a.b%c+d-e@x-y.z9.q now",
    "9" * 3000, "1.2.3.4 " * 700, ".a" * 3000 + "@" + "b." * 3000, "+1" * 500, "a@" * 300, "1 " * 2000 + "+1 017 555 7713",
    "6011000990139424 1.1.1.1 6011 0009 9013 9424 q@w.e +12345678901",
]


def test_base_spans_equal_the_stated_patterns(spark):
    assert based(spark, CASES) == [plain(t) for t in CASES]


def test_base_spans_of_random_texts(spark):
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.text("0123456789.+- ()@ab_é😀\n", max_size=60), min_size=30, max_size=60))
    def same(texts):
        assert based(spark, texts) == [plain(t) for t in texts]

    same()


def found(df):
    return op.find_identifiers(df, keep=("doc_id",))


def learned(make_docs, extra=()):
    rows = [(i, f"Please call +1 (017) 555-77{i:02d} soon, or write. Nothing else.") for i in range(12)]
    rows += [(20, "You may call 017 555-9913 soon."), (21, "The total was 017 555-9914 units."), (22, "Serial no. 20240101 of a box.")]
    return make_docs([*rows, *extra])


def test_contexts_of_seeds_find_unseen_identifiers(spark, make_docs):
    spans, patterns = found(learned(make_docs))
    got = {r.doc_id: [tuple(s) for s in r.added] for r in spans.collect()}
    text = "You may call 017 555-9913 soon."
    assert got[20] == [(text.index("017"), op.KINDS.index("phone"), text.index(" soon"))]
    assert not any(v for k, v in got.items() if k != 20)
    best = {r.pattern: r for r in patterns.collect()}
    assert best["call _"].trusted >= 12 and best["call _"].confidence > 0.8


def test_copies_teach_nothing(spark, make_docs):
    rows = [(i, "Please call +1 (017) 555-7713 soon.") for i in range(30)] + [(40, "Please call 017 555-9913 soon.")]
    assert not any(r.added for r in found(make_docs(rows))[0].collect())


def test_unsure_contexts_add_nothing(spark, make_docs):
    """As many other numbers as phones stand behind this word."""
    rows = [(i, f"see +1 (017) 555-77{i:02d} ok") for i in range(5)] + [(50 + i, f"see 20240{i:03d} ok") for i in range(40)]
    assert not any(r.added for r in found(make_docs(rows))[0].collect())


def test_rounds_reach_patterns_beside_found_instances(spark, make_docs):
    """Numbers found behind `call` are the only evidence for `reach`."""
    rows = [(i, f"call +1 (017) 555-77{i:02d} ok") for i in range(30)]
    rows += [(100 + i, f"call 017 555-99{i:02d} ok") for i in range(4)] + [(200 + i, f"reach 017 555-99{i:02d} x") for i in range(4)]
    rows += [(300, "reach 017 555-4411 x")]
    graph = op.edges(op.mark(make_docs(rows)))
    one = {r.pattern for r in op.score_patterns(graph, rounds=1).collect()}
    more = {r.pattern for r in op.score_patterns(graph, accept=0.4).collect()}
    assert "call _" in one and "reach _" not in one and "reach _" in more


def test_added_spans_stay_clear_of_base_spans(spark, make_docs):
    extra = [(30, "call 017 555-9913 +1 (017) 555-7799 ok"), (31, "call 1.2.3.4 017 555 ok")]
    for r in found(learned(make_docs, extra))[0].collect():
        taken = sorted([(s.start, s.end) for s in [*r.base]])
        for s in r.added:
            assert all(s.end <= a or s.start >= e for a, e in taken)
        assert [tuple(s) for s in r.base] == plain({30: extra[0][1], 31: extra[1][1]}.get(r.doc_id)) or r.doc_id < 30


def test_messy_and_empty_tables(spark, messy, make_docs):
    spans, _ = op.find_identifiers(messy, keep=("doc_id", "ids", "n"))
    assert spans.count() == messy.count() and spans.columns == ["doc_id", "ids", "n", "base", "added"]
    assert found(make_docs([]))[0].collect() == []


def test_query_columns(spark, tmp_path, make_docs):
    learned(make_docs, [(60, CASES[-1]), (61, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in op.op13_pii(spark, str(tmp_path)).collect()}
    names = list(STATED)
    for r in rows.values():
        assert r.n_email + r.n_ip + r.n_card + r.n_phone <= len([s for s in r.spans.split(",") if s])
    want = plain(CASES[-1])
    text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
    assert rows[60].spans == text and rows[60].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert [rows[60].n_email, rows[60].n_ip, rows[60].n_card, rows[60].n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
    assert rows[61].spans == "" and rows[61].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "phone:13:25" in rows[20].spans
