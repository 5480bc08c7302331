import pytest
from pyspark.sql import functions as F

from playbill.functions import base, rules, text

PRICES = [
    ("€16", "€16"), ("18€", "€18"), ("29,50", "€29"), ("27.50", "€27"), ("€20-€30", "€20"), ("30-20", "€20"),
    ("Sold  Out!", "Sold Out"), ("SOLDOUT", "Sold Out"), ("FREE entry", "Free"), ("carefree", "Free"),
    ("N/A", None), ("n/a", None), ("€", None), ("EUR", None), ("", None), ("   ", None), ("tba", None),
    ("€0.40", None), ("0", None), ("1.000,50", "€1"), (" €15 ", "€15"), ("€15/€12 presale", "€12"), (None, None),
    ("free or 10", "Free"), ("9" * 400, None), ("1" * 15, "€" + "1" * 15),
]


def test_prices(apply):
    assert apply(text.normalize_price, [p for p, _ in PRICES]) == [want for _, want in PRICES]


def test_prices_are_stable(apply):
    once = apply(text.normalize_price, [p for p, _ in PRICES if p is None or len(p) < 100])
    assert apply(text.normalize_price, once) == once


def test_price_amount(apply):
    assert apply(text.price_eur, ["€12", "Free", None, "Sold Out"]) == [12, None, None, None]


URLS = [
    ("http://x.gr/a", "http://x.gr/a"), ("HTTPS://x", "HTTPS://x"), ("www.x.gr", "https://www.x.gr"),
    ("x.gr/e", "https://x.gr/e"), ("tickets", None), ("", None), ("a b.c", None), (None, None),
    (" x.gr\n", "https://x.gr"), ("ftp://x.gr", "https://ftp://x.gr"), ("a.b c", "https://a.b c"),
]


def test_urls(apply):
    assert apply(text.normalize_url, [u for u, _ in URLS]) == [want for _, want in URLS]


def test_url_fallbacks(spark):
    frame = spark.createDataFrame([("t.gr", "u.gr"), (None, "u.gr"), ("x", "y"), (None, None)], "a string, b string")
    got = frame.select(text.gig_url(F.col("a"), F.col("b")).alias("g"),
                       text.gig_url_on_page(F.col("a"), F.col("b")).alias("p")).collect()
    assert [tuple(r) for r in got] == [
        ("https://t.gr", "https://t.gr"), ("https://u.gr", "u.gr"), ("", "y"), ("", None)]


TITLES = [("Red Lanterns @ STEGI", "Red Lanterns"), ("Nikos Petrou @ Η Αυλή", "Nikos Petrou"),
          ("Band Name at Venue", "Band Name"), ("Matthew", "Matthew"), ("Live AT Six", "Live"), ("At Sea", "At Sea")]


def test_titles(apply):
    assert apply(text.clean_title, [t for t, _ in TITLES]) == [want for _, want in TITLES]


def test_names(apply):
    assert apply(text.venue_or_default, ["", None, "Fuzz"]) == ["Unknown Venue", "Unknown Venue", "Fuzz"]
    keys = apply(text.name_key, ["ΟΔΟΣ", "οδος", "Οδοσ"])
    assert len(set(keys)) == 1
    assert apply(lambda c: text.eq_ci(c, "six DOGS"), ["Six Dogs", "Six Dog"]) == [True, False]


def test_truncate_counts_utf16_units(apply):
    values = ["abcdef", "ab😀cd", "a😀😀", "😀", "", None]
    want = [None if v is None else v.encode("utf-16-le")[:6].decode("utf-16-le", "ignore") for v in values]
    assert apply(lambda c: base.truncate(c, 3), values) == want
    assert apply(base.utf16_length, ["ab", "a😀", ""]) == [2, 3, 0]


def test_squeeze(apply):
    assert apply(base.squeeze, [" a\t\n b ", "a  b﻿", "a b", "　", "a  b   c"]) == [
        "a b", "a b", "a b", "", "a b c"]


def test_labels(spark):
    frame = spark.createDataFrame([("€5", "u"), (None, "u"), ("€5", ""), ("", None)], "price string, url string")
    rows = frame.select(text.price_label(F.col("price"), F.col("url")).alias("d"),
                        text.price_label(F.col("price"), F.col("url"), "mobile").alias("m")).collect()
    assert [tuple(r) for r in rows] == [("€5", "€5"), ("Info", "Info"), ("€5", "€5"), ("—", None)]


def test_hit_text_and_list(spark):
    frame = spark.createDataFrame([("u", "t", "")], "u string, t string, d string")
    row = frame.select(text.hit_text(F.col("u"), F.col("t"), F.col("d")).alias("h"),
                       text.numbered(F.array("u", "t")).alias("n")).first()
    assert row.h == "URL: u\nTitle: t\nDescription: N/A"
    assert row.n == "1. u\n2. t"


def test_citations(apply):
    assert apply(text.strip_citations, [
        'Here:\n[{"a":1}]\n<citation>{"index":[1]}</citation>', "<usage>[1]</usage>", "none"]) == ['[{"a":1}]', None, None]


@pytest.mark.parametrize("about, ok", [
    ("Post Punk night", True), ("indie pop", False), ("rocks", False), ("Rock!", True), ("jazz", True),
    ("hip hop and rock", False), ("έντεχνο", False), ("popular folk", True), ("", False)])
def test_genres(apply, about, ok):
    assert apply(rules.genre_ok, [about]) == [ok]


def test_cities(apply):
    assert apply(rules.city_ok, ["Hall, Patras", "Athens", None, "Patrasville"]) == [False, True, True, True]
    assert apply(lambda c: rules.genre_ok(c, rules.KEEP_GENRES), ["jazz"]) == [False]


def test_event_links(apply):
    urls = ["https://x.gr/event/a", "https://x.gr/t/12", "https://x.gr/t/12a", "https://x.gr/events", "https://x.gr/",
            "https://x.gr/category/event/", "https://x.gr/show/events-night", "https://x.gr/GIG/x?y"]
    assert apply(rules.is_event_link, urls) == [True, True, False, False, False, False, True, True]


def test_white_space_is_one_set(spark):
    """The pattern, its short form and the plain characters name the same ones."""
    every = spark.range(1, 0xD800).union(spark.range(0xE000, 0x10000)).select(F.decode(F.encode(F.char(F.lit(97)), "UTF-8"), "UTF-8").alias("a"), "id")
    wide = every.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    got = wide.where(F.col("c").rlike(rf"\A{base.WS}\z") != F.col("c").rlike(rf"\A[{base.SPACE}]\z")).collect()
    assert got == []
    trimmed = wide.where((base.trim_text(F.col("c")) == "") != F.col("c").rlike(rf"\A[{base.SPACE}]\z")).collect()
    assert trimmed == []
    assert wide.where(F.col("c").rlike(base.WS)).count() == len(base.SPACE_MARKS)


def test_words_in_any_place(apply):
    texts = ["rock", "Rocks", "hard rock!", "post rock", "krock", "hip-hop", "hip hop night", "λαϊκά", "άrock", "x\nrap", "trap"]
    assert apply(lambda c: c.rlike(rules.any_word(rules.KEEP_GENRES)), texts) == [
        True, False, True, True, False, False, False, False, False, False, False]
    assert apply(lambda c: c.rlike(rules.any_word(rules.SKIP_GENRES)), texts) == [
        False, False, False, False, False, True, True, True, False, True, True]
