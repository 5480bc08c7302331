import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from playbill.operators import extraction
from playbill.operators.keyed import id_range
from playbill.sources import responses

GOOD = {"gigs": [
    {"title": "Salt Choir", "date": "2026-02-15T20:00:00", "venue_name": "Old Depot", "description": "Three voices and a drum",
     "price": "€15", "url": "https://depot.example/salt", "image_url": "https://depot.example/salt.png"},
    {"title": "Paper Boats", "date": "2026-02-16T21:00:00", "venue_name": "", "description": "Slow songs",
     "price": "Free", "ticket_url": "www.more.com/x", "url": "https://boats.example/live"}]}

TEXTS = [
    (json.dumps(GOOD), 2), ("not json", 0), ("{}", 0), ('{"gigs":[]}', 0), ('{"gigs":null}', 0), ("", 0), (None, 0),
    (json.dumps(GOOD) + " thanks", 0), ("Here: " + json.dumps(GOOD), 0), (json.dumps(GOOD)[:-2], 0),
    ('{"gigs":[1, null, {"title":"ok"}]}', 1), ('{"gigs":{"a":1}}', 0), ("{'gigs':[{'title':'a'}]}", 0),
    ('{"gigs":[{"title":"n","price":10}]}', 1), (json.dumps(GOOD) + " \n", 2),
]


def test_response_texts(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "batch long, response string")
    parsed = responses.parse_gig_responses(frame, "response", "batch")
    got = {r.batch: r.n for r in parsed.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A record that is not an object has no fields and goes with the undated ones.
    dated = {i: n for i, (_, n) in enumerate(TEXTS) if n}
    titled = parsed.where("title is not null").groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in titled} == dated
    assert set(got) >= set(dated)


def test_normalized_records(spark):
    frame = spark.createDataFrame([(0, json.dumps(GOOD)), (1, '{"gigs":[{"title":"x","date":"soon"}]}')],
                                  "batch long, response string")
    rows = extraction.candidates(frame).orderBy("i").collect()
    assert [(r.title, r.date, r.venue_name, r.price, r.url) for r in rows] == [
        ("Salt Choir", datetime(2026, 2, 15, 18), "Old Depot", "€15", "https://depot.example/salt"),
        ("Paper Boats", datetime(2026, 2, 16, 19), "Unknown Venue", "Free", "https://www.more.com/x")]
    assert [r.i for r in rows] == [0, 1]


def test_url_lists(spark):
    frame = spark.createDataFrame([('{"promising_urls":["a","b"]}',), ("x",), ("{}",)], "response string")
    got = responses.parse_url_list(frame, "response", "promising_urls").collect()
    assert [(r.pos, r.url) for r in got] == [(0, "a"), (1, "b")]


def test_batches(spark):
    pages = spark.range(0, 50, 5).select("id", F.col("id").cast("string").alias("url"), F.lit("c").alias("content"))
    chunks = extraction.chunk(pages, ["id"], id_range(F.col("id"), 15))
    got = {r.batch: [p.url for p in r.pages] for r in extraction.collect_batches(chunks).collect()}
    assert got == {i: [str(10 * i), str(10 * i + 5)] for i in range(5)}


def test_batches_of_sparse_keys(spark):
    """Keys anywhere in 64 bits, without ranges given by the caller."""
    pages = spark.range(5000).select(F.xxhash64("id").alias("id"), F.col("id").cast("string").alias("url"), F.lit("c").alias("content"))
    got = sorted((r.batch, r.slot, r.id) for r in extraction.chunk(pages, ["id"], size=3).collect())
    assert [(b, s) for b, s, _ in got] == [(n // 3, n % 3) for n in range(5000)]
    assert [i for _, _, i in got] == sorted(r.id for r in pages.collect())
    assert extraction.chunk(pages.limit(0), ["id"]).collect() == []


@pytest.fixture(scope="module")
def batches(spark):
    pages = [(0, [(0, "u0", "Red Lanterns @ STEGI 2026-02-15T20:00 €12-€15 heavy rock (https://www.more.com/w) doors 20:00")]),
             (1, [(0, "u1", "no date here"), (1, "u2", "Ida Moss at Copper Room, 01/12/2026 free entry, folk")])]
    return spark.createDataFrame(pages, "batch long, pages array<struct<slot int, url string, content string>>")


def test_rules_answer(batches):
    rows = {r.batch: json.loads(r.response)["gigs"] for r in extraction.score_batches(batches).collect()}
    assert rows[0] == [{"title": "Red Lanterns @ STEGI", "date": "2026-02-15T20:00", "venue_name": "STEGI",
                        "description": "€12-€15 heavy rock (https://www.more.com/w) doors 20:00", "price": "€12-€15",
                        "ticket_url": "https://www.more.com/w", "url": "u0"}]
    assert [(g["title"], g["venue_name"], g["price"]) for g in rows[1]] == [("Ida Moss at Copper Room", "Copper Room", "free entry")]


def test_failed_batch_is_isolated(batches):
    def fn(prompt):
        if "Moss" in prompt:
            raise RuntimeError("busy")
        return '{"gigs": [{"title": "t", "date": "2026-01-01"}]}'

    scored = extraction.score_batches(batches, fn)
    rows = {r.batch: (r.response is not None, r.error) for r in scored.collect()}
    assert rows == {0: (True, None), 1: (False, "RuntimeError: busy")}
    assert tuple(extraction.batch_counts(scored).first()) == (1, 1)
    assert extraction.candidates(scored).count() == 1


def test_failed_calls_are_made_again(batches):
    def fn(prompt, calls=[]):  # noqa: B006  # the list lives as long as the worker's copy of the function
        calls.append(prompt)
        if len(calls) % 3:
            raise RuntimeError("busy")
        return '{"gigs": [{"title": "t", "date": "2026-01-01"}]}'

    frame = batches.coalesce(1)
    assert {r.error for r in extraction.score_batches(frame, fn).collect()} == {None}
    assert {r.error for r in extraction.score_batches(frame, fn, attempts=1).collect()} == {"RuntimeError: busy"}


def test_rules_on_records(spark):
    at = datetime(2026, 5, 1, 18)
    rows = [(0, 0, "Band @ Hall", at, "Hall", "indie"), (0, 1, "BAND", at, "Hall", "indie"), (1, 0, "Band", at, "Hall", "indie"),
            (0, 2, "Other", at, "Patras Hall", "rock"), (0, 3, "Old", datetime(2025, 1, 1), "Hall", "rock"),
            (0, 4, "DJ", at, "Hall", "techno"), (0, 5, "None", at, "Hall", None)]
    frame = spark.createDataFrame(rows, "batch long, pos int, title string, date timestamp_ntz, venue_name string, description string")
    got = extraction.apply_rules(frame, "2026-01-01").collect()
    assert sorted((r.batch, r.pos, r.title) for r in got) == [(0, 0, "Band"), (1, 0, "Band")]


def test_prompts(spark, batches):
    text = batches.select(extraction.render_prompt("batch", pages=F.col("pages")).alias("p")).orderBy("batch").collect()[1].p
    assert "--- page 1 ---\nSource: u1\n\nno date here\n\n--- page 2 ---" in text
    one = spark.range(1).select(extraction.render_prompt(
        "links", url=F.lit("u"), title=F.lit(""), links=F.array(F.lit("a"), F.lit("b"))).alias("p")).first().p
    assert one.endswith("Page: u\nTitle: N/A\nLinks (2):\n1. a\n2. b")
    with pytest.raises(ValueError):
        extraction.render_prompt("other")


def test_index_range(spark):
    frame = spark.createDataFrame([(1, 2), (0, 1 << 24), (1 << 38, 0), (-1, 0), (None, 0)], "batch long, pos int")
    got = [r.i for r in frame.select(extraction.extraction_index(F.col("batch"), F.col("pos")).alias("i")).collect()]
    assert got == [(1 << 24) + 2, None, None, None, None]


def test_every_event_of_a_page(spark):
    text = ("Salt Choir @ Old Depot - 2026-02-15T20:00 €10 slow rock. Paper Boats at Mill, 16/02/2026 Free entry (https://www.more.com/b) "
            "Ida Moss | 2026-03-01 sold out")
    frame = spark.createDataFrame([("u", text), ("v", "no date"), ("w", "2026-01-01 no headline"), ("x", None)], "url string, content string")
    got = {r.url: r.e for r in frame.select("url", extraction.extract_events(F.col("url"), F.col("content")).alias("e")).collect()}
    assert [(e.title, e.date, e.venue_name, e.price, e.ticket_url) for e in got["u"]] == [
        ("Salt Choir @ Old Depot", "2026-02-15T20:00", "Old Depot", "€10", None),
        ("Paper Boats at Mill", "16/02/2026", "Mill", "Free entry", "https://www.more.com/b"),
        ("Ida Moss", "2026-03-01", None, "sold out", None)]
    assert got["v"] == got["w"] == got["x"] == []


AGENDAS = {
    # Dates that lead, with and without full stops, behind a header, as a list with bars.
    "first": "2026-02-15 Band One at Club A €10. 2026-02-20 Band Two at Club B €15.",
    "first, no stops": "2026-02-15 Band One at Club A €10 2026-02-20 Band Two at Club B €15",
    "first, header": "Upcoming shows. 2026-02-15 Band One at Club A €10. 2026-02-20 Band Two at Club B €15. All rights reserved.",
    "first, bars": "2026-02-15 | Band One | Club A | €10 | 2026-02-20 | Band Two | Club B | €15",
    "first, times": "2026-02-15 20:30 Band One @ Club A €10. 2026-02-20 21:00 Band Two @ Club B €15.",
    # Dates that trail.
    "last": "Band One @ Club A 2026-02-15 €10. Band Two @ Club B 2026-02-20 €15.",
    "last, no stops": "Band One @ Club A 2026-02-15 €10 Band Two @ Club B 2026-02-20 €15",
    "last, bars": "Band One | Club A | 2026-02-15 | €10 | Band Two | Club B | 2026-02-20 | €15",
    "last, described": "Band One @ Club A, 2026-02-15 €10 slow rock. Band Two @ Club B. 2026-02-20 €15 folk songs.",
    # Both on one page.
    "mixed": "Band One @ Club A 2026-02-15 €10. 2026-02-20 Band Two at Club B €15.",
}


@pytest.mark.parametrize("name", AGENDAS)
def test_dates_lead_or_trail(spark, name):
    frame = spark.createDataFrame([("u", AGENDAS[name])], "url string, content string")
    events = frame.select(extraction.extract_events(F.col("url"), F.col("content")).alias("e")).first().e
    got = [(e.title.split(" @ ")[0].split(" at ")[0], e.date, e.venue_name, e.price) for e in events]
    assert got == [("Band One", "2026-02-15", "Club A", "€10"), ("Band Two", "2026-02-20", "Club B", "€15")]


def test_five_events_in_any_order(spark):
    text = ("Agenda. Band One @ Club A 2026-02-15 €10. 2026-02-20 Band Two at Club B €15. Band Three @ Club C 2026-02-25 free entry. "
            "2026-03-01 Band Four at Club D. Band Five @ Club E 2026-03-05 sold out.")
    frame = spark.createDataFrame([("u", text)], "url string, content string")
    events = frame.select(extraction.extract_events(F.col("url"), F.col("content")).alias("e")).first().e
    assert [(e.date, e.venue_name, e.price) for e in events] == [
        ("2026-02-15", "Club A", "€10"), ("2026-02-20", "Club B", "€15"), ("2026-02-25", "Club C", "free entry"),
        ("2026-03-01", "Club D", "N/A"), ("2026-03-05", "Club E", "sold out")]


def test_a_text_between_two_dates_counts_once(spark):
    frame = spark.createDataFrame([("u", "2026-02-15 Band One at Club A 2026-02-20"), ("v", "2026-02-15 | 2026-02-16")], "url string, content string")
    got = [[(e.title, e.date) for e in r.e] for r in frame.select(extraction.extract_events(F.col("url"), F.col("content")).alias("e")).collect()]
    assert [len(g) for g in got] == [1, 0] and got[0][0][0] == "Band One at Club A"


def test_a_page_is_cut_at_its_dates_once(spark):
    pages = spark.createDataFrame([("u", "Band @ Hall 2026-02-15 €10")], "url string, content string")
    plan = pages.select(extraction.extract_events(F.col("url"), F.col("content")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {extraction._DATE}, -1)") <= 2


@pytest.mark.parametrize("content, dates", [
    ("2026-02-15 Band @ Hall €10", ["2026-02-15"]), ("Band @ Hall 2026-02-15T20:30", ["2026-02-15T20:30"]),
    ("Band @ Hall 15/02/2026 €10", ["15/02/2026"]), ("A @ B 2026-02-15 €1. C @ D 2026-02-15 €2.", ["2026-02-15"] * 2),
    ("A @ B 2026-02-15T20 or later", ["2026-02-15"]), ("Act 12 @ Hall 3 2026-02-155 €1", ["2026-02-15"]), ("no date 12/3", [])])
def test_dates_are_found_and_cut_off(spark, content, dates):
    got = spark.createDataFrame([(content,)], "c string").select(extraction.extract_events(F.lit("u"), F.col("c")).alias("e")).first().e
    assert [e.date for e in got] == dates
    assert not any(d in e.title for e in got for d in dates)
