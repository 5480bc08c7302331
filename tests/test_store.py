from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from playbill import schemas
from playbill.operators.listing import upcoming
from playbill.operators.extraction import apply_rules, candidates
from playbill.operators.reconcile import gig_outcomes
from playbill.plans.sync import SyncOptions, page_facts, run_sync, sync_store
from playbill.session import materialize
from playbill.sources.jdbc import jdbc_options
from playbill.sources.pages import read_pages, scrape_counts, scrape_rows, successful, with_text
from playbill.sources.store import Conflict, Head, Store
from playbill.streaming.incremental import apply_batch, start_incremental


def gig(i, title="t", at=datetime(2026, 1, 1), manual=False):
    return (i, title, at, None, None, None, None, 1, manual)


@pytest.fixture
def db(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_append_and_replace(spark, db):
    venues = spark.createDataFrame([(1, "Hall", None, None, None)], schemas.VENUE)
    assert db.head() == Head() and db.gigs().count() == 0 and db.venues().count() == 0
    db.append(spark.createDataFrame([gig(1), gig(2, at=datetime(2026, 3, 1), manual=True)], schemas.GIG), venues)
    db.append(spark.createDataFrame([gig(3)], schemas.GIG), venues.limit(0))
    assert sorted(r.id for r in db.gigs().collect()) == [1, 2, 3] and db.venues().count() == 1
    db.replace(db.gigs().where("manual"), spark.createDataFrame([gig(4)], schemas.GIG), venues.limit(0))
    assert sorted(r.id for r in db.gigs().collect()) == [2, 4] and db.venues().count() == 1
    assert db.head() == Head(1, 3)


def test_unfinished_run_is_invisible_and_replaced(spark, db):
    none = spark.createDataFrame([], schemas.VENUE)
    db.append(spark.createDataFrame([gig(1)], schemas.GIG), none)
    db.write_gigs(spark.createDataFrame([gig(8), gig(9)], schemas.GIG), 0, 2)   # lost before it finished
    assert [r.id for r in db.gigs().collect()] == [1]
    db.append(spark.createDataFrame([gig(2)], schemas.GIG), none)
    assert sorted(r.id for r in db.gigs().collect()) == [1, 2]


def test_months_are_pruned(spark, db):
    rows = [gig(1), gig(2, at=datetime(2026, 3, 1))]
    db.append(spark.createDataFrame(rows, schemas.GIG), spark.createDataFrame([], schemas.VENUE))
    later = upcoming(db.gigs(), "2026-02-10")
    assert [r.id for r in later.collect()] == [2]
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]


HOST = "https://live.gr"


def site(spark):
    def detail(n, body):
        return (f"{HOST}/event/{n}", f"<article><h1>{body}</h1></article>")

    pages = [
        (f"{HOST}/agenda", "".join(f'<a href="/event/{n}">x</a>' for n in range(6)) + '<a href="/about">a</a>'),
        detail(0, "Alpha @ Hall 2026-05-01T21:00 €10 rock"), detail(1, "ALPHA @ Hall 2026-05-01T22:00 €12 rock"),
        detail(2, "Beta at Six Dogs 2026-05-02 Free entry, folk"), detail(3, "Gamma @ Hall 2026-05-03 techno"),
        detail(4, "Delta @ Hall soon rock"), (f"{HOST}/event/5", None), (f"{HOST}/lonely", "<p>Solo @ Bar 2026-06-01 jazz</p>"),
    ]
    hits = [(0, 0, f"{HOST}/agenda", "Rock agenda", None), (0, 1, f"{HOST}/lonely", "Jazz", None), (1, 0, f"{HOST}/agenda", "Again", None)]
    return spark.createDataFrame(hits, schemas.SEARCH_HIT), spark.createDataFrame(pages, "url string, html string")


def test_full_sync_twice_then_clear(spark, db):
    hits, pages = site(spark)
    options = SyncOptions(as_of="2026-01-01")
    _, first = sync_store(db, hits, pages, options)
    assert first.stats.first().asDict() == {
        "search_results": 2, "filtered_urls": 4, "scraped_urls": 6, "gigs_extracted": 4, "gigs_created": 3,
        "gigs_skipped": 1, "errors": 0}
    titles = sorted(r.title.lower() for r in db.gigs().collect())
    assert titles == ["alpha", "beta", "solo"] and sorted(r.name for r in db.venues().collect()) == ["Bar", "Hall", "Six Dogs"]

    _, second = sync_store(db, hits, pages, options)
    assert second.stats.first().gigs_created == 0 and db.gigs().count() == 3

    db.append(spark.createDataFrame([gig(99, "Kept", manual=True)], schemas.GIG), spark.createDataFrame([], schemas.VENUE))
    sync_store(db, hits, pages, options, clear=True)
    assert sorted(r.title.lower() for r in db.gigs().collect()) == ["alpha", "beta", "kept", "solo"]


def test_sync_with_a_model(spark, db):
    hits, pages = site(spark)

    def model(prompt):
        if "Gamma" in prompt:
            raise RuntimeError("timeout")
        return '{"gigs":[{"title":"From model","date":"2026-05-01T21:00:00","venue_name":"","price":"29,50"}]}'

    _, result = sync_store(db, hits, pages, SyncOptions(as_of="2026-01-01", batch_size=1), model)
    assert result.scored.where("error is not null").count() == 1
    stats = result.stats.first()
    assert (stats.gigs_extracted, stats.gigs_created, stats.gigs_skipped) == (5, 1, 4)
    row = db.gigs().first()
    assert (row.title, row.price, row.url) == ("From model", "€29", "")
    assert db.venues().first().name == "Unknown Venue"


def test_caps(spark, db):
    hits, pages = site(spark)
    _, result = sync_store(db, hits, pages, SyncOptions(as_of="2026-01-01", max_sources=1, max_details=2, extra_urls=()))
    assert result.stats.first().filtered_urls == 1 and result.details.count() <= 2


def test_scraped_rows(spark):
    pages = scrape_rows(site(spark)[1])
    assert tuple(scrape_counts(pages).first()) == (7, 1, 8)
    failed = pages.where("not success").first()
    assert (failed.text, failed.raw_html, failed.error, failed.links) == (None, None, "no content", None)
    assert successful(pages).count() == 7 and with_text(pages).count() == 7


def test_incremental_runs(spark, tmp_path):
    source, root, check = (str(tmp_path / n) for n in ("in", "store", "check"))

    def day(batch, *titles):
        gigs = ",".join(f'{{"title":"{t}","date":"2026-05-01","venue_name":"{t[0]}"}}' for t in titles)
        rows = [(batch, '{"gigs":[' + gigs + "]}"), (batch + 1, "broken")]
        spark.createDataFrame(rows, "batch long, response string").coalesce(1).write.mode("append").json(source)
        start_incremental(spark, source, root, check, files_per_batch=1).awaitTermination()

    day(0, "Alpha", "Beta", "ALPHA")
    day(10, "beta", "Gamma")
    day(20)
    db = Store(spark, root)
    assert sorted((r.id, r.title) for r in db.gigs().collect()) == [(1, "Alpha"), (2, "Beta"), (3, "Gamma")]
    assert sorted((r.id, r.name) for r in db.venues().collect()) == [(1, "A"), (2, "B"), (3, "G")]
    head = db.head()
    apply_batch(db, spark.createDataFrame([(0, '{"gigs":[{"title":"New","date":"2026-05-01"}]}')],
                                          "batch long, response string"), "responses", 0)
    assert db.head() == head and db.gigs().count() == 3


def test_batch_numbers_need_not_be_unique(spark, tmp_path):
    source, root, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    texts = [(0, "Alpha"), (0, "ALPHA"), (None, "Beta"), (None, "beta"), (1 << 40, "Gamma"), (-5, "Delta"), (0, "Alpha")]
    for k, (batch, title) in enumerate(texts):
        spark.createDataFrame([(batch, '{"gigs":[{"title":"%s","date":"2026-05-01","venue_name":"V"}]}' % title)],
                              "batch long, response string").coalesce(1).write.json(f"{source}-{k}")
    frame = spark.read.schema("batch long, response string").json([f"{source}-{k}" for k in range(len(texts))])
    frame.coalesce(1).write.json(source)
    start_incremental(spark, source, root, check).awaitTermination()
    start_incremental(spark, source, root, check).awaitTermination()
    db = Store(spark, root)
    assert sorted(r.title.lower() for r in db.gigs().collect()) == ["alpha", "beta", "delta", "gamma"]
    assert len({r.id for r in db.gigs().collect()}) == 4 and db.venues().count() == 1


def test_pages_count_once(spark, db):
    hits, pages = site(spark)
    old = pages.select("url", F.lit("<p>short</p>").alias("html"))
    _, result = sync_store(db, hits, pages.unionByName(pages).unionByName(old.where("html is null")), SyncOptions(as_of="2026-01-01"))
    stats = result.stats.first()
    assert (stats.scraped_urls, stats.gigs_extracted, stats.gigs_created) == (6, 4, 3)


def test_only_months_of_the_records_are_read(spark, db):
    rows = [gig(k, f"T{k}") for k in range(3)]
    db.append(spark.createDataFrame(rows, schemas.GIG), spark.createDataFrame([], schemas.VENUE))
    found = spark.createDataFrame([(0, "New", datetime(2030, 1, 1), "V", None, None, "")],
                                  "i long, title string, date timestamp_ntz, venue_name string, description string, price string, url string")
    plan = gig_outcomes(found, db.gigs())._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_incremental_equals_one_batch(spark, tmp_path):
    rows = [(b, '{"gigs":[%s]}' % ",".join(
        f'{{"title":"T{(b * 7 + k) % 9}","date":"2026-05-0{(b + k) % 4 + 1}","venue_name":"V{k}"}}' for k in range(3))) for b in range(12)]
    whole, parts = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    frame = spark.createDataFrame(rows, "batch long, response string")
    apply_batch(whole, frame, "s", 0)
    for n in range(3):
        apply_batch(parts, frame.where(F.floor(F.col("batch") / 4) == n), "s", n)
    pick = [r.asDict() for r in whole.gigs().drop("month").orderBy("id").collect()]
    assert pick == [r.asDict() for r in parts.gigs().drop("month").orderBy("id").collect()]


def test_jdbc_options():
    assert jdbc_options({}) == {"driver": "org.sqlite.JDBC", "url": "jdbc:sqlite:.tmp/data.db"}
    pg = jdbc_options({"DATABASE_CLIENT": "postgres", "DATABASE_URL": "postgres://u:p@db:5433/x", "DATABASE_SSL": "true"})
    assert pg["url"] == "jdbc:postgresql://db:5433/x" and (pg["user"], pg["password"]) == ("u", "p")
    assert pg["currentSchema"] == "public" and pg["sslmode"] == "verify-ca"
    my = jdbc_options({"DATABASE_CLIENT": "mysql", "DATABASE_HOST": "h", "DATABASE_SSL": "true",
                       "DATABASE_SSL_REJECT_UNAUTHORIZED": "false"})
    assert my["url"].startswith("jdbc:mysql://h:3306/") and my["sslMode"] == "REQUIRED"
    with pytest.raises(ValueError):
        jdbc_options({"DATABASE_CLIENT": "oracle"})


def test_command_line(spark, tmp_path):
    from playbill import job

    hits, pages = site(spark)
    pages.write.parquet(str(tmp_path / "pages"))
    (tmp_path / "hits.json").write_text("".join(
        '{"query_idx":%d,"web":{"results":[{"url":"%s","title":"%s"}]}}\n' % (h.query_idx, h.url, h.title) for h in hits.collect()))
    common = ["--store", str(tmp_path / "store"), "--as-of", "2026-01-01"]
    job.main(["sync", "--hits", str(tmp_path / "hits.json"), "--pages", str(tmp_path / "pages"), "--max-details", "all", *common])
    job.main(["listing", "--out", str(tmp_path / "listing"), *common])
    rows = spark.read.parquet(str(tmp_path / "listing")).orderBy("date").collect()
    assert [(r.title.lower(), r.month_label) for r in rows] == [("alpha", "May"), ("beta", "May"), ("solo", "June")]
    job.main(["clear", *common[:2]])
    assert Store(spark, str(tmp_path / "store")).gigs().count() == 0 and Store(spark, str(tmp_path / "store")).venues().count() == 3
    job.main(["frontier", "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "frontier"), "--max-details", "3"])
    assert spark.read.parquet(str(tmp_path / "frontier")).count() == 3


def venue(i, name):
    return (i, name, None, None, None)


def test_two_writers_keep_both_runs(spark, db):
    """Both runs are made against the same head; the second is fitted to the first."""
    db.append(spark.createDataFrame([gig(1, "old")], schemas.GIG), spark.createDataFrame([venue(1, "Hall")], schemas.VENUE))
    base = db.head()
    first = [gig(2, "Alpha"), gig(3, "Beta")], [venue(2, "Depot")]
    second = [(2, "BETA", datetime(2026, 1, 1, 5), None, None, None, None, 2, False), gig(3, "Gamma"),
              (4, "Delta", datetime(2026, 1, 2), None, None, None, None, 3, False)], [venue(2, "DEPOT"), venue(3, "Mill")]
    for gigs, venues in (first, second):
        Store(spark, db.root).append(spark.createDataFrame(gigs, schemas.GIG), spark.createDataFrame(venues, schemas.VENUE), base=base)
    assert db.head() == Head(0, 3)
    rows = {r.title: r for r in db.gigs().collect()}
    assert sorted(rows) == ["Alpha", "Beta", "Delta", "Gamma", "old"]
    assert sorted(r.id for r in rows.values()) == [1, 2, 3, 5, 6]
    names = {r.id: r.name for r in db.venues().collect()}
    assert sorted(names.values()) == ["Depot", "Hall", "Mill"] and names[rows["Delta"].venue_id] == "Mill"
    assert names[rows["Gamma"].venue_id] == "Hall"


def test_runs_at_the_same_time(spark, db):
    base = db.head()

    def work(k):
        gigs = [gig(i + 1, f"{k}-{i}") for i in range(3)] + [gig(4, "everyone's")]
        return db.append(spark.createDataFrame(gigs, schemas.GIG), spark.createDataFrame([venue(1, "Hall")], schemas.VENUE), base=base)

    with ThreadPoolExecutor(4) as pool:
        heads = list(pool.map(work, range(4)))
    assert sorted(h.run for h in heads) == [1, 2, 3, 4]
    rows = db.gigs().collect()
    assert len(rows) == 13 and len({r.id for r in rows}) == 13 and len({r.title for r in rows}) == 13
    assert [(r.id, r.name) for r in db.venues().collect()] == [(1, "Hall")] and {r.venue_id for r in rows} == {1}


def test_a_clear_keeps_what_came_meanwhile(spark, db):
    none = spark.createDataFrame([], schemas.VENUE)
    db.append(spark.createDataFrame([gig(1, "a"), gig(2, "kept", manual=True)], schemas.GIG), none)
    base = db.head()
    db.append(spark.createDataFrame([gig(3, "late")], schemas.GIG), none)
    kept = db.gigs(base).where("manual")
    db.replace(kept, spark.createDataFrame([gig(3, "new")], schemas.GIG), none, base=base)
    assert sorted((r.title, r.id) for r in db.gigs().collect()) == [("kept", 2), ("late", 3), ("new", 4)]
    with pytest.raises(Conflict):
        db.replace(kept, spark.createDataFrame([], schemas.GIG), none, base=base)


def test_a_claimed_run_is_not_claimed_again(spark, db):
    assert db.claim(Head(0, 1), "x") and not db.claim(Head(0, 1), "y")
    assert [r.token for r in db.heads().collect()] == ["x"]


def test_a_batch_is_stored_once(spark, db):
    rows = spark.createDataFrame([gig(1)], schemas.GIG), spark.createDataFrame([], schemas.VENUE)
    assert db.append(*rows, "s", 7) == db.append(*rows, "s", 7) == Head(0, 1)
    assert db.gigs().count() == 1


def test_no_page_text_is_shuffled(spark, db):
    """Rules read a page in its own row: neither markup nor text is in any exchange of the run."""
    hits, pages = site(spark)
    plans = []

    def watch(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    options = SyncOptions(as_of="2026-01-01")
    result = run_sync(hits, pages, db.gigs(), db.venues(), options, stage=watch)
    assert result.stats.first().gigs_created == 3
    for plan in plans:
        for line in plan.split("\n"):
            if "Exchange" in line:
                assert not any(word in line for word in ("html", "content", "raw_html"))
    assert sum("max_by" in plan for plan in plans) == 1
    assert set(page_facts(pages, options, texts=False).columns) == {"url", "targets", "events", "full"}
    assert tuple(result.batches.first()) == (3, 0)


def test_scraped_rows_are_run_input(spark, db, tmp_path):
    hits, pages = site(spark)
    scrape_rows(pages).select(*[f.name for f in schemas.SCRAPED_PAGE.fields]).write.parquet(str(tmp_path / "scraped"))
    options = SyncOptions(as_of="2026-01-01")
    _, result = sync_store(db, hits, read_pages(spark, str(tmp_path / "scraped")), options)
    assert result.stats.first().gigs_created == 3 and sorted(r.title.lower() for r in db.gigs().collect()) == ["alpha", "beta", "solo"]


def test_rules_and_their_responses_agree(spark, db):
    """Records taken from the rules' structs are those that their response texts would give."""
    hits, pages = site(spark)
    result = run_sync(hits, pages, db.gigs(), db.venues(), SyncOptions(as_of="2026-01-01"))
    parsed = apply_rules(candidates(result.scored), "2026-01-01")
    columns = ["batch", "title", "date", "venue_name", "description", "price", "url"]
    assert sorted(map(str, parsed.select(*columns).collect())) == sorted(map(str, result.candidates.select(*columns).collect()))
