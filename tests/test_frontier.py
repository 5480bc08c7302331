import pytest
from pyspark.sql import functions as F

from playbill import schemas
from playbill.operators import frontier
from playbill.plans.sync import SyncOptions, choose_sources
from playbill.session import materialize
from playbill.sources import responses, seed


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(q, r, f"https://h{r % 3}.gr/{r}", f"q{q} r{r}", None) for q in range(2) for r in range(30)]
    return spark.createDataFrame(rows, schemas.SEARCH_HIT)


def test_cap_and_first(hits):
    assert frontier.cap_hits(hits).count() == frontier.cap_hits(hits, 50).count() == 60
    capped = frontier.cap_hits(hits, 20)
    assert capped.count() == 40 and capped.agg(F.max("rank")).first()[0] == 19
    unique = frontier.unique_hits(capped)
    assert unique.count() == 20 and {r.query_idx for r in unique.collect()} == {0}


def test_rank_sources_takes_turns(spark):
    rows = [(0, 0, "https://blog.gr/1", "rock", None), (0, 1, "https://blog.gr/2", "rock", None),
            (0, 2, "https://www.songkick.com/x", "rock", None), (0, 3, "https://www.viva.gr/a", "rock", None),
            (0, 4, "https://www.viva.gr/b", "rock", None), (0, 5, "https://facebook.com/p", "rock", None),
            (0, 6, "https://ok.gr", "Past events", None), (0, 7, "https://ok.gr/2", "techno", None),
            (0, 8, "https://ok.gr/3", "in Patras", None)]
    hits = spark.createDataFrame(rows, schemas.SEARCH_HIT)
    got = [r.url for r in frontier.rank_sources(hits, n=4).collect()]
    assert got == ["https://www.viva.gr/a", "https://blog.gr/1", "https://www.viva.gr/b", "https://blog.gr/2"]
    assert frontier.rank_sources(hits, n=None).count() == 5
    table = spark.createDataFrame([("blog.gr", 1), ("blog.gr", 3), ("viva.gr", 2)], "host string, tier int")
    assert [r.url for r in frontier.rank_sources(hits, table, n=1).collect()] == ["https://blog.gr/1"]
    # A site's name serves its hosts in either form, and the host's own row goes first.
    for form in (table, {"blog.gr": 1, "viva.gr": 2}):
        assert {r.url: r.tier for r in frontier.rank_sources(hits, form).collect()}["https://www.viva.gr/a"] == 2
    own = spark.createDataFrame([("www.viva.gr", 5), ("viva.gr", 2)], "host string, tier int")
    assert {r.url: r.tier for r in frontier.rank_sources(hits, own).collect()}["https://www.viva.gr/a"] == 5


def test_add_if_absent(spark):
    urls = spark.createDataFrame([("a",), ("b",)], "url string")
    assert sorted(r.url for r in frontier.add_if_absent(urls, ["b", "c", "c"]).collect()) == ["a", "b", "c"]


def test_no_hits_means_no_sources(spark, hits):
    none = choose_sources(hits.limit(0), SyncOptions(as_of="2026-01-01"))[1]
    assert none.count() == 0
    some = choose_sources(hits, SyncOptions(as_of="2026-01-01"))[1]
    assert some.count() == 30 + 2
    few = choose_sources(hits, SyncOptions(as_of="2026-01-01", max_sources=10))[1]
    assert few.count() == 10 + 2


def test_route_pages(spark):
    pages = spark.createDataFrame([
        ("p1", ["https://x.gr/event/1", "https://x.gr/about", "https://x.gr/event/2"]), ("p2", []), ("p3", None),
        ("p4", ["https://x.gr/about"])], "url string, links array<string>")
    got = sorted(r.url for r in frontier.route_pages(pages).collect())
    assert got == ["https://x.gr/event/1", "https://x.gr/event/2", "p2", "p3"]
    assert frontier.route_pages(pages, n=1).count() == 3


def test_sample_does_not_depend_on_partitions(spark):
    urls = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("url"))
    one = [r.url for r in frontier.sample_urls(urls.repartition(3), 10, "s").collect()]
    assert one == [r.url for r in frontier.sample_urls(urls.repartition(7), 10, "s").collect()]
    assert one != [r.url for r in frontier.sample_urls(urls, 10, "t").collect()]
    assert frontier.sample_urls(urls, None).count() == 1000


def test_search_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"query_idx":0,"web":{"results":[{"url":"u1","title":"t1","extra":1},{"url":"u2","title":"t2","description":"d"}]}}\n'
        '{"query_idx":1,"web":{}}\n{"query_idx":2}\n')
    got = responses.read_search_hits(spark, str(tmp_path)).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 0, "u1", "t1", None), (0, 1, "u2", "t2", "d")]


def test_fixed_inputs(spark):
    queries = seed.search_queries(spark).collect()
    assert [q.query_idx for q in queries] == [0, 1, 2] and queries[0].search_lang == "el"
    assert seed.extra_urls(spark).count() == 2


def many_hits(spark):
    rows = [(q, r, f"https://{h}.{s}.gr/{r}", "rock", None)
            for q in range(3) for r, (h, s) in enumerate([("www", "hot")] * 20 + [(f"h{k}", "pages") for k in range(20)] + [("a", f"s{k}") for k in range(20)])]
    tiers = [("hot.gr", 2), ("www.hot.gr", 3), ("pages.gr", 1), ("h3.pages.gr", 5), ("h3.pages.gr", 4), ("s7.gr", 1)]
    return spark.createDataFrame(rows, schemas.SEARCH_HIT), spark.createDataFrame(tiers, "host string, tier int")


def test_long_tier_tables_give_the_same(spark, monkeypatch):
    hits, tiers = many_hits(spark)
    want = sorted(map(tuple, frontier.rank_sources(hits, {h: t for h, t in tiers.groupBy("host").agg(F.min("tier")).collect()}).select("url", "query_idx", "tier").collect()))
    assert sorted(map(tuple, frontier.rank_sources(hits, tiers).select("url", "query_idx", "tier").collect())) == want
    monkeypatch.setattr(frontier, "small", lambda table: False)
    long = frontier.rank_sources(hits, tiers, stage=materialize)
    assert sorted(map(tuple, long.select("url", "query_idx", "tier").collect())) == want


def test_short_tier_tables_are_read_once_or_twice(spark, tmp_path):
    hits, tiers = many_hits(spark)
    for name, frame in (("hits", hits), ("tiers", tiers)):
        frame.write.parquet(str(tmp_path / name))
    ranked = frontier.rank_sources(spark.read.parquet(str(tmp_path / "hits")), spark.read.parquet(str(tmp_path / "tiers")))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and "SortMergeJoin" not in plan


def test_long_samples_are_the_same_rows(spark, monkeypatch):
    urls = spark.range(3000).select(F.concat(F.lit("https://e.gr/"), F.col("id") % 2500).alias("url")).repartition(5)
    every = sorted((r.sample_key, r.url) for r in frontier.sample_urls(urls).collect())
    for direct, digits in ((1000, 4), (3, 1), (0, 1)):
        monkeypatch.setattr(frontier, "DIRECT", direct)
        monkeypatch.setattr(frontier, "DIGITS", digits)
        for n in (1, 1500, 2999, 3000, 4000):
            got = sorted((r.sample_key, r.url) for r in frontier.sample_urls(urls, n).collect())
            assert got == every[:n]


def test_many_sources_take_the_same_turns(spark, monkeypatch):
    rows = [(q, r, f"https://{'big.gr' if (q + r) % 3 else f'h{r % 17}.gr'}/{q}/{r}", "t", "") for q in range(9) for r in range(60)]
    hits = spark.createDataFrame(rows, "query_idx int, rank int, url string, title string, description string").repartition(4)
    tiers = {"big.gr": 2, "h3.gr": 5, "h5.gr": 1}
    want = {n: [tuple(r) for r in frontier.rank_sources(hits, tiers, n).select("url", "tier", "round").collect()] for n in (5, 200, 900)}
    monkeypatch.setattr(frontier, "DIRECT", 0)
    for n, rows in want.items():
        assert [tuple(r) for r in frontier.rank_sources(hits, tiers, n).select("url", "tier", "round").collect()] == rows
