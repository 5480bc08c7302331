import random

import pytest
from pyspark.sql import functions as F

from playbill.operators import keyed
from playbill.session import materialize


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; one key holds a third, some keys are null."""
    rng = random.Random(1)
    rows = [(i, 7 if i % 3 == 0 else (None if i % 11 == 0 else rng.randrange(400))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, k long")


@pytest.mark.parametrize("limit, slices", [(keyed.BROADCAST_BYTES, 16), (0, 16), (0, 1024), (0, 1)])
def test_lookup_join_keeps_every_row(spark, skewed, limit, slices):
    rows, frame = skewed
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 300)], "k long, v string")
    got = keyed.lookup_join(frame, table, ["k"], F.col("id"), slices=slices, broadcast_bytes=limit)
    want = sorted((i, k, f"v{k}" if k is not None and k < 300 else None) for i, k in rows)
    assert sorted((r.id, r.k, r.v) for r in got.collect()) == want


def test_lookup_join_spreads_the_hot_key(spark, skewed):
    _, frame = skewed
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.createDataFrame([(k, f"v{k}") for k in range(300)], "k long, v string")
        got = keyed.lookup_join(frame, table, ["k"], F.col("id"), slices=64, broadcast_bytes=0)
        parts = got.where("k = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 600
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_join_with_counts(spark, skewed):
    rows, frame = skewed
    table = spark.createDataFrame([(7, "x")], "k long, v string")
    counts = frame.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = keyed.lookup_join(frame, table, ["k"], F.col("id"), counts, slices=8, broadcast_bytes=0)
    assert got.where("v = 'x'").count() == sum(k == 7 for _, k in rows)
    assert got.count() == len(rows)


@pytest.mark.parametrize("width", [1, 7, 1000, 10**6])
def test_number_rows(spark, width):
    ids = random.Random(2).sample(range(5000), 700)
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    got = keyed.number_rows(frame, ["id"], keyed.id_range(F.col("id"), width)).collect()
    assert {r.id: r.row_no for r in got} == {v: n for n, v in enumerate(sorted(ids), 1)}


def test_number_rows_by_hash(spark):
    frame = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("h"))
    got = keyed.number_rows(frame, ["h"], keyed.hash_range(F.col("h"), 2)).orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(1, 501))
    assert [r.h for r in got] == sorted(r.h for r in got)


def test_top_per_limits_before_the_shuffle(spark, skewed):
    _, frame = skewed
    top = keyed.top_per(frame, ["k"], ["id"], 2)
    assert top.where("k = 7").count() == 2
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("offset, limit", [(0, 5), (690, 25), (333, 10), (700, 5)])
def test_page_by_range(spark, offset, limit):
    keys = random.Random(3).sample(range(9000), 700)
    frame = spark.createDataFrame([(k % 3, k) for k in keys], "d int, id long")
    got = keyed.page_by_range(frame, ["d", "id"], offset, limit, materialize)
    rows = got.collect()
    assert [r._row for r in sorted(rows)] == [r._first for r in sorted(rows)] == list(range(offset + 1, offset + 1 + len(rows)))
    assert sorted((r.d, r.id) for r in rows) == sorted((k % 3, k) for k in keys)[offset:offset + limit]


@pytest.mark.parametrize("rows", [
    [(0, f"t{k}") for k in range(700)],                                  # one batch number holds all rows
    [(random.Random(k).getrandbits(63) - (1 << 62), f"t{k}") for k in range(700)],  # sparse hashes
    [(None, "same")] * 50 + [(1 << 40, "x")] * 50, []])
def test_number_sorted(spark, rows):
    frame = spark.createDataFrame(rows, "b long, t string").withColumn("u", F.monotonically_increasing_id())
    got = keyed.number_sorted(frame, ["b", "t", "u"], "no", materialize).collect()
    assert sorted(r.no for r in got) == list(range(1, len(rows) + 1))
    key = lambda b, t: (b is not None, b or 0, t)
    assert [key(r.b, r.t) for r in sorted(got, key=lambda r: r.no)] == sorted(key(*r) for r in rows)


def test_number_sorted_deals_ranges_evenly(spark):
    """One batch number, 100,000 rows: no range holds more than twice the mean, and no window sorts rows."""
    seen = {}

    def stage(df, name):
        seen[name] = materialize(df, name)
        return seen[name]

    frame = spark.range(100_000).select(F.lit(0).alias("b"), F.xxhash64("id").alias("h"), "id")
    got = keyed.number_sorted(frame.repartition(8), ["b", "h", "id"], "no", stage)
    sizes = [r["count"] for r in seen["ranges"].groupBy(F.shiftright("_m", 33)).count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert got.agg(F.min("no"), F.max("no"), F.count_distinct("no")).first() == (1, 100_000, 100_000)
    windows = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert len(windows) == 1 and "_c" in windows[0]


def test_tables_are_measured(spark, tmp_path):
    """A literal table is small; a file that packs well is not, whatever the optimizer thinks of them."""
    assert keyed.small(spark.createDataFrame([("a.gr", 1), ("b.gr", 2)], "host string, tier int"))
    spark.range(300_000).select((F.col("id") % 2).alias("k"), F.repeat(F.lit("x"), 100).alias("v")).write.parquet(str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    assert not keyed.small(packed) and keyed.measured(packed) == (300_000, 300_000 * 116)
    assert not keyed.small(packed.limit(1), 0) and keyed.small(packed.limit(1))
