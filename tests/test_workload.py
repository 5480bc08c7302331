from pyspark.sql import functions as F


def test_links_of_long_agendas_are_found_once(spark, tmp_path):
    from workload.queries import QUERIES

    spark.range(130).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    frame = QUERIES["long_agendas"](spark, str(tmp_path))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert {r.o_orderkey: r.links for r in frame.collect()} == {k: k % 60 for k in range(130) if k % 60}
