"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants. Parallelism and memory belong to the cluster.
# Page and record stages are bound by CPU, not bytes, so small partitions pay.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "playbill", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's SQL settings; `settings` win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Where it is unset, a local master gets a private temporary folder; a cluster
    must name one, because executors cannot see another machine's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="playbill-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the working root; nothing is created yet."""
    return f"{work_root(spark)}/playbill/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the working folder and read it back.

    Cuts the lineage so several consumers share one evaluation, and survives
    executor loss because the rows are on shared storage.
    """
    spark = df.sparkSession
    path = new_work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
