"""Reading the given tables, and folders for results that several steps share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Spark's default and ours: rows and bytes that a Python task gets at a time.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
          "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "2000000b")}


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long: unless the session names limits of its own, Python tasks get 1,000
    rows or some 2 MB at a time instead of Spark's 10,000 or 64 MB, which bounds both sides' buffers."""
    for name, (default, ours) in _BATCH.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


# What `stored` has written and nobody has dropped yet, oldest first.
made: list[DataFrame] = []


def drop(frames: list[DataFrame]) -> None:
    """Removes the folders of stored frames that no frame still to be computed reads."""
    for frame in frames:
        files = frame.inputFiles()
        if files:
            spark = frame.sparkSession.sparkContext
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        made[:] = [m for m in made if m is not frame]


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back, so that its lineage is cut.

    The shuffle files behind it have no further use, so Spark removes them as soon as the
    rows are written; without that they would pile up until the driver collects garbage.
    """
    spark = df.sparkSession
    small_batches(spark)
    before = spark.conf.get(_CLEAN_UP, None)
    try:
        if before is not None:
            spark.conf.set(_CLEAN_UP, "true")
        out = materialize(df, label)
        made.append(out)
        return out
    finally:
        if before is not None:
            spark.conf.set(_CLEAN_UP, before)


# Bits of the bitmaps that `among` sends to the tasks: 8 MB at most, whatever the number of keys.
BITS = 1 << 26


def among(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of `df` whose column `name` may be in that column of `keys` (of the same type): all that are, and,
    while keys are few beside `BITS`, few others. A join that follows need not move the rest."""
    place = (F.pmod(F.xxhash64(name), F.lit(BITS)) + 1).alias("_place")
    bits = (keys.select(place).groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")))
    placed = df.select("*", place).withColumns({"_bucket": F.bitmap_bucket_number("_place"), "_bit": F.bitmap_bit_position("_place")})
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (placed.join(F.broadcast(bits), "_bucket").withColumn("_byte", byte)
            .where(F.expr("mod(shiftright(_byte, cast(mod(_bit, 8) as int)), 2) = 1")).select(*df.columns))
