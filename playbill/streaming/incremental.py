"""Scheduled runs over newly arrived response files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from playbill.functions.dates import DEFAULT_ZONE
from playbill.operators.extraction import candidates, extraction_index
from playbill.operators.keyed import number_sorted
from playbill.operators.reconcile import reconcile
from playbill.session import materialize
from playbill.sources.store import Store

RESPONSE_FILE = "batch bigint, response string"


def apply_batch(store: Store, responses: DataFrame, source: str, batch_id: int,
                tz: str = DEFAULT_ZONE, day_first: bool = False) -> None:
    """Match one micro-batch of responses against the store and add what is new.

    A batch that is already recorded is left alone; what one that was cut short has written is
    never read, and it is done again.
    """
    if store.done(source, batch_id):
        return
    head = store.head()
    # Files of different runs may repeat or lack batch numbers, so rows get numbers of their own, in
    # order of batch, then of file and a digest of the text. The texts stay where they are.
    file = F.col("file") if "file" in responses.columns else F.lit(None).cast("string")
    rows = materialize(responses.select(F.coalesce("batch", F.lit(-1)).alias("no"), file.alias("file"), "response",
                                        F.monotonically_increasing_id().alias("batch")), "responses")
    order = ["no", "file", "digest", "batch"]
    numbers = number_sorted(rows.select("no", "file", F.xxhash64("response").alias("digest"), "batch"), order, "_no", materialize)
    # One row per response on either side, so no key is hot but by the records of one response.
    records = candidates(rows.select("batch", "response"), tz, day_first).drop("i").join(numbers.select("batch", "_no"), "batch")
    numbered = records.withColumn("batch", F.col("_no") - 1).drop("_no")
    found = materialize(numbered.withColumn("i", extraction_index(F.col("batch"), F.col("pos"))), "candidates")
    result = reconcile(found, store.gigs(head), store.venues(head), materialize)
    store.append(result.gigs, result.venues, source, batch_id, base=head)


def start_incremental(
    spark: SparkSession,
    in_dir: str,
    store_root: str,
    checkpoint: str,
    source: str = "responses",
    tz: str = DEFAULT_ZONE,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Read the response files that arrived since the last run, then stop."""
    reader = spark.readStream.schema(RESPONSE_FILE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    store = Store(spark, store_root)
    return (reader.json(in_dir).select("batch", "response", F.col("_metadata.file_path").alias("file")).writeStream
            .foreachBatch(lambda df, batch_id: apply_batch(store, df, source, batch_id, tz))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())
