"""The stored gigs and venues: plain Parquet folders and one small file for each finished run.

    <root>/heads/<run>.json                                    generation, run, token, source and batch
    <root>/gigs/gen=<g>/run=<r>/token=<t>/month=<yyyy-MM>/     gigs written by that run
    <root>/venues/run=<r>/token=<t>/                           venues written by that run

Many writers may work at once. A run writes to folders of its own (the token is unique) and then
claims the next run number by making its head file, which succeeds for one writer only. Who
comes second fits its rows to what has been stored meanwhile and claims the number after it. So a
reader sees all of a run or nothing, no run replaces another, and stored ids and (title, day) keys
stay unique. Clearing starts a new generation.

Making the head file needs a file system that refuses to rename over an existing file (HDFS, ABFS,
local disks). Where it does not, keep to one writer.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill import schemas
from playbill.functions.dates import utc_day
from playbill.functions.text import name_key

_HEADS = "generation bigint, run bigint, token string, source string, batch bigint"
# Claims that a writer loses before it gives up.
ATTEMPTS = 50

Rows = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class Head:
    generation: int = 0
    run: int = 0


class Conflict(RuntimeError):
    """Another run has cleared the store meanwhile: start again from its new head."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _read(self, path: str, schema, base: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema)
        if base:
            reader = reader.option("basePath", base)
        try:
            return reader.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def heads(self) -> DataFrame:
        try:
            return self.spark.read.schema(_HEADS).json(f"{self.root}/heads").where("run IS NOT NULL")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _HEADS)

    def head(self) -> Head:
        """The newest finished run; a one-row aggregate is all the driver reads."""
        row = self.heads().agg(F.max(F.struct("run", "generation")).alias("h")).first()
        return Head(row.h.generation, row.h.run) if row.h else Head()

    def done(self, source: str, batch: int) -> bool:
        """Whether a source's batch already has a finished run."""
        mine = (F.col("source") == source) & (F.col("batch") == batch)
        return not self.heads().where(mine).isEmpty()

    def _finished(self, head: Head, generation: int | None = None, after: int = 0) -> Column:
        """Whether a row belongs to a finished run: one token for each run, so folders of others are
        not even listed for reading."""
        runs = self.heads().where((F.col("run") <= head.run) & (F.col("run") > after))
        if generation is not None:
            runs = runs.where(F.col("generation") == generation)
        tokens = [r.token for r in runs.select("token").collect()]
        return F.col("token").isin(tokens) if tokens else F.lit(False)

    def gigs(self, head: Head | None = None, after: int = 0) -> DataFrame:
        """The gigs as of a head, or only those of runs later than `after`."""
        head = head or self.head()
        schema = T.StructType([*schemas.GIG.fields, T.StructField("run", T.LongType()), T.StructField("token", T.StringType()),
                               T.StructField("month", T.StringType())])
        path = f"{self.root}/gigs/gen={head.generation}"
        return self._read(path, schema, path).where(self._finished(head, head.generation, after)).drop("run", "token")

    def venues(self, head: Head | None = None) -> DataFrame:
        head = head or self.head()
        schema = T.StructType([*schemas.VENUE.fields, T.StructField("run", T.LongType()), T.StructField("token", T.StringType())])
        path = f"{self.root}/venues"
        return self._read(path, schema, path).where(self._finished(head)).drop("run", "token")

    def write_gigs(self, gigs: DataFrame, generation: int, run: int, token: str = "") -> None:
        """Write one run's gigs by month; busy months are split over several files."""
        (gigs.select([f.name for f in schemas.GIG.fields])
         .withColumn("month", F.date_format("date", "yyyy-MM"))
         .hint("rebalance", "month")
         .write.partitionBy("month")
         .parquet(f"{self.root}/gigs/gen={generation}/run={run}/token={token or uuid.uuid4().hex}"))

    def write_venues(self, venues: DataFrame, run: int, token: str = "") -> None:
        (venues.select([f.name for f in schemas.VENUE.fields])
         .write.parquet(f"{self.root}/venues/run={run}/token={token or uuid.uuid4().hex}"))

    def claim(self, head: Head, token: str, source: str = "batch", batch: int | None = None) -> bool:
        """Makes the head file of a run whose rows are written; False if another writer has it. The file
        appears with its content or not at all. Spark has no call for this, hence the file system's own."""
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path
        path = place(f"{self.root}/heads/{head.run:012d}.json")
        draft = place(f"{self.root}/heads/_{token}")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path.getParent())
        text = json.dumps({"generation": head.generation, "run": head.run, "token": token, "source": source, "batch": batch})
        out = files.create(draft, True)
        out.write(bytearray(text.encode() + b"\n"))
        out.close()
        try:
            if files.getScheme() != "file":
                return bool(files.rename(draft, path))
            # Renaming replaces a file on a local disk; a second link to the draft does not.
            os.link(draft.toUri().getPath(), path.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            files.delete(draft, False)

    def commit(self, build: Callable[[Head], Rows | None], clear: bool = False, source: str = "batch", batch: int | None = None) -> Head:
        """Stores what `build(head)` makes, as the run after that head. Where another run was faster,
        `build` is asked again with the newer head; None leaves the store as it is."""
        for _ in range(ATTEMPTS):
            head = self.head()
            rows = build(head)
            if rows is None:
                return head
            token = uuid.uuid4().hex
            new = Head(head.generation + clear, head.run + 1)
            self.write_venues(rows[1], new.run, token)
            self.write_gigs(rows[0], new.generation, new.run, token)
            if self.claim(new, token, source, batch):
                return new
        raise Conflict(f"{ATTEMPTS} other runs were faster")

    def _top(self, rows: DataFrame) -> int:
        return rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first().id

    def rebased(self, gigs: DataFrame, venues: DataFrame, base: Head, head: Head) -> Rows:
        """Rows made against `base`, fitted to a later head: gigs whose (title, day) has been stored since
        go, venues that have been stored since take their stored ids, other ids move behind the
        highest stored ones."""
        def shift(rows: DataFrame, stored: DataFrame) -> Column:
            least = rows.agg(F.min("id").alias("id")).first().id
            return F.lit(max(0, self._top(stored) + 1 - least) if least is not None else 0)

        since = self.gigs(head, base.run) if head.generation == base.generation else self.gigs(head)
        key = (name_key(F.col("title")).alias("_title"), utc_day(F.col("date")).alias("_day"))
        taken = since.select(*key).distinct()
        fresh = gigs.select("*", *key).join(taken, ["_title", "_day"], "left_anti").drop("_title", "_day")

        stored = self.venues(head)
        by_name = stored.groupBy(name_key(F.col("name")).alias("_name")).agg(F.min("id").alias("_stored"))
        moved = (venues.withColumn("_name", name_key(F.col("name"))).join(by_name, "_name", "left")
                 .withColumn("_new", F.coalesce("_stored", F.col("id") + shift(venues, stored))))
        ids = moved.select(F.col("id").alias("venue_id"), "_new")
        placed = (fresh.join(ids, "venue_id", "left").withColumn("venue_id", F.coalesce("_new", "venue_id"))
                  .withColumn("id", F.col("id") + shift(gigs, self.gigs(head))))
        left = moved.where(F.col("_stored").isNull()).withColumn("id", F.col("_new"))
        return placed.select([f.name for f in schemas.GIG.fields]), left.select([f.name for f in schemas.VENUE.fields])

    def append(self, gigs: DataFrame, venues: DataFrame, source: str = "batch", batch: int | None = None,
               base: Head | None = None) -> Head:
        """Add one run's gigs and venues to the current generation. `base` is the head they were made
        against (None: the current one). A batch of a source that is stored already is left out."""
        base = base or self.head()

        def build(head: Head) -> Rows | None:
            if batch is not None and self.done(source, batch):
                return None
            return (gigs, venues) if head == base else self.rebased(gigs, venues, base, head)

        return self.commit(build, source=source, batch=batch)

    def replace(self, kept: DataFrame, gigs: DataFrame, venues: DataFrame, base: Head | None = None) -> Head:
        """Start a new generation from the kept gigs plus one run's new rows. Gigs that other runs
        have added since `base` stay; if one of them has cleared the store, it is a `Conflict`."""
        base = base or self.head()
        names = [f.name for f in schemas.GIG.fields]

        def build(head: Head) -> Rows:
            if head == base:
                return kept.select(names).unionByName(gigs.select(names)), venues
            if head.generation != base.generation:
                raise Conflict("the store was cleared by another run")
            new, named = self.rebased(gigs, venues, base, head)
            return kept.select(names).unionByName(new).unionByName(self.gigs(head, base.run).select(names)), named

        return self.commit(build, clear=True)
