"""Keyed building blocks that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when its measured rows and bytes are not above these.
BROADCAST_BYTES = 10 * 1024 * 1024
BROADCAST_ROWS = 200_000
# A key is hot when it holds more than 1/SLICES of all rows.
SLICES = 1024
# Unique integer keys are grouped into ranges of this width.
RANGE_WIDTH = 1 << 17
# Ranges whose counts are summed up together, one task per group.
RANGES_PER_GROUP = 1 << 12


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int,
            number: str | None = None) -> DataFrame:
    """The first `n` rows of every key, with their position when `number` names it.

    Spark keeps `n` rows per key on the map side before it shuffles, so a hot key
    sends at most `n` rows from each task.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    top = df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n)
    return top.withColumnRenamed("_n", number) if number else top.drop("_n")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_per(df, keys, order, 1)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a table, counted in one distributed pass; one row reaches the driver. The optimizer's
    estimates are no measure: they are boundless for local rows and low for well-packed files."""
    def size(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(name), F.lit(0))
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
        return F.lit(8)

    wide = reduce(lambda x, y: x + y, [size(f"`{f.name}`", f.dataType) for f in df.schema.fields], F.lit(8))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(wide.cast("bigint")), F.lit(0)).alias("b")).first()
    return row.n, row.b


def small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast, by its measured size."""
    if most_bytes <= 0:
        return False
    rows, size = measured(df)
    return rows <= BROADCAST_ROWS and size <= most_bytes


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    spread: Column,
    counts: DataFrame | None = None,
    slices: int = SLICES,
    broadcast_bytes: int = BROADCAST_BYTES,
    fits: bool | None = None,
) -> DataFrame:
    """Left join `rows` to `table`, which has at most one row per key.

    A table that is measured not above `broadcast_bytes` is broadcast and `rows` stays where it
    is; `fits` saves measuring one whose size is known. Otherwise both sides shuffle on the key, and every hot key is spread: its rows
    go to `ceil(share * slices)` slices chosen by `spread` (any well-spread column,
    such as the row id) and its table row is copied to each. Fewer than `slices`
    keys can hold more than 1/slices of the rows, so the list of hot keys has a
    fixed bound and can be broadcast. Rows with a null key match nothing and are
    spread the same way.

    `counts` (key columns and `n`) saves counting the rows per key again.
    """
    on = list(on)
    if small(table, broadcast_bytes) if fits is None else fits:
        return rows.join(F.broadcast(table), on, "left")

    if counts is None:
        counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    known = F.lit(True)
    for key in on:
        known = known & F.col(key).isNotNull()
    # One filtered aggregate serves the total and both uses of `hot`, so Spark can
    # reuse its exchange.
    counts = counts.where(known)
    total = counts.agg(F.sum("n").cast("double").alias("n")).scalar()
    hot = (counts.where(F.col("n") * slices > total)
           .select(*on, F.ceil(F.col("n") * slices / total).cast("int").alias("_k")))

    salt = (F.when(~known, F.pmod(F.xxhash64(spread), F.lit(slices)))
            .when(F.col("_k").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_k")))
            .otherwise(0).cast("int"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_s", salt).drop("_k")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_k"), F.lit(1)) - 1))
    spread_table = table.join(F.broadcast(hot), on, "left").withColumn("_s", copies).drop("_k")
    return salted.join(spread_table, [*on, "_s"], "left").drop("_s")


def number_rows(df: DataFrame, order: Sequence[str], bucket: Column, name: str = "row_no") -> DataFrame:
    """Number rows 1, 2, 3 ... over the whole table, without one global sort.

    `bucket` is an integer that cuts the order into ranges: it must not decrease
    along `order`, and a range must be of limited size (`id_range` for unique
    integer keys, `hash_range` for hashes). Ranges are numbered on their own and
    shifted by the rows before them. Those shifts are summed in groups of ranges,
    so a single task only sees one count per RANGES_PER_GROUP ranges.
    """
    def before(count: str, *keys: str) -> Column:
        window = (W.partitionBy(*keys[:-1]) if keys[:-1] else W).orderBy(keys[-1])
        return F.coalesce(F.sum(count).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    ranged = df.withColumn("_b", bucket)
    counts = (ranged.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_g", F.floor(F.col("_b") / RANGES_PER_GROUP)))
    groups = counts.groupBy("_g").agg(F.sum("_c").alias("_gc")).select("_g", before("_gc", "_g").alias("_gs"))
    starts = (counts.select("_g", "_b", before("_c", "_g", "_b").alias("_s")).join(groups, "_g")
              .select("_b", (F.col("_s") + F.col("_gs")).alias("_start")))
    inside = W.partitionBy("_b").orderBy(*order)
    return (ranged.withColumn("_i", F.row_number().over(inside))
            .join(starts, "_b")
            .withColumn(name, F.col("_start") + F.col("_i"))
            .drop("_b", "_i", "_start"))


def number_sorted(keys: DataFrame, order: Sequence[str], name: str, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Number rows 1, 2, 3 ... in an order that is unique, however sparse or skewed its first columns are.

    The rows are written once, in sampled ranges of even size; a row's number is its place in its
    range plus the rows of the ranges before. One task sums up one count per range, and no task
    sorts more than a range.
    """
    ranged = stage(keys.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("_m", F.monotonically_increasing_id()), "ranges")
    placed = ranged.select(*keys.columns, F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_p").select(*keys.columns, (F.col("_start") + F.col("_at") + 1).alias(name))


def id_range(key: Column, width: int = RANGE_WIDTH) -> Column:
    """Range of a unique integer key; holds at most `width` rows."""
    return F.floor(key / F.lit(width)).cast("bigint")


def hash_range(digest: Column, digits: int = 4) -> Column:
    """Range of a hex digest: its leading digits as a number, 16**digits even ranges."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def page_by_range(
    keys: DataFrame,
    order: Sequence[str],
    offset: int,
    limit: int,
    stage: Callable[[DataFrame, str], DataFrame],
    descending: bool = False,
) -> DataFrame:
    """Rows `offset` to `offset + limit` of a long order, however deep: the order columns,
    each row's place `_row`, and `_first`, the place of the first row equal to it.

    `keys` holds just the order columns. They are written once in sampled ranges of even
    size; the ranges' counts show which of them the page touches, and only those are sorted.
    """
    sorting = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    ranged = stage(keys.repartitionByRange(*sorting).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_p", "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    touched = starts.where((F.col("_start") < offset + limit) & (F.col("_start") + F.col("_c") > offset))
    inside = W.partitionBy("_p").orderBy(*sorting)
    return (ranged.join(F.broadcast(touched.drop("_c")), "_p")
            .withColumn("_row", F.col("_start") + F.row_number().over(inside))
            .withColumn("_first", F.col("_start") + F.rank().over(inside))
            .where((F.col("_row") > offset) & (F.col("_row") <= offset + limit))
            .select(*order, "_row", "_first"))
