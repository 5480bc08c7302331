"""7. N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and word shingles are columns of an incidence matrix. Two documents
link when their overlap reaches the threshold's share of their union, so each must share
a column among its first `prefix(n)` in any order of the columns that all documents use.

1. Copies (equal sets) become one row, the smallest id of them.
2. The first block holds the columns with the smallest hashes of every row, some more than
   its prefix. Columns are counted; those with one row drop out, those with more than
   `FREQUENT` rows are set apart. Columns with the same rows become one that counts for
   all of them. The product over the rest accumulates overlap counts per pair; a pair whose count cannot reach the size-derived bound with all that is not
   counted is discarded.
3. Rows whose prefix is not covered that way (they hold too many frequent columns) form a
   second matrix. Its columns are ordered by exact frequency, and every column's rows are
   multiplied with one row of it, then, where they are not in its component, with another
   one; the last turn takes all pairs of a column that are still in different components.
4. Surviving pairs get their exact overlap over all columns.

No column, pair or partner is capped. Components come from alternating star steps.

Defined cases: null, empty or blank texts have no shingles and link with nothing; fewer words than
`size` make one shingle; repeated rows are copies; a null id links with nothing. Rows with one
id but different texts count as one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.arrays import HASH_BYTES, mix, slices, utf8
from llm.components import components
from llm.shingles import shingle_sets
from llm.tables import among, documents, drop, stored

SIZE, LEAST = 5, 75
# Turns of step 3; the last one takes all pairs that are left.
TURNS = 2
# A column with more rows than this is set apart for step 3.
FREQUENT = 32


def prefix(n: Column, least: int) -> Column:
    """Columns of a row of n of which a linked row must share one."""
    return (n - F.ceil(n * F.lit(least) / 100) + 1).cast("int")


def shingle_rows(df: DataFrame, doc_id: str, text: str, size: int, least: int | None) -> DataFrame:
    """(doc_id, n, sig, hs): set size, signature and, ascending, the smallest hashes (step 2), or all
    where `least` is None."""
    picked = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", HASH_BYTES):
                hashes, offsets = shingle_sets(*utf8(part.column("_text")), size)
                n = np.diff(offsets)
                sums = np.r_[np.uint64(0), np.cumsum(mix(hashes + np.uint64(0x51ED2701)))]
                sig = sums[offsets[1:]] - sums[offsets[:-1]]
                if least is not None:
                    first = n - (n * least + 99) // 100 + 1
                    most = np.minimum(n, first + first // 4 + 8)
                    keep = np.arange(len(hashes)) - np.repeat(offsets[:-1], n) < np.repeat(most, n)
                    hashes, offsets = hashes[keep], np.r_[0, np.cumsum(most)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int32()), pa.array(sig.view(np.int64)), lists], ["doc_id", "n", "sig", "hs"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n int, sig long, hs array<long>")


def linked(x: Column, y: Column, both: Column, least: int) -> Column:
    return both * 100 >= least * (x + y - both)


def _alike(a: str, b: str, least: int) -> Column:
    """Sizes that a linked pair may have."""
    return (F.col(a) * 100 >= F.col(b) * least) & (F.col(b) * 100 >= F.col(a) * least)


def _can_reach(x: tuple[str, str], y: tuple[str, str], least: int) -> Column:
    """Whether rows of sizes n that share their columns at places i, and none before, can link."""
    (nx, ix), (ny, iy) = x, y
    most = F.least(F.col(nx) - F.col(ix), F.col(ny) - F.col(iy))
    return _alike(nx, ny, least) & linked(F.col(nx), F.col(ny), most, least)


def verify(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of rows of `sets` that link, by the overlap of their whole sets."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("hs").alias("ha"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("hs").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return (pairs.select("a", "b").join(one, "a").join(two, "b")
            .where(linked(F.size("ha"), F.size("hb"), both, least)).select("a", "b"))


def ends(pairs: DataFrame) -> DataFrame:
    """(doc_id): rows of the pairs (a, b)."""
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))


def shared_cells(cells: DataFrame, counts: DataFrame, copies: DataFrame) -> DataFrame:
    """Cells (doc_id, n, h) of the columns in `counts`, without those of `copies` (doc_id, rep). Copies are looked up
    by the cells that are left: an anti-join would be pushed down to all lists of hashes and have them moved."""
    return cells.join(counts, "h").join(copies, "doc_id", "left").where("rep is null").select("doc_id", "h", "n")


def needed_texts(df: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows (doc_id, text) of the ids in `needed`, each id there once; other texts stay where they are."""
    return among(df, needed, "doc_id").join(needed, "doc_id").select("doc_id", "text")


def merged_columns(shared: DataFrame) -> DataFrame:
    """(h, c, m) over cells (doc_id, h): one column h for all m columns with the same c rows. Rows are
    compared by their number, least and greatest id, and three sums of 31-bit hashes. Columns of one row drop out."""
    sums = [F.sum(F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(1 << 31))).alias(f"s{k}") for k in range(3)]
    columns = shared.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), *sums)
    return (columns.where("c > 1").groupBy("c", "low", "high", "s0", "s1", "s2")
            .agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("m")).select("h", "c", "m"))


def light_pairs(shared: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Step 2 over (doc_id, n, h, c, m): candidate pairs (a, b), and the rows it does not cover."""
    first = prefix(F.col("n"), least)
    listed = F.least(F.col("n"), first + (first / 4).cast("int") + 8)  # as many as `shingle_rows` gives
    heavy = (shared.where(F.col("c") > FREQUENT).groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("m").alias("v"))
             .withColumn("open", listed - F.col("v") < first))
    light = (shared.where(F.col("c") <= FREQUENT).join(heavy.select("doc_id", "v"), "doc_id", "left")
             .select("h", "doc_id", "n", "m", F.coalesce("v", F.lit(0)).alias("v")))
    one = light.select("h", "m", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("v").alias("va"))
    two = light.select("h", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("v").alias("vb"))

    def rest(n: str, v: str) -> Column:
        """Columns of a row that the first block did not list or set apart."""
        p = prefix(F.col(n), least)
        return F.col(n) - F.least(F.col(n), p + (p / 4).cast("int") + 8) + F.col(v)

    most = F.col("both") + F.greatest(rest("na", "va"), rest("nb", "vb"))
    pairs = (one.join(two, "h").where((F.col("a") < F.col("b")) & _alike("na", "nb", least))
             .groupBy("a", "b").agg(F.sum("m").alias("both"), *(F.first(x).alias(x) for x in ("na", "nb", "va", "vb")))
             .where(linked(F.col("na"), F.col("nb"), F.least(most, F.col("na"), F.col("nb")), least)).select("a", "b"))
    return pairs, heavy.where("open").select("doc_id")


def rare_columns(sets: DataFrame, least: int) -> DataFrame:
    """Step 3: (h, doc_id, n, i), every row's prefix when its rarest columns come first; i: the place."""
    cells = sets.select("doc_id", "n", F.explode("hs").alias("h"))
    # Stored, so that the join is a plain one, which Spark splits at a hot column.
    counts = stored(cells.groupBy("h").agg(F.count(F.lit(1)).alias("c")), "counts")
    rows = (cells.join(counts, "h").groupBy("doc_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "h"))).alias("cs")))
    return (rows.select("doc_id", "n", F.posexplode(F.slice("cs", F.lit(1), prefix(F.col("n"), least))).alias("i", "x"))
            .where("x.c > 1").select("doc_id", "n", "i", F.col("x.h").alias("h")))


def split_columns(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """(h, doc_id, n, i, g) of the columns whose rows are in several components g."""
    rows = columns.select("h", "doc_id", "n", "i").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "h", "doc_id", "n", "i", F.coalesce("component", "doc_id").alias("g"))
    several = rows.groupBy("h").agg(F.min("g").alias("one"), F.max("g").alias("two")).where("one <> two").select("h")
    return rows.join(several, "h")


def spokes(columns: DataFrame, least: int, order: Column) -> DataFrame:
    """Pairs (a, b) of each column's first row by `order` with its other rows, but for rows of one
    component; as many as there are cells."""
    rows = columns if "g" in columns.columns else columns.withColumn("g", F.col("doc_id"))
    row = F.struct("doc_id", "n", "i", "g")
    hubs = rows.groupBy("h").agg(F.min_by(row, F.struct(order, "doc_id")).alias("hub"))
    return (rows.join(hubs, "h").where((F.col("g") != F.col("hub.g")) & _can_reach(("n", "i"), ("hub.n", "hub.i"), least))
            .select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")).distinct())


def all_pairs(columns: DataFrame, least: int) -> DataFrame:
    """Pairs of rows of a column that are in different components. In the first column that two rows
    share, the places bound their overlap; a pair that fails there is never made."""
    one = columns.select("h", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("g").alias("ga"))
    two = columns.select("h", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("g").alias("gb"))
    pairs = one.join(two, "h").where((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & _can_reach(("na", "ia"), ("nb", "ib"), least))
    return pairs.select("a", "b").distinct()


def similar_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, least: int = LEAST) -> DataFrame:
    """One row per document: its id, n_shingles, component_id."""
    rows = stored(shingle_rows(df, doc_id, text, size, least), "shingles")
    nodes = rows.where("n > 0 and doc_id is not null")
    first = nodes.groupBy("n", "sig").agg(F.min("doc_id").alias("rep"))
    rep = stored(nodes.select("doc_id", "n", "sig").join(first, ["n", "sig"]).groupBy("doc_id").agg(F.min("rep").alias("rep")), "copies")

    copies = stored(rep.where("rep <> doc_id"), "repeated")
    cells = nodes.select("doc_id", "n", F.explode("hs").alias("h"))
    counts = stored(cells.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "counts")
    shared = stored(shared_cells(cells, counts, copies), "shared")
    sizes = stored(rows.select("doc_id", "n"), "sizes")
    drop([rows, counts, copies])
    columns = stored(merged_columns(shared), "columns")
    cells = stored(shared.join(columns, "h"), "cells")
    drop([shared, columns])
    pairs, rest = light_pairs(cells, least)
    pairs, rest = stored(pairs, "pairs"), stored(rest, "open")
    drop([cells])

    needed = stored(ends(pairs).union(rest).distinct(), "needed")
    texts = needed_texts(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), needed)
    sets = stored(shingle_rows(texts, "doc_id", "text", size, None).select("doc_id", "n", "hs"), "sets")

    columns = stored(rare_columns(sets.join(rest, "doc_id", "left_semi"), least), "columns")
    found = [stored(verify(pairs.unionByName(spokes(columns, least, F.col("doc_id"))).distinct(), sets, least), "tied")]
    groups = components(found[0], "a", "b")
    # Rows that one component already holds need not meet again. Other rows of each column are tried
    # before the rest, so that few rows of different components are left in one column.
    for turn in range(1, TURNS + 1):
        apart = stored(split_columns(columns, groups), "apart")
        met = stored(spokes(apart, least, F.xxhash64("h", "doc_id", F.lit(turn))) if turn < TURNS else all_pairs(apart, least), "met")
        drop([apart])
        if not met.isEmpty():
            found.append(stored(verify(met, among(sets, ends(met), "doc_id"), least), "tied"))
            groups = components(reduce(DataFrame.unionByName, found), "a", "b")
        drop([met])
    drop([needed, pairs, rest, sets, columns])

    place = rep.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = sizes.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(place, "doc_id", "left")
    return out.select(F.col("doc_id").alias(doc_id), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir))
