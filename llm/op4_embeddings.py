"""4. Near-duplicate vectors by spherical-cap filters.

Filter directions are `CODES` product codes: after a seeded rotation the space is cut into
two blocks, each with its own random unit directions; a filter is one direction per block.
A vector is decoded to all filters whose inner product with it exceeds the cap's height:
directions of the first block that cannot reach the height are dropped, and the rest is
completed from the sorted scores of the second. Vectors meet in their common filters, and every pair that meets is checked by its cosine in double precision.

The number of filters follows the number of vectors so that a filter holds about `BUCKET`
of them, and the height is set for about `FILTERS` filters per vector and code: a pair at the
threshold then meets with a probability of about 0.99 (tests measure it). A filter with
more vectors than `CHUNK` is cut into chunks, and all pairs of chunks are tiles of their own:
nothing is capped. A pair is counted in its smallest common filter only. A tile returns sums per
vector and a spanning forest, never its pairs. Equal vectors are compared once.

Defined cases: a vector that is null, empty, zero or has null or non-finite components links
with nothing (its component is its own id); repeated rows are vectors of their own; vectors of different
lengths never link; a null id links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.arrays import whole_groups
from llm.components import components
from llm.tables import stored, table

BUCKET, CHUNK, BLOCKS, CODES, LEAST = 256, 512, 2, 3, 0.9


def plan(vectors: int) -> tuple[int, float]:
    """(directions per block, filters per vector and code) for a number of vectors. Caps shrink
    as there are more of them, and two near vectors share fewer; more filters make up for it."""
    filters = 6.0 + 1.5 * np.log10(max(vectors, 10))
    return max(6, int(np.ceil((max(vectors, 1) * filters / BUCKET) ** (1 / BLOCKS)))), float(filters)


@lru_cache(maxsize=16)
def cap_height(dims: int, size: int, filters: float, seed: int) -> float:
    """The height that `filters` filters exceed on average, over seeded random unit vectors."""
    x = np.random.default_rng(11).standard_normal((256, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    low, high = 0.0, 1.0
    for _ in range(12):
        mid = (low + high) / 2
        low, high = (mid, high) if len(decode(x, size, mid, seed)[0]) > filters * len(x) else (low, mid)
    return low


@lru_cache(maxsize=16)
def code(dims: int, size: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rotation, per block its directions as columns)."""
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    blocks = []
    for part in np.array_split(np.arange(dims), min(BLOCKS, dims)):
        d = rng.standard_normal((len(part), size))
        blocks.append(d / np.linalg.norm(d, axis=0) * np.sqrt(len(part) / dims))
    return rotation, blocks


def decode(x: np.ndarray, size: int, height: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for all filters that exceed `height`; rows are unit vectors."""
    rotation, blocks = code(x.shape[1], size, seed)
    x = x @ rotation
    cuts = np.cumsum([0, *(b.shape[0] for b in blocks)])
    scores = [x[:, a:z] @ b for a, z, b in zip(cuts, cuts[1:], blocks)]

    def sums(parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(x), 1))
        for p in parts:
            out = (out[:, :, None] + p[:, None, :]).reshape(len(x), -1)
        return out

    front, back = sums(scores[: len(scores) // 2]), sums(scores[len(scores) // 2 :])
    order = np.argsort(-back, axis=1)
    sorted_back = np.take_along_axis(back, order, axis=1)
    row, i = np.nonzero(front >= height - sorted_back[:, :1])
    need = height - front[row, i]
    count = (sorted_back[row] >= need[:, None]).sum(1)
    rep = np.repeat(np.arange(len(row)), count)
    j = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
    return row[rep], i[rep] * back.shape[1] + order[row[rep], j]


def _units(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    kind = "<f4" if len(raw) == 4 * dims * len(column) else "<f8"
    x = np.frombuffer(raw, kind).astype(np.float64).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_copies(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST) -> DataFrame:
    """One row per vector: its id, n_links (other vectors at `least` or more), component_id."""
    rows = df.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v"))
    if rows.schema["v"].dataType.simpleString() != "array<float>":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    fine = (F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
            & F.exists("v", lambda c: c != 0))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    texts = rows.where("fine").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    # One row for each distinct vector.
    reps = stored(texts.select("id", "w", "v", F.size("v").alias("dims")), "vectors")
    n_reps = reps.count()
    size, per_code = plan(n_reps)

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims_of = batch.column("dims").to_numpy()
            for dims in np.unique(dims_of):
                part = batch.filter(pa.array(dims_of == dims))
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    raw = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    x = raw.astype(np.float64)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    found = [decode(unit, size, cap_height(int(dims), size, per_code, seed), seed) for seed in range(CODES)]
                    row = np.concatenate([r for r, _ in found])
                    which = np.concatenate([w + seed * size**BLOCKS for seed, (_, w) in enumerate(found)])
                    order = np.lexsort((which, row))
                    row, which = row[order], which[order]
                    cut = np.searchsorted(row, np.arange(some.num_rows + 1))
                    lists = [which[a:b].astype("<i8").tobytes() for a, b in zip(cut, cut[1:])]
                    raw = [r.tobytes() for r in raw]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(which.astype(np.int64)), some.column("id").take(take), some.column("w").take(take), some.column("dims").take(take),
                         pa.array(raw, pa.binary()).take(take), pa.array(lists, pa.binary()).take(take)],
                        ["f", "id", "w", "dims", "v", "fs"])

    met = reps.mapInArrow(filters, "f long, id long, w long, dims int, v binary, fs binary")
    sizes = reps.mapInArrow(filters, "f long, id long, w long, dims int, v binary, fs binary").groupBy("f", "dims").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.where("n > 1").select("f", "dims", F.ceil(F.col("n") / CHUNK).cast("long").alias("k"))
    tiles = (met.join(sizes, ["f", "dims"])
             .withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")))
             .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
             .withColumn("ta", F.least("c", "o")).withColumn("tb", F.greatest("c", "o")))
    # A vector of chunk c is on the left side of tile (c, o) if c <= o; in tile (c, c) it is on both.
    tiles = (tiles.select("f", "dims", "ta", "tb", (F.col("c") == F.col("ta")).alias("left"), "id", "w", "v", "fs")
             .repartition("f", "dims", "ta", "tb").sortWithinPartitions("f", "dims", "ta", "tb", "id"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["f", "dims", "ta", "tb"]):
            f, dims, same = (rows.column(c).to_numpy() for c in ("f", "dims", "ta"))
            same = same == rows.column("tb").to_numpy()
            ids, w, left = (rows.column(c).to_numpy() for c in ("id", "w", "left"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(starts, starts[1:]):
                if b - a < 2:
                    continue
                x = _units(rows.column("v").slice(a, b - a), int(dims[a]))
                pick = np.ones(b - a, bool) if same[a] else left[a:b]
                one = np.flatnonzero(pick)
                two = one if same[a] else np.flatnonzero(~pick)
                hit = x[one] @ x[two].T >= least
                if same[a]:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                hit &= ~_met_before(rows.column("fs").slice(a, b - a), one, two, int(f[a]))
                ids_one, ids_two, w_one, w_two = ids[a:b][one], ids[a:b][two], w[a:b][one], w[a:b][two]
                out.append((ids_one, hit @ w_two, np.where(hit.any(1), _first(hit, ids_two), ids_one)))
                if not same[a]:
                    out.append((ids_two, hit.T @ w_one, np.where(hit.any(0), _first(hit.T, ids_one), ids_two)))
                # Every link that the first neighbours do not already imply inside this tile.
                extra = _forest(hit)
                out.append((ids_one[extra[:, 0]], np.zeros(len(extra), np.int64), ids_two[extra[:, 1]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(o[k], np.int64) for o in out])) for k in range(3)],
                                                 ["id", "n", "to"])

    found = stored(tiles.mapInArrow(compare, "id long, n long, to long").where("n > 0 or id <> to"), "neighbours")
    groups = components(found, "id", "to")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    by_rep = (reps.select("id", "w", "v").join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
              .select("v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    good = rows.where("fine").join(by_rep, "v").select("id", "n_links", "component_id")
    rest = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).withColumnRenamed("id", vec_id)


def _first(hit: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return ids[np.argmax(hit, axis=1)]


def _met_before(lists: pa.ChunkedArray, one: np.ndarray, two: np.ndarray, here: int) -> np.ndarray:
    """Whether two vectors share a filter smaller than `here`."""
    own = [x[x < here] for x in (np.frombuffer(b, "<i8") for b in lists.to_pylist())]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    if not len(row):
        return np.zeros((len(one), len(two)), bool)
    names, column = np.unique(np.concatenate(own), return_inverse=True)
    has = np.zeros((len(own), len(names)), np.float32)
    has[row, column] = 1
    return has[one] @ has[two].T > 0


def _forest(hit: np.ndarray) -> np.ndarray:
    """Links (row, column) that join what the first neighbour of every row and column leaves apart."""
    rows, cols = hit.shape
    label = np.arange(rows + cols)

    def top(v: int) -> int:
        while label[v] != v:
            label[v] = label[label[v]]
            v = label[v]
        return v

    out = []
    i, j = np.nonzero(hit)
    first_of_row = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
    for a, b in zip(i[first_of_row].tolist(), j[first_of_row].tolist()):
        label[top(a)] = top(rows + b)
    flat = np.array([top(v) for v in range(rows + cols)])
    apart = np.flatnonzero(flat[i] != flat[rows + j])
    for k in apart.tolist():
        a, b = top(int(i[k])), top(rows + int(j[k]))
        if a != b:
            label[a] = b
            out.append((i[k], j[k]))
    return np.array(out, np.int64).reshape(-1, 2)


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


# All pairs by brute force: right, but only for small tables.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, c -> c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, c -> c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce((SELECT count(*) FROM links l WHERE l.a = e.vec_id), 0) AS n_links,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) = e.vec_id AS kept
FROM embeddings e
"""
