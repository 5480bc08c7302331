"""6. Removal of repeated 100-byte strings by suffix arrays over shards.

Two equal windows of `width` bytes pick the same anchor: the `ANCHOR`-byte string inside
them with the smallest hash. Consecutive windows with one anchor are a segment. So:

1. Segments whose anchor occurs once hold no repeat. Anchors are counted with partial sums.
2. Equal segments of one anchor: all but the first (smallest document, then place) go.
3. The distinct segments of an anchor are a shard. Its suffix array is built by induced
   sorting (`suffixes`), and neighbours that share `width` bytes and more are runs of equal
   windows; all but the first of a run go. A shard with more than `SHARD` distinct segments is
   split before: its windows are dealt by their distance to the anchor, `STEP` distances to a piece,
   and by all bytes that the windows of a piece share; pieces are treated as in 2 and 3. What is
   still larger is split a second time, into single windows, whose shards hold one kind each.
4. The windows that go are joined to their documents, and the bytes they cover are removed.

Only hashes and places are shuffled for the whole corpus; texts travel compressed.

Defined cases: a null text is empty; texts shorter than `width` stay whole; bytes outside UTF-8 do
not arise; rows with one id are the same document (their spans are pooled, a copy stays); a row with
a null id comes before all others and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.arrays import HASH_BYTES, SpanHash, ragged, slices, utf8, whole_groups
from llm.suffixes import common_prefixes, suffix_arrays
from llm.tables import documents, drop, made, stored

WIDTH, ANCHOR, SHARD, STEP = 100, 28, 16, 8
# Bytes of shards whose suffix arrays are built together.
LANES_BYTES = 1 << 19


def segments(data: np.ndarray, offsets: np.ndarray, width: int, anchor: int, full: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start inside the row, windows, anchor hash, hash of the covered bytes if `full`)."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none, none
    hashes = SpanHash(data).windows(anchor)
    # The high half of a hash, then the place: the leftmost of the smallest wins.
    best = hashes >> np.uint64(32) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
    need, have = width - anchor + 1, 1
    while have * 2 <= need:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < need:
        best = np.minimum(best[: len(best) - (need - have)], best[need - have :])
    at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    windows = np.flatnonzero(row[: len(at)] == row[width - 1 :])
    if not len(windows):
        return none, none, none, none, none
    at = at[windows]
    new = np.r_[True, (at[1:] != at[:-1]) | (row[windows[1:]] != row[windows[:-1]])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(windows)])
    start = windows[first]
    whole = SpanHash(data, seed=2).spans(start, start + count + width - 1) if full else hashes[:0]
    return row[start], start - offsets[row[start]], count, hashes[at[first]].view(np.int64), whole.view(np.int64)


def segment_rows(docs: DataFrame, width: int, full: bool) -> DataFrame:
    """The segments of (doc_id, text): anchors alone, or with place and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASH_BYTES):
                row, start, count, anchor, whole = segments(*utf8(part.column("text")), width, ANCHOR, full)
                if not full:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])
                    continue
                ids = part.column("doc_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(start), pa.array(count.astype(np.int32)), pa.array(anchor), pa.array(whole)],
                    ["doc_id", "start", "windows", "anchor", "whole"])

    return docs.mapInArrow(run, "doc_id long, start long, windows int, anchor long, whole long" if full else "anchor long")


def packed(df: DataFrame, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, z, columns `keep`): whole texts, compressed for the shuffle."""
    picked = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"_{c}") for c in keep))
    more = [f"_{c}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text", HASH_BYTES):
                data, offsets = utf8(part.column("text"))
                raw, at = data.tobytes(), offsets.tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([press.compress(raw[a:b]) for a, b in zip(at, at[1:])], pa.binary()),
                     *(part.column(c) for c in more)], ["doc_id", "z", *more])

    fields = "".join(f", `{c}` {picked.schema[c].dataType.simpleString()}" for c in more)
    return picked.mapInArrow(run, "doc_id long, z binary" + fields)


def anchor_places(raw: list[bytes], anchor: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where the anchor stands in each segment: the leftmost place in its last window, which all its windows hold."""
    own = np.fromiter(map(len, raw), np.int64, len(raw))
    base = np.cumsum(own) - own
    hashes = SpanHash(np.frombuffer(b"".join(raw), np.uint8)).windows(ANCHOR)
    hit = np.flatnonzero(hashes == np.repeat(anchor.view(np.uint64), own)[: len(hashes)])
    seg = np.repeat(np.arange(len(raw)), own)[hit]
    at = hit - base[seg]
    fits = (at >= windows[seg] - 1) & (at <= own[seg] - ANCHOR)
    found, first = np.unique(seg[fits], return_index=True)
    assert len(found) == len(raw)
    return at[fits][first]


PARTS = "shard long, doc_id long, start long, windows int, skip int, core int, many boolean, bytes binary"


def cut_segments(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, z, places) to one row per place with its bytes; all its windows hold the `core` bytes from `skip` on
    (looked up for the segments of large shards only)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, "z", 1 << 17):
                out: list[tuple] = []
                for doc_id, z, places in zip(*(part.column(c).to_pylist() for c in ("doc_id", "z", "places"))):
                    raw = press.decompress(z)
                    out += [(p["anchor"], doc_id, p["start"], p["windows"], p["many"], raw[p["start"] : p["start"] + p["windows"] + width - 1])
                            for p in places]
                anchor, doc_id, start, windows, many, cut = zip(*out)
                large = np.flatnonzero(many)
                skip = np.zeros(len(out), np.int32)
                if len(large):
                    skip[large] = anchor_places([cut[k] for k in large], np.array(anchor)[large], np.array(windows)[large])
                columns = (anchor, doc_id, start, windows, skip, np.full(len(out), ANCHOR), many, cut)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)],
                                                 ["shard", "doc_id", "start", "windows", "skip", "core", "many", "bytes"])

    return texts.mapInArrow(run, PARTS)


def repeats_in_shards(shard: np.ndarray, doc: np.ndarray, start: np.ndarray, raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every window that is not the first of its kind in its shard.
    `shard` numbers the segments' shards from 0, in order."""
    length = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    n_shards = int(shard[-1]) + 1
    size = np.bincount(shard, length, n_shards).astype(np.int64) + 1
    by_size = np.argsort(-size, kind="stable")
    segs = np.argsort(np.argsort(by_size)[shard], kind="stable")  # segments in order of their lane
    sizes = size[by_size]
    base = np.cumsum(sizes) - sizes
    lane = np.argsort(by_size)[shard[segs]]
    # Symbols: 0 ends a lane, 1 ends a segment, bytes are 2 and up.
    text = np.zeros(int(sizes.sum()), np.int64)
    own = length[segs]
    opens = np.r_[True, lane[1:] != lane[:-1]]
    seg_at = np.cumsum(own) - own + lane  # one end symbol for each lane before
    flat = np.frombuffer(b"\xff".join(raw[s] for s in segs.tolist()) + b"\xff", np.uint8).astype(np.int64) + 2
    places = ragged(seg_at, own)
    text[places] = flat
    text[seg_at + own - 1] = 1
    # Only the symbols that occur get buckets.
    used = np.bincount(text, minlength=258) > 0
    text = (np.cumsum(used) - 1)[text]
    sa = suffix_arrays(text, sizes, np.full(len(sizes), int(used.sum())))
    shared = common_prefixes(text, sizes, sa)
    seg_of = np.full(len(text), -1, np.int64)
    seg_of[places] = np.repeat(segs, own)
    offset = np.zeros(len(text), np.int64)
    offset[places] = np.arange(len(places)) - np.repeat(np.cumsum(own) - own, own)
    where = np.repeat(base, sizes) + sa
    group = np.cumsum(shared < width)
    seg, off = seg_of[where], offset[where]
    real = (seg >= 0) & (off + width < length[np.maximum(seg, 0)])
    seg, off, group = seg[real], off[real], group[real]
    order = np.lexsort((start[seg] + off, doc[seg], group))
    later = np.r_[False, group[order][1:] == group[order][:-1]] if len(order) else np.zeros(0, bool)
    assert opens.sum() == n_shards
    return seg[order][later], off[order][later]


def shard_repeats(segs: DataFrame, width: int) -> DataFrame:
    """Steps 3's suffix arrays: (doc_id, start, windows) of the windows that go."""
    dealt = segs.select("shard", "doc_id", "start", "bytes").repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["shard"], LANES_BYTES):
            sizes = pc.binary_length(rows.column("bytes")).to_numpy()
            ends = np.cumsum(sizes)
            at = 0
            while at < len(starts) - 1:
                limit = (ends[starts[at]] - sizes[starts[at]]) + LANES_BYTES
                to = max(at + 1, int(np.searchsorted(ends[starts[1:] - 1], limit, "right")))
                a, b = int(starts[at]), int(starts[to])
                shard = np.repeat(np.arange(to - at), np.diff(starts[at : to + 1]))
                doc, start = rows.column("doc_id").to_numpy()[a:b], rows.column("start").to_numpy()[a:b]
                seg, off = repeats_in_shards(shard, doc, start, rows.column("bytes").slice(a, b - a).to_pylist(), width)
                doc, first = doc[seg], start[seg] + off
                order = np.lexsort((first, doc))
                doc, first = doc[order], first[order]
                joint = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1)]) if len(doc) else order
                n = np.diff(np.r_[joint, len(doc)])
                yield pa.RecordBatch.from_arrays([pa.array(doc[joint]), pa.array(first[joint]), pa.array(n.astype(np.int32))],
                                                 ["doc_id", "start", "windows"])
                at = to

    return dealt.mapInArrow(run, "doc_id long, start long, windows int")


def split(parts: DataFrame, step: int, width: int) -> DataFrame:
    """The windows of `parts`, dealt to pieces by their distance to the core, `step` distances to a piece. The windows of a piece
    share a longer core, whose bytes name its shard: equal windows stay in one shard."""
    last = F.col("windows") - 1
    dealt = parts.withColumn("b", F.explode(F.sequence(F.floor((F.col("skip") - last) / step), F.floor(F.col("skip") / step))))
    low = (F.col("b") * step).cast("int")
    dealt = (dealt.withColumn("low", low).withColumn("high", F.least(low + step - 1, F.lit(width) - F.col("core")))
             .withColumn("from", F.greatest(F.lit(0), F.col("skip") - F.col("high")))
             .withColumn("to", F.least(last, F.col("skip") - F.col("low")))
             .withColumn("held", F.col("low") + F.col("core") + F.lit(width) - F.col("core") - F.col("high")))
    core = F.substring("bytes", F.col("skip") - F.col("low") + 1, F.col("held"))
    return dealt.select(
        F.xxhash64("shard", "low", core).alias("shard"), "doc_id", (F.col("start") + F.col("from")).alias("start"),
        (F.col("to") - F.col("from") + 1).alias("windows"), (F.col("skip") - F.col("low") - F.col("from")).alias("skip"),
        F.col("held").alias("core"), F.substring("bytes", F.col("from") + 1, F.col("to") - F.col("from") + width).alias("bytes"))


def large_shard_repeats(parts: DataFrame, width: int) -> DataFrame:
    """The same for large shards: split into pieces, and what is still large into windows."""
    place = F.struct("doc_id", "start")
    kind = ["shard", "skip", "core", "windows", "bytes"]
    found = None
    for step in (STEP, 1):
        pieces = stored(split(parts, step, width), "pieces")
        kinds = stored(pieces.groupBy(*kind).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "piece_kinds")
        later = (pieces.join(kinds.where("n > 1").select(*kind, "first"), kind).where(place > F.col("first"))
                 .select("doc_id", "start", "windows"))
        found = later if found is None else found.unionByName(later)
        if step == 1:
            return found
        variants = stored(kinds.groupBy("shard").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "piece_variants")
        cut = stored(kinds.join(variants, "shard").select(*kind, "first.doc_id", "first.start", (F.col("k") > SHARD).alias("many")), "piece_shards")
        found = found.unionByName(shard_repeats(cut.where("not many"), width))
        parts = cut.where("many").drop("many")


def repeated_windows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, start, windows): runs of windows of `width` bytes that also start earlier."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col(doc_id).isNotNull())
    # Counts are stored before they are joined: then Spark can split a hot anchor.
    common = stored(segment_rows(docs, width, False).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    segs = stored(segment_rows(docs, width, True).join(common.hint("shuffle_hash"), "anchor"), "segments")
    kinds = stored(segs.groupBy("anchor", "whole").agg(F.min(F.struct("doc_id", "start", "windows")).alias("first"), F.count(F.lit(1)).alias("n")), "kinds")
    firsts = kinds.where("n > 1").select("anchor", "whole", F.struct("first.doc_id", "first.start").alias("first"))
    later = (segs.join(firsts, ["anchor", "whole"]).where(F.struct("doc_id", "start") > F.col("first"))
             .select("doc_id", "start", "windows"))
    variants = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "variants")
    places = (kinds.join(variants, "anchor").groupBy("first.doc_id")
              .agg(F.collect_list(F.struct("anchor", "first.start", "first.windows", (F.col("k") > SHARD).alias("many"))).alias("places")))
    cut = stored(cut_segments(packed(docs, "doc_id", "text").join(places, "doc_id"), width), "shards")
    return (later.unionByName(shard_repeats(cut.where("not many"), width))
            .unionByName(large_shard_repeats(cut.where("many").drop("many"), width)))


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, keep: tuple[str, ...] = (),
                    as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, columns `keep`): spans are the maximal removed runs (start,
    length), kept the remaining bytes end to end; `as_text`: as a string, without the bytes of
    characters that a removed run cuts in two."""
    before = len(made)
    runs = stored(repeated_windows(df, doc_id, text, width), "spans")
    drop(made[before:-1])  # all that only the spans were made from
    spans = runs.groupBy("doc_id").agg(
        F.collect_list(F.struct("start", F.col("windows").cast("long").alias("windows"))).alias("_spans"))
    texts = packed(df, doc_id, text, keep).join(spans, "doc_id", "left")
    more = [f"_{c}" for c in keep]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(raw: bytes, runs: list[dict] | None) -> tuple[int, list[dict], bytes | str]:
        merged: list[list[int]] = []
        for s, e in sorted((r["start"], min(len(raw), r["start"] + r["windows"] + width - 1)) for r in runs or ()):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            elif e > s:
                merged.append([s, e])
        edges = [0, *(x for m in merged for x in m), len(raw)]
        parts = [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]
        kept = "".join(p.decode("utf-8", "ignore") for p in parts) if as_text else b"".join(parts)
        return len(raw), [{"start": s, "length": e - s} for s, e in merged], kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, "z", 1 << 18):
                n, cuts, kept = zip(*(cut(press.decompress(z), runs) for z, runs in
                                      zip(part.column("z").to_pylist(), part.column("_spans").to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(cuts, spans_type), pa.array(kept, pa.string() if as_text else pa.binary()),
                     *(part.column(c) for c in more)], ["doc_id", "n_bytes", "spans", "kept", *more])

    fields = "".join(f", `{c}` {texts.schema[c].dataType.simpleString()}" for c in more)
    out = texts.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, length: long>>, kept "
                           + ("string" if as_text else "binary") + fields)
    return out.select(F.col("doc_id").alias(doc_id), "n_bytes", "spans", "kept", *(F.col(m).alias(c) for m, c in zip(more, keep)))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
