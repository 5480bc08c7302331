"""13. Personal data by bootstrapped contextual extraction, with Spark expressions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They are the seeds:

1. Every identifier-like mention (a run of digits and marks, something around an @, groups of hex
   digits) is an instance; the words beside it are its lexical patterns (the word before it with its
   mark, the two words before it, the words on both sides).
2. Instances and patterns make a graph per kind. Each round scores a pattern by the weights of its
   distinct instances over their number, and an instance without a seed by the mean of its patterns.
   An instance at `ACCEPT` or more counts in full from then on, the others by half.
3. Mentions that are no base match, but stand in a pattern of confidence `ACCEPT` or more and have a
   shape that its kind allows, are added as spans.

A pattern needs `SUPPORT` distinct trusted instances, so repeated copies of one text teach nothing. Spans are in code
points, end exclusive. The graph is counted by partial sums over distinct edges; each round is
stored in the shared folder.

Defined cases: a null text is empty; repeated rows and null ids are rows like any other; added spans never
overlap base spans or each other (the earlier start wins, then the longer one); an empty table gives no
rows. Words of a context are looked for within `NEAR` characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.tables import documents, drop, stored
from playbill.functions.base import let

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive repeats and the look behind only spare retries that
# cannot match (\G: a match may start where the last one ended).
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?=[0-9])(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PATTERNS = (_EMAIL, _IP, _CARD, _PHONE)
_HINTS = ("@", r"[0-9]\.[0-9]", "[0-9]", r"\+[0-9]")
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"

# What may be an identifier: something around an @, groups of hex digits, a run of digits and marks;
# each with what a text must hold for it to be looked for.
_OUT = r"\s@,;:<>()\[\]{}\"'"
MENTIONS = (
    (rf"(?:\G|(?<![^{_OUT}]))[^{_OUT}]++@[^{_OUT}]*[\p{{L}}\p{{N}}]", "@"),
    (r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}+(?![0-9A-Za-z:])", ":[0-9A-Fa-f]{1,4}:"),
    (r"(?=[+(0-9])(?<![\p{L}\p{N}])[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++(?![\p{L}\p{N}@])", "[0-9]"),
)
NEAR = 64
SUPPORT, ACCEPT, ROUNDS, DAMPED = 3, 0.6, 4, 0.5
# Spans whose places are summed up together.
_BLOCK = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern is an identifier of its kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda p: ~p.rlike(rf"\A{_BYTE}\z"))
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    return F.length(_digits(match)).between(10, 15)


def _before(lengths: Column) -> Column:
    """For an array of lengths, the sum of those before each: sums of blocks first, so that
    the work does not grow with the square of the array."""
    def add(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)

    def inner(b: Column) -> Column:
        return F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))

    def shifted(starts: Column) -> Column:
        return F.transform(lengths, lambda _, i: let(F.floor(i / _BLOCK).cast("int"), lambda b: F.get(starts, b) + add(
            F.slice(lengths, b * _BLOCK + 1, i - b * _BLOCK))))

    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / _BLOCK).cast("int") - 1, F.lit(0)))
    return let(F.transform(blocks, lambda b: add(inner(b))),
               lambda sums: let(F.transform(blocks, lambda b: add(F.slice(sums, F.lit(1), b))), shifted))


def _found(text: Column, pattern: str, hint: str) -> Column:
    """Matches as structs (start, end, value, left, right): `left` and `right` are what stands between
    a match and its neighbours, at most `NEAR` characters of it. `hint`: a cheap pattern that every
    text with a match holds."""
    def place(both: Column) -> Column:
        values, pieces = both["values"], both["pieces"]
        gaps = F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), values, lambda p, v: F.length(p) + F.length(v))

        def one(start: Column, i: Column) -> Column:
            piece, value = F.get(pieces, i), F.get(values, i)
            at = start + F.length(piece)
            return F.struct(at.alias("start"), (at + F.length(value)).alias("end"), value.alias("value"),
                            F.right(piece, F.lit(NEAR)).alias("left"), F.left(F.get(pieces, i + 1), F.lit(NEAR)).alias("right"))

        return F.transform(_before(gaps), one)

    values = F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    return let(values, lambda v: F.when(F.size(v) > 0, let(
        F.struct(v.alias("values"), F.split(text, pattern, -1).alias("pieces")), place)).otherwise(none))


def base_spans(text: Column) -> Column:
    """The base matches as structs (start, kind, end), sorted; `kind` is a place in `KINDS`."""
    def of(kind: int) -> Column:
        spans = F.filter(_found(text, _PATTERNS[kind], _HINTS[kind]), lambda m: _holds(KINDS[kind], m["value"]))
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return F.array_sort(F.concat(*map(of, range(len(KINDS)))))


def written(spans: Column) -> Column:
    """`kind:start:end`, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _shape(value: Column) -> Column:
    """The kinds that a mention which is no base match may be of."""
    def of(digits: Column) -> Column:
        n = F.length(digits)
        return (F.when(value.contains("@"), F.array(F.lit(0)))
                .when(value.contains(":"), F.array(F.lit(1)))
                .when(value.rlike(r"\A[0-9]+(?:\.[0-9]+){3}\z"), F.array(F.lit(1)))
                .when(n.between(7, 12), F.array(F.lit(3)))
                .when(n.between(13, 15), F.array(F.lit(2), F.lit(3)))
                .when(n.between(16, 19), F.array(F.lit(2)))
                .otherwise(F.array().cast("array<int>")))

    return let(_digits(value), of)


def _kind_of(value: Column) -> Column:
    """The kind of the first base match inside a mention, or null."""
    def has(kind: int) -> Column:
        return F.exists(F.regexp_extract_all(value, F.lit(_PATTERNS[kind]), F.lit(0)), lambda m: _holds(KINDS[kind], m))

    return F.coalesce(*[F.when(has(k), F.lit(k)) for k in (0, 3, 1, 2)])


def _contexts(left: Column, right: Column) -> Column:
    """The lexical patterns beside a mention, as texts; none without a word before it."""
    gap = r"[^\p{L}\p{N}\n]"
    before = F.lower(left)

    def of(words: Column) -> Column:
        one, mark, two, after = (words[n] for n in ("one", "mark", "two", "after"))
        return F.when(one == "", F.array().cast("array<string>")).otherwise(F.filter(F.array(
            F.concat(one, mark, F.lit(" _")),
            F.when(two != "", F.concat(two, F.lit(" "), one, F.lit(" _"))),
            F.when(after != "", F.concat(one, F.lit(" _ "), after))), lambda p: p.isNotNull()))

    return let(F.struct(
        F.regexp_extract(before, rf"(\p{{L}}+){gap}{{0,3}}\z", 1).alias("one"),
        F.trim(F.regexp_extract(before, rf"\p{{L}}({gap}{{0,3}})\z", 1)).alias("mark"),
        F.regexp_extract(before, rf"(\p{{L}}+){gap}{{1,3}}\p{{L}}+{gap}{{0,3}}\z", 1).alias("two"),
        F.regexp_extract(F.lower(right), rf"\A{gap}{{0,3}}(\p{{L}}+)", 1).alias("after")), of)


def mentions(text: Column) -> Column:
    """Identifier-like mentions: (start, end, item, seed, kinds, patterns). `item` is the mention's
    digits, or its text in lower case; `seed` the kind of a base match, `kinds` what else it may be."""
    def of(m: Column) -> Column:
        plain = m["value"].contains("@") | m["value"].contains(":")
        return let(_kind_of(m["value"]), lambda seed: F.struct(
            m["start"].alias("start"), m["end"].alias("end"),
            F.when(plain, F.lower(m["value"])).otherwise(_digits(m["value"])).alias("item"), seed.alias("seed"),
            F.when(seed.isNotNull(), F.array(seed)).otherwise(_shape(m["value"])).alias("kinds"),
            _contexts(m["left"], m["right"]).alias("patterns")))

    found = F.concat(*[_found(text, pattern, hint) for pattern, hint in MENTIONS])
    long_enough = F.filter(found, lambda m: m["value"].rlike("[@:]") | F.length(_digits(m["value"])).between(7, 19))
    return F.filter(F.transform(long_enough, of), lambda m: (F.size(m["kinds"]) > 0) & (F.size(m["patterns"]) > 0))


def mark(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with `base` (spans) and `mentions`."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(*keep, base_spans(body).alias("base"), mentions(body).alias("mentions"))


def edges(marked: DataFrame) -> DataFrame:
    """Distinct (kind, pattern, item) with `seed`: the graph that the rounds score."""
    one = marked.select(F.explode("mentions").alias("m")).select("m.item", "m.seed", F.explode("m.kinds").alias("kind"), "m.patterns")
    return (one.select("kind", F.explode("patterns").alias("pattern"), "item", F.col("seed").isNotNull().alias("seed"))
            .groupBy("kind", "pattern", "item").agg(F.max("seed").alias("seed")))


def score_patterns(graph: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(kind, pattern, confidence, trusted, instances) of all patterns with enough trusted instances."""
    def confidence(weighted: DataFrame) -> DataFrame:
        """`w` is an instance's belief; trusted instances count in full, others by half."""
        full = (F.col("w") >= accept)
        sums = weighted.groupBy("kind", "pattern").agg(
            F.sum(F.when(full, F.col("w")).otherwise(F.col("w") * DAMPED)).alias("w"), F.count(F.lit(1)).alias("instances"),
            F.count_if(full).alias("trusted"))
        return stored(sums.where(F.col("trusted") >= support).select(
            "kind", "pattern", (F.col("w") / (F.col("instances") + 1)).alias("confidence"), "trusted", "instances"), "patterns")

    patterns = confidence(graph.withColumn("w", F.col("seed").cast("double")))
    for _ in range(rounds - 1):
        if patterns.isEmpty():
            break
        unseen = graph.where(~F.col("seed"))
        beliefs = (unseen.join(patterns, ["kind", "pattern"], "left").groupBy("kind", "item")
                   .agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("w")).where("w > 0"))
        beliefs = stored(beliefs, "beliefs")
        known = graph.join(beliefs, ["kind", "item"], "left").select(
            "kind", "pattern", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("w", F.lit(0.0))).alias("w"))
        before, patterns = patterns, confidence(known)
        drop([before, beliefs])
    return patterns


def discovered(marked: DataFrame, patterns: DataFrame, row: str, accept: float = ACCEPT) -> DataFrame:
    """(row, added): spans of mentions that no base pattern finds, but patterns do."""
    sure = patterns.where(F.col("confidence") >= accept).select("kind", "pattern", "confidence")
    unseen = (marked.select(row, F.explode("mentions").alias("m")).where("m.seed IS NULL")
              .select(row, "m.start", "m.end", "m.kinds", F.explode("m.patterns").alias("pattern"))
              .select(row, "start", "end", "pattern", F.explode("kinds").alias("kind")))
    found = unseen.join(sure, ["kind", "pattern"]).groupBy(row, "start", "end").agg(
        F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    base = marked.join(found.select(row).distinct(), row, "left_semi").select(row, F.explode("base").alias("b"))
    spans = found.withColumn("own", F.lit(False)).unionByName(
        base.select(row, "b.start", "b.end", "b.kind", F.lit(True).alias("own")))
    # Nothing that a base span reaches into, and the first of those that overlap.
    along = W.partitionBy(row).orderBy("start", F.desc("end"), "kind")
    so_far = F.max(F.when(F.col("own"), F.col("end"))).over(along.rowsBetween(W.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("own"), F.col("start"))).over(along.rowsBetween(1, W.unboundedFollowing))
    free = spans.select("*", so_far.alias("_a"), ahead.alias("_b")).where(
        ~F.col("own") & (F.coalesce("_a", F.lit(0)) <= F.col("start")) & (F.coalesce("_b", F.col("end")) >= F.col("end")))
    return free.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))


def find_identifiers(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(`keep` columns with `base` and `added` spans, the scored patterns)."""
    marked = stored(mark(df, text, keep).withColumn("_row", F.monotonically_increasing_id()), "mentions")
    graph = stored(edges(marked), "graph")
    patterns = score_patterns(graph)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if patterns.where(F.col("confidence") >= ACCEPT).isEmpty():
        return marked.select(*keep, "base", none.alias("added")), patterns
    added = stored(discovered(marked, patterns, "_row"), "added")
    return marked.join(added, "_row", "left").select(*keep, "base", F.coalesce("added", none).alias("added")), patterns


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = find_identifiers(documents(spark, sf_dir))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = map(count, range(len(KINDS)))
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
