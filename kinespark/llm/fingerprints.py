"""Document fingerprints: threshold-scaled sketches, in DataFrame functions alone.

The sketch of a text is the set of hashes of its five-word shingles (lower case, words parted by white space; a shorter
text is one shingle) that lie below a fixed fraction of the hash space; if none does, the smallest hash stands in, so a
short text is not lost. The size follows the text, so a short text's share in a very long one can be told, which sketches
of fixed size cannot. Sketches of parts merge into that of the whole (``merge``). As a string, a sketch is its hashes in
ascending order, 16 hex digits each; a text without a word has the empty sketch.

Likeness is containment: shared hashes over those of the smaller sketch; of two empty sketches it is 1, of one 0. How many
hashes it rests on stands beside it (0 where a sketch is a stand-in, which says little of a longer text).

Null text is the empty text. Rows with a null id come first; rows with the same id are ordered by hash of the text, repeated
rows follow each other. Rows are dealt by ranges of (id, hash of the text, running number), whose count follows the bytes of
the texts: an id or a text that many rows share spans several ranges, so no task holds all rows of one. Other columns are
ignored. An empty table gives an empty result; a single row follows itself.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import whole_text

FRACTION, SHINGLE, RANGE_BYTES, MOST_RANGES = 1 / 4, 5, 32 << 20, 1 << 16
_LOW, _HIGH = -(2**63), 2**63 - 1


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, size: int = SHINGLE, fraction: float = FRACTION) -> Column:
    limit = F.lit(int(2**63 * fraction))
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, size)).bitwiseAND(F.lit(2**63 - 1)))

    def kept(every: Column) -> Column:
        few = F.filter(every, lambda x: x < limit)
        return _let(few, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(F.array(F.array_min(every))))

    none = F.array().cast("array<bigint>")
    return _let(hashed, lambda h: F.when(F.size(h) == 0, none).otherwise(_let(shingles(h), kept)))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the union of what two sketches stand for."""
    limit = F.lit(int(2**63 * fraction))
    both = F.array_sort(F.array_union(a, b))
    few = F.filter(both, lambda x: x < limit)
    return F.when(F.size(few) > 0, few).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    some = F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1))
    return F.when(least > 0, some).otherwise(F.when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0)))


def resemblance(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every > 0, shared / F.greatest(every, F.lit(1))).otherwise(F.lit(1.0))


def rests_on(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Hashes below the limit in the smaller sketch: how sure a likeness is."""
    below = lambda x: F.when(F.get(x, F.lit(0)) < int(2**63 * fraction), F.size(x)).otherwise(F.lit(0))
    return F.least(below(a), below(b))


def as_string(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _cuts(df: DataFrame, column: str, parts: int, by: str | None = None) -> dict:
    """Values that cut the column, in each group of by, into so many ranges of about the same number of rows."""
    at = [i / parts for i in range(1, parts)] or [0.5]
    cut = F.percentile_approx(column, at, max(10_000, 20 * parts)).alias("cuts")
    rows = df.groupBy(F.col(by).alias("by") if by else F.lit(0).alias("by")).agg(cut).collect()
    return {r["by"]: sorted(r["cuts"] or []) for r in rows}


def borders(keys: DataFrame, parts: int, few: int = 64) -> list[tuple[int, int, int]]:
    """Ascending (key, hash, salt) that begin ranges. A key that several cuts fall on is cut by hash, and so is a hash by salt."""
    spark, out = keys.sparkSession, []
    cuts = Counter(_cuts(keys, "key", parts).get(0, []))
    inner: dict[int, list[int]] = {}
    for hot, pieces in (([k for k, n in cuts.items() if 1 < n <= few], few), ([k for k, n in cuts.items() if n > few], parts)):
        if hot:
            some = keys.join(F.broadcast(spark.createDataFrame([(k,) for k in hot], "key long")), "key")
            inner |= {k: x[:: max(1, pieces // cuts[k])] for k, x in _cuts(some, "hash", pieces, "key").items()}
    for key in sorted(cuts):
        out.append((key, _LOW, _LOW))
        if key in inner:
            for h, times in sorted(Counter(inner[key]).items()):
                out += [(key, h, _LOW + (1 << 64) * j // times) for j in range(times)]
            out.append((key, _HIGH, _HIGH))
    return sorted(set(out))


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _place(at: Column, cuts: list[tuple[int, int, int]]) -> Column:
    """How many of the sorted cuts are at most the struct at, by halving."""
    if not cuts:
        return F.lit(0)
    sides = F.arrays_zip(*[_numbers([c[i] for c in cuts]).alias(n) for i, n in enumerate(("key", "hash", "salt"))])

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        below = F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        cut = F.element_at(sides, F.least(mid + 1, F.lit(len(cuts))))
        return F.when(s["lo"] >= s["hi"], s).when(F.struct(cut["key"].alias("key"), cut["hash"].alias("hash"), cut["salt"].alias("salt")) <= at, above).otherwise(below)

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text, next: the text of the following row by ascending id, the first after the last.

    Rows are dealt by ranges and ordered inside them; the text that begins a range also goes to the end of the range before.
    The driver holds a few numbers for each range. Texts move once, but for those that begin a range."""
    spark = docs.sparkSession
    key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)), whole_text()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key"), F.xxhash64(text).alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    parts = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes)))
    cuts = borders(own.select("key", "hash"), parts)
    own = own.withColumn("part", _place(F.struct("key", "hash", "salt"), cuts).cast("long"))
    # rows of one (key, hash) have one text, so any of them can stand for the first of a range
    firsts = {r["part"]: (r["least"]["key"], r["least"]["hash"]) for r in own.groupBy("part").agg(F.min(F.struct("key", "hash")).alias("least")).collect()}
    there = sorted(firsts)
    if not there:
        tails = own.select("text", "part", "key", "hash")
    else:
        dense, before = range(max(there) + 1), {p: there[i - 1] for i, p in enumerate(there)}
        first_key, first_hash, prior = (F.element_at(_numbers(x), (F.col("part") + 1).cast("int")) for x in ([firsts.get(p, (_LOW, _LOW))[0] for p in dense], [firsts.get(p, (_LOW, _LOW))[1] for p in dense], [before.get(p, 0) for p in dense]))
        tails = own.filter((F.col("key") == first_key) & (F.col("hash") == first_hash)).groupBy("part").agg(F.first("text").alias("text"))
        tails = tails.select("text", prior.alias("part"), F.lit(_HIGH).alias("key"), F.lit(_HIGH).alias("hash"))
    tails = tails.select(F.lit(None).cast("long").alias("doc_id"), "text", "key", "hash", "part", F.lit(1).alias("tail"))
    dealt = own.select("doc_id", "text", "key", "hash", "part", F.lit(0).alias("tail")).unionByName(tails).repartition(parts, "part")
    order = Window.partitionBy("part").orderBy("tail", "key", "hash")
    return dealt.select("doc_id", "text", "part", "tail", F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("rn"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """For each row: its fingerprint, that of its text with the last half replaced from the next row, and likenesses."""
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n.cast("int") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    pairs = with_next(docs).withColumn("edited", edited)
    real = F.col("tail") == 0
    made = pairs.select("doc_id", "part", "tail", "rn", n.alias("n_chars"), F.when(real, F.sha2("edited", 256)).alias("edited_sha256"), sketch(F.col("text")).alias("own"), F.when(real, sketch(F.col("edited"))).alias("other"))
    following = made.withColumn("after", F.lead("own").over(Window.partitionBy("part").orderBy("rn"))).filter(real)
    own, other, after = F.col("own"), F.col("other"), F.coalesce("after", "own")
    return following.select(
        "doc_id", "n_chars", "edited_sha256", as_string(own).alias("fingerprint"), as_string(other).alias("edited_fingerprint"),
        containment(own, other).alias("near_edited"), containment(own, after).alias("near_next"),
        resemblance(own, other).alias("jaccard_edited"), resemblance(own, after).alias("jaccard_next"), rests_on(own, other).alias("rests_on_edited"), rests_on(own, after).alias("rests_on_next"),
    )
