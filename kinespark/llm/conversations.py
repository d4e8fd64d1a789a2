"""Prefix trie of conversations: what many share is one node.

Turns are placed by a sort by ranges; a numpy scan gives every prefix a polynomial rolling fingerprint (sums of turn hashes
times powers of a base, modulo two primes), so prefixes of equal length and fingerprint are candidates for one node. Each
candidate group is then verified turn by turn against its representative, the smallest id: a row must have the
representative's role and text at this depth and the same candidate group at the depth before; where all rows do, every group
holds one sequence. Groups that fail, and what hangs below them, get a second fingerprint by another base and are verified
again, until none fails: collisions split, and no result rests on a hash.

The rollup to parents: each node belongs to its smallest member, whose nodes are a stretch of its own turns, so the trie is
a tree of such stretches. Sums over its subtrees take a number of rounds that is the logarithm of its height (each round a
stretch adds what lies twice as far below it); in a stretch, sums run over its turns. Ids that end at a node are packed in
order and hashed as a stream.

Conversations of any length and nodes with any number of members are dealt out by ranges, counts or the skew join; no task
holds one. Only the hash over a node's ids is one stream (constant memory), as its definition is a sequence.

Defined cases: null turns come first; null role and text are empty; equal turns of a conversation are ordered by role and text,
repeated rows stay; rows without conv_id belong to no conversation; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import crc32_sql, materialise, ready
from kinespark.llm.ordered import scanned

#: The two largest primes below 2^31: products fit 64 bits.
PRIMES, SHARED, CHUNK = (2**31 - 1, 2**31 - 19), 100, 1 << 20
_ENDS = "rep long, depth long, first long, ids string"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, i (place from 0 on), role and text of all turns that have a conv_id."""
    own = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("tie", F.monotonically_increasing_id())
    return scanned(own, ["conv_id", "turn", "role", "text", "tie"], "turns", key="conv_id").select("conv_id", F.col("rank").alias("i"), "role", "text")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, depth from 1 on, role, text), where the first h turns are those
    of conversation c - c % 100; h is the unsigned crc32 of c % 6."""
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % 6
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": h, "base": c - c % SHARED})
    sizes = convs.filter("conv_id = base").select("base", F.least(F.lit(5), "own").alias("has"))
    convs = materialise(convs.join(sizes, "base", "left").withColumn("m", F.least("h", F.coalesce("has", F.lit(0)))), "conversations")
    heads = turns.filter(f"i < 5 and conv_id % {SHARED} = 0").select(c.alias("base"), "i", "role", "text")
    taken = convs.filter("m > 0").select("conv_id", "base", "m").join(heads, "base").filter("i < m").select("conv_id", (F.col("i") + 1).alias("depth"), "role", "text")
    kept = turns.join(convs.select("conv_id", "h", "m"), "conv_id").filter("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("m") + 1).alias("depth"), "role", "text")
    length = F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return convs.select("conv_id", length.alias("length")), taken.unionByName(kept)


def _powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, square, e = np.ones(len(exponents), np.int64), base, exponents.astype(np.int64)
    while (e > 0).any():
        out = np.where(e & 1, out * square % prime, out)
        square, e = square * square % prime, e >> 1
    return out


def fingerprints(turns: DataFrame, seed: int, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """turns with fp, the fingerprint of the turns up to this one, and before, that of those before it."""
    ready(turns.sparkSession)
    bases = [int.from_bytes(hashlib.sha256(f"{seed}/{k}".encode()).digest()[:8], "big") % (p - 2) + 2 for k, p in enumerate(primes)]

    @F.pandas_udf("a long, b long")
    def terms(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hashes, depth in parts:
            h, d = hashes.to_numpy(np.int64), depth.to_numpy(np.int64)
            yield pd.DataFrame({c: (h % p) * _powers(b, d, p) % p for c, b, p in zip("ab", bases, primes, strict=True)})

    own = turns.withColumn("term", terms(F.xxhash64(F.lit(seed), "role", "text"), F.col("depth")))
    own = own.select(*turns.columns, F.col("term.a").alias("a"), F.col("term.b").alias("b"))
    own = scanned(own, ["conv_id", "depth"], "prefixes", key="conv_id", sums={"a": primes[0], "b": primes[1]})
    joined = lambda a, b: F.shiftleft(a, 31) + b
    gone = [F.pmod(F.col(f"sum_{c}") - F.col(c), F.lit(p)) for c, p in zip("ab", primes, strict=True)]
    return own.select(*turns.columns, joined(F.col("sum_a"), F.col("sum_b")).alias("fp"), joined(*gone).alias("before"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("depth", "fp", "more").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"))


def _failing(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """conv_id, depth, fp, more of rows that differ from their representative at this depth or in what comes before."""
    key = ["depth", "fp", "more"]
    told = groups.filter("n_convs > 1").select(*key, F.col("rep").alias("conv_id"))
    reps = told.join(rows, [*key, "conv_id"]).select(*key, F.col("role").alias("r"), F.col("text").alias("t"), F.col("before").alias("b"), F.col("before_more").alias("m"))
    same = (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")) & (F.col("before") == F.col("b")) & (F.col("before_more") == F.col("m"))
    return rows.join(reps, key).filter(~same).select("conv_id", *key)


def prefixes(turns: DataFrame, primes: tuple[int, int] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """The turns with depth, fp, more, before, before_more, and the groups (depth, fp, more, rep, n_convs); each
    group holds the conversations that share one sequence of turns."""
    zero = F.lit(0).cast("long")
    rows = fingerprints(turns, 0, primes).withColumns({"more": zero, "before_more": zero})
    rows, seed = materialise(rows, "prefixes"), 0
    while True:
        groups = materialise(_groups(rows), "nodes")
        failing = materialise(_failing(rows, groups), "collisions")
        if failing.isEmpty():
            return rows, groups
        seed += 1
        split = failing.select("depth", "fp", "more").distinct()
        since = rows.join(split, ["depth", "fp", "more"]).groupBy("conv_id").agg(F.min("depth").alias("since"))
        again = fingerprints(rows.drop("fp", "before"), seed).select("conv_id", "depth", F.col("fp").alias("fp2"), F.col("before").alias("before2"))
        mixed = lambda a, b: F.xxhash64(F.col(a), F.col(b))
        rows = rows.join(materialise(again, "again"), ["conv_id", "depth"]).join(since, "conv_id", "left")
        rows = rows.withColumn("more", F.when(F.col("depth") >= F.col("since"), mixed("more", "fp2")).otherwise(F.col("more")))
        rows = rows.withColumn("before_more", F.when(F.col("depth") > F.col("since"), mixed("before_more", "before2")).otherwise(F.col("before_more")))
        rows = materialise(rows.drop("fp2", "before2", "since"), "prefixes")


def _subtrees(stretches: DataFrame) -> DataFrame:
    """stretches: rep, up (the stretch it hangs on; null for the root's), leaves, saved. The sums over all that hangs below
    each, itself included."""
    now = materialise(stretches, "stretches")
    while not now.filter("up is not null").isEmpty():
        below = now.filter("up is not null").groupBy(F.col("up").alias("rep")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        far = now.select(F.col("rep").alias("up"), F.col("up").alias("next"))
        out = now.join(below, "rep", "left").join(far, "up", "left")
        plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
        now = materialise(out.select("rep", F.col("next").alias("up"), plus("leaves", "l").alias("leaves"), plus("saved", "s").alias("saved")), "stretches")
    return now.select("rep", "leaves", "saved")


def ends_hashes(ends: DataFrame) -> DataFrame:
    """ends: rep, depth, conv_id. The hash of the ids of each node, in order, with commas."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size = None, [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"rep": [key[0]], "depth": [key[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, schema=pa.schema([("rep", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

        for batch in batches:
            for rep, depth, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if ids and (key != (rep, depth) or size > CHUNK):
                    yield told()
                    ids, size = [], 0
                key = (rep, depth)
                ids.append(conv)
                size += 20
        if ids:
            yield told()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, first = None, None, True
        done: tuple[list, list, list] = ([], [], [])

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"rep": done[0], "depth": done[1], "ends_sha256": done[2]}, schema=pa.schema([("rep", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))
            for x in done:
                x.clear()
            return made

        def close() -> None:
            for x, y in zip(done, (*key, state.hexdigest()), strict=True):
                x.append(y)

        for batch in batches:
            for rep, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if key != (rep, depth):
                    if key is not None:
                        close()
                    key, state = (rep, depth), hashlib.sha256()
                    first = True
                state.update((ids if first else "," + ids).encode())
                first = False
            yield out()
        if key is not None:
            close()
            yield out()

    by = ["rep", "depth", "conv_id"]
    packed = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(pack, _ENDS)
    return packed.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").mapInArrow(stream, "rep long, depth long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """A row for each node of the trie of turns (conv_id, depth from 1 on without gaps, role, text); convs: all conv_id with
    their length, those without turns too."""
    ready(turns.sparkSession)
    root = convs.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    least = root.first()
    top = F.lit(least["rep"] if least else None).cast("long")
    rows, groups = prefixes(turns, primes)
    chars = rows.select("depth", "fp", "more", "before", "before_more", F.length("text").cast("long").alias("chars"), F.col("conv_id").alias("rep"))
    nodes = groups.join(chars, ["depth", "fp", "more", "rep"])
    above = groups.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("before"), F.col("more").alias("before_more"), F.col("rep").alias("up"))
    nodes = nodes.join(above, ["depth", "before", "before_more"], "left")
    nodes = nodes.select("rep", "depth", "n_convs", F.when(F.col("depth") == 1, top).otherwise(F.col("up")).alias("up"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    nodes = materialise(nodes.unionByName(root.select("rep", zero.alias("depth"), "n_convs", none.alias("up"), zero.alias("saved"))), "nodes")
    children = nodes.filter("up is not null").groupBy(F.col("up").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, ["rep", "depth"], "left").fillna(0, ["n_children"]).withColumn("leaves", (F.col("n_children") == 0).cast("long")), "nodes")
    stretches = nodes.groupBy("rep").agg(F.min_by("up", "depth").alias("up"), (F.min("depth") - 1).alias("at"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    stretches = materialise(stretches, "stretches")
    totals = _subtrees(stretches.drop("at"))
    hung = stretches.filter("up is not null").select("rep", "up", "at").join(totals, "rep").groupBy(F.col("up").alias("rep"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    plus = lambda a: F.col(a) + F.coalesce(f"more_{a}", F.lit(0))
    nodes = nodes.join(hung, ["rep", "depth"], "left").withColumns({"leaves": plus("leaves"), "saved": plus("saved"), "back": -F.col("depth")})
    nodes = scanned(nodes.drop("more_leaves", "more_saved"), ["rep", "back"], "rollup", key="rep", sums={"leaves": 0, "saved": 0})
    last = rows.select("conv_id", "depth", "fp", "more").join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
    ends = last.join(groups, ["depth", "fp", "more"]).select("rep", "depth", "conv_id")
    ends = ends.unionByName(convs.filter("length = 0").select(top.alias("rep"), zero.alias("depth"), "conv_id"))
    out = nodes.join(ends_hashes(ends), ["rep", "depth"], "left")
    return out.select(
        F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    convs, own = rebuilt(materialise(numbered(turns), "turns"))
    return trie(convs, own)


#: Whole sequences as keys.
SQL = f"""
WITH own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own) q),
built AS (
    SELECT c.conv_id, 0 AS part, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.i < c.h
    UNION ALL
    SELECT c.conv_id, 1, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i >= c.h),
prefixes AS (
    SELECT conv_id, count(*) OVER w AS depth, list({{'role': role, 'text': text}}) OVER w AS turns, length(text) AS chars FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING)
    UNION ALL
    SELECT conv_id, 0, CAST([] AS STRUCT(role VARCHAR, text VARCHAR)[]), 0 FROM convs),
last AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
nodes AS (
    SELECT p.depth, p.turns, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(p.chars) AS chars, sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE p.depth = l.depth), '')) AS ends_sha256
    FROM prefixes p JOIN last l ON l.conv_id = p.conv_id GROUP BY p.depth, p.turns),
linked AS (SELECT n.*, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.turns = n.turns[1:n.depth - 1]),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN kids k USING (conv_id, depth)),
below AS (SELECT turns[1:d] AS turns, d AS depth, n_children, (n_convs - 1) * chars AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) q),
sums AS (SELECT depth, turns, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY depth, turns)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.depth = f.depth AND s.turns = f.turns
"""
