"""SimHash near-dedup with deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in three bits at most, one segment
differs in one bit at most; so they share one of its 32 variants in which one bit is left out. Variants are dealt by
value and sorted; fingerprints of a run are compared by exclusive or. Runs of up to ``BLOCK`` fingerprints are compared
in place, longer ones in pairs of blocks, so no run is cut short and none is gathered whole. Each comparison gives the
links of a spanning forest, never all pairs. Equal fingerprints count once.

Null text counts as empty; without a word the fingerprint is zero and links like any other. Repeated rows and ids are
kept, each with its component. An id that is null is no component's smallest unless it is alone. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import carried, map_arrow, materialise, ready, words_of
from kinespark.llm.components import star_components

BLOCK = 4096
_STEP = 1 << 16


def fingerprint(words: list[bytes], size: int = 3, seed: int = 42) -> int:
    """Bit by bit, whether over half of the shingles' hashes have it set."""
    n = max(1, len(words) - size + 1)
    if not words:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        some = words[at : min(at + _STEP, n) + size - 1]
        shingles = map(b" ".join, zip(*(some[i:] for i in range(size)), strict=False)) if len(some) >= size else [b" ".join(some)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.fromiter((fingerprint(words_of(t.as_py()), size) for t in batch.column(1)), np.uint64, batch.num_rows)
        return {"doc_id": batch.column(0), "fp": fps.view(np.int64)}

    return map_arrow(docs.select(docs["doc_id"].cast("long"), docs["text"]), run, "doc_id long, fp long")


def _near(one: np.ndarray, many: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(one ^ many) <= bits


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within so many bits."""
    rest, out = fps, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = _near(one, rest, bits)
            if near.any():
                queue += (found := rest[near]).tolist()
                queue = [np.uint64(x) for x in queue]
                out += [(int(one), int(x)) for x in found]
                rest = rest[~near]
    return out


def _variants(fps: DataFrame) -> DataFrame:
    """Each fingerprint under its 64 variants: segment, place of the bit left out, and what is left."""
    word = "shiftrightunsigned(fp, 32 * (i div 32)) & 4294967295L"
    key = f"shiftleft(cast(i as bigint), 32) | (({word}) & ~shiftleft(1L, i % 32))"
    return fps.select("fp", F.expr(f"explode(transform(sequence(0, 63), i -> {key}))").alias("key"))


def _runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in; links (hot false) and members of runs longer than a block (hot true: a is the key, b the
    fingerprint, block its place) out. Holds one batch and one block."""
    names = ["hot", "a", "b", "block"]

    def made(hot, a, b, block):
        cols = [pa.array(np.full(len(a), hot)), pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64)), pa.array(np.asarray(block, np.int64))]
        return pa.RecordBatch.from_arrays(cols, names)

    keys, fps, hot_key, seen = np.zeros(0, np.int64), np.zeros(0, np.uint64), None, 0
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        while hot_key is not None and len(keys):
            same = int(np.searchsorted(keys, hot_key, "right"))
            if same:
                yield made(True, np.full(same, hot_key, np.int64).view(np.uint64), fps[:same], (seen + np.arange(same)) // BLOCK)
            seen, keys, fps = seen + same, keys[same:], fps[same:]
            if len(keys):
                hot_key = None
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1], "left"))
        yield from _compared(keys[:last], fps[:last], bits, made)
        keys, fps = keys[last:], fps[last:]
        if len(keys) > BLOCK:
            hot_key, seen = keys[0], 0
            yield made(True, keys.view(np.uint64), fps, np.arange(len(keys)) // BLOCK)
            seen, keys, fps = len(keys), keys[:0], fps[:0]
    yield from _compared(keys, fps, bits, made)


def _compared(keys: np.ndarray, fps: np.ndarray, bits: int, made) -> Iterator[pa.RecordBatch]:
    """Whole runs: short ones all at once, by the distance between two places; long ones by their forest."""
    if len(keys) < 2:
        return
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of = np.repeat(sizes, sizes)
    for apart in range(1, min(8, int(sizes.max()))):
        at = np.flatnonzero((keys[apart:] == keys[:-apart]) & (size_of[apart:] <= 8))
        at = at[_near(fps[at], fps[at + apart], bits)]
        if len(at):
            yield made(False, fps[at], fps[at + apart], np.zeros(len(at)))
    for k in np.flatnonzero(sizes > 8):
        at, n = starts[k], sizes[k]
        if n > BLOCK:
            yield made(True, keys[at : at + n].view(np.uint64), fps[at : at + n], np.arange(n) // BLOCK)
        elif found := forest(fps[at : at + n], bits):
            a, b = np.array(found, np.uint64).T
            yield made(False, a, b, np.zeros(len(a)))


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints within so many bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one bit left out reach three bits")
    ready(fps.sparkSession)
    dealt = _variants(fps).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = materialise(dealt.mapInArrow(lambda x: _runs(x, bits), "hot boolean, a long, b long, block long"), "runs")
    hot = found.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"), "block")
    blocks = materialise(hot.groupBy("key").agg(F.max("block").alias("most")), "hot")
    pairs = hot.join(blocks, "key").select("key", "fp", F.col("block").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("other"))
    pairs = pairs.select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        tree = forest(np.unique(group["fp"].to_numpy().view(np.uint64)), bits)
        a, b = np.array(tree, np.uint64).reshape(-1, 2).T
        return pd.DataFrame({"a": a.view(np.int64) if len(a) else np.zeros(0, np.int64), "b": b.view(np.int64) if len(b) else np.zeros(0, np.int64)})

    far = pairs.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")
    return found.filter("not hot").select("a", "b").unionByName(far)


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of docs."""
    own = materialise(fingerprints(docs, size), "fingerprints")
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = star_components(links(distinct.select("fp"), bits), "simhash")
    members = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    members = materialise(members, "members")
    smallest = materialise(members.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    classes = materialise(members.join(smallest, "root").select("fp", "component_id"), "classes")
    return own.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, size: int = 3, bits: int = 3) -> DataFrame:
    """The rows of docs that stand for their component: those of the smallest id. Rows that repeat an id are one document,
    of which the text with the smallest hash stays. Rows with a null id all stay."""
    groups = near_duplicates(docs, size, bits)
    stays = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    own = carried(docs, id=F.col("doc_id").cast("long"), tie=F.xxhash64("text"))
    kept = own.join(stays.hint("shuffle_hash"), "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("id").orderBy("tie"))
    kept = kept.select("row", place.alias("place")).filter("place = 1").select("row")
    return kept.unionByName(own.filter("id is null").select("row")).select("row.*")
