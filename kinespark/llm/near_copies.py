"""The near-dedup stage: SimHash links, and near copies that 64 bits can't reach.

Documents link if their SimHash fingerprints differ in three bits at most (``simhash``), or if the sets of their five-word
shingles have a Jaccard similarity of ``SIMILAR`` (4/5) or more, as SimHash tells such pairs only from about 0.97 up; groups
are the connected components of both. For the second, candidates share one of ``BANDS`` bands of ``DEPTH`` minima each: a pair of similarity
s is missed with probability (1 - s ** DEPTH) ** BANDS, 0.00003 at 0.8 and less above. Each candidate is verified on the
two texts, so nothing that is less similar links. First each text of a band's run is compared with one lead, whichever bands
they meet in; then, where a run is not one component yet, those outside of its largest with all others, in blocks of ``BLOCK``
on average. So a group of near copies of one text takes work in proportion to its size, and no link is lost where it isn't one.
Texts of the same words, and bands with the same texts in a run, count once.

Null text counts as empty, and texts without a word are copies of each other; a text of under five words is one shingle.
Of each group one row stays: that of the smallest id (null last), then of the smallest hash of the text. Other columns
are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm import simhash
from kinespark.llm.common import carried, map_arrow, materialise, words_of
from kinespark.llm.components import star_components

WORDS, SIMILAR, BANDS, DEPTH = 5, (4, 5), 20, 4
BLOCK, _COLUMNS, _WORDS_KEPT = 256, 8192, 1 << 19
_rng = np.random.default_rng(42)
_TIMES, _PLUS = _rng.integers(0, 2**64, (2, BANDS * DEPTH), np.uint64, endpoint=False) | np.array([[1], [0]], np.uint64)
_PLACES = _rng.integers(0, 2**64, max(WORDS, DEPTH), np.uint64, endpoint=False) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 42)
        return found


_HASHES = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, ascending."""
    sizes = np.array([len(words) for words in texts], np.int64)
    flat = np.fromiter((_HASHES[word] for words in texts for word in words), np.uint64, int(sizes.sum()))
    total = np.zeros(len(flat), np.uint64)
    for k in range(min(WORDS, len(flat))):
        total[: len(flat) - k] += flat[k:] * _PLACES[k]
    total, out = _mixed(total), []
    for end, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
        if n < WORDS:
            short = flat[end - n : end] * _PLACES[:n]
            out.append(_mixed(short.sum(keepdims=True) + np.uint64(n)) if n else flat[:0])
        else:
            out.append(np.unique(total[end - n : end - WORDS + 1]))
    return out


def bands(each: list[np.ndarray]) -> np.ndarray:
    """The keys of the bands of each set, none of them empty, as rows of longs."""
    flat, starts = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
    out = np.zeros((len(each), BANDS), np.uint64)
    for k in range(BANDS * DEPTH):
        least = np.minimum.reduceat(flat * _TIMES[k] + _PLUS[k], starts)
        out[:, k // DEPTH] = _mixed(out[:, k // DEPTH] + least * _PLACES[k % DEPTH] + np.uint64(k // DEPTH))
    return out.view(np.int64)


def _alike(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return both * SIMILAR[1] >= (a + b - both) * SIMILAR[0]


def common(each: list[np.ndarray]) -> np.ndarray:
    """How many hashes any two of the sets share."""
    if len(each) == 2:
        out = np.diag([len(each[0]), len(each[1])])
        out[0, 1] = out[1, 0] = len(np.intersect1d(*each, assume_unique=True))
        return out
    values, place, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(each)), [*map(len, each)])
    order = np.argsort(place, kind="stable")
    order = order[n[place[order]] > 1]
    # columns are numbered anew without the hashes that only one set has
    row, column = row[order], (np.cumsum(n > 1) - 1)[place[order]]
    out = np.zeros((len(each), len(each)), np.float64)
    for at in range(0, int((n > 1).sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + _COLUMNS])
        held = np.zeros((len(each), int(column[hi - 1]) - at + 1), np.float32)
        held[row[lo:hi], column[lo:hi] - at] = 1
        out += held @ held.T
    np.fill_diagonal(out, [*map(len, each)])
    return out.astype(np.int64)


def forest(each: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets that are similar."""
    n = np.array([*map(len, each)], np.int64)
    linked, rest, out = _alike(common(each), n[:, None], n[None, :]), np.ones(len(each), bool), []
    for start in range(len(each)):
        queue = [start] if rest[start] else []
        rest[start] = False
        while queue:
            one = queue.pop()
            found = np.flatnonzero(linked[one] & rest).tolist()
            rest[found] = False
            queue += found
            out += [(one, x) for x in found]
    return out


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def runs_of(distinct: DataFrame) -> DataFrame:
    """(key, words_key, n, lead): the members of each band's run of two or more, and the one among them whose runs are the
    largest together, as it is the likeliest to be near most others."""
    dealt = distinct.select("words_key", F.explode("bands").alias("key"))
    runs = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("words_key").alias("lo"), F.max("words_key").alias("hi"), F.bit_xor(F.xxhash64("words_key")).alias("all"))
    # bands whose runs have the same members count once
    runs = materialise(runs.filter("n > 1").groupBy("n", "lo", "hi", "all").agg(F.min("key").alias("key")).select("key", "n"), "runs")
    members = materialise(dealt.join(runs, "key").select("key", "words_key", "n"), "members")
    weights = materialise(members.groupBy("words_key").agg(F.sum("n").alias("weight")), "weights")
    leads = members.join(weights, "words_key").groupBy("key").agg(F.max(F.struct("weight", "words_key"))["words_key"].alias("lead"))
    return materialise(members.join(materialise(leads, "leads"), "key").select("key", "words_key", "n", "lead"), "led")


def texts_of(docs: DataFrame, distinct: DataFrame, led: DataFrame) -> DataFrame:
    """(words_key, text) of each text in a run, read from the one row that stands for it."""
    wanted = led.select("words_key").distinct().join(distinct.select("words_key", "best"), "words_key")
    wanted = wanted.select("words_key", F.col("best.doc_id").alias("_id"), F.col("best.text_key").alias("_key"))
    own = _known(docs)
    texts = own.join(wanted.hint("shuffle_hash"), own["doc_id"].eqNullSafe(F.col("_id")) & (own["text_key"] == F.col("_key"))).select("words_key", "text")
    return materialise(texts.dropDuplicates(["words_key"]), "texts")


def lead_links(led: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): leads, and the members of their runs that are similar to them. What meets in several bands is compared once;
    a lead's members are dealt in blocks, each with the lead's text."""
    pairs = materialise(led.filter("words_key <> lead").select("lead", "words_key").distinct(), "pairs")
    sizes = materialise(pairs.groupBy("lead").agg(F.expr(f"count(*) div {BLOCK}").alias("most")), "sizes")
    dealt = pairs.join(sizes, "lead").select("lead", "words_key", F.expr("pmod(xxhash64(words_key, 1), most + 1)").alias("block"))
    own = sizes.select("lead", F.col("lead").alias("words_key"), F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("block"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids, leads = group["words_key"].to_numpy(), group["lead"].to_numpy()
        each = shingles([words_of(t) for t in group["text"]])
        lead = each[int(np.flatnonzero(ids == leads)[0])]
        both = np.array([np.isin(x, lead, assume_unique=True).sum() for x in each], np.int64)
        near = _alike(both, np.array([*map(len, each)], np.int64), np.int64(len(lead))) & (ids != leads)
        return pd.DataFrame({"a": leads[near], "b": ids[near]})

    return dealt.unionByName(own).join(texts, "words_key").groupBy("lead", "block").applyInPandas(compare, "a long, b long")


def rest_links(led: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): what the links up to roots (node, root) leave open. In each run, members outside of its largest component are
    compared with all others, in blocks on both sides; two members of the largest are linked as it is."""
    rooted = led.filter("n > 2").join(roots.withColumnRenamed("node", "words_key"), "words_key", "left").select("key", "words_key", F.coalesce("root", "words_key").alias("root"))
    rooted = materialise(rooted, "rooted-runs")
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("n"))
    parts = parts.filter("n > main.size").select("key", "main.root", F.expr(f"n div {BLOCK}").alias("rows"), F.expr(f"(n - main.size) div {BLOCK}").alias("columns"))
    opened = rooted.join(materialise(parts.withColumnRenamed("root", "main"), "open"), "key")
    every = opened.select("key", "words_key", F.expr("pmod(xxhash64(words_key, 1), rows + 1)").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), "columns")).alias("j"))
    rest = opened.filter("root <> main").select("key", "words_key", F.explode(F.sequence(F.lit(0).cast("long"), "rows")).alias("i"), F.expr("pmod(xxhash64(words_key, 2), columns + 1)").alias("j"))
    blocks = materialise(every.unionByName(rest).distinct(), "blocks")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["words_key"].to_numpy()
        found = np.array(forest(shingles([words_of(t) for t in group["text"]])), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    return blocks.join(texts, "words_key").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def components(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(node, root) of the groups of texts that SimHash or a verified candidate links."""
    led = runs_of(distinct)
    texts = texts_of(docs, distinct, led)
    first = star_components(lead_links(led, texts).unionByName(simhash_links(distinct)), "near")
    return star_components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest_links(led, texts, first)), "groups")


def simhash_links(distinct: DataFrame) -> DataFrame:
    """(a, b): texts whose fingerprints are within three bits; the first of each fingerprint stands for the others."""
    fps = materialise(distinct.select("words_key", "fp"), "fingerprints")
    first = materialise(fps.groupBy("fp").agg(F.min("words_key").alias("first")), "first")
    linked = materialise(simhash.links(first.select("fp")), "simhash")
    side = lambda name: first.select(F.col("fp").alias(f"{name}_fp"), F.col("first").alias(name))
    linked = linked.select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp")).join(side("a"), "a_fp").join(side("b"), "b_fp").select("a", "b")
    return linked.unionByName(fps.join(first, "fp").filter("words_key <> first").select(F.col("words_key").alias("a"), F.col("first").alias("b")))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their group of near copies, one each."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [words_of(t.as_py()) for t in batch.column(2)]
        keys = np.fromiter((xxhash.xxh64_intdigest(b" ".join(t)) for t in texts), np.uint64, len(texts))
        fps = np.fromiter(map(simhash.fingerprint, texts), np.uint64, len(texts))
        some = [k for k, t in enumerate(texts) if t]
        found: list = [[]] * len(texts)
        if some:
            for k, row in zip(some, bands(shingles([texts[k] for k in some])).tolist(), strict=True):
                found[k] = row
        return {"doc_id": batch.column(0), "text_key": batch.column(1), "words_key": keys.view(np.int64), "fp": fps.view(np.int64), "bands": found}

    own = materialise(map_arrow(_known(docs), run, "doc_id long, text_key long, words_key long, fp long, bands array<long>"), "bands")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best")
    distinct = materialise(own.groupBy("words_key").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
    roots = components(docs, distinct)
    groups = distinct.join(roots.withColumnRenamed("node", "words_key"), "words_key", "left").groupBy(F.coalesce("root", "words_key").alias("root")).agg(F.min("best").alias("best"))
    return rows_of(docs, groups.select(F.col("best.doc_id").alias("id"), F.col("best.text_key").alias("key")))


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of docs for each (id, key) that is chosen."""
    chosen = materialise(chosen.select(F.col("id").alias("chosen_id"), F.col("key").alias("chosen_key")), "chosen")
    own = carried(docs, id=F.col("doc_id").cast("long"), key=F.xxhash64("text"), tie=F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = own.join(chosen.hint("shuffle_hash"), own["id"].eqNullSafe(chosen["chosen_id"]) & (own["key"] == chosen["chosen_key"]), "left_semi")
    place = F.row_number().over(Window.partitionBy("id", "key").orderBy("tie"))
    return kept.select("row", place.alias("place")).filter("place = 1").select("row.*")
