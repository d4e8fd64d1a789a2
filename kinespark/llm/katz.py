"""LM scoring by a Katz n-gram model with Good-Turing discounts and exactly normalised backoff weights.

Texts become blocks: the ids of up to ``BLOCK`` tokens and the sorted 64-bit hashes of their words. A block asks the
corpus about its own distinct n-grams and contexts; each question goes to the range of the hash it falls in, where all
blocks' counts meet, and the answer comes back in the order asked. So no task sees the whole model, a word that is in every
text counts once for a block, and what is sent grows with the corpus. The exchanges make the model:

1. counts, one exchange for each order: r of each n-gram in the training texts, and how many n-grams have each count; the
   first block that holds an n-gram also speaks for it below;
2. contexts, one for each order from two on: the sums of d(r) r and of the lower order's P over a context's followers,
   which give its backoff weight.

The counts of each order are a table, partitioned by ranges of the n-gram's hash (``ngrams`` reads it).

P1(w) = d(c) c / N, and what the discounts free is the probability of the one unknown word, so P1 adds up to one over
V known words and one unknown. P(w | h) = d(r) r / c(h) for an n-gram of the training texts, else a(h) P(w | h less its
first word), and so on down to P1, with a(h) = (1 - sum of d(r) r / c(h)) / (1 - sum of the lower P over h's followers); a
context that was never seen has a(h) = 1. A text's first word has the text's beginning as its context, and longer contexts
begin there. A context whose followers all have counts over K frees nothing; it counts as seen once more, which leaves
1 / (c(h) + 1). Counts over ``K`` are not discounted. Where the counts of counts give no sound Good-Turing discount for each
r up to K, they are smoothed by a line in logarithms; where that has none either (tiny inputs), the discount is absolute.

Words and n-grams are known by their 64-bit hashes. Null text is empty and has one token, its end. A null id is a training
text. Repeated rows count each time and get equal scores. Without training texts every token has probability one. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.taskcontext import TaskContext

from kinespark.llm.common import id_bucket, materialise, ready, words_of

BLOCK, KEYS, K, ORDER = 2_000_000, 1_000_000, 5, 2
#: Neither can be a word: words hold no line feed.
END, START = b"\n end", b"\n start"
_BLOCKS = "block long, docs array<long>, held array<boolean>, sizes array<int>, words binary, tokens binary, grams array<long>"
_ASKED = "part int, block long, keys binary, counts binary, extra binary"
#: kind: the order of counts, or of contexts with _CONTEXT added; a row without a block is a range's table, extra its keys.
_ANSWER = "kind int, block long, part int, counts binary, extra binary, stats array<long>"
_CONTEXT = 100


def _packed(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones, and so on: sorted hashes and small counts shrink that way."""
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 3)


def _unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _pack(block: int, docs: list, held: list, ends: list[int], index: dict[bytes, int], tokens: list[np.ndarray], order: int) -> dict:
    hashes = _hashes([*index])
    by = np.argsort(hashes)
    rank = np.empty(len(by), np.uint32)
    rank[by] = np.arange(len(by), dtype=np.uint32)
    ids = rank[np.concatenate(tokens)]
    row = {"block": block, "docs": docs, "held": held, "sizes": ends, "words": _packed(hashes[by]), "tokens": zstandard.compress(ids.tobytes(), 3)}
    row["grams"] = [len(g.keys) for g in Block(row, order).grams]
    return row


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, order: int) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    docs, held, sizes, index, tokens, total = [], [], [], {}, [], 0

    def full() -> pa.RecordBatch:
        row = _pack((part << 32) + number, docs, held, sizes, index, tokens, order)
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        for doc, out, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not total:
                index = {START: 0, END: 1}
            words = [*words_of(text), END]
            tokens.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
            docs.append(doc)
            held.append(out)
            sizes.append(len(words))
            total += len(words)
            if total >= BLOCK:
                yield full()
                number, total, docs, held, sizes, tokens = number + 1, 0, [], [], [], []
    if docs:
        yield full()


class Grams:
    """The distinct n-grams of a block in order of their hash: places of the prefix and the suffix among those of the order
    below, the last word, and for each token the n-gram that ends there (-1: none)."""

    def __init__(self, keys: np.ndarray, prefix: np.ndarray | None, suffix: np.ndarray | None, last: np.ndarray, at: np.ndarray):
        self.keys, self.prefix, self.suffix, self.last, self.at = keys, prefix, suffix, last, at

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How many of the tokens that are marked end each n-gram."""
        own = self.at[of]
        return np.bincount(own[own >= 0], minlength=len(self.keys)).astype(np.uint32)


class Block:
    """What a block row says: tokens, where documents begin, and the n-grams of each order up to one."""

    def __init__(self, row, order: int):
        words = _unpacked(row["words"], np.uint64)
        self.tokens = np.frombuffer(zstandard.decompress(row["tokens"]), np.uint32).astype(np.int64)
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.train = np.repeat(~np.asarray(row["held"], bool), self.sizes)
        self.start, self.end = (int(np.searchsorted(words, np.uint64(xxhash.xxh64_intdigest(w)))) for w in (START, END))
        self.grams = [Grams(words, None, None, np.arange(len(words)), self.tokens)]
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)
        for n in range(2, order + 1):
            self.grams.append(self._longer(self.grams[-1], n, place))

    def _longer(self, below: Grams, n: int, place: np.ndarray) -> Grams:
        there = np.flatnonzero(place >= n - 2)
        before = np.where(place[there] > 0, below.at[there - 1], self.start)
        words = self.grams[0].keys
        both, first, number = np.unique(before * len(words) + self.tokens[there], return_index=True, return_inverse=True)
        prefix, last = both // len(words), both % len(words)
        mixed = (below.keys[prefix] ^ (words[last] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xD6E8FEB86659FD93)
        for _ in range(2):
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        by = np.argsort(mixed)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        at = np.full(len(self.tokens), -1)
        at[there] = rank[number]
        return Grams(mixed[by], prefix[by], below.at[there[first]][by], last[by], at)


def _ask(block: int, keys: np.ndarray, counts: np.ndarray, extra: np.ndarray | None, parts: int) -> Iterator[dict]:
    """One question for each range of hashes."""
    edges = np.r_[0, np.searchsorted(keys, (np.arange(1, parts, dtype=object) * (2**64) // parts).astype(np.uint64)), len(keys)]
    for p in np.flatnonzero(np.diff(edges)):
        own = slice(edges[p], edges[p + 1])
        yield {"part": int(p), "block": block, "keys": _packed(keys[own]), "counts": _packed(counts[own]), "extra": _packed(extra[own]) if extra is not None else b""}


def _questions(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in frames:
            for row in some.to_dict("records"):
                b = Block(row, order)
                g = b.grams[-1]
                yield pd.DataFrame([*_ask(row["block"], g.keys, g.counts(b.train), None, parts)], columns=["part", "block", "keys", "counts", "extra"])

    return blocks.mapInPandas(run, _ASKED)


def _answers(asked: DataFrame, kind: int, parts: int) -> DataFrame:
    """Adds up what all blocks say of a key, exactly up to 2^53; each block gets the sum (64 bits) for each of its keys, and whether it is the first to
    hold it. One row of each range is its table, with the counts of counts: keys with count 1 to K+1, all keys, the sum."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        keys = [_unpacked(x, np.uint64) for x in group["keys"]]
        every, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        sums = np.bincount(place, np.concatenate([_unpacked(x, np.uint32) for x in group["counts"]])).astype(np.int64)
        mine = np.zeros(len(place), bool)
        mine[first] = True
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        out = pd.DataFrame({"kind": kind, "block": pd.array([*group["block"], None], "Int64"), "part": int(group["part"].iloc[0])})
        seen = sums > 0
        out["counts"] = [*(_packed(x) for x in np.split(sums[place].astype(np.uint64), cuts)), _packed(sums[seen].astype(np.uint64))]
        out["extra"] = [*(np.packbits(x).tobytes() for x in np.split(mine, cuts)), _packed(every[seen])]
        stats = [*np.bincount(np.minimum(sums, K + 2), minlength=K + 3)[1 : K + 2], seen.sum(), sums.sum()]
        out["stats"] = [*[None] * (len(out) - 1), list(map(int, stats))]
        return out

    return asked.repartition(parts, "part").groupBy("part").applyInPandas(run, _ANSWER)


def _sums(asked: DataFrame, kind: int, parts: int) -> DataFrame:
    """Adds up both sums of each context."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        keys = [_unpacked(x, np.uint64) for x in group["keys"]]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        out = pd.DataFrame({"kind": kind, "block": group["block"].to_numpy(), "part": group["part"].to_numpy()})
        for name in ("counts", "extra"):
            total = np.bincount(place, np.concatenate([_unpacked(x, np.float64) for x in group[name]]))
            out[name] = [_packed(x) for x in np.split(total[place], cuts)]
        out["stats"] = None
        return out

    return asked.repartition(parts, "part").groupBy("part").applyInPandas(run, _ANSWER)


class Discount:
    """d(r) by Good-Turing for r up to K, from the counts of counts."""

    def __init__(self, stats: np.ndarray):
        n = [0.0, *map(float, stats[: K + 1])]
        self.n, self.keys, self.total = n, int(stats[K + 1]), int(stats[K + 2])
        self.by, self.flat = np.ones(K + 1), 0.0
        for counts in (n, self._smoothed(n)):
            if all(counts[1:]) and (most := (K + 1) * counts[K + 1] / counts[1]) != 1:
                by = [((r + 1) * counts[r + 1] / (r * counts[r]) - most) / (1 - most) for r in range(1, K + 1)]
                if all(0 < d < 1 for d in by):
                    self.by = np.array([1.0, *by])
                    return
        self.flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5

    @staticmethod
    def _smoothed(n: list[float]) -> list[float]:
        """Counts of counts on a straight line in logarithms, as copies of documents make the raw ones uneven."""
        there = [r for r in range(1, K + 2) if n[r]]
        if len(there) < 2:
            return [0.0] * (K + 2)
        slope, level = np.polyfit(np.log(there), np.log([n[r] for r in there]), 1)
        return [0.0, *np.exp(level + slope * np.log(np.arange(1, K + 2)))]

    def kept(self, r: np.ndarray) -> np.ndarray:
        """d(r) r."""
        r = r.astype(np.float64)
        if self.flat:
            return np.where(r > 0, r - self.flat, 0.0)
        return r * np.where(r <= K, self.by[np.minimum(r, K).astype(np.int64)], 1.0)

    def freed(self) -> float:
        """The sum of (1 - d(r)) r over all keys."""
        if self.flat:
            return self.flat * self.keys
        return float(sum(self.n[r] * r * (1 - self.by[r]) for r in range(1, K + 1)))


class Model:
    """The discounts of each order."""

    def __init__(self, discounts: list[Discount]):
        self.discounts, self.words = discounts, discounts[0]
        self.unknown = self.words.freed() / self.words.total if self.words.total else 1.0

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.words.kept(c) / max(1, self.words.total), self.unknown)


class Told:
    """What a block knows of its n-grams from the answers, and what follows."""

    def __init__(self, row, answers: pd.DataFrame, model: Model, order: int):
        self.block, self.model, self.answers = Block(row, order), model, answers
        self.counts = [self._joined(n, "counts", np.uint64) for n in range(1, order + 1)]

    def _joined(self, kind: int, name: str, dtype) -> np.ndarray:
        own = self.answers[self.answers["kind"] == kind].sort_values("part")
        return np.concatenate([_unpacked(x, dtype) for x in own[name]])

    def first(self, n: int) -> np.ndarray:
        """Whether this block is the first to hold each n-gram."""
        own = self.answers[self.answers["kind"] == n].sort_values("part")
        return np.concatenate([np.unpackbits(np.frombuffer(e, np.uint8), count=len(_unpacked(x, np.uint64))).astype(bool) for x, e in zip(own["counts"], own["extra"], strict=True)])

    def context_counts(self, n: int) -> np.ndarray:
        """How often each context of the order n is followed by a token; what ends a text isn't."""
        g, c = self.block.grams[n - 2], self.counts[n - 2].astype(np.float64)
        if n == 2:
            c[self.block.start] = c[self.block.end]
        c[g.last == self.block.end] = 0
        return c

    def likely(self, n: int) -> np.ndarray:
        """P of each n-gram's last word after the others, by recursion to the orders below."""
        if n == 1:
            return self.model.unigram(self.counts[0])
        g, r, context = self.block.grams[n - 1], self.counts[n - 1], self.context_counts(n)
        kept, p = self._joined(_CONTEXT + n, "counts", np.float64), self._joined(_CONTEXT + n, "extra", np.float64)
        seen = context > 0
        context = np.where(seen & (kept >= context * (1 - 1e-12)), context + 1, context)
        back = np.where(seen, (1 - kept / np.where(seen, context, 1)) / np.where(seen, np.maximum(1 - p, 1e-300), 1), 1.0)
        of = g.prefix
        return np.where(r > 0, self.model.discounts[n - 1].kept(r) / np.where(seen[of], context[of], 1), back[of] * self.likely(n - 1)[g.suffix])


def _dealt(frame: DataFrame, blocks: int):
    return frame.repartition(blocks, "block").groupBy("block")


def _contexts(blocks: DataFrame, answers: DataFrame, model: Model, n: int, parts: int, many: int) -> DataFrame:
    def run(one: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = one.to_dict("records")[0]
        know = Told(row, told, model, n)
        g, r, below = know.block.grams[n - 1], know.counts[n - 1], know.block.grams[n - 2]
        at = np.flatnonzero(know.first(n) & (r > 0))
        kept = np.bincount(g.prefix[at], model.discounts[n - 1].kept(r[at]), len(below.keys))
        p = np.bincount(g.prefix[at], know.likely(n - 1)[g.suffix[at]], len(below.keys))
        return pd.DataFrame([*_ask(row["block"], below.keys, kept, p, parts)], columns=["part", "block", "keys", "counts", "extra"])

    return _dealt(blocks, many).cogroup(_dealt(answers, many)).applyInPandas(run, _ASKED)


def _scores(blocks: DataFrame, answers: DataFrame, model: Model, order: int, many: int) -> DataFrame:
    def run(one: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = one.to_dict("records")[0]
        know = Told(row, told, model, order)
        b, c = know.block, know.counts[0]
        likely = np.zeros(len(b.tokens))
        for n in range(1, order + 1):  # the longest that ends at each token
            at = b.grams[n - 1].at
            if n == order or (b.grams[n].at < 0).any():
                likely = np.where(at >= 0, know.likely(n)[at], likely)
        total, kinds = model.words.total, model.words.keys
        base = np.log10((c.astype(np.float64) + 1) / (total + kinds + 1))
        sum_of = lambda x: np.add.reduceat(x, b.starts)
        return pd.DataFrame({
            "doc_id": pd.array([None if x is None or x != x else int(x) for x in row["docs"]], "Int64"), "held_out": np.asarray(row["held"], bool), "n_tokens": b.sizes,
            "n_known": sum_of((c[b.tokens] > 0).astype(np.int64)), "train_tokens": total, "base_score": sum_of(base[b.tokens]), "score": sum_of(np.log10(np.maximum(likely, 1e-300))),
        })

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _dealt(blocks, many).cogroup(_dealt(answers, many)).applyInPandas(run, out)


def _discount(answers: DataFrame) -> Discount:
    each = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(K + 3)]
    return Discount(np.array([x or 0 for x in answers.filter("stats is not null").agg(*each).first()]))


def ngrams(counted: DataFrame) -> DataFrame:
    """(gram, count): the n-gram table of one order from the rows of its exchange; gram is the hash as a long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in frames:
            for keys, counts in zip(some["extra"], some["counts"], strict=True):
                yield pd.DataFrame({"gram": _unpacked(keys, np.uint64).view(np.int64), "n": _unpacked(counts, np.uint64).astype(np.int64)})

    return counted.filter("block is null").select("extra", "counts").mapInPandas(run, "gram long, n long").withColumnRenamed("n", "count")


def counted_blocks(docs: DataFrame, order: int, modulus: int, held_out: int) -> tuple[DataFrame, list[DataFrame], list[int], int]:
    """Blocks, the answers to their counts by order, the number of ranges by order, and that of blocks."""
    spark = docs.sparkSession
    ready(spark)
    schema = to_arrow_schema(T._parse_datatype_string(_BLOCKS))
    held = F.coalesce(id_bucket(modulus) == held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), "text")
    blocks = materialise(rows.mapInArrow(lambda x: _blocks(x, schema, order), _BLOCKS), "blocks")
    many, *sizes = (x or 0 for x in blocks.agg(F.count("*"), *[F.sum(F.col("grams")[n]) for n in range(order)]).first())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [max(least, -(-n // KEYS)) for n in sizes]
    counted = [materialise(_answers(_questions(blocks, n, parts[n - 1]), n, parts[n - 1]), f"grams-{n}") for n in range(1, order + 1)]
    return blocks, counted, parts, max(1, many)


def score_documents(docs: DataFrame, modulus: int = 7, held_out: int = 2, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; learns from the rest."""
    blocks, counted, parts, many = counted_blocks(docs, order, modulus, held_out)
    model = Model([*map(_discount, counted)])
    answers = reduce(DataFrame.unionByName, [c.filter("block is not null") for c in counted]).drop("stats")
    for n in range(2, order + 1):
        told = answers.filter((F.col("kind") <= n) | (F.col("kind") > _CONTEXT))
        contexts = materialise(_sums(_contexts(blocks, told, model, n, parts[n - 2], many), _CONTEXT + n, parts[n - 2]), "contexts")
        answers = answers.unionByName(contexts.drop("stats"))
    return _scores(blocks, answers, model, order, many)
