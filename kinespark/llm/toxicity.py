"""Toxicity by a classifier chain.

The categories are predicted one after the other; each later linear model also gets the probabilities of the earlier
ones. In training those come from models that did not see the row (out of fold), so a later model learns how far an
earlier one can be trusted on new texts; in use they come from models fitted on all of the sample.

Features are the presence of each word and of each word's first four and six letters, hashed: stems count whatever their
endings, and a text's length doesn't. A model takes the features whose log-odds between the classes of its own training
rows stand ``SIGNIFICANT`` standard errors from zero, scaled by them, and fits a penalised logistic regression. It is fitted on a
bounded sample, ``SAMPLE`` labelled rows in expectation, chosen by hash of the id; that sample's hashed features go to the
driver. Every text is scored whole, on the executors.

Null and empty texts have no feature, so they get the base rate, and are not rejected. Labels that are null are not
learnt from; of several labels of an id the worse one counts, of its texts the smallest. A category with one value only is a constant. Without labels
every probability is 0. Ids that repeat or are null are scored like others; other columns are kept as they are by the
stage, whatever their names, and not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinespark.llm.common import fresh, map_arrow, ready, whole_text

SAMPLE, FOLDS, BITS, PENALTY, SIGNIFICANT, STEPS = 6_000, 3, 18, 2.0, 3.0, 60


def features(text: Column) -> Column:
    """Hashed words and stems of a text; a place may come twice."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != ""))

    def hashed(letters: int) -> Column:
        stem = lambda w: F.substring(w, 1, letters) if letters else w
        return F.transform(words, lambda w: F.pmod(F.xxhash64(F.lit(letters), stem(w)), F.lit(1 << BITS)).cast("int"))

    return F.concat(*map(hashed, (0, 4, 6)))


def _minimised(loss, x: np.ndarray, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps; loss gives value and gradient."""
    value, slope = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = slope.copy(), []
        for s, y in reversed(moves):
            a = s @ way / (s @ y)
            way -= a * y
            kept.append(a)
        if moves:
            s, y = moves[-1]
            way *= s @ y / (y @ y)
        for (s, y), a in zip(moves, reversed(kept), strict=True):
            way += (a - y @ way / (s @ y)) * s
        step = 1.0 if moves else 1.0 / max(1.0, np.abs(slope).sum())
        while step > 1e-10:
            after, after_slope = loss(x - step * way)
            if after <= value - 1e-4 * step * (way @ slope):
                break
            step /= 2
        else:
            break
        s, y = -step * way, after_slope - slope
        if s @ y > 1e-12:
            moves = [*moves[1 - memory :], (s, y)]
        done = value - after < 1e-9 * max(1.0, abs(value))
        x, value, slope = x + s, after, after_slope
        if done:
            break
    return x


class Linear:
    """Weights of hashed features and of earlier categories' probabilities; a constant where there is one class."""

    def __init__(self, rows: Rows, label: np.ndarray, earlier: np.ndarray):
        n, yes = len(label), label.sum()
        self.weights, self.more, self.base = np.zeros(1 << BITS), np.zeros(earlier.shape[1]), None
        self.share = yes / n if n else 0.0
        if not 0 < yes < n:
            return
        there, with_ = rows.column_sums(np.ones(n)), rows.column_sums(label)
        without = there - with_
        odds = np.log((with_ + 0.5) / (yes + 1)) - np.log((without + 0.5) / (n - yes + 1))
        odds[np.abs(odds) < SIGNIFICANT * np.sqrt(1 / (with_ + 0.5) + 1 / (without + 0.5))] = 0
        used = np.flatnonzero(odds)
        place = np.full(1 << BITS, -1)
        place[used] = np.arange(len(used))
        small = rows.only(place)

        def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
            w, more, base = x[: len(used)], x[len(used) : -1], x[-1]
            z = small.row_sums(w * odds[used]) + earlier @ more + base
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            value = np.logaddexp(0, z).sum() - label @ z + PENALTY * (w @ w) / 2 + 1e-3 * (more @ more)
            off = p - label
            return float(value), np.r_[small.column_sums(off, len(used)) * odds[used] + PENALTY * w, earlier.T @ off + 2e-3 * more, off.sum()]

        x = _minimised(loss, np.r_[np.zeros(len(used) + earlier.shape[1]), np.log(yes / (n - yes))])
        self.weights[used], self.more, self.base = x[: len(used)] * odds[used], x[len(used) : -1], float(x[-1])

    def probability(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        if self.base is None:
            return np.full(len(earlier), float(self.share))
        z = rows.row_sums(self.weights) + earlier @ self.more + self.base
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Rows:
    """Rows of hashed features, each place once."""

    def __init__(self, places: np.ndarray, offsets: np.ndarray):
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        keys = np.unique((row.astype(np.int64) << BITS) | places)
        self.n, self.row, self.place = len(offsets) - 1, keys >> BITS, keys & ((1 << BITS) - 1)

    @classmethod
    def of(cls, column: pa.ListArray, step: int = 500) -> Rows:
        """Some hundred rows at a time, so sorting takes little memory."""
        out, rows, places = object.__new__(cls), [], []
        for at in range(0, len(column), step):
            some = column.slice(at, step)
            one = cls(some.flatten().to_numpy().astype(np.int64), np.r_[0, np.cumsum(some.value_lengths().fill_null(0).to_numpy())])
            rows.append((one.row + at).astype(np.int32))
            places.append(one.place.astype(np.int32))
        out.n, out.row, out.place = len(column), np.concatenate(rows or [np.zeros(0, np.int32)]), np.concatenate(places or [np.zeros(0, np.int32)])
        return out

    def only(self, new_place: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        kept = new_place[self.place] >= 0
        out.n, out.row, out.place = self.n, self.row[kept], new_place[self.place[kept]]
        return out

    def take(self, mask: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        kept, number = mask[self.row], np.cumsum(mask) - 1
        out.n, out.row, out.place = int(mask.sum()), number[self.row[kept]], self.place[kept]
        return out

    def row_sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.place], self.n)

    def column_sums(self, of_rows: np.ndarray, size: int = 1 << BITS) -> np.ndarray:
        return np.bincount(self.place, of_rows[self.row], size)


class Chain:
    """One model for each category, in order."""

    def __init__(self, names: list[str]):
        self.names, self.models = names, []

    def fit(self, rows: Rows, labels: list[np.ndarray], fold: np.ndarray) -> Chain:
        earlier = np.zeros((rows.n, 0))
        for k, label in enumerate(labels):
            self.models.append(Linear(rows, label, earlier))
            if k + 1 < len(labels):
                out = np.zeros(rows.n)
                for f in range(FOLDS):
                    apart = fold == f
                    model = Linear(rows.take(~apart), label[~apart], earlier[~apart])
                    out[apart] = model.probability(rows.take(apart), earlier[apart])
                earlier = np.column_stack([earlier, out])
        return self

    def predict(self, rows: Rows) -> np.ndarray:
        """A column for each category."""
        out = np.zeros((rows.n, 0))
        for model in self.models:
            out = np.column_stack([out, model.probability(rows, out)])
        return out


CATEGORIES = ["low_quality", "toxic"]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fits the chain low quality, then toxic, on labelled documents."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).cast("double").alias("low_quality"), F.max("toxic").cast("double").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    own = own.groupBy("doc_id", *CATEGORIES).agg(F.min("text").alias("text"))  # a row for each id, however often it comes
    got = own.select(fold, *CATEGORIES, features(whole_text()).alias("places")).toArrow().combine_chunks()
    if not got.num_rows:
        return Chain([])
    rows = Rows.of(got["places"].combine_chunks())
    columns, fold = [got[c].to_numpy() for c in CATEGORIES], got["fold"].to_numpy()
    del got
    return Chain(CATEGORIES).fit(rows, columns, fold)


def _scored(batch: pa.RecordBatch, chain: Chain) -> list[np.ndarray]:
    column = batch.column(batch.num_columns - 1)
    if not chain.models or not batch.num_rows:
        return [np.zeros(batch.num_rows)] * len(CATEGORIES)
    return list(np.concatenate([chain.predict(Rows.of(column.slice(at, 500))) for at in range(0, batch.num_rows, 500)]).T)


def score(docs: DataFrame, chain: Chain, cut: float = 0.5) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic of each row."""
    state = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batch: pa.RecordBatch) -> dict:
        low, toxic = _scored(batch, state.value)
        return {"doc_id": batch.column(0), "p_low_quality": low, "p_toxic": toxic, "toxic": toxic >= cut}

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), features(whole_text()).alias("places"))
    return map_arrow(rows, run, "doc_id long, p_low_quality double, p_toxic double, toxic boolean")


def reject_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows of docs, as they were, that are not toxic."""
    ready(docs.sparkSession)
    state = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch, state.value)[1] < cut)).select(list(range(batch.num_columns - 1)))

    rows = docs.select("*", features(whole_text()).alias(fresh(docs, "places")))
    return rows.mapInArrow(run, T.StructType(docs.schema.fields))
