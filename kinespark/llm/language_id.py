"""Language id by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. Words are runs of letters,
in lower case, with the vocabulary's mark before them. The probabilities come from expectation maximisation: expected
counts of pieces over all segmentations (forward and backward), added up by Spark, from a bounded sample of the labelled
texts, ``SAMPLE`` documents of a language in expectation, chosen by hash of the id; of those, words of any length count.
Every text is predicted whole. The driver and each worker hold one number for each language and piece (0.26 MB a language).

The prediction is the language of the highest probability, of equal ones the first by code point; the score is its
posterior with equal priors. A text that is null or has no letter is ``und`` with score 0, and so is every text where
nothing could be learnt. Letters that no piece has get the probability of an unknown piece. Ids that repeat or are null
are predicted like others, and a null id is not learnt from; other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm.bpe import Lookup, vocabulary_path
from kinespark.llm.common import id_bucket, map_arrow, materialise

SAMPLE, ROUNDS, SMOOTH = 800, 3, 0.01
MEMO, WORD, TEXTS = 600_000, 24, 256
#: Fixed value: the mark that the vocabulary file puts before words.
MARK = "▁"


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Pieces that are text, numbered; the next number stands for a letter that none has."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: k for k, p in enumerate(dict.fromkeys(model.id_to_piece(i) for i in own))}


class Lattice:
    """The pieces that fit at each place of a word."""

    def __init__(self, known: dict[str, int]):
        self.known, self.longest, self.unknown = known, max(map(len, known)), len(known)

    def arcs(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end, (start, piece)."""
        get, out = self.known.get, []
        for end in range(1, len(word) + 1):
            own = [(start, k) for start in range(max(0, end - self.longest), end) if (k := get(word[start:end])) is not None]
            if not own or own[-1][0] < end - 1:
                own.append((end - 1, self.unknown))
            out.append(own)
        return out


def _forward(arcs: list[list[tuple[int, int]]], p: list[float]) -> list[float]:
    """The log of the probability up to each place; the last is that of the whole word."""
    logs = [0.0]
    for own in arcs:
        top = max(logs[start] for start, _ in own)
        logs.append(top + math.log(sum(math.exp(max(logs[start] - top, -690.0)) * p[k] for start, k in own)))
    return logs


def expected_counts(lattice: Lattice, word: str, p: list[float]) -> list[tuple[int, float]]:
    """How often each piece is expected in the word, whatever its length. An arc's share is the probability that the last
    piece before its end is this one; read from the end, it passes on to its start how likely a cut is there."""
    arcs = lattice.arcs(word)
    logs = _forward(arcs, p)
    cut, out = [0.0] * len(arcs) + [1.0], []
    for end in range(len(arcs), 0, -1):
        for start, k in arcs[end - 1]:
            n = cut[end] * p[k] * math.exp(min(logs[start] - logs[end], 690.0))
            cut[start] += n
            out.append((k, n))
    return out


class LanguageModel:
    """Languages in order of code points, and the probability of each piece in each of them."""

    def __init__(self, languages: list[str], table: np.ndarray, path: str):
        self.languages, self.table, self.path, self.uid = languages, table, path, uuid.uuid4().hex


def _letters(text: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in text).split()


def words(text: str) -> list[str]:
    """Runs of letters, in lower case: the same in training and in use."""
    return _letters(text.lower())


def counted_words(texts: DataFrame) -> DataFrame:
    """(lang, word, n) from (lang, text): each batch adds up its own words before they move."""

    def count(batch: pa.RecordBatch) -> dict:
        n: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n.update((lang, w) for w in words(text))
        return {"lang": [k[0] for k in n], "word": [k[1] for k in n], "n": [*n.values()]}

    return map_arrow(texts, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> LanguageModel:
    """docs: doc_id, text, lang; rows without a language or a text say nothing."""
    spark = docs.sparkSession
    known = docs.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: x.encode())
    if not languages:
        return LanguageModel([], np.zeros((0, 0)), path)
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(min(1.0, sample / sizes[lang]) * (1 << 30)))])[F.col("lang")]
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < rate)
    counts = materialise(counted_words(picked.select("lang", "text")).repartition("word"), "words")

    vocabulary = pieces(path)
    table = np.full((len(languages), len(vocabulary) + 1), 1.0)
    table *= np.exp(-0.5 * np.array([*(len(p) for p in vocabulary), 8]))  # long pieces begin rarer
    table /= table.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((languages, table))

        def expect(batch: pa.RecordBatch) -> dict:
            names, now = state.value
            lattice, place = Lattice(pieces(path)), {x: i for i, x in enumerate(names)}
            rows, sums = now.tolist(), np.zeros_like(now)
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                i = place[lang]
                for k, x in expected_counts(lattice, MARK + word, rows[i]):
                    sums[i, k] += n * x
            at = np.nonzero(sums)
            return {"language": at[0].astype(np.int32), "piece": at[1].astype(np.int32), "n": sums[at]}

        told = map_arrow(counts, expect, "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).toPandas()
        table = np.full_like(table, SMOOTH)
        table[told["language"].to_numpy(), told["piece"].to_numpy()] += told["n"].to_numpy()
        table /= table.sum(axis=1, keepdims=True)
        state.unpersist()
    return LanguageModel(languages, table, path)


class Batch:
    """The forward algorithm for many words and all languages at once, place by place."""

    FACTOR = np.uint64(0x5851F42D4C957F2D)

    def __init__(self, model: LanguageModel):
        self.known, self.p = pieces(model.path), model.table
        self.longest, self.unknown, self.found = max(map(len, self.known)), len(self.known), Lookup(17)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(WORD + 2, self.FACTOR)], dtype=np.uint64)
            self.found.put(np.array([self._hash(x) for x in self.known], np.uint64), [*self.known.values()])

    def _hash(self, piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(self.FACTOR) + ord(c) + 1) & (2**64 - 1)
        return np.uint64(h)

    def logs(self, words: list[str]) -> np.ndarray:
        """A row of log probabilities for each word of WORD letters at most, mark included."""
        out = np.zeros((len(words), len(self.p)))
        order = np.array(sorted(range(len(words)), key=lambda i: -len(words[i])), np.int64)
        for at in range(0, len(order), 1 << 13):
            some = order[at : at + (1 << 13)]
            out[some] = self._sorted([words[i] for i in some])
        return out

    def _sorted(self, words: list[str]) -> np.ndarray:
        sizes = np.array([*map(len, words)])
        most, n = int(sizes[0]), len(words)
        text = np.frombuffer("".join(w.ljust(most, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, most).astype(np.uint64) + np.uint64(1)
        prefix, alpha = np.zeros((most + 1, n), np.uint64), np.zeros((most + 1, len(self.p), n))
        alpha[0] = 1
        for i in range(most):
            prefix[i + 1] = prefix[i] * self.FACTOR + text[:, i]
        for end in range(1, most + 1):
            open_ = int(np.searchsorted(-sizes, -end, "right"))
            for start in range(max(0, end - self.longest), end):
                piece = self.found.get(prefix[end][:open_] - prefix[start][:open_] * self.powers[end - start])
                if start == end - 1:
                    piece[piece < 0] = self.unknown
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    alpha[end][:, hit] += alpha[start][:, hit] * self.p[:, piece[hit]]
        return np.log(alpha[sizes, :, np.arange(n)])


class _Words:
    """Rows of log probabilities, and of how many words they stand for: one for each word met and each token of several
    words. Emptied when full."""

    def __init__(self, model: LanguageModel):
        self.lattice, self.p, self.batch = Lattice(pieces(model.path)), model.table.tolist(), Batch(model)
        self._empty()

    def _empty(self) -> None:
        self.tokens: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.rows, self.size = np.zeros((4096, len(self.p) + 1)), 1

    def _add(self, rows: np.ndarray) -> range:
        while self.size + len(rows) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.size : self.size + len(rows)] = rows
        self.size += len(rows)
        return range(self.size - len(rows), self.size)

    def _learn(self, tokens: set[str]) -> None:
        cut = {t: [t] if t.isalpha() else _letters(t) for t in tokens}
        new = [*{w for own in cut.values() for w in own if w not in self.words}]
        logs = np.ones((len(new), len(self.p) + 1))
        short = [i for i, w in enumerate(new) if len(w) < WORD]
        if short:
            logs[short, :-1] = self.batch.logs([MARK + new[i] for i in short])
        for i, w in enumerate(new):
            if len(w) >= WORD:
                logs[i, :-1] = [_forward(self.lattice.arcs(MARK + w), p)[-1] for p in self.p]
        if new:
            self.words.update(zip(new, self._add(logs), strict=True))
        for token, own in cut.items():
            if len(own) < 2:
                self.tokens[token] = self.words[own[0]] if own else 0
            else:
                self.tokens[token] = self._add(self.rows[[self.words[w] for w in own]].sum(axis=0)[None, :])[0]

    def totals(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the sums of its words' rows."""
        cut = [(t or "").lower().split() for t in texts]
        if self.size > MEMO:
            self._empty()
        if new := {t for t in set().union(*cut) if t not in self.tokens}:
            self._learn(new)
        return [self.rows[[*map(self.tokens.__getitem__, own)]].sum(axis=0) if own else self.rows[0] for own in cut]


_OPEN: dict[str, _Words] = {}


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of each row; only the text is looked at."""
    state = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        own = state.value
        names = own.languages
        if own.uid not in _OPEN:
            _OPEN.clear()
            _OPEN[own.uid] = _Words(own)
        words, said, score = _OPEN[own.uid], [], []
        for at in range(0, batch.num_rows, TEXTS):
            texts = batch.column(1).slice(at, TEXTS).to_pylist()
            for total in words.totals(texts) if names else [np.zeros(1)] * len(texts):
                if total[-1] < 1:
                    said.append("und")
                    score.append(0.0)
                    continue
                best = int(np.argmax(total[:-1]))
                said.append(names[best])
                score.append(float(1 / np.exp(total[:-1] - total[best]).sum()))
        return {"doc_id": batch.column(0), "lang_pred": said, "score": score}

    return map_arrow(docs.select(docs["doc_id"].cast("long"), docs["text"]), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 5, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; learns from the rows that are not held out."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(own.filter(id_bucket(modulus) != 0), path)
    held = F.coalesce(id_bucket(modulus) == 0, F.lit(False))
    return predict(own, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
