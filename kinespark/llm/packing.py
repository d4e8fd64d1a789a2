"""Packing of token ids into sequences of one capacity by multiway differencing.

Each text becomes its ids and an end token. Whole capacities of a text are sequences of their own; the rests, some thousand
at a time, are packed by the Karmarkar-Karp method: partial partitions, at first one rest each, lie in a heap by their
imbalance; the two with the largest are merged so that the larger windows of one meet the smaller ones of the other, until
one partition is left, whose windows are nearly equal. Of a window over the capacity the end of its largest piece is cut off;
cut ends fill the windows that have room, and where these don't hold them all, the window count rises: what is over gets
sequences of its own. These last ones, at most one for each binary digit of the capacity and block, are as long as a power of two
each, so they need no padding, like all the others, which are full. Without cutting (``cut=False``), rests stay whole and
the count rises until no window exceeds the capacity.

A task packs what it reads, a block at a time, so nothing is shuffled, no key can be hot and memory is bounded by a block (8 MB
of ids) and one text. A sequence's number is its task's and its place there: a rerun over the same files and splits gives the same
rows; other splits give other blocks. Texts of any length are encoded in chunks that end where a word must begin.

Defined cases: a null or empty text is the end token alone; null ids and repeated rows are packed like others; strings of
special tokens in a text become those tokens; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.taskcontext import TaskContext

from kinespark.llm.bpe import _CUT, CHUNK, vocabulary_path
from kinespark.llm.common import ready
from kinespark.llm.training_order import tokens

CAPACITY, END, BLOCK, TEXTS = 2048, 1, 2048, 256
#: Fixed value: the special token of the vocabulary.
SPECIAL = ("<|endoftext|>", 50_256)
_OUT = "sequence_id long, n_tokens int, ids binary, pieces array<struct<doc_id: long, start: long, length: long, doc_tokens: long, offset: long>>"


def differenced(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item: largest imbalances merged first, with opposing order. A partial partition keeps its windows
    in descending order without those that are empty; once none is, the smallest is taken from all."""
    n = len(sizes)
    held: list[np.ndarray | None] = [np.array([s], np.int64) for s in sizes]
    merged: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap = [(-int(s) if windows > 1 else 0, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = held[a], held[b]
        width = min(windows, len(x) + len(y))
        places_x, places_y = np.arange(len(x)), width - 1 - np.arange(len(y))
        both = np.zeros(width, np.int64)
        both[places_x] += x
        both[places_y] += y
        order = np.argsort(-both, kind="stable")
        rank = np.empty(width, np.int64)
        rank[order] = np.arange(width)
        both = both[order]
        full = width == windows
        held.append(both - both[-1] if full else both)
        held[a] = held[b] = None
        merged.append((a, b, rank[places_x], rank[places_y]))
        heapq.heappush(heap, (-int(both[0] - (both[-1] if full else 0)), n + len(merged) - 1))
    label, at = np.zeros(n, np.int64), {n + len(merged) - 1: np.arange(windows)}
    for k in range(len(merged) - 1, -1, -1):
        own, (a, b, in_a, in_b) = at.pop(n + k), merged[k]
        for child, places in ((a, in_a), (b, in_b)):
            if child < n:
                label[child] = own[places[0]]
            else:
                at[child] = own[places]
    return label


def whole(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of whole items (item, 0, size); the count rises until none is over the capacity. No item may be over it."""
    total = int(sizes.sum())
    count = -(-total // capacity)
    while count:
        label = differenced(sizes, count)
        over = np.maximum(np.bincount(label, sizes, count).astype(np.int64) - capacity, 0)
        if not over.any():
            out: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
            for i, w in enumerate(label.tolist()):
                out[w].append((i, 0, int(sizes[i])))
            return [w for w in out if w]
        count += -(-int(over.sum()) // capacity)
    return []


def filled(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of parts of items (item, start, length): all full, but for the last ones, which are powers of two."""
    count = int(sizes.sum()) // capacity
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    if count:
        for i, w in enumerate(differenced(sizes, count).tolist()):
            out[w].append((i, 0, int(sizes[i])))
        spare = []
        for window in out:
            over = sum(p[2] for p in window) - capacity
            while over > 0:
                k = max(range(len(window)), key=lambda k: window[k][2])
                i, start, length = window[k]
                gone = min(over, length)
                spare.append((i, start + length - gone, gone))
                window[k] = (i, start, length - gone)
                over -= gone
            window[:] = [p for p in window if p[2]]
    else:
        spare = [(i, 0, int(s)) for i, s in enumerate(sizes)]
    spare.sort(key=lambda p: p[2])
    rooms = sorted(((capacity - sum(p[2] for p in w), k) for k, w in enumerate(out)), reverse=True)
    rest = sum(p[2] for p in spare) - sum(max(r, 0) for r, _ in rooms)
    for digit in range(capacity.bit_length() - 1, -1, -1):
        if rest >> digit & 1:
            rooms.append((1 << digit, len(out)))
            out.append([])
    for room, k in rooms:
        while room > 0:
            i, start, length = spare.pop()
            part = min(room, length)
            out[k].append((i, start, part))
            room -= part
            if part < length:
                spare.append((i, start + part, length - part))
    return out


def encoded(texts: list[str | None], ranks: str) -> list[np.ndarray]:
    """The ids of each text."""
    out, small = [np.zeros(0, np.uint16)] * len(texts), []
    for k, text in enumerate(texts):
        if text and (len(text) > CHUNK or SPECIAL[0] in text):
            out[k] = np.concatenate([x for x in _long(text, ranks)] or [out[k]])
        elif text:
            small.append(k)
    for k, ids in zip(small, tokens(ranks).encode([texts[k] for k in small]), strict=True):
        out[k] = np.frombuffer(ids, "<u2")
    return out


def _long(text: str, ranks: str) -> Iterator[np.ndarray]:
    """The ids of a text that is long or has special tokens, a chunk at a time."""
    for n, stretch in enumerate(text.split(SPECIAL[0])):
        if n:
            yield np.array([SPECIAL[1]], np.uint16)
        at = 0
        while at < len(stretch):
            cut = next((m.start() for m in _CUT.finditer(stretch, at + CHUNK)), len(stretch))
            yield np.frombuffer(tokens(ranks).encode([stretch[at:cut]])[0], "<u2")
            at = cut


class _Packer:
    """The sequences of one task."""

    def __init__(self, capacity: int, cut: bool, first: int):
        self.capacity, self.deal, self.number = capacity, filled if cut else whole, first
        self.rests: list[tuple[int | None, int, int, np.ndarray]] = []
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n, capacity = len(ids), self.capacity
        rest = n % capacity
        for start in range(0, n - rest, capacity):
            self.emit([(doc, start, n, ids[start : start + capacity])])
        if rest:
            self.rests.append((doc, n - rest, n, ids[n - rest :]))
        if len(self.rests) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        for window in self.deal(np.array([len(r[3]) for r in self.rests], np.int64), self.capacity):
            self.emit([(self.rests[i][0], self.rests[i][1] + start, self.rests[i][2], self.rests[i][3][start : start + length]) for i, start, length in window])
        self.rests = []

    def emit(self, pieces: list[tuple[int | None, int, int, np.ndarray]]) -> None:
        size = np.array([len(p[3]) for p in pieces])
        places = (np.cumsum(size) - size).tolist()
        told = [{"doc_id": d, "start": s, "length": len(x), "doc_tokens": n, "offset": o} for (d, s, n, x), o in zip(pieces, places, strict=True)]
        self.rows.append((self.number, int(size.sum()), np.concatenate([p[3] for p in pieces]).astype("<u4").tobytes(), told))
        self.number += 1


def sequences(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY, end: int = END, cut: bool = True) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian unsigned 32-bit integers, unpadded; see ``padded``) and pieces: doc_id, start
    (the document's ids before), length, doc_tokens and offset. docs: doc_id and text."""
    if not 1 <= capacity:
        raise ValueError("the capacity must be positive")
    ready(docs.sparkSession)
    ranks = ranks or vocabulary_path("byte_bpe_50k.tiktoken")
    schema = to_arrow_schema(T._parse_datatype_string(_OUT))

    def out(packer: _Packer) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(packer.rows), 512):
            some = packer.rows[at : at + 512]
            yield pa.RecordBatch.from_pydict({c: [r[k] for r in some] for k, c in enumerate(schema.names)}, schema=schema)
        packer.rows = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, cut, TaskContext.get().partitionId() << 33)
        stop = np.array([end], np.uint16)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                for doc, ids in zip(some.column(0).to_pylist(), encoded(some.column(1).to_pylist(), ranks), strict=True):
                    packer.add(doc, np.concatenate([ids, stop]))
                yield from out(packer)
        packer.flush()
        yield from out(packer)
        tokens(ranks).later.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def pieces(packed: DataFrame) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    one = packed.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    own = F.substring("ids", (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return one.select("p.doc_id", "p.start", "p.length", own.alias("ids"), "p.doc_tokens", "sequence_id", "p.offset")


def padded(packed: DataFrame, capacity: int = CAPACITY, filler: int = END) -> DataFrame:
    """The sequences with ids filled up to the capacity, but for those whose length is a power of two."""
    n = F.col("n_tokens")
    missing = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(capacity) - n)
    fill = F.unhex(F.repeat(F.lit(filler.to_bytes(4, "little").hex()), missing))
    return packed.withColumn("ids", F.concat("ids", fill))


def digest(docs: DataFrame) -> DataFrame:
    """The pieces with the unsigned crc32 of their ids in their place."""
    told = pieces(sequences(docs))
    return told.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
