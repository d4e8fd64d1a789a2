"""Training-order materialisation of token ids.

Each text becomes its token ids and an end token, cut into sequences of ``length`` tokens; the last of a text is filled
up. Texts are encoded once and written, each partition counting its sequences; so the sequences have numbers 0 .. N - 1 in
order of partitions, and the driver knows N from one number for each partition. A keyed Feistel network on the next power of
four, walked until it falls below N, permutes 0 .. N - 1: a sequence's permuted number is its slot, without gaps.

Shard s holds the slots from s x ``span`` on, so all shards but the last have ``span`` records. A shard is a file of records
of one fixed stride: a header (id of the text, place of the sequence in it, tokens that count), the ids as little-endian
unsigned 16-bit integers, a line feed. A slot's shard and byte follow from the slot alone, and a reader goes on where it
stopped. Records move to their shard once, packed in runs; the shards are written in ``waves``, each from the encoded texts,
so no more than a share of the records is in shuffle files at once. A task holds one shard (35 MB by default).

Everything that is numbered comes from written files, so a lost executor's work gives the same slots again. Spark's commit
protocol writes the shards, so lost tasks leave no half shard.

A null or empty text is one sequence with the end token alone. Rows with a null id are marked in the header. Repeated
rows are sequences of their own. Strings of special tokens in a text are ordinary text. Vocabularies of over 65,536 ids are
refused. Other columns are ignored; an empty table writes nothing and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.taskcontext import TaskContext

from kinespark.llm.bpe import MEMO_PIECES, TEXTS, pieces
from kinespark.llm.common import materialise, new_path, ready, shuffles_freed

#: END is free in the rank file.
LENGTH, SPAN, ROUNDS, END, WAVES, HELD = 256, 65_536, 6, 50_256, 2, 24 << 20
_ENCODED = "part int, first long, n long, docs array<long>, sizes array<int>, ids binary"
_HEAD = np.dtype([("doc_id", "<i8"), ("part", "<u4"), ("tokens", "<u2"), ("known", "u1"), ("spare", "u1")])


def record_type(length: int) -> np.dtype:
    return np.dtype([("head", _HEAD), ("ids", "<u2", (length,)), ("line", "S1")])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, exclusive or)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed bijection of 0 .. n - 1."""

    def __init__(self, n: int, key: str):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        digest = hashlib.sha256(key.encode()).digest() + hashlib.sha256(key.encode()[::-1] + b"+").digest()
        self.keys = np.frombuffer(digest, "<u8")[:ROUNDS].copy()

    def _once(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        low = np.uint64((1 << self.half) - 1)
        shift = np.uint64(self.half)
        left, right = x >> shift, x & low
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (_mixed(left + k) & low), left
            else:
                left, right = right, left ^ (_mixed(right + k) & low)
        return (left << shift) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while (far := out >= self.n).any():
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slot(self, number) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot) -> np.ndarray:
        return self._walk(slot, True)


class Tokens:
    """Ids of texts as little-endian unsigned 16-bit integers, by the library of the rank file. Pieces between spaces are
    encoded once, those that are new all at once, and remembered up to a bound."""

    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            self.size[i] = len(token)
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _learn(self, memory: dict[str, bytes], new: list[str], before: str) -> None:
        ids = np.asarray(self.encoding.encode_ordinary("".join(before + p for p in new)), np.int64)
        ends = np.cumsum([len((before + p).encode()) for p in new])
        cuts = np.searchsorted(np.cumsum(self.size[ids]), ends, "left") + 1
        data, at = ids.astype("<u2").tobytes(), 0
        for p, cut in zip(new, (2 * cuts).tolist(), strict=True):
            memory[p], at = data[at:cut], cut

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [pieces((t or "").encode("utf-8", "replace").decode()) for t in texts]
        if len(self.later) > MEMO_PIECES:
            self.later.clear()
        if new := [p for p in {p for own in cut for p in own[1:]} if p not in self.later]:
            self._learn(self.later, new, " ")
        if len(self.first) > MEMO_PIECES // 10:
            self.first.clear()
        for own in cut:
            if own[0] and own[0] not in self.first:
                self._learn(self.first, [own[0]], "")
        get = self.later.__getitem__
        return [(self.first[own[0]] if own[0] else b"") + b"".join(map(get, own[1:])) for own in cut]


@lru_cache(maxsize=2)
def tokens(ranks: str) -> Tokens:
    """One for each Python worker."""
    return Tokens(ranks)


def _encoded(batches: Iterator[pa.RecordBatch], schema: pa.Schema, vocabulary: str, end: int, length: int) -> Iterator[pa.RecordBatch]:
    """Some texts a row: their ids end to end, each text with its end token; first is the number of the row's first
    sequence among those of its partition."""
    part, first = TaskContext.get().partitionId(), 0
    stop = np.uint16(end).tobytes()
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            some = batch.slice(k, TEXTS)
            ids = tokens(vocabulary).encode(some.column(1).to_pylist())
            sizes = [len(x) // 2 + 1 for x in ids]
            n = sum(-(-size // length) for size in sizes)
            data = zstandard.compress(b"".join(x + stop for x in ids), 3)
            yield pa.RecordBatch.from_pydict({"part": [part], "first": [first], "n": [n], "docs": [some.column(0).to_pylist()], "sizes": [sizes], "ids": [data]}, schema=schema)
            first += n
    tokens(vocabulary).later.clear()


def _records(docs: list, sizes: np.ndarray, ids: np.ndarray, end: int, length: int) -> np.ndarray:
    """The sequences of some texts, filled up with the end token."""
    rows = -(-sizes // length)
    of, part = np.repeat(np.arange(len(sizes)), rows), np.concatenate([np.arange(n) for n in rows])
    out = np.zeros(len(of), record_type(length))
    out["head"]["doc_id"] = np.array([-1 if d is None or d != d else d for d in docs], np.int64)[of]
    out["head"]["known"] = np.array([not (d is None or d != d) for d in docs], np.uint8)[of]
    out["head"]["part"], out["head"]["tokens"], out["line"] = part, np.minimum(length, sizes[of] - length * part), b"\n"
    filled = np.full(len(of) * length, end, "<u2")
    start = np.repeat(np.cumsum(rows) - rows, sizes) * length
    filled[start + np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = ids
    out["ids"] = filled.reshape(-1, length)
    return out


def _packed(shard: np.ndarray, place: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard that some records go to."""
    order = np.argsort(shard, kind="stable")
    shard, place, records = shard[order], place[order], records[order]
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
    rows = [(int(shard[a]), place[a:b].astype("<u4").tobytes(), zstandard.compress(records[a:b].tobytes(), 3)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    yield pa.RecordBatch.from_pydict({"shard": [r[0] for r in rows], "places": [r[1] for r in rows], "records": [r[2] for r in rows]}, schema=pa.schema([("shard", pa.int64()), ("places", pa.binary()), ("records", pa.binary())]))


def materialise_order(docs: DataFrame, path: str, vocabulary: str, key: str = "kinespark", length: int = LENGTH, span: int = SPAN, end: int = END, waves: int = WAVES) -> int:
    """Writes the shards below path; gives the number of sequences."""
    spark = docs.sparkSession
    ready(spark)
    if max(len(tokens(vocabulary).size), end) >= 1 << 16:
        raise ValueError("ids don't fit 16 bits")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = to_arrow_schema(T._parse_datatype_string(_ENCODED))
    encoded = materialise(texts.mapInArrow(lambda x: _encoded(x, schema, vocabulary, end, length), _ENCODED), "encoded", "none")
    counts = {r["part"]: r["n"] for r in encoded.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    total, starts = 0, {}
    for part in sorted(counts):
        starts[part], total = total, total + counts[part]
    if not total:
        return 0
    shards, kind = -(-total // span), record_type(length)
    state = spark.sparkContext.broadcast(starts)

    def place(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
        order, held, size = Permutation(total, key), [], 0
        for batch in batches:
            for part, first, n, ids_of, sizes, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                slots = order.slot(state.value[part] + first + np.arange(n))
                records = _records(ids_of, np.array(sizes), np.frombuffer(zstandard.decompress(data), "<u2"), end, length)
                own = (slots >= low * span) & (slots < high * span)
                held.append((slots[own], records[own]))
                size += int(own.sum())
                if size * kind.itemsize > HELD:
                    slots, records = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                    yield from _packed(slots // span, slots % span, records)
                    held, size = [], 0
        if size:
            slots, records = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            yield from _packed(slots // span, slots % span, records)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds the runs of one shard: its file as one value."""
        out, shard = np.zeros(span, kind), None
        for batch in batches:
            for shard, places, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out[np.frombuffer(places, "<u4")] = np.frombuffer(zstandard.decompress(data), kind)
        if shard is not None:
            body = out[: min(span, total - shard * span)].tobytes()[:-1]
            yield pa.RecordBatch.from_pydict({"value": [body], "shard": [shard]}, schema=pa.schema([("value", pa.binary()), ("shard", pa.int64())]))

    for w in range(min(waves, shards)):
        low, high = (shards * x // min(waves, shards) for x in (w, w + 1))
        dealt = encoded.mapInArrow(lambda x, low=low, high=high: place(x, low, high), "shard long, places binary, records binary")
        files = dealt.repartitionById(high - low, (F.col("shard") - low).cast("int")).mapInArrow(whole, "value binary, shard long")
        # a binary is its bytes as a string too, and the text sink ends it with a line feed
        with shuffles_freed(spark):
            files.select(F.col("value").cast("string").alias("value"), "shard").write.mode("append" if w else "errorifexists").partitionBy("shard").option("compression", "none").text(path)
    return total


def read_order(spark: SparkSession, path: str, from_slot: int = 0, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """slot, shard, record, doc_id, part, ids of all records from a slot on; earlier shards aren't opened."""
    ready(spark)
    files = spark.read.format("binaryFile").load(path).filter(F.col("shard") >= from_slot // span)
    files, kind = files.select(F.col("shard").cast("long").alias("shard"), "content"), record_type(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                records = np.frombuffer(content.as_buffer(), kind)
                for at in range(max(0, from_slot - shard * span), len(records), 2000):
                    some = records[at : at + 2000]
                    number, head = at + np.arange(len(some)), some["head"]
                    yield pa.RecordBatch.from_pydict({
                        "slot": pa.array(shard * span + number), "shard": pa.array(np.full(len(some), shard)), "record": pa.array(number),
                        "doc_id": pa.array(head["doc_id"], mask=head["known"] == 0), "part": pa.array(head["part"].astype(np.int64)),
                        "ids": pa.array([ids[:n].tobytes() for ids, n in zip(some["ids"], head["tokens"], strict=True)], pa.binary()),
                    })

    return files.mapInArrow(run, "slot long, shard long, record long, doc_id long, part long, ids binary")


def digest(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Writes the shards and reads them: slot, shard, record, doc_id, part, n_tokens, ids_sha256."""
    spark = docs.sparkSession
    path = path or new_path(spark, "training-order")
    if not materialise_order(docs, path, vocabulary):
        return spark.createDataFrame([], "slot long, shard long, record long, doc_id long, part long, n_tokens long, ids_sha256 string")
    return read_order(spark, path).select("slot", "shard", "record", "doc_id", "part", (F.length("ids") / 2).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
