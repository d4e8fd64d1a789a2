"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The merge list is compiled to a left-to-right machine. Two neighbours (a, b) may stand side by side in an encoding just
if no merge across their border comes before the merges that build a's right edge and b's left edge. A sequence is the
encoding of its bytes exactly if each of its tokens encodes itself and each pair of neighbours may stand together; so a
prefix of an encoding is the encoding of that prefix, and each prefix has one last token. The machine keeps that last
token for each position. What follows can only take back tokens that end within the lookahead of the merge list (see
``MergeTable.lookahead``); older ones, on which all open positions agree, are emitted and forgotten.

A text goes through in chunks of about ``CHUNK`` characters that end where a pretoken must begin, so cutting changes no
token; a pretoken of any length streams through a window of constant size. Tokens leave as soon as they are settled and go
straight on to the decoder, whose state is an unfinished character. So beside the text itself, and memories of pieces met
before that are bounded, what is held doesn't grow with a text. Short pretokens run through the same machine many at once.

Null and empty texts: no token. Equal texts give equal rows; repeated rows are kept; other columns are not touched. An empty table
gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinespark.llm.common import map_arrow

#: The pattern that splits text before merging (PATTERN of the vocabulary files), with its white space written out.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A space before a character that isn't white space begins a new pretoken whatever came before.
_ODD, _CUT = re.compile(r" (?!\S)"), re.compile(r" (?=\S)")
MEMO_PIECES, MEMO_BYTES, TEXTS, CHUNK = 200_000, 64, 256, 1 << 16


def _printable() -> dict[str, int]:
    """The vocabulary file writes bytes as printable characters: those that are none follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Tokens, merges and what follows from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _printable()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.text = dict((i, b) for b, i in vocab.items()) | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        names = {w: i for w, i in spec["model"]["vocab"].items()}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (names[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank.setdefault((a, b), r)
            self.parts.setdefault(names[self._name(spec, pair)], (a, b))
            self.born.setdefault(names[self._name(spec, pair)], r)
        self.longest = max(map(len, vocab))
        self._may: dict[tuple[int, int], bool] = {}
        self.ids = {b: i for b, i in vocab.items() if self._whole(i)}
        self.lookahead = self._lookahead()

    @staticmethod
    def _name(spec: dict, pair) -> str:
        return "".join(pair.split(" ") if isinstance(pair, str) else pair)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces that stand at this edge of the token while it is built, each with the rank of the merge that takes it."""
        taken, out = float("inf"), []
        while True:
            out.append((token, taken))
            if token not in self.parts:
                return out
            taken, token = self.born[token], self.parts[token][side]

    def _crossed(self, a: int, b: int, skip: tuple[int, int] | None = None) -> bool:
        """Whether a merge across the border of a and b happens before those that hide it. Of equal merges the left one is first."""
        for x, x_taken in self._edge(a, 1):
            for y, y_taken in self._edge(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < x_taken and r <= y_taken and (x, y) != skip:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        first = self.born[token]
        early = any((r := self.rank.get((x, y))) is not None and r < min(first, x_taken) and r <= y_taken for x, x_taken in self._edge(a, 1) for y, y_taken in self._edge(b, 0))
        return not early and self._whole(a) and self._whole(b)

    def may_follow(self, a: int, b: int) -> bool:
        known = self._may.get((a, b))
        if known is None:
            if len(self._may) > 2_000_000:
                self._may.clear()
            known = self._may[a, b] = not self._crossed(a, b)
        return known

    def _lookahead(self) -> int:
        """Bytes after which a token is settled. New bytes undo a merge (u, v) only by a merge (v, w) of a smaller rank, which
        frees u for one (t, u) of a larger rank, and so on: the longest chain of rising ranks, in bytes, and one token."""
        best: dict[int, int] = {}
        for (u, v), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            best[u] = max(best.get(u, 0), len(self.text[u]) + best.get(v, len(self.text[v])))
        return max(best.values(), default=0) + self.longest


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class Transducer:
    """Bytes of one pretoken in, settled tokens out."""

    def __init__(self, table: MergeTable):
        self.table, self.window = table, max(1024, 2 * table.lookahead)
        self.buffer, self.last = bytearray(), [-1]

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self._advance(data[at : at + self.window])
            if len(self.buffer) >= 2 * self.window:
                out += self._settle()
        return out

    def _advance(self, data: bytes) -> None:
        """last[i]: the token that ends the encoding of what lies before i."""
        ids, may, longest, last = self.table.ids.get, self.table.may_follow, self.table.longest, self.last
        self.buffer += data
        text = bytes(self.buffer)
        for end in range(len(last), len(text) + 1):
            for start in range(max(0, end - longest), end):
                token = ids(text[start:end])
                if token is not None and ((prior := last[start]) < 0 or may(prior, token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")

    def _chain(self, end: int) -> list[int]:
        """Ends of the tokens of the prefix that ends here, last first."""
        out = []
        while end > 0:
            out.append(end)
            end -= len(self.table.text[self.last[end]])
        return out

    def _settle(self) -> list[int]:
        """Emits the tokens on which all positions agree where a later token can begin."""
        n = len(self.buffer)
        shared = set(self._chain(n))
        for end in range(max(1, n - self.table.longest + 1), n):
            shared &= {*self._chain(end)}
        if not shared:
            return []
        stable = max(shared)
        out = self._tokens(stable)
        kept = self.last[stable]
        del self.buffer[:stable]
        self.last = [kept, *self.last[stable + 1 :]]
        return out

    def _tokens(self, end: int) -> list[int]:
        out = [self.last[e] for e in self._chain(end)]
        return out[::-1]

    def finish(self) -> list[int]:
        out = self._tokens(len(self.buffer))
        self.buffer, self.last = bytearray(), [-1]
        return out


def pieces(text: str) -> list[str]:
    """The text cut where a space stands before a character that isn't white space; the spaces are left out."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Lookup:
    """Whole numbers to small ones in arrays, by open addressing; -1 for what isn't there."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.size = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.values[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[at[todo]] != keys[todo])]
        return out

    def put(self, keys: np.ndarray, values: list[int]) -> None:
        if self.size + len(keys) > self.mask // 2:
            self.values[:], self.size = -1, 0
        for at, key, value in zip(self._slot(keys).tolist(), keys, values, strict=True):
            while self.values[at] >= 0 and self.keys[at] != key:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, value
        self.size += len(keys)


class Batch:
    """The machine for many short pretokens at once, position by position. Substrings are told by a polynomial hash."""

    FACTOR = np.uint64(0x5851F42D4C957F2D)

    def __init__(self, table: MergeTable):
        self.table, self.tokens, self.pairs = table, Lookup(18), Lookup(20)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(256, self.FACTOR)], dtype=np.uint64)
            self.tokens.put(np.array([self._hash(b) for b in table.ids], np.uint64), [*table.ids.values()])
        self.length = np.zeros(max(table.text) + 1, np.int64)
        for i, b in table.text.items():
            self.length[i] = len(b)

    def _hash(self, data: bytes) -> np.uint64:
        h = 0
        for x in data:
            h = (h * int(self.FACTOR) + x + 1) & (2**64 - 1)
        return np.uint64(h)

    def _fits(self, prior: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = (prior.astype(np.uint64) << np.uint64(20)) | token.astype(np.uint64)
        out = self.pairs.get(keys)
        if (out < 0).any():
            new = np.unique(keys[out < 0])
            self.pairs.put(new, [int(not self.table._crossed(int(k) >> 20, int(k) & 0xFFFFF)) for k in new])
            out = self.pairs.get(keys)
        return out > 0

    def encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        for at in range(0, len(order), 1 << 14):
            some = order[at : at + (1 << 14)]
            for i, ids in zip(some, self._sorted([words[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _sorted(self, words: list[bytes]) -> list[bytes]:
        """Longest first, so those that reach a position stand together."""
        sizes = np.array([*map(len, words)])
        n, most = len(words), int(sizes[0])
        text = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in words), np.uint8).reshape(n, most).astype(np.uint64) + np.uint64(1)
        last = np.full((most + 1, n), -1, np.int64)
        prefix = np.zeros((most + 1, n), np.uint64)
        for i in range(most):
            prefix[i + 1] = prefix[i] * self.FACTOR + text[:, i]
        for end in range(1, most + 1):
            open_ = np.arange(int(np.searchsorted(-sizes, -end, "right")))
            for start in range(max(0, end - self.table.longest), end):
                token = self.tokens.get(prefix[end][open_] - prefix[start][open_] * self.powers[end - start])
                hit = token >= 0
                if start and hit.any():
                    hit[hit] = self._fits(last[start][open_[hit]], token[hit])
                if hit.any():
                    last[end][open_[hit]] = token[hit]
                    open_ = open_[~hit]
                    if not len(open_):
                        break
        made = np.zeros((n, most), "<u4")
        at, place, rows = sizes.copy(), np.full(n, most), np.arange(n)
        while len(rows):
            token = last[at[rows], rows]
            place[rows] -= 1
            made[rows, place[rows]] = token
            at[rows] -= self.length[token]
            rows = rows[at[rows] > 0]
        return [made[i, k:].tobytes() for i, k in enumerate(place.tolist())]


class Encoder:
    """Encodes texts. Pieces and words met before are looked up; both memories are bounded and emptied when full."""

    def __init__(self, table: MergeTable):
        self.table, self.machine, self.batch = table, Transducer(table), Batch(table)
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.special = re.compile("|".join(map(re.escape, table.special))) if table.special else None
        self.bytes_of = [table.text.get(i, b"") for i in range(max(table.text) + 1)]

    def _learn(self, memory: dict[str, bytes], pieces: set[str], before: str) -> None:
        """Fills memory with the encodings of the pieces, each with what stands before it."""
        if len(self.words) > MEMO_PIECES:
            self.words.clear()
        cut = {p: [before + p] if p.isalpha() else _PRETOKEN.findall(before + p) for p in pieces}
        new = {w for words in cut.values() for w in words if w not in self.words}
        short: dict[str, bytes] = {}
        for word in new:
            data = word.encode("utf-8", "replace")
            token = self.table.ids.get(data)
            if token is not None:
                self.words[word] = token.to_bytes(4, "little")
            elif len(data) <= MEMO_BYTES:
                short[word] = data
            else:
                self.words[word] = np.asarray([*self.machine.feed(data), *self.machine.finish()], "<u4").tobytes()
        self.words.update(zip(short, self.batch.encode([*short.values()]), strict=True))
        get = self.words.__getitem__
        memory.update((p, b"".join(map(get, words))) for p, words in cut.items())

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; strings of special tokens in a text become those
        tokens. Null gives none."""
        spans: list[list[tuple[bytes, str, list[str]]]] = []
        for text in texts:
            own, at = [], 0
            for m in self.special.finditer(text) if text and self.special else ():
                own.append(self._split(text[at : m.start()]))
                own.append((self.table.special[m[0]].to_bytes(4, "little"), "", []))
                at = m.end()
            spans.append([*own, self._split((text or "")[at:])])
        firsts = {first for own in spans for _, first, _ in own}
        laters: set[str] = set()
        for own in spans:
            for _, _, rest in own:
                laters.update(rest)
        for memory, pieces, before in ((self.first, firsts, ""), (self.later, laters, " ")):
            if len(memory) > MEMO_PIECES:
                memory.clear()
            if new := {p for p in pieces if p not in memory}:
                self._learn(memory, new, before)
        get = self.later.__getitem__
        return [b"".join([known or self.first[first] + b"".join(map(get, rest)) for known, first, rest in own]) for own in spans]

    def stream(self, text: str | None) -> Iterator[np.ndarray]:
        """The ids of a text, some at a time."""
        at = 0
        for m in self.special.finditer(text) if text and self.special else ():
            yield from self._plain(text, at, m.start())
            yield np.array([self.table.special[m[0]]], "<u4")
            at = m.end()
        yield from self._plain(text or "", at, len(text or ""))

    def _plain(self, text: str, at: int, end: int) -> Iterator[np.ndarray]:
        """A stretch without special tokens, in chunks."""
        while at < end:
            cut = next((m.start() for m in _CUT.finditer(text, at + CHUNK, end)), end)
            if cut - at <= 2 * CHUNK:
                yield np.frombuffer(self.encode(text[at:cut]), "<u4")
            else:
                for m in _PRETOKEN.finditer(text, at, cut):
                    for k in range(m.start(), m.end(), CHUNK):
                        yield np.asarray(self.machine.feed(text[k : min(k + CHUNK, m.end())].encode("utf-8", "replace")), "<u4")
                    yield np.asarray(self.machine.finish(), "<u4")
            at = cut

    @staticmethod
    def _split(text: str) -> tuple[bytes, str, list[str]]:
        parts = pieces(text)
        return b"", parts[0], parts[1:]

    def forget(self) -> None:
        for memory in (self.first, self.later, self.words):
            memory.clear()

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode_stream(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        """Text as soon as its bytes are whole: the state is the unfinished character, three bytes at most. Bytes that are no
        UTF-8 become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for some in ids:
            yield state.decode(b"".join(map(self.bytes_of.__getitem__, some.tolist())))
        yield state.decode(b"", True)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(merge_table(path))


def encoded(texts: pa.Array, path: str) -> Iterator[bytes]:
    """Ids of each text, some hundred texts at a time."""
    for at in range(0, len(texts), TEXTS):
        yield from encoder(path).encode_many(texts.slice(at, TEXTS).to_pylist())


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The installed vocabulary file; it is read where it lies and never copied."""
    try:
        import public_tokenizers
    except ImportError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of (id, ids binary) for each row of docs."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "ids": [*encoded(batch.column(1), path)]}

    return map_arrow(docs.select(docs[id_col].cast("long"), docs[text_col]), run, "doc_id long, ids binary", lambda: encoder(path).forget())


def _rounds(texts: list[str | None], enc: Encoder) -> Iterator[tuple[int, str, str]]:
    """Number of tokens, sha256 of the ids and of the decoded text, of each text. The short ones are encoded together, each as
    one chunk; a long one streams."""
    short = [k for k, t in enumerate(texts) if len(t or "") <= CHUNK]
    whole = dict(zip(short, enc.encode_many([texts[k] for k in short]), strict=True))
    for k, text in enumerate(texts):
        n, ids_said, text_said = 0, hashlib.sha256(), hashlib.sha256()

        def passing(chunks: Iterable[np.ndarray], said=ids_said) -> Iterator[np.ndarray]:
            nonlocal n
            for ids in chunks:
                n += len(ids)
                said.update(ids.tobytes())
                yield ids

        for part in enc.decode_stream(passing([np.frombuffer(whole[k], "<u4")] if k in whole else enc.stream(text))):
            text_said.update(part.encode())
        yield n, ids_said.hexdigest(), text_said.hexdigest()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: each chunk is encoded and decoded before the next."""

    def run(batch: pa.RecordBatch) -> dict:
        enc, rows = encoder(path), []
        for at in range(0, batch.num_rows, TEXTS):
            rows += _rounds(batch.column(1).slice(at, TEXTS).to_pylist(), enc)
        return {"doc_id": batch.column(0), "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]}

    return map_arrow(docs.select(docs[id_col].cast("long"), docs[text_col]), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: encoder(path).forget())
