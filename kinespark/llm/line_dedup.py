"""Line dedup by pairwise alignment.

Lines that occur in two documents or more are found by their hash. A passage is the shortest run of such lines, from a
line on or up to a line, that has ``MIN_WORDS`` words; what pairs documents is the hash of its rarest line together with
that of the passage, and each document is paired with the first one that holds it. Every line of a common block of so many
words is in such a passage, so no block is missed however frequent its lines are, and a line that is everywhere makes no
pair alone. Each pair is aligned with patience diff: lines that occur once on both sides, in the longest ascending run, are
anchors, between which the same is done again. Runs of aligned lines that follow each other in both documents are common
blocks; blocks of ``MIN_WORDS`` words or more are deleted from the later document. So are those that the alignment breaks
or passes over, as they changed places or their lines repeat: the longest match that ends at each line, by the suffix
automaton of the earlier document, gives every run of so many words that both documents have. Lines are equal if two
independent 64-bit hashes of their text are. So the lines that go are just those in a run of so many words that stands in
any earlier document, and the first one with a passage keeps it.

Documents are ordered by id, then by hash of the text; rows with the same id and text are one document and share its
decisions. Rows with a null id and null texts stay as they are. White space (\\s) at a line's ends doesn't count. Blank
lines are no part of blocks and don't part them: lines follow each other by their place among those that aren't blank.
Repeats within one document are kept. Other columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import carried, map_arrow, materialise

MIN_WORDS = 50
_FACTOR = 0x5851F42D4C957F2D
_BLANKS = " \t\n\x0b\f\r"  # \s
Item = tuple  # place, hash, words


def patience(a: list[Item], b: list[Item]) -> list[tuple[int, int]]:
    """Matched places in a and b, both ascending; items are (place, hash, words)."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i][1] == b[j][1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1][1] == b[n - 1][1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        left, right = Counter(x[1] for x in a[i:m]), Counter(x[1] for x in b[j:n])
        common = {h for h in left if h in right}
        single = {h for h in common if left[h] == right[h] == 1} or common
        if not single:
            continue
        where: dict[int, int] = {}
        for k in range(m - 1, i - 1, -1):
            where[a[k][1]] = k
        met, steps = set(), []
        for k in range(j, n):
            if (h := b[k][1]) in single and h not in met:
                met.add(h)
                steps.append((where[h], k))
        i0, j0 = i, j
        for x, y in [*_ascending(steps), (m, n)]:
            todo.append((i0, x, j0, y))
            if x < m:
                out.append((x, y))
            i0, j0 = x + 1, y + 1
    return sorted(out)


def _ascending(steps: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of steps whose first places ascend."""
    tops: list[int] = []  # the least place that ends a run of each length
    ends: list[int] = []  # its step
    prior: list[int] = []
    for k, (x, _) in enumerate(steps):
        p = bisect_left(tops, x)
        tops[p : p + 1], ends[p : p + 1] = [x], [k]
        prior.append(ends[p - 1] if p else -1)
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(steps[k])
        k = prior[k]
    return out[::-1]


def longest_matches(a: list[Item], b: list[Item]) -> list[int]:
    """For each item of b, how many items up to it, at places that follow each other, stand so in a too: its longest match
    by the suffix automaton of a."""
    steps: list[dict] = [{}]
    link, length, last, place = [-1], [0], 0, None
    for at, h, _ in a:
        # a gap is a token that nothing equals
        for token in (h,) if place is None or at == place + 1 else (object(), h):
            new = len(steps)
            steps.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and token not in steps[p]:
                steps[p][token] = new
                p = link[p]
            if p >= 0:
                q = steps[p][token]
                if length[q] > length[p] + 1:
                    copy = len(steps)
                    steps.append(dict(steps[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and steps[p].get(token) == q:
                        steps[p][token] = copy
                        p = link[p]
                    link[q] = q = copy
                link[new] = q
            last = new
        place = at
    out, v, n, place = [], 0, 0, None
    for at, h, _ in b:
        if place is not None and at != place + 1:
            v = n = 0
        while v and h not in steps[v]:
            v = link[v]
            n = length[v]
        v, n = (steps[v][h], n + 1) if h in steps[v] else (0, 0)
        out.append(n)
        place = at
    return out


def common_blocks(a: list[Item], b: list[Item], min_words: int = MIN_WORDS) -> list[int]:
    """Places of b's lines in common blocks of so many words."""
    ours = {x[1] for x in b}
    a = [x for x in a if x[1] in ours]
    theirs = {x[1] for x in a}
    b = [x for x in b if x[1] in theirs]
    if sum(x[2] for x in b) < min_words:
        return []
    gone: set[int] = set()
    block: list[tuple[int, int]] = []
    for x, y in [*patience(a, b), (-1, -1)]:
        if not block or x < 0 or (a[x][0], b[y][0]) != (a[block[-1][0]][0] + 1, b[block[-1][1]][0] + 1):
            if sum(b[k][2] for _, k in block) >= min_words:
                gone.update(k for _, k in block)
            block = []
        block.append((x, y))
    if len(gone) < len(b):
        reach, least = np.r_[0, np.cumsum([x[2] for x in b])].tolist(), len(b)
        for y, n in reversed([*enumerate(longest_matches(a, b))]):
            if reach[y + 1] - reach[y + 1 - n] >= min_words:
                least = min(least, y + 1 - n)
            if least <= y:
                gone.add(y)
    return sorted(b[y][0] for y in gone)


def passages(row: np.ndarray, place: np.ndarray, line: np.ndarray, words: np.ndarray, holders: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first item, rarest line, hash) of each passage in the items of some documents, which follow each other in order of
    row and place: the shortest runs from an item on, and those up to one."""
    n = len(row)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    powers, back = (np.cumprod(np.r_[np.uint64(1), np.full(n, f & (2**64 - 1), np.uint64)], dtype=np.uint64) for f in (_FACTOR, pow(_FACTOR, -1, 2**64)))
    sums = np.r_[np.uint64(0), np.cumsum(line.astype(np.int64).view(np.uint64) * powers[:n], dtype=np.uint64)]
    reach = np.r_[0, np.cumsum(words, dtype=np.int64)]
    first = np.r_[np.arange(n), np.searchsorted(reach, reach[1:] - min_words, "right") - 1]
    last = np.r_[np.searchsorted(reach, reach[:-1] + min_words) - 1, np.arange(n)]
    there = (first >= 0) & (last < n)
    first, last = first[there], last[there]
    whole = (row[last] == row[first]) & (place[last] - place[first] == last - first)
    first, last = np.unique(np.stack([first[whole], last[whole]]), axis=1)
    order = np.lexsort((line, holders))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = np.arange(n), n
    rarest = np.minimum.reduceat(rank, np.stack([first, last + 1], axis=1).ravel())[::2] if len(first) else first
    return first, line[order[rarest]], ((sums[last + 1] - sums[first]) * back[first]).view(np.int64)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key() -> Column:
    return F.xxhash64("text")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, deleted, partners): for each later document that loses lines, their places, and the first documents
    that hold them."""
    known = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("text_key"), "text")
    trimmed = F.transform(_lines(F.col("text")), lambda line, pos: F.struct(pos.alias("pos"), F.btrim(line, F.lit(_BLANKS)).alias("line")))
    each = known.select("doc_id", "text_key", F.posexplode(F.filter(trimmed, lambda x: x["line"] != "")).alias("place", "own")).select("doc_id", "text_key", "place", "own.pos", "own.line")
    lines = each.select("doc_id", "text_key", "place", "pos", F.xxhash64("line").alias("line"), F.xxhash64(F.lit("again"), "line").alias("check"), F.size(F.split("line", r"\s+")).alias("words"))
    lines = materialise(lines, "lines")
    who = F.struct("doc_id", "text_key")
    shared = lines.groupBy("line").agg(F.min(who).alias("first"), F.max(who).alias("last"), F.count("*").alias("n")).filter(F.col("first") != F.col("last"))
    shared = materialise(shared.select("line", "n"), "shared")
    # rows of one document may repeat, so its lines are a set
    held = lines.join(shared, "line").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("place", "line", "words", "n", "check", "pos"))).alias("items"))
    texts = materialise(held, "items")

    def keys(batch: pa.RecordBatch) -> dict:
        items = batch.column(2)
        flat, row = items.flatten(), np.repeat(np.arange(batch.num_rows), items.value_lengths().to_numpy())
        at, rare, key = passages(row, *(flat.field(k).to_numpy() for k in range(4)), min_words)
        return {"doc_id": batch.column(0).take(pa.array(row[at])), "text_key": batch.column(1).take(pa.array(row[at])), "rare": rare, "passage": key}

    runs = materialise(map_arrow(texts, keys, "doc_id long, text_key long, rare long, passage long").distinct(), "passages")
    opened = runs.groupBy("rare", "passage").agg(F.min(who).alias("first"), F.max(who).alias("last")).filter(F.col("first") != F.col("last"))
    opened = materialise(opened.select("rare", "passage", "first"), "opened")
    pairs = runs.join(opened, ["rare", "passage"]).filter(F.col("first") < who).select(who.alias("later"), F.col("first").alias("earlier")).distinct()
    pairs = materialise(pairs.select(F.col("later.doc_id").alias("doc_id"), F.col("later.text_key").alias("text_key"), F.col("earlier.doc_id").alias("first_id"), F.col("earlier.text_key").alias("first_key")), "pairs")

    firsts = texts.select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"), F.col("items").alias("before"))
    both = pairs.join(firsts, ["first_id", "first_key"]).join(texts, ["doc_id", "text_key"])

    def run(batch: pa.RecordBatch) -> dict:
        cols = {c: batch.column(c) for c in ("doc_id", "text_key", "first_id", "before", "items")}
        out: dict = {"doc_id": [], "text_key": [], "first_id": [], "gone": []}
        as_items = lambda rows: [(r["place"], (r["line"], r["check"]), r["words"]) for r in rows]
        for k in range(batch.num_rows):
            items = cols["items"][k].as_py()
            gone = common_blocks(as_items(cols["before"][k].as_py()), as_items(items), min_words)
            if gone:
                for name in ("doc_id", "text_key", "first_id"):
                    out[name].append(cols[name][k].as_py())
                pos = {r["place"]: r["pos"] for r in items}
                out["gone"].append([pos[x] for x in gone])
        return out

    aligned = map_arrow(both, run, "doc_id long, text_key long, first_id long, gone array<int>")
    return aligned.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("deleted"), F.array_sort(F.collect_set("first_id")).alias("partners"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row (all of docs' columns), text (what is left of it), deleted (places of lines) and partners, for each row of docs."""
    gone = materialise(deletions(docs, min_words), "deleted")
    own = carried(docs, doc_id=F.col("doc_id").cast("long"), text_key=_key())
    # always by shuffle, so the plan is the same at any size; the small side is hashed, the texts are not sorted
    joined = own.join(gone.hint("shuffle_hash"), ["doc_id", "text_key"], "left")
    left = F.array_join(F.filter(_lines(F.col("row.text")), lambda _, i: ~F.array_contains("deleted", i)), "\n")
    text = F.when(F.col("deleted").isNull(), F.col("row.text")).otherwise(left)
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return joined.select("row", text.alias("text"), F.coalesce("deleted", empty("int")).alias("deleted"), F.coalesce("partners", empty("bigint")).alias("partners"))


def digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_deleted, deleted_lines, partners and the sha256 of what is left, for each row."""
    rows = without_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words)
    return rows.select("row.doc_id", F.size("deleted").cast("long").alias("n_deleted"), F.col("deleted").alias("deleted_lines"), "partners", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with repeated blocks gone; n_chars, if there, follows the text."""
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.size("deleted") > 0, length).otherwise(F.col("row.n_chars")))
    return without_repeats(docs, min_words).select(row.alias("row")).select("row.*")
