"""Manifest, prefix trie and packing against plain versions that hold everything at once; n-gram counts beyond 32 bits; what a classifier chain is trained on."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinespark.llm import bpe, conversations, katz, merkle, ordered, packing, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, part int, key string"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def docs_of(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en" if i else None, s, len(t) if t else None, "x", 3, "k") for i, t, s in rows], DOCS)


# --- ranks and running sums


def test_ranks_and_sums_go_on_across_partitions(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot"]), rng.randrange(50), rng.randrange(1 << 40)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(7)
    own = df.withColumn("w", F.col("v") % 97).withColumn("tie", F.monotonically_increasing_id())
    got = ordered.scanned(own, ["k", "o", "v", "tie"], "test", key="k", sums={"v": 0, "w": 97}).collect()
    at = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["k"], r["rank"])):
        at[r["k"]].append(r)
    for k, own in at.items():
        want = sorted((o, v) for a, o, v in rows if a == k)
        assert [(r["o"], r["v"]) for r in own] == want and [r["rank"] for r in own] == list(range(len(want)))
        assert [r["sum_v"] for r in own] == np.cumsum([v for _, v in want]).tolist()
        assert [r["sum_w"] for r in own] == (np.cumsum([v % 97 for _, v in want]) % 97).tolist()
    every = ordered.scanned(df.select("v"), ["v"], "test").collect()
    assert sorted(r["rank"] for r in every) == list(range(3000))
    assert [r["v"] for r in sorted(every, key=lambda r: r["rank"])] == sorted(v for *_, v in rows)
    assert ordered.scanned(df.filter("false"), ["v"], "test").count() == 0


# --- manifest


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(nodes):
    """Root and, for each node, its siblings level by level with its place among them."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            paths[k].append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
        nodes, at = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    leaf = lambda d, s, la, n, t: sha(*map(field, (d, s, la, n, t)))
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names]
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(names, trees, tops, strict=True):
        for (_, _, own, r), path in zip(sorted(by[s], key=lambda x: x[:3]), paths, strict=True):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf(*r[:4], text)
            for place, siblings in path + top:
                node = sha(*siblings[:place], node, *siblings[place:])
            out.append((r[0], own, subroot, root, sha(*[x for _, some in path + top for x in some]), node, node == root))
    return sorted(out, key=repr)


def told(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_equals_the_plain_tree(spark):
    rng = random.Random(1)
    rows = [(i, f"line {i}\nnext é{'\n' * (i % 3)}", rng.choice(["big", "big", "big", "b", "ü", "Z"])) for i in range(400)]
    rows += [(None, "no id\n", "b"), (None, None, None), (7, "", None), (7, "", None), (8, "\n", "one"), (9, "long " * 50_000 + "\n", "long"), (-4, None, "b")]
    df = docs_of(spark, rows)
    want = plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()])
    assert told(merkle.verified_edits(df)) == want
    assert {w[6] for w in want} == {True, False}


@pytest.mark.parametrize(("sizes", "levels"), [((1,), 2), ((2, 1, 1), 1), ((9,), 1), ((10, 9, 28), 1), ((81, 1, 3), 2), ((82, 27), 3), ((1,) * 30, 1)])
def test_blocks_of_any_size_give_the_same_tree(spark, sizes, levels):
    rows = [(100 * k + i, f"t{i}", f"s{k:02}") for k, n in enumerate(sizes) for i in range(n)]
    df = docs_of(spark, rows)
    got = merkle.manifest(df, levels=levels).withColumn("proof", merkle.proof_of(F.col("path"))).withColumn("back", merkle.folded_root("leaf", "path")).collect()
    want = {w[0]: w for w in plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()])}
    assert len(got) == len(rows)
    for r in got:
        assert (r["leaf"], r["subroot"], r["root"], r["proof"]) == want[r["doc_id"]][1:5] and r["back"] == r["root"]


def test_manifest_of_an_empty_table_and_refusals(spark):
    df = docs_of(spark, [])
    assert merkle.verified_edits(df).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(df, levels=0)


def test_manifest_on_a_given_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in d.collect()])
    assert told(queries.op11_merkle_manifest(spark, sf)) == want


# --- prefix trie


def plain_trie(rows):
    """rows: conv_id, turn, role, text."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    new = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        new[c] = turns.get(base, [])[:h] + t[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            members[tuple(new[c][:d])].append(c)
        ends[tuple(new[c])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(total[x][1] for x in children[p])
        total[p] = (sum(total[x][0] for x in children[p]) or 1, saved)
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), *total[p], sha(",".join(map(str, ends[p])))) for p, m in members.items()
    )


TURNS = "conv_id long, turn long, role string, text string, depth int, fp string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "f") for r in rows], TURNS)


def nodes_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def conversation_rows(seed=3, convs=260):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randrange(9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "a", "", "ü💡"])))
    rows += [(900, None, None, None), (900, 2, "user", "x"), (900, 2, "user", "x"), (None, 1, "user", "lost"), (-205, 0, "user", "minus"), (-200, 0, "user", "base"), (-200, 1, None, "b")]
    rows += [(1000 + k, t, "user", f"chain {t}") for k in range(12) for t in range(k + 1)]
    rows += [(2000, t, "user", "long " * 3000 if t == 4 else "turn") for t in range(90)]
    rows += [(3001 + k, t, "bot", f"same {t}") for k in range(60) for t in range(7)]
    return rows


def test_trie_equals_the_plain_trie(spark):
    rows = conversation_rows()
    random.Random(1).shuffle(rows)
    got = conversations.prefix_trie(turns_of(spark, rows).repartition(5))
    assert nodes_of(got) == plain_trie(rows)


def test_collisions_split(spark):
    """With primes this small most groups hold several sequences, until the second fingerprint."""
    rows = conversation_rows(seed=8, convs=60)
    convs, own = conversations.rebuilt(conversations.materialise(conversations.numbered(turns_of(spark, rows)), "test"))
    assert nodes_of(conversations.trie(convs, own, primes=(5, 3))) == plain_trie(rows)


def test_trie_of_few_or_no_turns(spark):
    assert conversations.prefix_trie(turns_of(spark, [])).count() == 0
    c = next(c for c in range(201, 300) if zlib.crc32(b"%d" % c) % 6 > 0)
    alone = [(c, 0, "user", "gone: the first turns come from a conversation that isn't there")]
    assert nodes_of(conversations.prefix_trie(turns_of(spark, alone))) == plain_trie(alone) == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


def test_trie_on_a_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(queries.op12_conversation_trie(spark, sf)) == plain_trie(rows)


# --- packing


def ids_by_library():
    known = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    known.no_truncation()
    known.no_padding()
    return lambda text: known.encode(text or "", add_special_tokens=False).ids + [1]


def check_pieces(got, texts):
    """texts: (doc_id, text), ids may repeat. Every id once, sequences gapless and within the capacity."""
    library = ids_by_library()
    want = defaultdict(int)
    for doc, text in texts:
        ids = np.array(library(text), "<u4")
        want[doc, len(ids)] += len(ids)
    have, by = defaultdict(int), defaultdict(list)
    for r in got:
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
        by[r["sequence_id"]].append(r)
        assert r["length"] > 0 and r["start"] + r["length"] <= r["doc_tokens"]
    assert have == want
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    sizes = [sum(r["length"] for r in own) for own in by.values()]
    return sizes


def test_packing_on_a_given_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op13_pack_sequences(spark, sf).collect()
    sizes = check_pieces(got, docs)
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)  # nothing is padded
    library, texts = ids_by_library(), dict(docs)
    for doc in {r["doc_id"] for r in got}:
        ids, at = np.array(library(texts[doc]), "<u4"), 0
        for r in sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)


def test_packing_of_odd_rows(spark):
    texts = [(None, None), (None, ""), (1, "twice"), (1, "twice"), (2, "a<|endoftext|> b <|endoftext|>"), (3, "word " * 40_000), (4, "x" * 3000 + "  \n\t  é\u0085 z"), (5, "\x1c\x1d 's'll don't ９９ ٣ 漢字 🙂")]
    got = packing.pieces(packing.sequences(docs_of(spark, [(i, t, "s") for i, t in texts]).repartition(3))).collect()
    check_pieces(got, texts)
    library = ids_by_library()
    for doc in (2, 3, 4, 5):
        parts = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["start"])
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in parts), "<u4").tolist() == library(dict(texts)[doc])
    assert packing.digest(docs_of(spark, [])).count() == 0


def test_padding_of_sequences(spark):
    packed = packing.sequences(docs_of(spark, [(k, "some words here " * (k + 1), "s") for k in range(9)]).coalesce(1), capacity=100, cut=False)
    for r in packing.padded(packed, 100, 9).collect():
        n = r["n_tokens"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 100)
    assert check_pieces(packing.pieces(packed).collect(), [(k, "some words here " * (k + 1)) for k in range(9)])


@pytest.mark.parametrize("seed", range(12))
def test_windows_hold_every_part_once(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 2048, rng.integers(1, 400))
    for deal in (packing.filled, packing.whole):
        out, at = deal(sizes), defaultdict(list)
        for window in out:
            assert 0 < sum(p[2] for p in window) <= 2048
            for i, start, length in window:
                at[i].append((start, length))
        for i, parts in at.items():
            end = 0
            for start, length in sorted(parts):
                assert start == end
                end += length
            assert end == sizes[i]
        assert len(at) == len(sizes)
    assert all(sum(p[2] for p in w) == 2048 for w in packing.filled(sizes)[: int(sizes.sum()) // 2048])


def plain_differencing(sizes, k):
    """Karmarkar and Karp's method on whole tuples: the sums of the windows it ends with."""
    parts = [(sorted([s] + [0] * (k - 1), reverse=True), [s] + [0] * (k - 1)) for s in sizes]
    parts = [sorted(p[1], reverse=True) for p in parts]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1], reverse=True)
        a, b, *parts = parts
        parts.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return parts[0]


@pytest.mark.parametrize("seed", range(6))
def test_differencing_equals_whole_tuples(seed):
    """Distinct imbalances, so that no tie is broken in two ways."""
    rng = np.random.default_rng(seed)
    sizes, k = rng.choice(10**9, 40, replace=False) + 1, int(rng.integers(2, 9))
    label = packing.differenced(sizes, k)
    assert sorted(np.bincount(label, sizes, k).astype(int).tolist(), reverse=True) == plain_differencing(sizes.tolist(), k)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_conversation_trie"])
def test_sql_agrees_on_odd_rows(spark, name):
    """The SQL on nulls, repeats and missing bases too."""
    import duckdb

    con = duckdb.connect()
    rows = [(k, f"t{k}\n{k % 3}", ["a", "b", None, "a", "ü"][k % 5]) for k in range(60)] + [(None, None, None), (None, "\n", "a"), (3, "\n", "Z"), (3, "\n", "Z")]
    if name.startswith("op11"):
        own = docs_of(spark, rows)
        con.register("documents", own.toArrow())
        want = told(merkle.verified_edits(own))
    else:
        own = turns_of(spark, conversation_rows(seed=4, convs=120))
        con.register("conversations", own.toArrow())
        want = nodes_of(conversations.prefix_trie(own))
    out = con.sql(queries.oracle_sql()[name])
    columns = COLUMNS if "conv_id" in out.columns else ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(out.select(*columns).fetchall(), key=repr) == sorted(want, key=repr)


# --- n-gram counts


def test_counts_over_32_bits_are_summed_whole(spark):
    """Three blocks that saw the same n-grams over three thousand million times each."""
    keys, counts = np.array([5, 9, 2**63 + 1], np.uint64), np.array([3_000_000_000, 1, 4_294_967_295], np.uint32)
    katz.ready(spark)
    asked = spark.createDataFrame([(0, b, bytearray(katz._packed(keys)), bytearray(katz._packed(counts)), bytearray(b"")) for b in range(3)], katz._ASKED)
    told = katz._answers(asked, 1, 1)
    table = {r["gram"]: r["count"] for r in katz.ngrams(told).collect()}
    assert table == {5: 9_000_000_000, 9: 3, 1 - 2**63: 12_884_901_885}
    for r in told.filter("block is not null").collect():
        assert katz._unpacked(bytes(r["counts"]), np.uint64).tolist() == [9_000_000_000, 3, 12_884_901_885]
    assert told.filter("stats is not null").first()["stats"][-2:] == [3, 21_884_901_888]


# --- classifier chain


def test_a_later_model_is_trained_with_probabilities_of_models_that_did_not_see_the_row(monkeypatch):
    """Each row has a word of its own, so a model can tell which rows it saw."""
    fits = []

    class Remembers:
        def __init__(self, rows, label, earlier):
            self.seen = set(rows.place.tolist())
            fits.append((self.seen, earlier.copy()))

        def probability(self, rows, earlier):
            return np.array([0.9 if p in self.seen else 0.1 for p in rows.place.tolist()])

    monkeypatch.setattr(toxicity, "Linear", Remembers)
    n = 60
    rows = toxicity.Rows(np.arange(n), np.arange(n + 1))
    fold = np.arange(n) % toxicity.FOLDS
    chain = toxicity.Chain(["a", "b"]).fit(rows, [np.zeros(n), np.zeros(n)], fold)
    assert len(chain.models) == 2 and len(fits) == 2 + toxicity.FOLDS
    everything, *folds, last = fits
    assert everything[0] == last[0] == set(range(n))
    assert sorted(tuple(sorted(set(range(n)) - seen)) for seen, _ in folds) == sorted(tuple(np.flatnonzero(fold == f)) for f in range(toxicity.FOLDS))
    assert last[1].shape == (n, 1) and (last[1] == 0.1).all()  # in training: none saw its row
    assert (chain.predict(rows)[:, 1] == 0.9).all()  # in use: the models of all rows


def test_an_id_that_repeats_is_one_training_row(spark, monkeypatch):
    """However often a labelled id comes, the driver gets one row of it."""
    got = []
    fit = toxicity.Chain.fit
    monkeypatch.setattr(toxicity.Chain, "fit", lambda self, rows, labels, fold: got.append(rows.n) or fit(self, rows, labels, fold))
    docs = spark.createDataFrame([(i % 40, f"word{i % 40} plain text {'good' if i % 2 else 'bad'}") for i in range(400)] + [(7, None)] * 200, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(7, None, 1), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    assert got == [40] and toxicity.score(docs, chain).count() == 600
