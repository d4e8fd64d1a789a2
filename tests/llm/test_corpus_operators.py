"""The ten operators and the pipeline's stages: brute force on small fixtures, and nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kinespark.llm import bpe, fingerprints, katz, language_id, line_dedup, mixing, near_copies, simhash, topk, toxicity, training_order
from kinespark.llm.components import star_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark int"


def words(seed, n, vocabulary=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


LONG = "abc" * 20_000
TEXTS = [
    words(1, 40), words(1, 40), None, "", "one", "two words", words(2, 80) + "\n" + words(3, 60), words(4, 30) + "\n" + words(3, 60) + "\nend", "Ünïcode ß 日本語 <|endoftext|> x", LONG, words(5, 300), "  \n\t ", words(1, 39) + " changed", words(6, 3000, 10**6),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "c"][i % 4], None, i) for i, t in enumerate(TEXTS)]
    rows += [(0, TEXTS[0], "en", "b", None, 99), (None, words(7, 20), None, None, None, 98)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        language_id.identify(empty), fingerprints.fingerprint_edits(empty), mixing.mix(empty), mixing.mixed_documents(empty), toxicity.score(empty, toxicity.train(empty, labels)), toxicity.reject_toxic(empty, labels),
        training_order.digest(empty, bpe.vocabulary_path("byte_bpe_50k.tiktoken")), simhash.near_duplicates(empty), simhash.representatives(empty), bpe.round_trip(empty, bpe.vocabulary_path()), katz.score_documents(empty),
        line_dedup.digest(empty), line_dedup.deduplicated(empty), topk.top_k(*[topk.vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))] * 2),
    ]
    assert [df.count() for df in made] == [0] * len(made)


# 1


def test_language_forward_sums_all_segmentations(spark):
    model = language_id.LanguageModel(["x", "y"], np.random.default_rng(0).dirichlet(np.ones(len(language_id.pieces(PIECES)) + 1), 2), PIECES)
    lattice, batch = language_id.Lattice(language_id.pieces(PIECES)), language_id.Batch(model)

    def brute(word, p):
        if not word:
            return 1.0
        known = language_id.pieces(PIECES)
        total = 0.0
        for k in range(1, len(word) + 1):
            piece = known.get(word[:k])
            if piece is None and k == 1:
                piece = len(known)
            if piece is not None:
                total += p[piece] * brute(word[k:], p)
        return total

    for word in ("▁the", "▁señor", "▁日本x", "▁a"):
        for k in range(2):
            want = math.log(brute(word, model.table[k]))
            assert math.isclose(language_id._forward(lattice.arcs(word), model.table[k].tolist())[-1], want, rel_tol=1e-9)
            assert math.isclose(batch.logs([word])[0, k], want, rel_tol=1e-9)


PIECES = bpe.vocabulary_path("piece_bpe_32k.model")


def segmentations(word, known, unknown):
    """All ways to cut a word into pieces, as lists of their numbers."""
    if not word:
        return [[]]
    out = []
    for k in range(1, len(word) + 1):
        piece = known.get(word[:k], unknown if k == 1 else None)
        if piece is not None:
            out += [[piece, *rest] for rest in segmentations(word[k:], known, unknown)]
    return out


def brute_identify(rows, modulus=5):
    """Learns and predicts by listing every segmentation of every word."""
    known = language_id.pieces(PIECES)
    cut = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    ways = {w: segmentations(language_id.MARK + w, known, len(known)) for _, t, _ in rows for w in cut(t)}
    train = [(lang, w) for i, t, lang in rows if lang and t is not None and zlib.crc32(str(i).encode()) % modulus for w in cut(t)]
    names = sorted({lang for i, t, lang in rows if lang and t is not None and zlib.crc32(str(i).encode()) % modulus})
    start = np.exp(-0.5 * np.array([*(len(x) for x in known), 8]))
    p = {x: start / start.sum() for x in names}
    for _ in range(language_id.ROUNDS):
        sums = {x: np.full(len(known) + 1, language_id.SMOOTH) for x in names}
        for (lang, w), n in Counter(train).items():
            shares = [math.prod(p[lang][k] for k in way) for way in ways[w]]
            for share, way in zip(shares, ways[w], strict=True):
                for k in way:
                    sums[lang][k] += n * share / sum(shares)
        p = {x: sums[x] / sums[x].sum() for x in names}
    out = {}
    for i, t, _ in rows:
        logs = [sum(math.log(sum(math.prod(p[x][k] for k in way) for way in ways[w])) for w in cut(t)) for x in names]
        best = int(np.argmax(logs))
        out[i] = (names[best], 1 / sum(math.exp(x - logs[best]) for x in logs)) if cut(t) else ("und", 0.0)
    return out


def test_languages_are_those_of_all_segmentations(spark):
    rng = np.random.default_rng(21)
    pool = {"aa": ["der", "und", "haus", "nicht"], "bb": ["the", "and", "house", "not"], "cc": ["le", "et", "maison", "pas"]}
    rows = [(i, " ".join(rng.choice(pool[x], 3)) + rng.choice(["", ", Été", " 7 x-y", " 日本"]), x) for i, x in enumerate([*pool] * 10)] + [(30, "... 12", "aa"), (31, None, None)]
    want = brute_identify(rows)
    for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        assert r.lang_pred == want[r.doc_id][0] and math.isclose(r.score, want[r.doc_id][1], rel_tol=1e-6, abs_tol=1e-9)


def test_words_of_any_length_are_learnt():
    known = language_id.pieces(PIECES)
    p = np.full(len(known) + 1, 1e-5).tolist()
    for n in (3, 70, 3000):
        word = language_id.MARK + "ab" * n
        got = Counter()
        for k, x in language_id.expected_counts(language_id.Lattice(known), word, p):
            got[k] += x
        names = [*known, "?"]
        assert math.isclose(sum(x * len(names[k]) for k, x in got.items()), len(word), rel_tol=1e-6)


def test_languages_are_told_apart(spark, docs):
    en, fr = "the cat and the dog are here with that house", "le chat et les chiens sont dans une maison avec nous"
    rows = [(i, " ".join(np.random.default_rng(i).permutation((en if i % 2 else fr).split())), "en" if i % 2 else "fr") for i in range(60)] + [(60, "123 !!", "en"), (61, None, "fr")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") and 0.5 <= got[i].score <= 1 for i in range(60))
    assert got[60].lang_pred == got[61].lang_pred == "und" and got[60].score == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert language_id.identify(docs).count() == docs.count()


# 2


def test_fingerprints(spark, docs):
    rows = sorted(((-1 if i is None else i), t or "") for i, t in [(r.doc_id, r.text) for r in docs.collect()])
    got = defaultdict(list)
    for r in fingerprints.fingerprint_edits(docs).collect():
        got[-1 if r.doc_id is None else r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        assert any(r.edited_sha256 == sha and r.n_chars == len(t) and 0 <= r.near_edited <= 1 for r in got[i])
    same = {r.fingerprint for i in (0, 1) for r in got[i]}
    assert len(same) == 1 and got[3][0].fingerprint == ""


def brute_sketch(text):
    """Hashes by Spark's rule: XXH64 of a word with seed 42, of a shingle with each hash's bytes seeded by the one before."""
    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    every = set()
    for i in range(max(1, len(h) - 4)) if h else []:
        x = 42
        for one in h[i : i + 5]:
            x = xxhash.xxh64_intdigest(one.to_bytes(8, "little", signed=True), x)
        every.add(x & (2**63 - 1))
    few = {x for x in every if x < 2**63 * fingerprints.FRACTION}
    return few or ({min(every)} if every else set())


def brute_containment(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b))


def test_sketches_and_likenesses(spark):
    """Against plain sets, with ids and texts that a third of all rows share, over several ranges."""
    rng = np.random.default_rng(31)
    rows = [(i, words(300 + i, int(rng.integers(0, 120)), 50)) for i in range(60)] + [(7, words(400 + i, 30)) for i in range(40)] + [(7, "same text of seven words or so")] * 40 + [(None, "x y"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = lambda r: (-(2**63) if r[0] is None else r[0], _xx(r[1]))
    ordered = sorted([(i, t or "") for i, t in rows], key=key)
    got = defaultdict(list)
    for r in fingerprints.fingerprint_edits(df).collect():
        got[r.doc_id].append((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)))
    want = defaultdict(list)
    text = lambda s: "".join(f"{x:016x}" for x in sorted(s))
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(after)
        want[i].append((len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), round(brute_containment(a, b), 9), round(brute_containment(a, c), 9)))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    own = fingerprints.with_next(df, range_bytes=500)
    assert own.filter("tail = 0").groupBy("part").count().agg({"count": "max"}).first()[0] < 60


def _xx(text):
    x = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return x - 2**64 if x >= 2**63 else x


def test_merged_sketches(spark):
    one, two = words(11, 200), words(12, 4000, 10**5)
    df = spark.createDataFrame([(one, two)], "a string, b string").select(*[fingerprints.sketch(__import__("pyspark").sql.functions.col(c)).alias(c) for c in "ab"])
    r = df.select("a", "b", fingerprints.merge(df["a"], df["b"]).alias("m")).first()
    assert sorted(set(r.a) | set(r.b)) == r.m and 0.7 < len(r.b) / 3996 / fingerprints.FRACTION < 1.3


# 3


def test_water_level_is_that_of_repeated_clamping(spark):
    sizes = {"a": 100.0, "b": 5.0, "c": 40.0, "d": 1.0, "e": 300.0, "f": 0.0}
    weights = dict(zip(sizes, (5.0, 2.0, 1.0) * 2, strict=True))
    df = spark.createDataFrame([(s, int(n), weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(df).collect()}
    capped: dict = {}
    while True:
        left = sum(sizes.values()) - sum(capped.values())
        free = [s for s in sizes if s not in capped]
        want = capped | {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if want[s] > 3 * sizes[s]]
        if not over:
            break
        capped |= {s: 3 * sizes[s] for s in over}
    assert all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in sizes)


def test_mix(spark, docs):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), None, f"s{i % 7}", None, 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    taken, target = Counter(), {}
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)
    assert sorted(got) == sorted(mixing.mix(df.repartition(5)).collect())
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in got)
    assert mixing.mix(docs).count() == docs.count()


# 4


def test_toxic_words_and_stems_are_found(spark):
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        text = words(1000 + i, 60, 3000) + (f" grobz{'abc'[i % 3]} und schlim" if toxic else "")
        rows.append((i, text, None, None, None, i))
        labels.append((i, 1 - (i % 4 == 0), int(toxic)))
    rows.append((500, None, None, None, None, 0))
    df = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame([*labels[:400], (None, 1, 1), (7, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, lab)
    got = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    assert all(got[i].toxic == (i % 5 == 0) for i in range(400, 500)) and not got[500].toxic and len(got) == 501
    kept = toxicity.reject_toxic(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].toxic}


def test_toxic_scores_are_the_chains_by_hand(spark):
    """Features and both models' sums word by word, with the weights that were fitted."""
    rows = [(i, words(1100 + i, 30, 200) + (" grob" if i % 3 == 0 else ""), None, None, None, i) for i in range(120)] + [(120, "x" * 5000 + " grob " * 3000, None, None, None, 0), (120, "", None, None, None, 0), (None, "grob", None, None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    chain = toxicity.train(df, spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(100)], "doc_id long, quality int, toxic int"))
    place = lambda w, n: xxhash.xxh64_intdigest((w[:n] if n else w).encode(), xxhash.xxh64_intdigest(n.to_bytes(4, "little"), 42))

    def by_hand(text):
        said = []
        own = {(x - 2**64 if (x := place(w, n)) >= 2**63 else x) % (1 << toxicity.BITS) for w in {*re.findall(r"[^\W\d_]+", text.lower())} for n in (0, 4, 6)}
        for m in chain.models:
            z = None if m.base is None else sum(m.weights[k] for k in own) + sum(a * b for a, b in zip(said, m.more, strict=True)) + m.base
            said.append(m.share if z is None else 1 / (1 + math.exp(-z)))
        return said

    want = Counter((i, *(round(x, 9) for x in by_hand(t or ""))) for i, t, *_ in rows)
    assert Counter((r.doc_id, round(r.p_low_quality, 9), round(r.p_toxic, 9)) for r in toxicity.score(df, chain).collect()) == want


# 5


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = training_order.Permutation(n, "k")
        assert sorted(p.slot(np.arange(n))) == list(range(n)) and (p.number(p.slot(np.arange(n))) == np.arange(n)).all()
    assert (training_order.Permutation(1000, "a").slot(np.arange(1000)) != training_order.Permutation(1000, "b").slot(np.arange(1000))).any()


def test_training_order(spark, docs, tmp_path):
    ranks, path = bpe.vocabulary_path("byte_bpe_50k.tiktoken"), str(tmp_path / "order")
    total = training_order.materialise_order(docs, path, ranks, span=50)
    got = training_order.read_order(spark, path, span=50).collect()
    assert sorted(r.slot for r in got) == list(range(total)) and all((r.shard, r.record) == divmod(r.slot, 50) for r in got)
    later = training_order.read_order(spark, path, from_slot=70, span=50).collect()
    assert {r.slot: r.ids for r in later} == {r.slot: r.ids for r in got if r.slot >= 70}


def test_slots_are_the_permuted_numbers_of_the_librarys_ids(spark, docs, library, tmp_path):
    """Rows in one partition, so numbers follow their order; ids by the other library with the same vocabulary."""
    one = spark.createDataFrame(docs.collect(), SCHEMA).coalesce(1)
    path = str(tmp_path / "order")
    total = training_order.materialise_order(one, path, bpe.vocabulary_path("byte_bpe_50k.tiktoken"), key="k", length=16, span=1000, waves=3)
    library.encode_special_tokens = True
    want = []
    for r in one.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, training_order.END]
        want += [(r.doc_id, k // 16, ids[k : k + 16]) for k in range(0, len(ids), 16)]
    library.encode_special_tokens = False
    order = training_order.Permutation(total, "k")
    got = {r.slot: (r.doc_id, r.part, np.frombuffer(r.ids, "<u2").tolist()) for r in training_order.read_order(spark, path, length=16, span=1000).collect()}
    assert total == len(want) and got == {int(order.slot(np.array([n]))[0]): x for n, x in enumerate(want)}
    size = training_order.record_type(16).itemsize
    shards = sorted(tmp_path.glob("order/shard=*"), key=lambda p: int(p.name[6:]))
    assert [f.stat().st_size for s in shards for f in s.glob("part*")] == [size * min(1000, total - k) for k in range(0, total, 1000)]


# 6


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(nodes, linked):
    label = dict(zip(nodes, nodes, strict=True))
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_simhash(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    fp = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    want = brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert len(got) == len(rows)
    assert all(r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_large_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(0)
    fps = {0}
    for _ in range(150):
        x = int(rng.choice([0, 2**63 + 5]))
        for b in rng.integers(0, 64, int(rng.integers(0, 6))):
            x ^= 1 << int(b)
        fps.add(x)
    signed = np.array(sorted(fps), np.uint64).view(np.int64)
    roots = {r.node: r.root for r in star_components(simhash.links(spark.createDataFrame([(int(x),) for x in signed], "fp long"))).collect()}
    nodes = [int(x) for x in signed]
    want = brute_components(sorted(nodes), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {n: roots.get(n, n) for n in nodes} == want


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (3, 2)]
    got = {r.node: r.root for r in star_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def brute_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_near_copies_are_those_of_similar_shingles(spark, monkeypatch):
    """Copies edited more or less, in runs longer than a block; the pipeline's stage keeps one of each group of similar
    shingles or near fingerprints."""
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng, texts = np.random.default_rng(8), ["", None, "one", "One", "a b c d e", "a b c d f"]
    for base in range(6):
        one = words(200 + base, 200, 10**5).split()
        texts.append(" ".join(one))
        for _ in range(12):
            copy = list(one)
            for at in rng.integers(0, 200, int(rng.integers(1, 8))):
                copy[at] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    sets, fps = [brute_shingles(t) for t in texts], [brute_fingerprint(t) for t in texts]
    want = brute_components(range(len(texts)), lambda a, b: brute_similar(sets[a], sets[b]) or (fps[a] ^ fps[b]).bit_count() <= 3)
    df = spark.createDataFrame([(i, t, None, None, 0, i) for i, t in enumerate(texts)], SCHEMA)
    kept = [r.doc_id for r in dict(corpus_pipeline.STAGES)["near-dedup"](spark, df, "").collect()]
    assert sorted(kept) == sorted(set(want.values())) and 10 < len(kept) < 60


def test_chains_that_leads_do_not_link(spark, monkeypatch):
    """One run of two chains of texts, of which only neighbours are similar, and its largest component so far."""
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    chains = [words(240 + k, 300, 10**5).split() for k in range(2)]
    texts = [" ".join(chain[at : at + 120]) for chain in chains for at in range(0, 120, 10)]
    sets = [brute_shingles(t) for t in texts]
    want = brute_components(range(len(texts)), lambda a, b: brute_similar(sets[a], sets[b]))
    assert len(set(want.values())) == 2
    led = spark.createDataFrame([(7, k, len(texts), 3) for k in range(len(texts))], "key long, words_key long, n long, lead long")
    df = spark.createDataFrame(list(enumerate(texts)), "words_key long, text string")
    first = star_components(near_copies.lead_links(led, df))
    assert {r.node: r.root for r in first.collect()} == {3: 2, 4: 2}
    rest = near_copies.rest_links(led, df, first).unionByName(first.selectExpr("node as a", "root as b"))
    got = {r.node: r.root for r in star_components(rest).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


def test_pairs_at_the_limit_share_a_band():
    rng, found = np.random.default_rng(9), 0
    for _ in range(400):
        pool = rng.integers(0, 2**64, 120, np.uint64)
        a, b = near_copies.bands([np.unique(pool[:108]), np.unique(pool[12:])])  # 96 of 120: 0.8
        found += bool((a == b).any())
    assert found >= 399


def test_common_hashes():
    rng = np.random.default_rng(10)
    each = [np.unique(rng.integers(0, 50, int(n)).astype(np.uint64)) for n in rng.integers(0, 40, 30)]
    assert near_copies.common(each).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in each] for a in each]


def test_each_group_of_near_copies_keeps_one_row(spark):
    """Rows of one id in different groups, and null ids."""
    x, y, z = (words(220 + k, 50, 10**5) for k in range(3))
    rows = [(1, x), (5, x), (5, y), (None, y), (None, z), (None, z), (5, y)]
    df = spark.createDataFrame([(i, t, None, None, 0, 0) for i, t in rows], SCHEMA)
    assert sorted((r.doc_id or 0, r.text) for r in near_copies.representatives(df).collect()) == sorted([(1, x), (5, y), (0, z)])


# 7


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_encoding_is_the_librarys(library):
    rng, enc = np.random.default_rng(5), bpe.encoder(bpe.vocabulary_path())
    some = ["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "日本", "1", "'s", "!!", "<|endoftext|>", "😀", "----", "aaaa", " \n", "\r\n"]
    texts = ["".join(rng.choice(some, int(n))) for n in rng.integers(0, 40, 400)] + ["a" * 3000, "ab" * 2000, " " * 900 + "x", "é" * 800, "".join(rng.choice(list("abcdefgh"), 4000))]
    for text, ids in zip(texts, enc.encode_many(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == want
        assert "".join(enc.decode_stream([got[:3], got[3:4], got[4:]])) == library.decode(want, skip_special_tokens=False)


def test_streamed_chunks_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    enc, rng = bpe.encoder(bpe.vocabulary_path()), np.random.default_rng(6)
    some = ["a", "the", " ", "  ", " word", "\n", "\x1c", "é", "日本", "12", "'s", "!!", "<|endoftext|>", "😀", "xyz" * 60]
    for n in rng.integers(0, 300, 60):
        text = "".join(rng.choice(some, int(n)))
        ids = [x for part in enc.stream(text) for x in part.tolist()]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert next(bpe._rounds([text], enc))[2] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_window_of_the_transducer_stays_small():
    table = bpe.merge_table(bpe.vocabulary_path())
    machine, rng = bpe.Transducer(table), np.random.default_rng(1)
    data = bytes(rng.choice(list(b"abcdeh "), 60_000))
    most = 0
    out = []
    for at in range(0, len(data), 500):
        out += machine.feed(data[at : at + 500])
        most = max(most, len(machine.buffer))
    out += machine.finish()
    assert b"".join(table.text[i] for i in out) == data and most <= 3 * machine.window + 500


def test_round_trip(docs, library):
    got = bpe.round_trip(docs, bpe.vocabulary_path()).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4")
        want[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want


# 8


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 60)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (300, 8)).astype(np.float32)
    v[100:140] = v[100]
    rows = [(i, v[i].tolist()) for i in range(300)] + [(350, None), (400, [float("nan")] + [0.0] * 7), (450, [None] + [0.0] * 7)]
    t = topk.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    for r in topk.top_k(t.filter("vec_id % 50 = 0"), t).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    for q in range(0, 300, 50):
        s = x @ x[q]
        assert got[q] == [(i, s[i]) for i in sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]]
    assert set(got) == set(range(0, 300, 50))


def test_top_k_of_odd_rows(spark):
    """Vectors of several lengths, repeated ids, ties, and a side without rows."""
    rows = [(0, [1.0, 2.0]), (0, [3.0, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0]), (4, [2.0]), (50, [4.0]), (100, []), (None, [1.0])]
    t = topk.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in topk.top_k(t.filter("vec_id % 50 = 0"), t).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    by = 256 * 256
    assert dict(got) == {0: [(1, 5 * by), (1, 5 * by), (2, 5 * by), (2, 5 * by)], 50: [(3, 20 * by), (4, 8 * by)]}
    assert topk.top_k(t.filter("vec_id < 0"), t).count() == topk.top_k(t, t.filter("vec_id < 0")).count() == 0


def test_searches_stop_on_proof():
    x = np.floor(256 * np.random.default_rng(7).normal(0, 0.125, (3000, 64))).astype(np.int64)
    index, none = topk.ImpactIndex(x), np.zeros((20, 3000), bool)
    found, read = index.search(x[:20], 5, none)
    for q, (places, scores) in zip(x[:20], found, strict=True):
        want = x @ q
        assert set(np.flatnonzero(want >= np.sort(want)[-5])) <= set(places.tolist()) and (want[places] == scores).all() and len(places) < 3000
    assert read < 20 * x.size and topk.skipped(x[:20], x, 5) > 0.05


# 9


def brute_discount(counts, most=5):
    """d(r) r of Good-Turing, from raw counts of counts, else from a line through their logarithms, else one number off."""
    n = Counter(counts.values())
    there = [r for r in range(1, most + 2) if n[r]]
    tries = [{r: float(n[r]) for r in range(1, most + 2)}]
    if len(there) > 1:
        slope, level = np.polyfit(np.log(there), np.log([n[r] for r in there]), 1)
        tries.append({r: math.exp(level + slope * math.log(r)) for r in range(1, most + 2)})
    for m in tries:
        if all(m.values()):
            over = (most + 1) * m[most + 1] / m[1]
            d = {r: ((r + 1) * m[r + 1] / (r * m[r]) - over) / (1 - over) for r in range(1, most + 1)} if over != 1 else {0: 0}
            if all(0 < x < 1 for x in d.values()):
                return lambda r: r * d.get(r, 1.0)
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return lambda r: r - off


def brute_katz(rows, order):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    cut = lambda t: [*(t or "").encode().lower().split(), katz.END]

    def grams(w, n):
        padded = [katz.START, *w]
        return [tuple(padded[k - n + 1 : k + 1]) for k in range(max(1, n - 1), len(padded))]

    counts = [Counter(g for i, t in rows if not held(i) for g in grams(cut(t), n)) for n in range(1, order + 1)]
    kept = [brute_discount(c) for c in counts]
    total, kinds = sum(counts[0].values()), len(counts[0])
    freed = total - sum(kept[0](r) for r in counts[0].values())
    followers = defaultdict(list)
    for c in counts[1:]:
        for g in c:
            followers[g[:-1]].append(g)

    def p(g):
        n = len(g)
        if n == 1:
            return kept[0](counts[0][g]) / total if g in counts[0] else freed / total
        own = followers.get(g[:-1])
        if not own:
            return p(g[1:])
        all_ = sum(counts[n - 1][x] for x in own)
        mass = sum(kept[n - 1](counts[n - 1][x]) for x in own)
        if mass >= all_ * (1 - 1e-12):
            all_ += 1
        if g in counts[n - 1]:
            return kept[n - 1](counts[n - 1][g]) / all_
        return (1 - mass / all_) / (1 - sum(p(x[1:]) for x in own)) * p(g[1:])

    out = []
    for i, t in rows:
        w = cut(t)
        padded = [katz.START, *w]
        score = sum(math.log10(p(tuple(padded[max(0, k - order + 1) : k + 1]) if order > 1 else (padded[k],))) for k in range(1, len(padded)))
        base = sum(math.log10((counts[0][(x,)] + 1) / (total + kinds + 1)) for x in w)
        out.append((i, held(i), len(w), sum((x,) in counts[0] for x in w), total, base, score))
    return out, p, counts


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(docs, rows, monkeypatch, order):
    got = sorted(map(tuple, katz.score_documents(docs, order=order).collect()), key=str)
    want, p, counts = brute_katz(rows, order)
    vocabulary = [g[0] for g in counts[0]]
    for context in [g[:-1] for g in [*counts[order - 1]][:15]]:
        assert math.isclose(sum(p((*context, w)) for w in vocabulary) + p((*context, b"never seen")), 1.0, rel_tol=1e-9)
    for g, x in zip(got, sorted(want, key=str), strict=True):
        assert g[:5] == x[:5] and np.allclose(g[5:], x[5:], rtol=1e-9)
    monkeypatch.setattr(katz, "BLOCK", 50)
    again = sorted(map(tuple, katz.score_documents(docs, order=order).collect()), key=str)
    assert np.allclose([g[6] for g in again], [g[6] for g in got])


def test_tables_of_ngrams(docs, rows):
    counted = katz.counted_blocks(docs, 2, 7, 2)[1]
    counts = brute_katz(rows, 2)[2]
    for n in (1, 2):
        got = katz.ngrams(counted[n - 1]).collect()
        assert Counter(r["count"] for r in got) == Counter(counts[n - 1].values()) and len({r.gram for r in got}) == len(got)


# 10


def test_line_dedup(spark, docs):
    passage = words(50, 55)
    half = [words(51, 26), words(52, 26)]
    rows = [
        (1, "own first\n" + passage + "\ntail"), (2, passage), (3, "x y z\n" + "\n".join(half) + "\nmore here"), (4, "\n".join(["start", *half, "rest"])), (5, half[1] + "\nbetween\n" + half[0]), (6, "short line\nown"), (7, "short line\nother"),
        (8, "p\n  " + passage + " \nq\n" + passage), (None, passage), (9, None), (2, passage),
    ]
    df = spark.createDataFrame([(i, t, None, None, len(t or ""), 0) for i, t in rows], SCHEMA)
    got = defaultdict(list)
    for r in line_dedup.digest(df).collect():
        got[r.doc_id].append(r)
    assert [r.n_deleted for r in got[1]] == [0] and [r.deleted_lines for r in got[2]] == [[0], [0]] and got[4][0].deleted_lines == [1, 2]
    assert got[5][0].n_deleted == got[6][0].n_deleted == got[7][0].n_deleted == 0 and got[8][0].deleted_lines == [1, 3]
    assert got[None][0].n_deleted == 0 and got[9][0].n_deleted == 0 and got[8][0].partners == [1]
    kept = {(r.doc_id, r.text): r.n_chars for r in line_dedup.deduplicated(df).collect()}
    assert kept[4, "start\nrest"] == 10 and (9, None) in kept and kept[2, ""] == 0
    assert line_dedup.digest(docs).count() == docs.count()


def test_passages_of_common_lines_are_found(spark):
    """Each line came first in another document and is in many of them; only the passage as a whole repeats."""
    lines = [words(70 + k, 8, 500) for k in range(8)]
    rows = [(10 * k + j, f"own {k} {j} here\n{line}") for k, line in enumerate(lines) for j in range(9)]
    rows += [(i, "\n".join([f"start of {i}", *lines, f"end of {i}"])) for i in (900, 901, 902)]
    got = {r.doc_id: r for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900].n_deleted == 0 and got[901].deleted_lines == got[902].deleted_lines == [*range(1, 9)]
    assert all(r.n_deleted == 0 for i, r in got.items() if i < 900)


def test_blank_lines_and_white_space_part_no_passage(spark):
    """Short paragraphs with blank lines between, more or fewer, and lines that end in a tab or CR."""
    parts = [words(90 + k, 20, 500) for k in range(5)]
    rows = [(1, "own\n" + "\n\n".join(parts)), (2, "\n\n".join(parts) + "\n\nmore"), (3, "x\r\n" + "\r\n".join(parts) + "\r\n"), (4, "\t\n\n".join(f"\t{p}\t" for p in parts)), (5, f"{parts[0]}\n \nother\n{parts[1]}")]
    got = {r.doc_id: r.deleted_lines for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0, 2, 4, 6, 8], 3: [1, 2, 3, 4, 5], 4: [0, 2, 4, 6, 8], 5: []}


def test_passages_are_the_shortest_runs():
    rng = np.random.default_rng(4)
    hashes = rng.integers(-(2**63), 2**63 - 1, 3)
    docs = [[(p, int(rng.choice(hashes)), int(rng.integers(1, 30))) for p in range(12) if rng.random() < 0.9] for _ in range(40)]
    row = np.repeat(np.arange(40), [*map(len, docs)])
    pos, line, n = (np.array([x[k] for d in docs for x in d]) for k in range(3))
    holders = np.array([int(np.flatnonzero(hashes == h)[0]) for h in line])
    at, rare, key = line_dedup.passages(row, pos, line, n, holders)
    want = set()
    for i in range(len(row)):
        for way in (1, -1):
            j = i
            while 0 <= j < len(row) and row[j] == row[i] and pos[j] - pos[i] == j - i:
                a, b = min(i, j), max(i, j) + 1
                if n[a:b].sum() >= 50:
                    want.add((a, tuple(line[a:b])))
                    break
                j += way
    assert len(at) == len(want) and {(a, r) for a, r in zip(at.tolist(), rare.tolist(), strict=True)} == {(a, min(x, key=lambda h: (int(np.flatnonzero(hashes == h)[0]), h))) for a, x in want}
    of = defaultdict(set)
    for (a, x), k in zip(sorted(want, key=lambda y: (y[0], len(y[1]))), key, strict=True):
        of[x].add(k)
    assert all(len(v) == 1 for v in of.values()) and len({*key.tolist()}) == len(of)


@pytest.mark.parametrize("seed", [0, 1])
def test_all_common_runs_of_a_corpus_are_deleted(spark, seed):
    """Random documents whose lines stand in one to a hundred of them, against every pair's common runs."""
    rng = np.random.default_rng(seed)
    pool = [words(500 + k, int(rng.choice([1, 2, 3, 8, 19, 26, 51])), 400) for k in range(60)]
    weight = 1.0 / np.arange(1, 61) ** 1.2
    rows = []
    for i in range(100):
        lines = [pool[k] for k in rng.choice(60, int(rng.integers(1, 12)), p=weight / weight.sum())]
        if i % 3 == 0:
            k = int(rng.integers(0, 50))
            lines[len(lines) // 2 : 0] = pool[k : k + 6]
        rows.append((i, "\n".join([*lines, rng.choice(["", " ", "\t"])])))
    want = {}
    items = {i: [(p, line, len(line.split())) for p, line in enumerate(x.strip() for x in t.split("\n") if x.strip())] for i, t in rows}
    for i, _ in rows:
        want[i] = sorted({p for j in range(i) for p in brute_blocks(items[j], items[i], 50)})
    got = {r.doc_id: r.deleted_lines for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and sum(map(bool, want.values())) > 20


def test_patience_matches_are_common_and_ascend():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = ([(i, int(h), 5) for i, h in enumerate(rng.integers(0, 12, int(n)))] for n in rng.integers(0, 15, 2))
        m = line_dedup.patience(a, b)
        assert all(a[x][1] == b[y][1] for x, y in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))


def brute_blocks(a, b, least):
    """Places of b in any run of so many words whose lines and distances stand in a too."""
    gone = set()
    for j in range(len(b)):
        for i in range(len(a)):
            k = 0
            while j + k < len(b) and i + k < len(a) and b[j + k][1] == a[i + k][1] and b[j + k][0] - b[j][0] == a[i + k][0] - a[i][0] == k:
                k += 1
            if sum(x[2] for x in b[j : j + k]) >= least:
                gone |= {x[0] for x in b[j : j + k]}
    return sorted(gone)


def test_blocks_are_all_common_runs():
    p1, q, p2, p3 = range(4)
    a, b = ([(i, h, 20) for i, h in enumerate(x)] for x in ([p1, q, p1, p2, p3], [p1, p2, p3]))
    assert line_dedup.common_blocks(a, b) == [0, 1, 2]
    rng, size, found = np.random.default_rng(11), [9, 20, 31, 14, 26, 50], 0
    for _ in range(3000):
        kinds = int(rng.integers(2, 7))
        a, b = ([(i, int(h), size[h]) for i, h in enumerate(rng.integers(0, kinds, int(rng.integers(0, 16)))) if rng.random() < 0.9] for _ in range(2))
        want = brute_blocks(a, b, 50)
        assert line_dedup.common_blocks(a, b) == want
        found += 0 < len(want) < len(b)
    assert found > 500


# pipeline


def test_columns_of_any_name_pass_through_the_stages(spark):
    """The values of columns that are named like the stages' own are those of their rows."""
    import corpus_pipeline

    names = ["mark", "row", "key", "id", "copies", "copy", "deleted", "partners", "place", "places", "tie", "text_key", "size", "_id", "_place", "_size", "_places", "_copies", "fp", "kind"]
    passage = words(50, 55)
    rows = [(i, [passage, words(600 + i, 60), words(600, 60)][i % 3] if i % 5 else None, "en", "ab"[i % 2], i, *[f"{n}{i}" for n in names]) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    df.createOrReplaceTempView("clashing")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, stage in [("toxicity", lambda: toxicity.reject_toxic(df, labels)), *((n, lambda f=f: f(spark, df, "")) for n, f in corpus_pipeline.STAGES[1:4]), ("simhash", lambda: simhash.representatives(df))]:
        got = stage()
        assert got.columns == df.columns, name
        out = got.collect()
        assert out and all(r[n] == f"{n}{r.doc_id}" for r in out for n in names), name
    assert dict(corpus_pipeline.STAGES)["bpe"](spark, df, "").count() == 24


def test_pipeline_rows_are_those_of_plain_versions(spark, tmp_path, library):
    """The whole run against plain Python: the chain's own scores, common runs of lines, similar shingles, SQL for the mix and
    the library for tokens."""
    import duckdb
    import pandas as pd

    import corpus_pipeline

    rng = np.random.default_rng(41)
    passage = [words(70 + k, 13, 500) for k in range(5)]
    rows, labels = [], []
    for i in range(90):
        text = words(800 + i, int(rng.integers(30, 90)), 3000)
        if i % 9 == 0:
            text = "\n".join([text, *passage, f"end {i}"])
        if i % 10 == 3:
            text = rows[i - 3][1].replace("w1", "w2", 1)
        if i % 6 == 1:
            text += " grobzeug schlimm"
        rows.append((i, text, "en", ["a", "b", None][i % 3], len(text)))
        labels.append((i, 1, int(i % 6 == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    bad = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).collect() if r.toxic}
    assert len(bad) >= 10
    texts = {i: t for i, t, *_ in rows if i not in bad}
    items = {i: [(p, line, len(line.split())) for p, line in enumerate(t.split("\n"))] for i, t in texts.items()}
    cut = {}
    for i, t in texts.items():
        gone = {p for j in texts if j < i for p in brute_blocks(items[j], items[i], 50)}
        cut[i] = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
    sets, fps = {i: brute_shingles(t) for i, t in cut.items()}, {i: brute_fingerprint(t) for i, t in cut.items()}
    group = brute_components(sorted(cut), lambda a, b: brute_similar(sets[a], sets[b]) or (fps[a] ^ fps[b]).bit_count() <= 3)
    kept = sorted(set(group.values()))
    documents = pd.DataFrame({"doc_id": kept, "text": [cut[i] for i in kept], "source": [rows[i][3] for i in kept]})  # noqa: F841
    want = Counter()
    for doc_id, size, taken in duckdb.sql(f"select doc_id, size, taken from ({mixing.SQL})").fetchall():
        ids = np.array(library.encode(cut[doc_id], add_special_tokens=False).ids, "<u4")
        if size:
            want[doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(cut[doc_id].encode()).hexdigest()] += taken // size
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == +want and len(kept) < len(texts) and any(cut[i] != texts[i] for i in cut)


def test_stages_pass_documents_on(spark, sf):
    import corpus_pipeline
    from kinespark.llm.common import materialise

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == columns and 0 < docs.count() and (name == "mixing" or docs.count() <= before)
        before = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == before
    assert corpus_pipeline.run(spark, sf).count() == before


def test_arrow_columns_are_not_views():
    assert toxicity.Rows.of(pa.array([[3, 3, 1], [], None, [2]], pa.list_(pa.int32()))).row_sums(np.ones(1 << toxicity.BITS)).tolist() == [2, 0, 0, 1]
