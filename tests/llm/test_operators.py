"""The numbered operators against brute force, round trips and held-out accuracy, with edge cases for each."""

import collections
import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import bpe, common, components, decontaminate, embedding_neardup, hmm, license_scan, quality, secret_scan, simhash, substring_dedup, text, warc
from lattica.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, id string, key string, row long, score double, spans string"


def words_of(t):
    return WORD.findall(t or "")


def vocabulary(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, runs of one word, nulls, empties and one very long text."""
    rng, vocab = random.Random(3), vocabulary(600)
    texts = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 20, 34, 35, 36, 80, 300]))) for _ in range(60)]
    texts += [texts[9], texts[9], texts[20].upper(), " ".join(texts[30].split()[:-1] + ["changed"])]
    passage = " ".join(rng.choices(vocab, k=50))
    texts += [f"{' '.join(rng.choices(vocab, k=30))} {passage} {' '.join(rng.choices(vocab, k=30))}" for _ in range(6)]
    texts += [passage + " " + passage, "same " * 200, "same " * 90, "a b " * 60, None, None, "", "  \n\t ", "É\té\x0b ünï \x0c zz"]
    texts += [" ".join(rng.choices(vocab, k=6000))]
    near = texts[-1].split()
    near[3000] = "other"
    return [*texts, " ".join(near)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", "x", "k", 1, 0.5, "s") for i, t in enumerate(corpus)]
    rows += [(None, corpus[9], None, None, None, None, None, None), (0, corpus[0], "en", "x", "k", 1, 0.5, "s")]  # a null id, a repeated row
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def every(corpus):
    return [*enumerate(corpus), (None, corpus[9]), (0, corpus[0])]


# -- shared parts

def test_words_and_hashes(corpus):
    for limit in (1, 500, 1 << 30):
        seen = 0
        for i, j, data, offsets in text.chunks(pa.array(corpus), limit):
            w = text.Words(data, offsets)
            joined, place, start, end = w.joined()
            for k in range(j - i):
                assert bytes(joined[place[k] : place[k + 1]]).decode() == " ".join(words_of(corpus[i + k]))
            for n in (1, 3, 9):
                if len(w) >= n:
                    s, e = start[: len(w) - n + 1], end[n - 1 :]
                    assert text.xxh64_ranges(joined, s, e).tolist() == [xxhash.xxh64_intdigest(bytes(joined[a:b]), 42) for a, b in zip(s, e, strict=True)]
            seen += j - i
        assert seen == len(corpus)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 470)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component_id"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}
    root = lambda i: i if up.setdefault(i, i) == i else root(up[i])
    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1

def test_embedding_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_neardup, "PART_ROWS", 40)
    rng, rows = np.random.default_rng(1), []
    for label in range(3):
        for centre in rng.standard_normal((25, 16)):
            rows += [(label, centre + s * rng.standard_normal(16)) for s in (0, 0.02, 0.05, 0.05, 0.1)]
        dense = rng.standard_normal(16)
        rows += [(label, dense + 0.03 * rng.standard_normal(16)) for _ in range(120)]
        rows += [(label, dense)] * 30
    odd = [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] * 16, 1), (504, [None] * 16, 1), (505, [1.0] * 16, None), (506, [float("inf")] * 16, 1), (None, [1.0] * 16, 1)]
    table = [(i + 1000, [float(np.float32(x)) for x in v], int(lab)) for i, (lab, v) in enumerate(rows)]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_neardup.near_duplicates(df.withColumn("size", F.lit(1)).withColumn("rep", F.lit(2))).collect()}
    x = np.array([v for _, v, _ in table])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([t[2] for t in table])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(near, comp[None], len(x)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    assert len(got) == len(table) + len(odd)
    assert all(got[1000 + i]["n_links"] == near[i].sum() and got[1000 + i]["component_id"] == 1000 + comp[i] for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(500, 507))
    assert got[None]["component_id"] is None
    assert embedding_neardup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_one_id(spark):
    """Rows that share an id are vectors of their own, whatever else has that id."""
    e = np.eye(8)
    near = e[0] + 0.05 * e[1]
    rows = [(1, e[0]), (1, e[2]), (2, near), (3, near), (4, e[3]), (4, e[3]), (4, e[0]), (9, e[4]), (5, e[4] + 0.01 * e[5])]
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_neardup.near_duplicates(df).collect())
    # 1 (first), 2, 3 and the last row of 4 are one component
    assert got == sorted([(1, 3, 1, True), (1, 0, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 1, 4, True), (4, 1, 4, True), (4, 3, 1, False), (9, 1, 5, False), (5, 1, 5, True)])


@pytest.mark.parametrize("common", [0.0, 0.5, 0.8])
def test_embeddings_with_a_common_direction(spark, common):
    """Mean cosines as embedding models have them: all links are found, and a filter holds a small part of the label."""
    rng, n, dim = np.random.default_rng(int(common * 10)), 4000, 64
    side = rng.standard_normal((n, dim))
    side[:, 0] = 0
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.sqrt(1 - common) * side
    x[:, 0] = np.sqrt(common)
    x[1::10] = x[::10] + 0.2 / np.sqrt(dim) * rng.standard_normal((n // 10, dim)) * 0.95
    df = spark.createDataFrame([(i, [float(np.float32(c)) for c in v], i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    df = df.withColumn("label", F.lit(0))
    got = {r["vec_id"]: r["n_links"] for r in embedding_neardup.near_duplicates(df).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98).sum(axis=1) - 1
    assert near.sum() > 200 and all(got[i] == near[i] for i in range(n))
    classes = df.select("label", "embedding", F.lit(dim).alias("dim"))
    mean = np.array(embedding_neardup.label_means(classes, df.select("label").distinct()).first()["mean"])
    assert mean == pytest.approx(u.mean(axis=0), abs=1e-9)
    away = u - mean
    words = 23
    names, load = np.unique(embedding_neardup.list_decode(away / np.linalg.norm(away, axis=1, keepdims=True), 0, words, 6), return_counts=True)
    assert (load.astype(float) ** 2).sum() / n < 500  # comparisons a row in one of four codes


def test_blocks_of_a_repeated_row(spark):
    """One row as a third of the table is dealt to all blocks; rows come through as they are."""
    rows = [(7, "the same")] * 7000 + [(None, None)] * 3000 + [(i, f"text {i}") for i in range(10000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()
    dealt = common.in_blocks(df, "doc_id", "text", 40)
    sizes = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 2 * 20000 / 40
    assert collections.Counter((r["id"], r["text"]) for r in dealt.collect()) == collections.Counter(rows)


def test_repeated_rows_in_block_operators(spark, monkeypatch):
    """op3 and op10 where most rows are one row: what is removed and scored is as for rows apart."""
    monkeypatch.setattr(common, "SAME_ROWS", 16)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 2000)
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long)] * 200 + [(None, None)] * 100 + [(i, f"only here {i}") for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()
    cut = substring_dedup.remove_repeats(df).collect()
    assert len(cut) == len(rows) and all(r["n_removed"] == (40 if r["id"] == 1 else 0) for r in cut)
    scored = hmm.score(df).collect()
    assert len(scored) == len(rows) and len({round(r["score"], 9) for r in scored if r["id"] == 1}) == 1
    assert all(r["n_known"] == 41 for r in scored if r["id"] == 1)


def test_states_learn_more_than_classes(spark):
    """On held-out texts the chain is at least 0.2 (log10 a token) above the same model without states."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = common.fold("doc_id", 10) != 0
    chain = hmm.train(df.where(learn))
    texts = [(r["text"] or "").encode() for r in df.where(~learn).collect()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    _, tokens, first = hmm.sequences(data, offsets)
    alone = hmm.pair_counts(df.where(learn)).sum(axis=0)
    unigram = np.log10((alone + hmm.SMOOTH) / (alone + hmm.SMOOTH).sum())[tokens].mean()
    assert hmm.forward(chain, tokens, first).sum() / len(tokens) > unigram + 0.2
    worse = [hmm.forward(c, tokens, first).sum() for c in (hmm.Chain.from_pairs(hmm.pair_counts(df.where(learn))), chain)]
    assert worse[0] < worse[1]  # the rounds over whole texts gain on the start


def test_pairs_at_the_threshold_share_a_filter():
    rng, missed = np.random.default_rng(4), 0
    for dim, words in ((16, 5), (64, 23), (64, 91), (128, 400)):
        x = rng.standard_normal((5000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = rng.standard_normal((5000, dim))
        side -= (side * x).sum(axis=1, keepdims=True) * x
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
        met = np.zeros(len(x), bool)
        for code in range(4):
            a, b = (embedding_neardup.list_decode(v, code, words, 6) for v in (x, y))
            met |= (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
        missed += (~met).sum()
    assert missed == 0


def test_labels_of_any_type_and_size(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist(), "large" if i % 2 else f"small {i % 20}") for i in range(600)]
    rows += [(1000 + i, v, lab) for i, v, lab in rows[:50]]
    got = {r["vec_id"]: r for r in embedding_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    links = ((x @ x.T >= 0.98) & (lab[:, None] == lab[None])).sum(axis=1) - 1
    assert {i: got[i]["n_links"] for i, _, _ in rows} == {r[0]: n for r, n in zip(rows, links.tolist(), strict=True)}


# -- 2

def fingerprint(t, size=3):
    w = words_of((t or "").translate(LOWER))
    grams = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash_matches_brute_force(docs, corpus, nothing, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "SPLIT", 10)
    got = simhash.near_duplicates(docs).collect()
    prints = {i: fingerprint(t) for i, t in enumerate(corpus)}
    comp = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if comp[j] < comp[i] and (prints[i] ^ prints[j]).bit_count() <= 3:
                    comp[i], changed = comp[j], True
    assert len(got) == len(corpus) + 2
    for r in got:
        i = r["doc_id"]
        assert r["fingerprint"] == f"{prints[9 if i is None else i]:016x}"
        assert r["component_id"] == comp[9 if i is None else i]
    assert simhash.near_duplicates(nothing).count() == 0


def test_majority_of_very_long_texts():
    h = np.random.default_rng(0).integers(0, 2**63, 150_000, dtype=np.uint64)
    first = np.array([0, 3, 3, 140_003, 150_000])
    want = [sum(1 << b for b in range(64) if ((h[s:e] >> np.uint64(b)) & np.uint64(1)).sum() * 2 > e - s) if e > s else 0 for s, e in zip(first[:-1], first[1:], strict=True)]
    assert simhash.majority(h, first).tolist() == want


def test_tree_finds_every_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 20)
    monkeypatch.setattr(simhash, "SPLIT", 60)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(300)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(4)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    links = simhash.hamming_links(df, 3).collect()
    assert all((fps[r["a"]] ^ fps[r["b"]]).bit_count() <= 3 for r in links)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    group = lambda ps: {r["id"]: r["component_id"] for r in components.connected_components(spark.createDataFrame(ps, "a long, b long")).collect()}
    assert group([(r["a"], r["b"]) for r in links]) == group(pairs)


def test_leaves_shrink_with_the_table():
    """A million unrelated fingerprints: few copies of each, and no leaf with a share of the table."""
    fps = np.random.default_rng(5).integers(0, 2**64, 1_000_000, dtype=np.uint64)
    for rows, depth in ((100_000, simhash.tree_depth(100_000, 1)), (1_000_000, simhash.tree_depth(1_000_000, 1))):
        copies = largest = 0
        for t in range(2):
            x = simhash.half(fps[:rows], t)
            tree = simhash.fit_tree(x[: simhash.SAMPLE], depth, 1)
            _, leaf, _ = simhash.route(x, *tree, depth, 1)
            copies, largest = copies + len(leaf) / rows, max(largest, np.bincount(leaf).max())
        assert copies < 8 and largest < 2.5 * simhash.LEAF


@pytest.mark.parametrize("part", [12, 6000, 4000])
def test_verified_groups(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART_SHINGLES" if part == 4000 else "PART_TEXTS", part)
    monkeypatch.setattr(simhash, "PEEL_ROUNDS", 3)
    rng, vocab, rows = random.Random(8), vocabulary(900, 8), []
    for k in range(40):
        base = rng.choices(vocab, k=200)
        rows.append((10 * k, " ".join(base)))
        for c in range(1, 4):
            copy = list(base)
            for at in rng.sample(range(200), 2):
                copy[at] = "new" + str(rng.random())
            rows.append((10 * k + c, " ".join(copy)))
    base = rng.choices(vocab, k=150)
    for c in range(60):  # one large group
        copy = list(base)
        copy[c] = "word" + str(c)
        rows.append((2000 + c, " ".join(copy)))
    rows += [(1000, "  "), (1001, None), (1002, ""), (1003, rows[0][1])]
    got = {r["id"]: r["component_id"] for r in simhash.verified_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[10 * k + c] == 10 * k for k in range(40) for c in range(1, 4))
    assert found >= 119 and all(got[10 * k] == 10 * k for k in range(40))
    assert all(got[2000 + c] == 2000 for c in range(60))
    assert got[1003] == 0 and got[1002] == got[1001] == got[1000] == 1000  # texts without words are alike


def test_large_groups_are_parted_by_shingles(spark, monkeypatch):
    """Few texts of many shingles are parted as many texts are: no task has more than two parts, and all pairs meet."""
    monkeypatch.setattr(simhash, "PART_SHINGLES", 3000)
    monkeypatch.setattr(simhash, "BIN_SHINGLES", 1000)
    rows = [(1, i, list(range(i, i + 300))) for i in range(100)] + [(2, 1000 + i, [i, i + 1]) for i in range(50)]
    sets = spark.createDataFrame(rows, "near long, node long, shingles array<int>").repartition(4).checkpoint()
    dealt = simhash._placed(sets).collect()
    load = collections.Counter()
    for r in dealt:
        load[r["bin"]] += len(r["shingles"])
    assert max(load.values()) < 2 * 3000 * 2 and len(load) > 20
    places = collections.defaultdict(set)
    for r in dealt:
        places[r["place"]].add(r["node"])
    met = {(a, b) for nodes in places.values() for a in nodes for b in nodes}
    assert all((a, b) in met for a in range(100) for b in range(100)) and all((1000, 1000 + b) in met for b in range(50))
    left, links = simhash._peel(sets, 0.8)
    assert links and sum(r["n"] for r in left.groupBy("near").agg(F.count("node").alias("n")).collect()) >= 50
    assert {r["node"] for r in left.where("near = 2").collect()} == {1000 + i for i in range(50)}  # small groups stay as they are


@pytest.mark.parametrize("part", [10, 24_000])
def test_verified_groups_match_brute_force(spark, monkeypatch, part):
    """Truncated, extended and reordered texts, at similarities on both sides of 0.8."""
    monkeypatch.setattr(simhash, "PART_TEXTS", part)
    monkeypatch.setattr(simhash, "PEEL_ROUNDS", 3)
    rng, texts = random.Random(18), []
    fresh = lambda n: ["w" + str(rng.getrandbits(40)) for _ in range(n)]
    for n in (9, 40, 120, 300):
        for k in range(12):
            base = fresh(n)
            block = n * rng.randint(8, 30) // 100 + 1
            texts += [base, base[:-block], base[block:], base + fresh(block), fresh(block) + base]
            texts.append(base[: n // 2] + fresh(block) + base[n // 2 :])
    base = fresh(120)
    other = [*base[:-1], "changed"]
    texts += [base[::-1], base, other]  # one bag of words, but another order
    shared = fresh(60)
    texts += [fresh(20) + shared + fresh(20) for _ in range(15)]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["id"]: r["component_id"] for r in simhash.verified_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(want) - 100


# -- 3

def brute_repeats(texts, width=35):
    all_words = [words_of(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + width]) for w in all_words for i in range(len(w) - width + 1))
    out = []
    for w in all_words:
        drop = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                drop[i : i + width] = [True] * width
        out.append((len(w), sum(drop), " ".join(x for x, d in zip(w, drop, strict=True) if not d)))
    return out


@pytest.mark.parametrize("block", [200, 3000, 1 << 22])
def test_repeats_match_brute_force(docs, corpus, nothing, block, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    rows = every(corpus)
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows]), strict=True))
    got = substring_dedup.remove_repeats(docs).collect()
    assert collections.Counter((r["id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == want
    assert sum(r["n_removed"] for r in got) > 500
    if block == 200:
        assert substring_dedup.remove_repeats(nothing).count() == 0


def test_repeats_of_few_words(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 300)
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["a", "b"], [0.9, 0.1], k=rng.randint(0, 120))) for _ in range(40)] + ["a b " * 40, "b a " * 40, "a a b " * 30]
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window_words=10).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 10)))


# -- 4

def test_license_alignment(spark):
    mit = license_scan.TEMPLATES["mit-permission"]
    gpl = license_scan.TEMPLATES["gpl-3.0"]
    w = mit.split()
    w[5], w[20] = "oops", "other"
    rows = [(1, "x y z\n" + gpl + "\nmore"), (2, " ".join(["filler"] * 3000 + w + ["rest"] * 50)), (3, "nothing licensed here"), (4, None), (5, ""), (None, gpl.upper()), (6, " ".join(mit.split()[:20])), (1, gpl)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))).collect()
    assert sorted((str(r["id"]), r["license"]) for r in got) == [("1", "gpl-3.0"), ("1", "gpl-3.0"), ("2", "mit-permission"), ("None", "gpl-3.0")]
    two = next(r for r in got if r["id"] == 2)
    assert (two["start_word"], two["end_word"]) == (3000, 3000 + len(w)) and two["coverage"] == pytest.approx((len(w) - 2) / len(w))
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def longest_common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_license_scan_against_every_start(spark):
    rng, vocab, names = random.Random(14), vocabulary(300, 14), list(license_scan.TEMPLATES)
    templates = {k: [plain(w) for w in t.split()] for k, t in license_scan.TEMPLATES.items()}
    rows, planted = [], {}
    for k in range(150):
        name = names[k % len(names)]
        t, gap = license_scan.TEMPLATES[name].split(), rng.choice([0, 0, 1, 5, 20])
        out = rng.choices(vocab, k=rng.choice([0, 30, 400, 3000 if k % 30 == 0 else 10]))
        edits = rng.randint(0, len(t) // 12) if k % 3 else 0
        for _ in range(1 + k % 8):
            w = list(t)
            for at in rng.sample(range(len(t)), edits):
                w[at] = "edited"
            out += w + rng.choices(vocab, k=gap)
        rows.append((k, " ".join(out + rng.choices(vocab, k=rng.choice([0, 40])))))
        planted[k] = name
    for k in range(40):  # the words of a notice in another order
        w = license_scan.TEMPLATES[names[k % len(names)]].split()
        rng.shuffle(w)
        rows.append((1000 + k, " ".join(rng.choices(vocab, k=20) + w)))
    got = {(r["id"], r["license"]): r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((k, name) in got for k, name in planted.items())
    for k, text_ in rows:
        w = [plain(x) for x in text_.split()]
        for name, t in templates.items():
            exact = [p for p in range(len(w) - len(t) + 1) if w[p] == t[0] and w[p : p + len(t)] == t]
            found = got.get((k, name))
            if exact:  # the first of all exact copies
                assert (found["coverage"], found["start_word"], found["end_word"]) == (1.0, exact[0], exact[0] + len(t))
            elif found:  # as many words as reported stand in order in the span
                assert 0.8 <= found["coverage"] <= 1 and longest_common(w[found["start_word"] : found["end_word"]], t) >= round(found["coverage"] * len(t))


def test_license_at_exactly_the_coverage(spark):
    rows = [(1, "Licensed under the MIT License."), (2, "Licensed under a MIT License.")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["id"], r["license"], r["coverage"]) for r in got] == [(1, "mit", 0.8)]


def test_license_with_marks_only_at_the_front(spark):
    """Marks nearer to the text's front than their place in the notice: a German "Mit" there, notices cut at their front."""
    gpl, rows, want = license_scan.TEMPLATES["gpl-3.0"], [], {}
    for name, t in license_scan.TEMPLATES.items():
        w = t.split()
        for cut in range(len(w)):
            rows.append((len(rows), " ".join(w[cut:] + w[:cut][::-1])))
            plain_t, plain_w = [plain(x) for x in w], [plain(x) for x in w[cut:] + w[:cut][::-1]]
            enough, most = license_scan.needed(len(w), 0.8), longest_common(plain_w, plain_t)
            want[rows[-1][0], name] = None if cut > len(w) - enough and most >= enough else most >= enough
    rows.append((-1, f"Mit den als. {gpl}"))
    got = {(r["id"], r["license"]): r["coverage"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if k[0] == -1} == {(-1, "gpl-3.0"): 1.0}
    assert all(((k in got) == w) for k, w in want.items() if w is not None) and False in want.values()


def test_shared_words_slide():
    """Counts of words shared with a template, a start at a time, and a long text of a notice's words in random order."""
    rng = random.Random(1)
    for _ in range(200):
        template, words = [rng.randrange(8) for _ in range(rng.randint(1, 9))], [rng.randrange(10) for _ in range(rng.randint(0, 30))]
        for size in (1, 3, len(template), 12):
            want = [sum((collections.Counter(words[i : i + size]) & collections.Counter(template)).values()) for i in range(len(words))]
            assert license_scan.shared_words(words, template, size).tolist() == want
    notice = max(license_scan.TEMPLATES.values(), key=len).split()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(rng.choices(notice, k=20_000))])], names=["id", "text"])
    began = time.process_time()
    list(license_scan._scanner(license_scan.TEMPLATES, 0.8)(iter([batch])))
    assert time.process_time() - began < 30


def test_license_repeated_back_to_back(spark):
    rows = []
    for k, (name, t) in enumerate(license_scan.TEMPLATES.items()):
        rows += [(k, f"foo {t} {t} bar"), (k, f"foo {t} x y {t} bar {t}"), (k, f"{t} {t} {t}")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for k, (name, t) in enumerate(license_scan.TEMPLATES.items()):
        assert sum(r["id"] == k and r["license"] == name and r["coverage"] == 1 for r in got) == 3, name


def test_alignment_is_an_increasing_matching():
    rng = random.Random(6)
    for _ in range(200):
        a, b = (rng.choices(range(12), k=rng.randint(0, 25)) for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True))
    assert license_scan.longest_increasing([3, 1, 2, 5, 4, 6]) in ([1, 2, 4, 5], [1, 2, 3, 5])


# -- 5

def plain(w):
    edge = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
    return w.translate(LOWER).strip(edge) or w.translate(LOWER)


def brute_hits(docs, items, span=13, share=0.8):
    out = set()
    for i, t in docs:
        d = [plain(x) for x in words_of(t)]
        for k, s in items:
            b = [plain(x) for x in words_of(s)]
            n = min(span, len(b))
            if n < 5:
                if n and d == b:
                    out.add((i, k, 0, 0, n, n))
                continue
            for p in range(len(d) - n + 1):
                for q in range(len(b) - n + 1):
                    same = sum(x == y for x, y in zip(d[p : p + n], b[q : q + n], strict=True))
                    if same >= share * n:
                        out.add((i, k, p, q, n, same))
    return out


def test_spaced_seeds_match_brute_force(spark):
    rng, vocab = random.Random(9), vocabulary(80, 9)
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([4, 7, 13, 20])))) for k in range(12)] + [(50, None), (51, "")]
    docs = []
    for k in range(40):
        w = rng.choices(vocab, k=60)
        if k % 2:
            passage = items[k % 12][1].split()
            for at in rng.sample(range(len(passage)), min(len(passage), k % 4)):
                passage[at] = "sub"
            w[20:20] = [x.upper() + "," for x in passage]
        docs.append((k, " ".join(w)))
    items += [(60, "Short answer."), (61, "no"), (62, items[2][1]), (63, items[2][1] + " and more of it")]
    docs += [(100, None), (101, ""), (None, items[3][1]), (5, docs[5][1]), (102, "short answer"), (103, "a short answer"), (104, "No!")]
    got = decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_hits(docs, items)
    assert {tuple(r) for r in got} == want and len(want) > 30
    per = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["id"]: r["items"] for r in per} == {i: sorted({h[1] for h in want if h[0] == i}) for i in {h[0] for h in want}}
    assert {102, 104, None} <= {h[0] for h in want} and 103 not in {h[0] for h in want}
    with pytest.raises(ValueError):
        decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), span=30)
    named = spark.createDataFrame([(str(k), t) for k, t in items], "item_id string, text string")
    assert decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), named).count() == len({h[0] for h in want})
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


# -- 6

def test_bpe_equals_the_library(spark, docs, corpus, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    bits = ["a", "th", "in", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "中", "🙂", "1", "²", "Ⅳ", "'s", "'ll", "_", "<|endoftext|>", "\x00", "the", "​", "　", "-" * 20]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3000)]
    for t, coded, want in zip(texts, bpe.encode_texts(texts, path), library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(coded, "<u4")
        assert ids.tolist() == want.ids, repr(t)
        assert bpe.encoder(path).vocabulary.decode(ids.astype(np.int64)).decode("utf-8", "replace") == library.decode(want.ids, skip_special_tokens=False)
    both = bpe.decode(bpe.encode(docs, path), path).collect()
    assert collections.Counter((r["id"], r["text"]) for r in both) == collections.Counter((i, t or "") for i, t in every(corpus))
    one = {r["id"]: r for r in bpe.encode_decode(docs, path).collect()}
    assert all(one[r["id"]]["n_tokens"] == len(r["ids"]) and one[r["id"]]["ids"] == np.array(r["ids"], "<u4").tobytes() for r in both)
    assert bpe.encode_decode(nothing, path).count() == 0


def test_bpe_encodes_a_word_once_for_all_its_pieces(monkeypatch):
    """The same word with and without marks, in chunks of their own, costs one encoding."""
    own = bpe.Encoder(tokenizer_path())
    asked, sorted_words = [], own.vocabulary.encode_sorted
    monkeypatch.setattr(own.vocabulary, "encode_sorted", lambda words: asked.extend(words) or sorted_words(words))
    own.texts(["x qrtzling qrtzlañg", "x qrtzling, qrtzlañg!", "x qrtzling. qrtzlañg###", "x qrtzling; qrtzling/qrtzling\nqrtzling"], chunk=1)
    assert asked.count(b" qrtzling") == asked.count(" qrtzlañg".encode()) == asked.count(b"qrtzling") == 1


def test_bpe_of_odd_pieces_equals_the_library(monkeypatch):
    """Long words and tokens, pieces that meet again after others, kept encodings that are turned over, unused special tokens."""
    from tokenizers import Tokenizer

    path, rng = tokenizer_path(), random.Random(3)
    library, own = Tokenizer.from_file(path), bpe.Encoder(path)
    tokens = sorted((b for b in own.vocabulary.id if len(b) > 2), key=len)
    words = [b.decode("utf-8", "ignore") for b in tokens[-300:] + rng.sample(tokens, 700)]
    bits = [*words, "!\x1c!", "!\x1c", "\x1ca", "ª", "ſ", "Ԁ", "ɐ", "l'été,", "don't.", "d'", "'", "''s", "a\nb", "a\n", "\u2028", "3.", "x" * 199 + "y", "é" * 150, "-" * 500, "", "\t", "ß,,", "¿qué?", "<|endoftext|>", "<|end"]
    texts = [rng.choice(["", " "]).join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(3000)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for kept in (bpe.KEPT_WORDS, 50):
        monkeypatch.setattr(bpe, "KEPT_WORDS", kept)
        for chunk in (1_000_000, 700):
            own.forget()
            for t, got, ids in zip(texts, own.texts(texts, chunk), want, strict=True):
                assert np.frombuffer(got, "<u4").tolist() == ids, repr(t)


# -- 7

def test_quality_on_held_out_labels(spark, docs, nothing):
    rng, vocab = random.Random(2), vocabulary(400, 2)
    rows = [(i, " ".join(w + ("###" if i % 3 == 0 else "") for w in rng.choices(vocab, k=rng.randint(5, 200)))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(9)).withColumn("x", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r["id"]: r for r in quality.classify(frame, labels).collect()}
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {i for i in got if got[i]["held_out"]} == held
    assert np.mean([got[i]["predicted"] == int(i % 3 != 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    model = quality.fit(frame, labels)
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {r["id"] for r in quality.score(frame, model).where("score >= 0.5").collect()}
    assert quality.score(docs, model).where("score between 0 and 1").count() == docs.count()
    assert quality.classify(nothing, labels).count() == 0
    one = quality.classify(frame, labels.where("quality = 1")).agg(F.min("predicted")).first()[0]
    none = quality.classify(frame, labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert one == 1 and tuple(none) == (0.5, 0.5)


def test_ranking_matches_a_plain_fit():
    """The weights are those that gradient descent on the same pairs finds, and the threshold parts the classes by their shares."""
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((500, len(quality.NAMES))), (rng.random(500) < 0.4).astype(int)
    x[y == 1, :3] += 0.8
    model = quality.fit_pairs(x, y, pairs=4000)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    pick = np.random.default_rng(11)
    d = z[pick.choice(np.flatnonzero(y == 1), 4000)] - z[pick.choice(np.flatnonzero(y == 0), 4000)]
    w = np.zeros(d.shape[1])
    for _ in range(4000):
        w -= 0.5 * (1e-3 * w - (d / (1 + np.exp(d @ w))[:, None]).mean(0))
    assert model.weights == pytest.approx(w, abs=1e-4)
    scores = model.score(x)
    assert (scores >= 0.5).sum() == (y == 1).sum()
    assert (np.argsort(scores, kind="stable") == np.argsort(z @ model.weights, kind="stable")).all()


def test_quality_ties_conflicts_and_repeats(spark):
    rows = [(i, "good text of some words" if i % 2 else "#### ####") for i in range(200)] + [(1, "#### ####"), (500, "word " * 60_000)]
    labels = [(i, i % 2) for i in range(200)] + [(2, 1), (4, 0), (5, None)]
    frame, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    one, two = (sorted((r["id"], r["score"]) for r in quality.classify(frame.repartition(n), known.repartition(n)).collect()) for n in (2, 5))
    assert one == two and len(one) == len(rows)
    by_text = collections.defaultdict(set)
    for (i, t), (j, s) in zip(sorted(rows), sorted(one), strict=True):
        by_text[t if i != 1 else None].add(s)
    assert all(len(v) == 1 for k, v in by_text.items() if k)  # equal texts have equal scores
    assert all(s < 0.5 for s in by_text["#### ####"]) and all(s >= 0.5 for s in by_text["good text of some words"])


# -- 8

@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_archive_round_trip(spark, tmp_path, monkeypatch, broadcast_rows):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    rng, vocab = random.Random(7), vocabulary(200, 7)
    pages = [(k, f"http://h/{k}\r\nX: y", "<html>" + " ".join(rng.choices(vocab, k=rng.randint(1, 300)))) for k in range(200)]
    pages += [(300 + k, None, pages[10][2] + " padding " * 20) for k in range(30)] + [(400, "u", None), (401, "u", ""), (402, "u", "é" * 50), (403, "u", "é" * 50), (404, "u", "short"), (405, "u", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("z")).withColumn("refers_to", F.lit(1))
    folder = f"file://{tmp_path}/archive"
    odd = [(None, "n", pages[10][2]), (None, "n", pages[3][2]), (None, "n", "only nulls " * 20), (None, "n", "only nulls " * 20), (7, "again", pages[7][2]), (None, None, None)]
    manifest = warc.write_archive(df.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"), allowMissingColumns=True), folder)
    assert manifest.agg(F.sum("records")).first()[0] == len(pages) + len(odd) and manifest.count() > 1
    back = warc.read_archive(folder, manifest).collect()
    assert len({r["record_id"] for r in back}) == len(back) == len(pages) + len(odd)
    got = {r["page_id"]: r for r in back}
    unnamed = sorted((r["record_type"], str(r["refers_to"])) for r in back if r["page_id"] is None)
    kinds = [("response", "None") if h is None or len(h) < 100 or "only nulls" in h else ("revisit", "10" if h == pages[10][2] else "3") for i, _, h in odd if i is None]
    assert unnamed == sorted(kinds)
    first = {}
    for i, _, h in pages:
        p = (h or "").encode()
        r, d = got[i], hashlib.sha256(p).hexdigest()
        again = len(p) >= 100 and d in first
        first.setdefault(d, i)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(p), d, "revisit" if again else "response", first[d] if again else None)
        assert again or bytes(r["payload"]) == p
    assert got[403]["record_type"] == "revisit" and got[405]["record_type"] == "response"
    with open(next(tmp_path.glob("archive/*.zst")), "rb") as f:
        assert int.from_bytes(f.read(4), "little") == warc.DICTIONARY_MAGIC
    none = warc.write_archive(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archive(f"file://{tmp_path}/none", none).count() == 0


@pytest.mark.parametrize("limit", [-1, 1000])
def test_lookups_leave_rows_where_they_stand(spark, monkeypatch, limit):
    """Every width and a key that a third of the rows share; the plan exchanges no text."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    rows = spark.range(0, 3000, 1, 7).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 10 = 1, null, 'k' || id % 500)) as k", "repeat('x', int(id % 50)) as text", "array(id, null) as list")
    keys = common.kept(spark.createDataFrame([("hot", 1, "a"), ("k7", 2, None), ("k9", None, "c"), ("other", 4, "d")], "k string, n long, name string"))
    got = common.looked_up(rows, keys, "k")
    want = {"hot": (1, "a"), "k7": (2, None), "k9": (None, "c")}
    assert got.columns == [*rows.columns, "n", "name"]
    found = got.collect()
    assert sorted(r["id"] for r in found) == list(range(3000))
    own = {r["id"]: r for r in rows.collect()}
    for r in found:
        assert (r["n"], r["name"]) == want.get(r["k"], (None, None)) and (r["k"], r["text"], r["list"]) == tuple(own[r["id"]][1:])
    if limit < 0:
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    left = common.without(rows, keys.select("k"), "k")
    assert left.columns == rows.columns and sorted(r["id"] for r in left.collect()) == sorted(i for i, r in own.items() if r["k"] not in want)
    assert common.looked_up(rows.limit(0), keys, "k").count() == 0 and common.looked_up(rows, keys.limit(0), "k").count() == 3000


# -- 9

def brute_base(t):
    assign = re.compile(secret_scan.ASSIGN.replace("(?i)", ""), re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(secret_scan.ACCESS, t) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(secret_scan.HEX, t) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secrets_in_a_text_full_of_them(spark):
    """Thousands of matches in one text, and every weak part next to another."""
    t = " ".join(f"token=abcdefghijkl{k:04d} user=u{k:04d} pw secret: zzz{k:04d} {k:016x}" for k in range(3000))
    r = secret_scan.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).select(
        secret_scan.as_text(F.filter("spans", lambda s: s["base"])).alias("base"), F.size("spans").alias("n")).first()
    assert r["base"] == brute_base(t) and r["n"] == 4 * 3000


def test_secrets_match_brute_force(spark, nothing):
    rng = random.Random(10)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", " = ", "AKIA", "ABCDEFGH123456", "deadbeef", "0123456789abcdef", "é", "🙂", "\n", "x", "hunter2hunter2", "https://a.b/c", "user=bob", ", "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(1500)] + [None, "", "token=" * 300, "🙂" * 5000 + " secret: abcdefabcdefabcdef"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[5]), (3, texts[3])], "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("row", F.lit(2))
    got = secret_scan.scan(df).select("id", secret_scan.as_text(F.filter("spans", lambda s: s["base"])).alias("base"), secret_scan.as_text(F.col("spans")).alias("all")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r["base"] == brute_base(texts[5 if r["id"] is None else r["id"]] or "")
        assert set(filter(None, r["base"].split(","))) <= set(r["all"].split(","))
    assert secret_scan.scan(nothing).count() == 0


def test_weak_parts_need_one_another(spark):
    far = "x " * 300
    rows = [(1, "user=bob"), (2, "user=bob password=short1"), (3, f"user=bob {far} password=short1"), (4, "https://h/x"), (5, "https://h/x token: 0123456789abcdefXYZ"), (6, "password=short1"), (7, "AKIAABCDEFGHIJ secret=abc123")]
    df = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["id"]: [s["kind"] for s in r["spans"]] for r in df.collect()}
    assert got == {1: [], 2: ["login", "weak_secret"], 3: [], 4: [], 5: ["endpoint", "assign", "hex"], 6: [], 7: ["weak_access", "weak_secret"]}
    cut = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "id").join(df, "id").select("id", secret_scan.redact(F.col("text"), F.col("spans")).alias("t"))
    assert {r["id"]: r["t"] for r in cut.collect()}[5] == "[secret] [secret]"


# -- 10

def test_language_model_base_and_chain(spark, docs, corpus, nothing):
    rows = every(corpus)
    tokens = lambda t: [*words_of((t or "").translate(LOWER)), None]
    learn = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(x for t in learn for x in tokens(t))
    n, low = sum(count.values()), math.log10(sum(count.values()) + 0.1 * (len(count) + 1))
    got = hmm.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = tokens(corpus[9] if r["id"] is None else corpus[r["id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(count[x] + 0.1) - low for x in w), rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
        assert r["held_out"] == (None if r["id"] is None else zlib.crc32(str(r["id"]).encode()) % 10 == 0)
    assert hmm.score(nothing).count() == 0


def test_language_model_end_to_end(spark, monkeypatch):
    """Scores equal a plain restatement: word shares of classes, Baum-Welch over whole texts, and the sum over all paths."""
    monkeypatch.setattr(hmm, "SEGMENT", 7)
    rng, vocab = random.Random(21), vocabulary(60, 21)
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 4, 9, 40])))) for i in range(60)] + [(60, None), (61, "  "), (62, " ".join(rng.choices(vocab, k=700))), (3, "again")]
    learn = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    classes = lambda t: hmm.sequences(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[1].tolist()
    tokens = lambda t: [*words_of(t.translate(LOWER)), None]
    count, kind = collections.Counter(x for t in learn for x in tokens(t)), {}
    for t in (t or "" for _, t in rows):
        kind |= dict(zip(tokens(t), classes(t), strict=True))
    size, names = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for x, c in count.items():
        size[kind[x]] += c
        names[kind[x]] += 1
    pairs = np.zeros((hmm.CLASSES, hmm.CLASSES))
    for t in learn:
        for a, b in zip([0, *classes(t)], classes(t)):  # noqa: B905
            pairs[a, b] += 1
    chain = hmm.Chain.from_pairs(pairs)
    for _ in range(hmm.ROUNDS):
        start, move, emit = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.STATES, hmm.CLASSES))
        for t in learn:
            s = classes(t)
            a = [chain.start * chain.emit[:, s[0]]]
            for x in s[1:]:
                a.append(a[-1] / a[-1].sum() @ chain.move * chain.emit[:, x])
            b = [np.ones(hmm.STATES)]
            for x in s[:0:-1]:
                v = chain.move @ (chain.emit[:, x] * b[-1])
                b.append(v / v.sum())
            b.reverse()
            for k, x in enumerate(s):
                g = a[k] * b[k] / (a[k] @ b[k])
                emit[:, x] += g
                start += g if not k else 0
                if k + 1 < len(s):
                    m = a[k][:, None] * chain.move * (chain.emit[:, s[k + 1]] * b[k + 1])[None]
                    move += m / m.sum()
        part = lambda x: (x + hmm.SMOOTH) / (x + hmm.SMOOTH).sum(-1, keepdims=True)
        chain = hmm.Chain(part(start), part(move), part(emit))

    def score(t):
        total, a = 0.0, chain.start
        for k, (x, c) in enumerate(zip(tokens(t), classes(t), strict=True)):
            a = (a @ chain.move if k else a) * chain.emit[:, c]
            total += math.log10(a.sum()) + math.log10((count[x] + hmm.SMOOTH) / (size[c] + hmm.SMOOTH * (names[c] + 1)))
            a = a / a.sum()
        return total

    got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    held = {(i, t or ""): score(t or "") for i, t in rows}
    assert sorted(round(r["score"], 6) for r in got) == sorted(round(v, 6) for v in held.values())
    # known words and one unknown word for each class: the chances of all next tokens sum to 1
    a = chain.start
    next_class = a @ chain.emit
    words = sum(next_class[kind[x]] * (c + hmm.SMOOTH) / (size[kind[x]] + hmm.SMOOTH * (names[kind[x]] + 1)) for x, c in count.items())
    unknown = sum(next_class[c] * hmm.SMOOTH / (size[c] + hmm.SMOOTH * (names[c] + 1)) for c in range(hmm.CLASSES))
    assert words + unknown == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("segment", [2, 3, 1000])
def test_segments_change_nothing(monkeypatch, segment):
    rng = np.random.default_rng(15)
    tokens, first = rng.integers(0, 40, 900), np.array([0, 1, 3, 6, 13, 400, 900])
    chain = hmm.Chain.first(np.bincount(tokens, minlength=40).astype(float), 4)
    want = hmm.forward(chain, tokens, first), hmm.expected(chain, tokens, first)
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    assert hmm.forward(chain, tokens, first) == pytest.approx(want[0], rel=1e-12)
    assert hmm.expected(chain, tokens, first) == pytest.approx(want[1], rel=1e-9, abs=1e-12)


def test_forward_and_counts_match_enumeration():
    rng = np.random.default_rng(5)
    draw = lambda *n: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(n))
    chain = hmm.Chain(draw(3), draw(3, 3), draw(3, 7))
    seqs = [rng.integers(0, 7, k) for k in (1, 2, 5, 3, 6)]
    first, tokens = np.r_[0, np.cumsum([len(s) for s in seqs])], np.concatenate(seqs)
    got = hmm.forward(chain, tokens, first)
    counts = np.zeros(3 + 9 + 21)
    for s, value in zip(seqs, got, strict=True):
        total, own = 0.0, np.zeros_like(counts)
        for path in np.ndindex(*[3] * len(s)):
            p = chain.start[path[0]] * chain.emit[path[0], s[0]]
            for t in range(1, len(s)):
                p *= chain.move[path[t - 1], path[t]] * chain.emit[path[t], s[t]]
            total += p
            own[path[0]] += p
            for t in range(1, len(s)):
                own[3 + 3 * path[t - 1] + path[t]] += p
            for t in range(len(s)):
                own[12 + 7 * path[t] + s[t]] += p
        assert value == pytest.approx(math.log10(total))
        counts += own / total
    assert hmm.expected(chain, tokens, first) == pytest.approx(counts)


# -- shared parts that need a cluster's settings

def test_shared_folder_is_asked_for():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError):
        common.shared_folder(Session())


def test_tables_are_discarded(spark):
    one, two = common.kept(spark.range(3)), common.kept(spark.range(4))
    folders = [f.rsplit("/", 1)[0].removeprefix("file:").replace("//", "/") for df in (one, two) for f in df.inputFiles()[:1]]
    common.discard(one)
    assert [os.path.exists(f) for f in folders] == [False, True] and two.count() == 4
    common.discard(spark.range(2))  # no table of its own
