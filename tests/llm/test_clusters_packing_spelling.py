"""Centroid clustering, packing and spelling variants against plain versions, with edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import centroids, packing, spelling, text
from lattica.llm.queries import packing_tokenizer_path

VECTORS = "vec_id long, embedding array<float>, label int, x string, cluster int"
DOCS = "doc_id long, text string, word string, n long, id string, ids string, start long"


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# centroids


def plain_clusters(rows, dims, k, rounds, scale=256, seed="2"):
    """Lloyd's rounds as they are stated, all distances measured."""
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in start[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        at = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(at)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = collections.Counter()
    for _, c, d in found:
        inertia[c] += d
    return collections.Counter((i, c, d, inertia[c], sum(inertia.values()), tuple(at[c])) for i, c, d in found)


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300, rows[5][1]), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (301, None), (302, []), (303, [1.0] * 7), (304, [1.0] * 9), (305, [float("nan")] + [0.0] * 7),
             (306, [float("-inf")] + [0.0] * 7), (307, [None] + [0.0] * 7), (308, [0.0] * 8), (309, [-0.5] * 8)] + [(400 + i, [0.25] * 8) for i in range(150)]
    df = spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows], VECTORS).repartition(5)
    for k, rounds in ((7, 5), (40, 2), (600, 1)):
        got = collections.Counter((r["id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in centroids.cluster(df, dims=8, k=k, rounds=rounds).collect())
        assert got == plain_clusters(rows, 8, k, rounds)


def test_walk_finds_the_nearest_and_stops_early():
    rng = np.random.default_rng(1)
    at = rng.integers(-300, 300, (40, 3))
    at[11] = at[4]  # a tie goes to the smaller number
    x = np.concatenate([at, rng.integers(-310, 310, (500, 3))])
    found, distance, measured = centroids.SortedLists(at).nearest(x)
    every = ((x[:, None] - at[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < every.size / 2


def test_ties_at_the_frontier():
    """Distances equal to the frontier's sum must not stop the walk: an unseen centroid of smaller number may be as near."""
    at = np.array(list(itertools.product((-1, 0, 1), repeat=3)))
    x = np.array(list(itertools.product(range(-2, 3), repeat=3)))
    every = ((x[:, None] - at[None]) ** 2).sum(axis=2)
    assert (centroids.SortedLists(at).nearest(x)[0] == every.argmin(axis=1)).all()
    at = at[::-1].copy()
    every = ((x[:, None] - at[None]) ** 2).sum(axis=2)
    assert (centroids.SortedLists(at).nearest(x)[0] == every.argmin(axis=1)).all()


def test_clusters_of_nothing_and_of_huge_components(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert centroids.cluster(empty).count() == 0
    assert centroids.cluster(empty).columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    huge = spark.createDataFrame([(1, [1e30] * 64, 1, "x", 1)], VECTORS)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(huge)


# packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing_tokenizer_path())


ODD = ["a", "b", "Z", "é", "é", "'s", "'", "t", "1", "22", "²", "क़", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "</w>", "<", "|", ".", ",", "_", " ", "\n", "\t", "\x0b",
       "　", "\xa0", "\x1c", "\x85", "中", "😀", "x" * 40, "‍", "́", "don't", "I'LL", "ſ", "ẞ", "\x00", "!!!"]


def test_ids_equal_the_library(library):
    rng = random.Random(2)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 25))) for _ in range(4000)] + ["", " ", None]
    got = [x.tolist() for x in packing.Encoder(packing_tokenizer_path()).texts(pa.array(texts))]
    assert got == [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_long_texts_in_segments(library, monkeypatch):
    """Texts cut into segments behind white space have the same ids and words; a word longer than a segment stays whole."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices(ODD[:8] + ODD[22:26], k=rng.randint(1, 6))) for _ in range(n)) for n in (0, 1, 30, 300)] + ["x" * 9000 + " y " + "z" * 5000, "é " * 3000]
    for limit in (1, 7, 5000):
        monkeypatch.setattr("lattica.llm.text.SEGMENT_BYTES", limit)
        for t in texts:
            raw = np.frombuffer(t.encode(), np.uint8)
            assert b"".join(p.tobytes() for p in text.segments(raw)) == t.encode()
            assert [x.tolist() for x in packing.Encoder(packing_tokenizer_path()).texts(pa.array([t]))] == [library.encode(t, add_special_tokens=False).ids]
            found = {}
            for b in spelling._counted(1, 5)(iter([pa.RecordBatch.from_arrays([pa.array([3]), pa.array([t])], names=["id", "text"])])):
                found = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            want = collections.Counter(w for run in re.findall("[A-Za-zÀ-ÿ]+", t) if (w := spelling.altered("3", run.translate(LOWER), 5)))
            assert {w: n for w, n in found.items() if n} == dict(want)


def test_kept_pieces_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    rng, encode = random.Random(3), packing.Encoder(packing_tokenizer_path())
    for _ in range(20):
        text = " ".join("".join(rng.choices("abcde,'", k=4)) for _ in range(40))
        assert [x.tolist() for x in encode.texts(pa.array([text]))] == [library.encode(text, add_special_tokens=False).ids]


def check_pieces(rows, wanted, size):
    """Every id in one piece, sequences without gaps, nothing padded but where a task had no more."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        by_doc[(r["id"], r["doc_tokens"])].append((r["start"], ids))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    got = collections.Counter()
    for (doc, n), pieces in by_doc.items():
        copies = sum(s == 0 for s, _ in pieces)
        joined = [i for _, ids in sorted(pieces, key=lambda p: p[0]) for i in ids] if copies == 1 else None
        assert sum(len(ids) for _, ids in pieces) == n * copies
        got[doc, tuple(joined) if joined else None] += copies
    for doc, ids in wanted.items():
        assert any(d == doc and (x is None or list(x) == ids) for d, x in got), doc
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0
    return by_sequence


def test_pack_covers_all_ids(spark, library):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(rng.choice([0, 1, 5, 20, 60, 200]))) for _ in range(200)] + [None, "", "x" * 30000, "w " * 9000]
    rows = [(i, t, "x", 1, "y", "z", 2) for i, t in enumerate(texts)] + [(None, "null id", "x", 1, "y", "z", 2)]
    for size, open_ids in ((64, packing.OPEN_IDS), (64, 200), (2048, packing.OPEN_IDS), (1, 10)):
        got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), packing_tokenizer_path(), size=size, open_ids=open_ids).collect()
        wanted = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
        check_pieces(got, wanted, size)
        assert {r["id"] for r in got} == set(wanted)


def test_pack_of_repeated_rows_and_of_nothing(spark):
    rows = [(i // 400, "one text that most rows repeat word by word", "x", 1, "y", "z", 2) for i in range(800)]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(2), packing_tokenizer_path(), size=64).collect()
    n = got[0]["doc_tokens"]
    assert sum(r["length"] for r in got) == 800 * n
    assert packing.pack(spark.createDataFrame([], DOCS), packing_tokenizer_path()).count() == 0


def test_each_choice_keeps_the_sum_of_squares_smallest():
    """The level that is chosen for every document is one of those that a search over all levels finds, the fullest."""
    rng, size = np.random.default_rng(6), 50
    p, levels = packing.Packer(size), collections.Counter()
    for k in range(3000):
        n = int(rng.integers(1, size)) if k % 3 else 17
        after = {}
        for level in [0, *[h for h in levels if levels[h] and h + n <= size]]:
            new = levels.copy()
            if level:
                new[level] -= 1
            if level + n < size:
                new[level + n] += 1
            after[level] = sum(c * c for c in new.values())
        want = max(h for h in after if after[h] == min(after.values()))
        assert p.level_for(n) == want
        p.add((k, n), np.arange(n, dtype=np.uint32))
        if want:
            levels[want] -= 1
        if want + n < size:
            levels[want + n] += 1
        assert all(p.levels[h] == levels[h] for h in range(1, size))
    p.finish()
    fills = [sum(len(x[2]) for x in w) for w in p.done]
    assert sum(f != size for f in fills) <= 6 and all(f == size or f & (f - 1) == 0 for f in fills)


# spelling


def plain_variants(rows, least=5, occurrences=3, every=97):
    found = collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    words = {w: n for w, n in found.items() if len(w) >= least and n >= occurrences}
    near = {w: {v for v in words if spelling.one_edit(w.encode("latin-1"), v.encode("latin-1"))} for w in words}
    form = {}
    for w, vs in near.items():
        if vs:
            v = min(vs, key=lambda v: (-words[v], v))
            if words[v] >= 2 * words[w]:
                form[w] = v

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def one_edit_by_list(a, b):
    return a != b and (any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
                       or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1))


def test_one_edit():
    words = [bytes(w) for n in range(5) for w in itertools.product(b"ab", repeat=n)]
    table = spelling.Letters(words)
    pairs = np.array(list(itertools.product(range(len(words)), repeat=2)))
    wanted = [one_edit_by_list(words[i], words[j]) for i, j in pairs.tolist()]
    assert [spelling.one_edit(words[i], words[j]) for i, j in pairs.tolist()] == wanted
    assert table.near(pairs[:, 0], pairs[:, 1]).tolist() == wanted
    long = [b"q" * n + w + b"z" * m for n in (28, 29, 31) for w in (b"ab", b"b", b"ac", b"") for m in (0, 3)]
    pairs = np.array(list(itertools.product(range(len(long)), repeat=2)))
    assert spelling.Letters(long).near(pairs[:, 0], pairs[:, 1]).tolist() == [one_edit_by_list(long[i], long[j]) for i, j in pairs.tolist()]


def test_trie_reaches_all_near_words():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abcmno", k=rng.randint(4, 7))) for _ in range(1500)})
    coded = [w.encode() for w in words]
    vectors = spelling.vectors_of(coded)
    for leaf in (1, 32):
        reached = {(i, j) for a, b in spelling.FrequencyTrie(vectors, leaf).reached(vectors) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        wanted = {(i, j) for i in range(0, len(words), 20) for j in range(len(words)) if one_edit_by_list(coded[i], coded[j])}
        assert reached | {(j, i) for i, j in reached} >= wanted
        assert all(i == j or vectors[i].tolist() <= vectors[j].tolist() for i, j in reached)
        assert len(reached) < len(words) ** 2 / 4


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdeéÀÿß", k=rng.randint(4, 8))) for _ in range(60)]
    vocab = base + [w[:2] + rng.choice("abxÉ") + w[2 + rng.randint(0, 1) :] for w in base for _ in range(4)] + ["q" * 90, "q" * 91, "q" * 89 + "é"]
    rows = [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=rng.choice([5, 60, 400])))) for i in range(80)]
    rows += [(None, "aaaaa bbbbb " * 40), (7, "Straße,STRASSE;straße × naïve÷naïve " * 5), (8, None), (9, ""), (10, "1234 ---"), (11, "hot word " * 3000), (12, "x" * 100000 + " ")]
    return rows + rows[:10] + [(13, "hotter") for _ in range(40)]


def test_variants_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "w", 1, "i", "x", 0) for i, t in texts], DOCS).repartition(4)
    got = {tuple(r) for r in spelling.group_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(texts)
    got = {tuple(r) for r in spelling.group_variants(df, every=3, occurrences=1).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(texts, occurrences=1, every=3)


def test_shards_and_parts_change_nothing(spark, texts):
    """Small shards: deeper levels, and parts of one frequency vector's words (all letters permuted)."""
    words = ["".join(p) for p in itertools.permutations("abcde")] + ["".join(p) for p in itertools.permutations("abcd")] + ["".join(p) + "x" for p in itertools.permutations("abcd")]
    rows = spark.createDataFrame([(w, k % 7 + 3) for k, w in enumerate(words)], "word string, n long")
    for shard in (1000, 20):
        got = {r["word"]: (r["n_near"], r["form_n"], r["form"]) for r in spelling.near_words(rows, shard).collect()}
        count = {w: k % 7 + 3 for k, w in enumerate(words)}
        for w in words:
            near = [v for v in words if one_edit_by_list(w.encode(), v.encode())]
            best = min(near, key=lambda v: (-count[v], v)) if near else None
            assert got.get(w) == ((len(near), count[best], best) if near else None)


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert spelling.group_variants(empty).count() == 0
    one = spark.createDataFrame([(1, "single single single", "w", 1, "i", "x", 0)], DOCS)
    assert [tuple(r) for r in spelling.group_variants(one).select("word", "form", "root", "n", "n_near").collect()] == [("single", None, "single", 3, 0)]


def test_chains_follow_to_the_last(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(20)] + [("a", "w3"), ("b", "w20")], "word string, form string")
    assert {r["root"] for r in spelling.roots(links).collect()} == {"w20"}
    assert spelling.roots(links).count() == 22
