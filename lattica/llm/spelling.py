"""Spelling variants: words one edit apart, by a frequency-vector trie.

A word's frequency vector counts its letters by letter group.  One inserted letter adds one to a group, one deleted
letter takes one away, one replaced letter does both at most; so the vectors of near words differ by a surplus of one
and a deficit of one at most.  Words stand in a trie by the successive counts; a depth-first search walks it with all
words that ask at once, and a word follows a branch as long as its surplus and its deficit are not spent twice.  Words
in the leaves that it reaches are verified on their letters.  A pair is looked for from its smaller vector only, so a
word spends its surplus first.

On Spark, the trie's upper levels are the shards: a word is held in the shard of its own first counts and asks in every
shard that the budget reaches upwards.  Only each word's number of near words and its best one leave a task, never pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import discard, kept, prepare, releasing, small
from lattica.llm.text import Words, chunks, lower_ascii, segments

#: Letter groups: a letter's group is its code point modulo this.
GROUPS = 12
#: Words of a shard, at most (a larger one is dealt into parts, and all parts are asked).
SHARD_WORDS = 5000
#: Words of a trie node that is not split further.
LEAF_WORDS = 32
#: Levels of the trie that shards are made of, at most.
SHARD_LEVELS = 5
#: Distinct words that a counting task gathers before it passes them on.
COUNTED_WORDS = 200_000
#: Bytes of a run up to which check sums come from a table.
SHORT = 64
#: Pairs that are verified at once.
PAIRS = 100_000


@lru_cache(maxsize=1)
def _crc_step() -> np.ndarray:
    """How one zero byte moves a CRC-32 state, by the state's low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF (which are 0xC3 and one more byte)."""
    low = data | 0x20
    lead = data == 0xC3
    inside = ((low >= 97) & (low <= 122)) | lead
    inside[1:] |= lead[:-1]
    return inside


def altered(doc: str, run: str, every: int) -> str:
    """The run, without one code point if ``every`` divides the check sum of ``<doc>:<run>``."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % every:
        return run
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def _add_words(found: dict[bytes, int], docs: list[str], data: np.ndarray, offsets: np.ndarray, least: int, every: int) -> None:
    """Count a chunk's words into ``found``."""
    runs = Words(lower_ascii(data), offsets, _letters(data))
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0xC3, out=before[1:])
    letters = runs.end - runs.start - (before[runs.end] - before[runs.start])
    text = runs.text_of()
    long = letters >= least  # taking a letter out makes no run longer
    runs.start, runs.end, text, letters = runs.start[long], runs.end[long], text[long], letters[long]
    if not len(runs):
        return
    raw, size = runs.data.tobytes(), runs.end - runs.start
    first, inverse = runs.distinct()
    names = [raw[s:e] for s, e in zip(runs.start[first].tolist(), runs.end[first].tolist(), strict=True)]
    # crc(doc + ":" + run) is the first part's sum, moved over the run's bytes, and the run's own sum
    own = np.array([zlib.crc32(x) for x in names], np.uint32)
    moved, step = np.empty((SHORT + 1, len(docs)), np.uint32), _crc_step()
    moved[0] = [zlib.crc32(f"{d}:".encode()) for d in docs]
    for k in range(SHORT):
        moved[k + 1] = step[moved[k] & 255] ^ (moved[k] >> 8)
    h = moved[np.minimum(size, SHORT), text] ^ own[inverse]
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = zlib.crc32(names[inverse[i]], int(moved[0, text[i]]))
    hit = h % np.uint32(every) == 0
    for word, n in zip(names, np.bincount(inverse[~hit], minlength=len(names)).tolist(), strict=True):
        found[word] = found.get(word, 0) + n
    hit &= letters > least
    for k, at in zip(inverse[hit].tolist(), (h[hit] % letters[hit]).tolist(), strict=True):
        word = names[k].decode()
        word = (word[:at] + word[at + 1 :]).encode()
        found[word] = found.get(word, 0) + 1


def _counted(least: int, every: int):
    def batch_of(found: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            ids = pc.fill_null(batch.column(0).cast(pa.string()), "").to_pylist()
            for i, j, data, offsets in chunks(batch.column(1)):
                for part in segments(data) if j - i == 1 else [data]:  # a very long text is counted in segments
                    _add_words(found, ids[i:j], part, np.array([0, len(part)]) if j - i == 1 else offsets, least, every)
                if len(found) > COUNTED_WORDS:
                    yield batch_of(found)
                    found = {}
        yield batch_of(found)
    return run


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 5, occurrences: int = 3, every: int = 97) -> DataFrame:
    """(word, n) of all words of at least ``least`` letters that occur ``occurrences`` times or more, over whole texts."""
    rows = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
    found = rows.mapInArrow(releasing(_counted(least, every)), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def vectors_of(words: list[bytes]) -> np.ndarray:
    """Letters by group of each word (Latin-1 bytes, one a letter)."""
    out = np.zeros((len(words), GROUPS), np.int32)
    flat = np.frombuffer(b"".join(words), np.uint8)
    np.add.at(out, (np.repeat(np.arange(len(words)), [len(w) for w in words]), flat % GROUPS), 1)
    return out


def _with_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = vectors_of([w.encode("latin-1") for w in batch.column(0).to_pylist()])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), GROUPS).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["word", "n", "vec"])


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one letter inserted, deleted or replaced makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Letters:
    """Words as rows of letters for comparing many pairs at once; long words are compared one by one."""

    WIDE = 30

    def __init__(self, words: list[bytes]):
        self.words, self.size = words, np.array([len(w) for w in words], np.int64)
        held = np.array([w[: self.WIDE] for w in words], f"S{self.WIDE + 2}")
        self.cells = np.frombuffer(held.tobytes(), np.uint8).reshape(len(words), self.WIDE + 2)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        swap = self.size[i] > self.size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        wide = self.size[j] > self.WIDE
        for at in range(0, len(i), PAIRS):
            s = slice(at, at + PAIRS)
            a, b = self.cells[i[s]], self.cells[j[s]]
            more = self.size[j[s]] - self.size[i[s]]
            unlike = a != b
            same = more == 0
            hit = same & (unlike.sum(axis=1) == 1)
            one = np.flatnonzero(more == 1)
            if len(one):
                late = np.arange(a.shape[1] - 1) >= unlike[one].argmax(axis=1)[:, None]  # from the first difference on
                hit[one] = ~((a[one, :-1] != b[one, 1:]) & late).any(axis=1)
            out[s] = hit
        for k in np.flatnonzero(wide).tolist():
            out[k] = one_edit(self.words[i[k]], self.words[j[k]])
        return out


class FrequencyTrie:
    """A trie over the rows of ``vectors`` by successive counts: rows in order, a node is a range of them at a depth."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF_WORDS):
        self.order = np.lexsort(vectors.T[::-1])
        self.rows, self.leaf = vectors[self.order], leaf

    def reached(self, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asking row, held row) pairs whose vectors keep within a surplus of one and a deficit of one, the held one not the smaller."""
        n = np.arange(len(asking))
        if len(n) and len(self.rows):
            yield from self._walk(asking, 0, len(self.rows), 0, n, np.zeros(len(n), bool), np.zeros(len(n), bool))

    def _walk(self, asking, low, high, depth, who, surplus, deficit):
        if high - low <= self.leaf or depth == self.rows.shape[1]:
            step = max(1, PAIRS // (high - low))
            for k in range(0, len(who), step):
                w = who[k : k + step]
                change = self.rows[None, low:high, depth:] - asking[w, None, depth:]
                up = np.maximum(change, 0).sum(axis=2) + surplus[k : k + step, None]
                down = np.maximum(-change, 0).sum(axis=2) + deficit[k : k + step, None]
                fits = (up <= 1) & (down <= 1)
                first = np.take_along_axis(change, (change != 0).argmax(axis=2)[..., None], 2)[..., 0] if change.shape[2] else 0
                i, j = np.nonzero(fits & (surplus[k : k + step, None] | (first >= 0)))
                if len(i):
                    yield w[i], self.order[low + j]
            return
        column = self.rows[low:high, depth]
        cut = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(column)], strict=True):
            change = int(column[s]) - asking[who, depth]
            go = (change == 0) | ((change == 1) & ~surplus) | ((change == -1) & ~deficit & surplus)
            if go.any():
                yield from self._walk(asking, low + s, low + e, depth + 1, who[go], surplus[go] | (change[go] == 1), deficit[go] | (change[go] == -1))


def _search(t: pa.Table) -> pa.Table:
    held = t.filter(t.column("held"))
    ask = t.filter(pc.invert(t.column("held")))
    names = ask.column("word").to_pylist()
    once = list({w: k for k, w in enumerate(names)}.values())  # a word may ask in several shards of this bin
    ask, names = ask.take(pa.array(once, pa.int64())), [names[k] for k in once]
    own = held.column("word").to_pylist()
    matrix = lambda x: x.column("vec").combine_chunks().flatten().to_numpy().reshape(len(x), GROUPS)
    words = own + names
    letters, asked, kept_vectors = Letters([w.encode("latin-1") for w in words]), matrix(ask), matrix(held)
    rank = np.empty(len(words), np.int64)  # in code-point order, equal for equal words
    rank[:] = np.unique(np.array([w.encode("utf-8") for w in words] or [b""], object), return_inverse=True)[1][: len(words)]
    found = [(np.zeros(0, np.int64),) * 2]
    for i, j in FrequencyTrie(kept_vectors).reached(asked):
        i, j = (x[letters.near(j, i + len(own))] for x in (i, j))
        one_way = (rank[i + len(own)] < rank[j]) | (asked[i] != kept_vectors[j]).any(axis=1)
        found.append((i[one_way] + len(own), j[one_way]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    n = np.concatenate([held.column("n").to_numpy(), ask.column("n").to_numpy()])
    a, b = np.concatenate([i, j]), np.concatenate([j, i])  # a pair counts for both of its words
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    who, first, count = np.unique(a, return_index=True, return_counts=True)
    best = b[first]
    return pa.table([pa.array([words[k] for k in who.tolist()], pa.string()), pa.array(count), pa.array(n[best]), pa.array([words[k] for k in best.tolist()], pa.string())],
                    names=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) of the words that have a near word: how many, and the most frequent (ties: the smallest).

    ``words`` holds distinct words of Latin-1 letters and counts (word, n).
    """
    rows = kept(words.mapInArrow(_with_vectors, "word string, n long, vec array<int>"))
    classes = kept(rows.groupBy("vec").agg(F.count(F.lit(1)).alias("words")))
    levels = 0
    while levels < SHARD_LEVELS:
        levels += 1
        shards = classes.groupBy(F.slice("vec", 1, levels).alias("shard")).agg(F.sum("words").alias("words"))
        if (shards.agg(F.max("words")).first()[0] or 0) <= shard_words:
            break
    parts = small(kept(shards.where(F.col("words") > shard_words).select("shard", F.ceil(F.col("words") / shard_words).cast("int").alias("parts"))))
    bins = max(1, -(-rows.count() // (shard_words // 2)))
    unit = np.eye(levels, dtype=int)
    steps = [np.zeros(levels, int), *unit, *(unit[a] - unit[b] for a in range(levels) for b in range(a + 1, levels))]
    moves = F.array(*(F.array(*(F.lit(int(x)) for x in s)) for s in steps))
    own = F.slice("vec", 1, levels)
    reach = F.filter(F.transform(moves, lambda s: F.zip_with(own, s, lambda a, b: a + b)), lambda v: F.forall(v, lambda x: x >= 0))
    bin_of = lambda part: F.pmod(F.xxhash64("shard", part), F.lit(bins)).cast("int").alias("bin")
    held = (
        rows.withColumn("shard", own).join(parts, "shard", "left")
        .select(bin_of(F.coalesce(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.lit(0))), "word", "n", "vec", F.lit(True).alias("held"))
    )
    ask = (
        rows.withColumn("shard", F.explode(reach)).join(parts, "shard", "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        .select(bin_of(F.col("part")), "word", "n", "vec", F.lit(False).alias("held"))
    )
    found = held.union(ask).groupBy("bin").applyInArrow(releasing(_search), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def roots(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root): the word at which the links (word, form) end; a form is never linked back, counts at least double."""
    now = kept(links.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = kept(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        moved = new.where("moved").limit(1).count()
        discard(now)
        now = new.select("word", "root")
        if not moved:
            return now
    raise RuntimeError(f"links did not end in {rounds} rounds")


def group_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 5, occurrences: int = 3, every: int = 97, ratio: int = 2) -> DataFrame:
    """Group spelling variants: (word, form, root, n, n_near, form_n), a row for each counted word.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where ``every`` divides the crc32 of
    ``<id>:<run>`` one letter is taken out (planted variants; a null id is hashed as an empty one).  Counted are the
    distinct words of ``least`` letters and ``occurrences`` occurrences.  A word's form is its most frequent near word
    (ties: the smallest) if that occurs ``ratio`` times as often or more; root follows the forms to the last.

    Null and empty texts have no words, repeated rows count each time, other columns are ignored, and an empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    words = kept(word_counts(docs, id, text, least, occurrences, every))
    near = kept(near_words(words))
    told = kept(words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))).select(
        "word", F.when(F.col("has"), F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("form_n")).alias("form_n")))
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
