"""Hidden Markov language model for scoring texts.

Hidden states emit word classes and words follow their class: P(text) is the chance of the class sequence under
the chain, times, for each token, its share within its class.  A class follows from a word's spelling alone (its
last letters, shape and length), so that the expectation step needs no dictionary.  Transition and emission counts
of Baum-Welch are added up over all training documents in every round.  The start is what the corpus's counts of
neighbouring classes tell: the same chain fitted on that table of pairs, until it gains nothing more.  Word counts are exact counts over all training documents.  The likelihood of a class sequence is the
scaled forward recursion's, without approximation.

Long texts are cut into segments that are worked on side by side: the product of a segment's transition and emission
matrices carries a distribution from its beginning to its end, so that every segment starts and ends with the exact
vectors of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import block_count, fold, in_blocks, kept, prepare, signed
from lattica.llm.text import Words, chunks, lanes_of, lower_ascii, mix

BLOCK_BYTES = 8 << 20
STATES, CLASSES, ROUNDS = 6, 1024, 3
#: Rounds on the table of neighbouring classes, at most, and the log10 probability a pair that a round must gain.
PAIR_ROUNDS, PAIR_GAIN = 200, 1e-6
#: Tokens of a segment.
SEGMENT = 1024
SMOOTH = 0.1
_U = np.uint64
_KEEP3 = _U(0xFFFFFF)


def word_classes(w: Words) -> np.ndarray:
    """1..CLASSES - 1 for each lower-cased word: its length up to 3 bytes in full, else its last three bytes; 0 is the end."""
    length = w.end - w.start
    tail = lanes_of(w.data)[np.maximum(w.end - 3, w.start)] & np.where(length >= 3, _KEEP3, (_U(1) << (_U(8) * np.minimum(length, 3).astype(_U))) - _U(1))
    key = tail | (np.minimum(length, 4) // 4).astype(_U) << _U(32)
    return (mix(key) % _U(CLASSES - 1)).astype(np.int64) + 1


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, classes of all tokens (each text's words, then its end), and where each text's tokens begin (n + 1)."""
    w = Words(lower_ascii(data), offsets)
    first = w.first + np.arange(len(w.first))
    out = np.zeros(first[-1], np.int64)
    out[np.arange(len(w)) + w.text_of()] = word_classes(w)
    return w, out, first


@dataclass(frozen=True)
class Chain:
    """Start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(class_counts: np.ndarray, states: int = STATES) -> Chain:
        """A start for Baum-Welch: the classes' shares in the corpus, drawn apart by state."""
        rng = np.random.default_rng(3)
        share = (class_counts + SMOOTH) / (class_counts + SMOOTH).sum()
        return Chain(rng.random(states) + 0.5, rng.random((states, states)) + 0.5 + 2 * np.eye(states), share * (rng.random((states, len(share))) + 0.5)).normal()

    @staticmethod
    def from_pairs(pairs: np.ndarray, states: int = STATES) -> Chain:
        """The chain whose neighbouring classes come nearest to the corpus's: expectation-maximisation on their counts.

        ``pairs`` counts (class, next class), a text's first token as one that follows an end.
        """
        total = pairs.sum()
        first = Chain.first(pairs.sum(axis=0), states)
        joint, emit, share, last = first.move / states, first.emit, pairs / max(total, 1.0), -np.inf
        for _ in range(PAIR_ROUNDS if total else 0):
            chance = emit.T @ joint @ emit
            ratio = share / chance
            gained = float((share * np.log10(chance)).sum())
            if gained - last < PAIR_GAIN:
                break
            last = gained
            right = ratio @ emit.T  # by class and by the state that follows
            left = ratio.T @ emit.T
            new = emit * (right @ joint.T + left @ joint).T
            joint = joint * (emit @ right)
            emit = new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300) * total + SMOOTH
            emit, joint = emit / emit.sum(axis=1, keepdims=True), joint / joint.sum()
        return Chain(emit[:, 0] @ joint + 1e-9, joint + 1e-12, emit).normal()

    def normal(self) -> Chain:
        part = lambda x: x / x.sum(-1, keepdims=True)
        return Chain(part(self.start), part(self.move), part(self.emit))

    @staticmethod
    def from_counts(counts: np.ndarray, states: int = STATES, classes: int = CLASSES) -> Chain:
        """The chain that expected counts lead to, smoothed so that no probability is zero."""
        a, b = states, states + states * states
        return Chain(counts[:a] + SMOOTH, counts[a:b].reshape(states, states) + SMOOTH, counts[b:].reshape(states, classes) + SMOOTH).normal()


def _steps(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from the longest down, and how many of them have a token at each step."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    return order, np.searchsorted(-size[order], -np.arange(size.max() if len(size) else 0), "left")


class Segments:
    """Texts cut into segments: where each begins (n + 1), its text, and its number within the text."""

    def __init__(self, chain: Chain, tokens: np.ndarray, first: np.ndarray):
        number = -(-np.diff(first) // SEGMENT)
        self.chain, self.tokens, self.emit = chain, tokens, np.ascontiguousarray(chain.emit.T)
        self.text = np.repeat(np.arange(len(number)), number)
        self.nth = np.arange(len(self.text)) - np.repeat(np.cumsum(number) - number, number)
        self.first = np.r_[first[:-1][self.text] + self.nth * SEGMENT, first[-1]]
        self.last = self.nth == number[self.text] - 1
        self.by_number = [np.flatnonzero(self.nth == k) for k in range(1, int(number.max()) if len(number) else 1)]
        self.through = self._products() if self.by_number else None

    def _products(self) -> np.ndarray:
        """For segments of texts with several, emission and transition matrices from the first to the last token, scaled."""
        k = len(self.chain.start)
        out = np.zeros((len(self.text), k, k))
        own = np.flatnonzero((self.nth > 0) | ~self.last)
        size = np.diff(self.first)[own]
        order, live = _steps(np.r_[0, np.cumsum(size)])
        begin = self.first[:-1][own][order]
        a = np.broadcast_to(np.eye(k), (len(own), k, k))
        for t in range(len(live)):
            m = live[t]
            done = a[m:]
            if len(done):
                out[own[order[m : len(a)]]] = done / done.sum(axis=(1, 2), keepdims=True)
            a = a[:m] if not t else (a[:m].reshape(m * k, k) @ self.chain.move).reshape(m, k, k)
            a = a * self.emit[self.tokens[begin[:m] + t]][:, None, :]
            if t % 16 == 15:
                a /= a.sum(axis=(1, 2), keepdims=True)
        out[own[order[: len(a)]]] = a / a.sum(axis=(1, 2), keepdims=True)
        return out

    def entries(self) -> np.ndarray:
        """The distribution of each segment's first state given all tokens of the text before it."""
        out = np.tile(self.chain.start, (len(self.text), 1))
        for now in self.by_number:
            v = np.einsum("si,sij->sj", out[now - 1], self.through[now - 1]) @ self.chain.move
            out[now] = v / v.sum(axis=1, keepdims=True)
        return out

    def exits(self, alphas: np.ndarray) -> np.ndarray:
        """For each segment's last state, the chance of all tokens of the text after it, scaled so that alpha times it is 1."""
        out = np.ones((len(self.text), len(self.chain.start)))
        for now in reversed(self.by_number):
            v = np.einsum("sij,sj->si", self.through[now], out[now]) @ self.chain.move.T
            out[now - 1] = v / (alphas[self.first[now] - 1] * v).sum(axis=1, keepdims=True)
        return out


def forward(chain: Chain, tokens: np.ndarray, first: np.ndarray, keep: bool = False):
    """log10 likelihood of each text by the scaled recursion, all segments a step at a time.

    With ``keep``, also the segments, the scaled vectors and the scales.
    """
    cut, k = Segments(chain, tokens, first), len(chain.start)
    order, live = _steps(cut.first)
    begin, total = cut.first[:-1][order], np.zeros(len(cut.text))
    alphas = np.zeros((len(tokens), k)) if keep else None
    scales = np.zeros(len(tokens)) if keep else None
    a = cut.entries()[order]
    for t in range(len(live)):
        m, at = live[t], begin[: live[t]] + t
        a = (a[:m] @ chain.move if t else a[:m]) * cut.emit[tokens[at]]
        s = a.sum(axis=1)
        a = a / s[:, None]
        total[:m] += np.log10(s)
        if keep:
            alphas[at], scales[at] = a, s
    out = np.bincount(cut.text[order], total, len(first) - 1)
    return (out, cut, alphas, scales) if keep else out


def expected(chain: Chain, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected start, transition and emission counts of the texts, as one flat array."""
    k, classes = chain.emit.shape
    _, cut, alphas, scales = forward(chain, tokens, first, True)
    order, live = _steps(cut.first)
    begin, ends = cut.first[:-1][order], cut.exits(alphas)[order]
    gamma, moves, b = np.zeros((len(tokens), k)), np.zeros((k, k)), np.zeros((0, k))
    back = np.ascontiguousarray(chain.move.T)
    for t in range(len(live) - 1, -1, -1):
        at, grown = begin[: live[t]] + t, ends[: live[t]].copy()
        if len(b):
            own = at[: len(b)]
            e = cut.emit[tokens[own + 1]] * b / scales[own + 1][:, None]
            moves += alphas[own].T @ e
            grown[: len(b)] = e @ back
        b = grown
        gamma[at] = alphas[at] * b
    over = np.flatnonzero(cut.nth[order] > 0)  # transitions from one segment to the next
    if len(over):
        at = begin[over]
        moves += alphas[at - 1].T @ (cut.emit[tokens[at]] * b[over] / scales[at][:, None])
    emitted = np.stack([np.bincount(tokens, gamma[:, j], classes) for j in range(k)])
    return np.concatenate([gamma[first[:-1]].sum(axis=0), (moves * chain.move).ravel(), emitted.ravel()])


#: Bytes of text in a forward or backward pass, about.
PASS_BYTES = 4 << 20


def _expectation(chain: Chain):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(chain.start) * (1 + len(chain.start) + chain.emit.shape[1]))
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text"), PASS_BYTES):
                _, tokens, first = sequences(data, offsets)
                total += expected(chain, tokens, first)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])
    return work


def _pairs(classes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text"), PASS_BYTES):
                _, tokens, first = sequences(data, offsets)
                before = np.r_[0, tokens[:-1]]
                before[first[:-1]] = 0  # a text's first token follows an end
                total += np.bincount(before * classes + tokens, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])
    return work


def pair_counts(docs: DataFrame, text: str = "text", classes: int = CLASSES) -> np.ndarray:
    """How often each class follows each other one in the corpus; a task emits a row for a pair of classes that it has met."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    sums = rows.mapInArrow(_pairs(classes), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # classes squared at most
    out = np.zeros(classes * classes)
    out[sums["at"].to_numpy(np.int64)] = sums["n"]
    return out.reshape(classes, classes)


def train(docs: DataFrame, text: str = "text", states: int = STATES, rounds: int = ROUNDS, classes: int = CLASSES) -> Chain:
    """Baum-Welch: ``rounds`` rounds over all documents, from the chain that the counts of neighbouring classes give.

    A round is one pass: tasks add up expected counts of their texts, and Spark sums them by position, so that
    states x (1 + states + classes) numbers reach the driver whatever the size of the corpus.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    chain = Chain.from_pairs(pair_counts(docs, text, classes), states)
    for _ in range(rounds):
        sums = rows.mapInArrow(_expectation(chain), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(states * (1 + states + classes))
        counts[sums["at"].to_numpy(np.int64)] = sums["n"]
        chain = Chain.from_counts(counts, states, classes)
    return chain


def _vocabulary_rows(buckets: int):
    """Per block: each distinct word once, with its class and its count in training texts."""
    def make(t: pa.Table) -> pa.Table:
        _, _, data, offsets = next(chunks(t.column("text").combine_chunks(), 1 << 62))
        w = Words(lower_ascii(data), offsets)
        h, learn = w.hashes(9), np.repeat(t.column("learn").to_numpy(), w.per_text)
        order = np.argsort(h, kind="stable")
        s = h[order]
        begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
        n = np.add.reduceat(learn[order].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        name, kind = s[begin], word_classes(w)[order][begin]
        bucket = ((name >> _U(20)) % _U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        held, cut = np.unique(bucket[by], return_index=True)
        off = pa.array(np.r_[cut, len(by)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(off, pa.array(x[by])) for x in (signed(name), n, kind.astype(np.int16))]
        block = pa.array(np.full(len(held), t.column("block")[0].as_py(), np.int32))
        return pa.table([block, pa.array(held.astype(np.int32)), *lists], names=["block", "bucket", "h", "n", "kind"])
    return make


def _sum_words(t: pa.Table) -> pa.Table:
    """Counts of a bucket's words over all blocks, back to each block; and a row (block -1) of totals by class."""
    flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy()
    h, n, kind = flat("h"), flat("n"), flat("kind")
    block = np.repeat(t.column("block").to_numpy(), pc.list_value_length(t.column("h")).to_numpy())
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]][: len(s)]
    begin = np.flatnonzero(new)
    total = np.add.reduceat(n[order], begin) if len(begin) else n[:0]
    seen = total > 0
    sums = np.concatenate([np.bincount(kind[order][begin], total, CLASSES), np.bincount(kind[order][begin], seen, CLASSES)]).astype(np.int64)
    keep = seen[np.cumsum(new) - 1] if len(s) else np.zeros(0, bool)
    rows, value = order[keep], total[np.cumsum(new) - 1][keep] if len(s) else total
    by = np.argsort(block[rows], kind="stable")
    held, cut = np.unique(block[rows][by], return_index=True)
    off = np.r_[cut, len(by), len(by)].astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(np.r_[x[by]])) for x in (h[rows], value)]
    stats = pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(len(held) + 1, np.int32), np.int32(len(sums))]), pa.array(sums))
    return pa.table([pa.array(np.r_[held, -1].astype(np.int32)), *lists, stats], names=["block", "h", "n", "sums"])


def _scorer(chain: Chain, n_class: np.ndarray, v_class: np.ndarray):
    """Scores of a block's texts, given the training counts of its words."""
    total, distinct = float(n_class.sum()), float(v_class.sum())
    base_low = np.log10(total + SMOOTH * (distinct + 1))
    class_low = np.log10(n_class + SMOOTH * (v_class + 1))

    def make(docs: pa.Table, known: pa.Table) -> pa.Table:
        names = ["id", "learn", "n_tokens", "n_known", "base_score", "score"]
        if not docs.num_rows:
            return pa.table([docs.column("id"), docs.column("learn"), *(pa.array([], k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)
        flat = lambda c: known.column(c).combine_chunks().flatten().to_numpy() if known.num_rows else np.zeros(0, np.int64)
        h, n = flat("h").view(_U), flat("n")
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        columns = []
        for _, _, data, offsets in chunks(docs.column("text").combine_chunks(), 2 * BLOCK_BYTES):
            w, tokens, first = sequences(data, offsets)
            mine = w.hashes(9)
            at = np.minimum(np.searchsorted(h, mine), max(0, len(h) - 1))
            count = np.where(h[at] == mine, n[at], 0) if len(h) else np.zeros(len(w), np.int64)
            c = np.full(len(tokens), n_class[0], np.int64)
            c[np.arange(len(w)) + w.text_of()] = count
            sums = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  a text has one token at least
            log = np.log10(c + SMOOTH)
            columns.append((np.diff(first), sums((c > 0).astype(np.int64)), sums(log - base_low), forward(chain, tokens, first) + sums(log - class_low[tokens])))
        out = [np.concatenate(x) for x in zip(*columns, strict=True)]
        return pa.table([docs.column("id"), docs.column("learn"), *map(pa.array, out)], names=names)
    return make


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 10, held: int = 0) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    The model learns from rows whose crc32(id as text) mod ``folds`` is not ``held``.  base_score is the smoothed
    unigram log10 probability, score the hidden Markov model's.  Null and empty texts are one end token.  A null id
    has held_out = null and is not learnt from.  Without training rows every token is unknown and the chain is
    what smoothing alone gives.  Repeated rows count as often as they occur; extra columns are ignored.
    """
    prepare(docs.sparkSession)
    learn = F.coalesce(fold(id, folds) != held, F.lit(False))
    blocks = block_count(docs, text, BLOCK_BYTES)
    rows = in_blocks(docs, id, text, blocks).withColumn("learn", F.coalesce(fold("id", folds) != held, F.lit(False)))
    by_block = rows.groupBy("block")
    counts = kept(
        by_block.applyInArrow(_vocabulary_rows(blocks), "block int, bucket int, h array<long>, n array<long>, kind array<short>")
        .groupBy("bucket").applyInArrow(_sum_words, "block int, h array<long>, n array<long>, sums array<long>"))
    stats = counts.where("block = -1").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(2 * CLASSES, np.int64)
    sums[stats["at"].to_numpy(np.int64)] = stats["n"]
    ends = docs.where(learn).count()
    sums[0], sums[CLASSES] = ends, int(ends > 0)
    chain = train(docs.where(learn), text)
    found = by_block.cogroup(counts.where("block >= 0").select("block", "h", "n").groupBy("block")).applyInArrow(
        _scorer(chain, sums[:CLASSES], sums[CLASSES:]),
        f"id {rows.schema['id'].dataType.simpleString()}, learn boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("id", (fold("id", folds) == held).alias("held_out"), "n_tokens", "n_known",
                        F.lit(int(sums[:CLASSES].sum())).cast("long").alias("train_tokens"), "base_score", "score")
