"""Sum-of-squares online packing of documents into token windows.

A document is its token ids and an end id.  Whole windows are cut from its front; what is left goes, as it comes, to
the fill level that keeps the sum of squared counts of partially filled windows smallest: windows of one level are
interchangeable, so a level array of counts is all that the choice looks at.  Windows that are still open at the end
of a task, or when too many are open, are closed by cutting: their pieces are strung together into full windows, and
the last rest goes to windows of a power of two, which need no padding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import prepare, releasing
from lattica.llm.text import Words, chunks, lower_ascii, segments

#: Ids that a task holds in open windows, at most; beyond that they are closed by cutting.
OPEN_IDS = 4_000_000
#: Encoded pieces that a worker keeps, at most.
KEPT_WORDS = 500_000
#: Pieces of letters that are encoded as one text.
JOINED = 500
#: Sequence numbers of a task start at its partition's number times this.
TASK_STEP = 1 << 36
#: Rows of an output batch.
OUT_ROWS = 2000


# Bytes of words that are cut into letters, digits and the rest before merging, as the tokenizer does.
_LETTER, _DIGIT, _OTHER, _WHOLE = range(4)
_CLASS = np.full(256, _WHOLE, np.uint8)  # words that hold an apostrophe, < or a byte beyond ASCII are looked up as they are
_CLASS[33:127] = _OTHER
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[0x27, 0x3C]] = _WHOLE


def pieces(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of a chunk, those of plain ASCII cut further into runs of letters, single digits and runs of other marks."""
    words = Words(data, offsets)
    if not len(words):
        return words
    kind = _CLASS[data]
    odd = np.add.reduceat((kind == _WHOLE).astype(np.int64), np.stack([words.start, words.end], axis=1).ravel()[: 2 * len(words) - (words.end[-1] == len(data))])[::2] > 0
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start[~odd]] += 1
    inside[words.end[~odd]] -= 1
    cut &= np.cumsum(inside).astype(bool)
    cut[words.end] = False
    cut[words.start] = True
    start = np.flatnonzero(cut)
    after = np.searchsorted(words.start, start, "right") - 1
    end = np.minimum(words.end[after], np.r_[start[1:], len(data)])
    words.start, words.end, words.first = start, end, np.searchsorted(start, offsets)
    return words


class Encoder:
    """Token ids of whole texts by the tokenizers library, each distinct piece encoded once and kept.

    For tokenizers whose tokens never span white space and that drop it, lower-case, cut letters, digits and marks as
    ``pieces`` does, and close each piece with a word-end mark.  Pieces of letters are encoded many at a time: a
    token with the word-end mark is the last of its piece.  Where the marks are not as many as the pieces (letters that
    fall apart when normalised), and for all other pieces, each is encoded by itself.
    """

    def __init__(self, path: str, mark: str = "</w>"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        text = [w.decode() for w in new]
        letters = [t.isalpha() for t in text]
        plain, rest = ([k for k, p in enumerate(letters) if p is wanted] for wanted in (True, False))
        parts = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        order, ids, size = [], [self.ids], [self.size]
        for part, found in zip(parts, self._encode([" ".join(text[k] for k in part) for part in parts]), strict=True):
            found = np.array(found, np.uint32)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) == len(part):
                order += part
                ids.append(found)
                size.append(np.diff(ends, prepend=0))
            else:
                rest += part
        each = self._encode([text[k] for k in rest])
        for slot, k in enumerate(order + rest, len(self.known)):
            self.known[new[k]] = slot
        self.ids = np.concatenate([*ids, np.array([i for x in each for i in x], np.uint32)])
        self.size = np.concatenate([*size, np.array([len(x) for x in each], np.int64)])
        self.begin = np.cumsum(self.size) - self.size

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Where each of the distinct ``words`` is kept; new ones are encoded."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT_WORDS:
            self.forget()
            new = words
        if new:
            self._learn(new)
        return np.array([self.known[w] for w in words], np.int64)

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        words = pieces(lower_ascii(data), offsets)
        first, inverse = words.distinct()
        raw = words.data.tobytes()
        slot = self.slots([raw[s:e] for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)])[inverse]
        size = self.size[slot]
        shift = np.repeat(self.begin[slot] - (np.cumsum(size) - size), size)
        ids = self.ids[np.arange(len(shift)) + shift]
        ends = np.r_[0, np.cumsum(size)][words.first]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn; a null text counts as empty, a very long one is worked on in segments."""
        for _, _, data, offsets in chunks(column):
            if len(offsets) == 2:
                yield np.concatenate([self._ids(part, np.array([0, len(part)]))[0] for part in segments(data)])
            else:
                yield from self._ids(data, offsets)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Windows of one task.  A piece is (document, start, ids); ``done`` holds finished windows as lists of pieces."""

    def __init__(self, size: int, open_ids: int = OPEN_IDS):
        self.size, self.open_ids, self.held = size, open_ids, 0
        self.levels = np.zeros(size + 1, np.int64)  #: open windows by fill level
        self.open: dict[int, list[list]] = {}
        self.done: list[list] = []

    def level_for(self, n: int) -> int:
        """The level to which a piece of ``n`` ids goes; 0 is a new window.  Ties: the fullest level."""
        last = self.size - n
        now, then = self.levels[1 : last + 1], self.levels[1 + n : self.size + 1]
        change = 2 * (then - now) + 2
        if last:
            change[-1] = 1 - 2 * now[-1]  # a window that becomes full leaves the array
        change = np.where(now > 0, change, np.iinfo(np.int64).max)
        best, least = 0, 2 * int(self.levels[n]) + 1
        if last:
            k = last - 1 - int(np.argmin(change[::-1]))
            if change[k] <= least:
                best = k + 1
        return best

    def add(self, document, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        self.done += [[(document, s, ids[s : s + self.size])] for s in range(0, whole, self.size)]
        n = len(ids) - whole
        if not n:
            return
        level = self.level_for(n)
        window = []
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
        window.append((document, whole, ids[whole:].copy()))
        if level + n == self.size:
            self.done.append(window)
            self.held -= level
            return
        self.open.setdefault(level + n, []).append(window)
        self.levels[level + n] += 1
        self.held += n
        if self.held > self.open_ids:
            rest = self.cut()
            if rest:
                level = sum(len(x[2]) for x in rest)
                self.open, self.held = {level: [rest]}, level
                self.levels[level] = 1

    def cut(self) -> list:
        """Close all open windows, the fullest first, by cutting pieces at window ends; returns the last, partly filled one."""
        window, level = [], 0
        for fill in sorted(self.open, reverse=True):
            for document, start, ids in (p for w in self.open[fill] for p in w):
                while len(ids):
                    n = min(len(ids), self.size - level)
                    window.append((document, start, ids[:n]))
                    start, ids, level = start + n, ids[n:], level + n
                    if level == self.size:
                        self.done.append(window)
                        window, level = [], 0
        self.open, self.held = {}, 0
        self.levels[:] = 0
        return window

    def finish(self) -> None:
        """Close everything; the last rest goes to windows whose sizes are powers of two."""
        rest = self.cut()
        left = sum(len(x[2]) for x in rest)
        while left:
            room, window = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                document, start, ids = rest[0]
                n = min(len(ids), room)
                window.append((document, start, ids[:n]))
                rest[0] = (document, start + n, ids[n:])
                room -= n
                if n == len(ids):
                    rest.pop(0)
            self.done.append(window)


def _batches(done: list[list], ids: pa.DataType, number: int) -> Iterator[pa.RecordBatch]:
    rows = [((d, start, len(x), x.tobytes()), number + k, at) for k, window in enumerate(done)
            for (d, start, x), at in zip(window, np.cumsum([0] + [len(p[2]) for p in window[:-1]]).tolist(), strict=True)]
    for k in range(0, len(rows), OUT_ROWS):
        part = rows[k : k + OUT_ROWS]
        columns = [
            pa.array([r[0][0][0] for r in part], ids), *(pa.array([r[0][c] for r in part], t) for c, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary()))),
            pa.array([r[0][0][1] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def _task(path: str, size: int, end: int, open_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number, kind = Packer(size, open_ids), TaskContext.get().partitionId() * TASK_STEP, pa.int64()
        stop = np.array([end], np.uint32)
        for batch in batches:
            kind = batch.column(0).type
            for key, ids in zip(batch.column(0).to_pylist(), encoder(path).texts(batch.column(1)), strict=True):
                ids = np.concatenate([ids, stop])
                packer.add((key, len(ids)), ids)
                if len(packer.done) >= OUT_ROWS:
                    done, packer.done = packer.done, []
                    yield from _batches(done, kind, number)
                    number += len(done)
        packer.finish()
        yield from _batches(packer.done, kind, number)
    return run


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", size: int = 2048, end: int = 1, open_ids: int = OPEN_IDS) -> DataFrame:
    """Pack every text's ids, and ``end`` behind them, into sequences of at most ``size`` ids.

    Returns one row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset); ids are little-endian and
    unsigned, 32 bits each.  Every id lies in one piece; a sequence's pieces follow one another without a gap.  All
    sequences are full but for at most log2(size) a task, whose lengths are powers of two: nothing is padded.  A null
    text counts as empty (its document is the end id alone); null and repeated ids are rows like any other; other
    columns are ignored; an empty table gives an empty result.  Each task packs its own rows, so nothing is exchanged,
    and a task that is repeated gives the same sequences.  A text longer than a window is cut at windows, others only
    where windows are closed at the end or for memory (over ``open_ids`` ids in open windows).
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(releasing(_task(tokenizer, size, end, open_ids)), schema)
