"""Substring deduplication by recompression.

Recompression replaces, round after round, runs of one symbol and pairs of neighbours by new symbols.  Names are
64-bit hashes of what they stand for and the side a symbol takes in a round's pairing is a bit of its name, so a
round names alike in every task without a dictionary or a shuffle.  With each symbol goes its context: the words
that settle that it appears there.  A window whose words include a symbol's context holds that symbol wherever
else it appears, so each window picks an anchor among the symbols it is certain to hold (the highest level that
has any, there the smallest name), and equal windows pick equal anchors.

Spark then counts anchors over all blocks of documents: windows of an anchor that appears once are unique; an
anchor that always has the same surroundings has repeated windows only; for the others the windows themselves
are counted by a 96-bit hash.  Rows exchanged are arrays of one block and one bucket, each anchor or window
at most once per block, so that a passage of a third of all documents is one entry per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import block_count, in_blocks, prepare, signed
from lattica.llm.text import Words, chunks, mix

BLOCK_BYTES = 4 << 20
ROUNDS = 3
_U = np.uint64
_P1, _P2 = _U(0x9E3779B97F4A7C15 | 1), _U(0xC2B2AE3D27D4EB4F)


def _powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, p, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes (mod 2^64) of any stretch of words, from prefix sums; words are 64-bit hashes."""

    def __init__(self, words: np.ndarray, p: np.uint64):
        n = len(words)
        self.sum = np.zeros(n + 1, _U)
        np.cumsum(words * _powers(p, n + 1)[:n], out=self.sum[1:])
        self.back = _powers(_U(pow(int(p), -1, 2**64)), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.back[start])


class Level:
    """Symbols of a round: names, spans [start, end) and contexts [low, high) in words; text of each."""

    def __init__(self, name, start, end, low, high, text):
        self.name, self.start, self.end, self.low, self.high, self.text = name, start, end, low, high, text

    def take(self, at):
        return Level(*(x[at] for x in (self.name, self.start, self.end, self.low, self.high, self.text)))


def _neighbours(x: Level):
    """Context of the left and the right neighbour; the edge of a text counts as a word outside any window."""
    same = x.text[1:] == x.text[:-1]
    low = np.r_[x.start[:1] - 1, np.where(same, x.low[:-1], x.start[1:] - 1)]
    high = np.r_[np.where(same, x.high[1:], x.end[:-1] + 1), x.end[-1:] + 1]
    return same, low, high


def merge_runs(x: Level, words: np.ndarray) -> Level:
    """One round of naming runs: equal neighbours become one symbol.

    That a symbol's neighbour differs from it is settled by one word, if the neighbour's nearest word differs from
    the word that an equal symbol would have there; else by the neighbour's own context.
    """
    same, near_low, near_high = _neighbours(x)
    n, w = len(x.name), np.r_[words, _U(0)]
    equal = same & (x.name[1:] == x.name[:-1])
    before, after = np.r_[False, same], np.r_[same, False]
    low = np.where(before & (w[x.start - 1] != w[x.end - 1]), np.minimum(x.low, x.start - 1), np.minimum(x.low, near_low))
    high = np.where(after & (w[np.minimum(x.end, len(words))] != w[x.start]), np.maximum(x.high, x.end + 1), np.maximum(x.high, near_high))
    if not equal.any():
        return Level(x.name, x.start, x.end, low, high, x.text)
    first = np.flatnonzero(np.r_[True, ~equal])
    last = np.r_[first[1:], n] - 1
    long = last > first
    name = np.where(long, mix(x.name[first] ^ mix((last - first + 1).astype(_U) + _U(0x51ED270B))), x.name[first])
    return Level(name, x.start[first], x.end[last], low[first], high[last], x.text[first])


def merge_pairs(x: Level, turn: int) -> Level:
    """One round of naming pairs: a symbol of the left side joins a right-side symbol that follows it."""
    side = (mix(x.name ^ _U(0xD6E8FEB86659FD93 * (turn + 1) % 2**64)) & _U(1)).astype(bool)
    same, near_low, near_high = _neighbours(x)
    pair = same & ~side[:-1] & side[1:]
    head, tail = np.r_[pair, False], np.r_[False, pair]
    low = np.where(side & ~tail, np.minimum(x.low, near_low), x.low)
    high = np.where(~side & ~head, np.maximum(x.high, near_high), x.high)
    at = np.flatnonzero(~tail)
    end = at + head[at]
    name = np.where(head[at], mix(x.name[at] * _P1 + mix(x.name[end] + _P2)), x.name[at])
    return Level(name, x.start[at], x.end[end], np.minimum(low[at], low[end]), np.maximum(high[at], high[end]), x.text[at])


class Block:
    """Windows of a block's texts and their anchors."""

    def __init__(self, texts: pa.Array, width: int):
        data, offsets = next(chunks(texts, 1 << 62))[2:]
        self.w = Words(data, offsets)
        h = self.w.hashes(1)
        per, first = self.w.per_text, self.w.first
        self.width = width
        # starts of windows, by word index
        number = np.maximum(per - width + 1, 0)
        self.windows = np.arange(number.sum()) + np.repeat(first[:-1] - np.r_[0, np.cumsum(number)[:-1]], number)
        self.one, self.h = Rolling(h, _P1), h
        self.name = self.around = np.zeros(0, _U)
        if len(self.windows):
            self._anchors()

    def hashes(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit and another 32-bit hash of the windows at ``start``."""
        end, two = start + self.width, Rolling(mix(self.h + _P2), _P2)
        return self.one.of(start, end), (two.of(start, end) >> _U(32)).astype(np.uint32).view(np.int32)

    def _anchors(self) -> None:
        n = len(self.h)
        text = self.w.text_of().astype(np.int32)
        at = np.arange(n, dtype=np.int32)
        raw = Level(self.h, at, at + 1, at, at + 1, text)
        levels, x = [raw], raw
        for turn in range(ROUNDS):
            x = merge_runs(x, self.h)
            levels.append(x)
            x = merge_pairs(x, turn)
        levels.append(merge_runs(x, self.h))
        total = len(self.windows)
        todo, anchor = np.arange(total), np.zeros(total, np.int64)
        name, place, base = np.zeros(total, _U), np.zeros(total, np.int64), 0
        for depth in range(len(levels) - 1, -1, -1):
            x = levels[depth]
            start = self.windows[todo]
            # contexts begin and end in order, so the symbols that a window holds stand together
            left = np.cumsum(np.bincount(x.low + 1, minlength=n + 2))[start]
            right = np.cumsum(np.bincount(x.high, minlength=n + 2))[start + self.width]
            some = right > left
            symbol = _smallest(x.name, left[some], right[some])
            done = todo[some]
            anchor[done], name[done], place[done] = base + symbol, mix(x.name[symbol] + _U(depth)), x.start[symbol]
            base += len(x.name)
            todo = todo[~some]
            if not len(todo):
                break
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (self.windows[1:] != self.windows[:-1] + 1)]
        self.group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        last = np.r_[begin[1:], len(new)] - 1
        self.name = name[begin]
        lo, hi = self.windows[begin], self.windows[last] + self.width
        self.around = mix(self.one.of(lo, hi) ^ mix((place[begin] - lo).astype(_U) * _P2 + (hi - lo).astype(_U)))


def _smallest(name: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Index of the smallest name (by its upper half, then the earliest) in each range, by doubling minima."""
    power = (name >> _U(32) << _U(32)) | np.arange(len(name), dtype=_U)
    span, best, size = right - left, np.zeros(len(left), _U), 1
    while len(span):
        pick = np.flatnonzero((span >= size) & (span < 2 * size))
        best[pick] = np.minimum(power[left[pick]], power[right[pick] - size])
        if not (span >= 2 * size).any():
            break
        power = np.minimum(power[:-size], power[size:])
        size *= 2
    return (best & _U(0xFFFFFFFF)).astype(np.int64)


def _lists(cut: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    offsets = pa.array(cut.astype(np.int32))
    return {k: pa.ListArray.from_arrays(offsets, pa.array(v)) for k, v in columns.items()}


def _to_buckets(block: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """Rows (block, bucket, a list per column) from one block's flat arrays."""
    order = np.argsort(bucket, kind="stable")
    held, begin = np.unique(bucket[order], return_index=True)
    lists = _lists(np.r_[begin, len(order)], {k: v[order] for k, v in columns.items()})
    return pa.table({"block": pa.array(np.full(len(held), block, np.int32)), "bucket": pa.array(held.astype(np.int32)), **lists})


def _flat(t: pa.Table, column: str) -> np.ndarray:
    return t.column(column).combine_chunks().flatten().to_numpy()


def _counted(key: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, where each distinct key begins in it, and the sum of ``n`` per key."""
    order = np.lexsort(key[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[order][1:] != k[order][:-1]
    begin = np.flatnonzero(new)
    return order, begin, np.add.reduceat(n[order], begin) if len(begin) else n[:0]


def _anchor_rows(width: int, buckets: int):
    def make(t: pa.Table) -> pa.Table:
        b = Block(t.column("text").combine_chunks(), width)
        order, begin, n = _counted([b.name], np.ones(len(b.name), np.int64))
        name, around = b.name[order], b.around[order]
        if len(begin):
            mixed = np.minimum.reduceat(around, begin) != np.maximum.reduceat(around, begin)
        else:
            mixed = np.zeros(0, bool)
        name, around = name[begin], around[begin]
        return _to_buckets(t.column("block")[0].as_py(), ((name >> _U(20)) % _U(buckets)).astype(np.int64), {
            "h": signed(name), "u": signed(around), "mixed": mixed.astype(np.int8), "n": np.minimum(n, 2).astype(np.int8)})
    return make


def _settle(kind: str):
    """Count a bucket's keys over all blocks; return those seen twice or more to every block that has them.

    ``more`` says of an anchor whether its surroundings differ, and is the second part of a window's hash.
    """
    def settle(t: pa.Table) -> pa.Table:
        block = np.repeat(t.column("block").to_numpy(), pc.list_value_length(t.column("h")).to_numpy())
        key = [_flat(t, c) for c in (("h",) if kind == "anchors" else ("h", "g"))]
        order, begin, total = _counted(key, _flat(t, "n").astype(np.int64))
        differ = np.zeros(len(begin), bool)
        if kind == "anchors":
            u = _flat(t, "u")[order]
            differ = np.minimum.reduceat(u, begin) != np.maximum.reduceat(u, begin)
            differ |= np.maximum.reduceat(_flat(t, "mixed")[order], begin) > 0
        own = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
        keep = (total > 1)[own]
        rows, flag = order[keep], differ[own][keep]
        by = np.argsort(block[rows], kind="stable")
        held, cut = np.unique(block[rows][by], return_index=True)
        more = flag.astype(np.int32) if kind == "anchors" else key[1][rows]
        lists = _lists(np.r_[cut, len(by)], {"h": key[0][rows][by], "more": more[by]})
        return pa.table({"block": pa.array(held.astype(np.int32)), "stage": pa.array([kind] * len(held), pa.string()), **lists})
    return settle


def _state(b: Block, known: pa.Table) -> np.ndarray:
    """Per anchor of the block: 0 unique, 1 all windows repeated, 2 to be settled window by window."""
    known = known.filter(pc.equal(known.column("stage"), "anchors"))
    h, mixed = _flat(known, "h").view(_U), _flat(known, "more")
    if not len(h):
        return np.zeros(len(b.name), np.int8)
    order = np.argsort(h, kind="stable")
    h, mixed = h[order], mixed[order]
    at = np.minimum(np.searchsorted(h, b.name), len(h) - 1)
    return np.where(h[at] == b.name, 1 + mixed[at], 0).astype(np.int8)


def _window_rows(width: int, buckets: int):
    def make(docs: pa.Table, known: pa.Table) -> pa.Table:
        start = np.zeros(0, np.int64)
        if docs.num_rows and known.num_rows:
            b = Block(docs.column("text").combine_chunks(), width)
            start = b.windows[_state(b, known)[b.group] == 2]
        if not len(start):
            return _to_buckets(0, start, {"h": start, "g": start.astype(np.int32), "n": start.astype(np.int8)})
        one, two = b.hashes(start)
        order, begin, n = _counted([one, two], np.ones(len(one), np.int64))
        one, two = one[order][begin], two[order][begin]
        return _to_buckets(docs.column("block")[0].as_py(), ((one >> _U(20)) % _U(buckets)).astype(np.int64),
                           {"h": signed(one), "g": two, "n": np.minimum(n, 2).astype(np.int8)})
    return make


def _among(mine: tuple[np.ndarray, np.ndarray], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which hashes are in the table (h, g), both parts alike."""
    found, order = np.zeros(len(mine[0]), bool), np.lexsort((g, h))
    h, g = h[order], g[order]
    at, end = np.searchsorted(h, mine[0], "left"), np.searchsorted(h, mine[0], "right")
    while (at < end).any():  # one turn, unless two windows agree in the first part only
        live = np.flatnonzero(at < end)
        found[live] |= g[at[live]] == mine[1][live]
        at[live] += 1
    return found


def _cut(width: int):
    def make(docs: pa.Table, known: pa.Table) -> pa.Table:
        b = Block(docs.column("text").combine_chunks(), width)
        drop = np.zeros(len(b.h), bool)
        if len(b.windows) and known.num_rows:
            state = _state(b, known)[b.group]
            hit, ask = state == 1, np.flatnonzero(state == 2)
            start = b.windows[ask]
            repeated = known.filter(pc.equal(known.column("stage"), "windows"))
            hit[ask] = _among(b.hashes(start), _flat(repeated, "h").view(_U), _flat(repeated, "more"))
            edge = np.zeros(len(b.h) + 1, np.int64)
            edge[: len(b.h)] += np.bincount(b.windows[hit], minlength=len(b.h))
            edge += np.bincount(b.windows[hit] + width, minlength=len(b.h) + 1)[: len(b.h) + 1] * -1
            drop = np.cumsum(edge[:-1]) > 0
        data, offsets, _, _ = b.w.joined(~drop)
        gone = np.r_[0, np.cumsum(drop)]
        text = pa.LargeStringArray.from_buffers(docs.num_rows, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes()))
        return pa.table({"id": docs.column("id"), "n_words": pa.array(b.w.per_text.astype(np.int64)),
                         "n_removed": pa.array((gone[b.w.first[1:]] - gone[b.w.first[:-1]]).astype(np.int64)),
                         "kept_text": text.cast(pa.string())})
    return make


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window_words: int = 35) -> DataFrame:
    """Remove every word covered by a window of ``window_words`` words that also starts anywhere else.

    Returns (id, n_words, n_removed, kept_text), one row per input row; kept_text has the kept words joined by
    one space.  Null and empty texts have no words; texts shorter than a window keep all of theirs.  Null or
    repeated ids are rows like any other, repeated rows repeat each other's windows, extra columns are ignored,
    and an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    blocks = block_count(docs, text, BLOCK_BYTES)
    buckets = -(-blocks // 2)
    rows = in_blocks(docs, id, text, blocks)
    by_block = rows.groupBy("block")
    anchors = (
        by_block.applyInArrow(_anchor_rows(window_words, buckets), "block int, bucket int, h array<long>, u array<long>, mixed array<tinyint>, n array<tinyint>")
        .groupBy("bucket").applyInArrow(_settle("anchors"), "block int, stage string, h array<long>, more array<int>")
    )
    windows = (
        by_block.cogroup(anchors.groupBy("block"))
        .applyInArrow(_window_rows(window_words, buckets), "block int, bucket int, h array<long>, g array<int>, n array<tinyint>")
        .groupBy("bucket").applyInArrow(_settle("windows"), "block int, stage string, h array<long>, more array<int>")
    )
    kind = rows.schema["id"].dataType.simpleString()
    return by_block.cogroup(anchors.union(windows).groupBy("block")).applyInArrow(
        _cut(window_words), f"id {kind}, n_words long, n_removed long, kept_text string")
