"""Benchmark decontamination by spaced-seed hashing.

A window of ``span`` words is split into four groups of positions.  Each of the six masks keeps two groups and
ignores the other two, so two windows that differ in at most two words agree under at least one mask.  Mask
hashes of the benchmark go into a bitmap of bounded size that every task tests its own windows against; those that
pass are joined with the benchmark's hashes.  Windows of equal words are one on both sides: each pair of unlike
windows is verified once, word by word, however many documents and items hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import kept, prepare, releasing, signed, small
from lattica.llm.text import Words, chunks, hash_ranges, lower_ascii, mix

SPAN = 13
#: Substitutions that the masks allow for in any window.
SUBSTITUTIONS = 2
#: An item of fewer words than this is a hit only where it is a document's whole text.
LEAST_WORDS = 5
#: Bits of the bitmap: 2^17 at least, 64 for each hash, and 2^28 (32 MB) at most; a fuller one only lets more windows through to the join.
LEAST_BITS, MOST_BITS = 17, 28
_U = np.uint64
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words and their hashes, lower-cased and without ASCII punctuation at either end."""
    w = Words(lower_ascii(data), offsets)
    start, end = w.start.copy(), w.end.copy()
    live = np.arange(len(start))
    while len(live):
        live = live[(start[live] < end[live])]
        live = live[_EDGE[w.data[end[live] - 1]]]
        end[live] -= 1
    live = np.arange(len(start))
    while len(live):
        live = live[(start[live] < end[live])]
        live = live[_EDGE[w.data[start[live]]]]
        start[live] += 1
    bare = start == end  # a word of punctuation only stands for itself
    start[bare], end[bare] = w.start[bare], w.end[bare]
    return w, hash_ranges(w.data, start, end, 5)


def _factors(span: int) -> np.ndarray:
    return mix(np.arange(1, span + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def seed_hashes(codes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position with ``span`` words ahead of it, the hash under each mask (a row a mask) and that of all its words.

    Below ``LEAST_WORDS`` there is one mask, which ignores nothing.
    """
    n = max(0, len(codes) - span + 1)
    groups, factor = np.array_split(np.arange(span), 4), _factors(span)
    part = np.zeros((4, n), _U)
    for g, of in enumerate(groups):
        for k in of:
            part[g] += codes[k : k + n] * factor[k]
    whole = mix(part.sum(axis=0, dtype=_U) + _U(1000 * span + 999))
    if span < LEAST_WORDS:
        return whole[None, :], whole
    return np.stack([mix(part[a] + part[b] + _U(1000 * span + m)) for m, (a, b) in enumerate(combinations(range(4), 2))]), whole


def least_same(span: int, similarity: float) -> int:
    """Equal words that a hit of ``span`` words has, at least."""
    return int(np.ceil(similarity * span - 1e-9))


def _windows(w: Words, span: int) -> np.ndarray:
    """Whether a window of ``span`` words starts at each word position (for those seed_hashes covers); short ones must be the whole text."""
    text = w.text_of()
    n = max(0, len(text) - span + 1)
    ok = text[:n] == text[span - 1 :] if n else np.zeros(0, bool)
    return ok & (w.per_text[text[:n]] == span) if span < LEAST_WORDS and n else ok


def _lists(values: np.ndarray, length: int) -> pa.Array:
    """Rows of a matrix of 64-bit values as lists."""
    return pa.FixedSizeListArray.from_arrays(pa.array(signed(np.ascontiguousarray(values).ravel())), length).cast(pa.list_(pa.int64()))


_WINDOW = "win long, span int, words array<long>, keys array<long>"


def _columns(codes: np.ndarray, start: np.ndarray, whole: np.ndarray, keys: np.ndarray, span: int) -> list[pa.Array]:
    words = codes[start[:, None] + np.arange(span)] if len(start) else np.zeros((0, span), _U)
    return [pa.array(signed(whole)), pa.array(np.full(len(start), span, np.int32)), _lists(words, span), _lists(keys, keys.shape[1] if len(keys) else 1)]


def _bench_windows(span: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                w, codes = word_codes(data, offsets)
                own = batch.column("item").slice(i, j - i)
                for k in range(j - i):
                    mine = codes[w.first[k] : w.first[k + 1]]
                    size = min(span, len(mine))
                    if not size:
                        continue
                    keys, whole = seed_hashes(mine, size)
                    at = np.arange(len(whole))
                    yield pa.RecordBatch.from_arrays(
                        [own.take(pa.array(np.full(len(at), k))), pa.array(at.astype(np.int32)), *_columns(mine, at, whole, keys.T, size)],
                        names=["item", "at", "win", "span", "words", "keys"])
    return releasing(make)


def _doc_windows(spans: list[int], held, bits: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, mask = held.value, _U((1 << bits) - 1)
        lit = lambda slot: (bitmap[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                w, codes = word_codes(data, offsets)
                text, ids = w.text_of(), batch.column("id").slice(i, j - i)
                for span in spans:
                    ok = _windows(w, span)
                    keys, whole = seed_hashes(codes, span)
                    passed = np.stack([ok & (lit(h & mask) & lit((h >> _U(32)) & mask)).astype(bool) for h in keys])
                    at = np.flatnonzero(passed.any(axis=0))
                    # keys that did not pass are not in the benchmark; the first that did stands in for them
                    some = np.where(passed[:, at], keys[:, at], keys[np.argmax(passed[:, at], axis=0), at] if len(at) else keys[:, at])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(text[at])), pa.array((at - w.first[text[at]]).astype(np.int32)), *_columns(codes, at, whole[at], some.T, span)],
                        names=["id", "pos", "win", "span", "words", "keys"])
    return releasing(make)


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with two bits for each key; at most 2^bits / 8 bytes reach the driver, however many keys there are."""
    mask = F.lit((1 << bits) - 1)
    slots = seeds.select(F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 32).bitwiseAND(mask))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("held")).toPandas()
    out = np.zeros(1 << (bits - 6), _U)
    out[words["word"].to_numpy(np.int64)] = words["held"].to_numpy(np.int64).view(_U)
    return out.view(np.uint8)


def _overlaps(docs: DataFrame, benchmark: DataFrame, id: str, text: str, item: str, item_text: str, span: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Verified windows of documents (id, pos, span, bench, same), and the benchmark's windows (bench, item, at)."""
    if span - least_same(span, similarity) > SUBSTITUTIONS:
        raise ValueError(f"the masks find windows with up to {SUBSTITUTIONS} substitutions; ask for a higher similarity or a shorter span")
    spark = prepare(docs.sparkSession)
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("item is not null")
    bench = kept(items.mapInArrow(_bench_windows(span), f"item {items.schema['item'].dataType.simpleString()}, at int, {_WINDOW}"))
    seeds = kept(bench.select(F.explode("keys").alias("key"), "span", F.col("win").alias("bench")).distinct())
    spans = sorted(r["span"] for r in bench.select("span").distinct().collect())
    bits = int(np.clip(np.ceil(np.log2(64 * max(1, seeds.count()))), LEAST_BITS, MOST_BITS))
    held = spark.sparkContext.broadcast(_bitmap(seeds, bits))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    mine = rows.mapInArrow(_doc_windows(spans, held, bits), f"id {rows.schema['id'].dataType.simpleString()}, pos int, {_WINDOW}")
    met = kept(
        mine.select("id", "pos", "win", "span", "words", F.explode(F.array_distinct("keys")).alias("key"))
        .join(small(seeds), ["key", "span"]).select("id", "pos", "win", "span", "words", "bench"))
    known = bench.groupBy(F.col("win").alias("bench")).agg(F.first("words").alias("known"))
    same = F.size(F.filter(F.zip_with("words", "known", lambda a, b: a == b), lambda x: x))
    least = F.ceil(F.col("span") * F.lit(similarity) - 1e-9)
    verified = kept(
        met.groupBy("win", "bench", "span").agg(F.first("words").alias("words")).join(known, "bench")
        .withColumn("same", same).where(F.col("same") >= least).select("win", "bench", "same"))
    found = met.select("id", "pos", "span", "win", "bench").join(small(verified), ["win", "bench"]).select("id", "pos", "span", "bench", "same")
    return found, bench.select(F.col("win").alias("bench"), "item", "at")


def hits(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    span: int = SPAN, similarity: float = 0.8,
) -> DataFrame:
    """Verified overlaps: (id, item_id, pos, at, span, same), a row per window of a document and an item.

    A hit is a window of ``span`` consecutive words, or of all an item's words if it has fewer, in which at least
    ``similarity`` of the words, position by position, equal the item's; an item of fewer than ``LEAST_WORDS`` words
    must be the document's whole text.  Words are compared lower-cased and without punctuation at their ends.  Null
    and empty texts and items have no hits; documents with a null id are reported under it; items with a null id are
    not searched; repeated rows count once; extra columns are ignored; an empty table gives an empty result.
    """
    found, bench = _overlaps(docs, benchmark, id, text, item, item_text, span, similarity)
    return found.join(bench, "bench").select("id", F.col("item").alias("item_id"), "pos", "at", "span", "same").distinct()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    span: int = SPAN, similarity: float = 0.8,
) -> DataFrame:
    """(id, n_items, n_windows, items): each document with hits (see ``hits``), its distinct items and the number of hit windows.

    A document's windows and the items that hold them are only brought together once for each distinct window.
    """
    found, bench = _overlaps(docs, benchmark, id, text, item, item_text, span, similarity)
    found = kept(found)
    windows = found.groupBy("id").agg(F.countDistinct("pos").alias("n_windows"))
    items = (found.select("id", "bench").distinct().join(bench.select("bench", "item").distinct(), "bench").groupBy("id")
             .agg(F.array_sort(F.collect_set("item")).alias("items")).withColumnRenamed("id", "_id"))
    return windows.join(items, F.col("id").eqNullSafe(F.col("_id"))).select("id", F.size("items").cast("long").alias("n_items"), "n_windows", "items")
