"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through vantage-point trees.

Two fingerprints at most r bits apart differ in at most r // 2 bits in one of their halves, so there is a tree for
each half and a pair needs to meet in one of them.  At a node with vantage point v and radius m, d(x, v) <= m goes
left and the rest goes right; by the triangle inequality two halves within q of one another can only be parted when
the right one has d <= m + q, so such rows are also sent left.  Each pair of halves within q therefore meets in a
leaf, and exactly one leaf takes it: that where at every left turn one of the two was at home.  Leaves compare all
their pairs exactly.

Distances of unrelated halves lie within a few bits of their mean, so that the boundary copies about one row in seven
at each node (the whole fingerprint with its wider boundary would copy one in four).  Points and radii of the upper
nodes are fitted on a bounded sample to the least work; nodes below draw their points by a hash of their number, so
that a tree's depth follows the table and is not limited by the sample.

``verified_groups`` adds what fingerprints alone can't decide: groups by Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Forest, discard, hashed_sample, kept, looked_up, paired_groups, prepare, releasing, signed, small, without
from lattica.llm.components import connected_components
from lattica.llm.text import Words, chunks, hash_ranges, lower_ascii, mix, xxh64_ranges

#: Fingerprints that the upper nodes are fitted on, and texts that tell which shingles are very frequent, at most.
SAMPLE = 8192
#: Sampled rows that a node is fitted on, at least.
FIT_LEAST = 32
#: Fingerprints per leaf, about; leaves over SPLIT rows (dense groups) are split into parts.
LEAF, SPLIT = 8000, 40_000
#: Texts and shingles of a group that one task verifies, at most, and of a task with smaller groups, about.
PART_TEXTS, PART_SHINGLES, BIN_TEXTS, BIN_SHINGLES = 24_000, 16_000_000, 6000, 4_000_000
#: Rounds in which groups over PART_TEXTS or PART_SHINGLES are taken apart around vantage texts before they are dealt into parts.
PEEL_ROUNDS = 8
#: Shingles whose counts a task settles, about.
BUCKET_SHINGLES = 1_500_000
#: A shingle of so many sampled texts is very frequent; so many of them are known to all tasks, at most.
OFTEN_LEAST, OFTEN = 4, 1 << 20
_U = np.uint64
_HALF = _U(0xFFFFFFFF)
#: The 16-bit lanes that hold the low and the high four bits of a byte.
_LANES = np.array([[sum((v >> (4 * k + b) & 1) << (16 * b) for b in range(4)) for v in range(256)] for k in range(2)], _U)


def shingle_ranges(words: Words, size: int):
    """Byte ranges of all ``size``-word shingles; a shorter text has one, of all its words, and none if empty.

    Returns the joined bytes, shingle starts and ends, and per text the first shingle (n + 1).
    """
    data, _, start, end = words.joined()
    per = words.per_text
    number = np.where(per == 0, 0, np.maximum(per - size + 1, 1))
    first = np.r_[0, np.cumsum(number)]
    text = np.repeat(np.arange(len(per)), number)
    at = np.arange(first[-1]) - first[:-1][text] + words.first[:-1][text]
    last = np.minimum(at + size - 1, words.first[1:][text] - 1)
    return data, start[at], end[last], first


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the bits that are set in over half of its hashes (zero without hashes)."""
    number = np.diff(first)
    out = np.zeros(len(number), _U)
    # sums of 16-bit lanes are safe up to 65,535 rows, so longer texts are summed in pieces
    piece = np.concatenate([np.arange(a, b, 65535) for a, b in zip(first[:-1], first[1:], strict=True) if b - a > 65535] or [[]])
    cuts = np.unique(np.r_[first[:-1][number > 0], piece].astype(np.int64))
    if not len(cuts):
        return out
    owner = np.searchsorted(first, cuts, "right") - 1
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    half, octets = number[owner[begin]] / 2, hashes.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        for k in range(2):
            lane = np.add.reduceat(_LANES[k][octets[:, j]], cuts)
            for b in range(4):
                total = np.add.reduceat((lane >> _U(16 * b)) & _U(0xFFFF), begin)
                out[owner[begin]] |= (total > half).astype(_U) << _U(8 * j + 4 * k + b)
    return out


def _printer(size: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                data, start, end, first = shingle_ranges(Words(lower_ascii(data), offsets), size)
                fp = majority(xxh64_ranges(data, start, end), first)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(signed(fp))], names=["id", "fp"])
    return releasing(prints)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp long): the SimHash of each text's lower-cased word shingles (XXH64, seed 42), repeats included."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_printer(shingle_words), f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def half(fp: np.ndarray, tree: int) -> np.ndarray:
    """The low (tree 0) or the high 32 bits (tree 1)."""
    return (fp >> _U(32 * tree)) & _HALF


def fit_tree(sample: np.ndarray, depth: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of the upper nodes in heap order, from a bounded sample of halves.

    A node takes, of a few sampled points and all radii, those with the fewest pairs left in its two sides, boundary
    included.  Nodes without ``FIT_LEAST`` sampled rows get a point by hash, and a radius for unrelated halves.
    """
    levels = min(depth, max(0, int(np.log2(max(1, len(sample)) / FIT_LEAST))))
    point, radius = by_hash(np.arange(2**levels)), np.full(2**levels, usual_radius(reach), np.int16)
    rng, members = np.random.default_rng(7), {1: sample}
    for node in range(1, 2**levels):
        own = members.pop(node, sample[:0])
        if len(own) < FIT_LEAST:
            continue
        tried = own[rng.integers(0, len(own), 6)]
        away = np.bitwise_count(tried[:, None] ^ own[None, :]).astype(np.int16)
        within = np.stack([np.cumsum(np.bincount(d, minlength=33)) for d in away])
        left = np.concatenate([within[:, reach:], np.repeat(within[:, -1:], reach, axis=1)], axis=1)
        work = left.astype(float) ** 2 + (len(own) - within).astype(float) ** 2
        pick, m = np.unravel_index(int(np.argmin(work)), work.shape)
        point[node], radius[node] = tried[pick], m
        members[2 * node], members[2 * node + 1] = own[away[pick] <= m + reach], own[away[pick] > m]
    return point, radius


def by_hash(node: np.ndarray) -> np.ndarray:
    """A pseudo-random half for each node number."""
    return mix(node.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1)) & _HALF


def usual_radius(reach: int) -> int:
    """The radius that parts unrelated halves (distances about 16) evenly, the boundary counted to the left."""
    return 16 - (reach + 2) // 2


def route(x: np.ndarray, point: np.ndarray, radius: np.ndarray, depth: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, leaf and, as bits by level, where the row was copied over a boundary, for each place that a row gets."""
    row, node, spilt = np.arange(len(x)), np.ones(len(x), np.int64), np.zeros(len(x), np.int64)
    for level in range(depth):
        known = np.minimum(node, len(point) - 1)
        fitted = node < len(point)
        away = np.bitwise_count(x[row] ^ np.where(fitted, point[known], by_hash(node))).astype(np.int16)
        most = np.where(fitted, radius[known], usual_radius(reach))
        home, left = away <= most, np.flatnonzero(away <= most + reach)
        right = np.flatnonzero(~home)
        spilt = np.r_[spilt[left] | (~home[left]).astype(np.int64) << level, spilt[right]]
        row, node = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1]
    return row, node, spilt


def _router(trees: list[tuple[np.ndarray, np.ndarray]], depth: int, reach: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(_U)
            for t, (point, radius) in enumerate(trees):
                row, node, spilt = route(half(fp, t), point, radius, depth, reach)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), t, np.int32)), pa.array(node), pa.array(spilt), batch.column("fp").take(take), batch.column("rep").take(take)],
                    names=["tree", "leaf", "spilt", "fp", "rep"])
    return releasing(deal)


def _leaf(reach: int):
    def link(t: pa.Table) -> pa.Table:
        fp, spilt = t.column("fp").to_numpy().view(_U), t.column("spilt").to_numpy()
        rep, part = t.column("rep").to_numpy(), t.column("part").to_numpy()
        low, high = t.column("pa")[0].as_py(), t.column("pb")[0].as_py()
        order = np.lexsort((spilt, fp, part))
        fp, spilt, rep, part = fp[order], spilt[order], rep[order], part[order]
        a = np.flatnonzero(part == low)
        b = a if low == high else np.flatnonzero(part == high)
        forest, label = Forest(len(fp)), np.arange(len(fp))
        edges, step = [], max(1, 1_000_000 // max(1, len(b)))
        for i0 in range(0, len(a), step):
            rows, cols = a[i0 : i0 + step], b[i0:] if low == high else b
            away = np.bitwise_count(fp[rows][:, None] ^ fp[cols][None, :])
            i, j = np.nonzero(away <= reach)
            d, i, j = away[i, j], rows[i], cols[j]
            ok = (label[i] != label[j]) & ((spilt[i] & spilt[j]) == 0)
            d, i, j = d[ok], i[ok], j[ok]
            for level in range(reach + 1):  # nearest first
                x, y = i[d == level], j[d == level]
                # one edge per partner, then one per pair of sets still apart, then all that still join two sets
                for turn in range(3):
                    apart = label[x] != label[y]
                    x, y = x[apart], y[apart]
                    if not len(x):
                        break
                    key = (y, label[x] * len(fp) + label[y], np.arange(len(x)))[turn]
                    once = np.unique(key, return_index=True)[1]
                    edges += [(p, q, level) for p, q in zip(x[once].tolist(), y[once].tolist(), strict=True) if forest.join(p, q)]
                    label = forest.labels()
        x, y, d = np.array(edges, np.int64).reshape(-1, 3).T
        return pa.table([pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y])), pa.array(d.astype(np.int32))], names=["a", "b", "d"])
    return releasing(link)


def tree_depth(rows: int, reach: int) -> int:
    """Levels after which a leaf has about ``LEAF`` of ``rows`` unrelated halves; a side keeps about 0.57 of its node's."""
    return max(0, int(np.ceil(np.log(max(1, rows) / LEAF) / -np.log(0.57))))


def hamming_links(prints: DataFrame, reach: int = 3) -> DataFrame:
    """Links (a, b, d) between the representatives of distinct fingerprints at most ``reach`` bits apart.

    ``prints`` has (fp long, rep long), distinct by fp.  All links are verified; those returned span every component.
    """
    prepare(prints.sparkSession)
    rows, within = prints.count(), reach // 2
    depth = tree_depth(rows, within)
    sample = hashed_sample(prints.select("fp"), SAMPLE, "fp").toPandas()["fp"].to_numpy(np.int64).view(_U) if depth else np.zeros(0, _U)
    trees = [fit_tree(half(sample, t), depth, within) for t in range(2)]
    routed = prints.select("fp", "rep").mapInArrow(_router(trees, depth, within), "tree int, leaf long, spilt long, fp long, rep long")
    dealt = paired_groups(routed, ["tree", "leaf"], "fp", SPLIT)
    return dealt.groupBy("tree", "leaf", "pa", "pb").applyInArrow(_leaf(reach), "a long, b long, d int")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle_words: int = 3, reach: int = 3) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    Documents are linked when their fingerprints differ in at most ``reach`` bits; component_id is the smallest
    id that links reach.  Texts without words (null and empty ones too) have fingerprint zero and are linked
    like any other.  Documents of equal fingerprint are one vertex, so copies cost one row.  A null id keeps its
    fingerprint, joins no links, and has a null component_id unless its fingerprint is another document's too.
    Extra columns are ignored; an empty table gives an empty result.
    """
    prints = kept(fingerprints(docs, id, text, shingle_words))
    alike = kept(prints.groupBy("fp").agg(F.min("id").cast("long").alias("rep")))
    links = kept(hamming_links(alike.where("rep is not null"), reach))
    parts = connected_components(links).withColumnRenamed("id", "rep")
    groups = kept(alike.join(parts, "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")))
    return prints.join(groups, "fp", "left").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sampled_shingles(size: int):
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                data, start, end, first = shingle_ranges(Words(lower_ascii(data), offsets), size)
                h = hash_ranges(data, start, end)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.unique(h[a:b])))], names=["h"])
    return releasing(shingles)


def needed(n: np.ndarray, similarity: float) -> np.ndarray:
    """Shared shingles that a text of ``n`` has with any text at the similarity, at least."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def _lists(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values))


def _text_sets(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, and the text of each."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)]
    return h[new], text[new]


_DEALT = "batch long, bucket int, at array<short>, h array<int>, nodes array<long>, n array<int>, rare array<int>, late_at array<short>, late array<long>"


def _deal_shingles(size: int, similarity: float, often: np.ndarray, level: np.ndarray, buckets: int):
    """Per batch of texts: a row per bucket of shingles, and one (bucket below 0) with the texts themselves.

    Very frequent shingles come last in every text's order and are not dealt out; those that a text's prefix would
    reach even if all of its other shingles came first go along as ``late``.
    """
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text"), 3 << 20):
                name = TaskContext.get().partitionId() << 32 | number  # the same if the task runs again
                number += 1
                data, start, end, first = shingle_ranges(Words(lower_ascii(data), offsets), size)
                h, text = _text_sets(hash_ranges(data, start, end), first)
                n = np.bincount(text, minlength=j - i)
                at = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
                common = often[at] == h if len(often) else np.zeros(len(h), bool)
                rare = n - np.bincount(text[common], minlength=j - i)
                # the texts; the prefix of one without words is 0, so that such texts are alike
                late = np.maximum(n - needed(n, similarity) + 1 - rare, 0)
                late_h, late_text = h[common], text[common]
                order = np.lexsort((late_h, level[at[common]], late_text)) if len(late_h) else np.zeros(0, np.int64)
                late_h, late_text = late_h[order], late_text[order]
                begin = np.searchsorted(late_text, np.arange(j - i))
                take = np.arange(len(late_h)) - begin[late_text] < late[late_text]
                late_h, late_text = np.r_[late_h[take], np.zeros((n == 0).sum(), _U)], np.r_[late_text[take], np.flatnonzero(n == 0)]
                # the shingles by bucket
                h, text = h[~common], text[~common]
                bucket = ((h >> _U(40)) % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                held, cut = np.unique(bucket[order], return_index=True)
                sizes = np.diff(np.r_[cut, len(order)])
                none = np.zeros(len(held), np.int64)
                key = (h[order] & _HALF).astype(np.uint32).view(np.int32)
                i16, i32 = (lambda x, t=t: np.asarray(x, t) for t in (np.int16, np.int32))  # a batch has 1,000 texts at most
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(held) + 1, name)), pa.array(i32(np.r_[held, -1 - number % buckets])),
                    _lists(np.r_[sizes, 0], i16(text[order])), _lists(np.r_[sizes, 0], key),
                    _lists(np.r_[none, j - i], np.asarray(batch.column("node").slice(i, j - i))), _lists(np.r_[none, j - i], i32(n)),
                    _lists(np.r_[none, j - i], i32(rare)), _lists(np.r_[none, len(late_h)], i16(late_text)), _lists(np.r_[none, len(late_h)], signed(late_h)),
                ], names=["batch", "bucket", "at", "h", "nodes", "n", "rare", "late_at", "late"])
    return releasing(deal)


_SETTLED = "batch long, at array<short>, h array<long>, c array<int>, nodes array<long>, n array<int>, rare array<int>, late_at array<short>, late array<long>"


def _settle_shingles(t: pa.Table) -> pa.Table:
    """Counts of a bucket's shingles over all texts; those of two texts or more go back to their batches."""
    t = t.combine_chunks()
    bucket, batch = t.column("bucket")[0].as_py(), t.column("batch").to_numpy()
    if bucket < 0:
        none = pa.array([[]] * t.num_rows, pa.list_(pa.int32()))
        return pa.table([t.column("batch"), t.column("at"), none.cast(pa.list_(pa.int64())), none, *(t.column(c) for c in ("nodes", "n", "rare", "late_at", "late"))],
                        names=["batch", "at", "h", "c", "nodes", "n", "rare", "late_at", "late"])
    sizes = pc.list_value_length(t.column("h")).to_numpy()
    h, at = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("h", "at"))
    order = np.argsort(h, kind="stable")
    s = h[order]
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
    count = np.diff(np.r_[begin, len(s)])
    keep = np.repeat(count > 1, count)
    rows, c = order[keep], np.repeat(count, count)[keep]
    row = np.repeat(np.arange(t.num_rows), sizes)[rows]
    by = np.argsort(row, kind="stable")
    held, cut = np.unique(row[by], return_index=True)
    length = np.diff(np.r_[cut, len(by)])
    name = (np.int64(bucket) << 32) | (h[rows][by].view(np.uint32).astype(np.int64))
    none = lambda k: pa.array([[]] * len(held), pa.list_(k))
    return pa.table([pa.array(batch[held]), _lists(length, at[rows][by]), _lists(length, name), _lists(length, c[by].astype(np.int32)),
                     none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.int16()), none(pa.int64())],
                    names=["batch", "at", "h", "c", "nodes", "n", "rare", "late_at", "late"])


def _prefixes(similarity: float):
    """The rarest shingles of each text of a batch, as many as a text at the similarity can't miss all of.

    A shingle of one text only is of no use, so it counts towards the number but is not returned.
    """
    def prefixes(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy()
        at, h, c, nodes, n, rare, late_at, late = (flat(x) for x in ("at", "h", "c", "nodes", "n", "rare", "late_at", "late"))
        shared = np.bincount(at, minlength=len(nodes))
        want = n - needed(n, similarity) + 1 - (rare - shared)
        order = np.lexsort((h, c, at))
        at, h = at[order], h[order]
        begin = np.searchsorted(at, np.arange(len(nodes)))
        take = np.arange(len(at)) - begin[at] < want[at]
        row = np.r_[at[take], late_at].astype(np.int64)
        return pa.table([pa.array(nodes[row]), pa.array(n[row].astype(np.int32)), pa.array(np.r_[h[take], late])], names=["node", "n", "h"])
    return releasing(prefixes)


def shingle_prefixes(texts: DataFrame, shingle_words: int, similarity: float, number: int, text_bytes: int) -> DataFrame:
    """(node, n, h): of ``number`` texts (node, text), the rarest shingles h of each and the number n of its distinct shingles.

    Two texts at the similarity share one of the h of both, whatever the edit that parts them.  Rare means few texts
    of all; counts are exact but for the shingles that a bounded sample of texts holds repeatedly, which come last.
    That bounds how many rows one shingle has: a shingle outside that list is in about one text in a thousand at most.
    """
    share = min(1.0, SAMPLE / max(1, number))
    often = (texts.sample(share, 7).select("text").mapInArrow(_sampled_shingles(shingle_words), "h long").groupBy("h").count()
             .where(F.col("count") >= OFTEN_LEAST).orderBy(F.desc("count"), "h").limit(OFTEN).toPandas())
    codes, level = often["h"].to_numpy(np.int64).view(_U), np.log2(often["count"].to_numpy(np.float64)).astype(np.int8) + 1
    order = np.argsort(codes)
    buckets = max(1, -(-text_bytes // (6 * BUCKET_SHINGLES)))  # a word has about six bytes
    dealt = texts.select("node", "text").mapInArrow(_deal_shingles(shingle_words, similarity, codes[order], level[order], buckets), _DEALT)
    settled = dealt.groupBy("bucket").applyInArrow(releasing(_settle_shingles), _SETTLED)
    return settled.groupBy("batch").applyInArrow(_prefixes(similarity), "node long, n int, h long")


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                data, start, end, first = shingle_ranges(Words(lower_ascii(data), offsets), size)
                h = (hash_ranges(data, start, end) >> _U(32)).astype(np.uint32).view(np.int32)
                h, text = _text_sets(h, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("near").slice(i, j - i), batch.column("node").slice(i, j - i), _lists(np.bincount(text, minlength=j - i), h)],
                    names=["near", "node", "shingles"])
    return releasing(sets)


def similar_links(flat: np.ndarray, cut: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that span exactly the components of the sets ``flat[cut[i] : cut[i + 1]]`` under a Jaccard similarity.

    A breadth-first search: each set is counted, through the sets that hold its members, against all sets not reached yet.
    """
    n, size = len(cut) - 1, np.diff(cut)
    # shingles of two sets or more are numbered range by range of hashes, which keeps the sorts small
    ranges = min(255, 1 + len(flat) // 500_000)
    code, of, which = np.full(len(flat), -1, np.int32), np.repeat(np.arange(n, dtype=np.int32), size), (flat % ranges).astype(np.uint8)
    posts, counts, codes = [], [], 0
    for r in range(ranges):
        at = np.flatnonzero(which == r)
        at = at[np.argsort(flat[at], kind="stable")]
        begin = np.flatnonzero(np.r_[True, flat[at][1:] != flat[at][:-1]][: len(at)])
        k = np.diff(np.r_[begin, len(at)])
        at, k = at[np.repeat(k > 1, k)], k[k > 1]
        code[at] = codes + np.repeat(np.arange(len(k)), k)
        posts.append(of[at])
        counts.append(k)
        codes += len(k)
    del of, which
    post, count = np.concatenate(posts), np.concatenate(counts)
    del posts
    start, indexed = np.cumsum(count) - count, n
    left, out = np.ones(n, bool), []
    unseen = n
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        unseen -= 1
        while queue and unseen:
            x = queue.pop()
            if unseen < indexed // 2:
                held = left[post]
                post, count = post[held], np.bincount(np.repeat(np.arange(len(count), dtype=np.int32), count)[held], minlength=len(count))
                start, indexed = np.cumsum(count) - count, unseen
            if not size[x]:
                near = np.flatnonzero(left & (size == 0))
            else:
                c = code[cut[x] : cut[x + 1]]
                c = c[c >= 0]
                c = c[count[c] > 0]
                both = np.zeros(n, np.int64)
                for some in np.array_split(c, 1 + int(count[c].sum()) // 1_000_000):
                    k = count[some]
                    at = np.repeat(start[some] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                    both += np.bincount(post[at], minlength=n)
                near = np.flatnonzero(left & (both >= similarity * (size[x] + size - both) - 1e-9))
            left[near] = False
            unseen -= len(near)
            queue += near.tolist()
            out += [(x, y) for y in near.tolist()]
    return out


def _verify(similarity: float):
    def verify(t: pa.Table) -> pa.Table:
        """Links that span the components of each place's texts."""
        place, node = t.column("place").to_numpy(), t.column("node").to_numpy()
        sets = []
        for lists in t.column("shingles").chunks:
            flat, cut = lists.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())].tolist()
            sets += [flat[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        order = np.lexsort((node, place))
        begin = np.flatnonzero(np.r_[True, place[order][1:] != place[order][:-1]])
        a, b = [], []
        for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
            own = order[s:e]
            each = [sets[i] for i in own.tolist()]
            links = np.array(similar_links(np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])], similarity), np.int64).reshape(-1, 2)
            a.append(node[own[links[:, 0]]])
            b.append(node[own[links[:, 1]]])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
    return releasing(verify)


def distinct_texts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """One row (node, text) per text of ``rows`` (id, node, text) that has an id; ``keys`` is its kept (id, node).

    Copies are left out by their keys, so that texts themselves are only exchanged where one id repeats a text.
    """
    each = keys.where("id is not null").groupBy("node", "id").agg(F.count(F.lit(1)).alias("c"))
    first = keys.groupBy("node").agg(F.min("id").alias("rep"))
    marked = each.join(first, "node").where((F.col("id") != F.col("rep")) | (F.col("c") > 1)).select("node", "id", (F.col("id") == F.col("rep")).alias("again"))
    marked = kept(marked)
    pair = F.struct("node", "id").alias("__pair")
    own = without(rows.where("id is not null").select(pair, "node", "text"), kept(marked.select(pair)), "__pair").select("node", "text")
    again = kept(marked.where("again").select("node", "id"))
    if not again.limit(1).count():
        return own
    return own.unionByName(rows.join(small(again), ["node", "id"], "left_semi").groupBy("node").agg(F.first("text").alias("text")).select("node", "text"))


def _candidates(prefixes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b), not verified, that join all texts of like size that share an h: each to the smallest of its list.

    Sizes fall into classes as wide as the similarity allows; a text is listed in its class and in the next one, so
    that two texts of a compatible size have a list in common.
    """
    width = F.lit(float(-np.log(similarity)))
    kind = F.when(F.col("n") > 0, F.floor(F.log("n") / width)).otherwise(F.lit(-2))
    listed = prefixes.select("node", "n", "h", F.explode(F.array(kind, kind + 1)).alias("k"))
    heads = listed.groupBy("h", "k").agg(F.min(F.struct("n", "node"))["node"].alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return listed.join(heads, ["h", "k"]).where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _parts(sets: DataFrame) -> DataFrame:
    """(near, parts) of the groups that are more than one task's work, by their texts or by their shingles."""
    n, shingles = F.count(F.lit(1)), F.sum(F.size("shingles"))
    parts = F.greatest(F.ceil(n / PART_TEXTS), F.ceil(shingles / PART_SHINGLES)).cast("int")
    return kept(sets.groupBy("near").agg(parts.alias("parts")).where("parts > 1"))


def _peel(sets: DataFrame, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """Take groups over ``PART_TEXTS`` or ``PART_SHINGLES`` apart around vantage texts: what is left to compare, and verified links.

    All texts of a group are compared with one of them.  Those at the similarity are linked to it, and with a
    distance d = 1 - Jaccard, which is a metric, a text further than 2 (1 - similarity) away can't be linked to any of
    them.  So the rest goes on as a group without the linked ones, and only where texts lie in the ring between do
    they form another group with the linked ones at the ring's side.  A group of near copies of any size is one pass.
    """
    links, near, apart = [], 1 - similarity, []
    for turn in range(PEEL_ROUNDS):
        large = _parts(sets).select("near")
        if not large.limit(1).count():
            break
        big = sets.join(small(large), "near", "left_semi")
        apart.append(sets.join(small(large), "near", "left_anti"))  # read from where it stands
        heads = kept(big.groupBy("near").agg(F.min_by(F.struct("node", "shingles"), F.xxhash64("node", F.lit(turn))).alias("head")))
        both = F.size(F.array_intersect("shingles", "head.shingles"))
        total = F.size("shingles") + F.size("head.shingles") - both
        seen = big.join(small(heads), "near").select("near", "node", "shingles", F.col("head.node").alias("a"), F.when(total > 0, 1 - both / total).otherwise(0.0).alias("d"))
        seen = kept(seen)
        links.append(kept(seen.where((F.col("d") <= near + 1e-9) & (F.col("a") != F.col("node"))).select("a", F.col("node").alias("b"))))
        ring = kept(seen.where((F.col("d") > near + 1e-9) & (F.col("d") <= 2 * near + 1e-9)).groupBy("near").agg(F.min("d").alias("inner")))
        edge = (seen.join(small(ring), "near").where((F.col("d") <= 2 * near + 1e-9) & (F.col("d") >= F.col("inner") - near - 1e-9))
                .select(F.xxhash64("near", "a").alias("near"), "node", "shingles"))
        sets = kept(seen.where(F.col("d") > near + 1e-9).select("near", "node", "shingles").unionByName(edge))
    return reduce(DataFrame.unionByName, apart, sets), links


def _placed(sets: DataFrame) -> DataFrame:
    """(place, bin, node, shingles): a group is judged in one place; one that is still large, in a place for each two of its parts.

    Small groups share a task; two parts of a large one have theirs to themselves.
    """
    large = _parts(sets)
    size = sets.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("s")).first()
    bins = max(1, -(-size["n"] // BIN_TEXTS), -(-size["s"] // BIN_SHINGLES))
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(0))
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part")))
    dealt = sets.join(small(large), "near", "left").withColumn("part", part).withColumn("other", F.explode(others))
    place = F.xxhash64("near", F.least("part", "other"), F.greatest("part", "other"))
    return dealt.select(place.alias("place"), F.when(F.col("parts").isNull(), F.pmod(place, F.lit(bins))).otherwise(place).alias("bin"), "node", "shingles")


def verified_groups(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle_words: int = 5, similarity: float = 0.8, row: str | None = None, reach: int = 3,
) -> DataFrame:
    """(id, component_id), one row per input row: documents grouped by a Jaccard similarity of at least 0.8.

    Similarity is that of the sets of lower-cased ``shingle_words``-word shingles.  Candidates are the links of the
    trees over the texts' fingerprints, at most ``reach`` bits apart, and, since at this similarity fingerprints differ
    by ten bits and more, texts that share one of the rarest shingles of both (prefix filter: two texts at the
    similarity always do, whatever the edit).  All pairs of each group of candidates are then judged, except those that
    verified links have joined already, so the groups are those of brute force (on hashes: 64 bits for whole texts, 32
    and more for shingles).  Equal texts are one vertex, and null counts as empty; texts without words are alike.
    component_id is the smallest id of the group; a null id gets its text's group, null if it has no other.  With
    ``row``, that column and ``component``, a key of the group that does not depend on ids, are added.  Extra columns
    are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    more = ["row"] if row else []
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.col(row).alias("row")] if row else []))
    rows = rows.withColumn("node", F.xxhash64("text"))
    keys = kept(rows.select("id", *more, "node", F.octet_length("text").alias("bytes")))
    texts = distinct_texts(rows, keys)
    each = keys.groupBy("node").agg(F.max("bytes").alias("bytes")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    prefixes = kept(shingle_prefixes(texts, shingle_words, similarity, each["n"], each["bytes"] or 0))
    prints = kept(fingerprints(texts, "node", "text", shingle_words).withColumnRenamed("id", "node"))
    reps = kept(prints.groupBy("fp").agg(F.min("node").alias("rep")))
    candidates = kept(
        _candidates(prefixes, similarity)
        .union(prints.join(reps, "fp").where("node <> rep").select("rep", "node"))
        .union(hamming_links(reps, reach).select("a", "b")))
    near = connected_components(candidates).select(F.col("id").alias("node"), F.col("component_id").alias("near"))
    grouped = looked_up(texts, near, "node").where("near is not null")
    sets = kept(grouped.select("near", "node", "text").mapInArrow(_sets(shingle_words), "near long, node long, shingles array<int>"))
    discard(prefixes, prints, reps, candidates)
    sets, links = _peel(sets, similarity)
    placed = _placed(sets)
    found = placed.groupBy("bin").applyInArrow(_verify(similarity), "a long, b long")
    for one in links:
        found = found.unionByName(one)
    parts = connected_components(kept(found)).withColumnRenamed("id", "node")
    reps = keys.where("id is not null").groupBy("node").agg(F.min("id").alias("rep"))
    groups = kept(reps.join(parts, "node", "left").select("node", "rep", F.coalesce("component_id", "node").alias("component")))
    smallest = groups.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = kept(groups.join(smallest, "component").select("node", "component", "component_id"))
    discard(sets, groups, parts)
    return keys.join(named, "node", "left").select("id", "component_id", *(["row", "component"] if row else []))
