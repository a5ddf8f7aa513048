"""Embedding near-duplicates by spherical-cap filters.

Filter directions come from structured random product codes: a rotated vector is cut into blocks, each block
has a small random code, and a filter is one code word per block; its score is the sum of the block products.
A vector is list-decoded to every filter whose cap it lies in; the cap's threshold is the vector's own
``caps``-th best score, so that a vector always has that many filters however the table is spread.  Rows meet
in the filters they share (a join on label and filter), and each pair that meets is verified by its cosine.

Embeddings of a model mostly have a common direction, which would send most of a label to a few filters; so what is
decoded is a vector's difference from the mean of its label (a smaller angle between vectors this near one another is
still one that shares filters), while pairs are verified on the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Forest, discard, kept, paired_groups, prepare, small
from lattica.llm.components import connected_components

#: Labels whose code has so many words or fewer are small: whatever their vectors have in common, all pairs are few.
FEW_WORDS = 8
PART_ROWS = 2000
BIN_ROWS = 20000


@lru_cache(maxsize=64)
def product_code(dim: int, code: int, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation of code number ``code`` and its unit code words by block; the same in every task."""
    rng = np.random.default_rng([dim, code, words])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    blocks = []
    for part in np.array_split(np.arange(dim), min(2, dim)):
        w = rng.standard_normal((words, len(part)))
        blocks.append(w / np.linalg.norm(w, axis=1, keepdims=True))
    return rotation, blocks


def list_decode(unit: np.ndarray, code: int, words: int, caps: int) -> np.ndarray:
    """For each row, the filters with the ``caps`` highest scores (exact: a top sum uses top summands only)."""
    rotation, blocks = product_code(unit.shape[1], code, words)
    turned, at, best, ids = unit @ rotation, 0, None, None
    for w in blocks:
        score = turned[:, at : at + w.shape[1]] @ w.T
        at += w.shape[1]
        top = np.argsort(-score, axis=1, kind="stable")[:, :caps]
        score = np.take_along_axis(score, top, 1)
        if best is None:
            best, ids = score, top
            continue
        both = (best[:, :, None] + score[:, None, :]).reshape(len(unit), -1)
        name = (ids[:, :, None] * words + top[:, None, :]).reshape(len(unit), -1)
        pick = np.argsort(-both, axis=1, kind="stable")[:, :caps]
        best, ids = np.take_along_axis(both, pick, 1), np.take_along_axis(name, pick, 1)
    return ids


def _units(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision from a list column whose rows have one length."""
    v = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _decoder(codes: int, caps: int):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.stack([np.asarray(batch.column("dim")), np.asarray(batch.column("words"))], axis=1)
            for dim, words in np.unique(kind, axis=0).tolist():
                part = batch.take(pa.array(np.flatnonzero((kind == [dim, words]).all(axis=1))))
                unit = _units(part.column("embedding"))
                mean = part.column("mean")
                away = unit - np.asarray(mean.fill_null(pa.scalar([0.0] * dim, mean.type)).flatten(), np.float64).reshape(unit.shape)
                length = np.linalg.norm(away, axis=1, keepdims=True)
                away = np.where(length > 1e-9, away / np.maximum(length, 1e-300), unit)
                found = np.hstack([list_decode(away, r, words, caps) + r * words * words for r in range(codes)])
                n, each = found.shape
                row = pa.array(np.repeat(np.arange(n), each))
                found = np.sort(found, axis=1).astype(np.int32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), each).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").take(row), part.column("dim").take(row), pa.array(found.ravel()),
                     part.column("rep").take(row), part.column("size").take(row), lists.take(row),
                     part.column("embedding").take(row)],
                    names=["label", "dim", "filter", "rep", "size", "filters", "embedding"])
    return decode


def _mean_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's sums of unit vectors by label and length."""
    for batch in batches:
        label = batch.column("label").dictionary_encode()
        key = np.stack([np.asarray(label.indices), np.asarray(batch.column("dim"))], axis=1)
        names, inverse = np.unique(key, axis=0, return_inverse=True)
        for k, (code, dim) in enumerate(names.tolist()):
            rows = np.flatnonzero(inverse.ravel() == k)
            total = _units(batch.column("embedding").take(pa.array(rows))).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [label.dictionary.take(pa.array([code] * dim)), pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(total), pa.array([len(rows)] * dim, pa.int64())],
                names=["label", "dim", "i", "s", "n"])


def label_means(classes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(label, dim, mean): the mean unit vector of each label of ``sizes``, by length of its vectors."""
    kind = classes.schema["label"].dataType.simpleString()
    sums = classes.join(small(sizes), "label").select("label", "dim", "embedding").mapInArrow(_mean_sums, f"label {kind}, dim int, i int, s double, n long")
    each = sums.groupBy("label", "dim", "i").agg((F.sum("s") / F.sum("n")).alias("m"))
    return each.groupBy("label", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))  # as many as a vector has


def _bits(filters: np.ndarray, here: int) -> np.ndarray:
    """Each row's earlier filters that another row of the group has too, as bits."""
    early = filters < here
    names, counts = np.unique(filters[early], return_counts=True)
    names = names[counts > 1]
    bits = np.zeros((len(filters), len(names) // 8 + 1), np.uint8)
    row, col = np.nonzero(early & np.isin(filters, names))
    at = np.searchsorted(names, filters[row, col])
    np.bitwise_or.at(bits, (row, at >> 3), (1 << (at & 7)).astype(np.uint8))
    return bits


def _link_group(unit, size, filters, here, first, second, threshold):
    """Links of one group: weighted link counts per row and edges of a spanning forest.

    A pair is taken in the smallest filter that its rows share, so that it counts once.
    """
    n = len(unit)
    bits, count, forest, edges = _bits(filters, here), np.zeros(n, np.int64), Forest(n), []
    a = np.flatnonzero(first)
    b = a if second is None else np.flatnonzero(second)
    step = max(1, 500_000 // max(1, len(b)))
    for i0 in range(0, len(a), step):
        rows = a[i0 : i0 + step]
        i, j = np.nonzero(unit[rows] @ unit[b].T >= threshold)
        i, j = rows[i], b[j]
        if second is None:
            i, j = i[i < j], j[i < j]
        per = max(1, 4_000_000 // bits.shape[1])
        for k in range(0, len(i), per):
            x, y = i[k : k + per], j[k : k + per]
            new = ~(bits[x] & bits[y]).any(axis=1)
            x, y = x[new], y[new]
            count += np.bincount(x, size[y], n).astype(np.int64) + np.bincount(y, size[x], n).astype(np.int64)
            # one edge for each pair of sets still apart: first towards the first partner, then what is left
            for _ in range(2):
                label = np.array([forest.root(t) for t in range(n)])
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                if not len(x):
                    break
                _, once = np.unique(y, return_index=True) if _ == 0 else np.unique(label[x] * n + label[y], return_index=True)
                edges += [(p, q) for p, q in zip(x[once].tolist(), y[once].tolist(), strict=True) if forest.join(p, q)]
            else:
                edges += [(p, q) for p, q in zip(x.tolist(), y.tolist(), strict=True) if forest.join(p, q)]
    return count, edges


def _linker(threshold: float):
    def link(t: pa.Table) -> pa.Table:
        col = {c: t.column(c).to_numpy() for c in ("dim", "filter", "rep", "size", "part", "pa", "pb")}
        col["label"] = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((col["rep"], col["pb"], col["pa"], col["filter"], col["dim"], col["label"]))
        key = np.stack([col[c][order] for c in ("label", "dim", "filter", "pa", "pb")])
        cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])
        filters, vectors = t.column("filters").combine_chunks(), t.column("embedding").combine_chunks()
        out_a, out_b, out_n = [], [], []
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if e - s < 2:
                continue
            rows = order[s:e]
            take = pa.array(rows)
            unit = _units(vectors.take(take))
            own = np.asarray(filters.take(take).flatten()).reshape(len(rows), -1)
            part, low, high = col["part"][rows], key[3, s], key[4, s]
            second = None if low == high else part == high
            count, edges = _link_group(unit, col["size"][rows], own, key[2, s], part == low, second, threshold)
            rep, hit = col["rep"][rows], np.flatnonzero(count)
            out_a += [rep[hit]]
            out_b += [np.full(len(hit), -1)]
            out_n += [count[hit]]
            if edges:
                x, y = np.array(edges).T
                out_a, out_b, out_n = [*out_a, rep[x]], [*out_b, rep[y]], [*out_n, np.full(len(x), -1)]
        arrays = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (out_a, out_b, out_n)]
        return pa.table([*map(pa.array, arrays)], names=["a", "b", "n"])
    return link


def near_duplicates(
    vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    threshold: float = 0.98, codes: int = 4, caps: int = 6, bucket: int = 48,
) -> DataFrame:
    """Link vectors of equal, non-null label whose cosine is at least ``threshold``.

    Returns one row per input row: (id, n_links, component_id, kept).  Equal vectors form a class that is
    compared once; its members count one another as links.  A vector that is null, empty or zero, or holds a
    null, NaN or infinite component, or whose label is null, has no links and is its own component.  A null id
    gives a null component and kept = null, and takes no part in linking.  Rows of equal id count as separate
    vectors.  Other columns of the input are ignored; an empty table gives an empty result.

    ``codes`` x ``caps`` filters are taken per vector, and the code's size follows the number of the label's classes so
    that a filter holds about ``bucket`` of them, in a label with half of all vectors too; filters that hold more (near
    copies) are split into parts, and every pair of parts meets.  Only counts and a spanning forest leave a task, never
    all pairs of a group.  Two vectors at the threshold share a filter unless all directions fall badly for them: with
    the defaults none of 20,000 random pairs at a cosine of 0.98 was missed.
    """
    spark = prepare(vectors.sparkSession)
    held = F.col(embedding)
    if vectors.schema[embedding].dataType.simpleString() != "array<float>":  # floats travel as they are and are compared as doubles
        held = held.cast("array<double>")
    rows = vectors.select(F.col(id).alias("vec_id"), held.alias("embedding"), F.col(label).alias("label"))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    classes = (
        rows.where(F.coalesce(usable, F.lit(False))).groupBy("label", "embedding")
        .agg(F.min("vec_id").cast("long").alias("first"), F.count(F.lit(1)).alias("size"))
        .withColumn("dim", F.size("embedding"))
    )
    # sizes of codes come in steps, so that a task holds few of them
    classes = kept(classes.withColumn("rep", F.monotonically_increasing_id()))  # an id may be that of unlike vectors: classes go by numbers of their own
    step = F.ceil(F.log2(F.sqrt(F.count(F.lit(1)) * caps / bucket)) * 2) / 2
    sizes = kept(classes.groupBy("label").agg(F.greatest(F.lit(3), F.ceil(F.pow(F.lit(2.0), step))).cast("int").alias("words")))
    bins = max(1, -(-classes.count() * codes * caps // BIN_ROWS))
    kind = {c: classes.schema[c].dataType.simpleString() for c in ("label", "embedding")}
    schema = f"label {kind['label']}, dim int, filter int, rep long, size long, filters array<int>, embedding {kind['embedding']}"
    means = kept(label_means(classes, kept(sizes.where(F.col("words") > FEW_WORDS).select("label"))))
    coded = classes.join(small(sizes), "label").join(small(means), ["label", "dim"], "left")
    dealt = paired_groups(coded.mapInArrow(_decoder(codes, caps), schema), ["label", "dim", "filter"], "rep", PART_ROWS)
    found = kept(
        dealt.withColumn("bin", F.pmod(F.xxhash64("label", "dim", "filter", "pa", "pb"), F.lit(bins)))
        .groupBy("bin").applyInArrow(_linker(threshold), "a long, b long, n long")
    )
    parts = connected_components(found.where("n < 0"))
    counts = found.where("n >= 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    named = kept(classes.join(parts.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component_id", "rep")).select("rep", "label", "embedding", "first", "size", "component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    done = kept(
        named.join(counts, "rep", "left").join(smallest, "component")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    )
    discard(found, parts)
    rows = rows.withColumn("label", F.when(F.coalesce(usable, F.lit(False)), F.col("label")))
    return (
        rows.join(done, ["label", "embedding"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
