"""Leading eigenpairs of an edge table, and k-means on the embedding that they give.

A block of vectors is a table (entity, array); a product with the matrix is a join of the edges with that table and a
sum with map-side combining.  Whatever has the size of the basis squared (Gram sums, the projected matrix) is summed
by Spark over the rows and solved on the driver; whatever has a row per entity stays in tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a basis has before it is restarted, and products with the matrix at most.
BASIS, STEPS = 40, 300


def _cells(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).flatten(), np.float64).reshape(batch.num_rows, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def row_sums(table: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all batches of an array that ``of`` makes of a batch; tasks add up theirs, Spark adds the tasks'."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "s"])

    out = np.zeros(int(np.prod(shape)))
    for r in table.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # as many rows as the array has cells
        out[r["i"]] = r["s"]
    return out.reshape(shape)


def mapped(table: DataFrame, of: dict[str, Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """(entity, arrays): every array column as a function of a batch's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("entity"), *(_lists(f(batch)) for f in of.values())], names=["entity", *of])

    return table.mapInArrow(run, "entity string, " + ", ".join(f"{c} array<double>" for c in of))


def product(edges: DataFrame, block: DataFrame, column: str, cells: range) -> DataFrame:
    """(entity, a): the matrix times the vectors that some cells of an array column hold, for entities that have edges."""
    sums = [F.sum(F.col("w") * F.col(column)[k]) for k in cells]
    return (edges.select("src", "dst", "w").join(block.select(F.col("entity").alias("dst"), column), "dst")
            .groupBy(F.col("src").alias("entity")).agg(F.array(*sums).alias("a")))


def _drawn(first: int, count: int):
    """Columns of a vector that looks random, by a hash of the entity."""
    return F.array(*[F.pmod(F.xxhash64(F.col("entity"), F.lit(first + j)), F.lit(2_000_003)) / F.lit(1_000_001.5) - 1 for j in range(count)])


def _orthonormal(state: DataFrame, m: int, width: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) such that v @ left + r @ right is orthonormal and orthogonal to v; directions below ``floor`` are dropped.

    Three rounds of sums: lengths and what lies along v, then the same of what is left, orthonormal at last.
    """
    left, right = np.zeros((m, width)), np.eye(width)
    for turn in range(3):
        def sums(b, left=left, right=right):
            v = _cells(b, "v") if m else np.zeros((b.num_rows, 0))
            w = v @ left + _cells(b, "r") @ right
            return w.T @ np.hstack([v, w])

        gram = row_sums(state, sums, (right.shape[1], m + right.shape[1]))
        along, own = gram[:, :m].T, gram[:, m:]
        if turn == 0:
            length = np.sqrt(np.maximum(np.diag(own), 0))
            held = length > floor
            turned = np.eye(len(length))[:, held] / length[held]
        else:
            values, vectors = np.linalg.eigh(own - along.T @ along)
            held = values > 1e-20
            turned = vectors[:, held] / np.sqrt(values[held])
        left, right = (left - along) @ turned, right @ turned
        if not right.shape[1]:
            break
    return left, right


def _ordered(h: np.ndarray, symmetric: bool) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the projected matrix, the leading ones first."""
    if symmetric:
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        return values[::-1], vectors[:, ::-1]
    values, vectors = np.linalg.eig(h)
    order = np.lexsort((-values.imag, -values.real, -np.round(np.abs(values), 12)))
    return values[order], vectors[:, order]


def _span(values: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Orthonormal real columns that span the first ``k`` vectors, and the partner of a complex one at the end."""
    if not np.iscomplexobj(vectors):
        return vectors[:, :k]
    if k < len(values) and values[k - 1].imag > 0 and np.isclose(values[k - 1], values[k].conj()):
        k += 1
    first = vectors[:, :k]
    u, s, _ = np.linalg.svd(np.hstack([first.real, first.imag]), full_matrices=False)
    return u[:, s > 1e-10 * s[0]]


def leading(edges: DataFrame, entities: DataFrame, k: int, symmetric: bool, block: int | None = None, tolerance: float = 1e-10, basis: int = BASIS) -> tuple[np.ndarray, DataFrame, float]:
    """(values, vectors, residual): the ``k`` leading eigenvalues of the matrix (src, dst, w) over ``entities``.

    Leading are the largest values of a symmetric matrix, and those of largest magnitude of another one.  The vectors
    are a table (entity, x array): those of the values for a symmetric matrix, else an orthonormal basis of the space
    that they span.  The residual is the largest one's length over the largest magnitude.

    A basis grows by the residuals of what is wanted, made orthogonal to it, and is restarted from its leading vectors
    when it is full (a restarted block Lanczos or Arnoldi process).  Such a process sees no more copies of a repeated
    value than its block has columns, so once it has settled it goes on from new directions, until it settles on the
    same values again.  Where the basis holds every direction there is, as it does at once for up to ``basis``
    entities, all values are exact.
    """
    entities = entities.select("entity").checkpoint()
    n = entities.count()
    if not n:
        return np.zeros(0), entities.select("entity", F.array().cast("array<double>").alias("x")), 0.0
    k = min(k, n)
    block = min(n, block or (n if n <= basis else k + 2))
    most = min(n, max(basis, 2 * k + 2 * block))
    nothing = F.array().cast("array<double>")
    state = entities.select("entity", nothing.alias("v"), nothing.alias("av"), _drawn(0, block).alias("r")).checkpoint()
    m, width, drawn, scale, residual, settled = 0, block, block, 0.0, np.inf, None
    for _ in range(STEPS):
        left, right = _orthonormal(state, m, width, 1e-13 * scale)
        grown = right.shape[1]
        if grown:
            v = lambda b, left=left, right=right, m=m: np.hstack([_cells(b, "v"), _cells(b, "v") @ left + _cells(b, "r") @ right]) if m else _cells(b, "r") @ right
            with_block = mapped(state, {"v": v, **({"av": lambda b: _cells(b, "av")} if m else {})})
            images = product(edges, with_block, "v", range(m, m + grown))
            zeros = F.array(*[F.lit(0.0)] * grown)
            a = F.coalesce("a", zeros)
            state = with_block.join(images, "entity", "left").select("entity", "v", (F.concat("av", a) if m else a).alias("av")).checkpoint()
            m += grown
        else:  # the basis holds a space that the matrix does not leave: go on from new directions
            state, width, drawn, scale = state.withColumn("r", _drawn(drawn, block)).checkpoint(), block, drawn + block, 0.0
            continue
        h = row_sums(state, lambda b: _cells(b, "v").T @ _cells(b, "av"), (m, m))
        values, vectors = _ordered(h, symmetric)
        q = _span(values, vectors, min(k, m))
        t = q.T @ h @ q
        scale = max(np.abs(values).max(), 1e-300)
        left_over = lambda b, q=q, t=t: _cells(b, "av") @ q - _cells(b, "v") @ (q @ t)
        lengths = np.sqrt(np.maximum(row_sums(state, lambda b, f=left_over: (f(b) ** 2).sum(axis=0), (q.shape[1],)), 0))
        residual = float(lengths.max() / scale)
        if m >= n:
            break
        again = m >= k and residual <= tolerance
        if again and settled is not None and np.allclose(settled, values[:k], rtol=0, atol=10 * max(tolerance, 1e-12) * scale):
            break
        settled = values[:k] if again else settled
        worst = np.sort(np.argsort(-lengths)[:block])
        keep = np.eye(m) if m + block <= most else _span(values, vectors, min(m - 1, k + block))
        width = len(worst)
        state = mapped(state, {"v": lambda b, keep=keep: _cells(b, "v") @ keep, "av": lambda b, keep=keep: _cells(b, "av") @ keep,
                               "r": lambda b, f=left_over, worst=worst: f(b)[:, worst]})
        if again:
            state, width, drawn, scale = state.withColumn("r", _drawn(drawn, block)), block, drawn + block, 0.0
        state, m = state.checkpoint(), keep.shape[1]
    else:
        raise RuntimeError(f"a residual of {residual} is left after {STEPS} products")
    q = _span(values, vectors, k)
    return values[:k], mapped(state, {"x": lambda b: _cells(b, "v") @ q}).checkpoint(), residual


def turned(vectors: DataFrame, count: int) -> DataFrame:
    """Vectors whose entry of largest size (ties: of the first entity) is positive."""
    size = [F.round(F.abs(F.col("x")[j]), 9) for j in range(count)]
    top = vectors.agg(*[F.min(F.struct(-s, "entity", F.col("x")[j].alias("x")))["x"].alias(f"s{j}") for j, s in enumerate(size)]).first()
    signs = F.array(*[F.lit(-1.0 if (top[j] or 0) < 0 else 1.0) for j in range(count)])
    return vectors.select("entity", F.zip_with("x", signs, lambda a, b: a * b).alias("x"))


def lowest(laplacian: DataFrame, entities: DataFrame, k: int, bound: float, **how) -> tuple[np.ndarray, DataFrame, float]:
    """The ``k`` smallest eigenvalues of a symmetric matrix (src, dst, w) whose values are at most ``bound``, as ``leading`` gives them."""
    own = entities.select(F.col("entity").alias("src"), F.col("entity").alias("dst"), F.lit(float(bound)).alias("w"))
    mirrored = laplacian.select("src", "dst", (-F.col("w")).alias("w")).unionByName(own).groupBy("src", "dst").agg(F.sum("w").alias("w")).checkpoint()
    values, vectors, residual = leading(mirrored, entities, k, True, **how)
    return bound - values, vectors, residual


# k-means


def _seeds(points: np.ndarray, weights: np.ndarray, k: int, tries: int, seed: int) -> np.ndarray:
    """``tries`` choices of ``k`` of the candidate points, each next one by weight times squared distance."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(tries):
        chosen, share = [], weights
        for _ in range(k):
            p = share / share.sum() if share.sum() > 0 else weights / weights.sum()
            chosen.append(points[rng.choice(len(points), p=p)])
            share = weights * np.min([((points - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        out.append(chosen)
    return np.array(out)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each try, the nearest centre and its squared distance."""
    distance = np.stack([((x[:, None] - c[None]) ** 2).sum(axis=2) for c in centres])
    return distance.argmin(axis=2), distance.min(axis=2)


def k_means(points: DataFrame, k: int, tries: int = 20, rounds: int = 300, draws: int = 5, seed: int = 42) -> DataFrame:
    """(entity, community) by k-means on (entity, x array); communities are numbered by their smallest entity.

    Seeding is parallel: ``draws`` passes each take points with a chance by their squared distance to what is taken so
    far, about 2 k a pass; the candidates, weighted by the points that are nearest to them, seed ``tries`` runs, which
    go through the table side by side.  The run of least squared distance is the result.
    """
    points = points.select("entity", "x").checkpoint()
    n, dims = points.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return points.select("entity", F.lit(0).alias("community"))
    chance = lambda r: F.pmod(F.xxhash64("entity", F.lit(seed + r)), F.lit(1_000_003)) / 1_000_003.0
    first = points.orderBy(F.xxhash64("entity", F.lit(seed)), "entity").limit(1).collect()
    taken = np.array([r["x"] for r in first])
    away = lambda t: F.array_min(F.array(*[F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in t]))
    left = points.withColumn("d", away(taken))
    for r in range(1, draws + 1):
        left = left.checkpoint()
        cost = left.agg(F.sum("d")).first()[0]
        if not cost > 1e-18 * n:
            break
        more = [x["x"] for x in left.where(chance(r) < F.lit(2.0 * k / cost) * F.col("d")).select("x").collect()]  # about 2 k rows
        if more:
            taken = np.concatenate([taken, more])
            left = left.withColumn("d", F.least("d", away(np.array(more))))
    taken = np.unique(taken, axis=0)
    weights = row_sums(points, lambda b: np.bincount(_nearest(_cells(b, "x"), taken[None])[0][0], minlength=len(taken)).astype(float), (len(taken),))
    centres = _seeds(taken, weights, k, tries, seed)
    cells = k * (dims + 1)

    def sums(b: pa.RecordBatch, centres: np.ndarray) -> np.ndarray:
        x = _cells(b, "x")
        own, distance = _nearest(x, centres)
        out = np.zeros((len(centres), cells + 1))
        for t in range(len(centres)):
            one = np.eye(k)[own[t]]
            out[t, :cells] = (one.T @ np.hstack([x, np.ones((len(x), 1))])).ravel()
            out[t, cells] = distance[t].sum()
        return out

    for _ in range(rounds):
        total = row_sums(points, lambda b, c=centres: sums(b, c), (tries, cells + 1))
        each = total[:, :cells].reshape(tries, k, dims + 1)
        new = np.where(each[..., -1:] > 0, each[..., :-1] / np.maximum(each[..., -1:], 1), centres)
        still = np.allclose(new, centres, rtol=0, atol=1e-9)
        centres = new
        if still:
            break
    cost = np.round(total[:, cells], 12)
    best = centres[int(cost.argmin())][None]
    labelled = mapped(points, {"c": lambda b: _nearest(_cells(b, "x"), best)[0].T.astype(float)}).select("entity", F.col("c")[0].cast("int").alias("c")).checkpoint()
    order = [r["c"] for r in labelled.groupBy("c").agg(F.min("entity").alias("e")).orderBy("e").collect()]  # k rows
    number = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])
    return labelled.select("entity", number[F.col("c")].alias("community"))
