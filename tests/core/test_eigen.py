"""Leading eigenpairs on edge tables against dense kernels, and k-means on what they give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import eigen, graph

EDGE = "src string, dst string, w double"


def edges_of(spark, w):
    rows = [(f"N{i:03d}", f"N{j:03d}", float(w[i, j])) for i in range(len(w)) for j in range(len(w)) if w[i, j]]
    return spark.createDataFrame(rows, EDGE)


def random_graph(n, seed, share=0.3):
    rng = np.random.default_rng(seed)
    w = rng.random((n, n)) * (rng.random((n, n)) < share)
    np.fill_diagonal(w, 0)
    w[np.arange(n), (np.arange(n) + 1) % n] += 0.1
    return w / w.sum(axis=1, keepdims=True)


def laplacians(w):
    s = (w + w.T) / 2
    d = s.sum(axis=1)
    inv = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    return np.diag(d) - s, np.diag((d > 0) * 1.0) - inv[:, None] * s * inv[None, :]


@pytest.mark.parametrize("how", [{}, {"block": 4, "basis": 20}])
def test_lowest_modes_equal_dense(spark, how):
    """At once with all directions, and by a small basis that is restarted."""
    w = random_graph(36, 1, 0.15)
    e = edges_of(spark, w).coalesce(1).checkpoint()
    for normal in (False, True) if not how else (True,):
        dense, vectors = np.linalg.eigh(laplacians(w)[normal])
        values, table = graph.lowest_modes(e, 3, normal, **how)
        assert np.allclose(values, dense[:3], atol=1e-8)
        got = np.array([r["x"] for r in table.orderBy("entity").collect()])
        assert np.allclose(np.abs((got * vectors[:, :3]).sum(axis=0)), 1, atol=1e-8)


@pytest.mark.parametrize("how", [{}, {"block": 6, "basis": 26}])
def test_leading_complex_values_equal_dense(spark, how):
    w = random_graph(32, 2, 0.12)
    dense = np.linalg.eigvals(w)
    dense = dense[np.lexsort((-dense.imag, -dense.real, -np.round(np.abs(dense), 12)))]
    got = graph.spectrum(edges_of(spark, w).coalesce(1).checkpoint(), 6 if how else 40, **how).orderBy("k").collect()
    values = np.array([complex(r["re"], r["im"]) for r in got])
    assert len(values) == (6 if how else 32) and (np.abs(dense.imag[:6]) > 1e-3).any()
    assert np.allclose(values[:6], dense[:6], atol=1e-7)
    if not how:
        assert np.isclose(values.sum(), np.trace(w), atol=1e-9) and np.allclose(np.sort(np.abs(values)), np.sort(np.abs(dense)), atol=1e-6)


def test_several_components_and_isolated_nodes(spark):
    """Repeated lowest values: one for every component."""
    rows = [(f"{g}{a}", f"{g}{b}", 1.0) for g in "abcde" for a in range(4) for b in range(4) if a != b] + [("alone", "alone", 1.0)]
    values, _ = graph.lowest_modes(spark.createDataFrame(rows, EDGE).coalesce(1).checkpoint(), 7, False, block=4, basis=16)
    assert np.allclose(values[:6], 0, atol=1e-9) and values[6] == pytest.approx(4)


def test_tiny_graphs(spark):
    one = spark.createDataFrame([("a", "a", 2.0)], EDGE)
    assert [(r["re"], r["im"]) for r in graph.spectrum(one).collect()] == [(2.0, 0.0)]
    assert graph.fiedler(one).count() == 1
    none = spark.createDataFrame([], EDGE)
    assert graph.spectrum(none).count() == 0 and graph.spectral_clusters(none).count() == 0
    two = spark.createDataFrame([("a", "b", 1.0)], EDGE)
    assert {r["side"] for r in graph.fiedler(two).collect()} == {"A", "B"} and graph.fiedler(two).first()["lambda2"] == pytest.approx(1)


def test_large_planted_partition(spark):
    """20,000 nodes in two halves with few edges between them: the Fiedler vector tells the halves, with a small residual."""
    n = 20_000
    side = F.col("id") < n // 2
    ids = spark.range(n)
    inner = [F.when(side, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n // 2))).otherwise(n // 2 + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n // 2))) for k in range(6)]
    cross = F.when(F.col("id") % 40 == 0, F.pmod(F.xxhash64("id", F.lit(99)), F.lit(n)))
    e = ids.select("id", F.explode(F.array(*inner, cross)).alias("to")).where("to is not null and id <> to")
    e = e.select(F.col("id").cast("string").alias("src"), F.col("to").cast("string").alias("dst"), F.lit(1.0).alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w")).checkpoint()
    f = graph.fiedler(e, tolerance=1e-7).checkpoint()
    lv = graph.laplacian(e).join(f.select(F.col("entity").alias("dst"), "value"), "dst").groupBy(F.col("src").alias("entity")).agg(F.sum(F.col("l") * F.col("value")).alias("lv"))
    worst = f.join(lv, "entity").agg(F.sqrt(F.sum(F.pow(F.col("lv") - F.col("lambda2") * F.col("value"), 2)))).first()[0]
    assert worst < 1e-5 and f.first()["lambda2"] > 0
    told = f.groupBy((F.col("entity").cast("int") < n // 2).alias("half"), "side").count().collect()
    assert sum(sorted(r["count"] for r in told)[-2:]) > 0.99 * n


def test_ring_of_cliques(spark):
    groups = "ABCDEF"
    rows = [(f"{g}{a}", f"{g}{b}", 1.0) for g in groups for a in range(6) for b in range(6) if a != b]
    rows += [(f"{g}0", f"{groups[(i + 1) % 6]}1", 0.1) for i, g in enumerate(groups)]
    e = spark.createDataFrame(rows, EDGE).coalesce(1).checkpoint()
    got = {r["entity"]: r["community"] for r in graph.spectral_clusters(e).collect()}
    assert [{got[f"{g}{a}"] for a in range(6)} for g in groups] == [{k} for k in range(6)]
    labels = spark.createDataFrame(list(got.items()), "entity string, community int")
    assert graph.modularity(e, labels).first()[0] == pytest.approx(1 - 1 / 6, abs=0.01)


def test_k_means_on_points(spark):
    rng = np.random.default_rng(3)
    centre = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [5, 30]])
    x = np.concatenate([c + rng.normal(size=(80, 2)) for c in centre])
    df = spark.createDataFrame([(f"p{i:04d}", r.tolist()) for i, r in enumerate(x)], "entity string, x array<double>").repartition(5)
    got = [r["community"] for r in eigen.k_means(df, 5, tries=5).orderBy("entity").collect()]
    assert got == [i // 80 for i in range(400)]
    same = spark.createDataFrame([(f"p{i}", [1.0, 2.0]) for i in range(9)], "entity string, x array<double>")
    assert {r["community"] for r in eigen.k_means(same, 3).collect()} == {0}
