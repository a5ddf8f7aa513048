"""Graph and dynamics operators against dense NumPy definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import backtest, dynamics, graph

EDGE = "src string, dst string, w double"


@pytest.fixture(scope="module")
def coupled(spark):
    w = np.random.RandomState(42).rand(10, 10)
    np.fill_diagonal(w, 0)
    w /= w.sum(axis=1, keepdims=True)
    names = [f"N{i}" for i in range(10)]
    return names, w, spark.createDataFrame([(names[i], names[j], float(w[i, j])) for i in range(10) for j in range(10) if i != j], EDGE)


def vector(df, key, value, names):
    held = {r[key]: r[value] for r in df.collect()}
    return np.array([held[n] for n in names])


def test_row_normalize_keeps_zero_rows(spark):
    e = graph.row_normalize(spark.createDataFrame([("A", "B", 0.0), ("C", "A", 1.0), ("C", "B", 3.0)], EDGE))
    assert {(r["src"], r["dst"]): r["w"] for r in e.collect()} == {("A", "B"): 0.0, ("C", "A"): 0.25, ("C", "B"): 0.75}


def test_mirror(spark):
    d = spark.createDataFrame([("A", "B", 10.0)], "src string, dst string, value double")
    assert {(r["src"], r["dst"]): r["w"] for r in graph.accumulate(graph.mirrored(d)).collect()} == {("A", "B"): 10.0, ("B", "A"): 5.0}


def test_missing_migration_goes_to_trade_and_geography():
    w = graph.channel_weights({"trade", "financial", "geographic", "political"})
    assert w["trade"] == pytest.approx(0.30 + 0.53 * 0.15) and w["geographic"] == pytest.approx(0.15 + 0.47 * 0.15)
    assert sum(w.values()) == pytest.approx(1)


def test_coincident_points_get_no_weight(spark):
    p = spark.createDataFrame([("A", 1.0, 1.0), ("B", 1.0, 1.0), ("C", 5.0, 5.0)], "entity string, lat double, lon double")
    got = {(r["src"], r["dst"]): r["w"] for r in graph.geographic(p).collect()}
    assert got["A", "B"] == 0 and got["A", "C"] == pytest.approx(1)


def test_pagerank_and_edge_table_form(spark, coupled, monkeypatch):
    names, w, edges = coupled
    r = np.full(10, 0.1)
    for _ in range(50):
        r = 0.85 * w.T @ r + 0.015
        r /= r.sum()
    assert vector(graph.pagerank(edges), "entity", "pagerank", names) == pytest.approx(r, abs=1e-9)
    assert r[:3] == pytest.approx([0.10506673, 0.09767946, 0.10380719], abs=1e-7)


@pytest.fixture
def dangling(spark):
    """Twelve nodes, four of them without out-edges."""
    w = np.random.RandomState(7).rand(12, 12) * (np.random.RandomState(8).rand(12, 12) < 0.4)
    np.fill_diagonal(w, 0)
    w[8:] = 0
    w[:8] /= w[:8].sum(axis=1, keepdims=True)
    names = [f"D{i:02d}" for i in range(12)]
    return names, w, spark.createDataFrame([(names[i], names[j], float(w[i, j])) for i in range(12) for j in range(12) if w[i, j] > 0], EDGE)


def test_both_forms_of_pagerank_agree(spark, dangling, monkeypatch):
    names, w, edges = dangling
    r = np.full(12, 1 / 12)
    for _ in range(9):
        r = 0.85 * w.T @ r + 0.15 / 12
        r /= r.sum()
    assert vector(graph.pagerank(edges, steps=9), "entity", "pagerank", names) == pytest.approx(r, abs=1e-12)
    two = edges.withColumn("draw", F.lit(1)).union(edges.withColumn("w", F.col("w") * 0.5).withColumn("draw", F.lit(2)))
    small = {(x["draw"], x["entity"]): x["pagerank"] for x in graph.pagerank(two, steps=4, by=["draw"]).collect()}
    monkeypatch.setattr(graph, "DENSE_LIMIT", 5)
    assert vector(graph.pagerank(edges, steps=9), "entity", "pagerank", names) == pytest.approx(r, abs=1e-12)
    large = {(x["draw"], x["entity"]): x["pagerank"] for x in graph.pagerank(two, steps=4, by=["draw"]).collect()}
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k], abs=1e-12) for k in small)


def test_pagerank_until_it_settles(spark, dangling, monkeypatch):
    names, w, edges = dangling
    for outgoing in (True, False):
        r, steps = np.full(12, 1 / 12), 0
        for _ in range(200):
            new = 0.85 * (w.T if outgoing else w) @ r + 0.15 / 12
            new /= new.sum()
            if np.linalg.norm(new - r) < 1e-4:
                break
            r, steps = new, steps + 1
        assert 2 < steps < 50
        assert vector(graph.pagerank_until(edges, tolerance=1e-4, outgoing=outgoing), "entity", "pagerank", names) == pytest.approx(r, abs=1e-12)
    monkeypatch.setattr(graph, "DENSE_LIMIT", 5)
    assert vector(graph.pagerank_until(edges, tolerance=1e-4, outgoing=False), "entity", "pagerank", names) == pytest.approx(r, abs=1e-12)


def test_leading_eigenvector(spark, coupled, dangling, monkeypatch):
    names, w, edges = coupled
    w = w * np.linspace(0.5, 2, 10)[:, None]
    edges = spark.createDataFrame([(names[i], names[j], float(w[i, j])) for i in range(10) for j in range(10) if i != j], EDGE)
    values, vectors = np.linalg.eig(w)
    v = np.abs(vectors[:, np.argmax(np.abs(values))].real)
    assert vector(graph.eigenvector_centrality(edges), "entity", "centrality", names) == pytest.approx(v / v.sum(), abs=1e-9)
    assert graph.spectral_radius(edges).first()[0] == pytest.approx(np.abs(values).max(), abs=1e-9)
    left = np.linalg.eig(w.T)
    u = np.abs(left[1][:, np.argmax(np.abs(left[0]))].real)
    few = vector(graph.eigenvector_centrality(edges, True, 8), "entity", "centrality", names)
    assert vector(graph.eigenvector_centrality(edges, True), "entity", "centrality", names) == pytest.approx(u / u.sum(), abs=1e-9)
    monkeypatch.setattr(graph, "DENSE_LIMIT", 5)
    assert vector(graph.eigenvector_centrality(edges, True, 8), "entity", "centrality", names) == pytest.approx(few, abs=1e-12)
    stable = dynamics.stability(graph.spectral_radius(edges, 8), 0.4).first()
    assert stable["stable"] and stable["margin"] == pytest.approx(1 - 0.4 * np.abs(values).max(), abs=1e-3)


def test_dynamics_on_edge_tables(spark, dangling, monkeypatch):
    names, w, edges = dangling
    s = np.random.RandomState(1).randn(12)
    scores = spark.createDataFrame(list(zip(names, map(float, s), strict=True)), "entity string, score double")
    zero = scores.withColumn("score", F.lit(0.0))
    forms = []
    for limit in (2000, 5):
        monkeypatch.setattr(graph, "DENSE_LIMIT", limit)
        sens = {(r["target"], r["source"]): r["l"] for r in dynamics.sensitivities(edges, 0.4, 6).collect()}
        path = {(r["t"], r["entity"]): r["x"] for r in dynamics.simulate(edges, scores, zero, 0.4, 3).collect()}
        forms.append((sens, path, vector(dynamics.steady_state(edges, scores, 0.4, 6), "entity", "steady_state", names)))
    assert all(a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a) for a, b in zip(forms[0][:2], forms[1][:2], strict=True))
    assert forms[0][2] == pytest.approx(forms[1][2], abs=1e-12)
    noisy = dynamics.simulate(edges, scores, zero, 0.4, 2, noise=0.1).collect()
    assert sorted(map(tuple, noisy)) == sorted(map(tuple, dynamics.simulate(edges, scores, zero, 0.4, 2, noise=0.1).collect()))
    far = [r["x"] - forms[0][1][r["t"], r["entity"]] for r in noisy if r["t"] == 1]
    assert 0.02 < np.std(far) < 0.3 and all(r["x"] == 0 for r in noisy if r["t"] == 0)


def test_normal_draws(spark):
    x = spark.range(20000).select(dynamics.normal_draw("id", F.lit(1)).alias("x")).toPandas()["x"]
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03 and abs((x**3).mean()) < 0.1


def test_steady_state_sensitivities_and_shock(spark, coupled):
    names, w, edges = coupled
    s = np.random.RandomState(42).randn(10)
    scores = spark.createDataFrame(list(zip(names, map(float, s), strict=True)), "entity string, score double")
    x = np.linalg.solve(np.eye(10) - 0.4 * w, 0.6 * s)
    base = dynamics.steady_state(edges, scores)
    assert vector(base, "entity", "steady_state", names) == pytest.approx(x, abs=1e-9)
    assert x[:3] == pytest.approx([0.46966002, 0.11664813, 0.52709775], abs=1e-6)
    sens = dynamics.sensitivities(edges).cache()
    leontief = 0.6 * np.linalg.inv(np.eye(10) - 0.4 * w)
    got = {(r["target"], r["source"]): r["l"] for r in sens.collect()}
    assert all(got[a, b] == pytest.approx(leontief[i, j], abs=1e-9) for i, a in enumerate(names) for j, b in enumerate(names))
    path = dynamics.simulate(edges, scores, scores.withColumn("score", F.lit(0.0)), steps=40)
    assert vector(path.where("t = 40"), "entity", "x", names) == pytest.approx(x, abs=1e-3)
    shocks = spark.createDataFrame([("s", "N3", 1.0)], "scenario_id string, entity string, delta double")
    moved = dynamics.factor_shock(sens, base, shocks)
    assert vector(moved, "entity", "delta", names) == pytest.approx(leontief[:, 3], abs=1e-9)
    theta = np.quantile(x, 0.9)
    risk = [sum(x[j] + 2 * leontief[j, i] > theta >= x[j] for j in range(10) if j != i) for i in range(10)]
    assert vector(dynamics.systemic_risk(sens, base), "entity", "systemic_risk", names).tolist() == risk
    with pytest.raises(ValueError):
        dynamics.steady_state(edges, scores, 1.5)


def test_hops_and_unreachable(spark):
    e = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("X", "Y", 1.0)], EDGE)
    start = spark.createDataFrame([("A",)], "entity string")
    assert {r["entity"]: r["hops"] for r in graph.hops(e, start).collect()} == {"A": 0, "B": 1, "C": 2}


def test_hops_have_no_bound(spark):
    chain = spark.createDataFrame([(f"C{i:02d}", f"C{i + 1:02d}", 1.0) for i in range(34)], EDGE)
    got = {r["entity"]: r["hops"] for r in graph.hops(chain, spark.createDataFrame([("C00",)], "entity string")).collect()}
    assert got == {f"C{i:02d}": i for i in range(35)}
    two = graph.hops(chain.limit(3), spark.createDataFrame([("C00",), ("C02",)], "entity string"), each=True)
    assert {(r["source"], r["entity"]): r["hops"] for r in two.collect()} == {("C00", f"C0{i}"): i for i in range(4)} | {("C02", "C02"): 0, ("C02", "C03"): 1}


def test_betweenness_counts_shortest_paths(spark, dangling, monkeypatch):
    names, w, edges = dangling
    dist, count = np.full((12, 12), 99), np.zeros((12, 12))
    for s in range(12):
        dist[s, s], count[s, s], queue = 0, 1, [s]
        for v in queue:
            for u in np.flatnonzero(w[v] > 0):
                if dist[s, u] == 99:
                    dist[s, u] = dist[s, v] + 1
                    queue.append(u)
                count[s, u] += count[s, v] * (dist[s, u] == dist[s, v] + 1)
    b = np.zeros(12)
    for v in range(12):
        for s in range(12):
            for t in range(12):
                if s != v != t and s != t and dist[s, t] < 99 and dist[s, v] + dist[v, t] == dist[s, t]:
                    b[v] += count[s, v] * count[v, t] / count[s, t]
    assert vector(graph.betweenness(edges, 0.0), "entity", "betweenness", names) == pytest.approx(b / b.max(), abs=1e-12)
    monkeypatch.setattr(graph, "SOURCE_BATCH", 5)
    assert vector(graph.betweenness(edges, 0.0), "entity", "betweenness", names) == pytest.approx(b / b.max(), abs=1e-12)


def test_domino_against_arrays(spark, coupled):
    names, w, edges = coupled
    s = np.random.RandomState(3).randn(10)
    scores = spark.createDataFrame(list(zip(names, map(float, s), strict=True)), "entity string, score double")
    sens, base = dynamics.sensitivities(edges).checkpoint(), dynamics.steady_state(edges, scores).checkpoint()
    lev, x = 0.6 * np.linalg.inv(np.eye(10) - 0.4 * w), np.linalg.solve(np.eye(10) - 0.4 * w, 0.6 * s)
    theta, fallen, want, d = np.quantile(x, 0.9), [4], {("N4", 0, None)}, 3.0 * lev[:, 4]
    for k in range(1, 21):
        x = x + d
        new = [i for i in range(10) if x[i] > theta and i not in fallen]
        if not new:
            break
        want |= {(names[i], k, names[max(fallen, key=lambda f: (w[i, f] if f != i else -1, names[f]))]) for i in new}
        d = sum(1.5 * lev[:, i] for i in new)
        fallen += new
    got = {(r["entity"], r["step"], r["trigger"]) for r in dynamics.domino(edges, base, sens, "N4", 3.0).collect()}
    assert got == want and len(want) > 3


def test_cascade_report_against_arrays(spark, coupled):
    names, w, edges = coupled
    s = np.random.RandomState(3).randn(10)
    scores = spark.createDataFrame(list(zip(names, map(float, s), strict=True)), "entity string, score double")
    sens, base = dynamics.sensitivities(edges).checkpoint(), dynamics.steady_state(edges, scores).checkpoint()
    lev, x = 0.6 * np.linalg.inv(np.eye(10) - 0.4 * w), np.linalg.solve(np.eye(10) - 0.4 * w, 0.6 * s)
    delta, theta, middle = 4.0 * (lev[:, 2] + lev[:, 5]), np.quantile(x, 0.5), np.median(w[w > 0])
    others = [i for i in range(10) if i not in (2, 5)]
    crossed = [i for i in others if x[i] + delta[i] > theta >= x[i]]

    def far(a, t):
        seen, queue = {a: 0}, [a]
        for v in queue:
            for u in np.flatnonzero(w[v] > middle):
                if u not in seen:
                    seen[u] = seen[v] + 1
                    queue.append(u)
        return seen.get(t, 10)

    r = dynamics.cascade_report(edges, base, sens, spark.createDataFrame([("N2",), ("N5",)], "entity string"), 4.0, float(theta)).first()
    assert (r["crossed"], r["depth"]) == (len(crossed), max(far(a, t) for a in (2, 5) for t in crossed)) and crossed
    assert r["breadth"] == pytest.approx(len(crossed) / 8) and r["amplification"] == pytest.approx(max(abs(delta[i]) for i in others) / 4, abs=1e-9)


def test_channels_fall_back(spark):
    none = spark.createDataFrame([], "src string, dst string, period int, value double")
    p = spark.createDataFrame([("A", 1.0, 1.0), ("B", 1.0, 9.0), ("C", 5.0, 5.0)], "entity string, lat double, lon double")
    sizes = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "entity string, size double")
    members = spark.createDataFrame([("o", "A"), ("o", "B")], "org string, entity string")
    growth = spark.createDataFrame([(e, t, float(v)) for e, k in (("A", 1), ("B", 2), ("C", -1)) for t, v in enumerate(np.arange(6) * k)], "entity string, period int, value double")
    rows, weights = graph.channels_with_fallbacks(none, none, none, sizes, sizes, p, members, growth)
    got = {(r["channel"], r["src"], r["dst"]): r["w"] for r in rows.collect()}
    assert "migration" not in weights and sum(weights.values()) == pytest.approx(1)
    assert got["financial", "A", "B"] == pytest.approx(1) and got["financial", "A", "C"] == 0
    assert got["trade", "A", "B"] + got["trade", "A", "C"] == pytest.approx(1)
    moved = spark.createDataFrame([("A", "B", 1, 4.0)], "src string, dst string, period int, value double")
    rows, weights = graph.channels_with_fallbacks(moved, moved, moved, sizes, sizes, p, members, growth)
    assert set(weights) == {"trade", "geographic", "financial", "political", "migration"} and {r["channel"] for r in rows.collect()} == set(weights)


def test_isolated_node_has_zero_laplacian_row(spark):
    e = spark.createDataFrame([("A", "B", 1.0), ("C", "C", 1.0)], EDGE)
    got = {(r["src"], r["dst"]): (r["l"], r["l_sym"], r["l_rw"]) for r in graph.laplacian(e).collect()}
    assert got["C", "C"] == (0.0, 0.0, 0.0) and got["A", "A"] == (0.5, 1.0, 1.0) and got["A", "B"] == (-0.5, -1.0, -1.0)


def test_betweenness_on_a_path(spark):
    e = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("C", "D", 1.0)], EDGE)
    assert {r["entity"]: r["betweenness"] for r in graph.betweenness(e, 0.0).collect()} == {"A": 0.0, "B": 1.0, "C": 1.0, "D": 0.0}


def test_clusters_of_two_cliques(spark):
    pairs = [(a, b) for g in ("ABCDE", "VWXYZ") for a in g for b in g if a != b]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [("A", "V", 0.01)], EDGE)
    got = {r["entity"]: r["community"] for r in graph.spectral_clusters(e, 2).collect()}
    assert {got[x] for x in "ABCDE"} == {0} and {got[x] for x in "VWXYZ"} == {1}
    side = {r["entity"]: r["side"] for r in graph.fiedler(e).collect()}
    assert len({side[x] for x in "ABCDE"}) == 1 and side["A"] != side["V"]
    labels = spark.createDataFrame(list(got.items()), "entity string, community int")
    assert graph.modularity(e, labels).first()[0] > 0.45


def test_short_history_falls_back(spark, coupled):
    s = spark.createDataFrame([("N0", 2000, 1.0), ("N0", 2001, 1.0)], "entity string, period int, score double")
    row = backtest.calibrate(s, coupled[2]).first()
    assert row["alpha"] == 0.40 and row["rmse"] is None


def test_episode_without_primary_is_skipped(spark):
    e = backtest.episodes_table(spark, [("a", [2001], ["N0"], []), ("b", [2001], [], ["N0"])])
    s = spark.createDataFrame([("N0", 2000, 1.0), ("N0", 2001, 2.0)], "entity string, period int, score double")
    assert {r["name"]: r["status"] for r in backtest.validate_episodes(e, s).collect()} == {"a": "PASS", "b": "SKIP"}
