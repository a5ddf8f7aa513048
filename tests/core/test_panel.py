"""Edge cases of panel and statistics operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import schema
from lattica.functions import scalars
from lattica.operators import impute, panel, stats
from lattica.sources import clean, sinks

FACT = "entity string, period int, indicator string, value double, source string"


def series(spark, values, source):
    return spark.createDataFrame([("A", 2000 + k, "i", v, source) for k, v in enumerate(values)], FACT)


def values(df):
    return [r["value"] for r in df.orderBy("period").collect()]


def test_forward_fill_is_bounded(spark):
    rows = series(spark, [None, 1.0, None, None, None, 5.0, None], "FSI")
    assert values(panel.align_temporal(rows, 7)) == [None, 1.0, 1.0, 1.0, None, 5.0, 5.0]


def test_interpolation_fills_one_slot(spark):
    rows = series(spark, [None, 1.0, None, None, 4.0, None, 6.0, None, None], "WB_WDI")
    assert values(panel.align_temporal(rows, 9)) == [None, 1.0, 2.0, None, 4.0, 5.0, 6.0, 6.0, None]


def test_other_sources_are_not_filled(spark):
    rows = series(spark, [1.0, None, 3.0], "ACLED")
    assert values(panel.align_temporal(rows, 3)) == [1.0, None, 3.0]


def test_duplicates_are_averaged(spark):
    rows = spark.createDataFrame([("A", 2000, "i", 1.0, "x"), ("A", 2000, "i", 3.0, "x")], FACT)
    assert values(panel.spine(rows, 1)) == [2.0]


def test_missing_rate_at_the_threshold_stays(spark):
    rows = spark.createDataFrame([("A", 2000 + k, "i", None if k < 6 else 1.0, "x") for k in range(15)] + [("B", 2000 + k, "i", None if k < 7 else 1.0, "x") for k in range(15)], FACT)
    report = panel.missingness(rows, 0.40)
    assert {r["entity"]: r["excluded"] for r in report.collect()} == {"A": False, "B": True}
    assert {r["entity"] for r in panel.drop_missing(rows, report).collect()} == {"A"}


def test_deficit_keeps_null(spark):
    rows = spark.createDataFrame([(-3.0,), (0.0,), (4.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(scalars.deficit("v")).collect()] == [3.0, 0.0, 0.0, None]


def test_clip_keeps_null(spark):
    rows = spark.createDataFrame([(None,), (5.0,)], "v double")
    assert [r[0] for r in rows.select(scalars.clip("v", F.lit(0.0), F.lit(1.0))).collect()] == [None, 1.0]


def test_robust_z_with_mad_zero_is_zero_everywhere(spark):
    rows = spark.createDataFrame([("i", v) for v in (1.0, 1.0, 1.0, 1.0, 9.0, None)], "indicator string, value double")
    assert [r["value"] for r in stats.robust_z(rows).collect()] == [0.0] * 6


def test_ranks_break_ties_by_entity(spark):
    rows = spark.createDataFrame([("B", 1.0), ("A", 1.0), ("C", 2.0)], "entity string, score double")
    assert [r["entity"] for r in stats.ranked(rows, "score").orderBy("rank").collect()] == ["C", "A", "B"]


def test_pca_invariants(spark):
    x = np.random.RandomState(42).randn(10, 5)
    rows = spark.createDataFrame([(f"E{i}", f"ind{j + 1}", float(x[i, j])) for i in range(10) for j in range(5)], "entity string, indicator string, value double")
    comp = stats.principal_components(stats.correlation_matrix(rows)).toPandas()
    ev = comp.drop_duplicates("component").sort_values("component")["eigenvalue"].to_numpy()
    assert ev.sum() == pytest.approx(5, abs=1e-9)
    assert ev == pytest.approx([1.94835486, 1.41336146, 0.84072845, 0.55326215, 0.24429309], abs=1e-6)
    v = comp.pivot(index="indicator", columns="component", values="loading").to_numpy()
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-9)
    assert (v.sum(axis=0) > -1e-9).all()
    turned = stats.varimax(v[:, :3])
    assert np.allclose((turned**2).sum(), (v[:, :3] ** 2).sum())
    spread = lambda a: ((a**2).var(axis=0)).sum()
    tries = [np.linalg.qr(np.random.RandomState(k).randn(3, 3))[0] for k in range(300)]
    assert spread(turned) >= max(spread(v[:, :3] @ q) for q in tries) - 1e-9  # no rotation has a larger criterion
    turn = np.linalg.lstsq(v[:, :3], turned, rcond=None)[0]
    assert np.allclose(turn.T @ turn, np.eye(3), atol=1e-9)


def test_p_values():
    assert stats.correlation_p_value(0.5, 20) == pytest.approx(0.0247685, abs=1e-5)
    assert stats.correlation_p_value(0.0, 10) == pytest.approx(1.0)
    assert stats.correlation_p_value(1.0, 10) == 0.0


def test_imputation_keeps_observed_cells(spark):
    x = np.random.RandomState(1).randn(30, 4)
    x[:, 3] = x[:, 0] + 0.1 * x[:, 3]
    cells = [(f"E{i:02d}", f"i{j}", None if j == 3 and i % 3 == 0 else float(x[i, j])) for i in range(30) for j in range(4)]
    rows = spark.createDataFrame(cells, "entity string, indicator string, value double")
    done = impute.impute_chained(rows, 3, 3).toPandas()
    assert done["imputation_id"].nunique() == 3 and done["value"].notna().all() and len(done) == 360
    known = {(e, i): v for e, i, v in cells if v is not None}
    assert all(known.get((r.entity, r.indicator), r.value) == r.value for r in done.itertuples())
    pooled = impute.pool(impute.impute_chained(rows, 3, 3)).where("indicator = 'i3'").toPandas()
    hidden = pooled[pooled.entity.isin([f"E{i:02d}" for i in range(0, 30, 3)])].sort_values("entity")
    assert np.corrcoef(hidden["value"], x[::3, 3])[0, 1] > 0.8


def test_imputation_equals_whole_matrices(spark):
    """The same regressions and draws on each replicate's whole matrix, row by row sums against NumPy's."""
    rng, n, p = np.random.RandomState(4), 40, 5
    x = 50 + rng.randn(n, p) @ rng.randn(p, p)
    gone = rng.rand(n, p) < np.array([0.0, 0.1, 0.3, 0.2, 1.0])
    names = [f"E{i:02d}" for i in range(n)]
    rows = spark.createDataFrame([(names[i], f"i{j}", None if gone[i, j] else float(x[i, j])) for i in range(n) for j in range(p) if not (gone[i, j] and i % 2)], "entity string, indicator string, value double").repartition(3)
    got = {(r["imputation_id"], r["entity"], r["indicator"]): r["value"] for r in impute.impute_chained(rows, 3, 7, seed=5).collect()}
    code = np.array([r["c"] for r in spark.createDataFrame([(e,) for e in names], "e string").select(F.xxhash64("e").alias("c")).collect()])
    seen = ~gone
    start = np.array([x[seen[:, j], j].mean() if seen[:, j].any() else 0.0 for j in range(p)])
    for r in range(3):
        m = np.where(gone, start, x) - start
        for step in range(7):
            for j in np.argsort(gone.sum(axis=0), kind="stable"):
                if gone[:, j].any() and not gone[:, j].all():
                    one = np.hstack([np.ones((n, 1)), m])[seen[:, j]]
                    fit, hole, others = impute.Regression.fitted(one.T @ one, j), gone[:, j], np.arange(p) != j
                    a, y = (m[np.ix_(seen[:, j], others)] - fit.mean) / fit.spread, m[seen[:, j], j]
                    assert fit.weights == pytest.approx(np.linalg.solve(a.T @ a + np.linalg.inv(fit.covariance) - a.T @ a, np.linalg.inv(fit.covariance) @ fit.weights))
                    assert fit.centre == pytest.approx(y.mean()) and fit.noise < y.var() + 1e-9
                    m[hole, j] = fit.drawn(m[np.ix_(hole, others)], impute.normal_draws(code[hole], 5, r, step, int(j)))
        for i in range(n):
            for j in range(p):
                assert got[r, names[i], f"i{j}"] == pytest.approx(m[i, j] + start[j], abs=1e-6)
    draws = impute.normal_draws(np.arange(100_000), 1, 2)
    assert abs(draws.mean()) < 0.02 and abs(draws.std() - 1) < 0.02
    assert impute.impute_chained(rows.limit(0)).count() == 0


def test_group_quantiles(spark):
    """Every group at once, one that holds most rows and one value that most of its rows share; NULL groups and values."""
    rng = np.random.RandomState(2)
    groups = {"hot": [1.0] * 3000 + rng.randn(2000).tolist(), "two": [3.0, 4.0], "one": [7.0], None: [1.0, None, 2.0], "none": [None]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    wanted = {"lo": 0.01, "q": 0.25, "m": 0.5, "hi": 0.99, "top": 1.0, "low": 0.0}
    got = {r["g"]: r.asDict() for r in stats.group_quantiles(rows, ["g"], "v", wanted).collect()}
    assert set(got) == {"hot", "two", "one", None}
    for g, row in got.items():
        held = [v for v in groups[g] if v is not None]
        assert all(row[name] == pytest.approx(np.quantile(held, q), abs=1e-12) for name, q in wanted.items())
    assert stats.group_quantiles(rows.limit(0), ["g"], "v", wanted).count() == 0


def test_cleaning(spark):
    wide = spark.createDataFrame([(" usa", "1.5", "x")], "iso string, YR2010 string, YR2011 string")
    got = clean.wide_years_to_long(wide, "iso", "gdp", "S", "YR").orderBy("period").collect()
    assert [(r["entity"], r["period"], r["value"]) for r in got] == [("USA", 2010, 1.5), ("USA", 2011, None)]
    rows = spark.createDataFrame([(-66.0,), (2.0,)], "v double")
    assert [r[0] for r in clean.sentinels_to_null(rows, "v", [-66, -77, -88]).collect()] == [None, 2.0]
    d = spark.createDataFrame([("A", "A", 1.0), ("A", "X", 1.0), ("A", "B", 0.0), ("A", "B", 2.0)], "src string, dst string, value double")
    u = spark.createDataFrame([("A",), ("B",)], "entity string")
    assert [tuple(r) for r in clean.dyads_within(d, u).select("src", "dst", "value").collect()] == [("A", "B", 2.0)]
    names = spark.createDataFrame([("Grmany",), ("Atlantis",)], "name string")
    known = spark.createDataFrame([("DEU", "Germany"), ("FRA", "France")], "code string, name string")
    assert {r["name"]: r["code"] for r in clean.fuzzy_codes(names, known).collect()} == {"Grmany": "DEU", "Atlantis": None}
    assert [r[0] for r in spark.createDataFrame([("2015-Q4",), ("x",)], "q string").select(scalars.leading_year("q")).collect()] == [2015, None]


def test_numbers_over_ranges(spark):
    rng = np.random.RandomState(2)
    values = [None if k % 50 == 0 else float(v) for k, v in enumerate(rng.randint(0, 40, 500))]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double").repartition(5)
    got = stats.numbered(df, [F.desc_nulls_last("v"), F.col("id")]).collect()
    want = sorted(range(500), key=lambda k: (values[k] is None, -(values[k] or 0), k))
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 501))
    for q in (0.0, 0.37, 0.5, 1.0):
        assert stats.quantile(df, "v", q).first()[0] == pytest.approx(np.quantile([v for v in values if v is not None], q))
    assert stats.quantile(df.limit(0), "v", 0.5).first()[0] is None
    ranks = {r["id"]: r["r"] for r in stats.average_ranks(df.where("v is not null"), "v", "r").collect()}
    held = np.array([v for v in values if v is not None])
    assert all(ranks[k] == (held < v).sum() + ((held == v).sum() + 1) / 2 for k, v in enumerate(values) if v is not None)


def test_codes_and_columns(spark):
    rows = spark.createDataFrame([("7",), ("123",), ("4567",), (None,)], "c string")
    assert [r[0] for r in rows.select(scalars.zero_padded("c")).collect()] == ["007", "123", "4567", None]
    years = spark.createDataFrame([("2020-2022",), ("2019",), ("x",)], "y string")
    assert [r[0] for r in years.select(scalars.end_year("y")).collect()] == [2022, 2019, None]
    assert schema.resolve_column(["Country Code", "Year", "Country"], lambda n: n == "country", lambda n: "country" in n) == "Country"
    assert schema.resolve_column(["ISO", "Year"], lambda n: "country" in n, lambda n: n.startswith("iso")) == "ISO"
    with pytest.raises(KeyError):
        schema.resolve_column(["a"], lambda n: n == "b")
    df = spark.createDataFrame([(1, 2)], "REF_AREA int, Time int")
    assert schema.rename_aliases(df, {"entity": ["ref_area", "iso3"], "period": ["time"]}).columns == ["entity", "period"]
    with pytest.raises(ValueError):
        schema.rename_aliases(spark.createDataFrame([(1, 2)], "iso3 int, ref_area int"), {"entity": ["ref_area", "iso3"]})
    assert clean.lower_headers(df).columns == ["ref_area", "time"] and clean.missing_columns(df, ["Time", "z", "a"]) == ["a", "z"]


def test_sources_of_other_shapes(spark, tmp_path):
    for year in (2015, 2016):
        spark.createDataFrame([("usa", year / 10)], "iso string, score double").coalesce(1).write.mode("overwrite").csv(str(tmp_path / f"index-v2-{year}.csv"), header=True)
    files = clean.read_csv(spark, [str(tmp_path / f"index-v2-{y}.csv/*.csv") for y in (2015, 2016)])
    parts = files.select("*", "_metadata.file_path").collect()
    assert len(parts) == 2
    flat = tmp_path / "flat"
    flat.mkdir()
    for year in (2015, 2016):
        (flat / f"fsi_{year}_final.csv").write_text(f"iso,score\nusa,{year / 10}\n")
    (flat / "notes.csv").write_text("iso,score\nfra,1\n")
    got = {(r["iso"], r["period"]): r["score"] for r in clean.with_file_year(clean.read_csv(spark, str(flat))).collect()}
    assert got == {("usa", 2015): "201.5", ("usa", 2016): "201.6", ("fra", None): "1"}
    wide = spark.createDataFrame([("usa", "1", "2")], "iso string, YR2010 string, YR2011 string")
    long = spark.createDataFrame([("usa", "2010", "1"), ("usa", "2011", "2")], "iso string, year string, share string")
    one, two = (sorted(map(tuple, clean.two_layouts_to_long(df, "iso", "mil", "S", "YR", "year", "share").collect())) for df in (wide, long))
    assert one == two == [("USA", 2010, "mil", 1.0, "S"), ("USA", 2011, "mil", 2.0, "S")]
    codes = spark.createDataFrame([("5A",), ("US",), ("EURO",), ("X",), (None,)], "c string")
    assert [r[0] for r in clean.plausible_codes(codes, "c").collect()] == ["US"]
    names = spark.createDataFrame([("Xermany",), ("Germayn",), ("ermany",), ("Francexyz",)], "name string")
    known = spark.createDataFrame([("DEU", "Germany"), ("FRA", "France")], "code string, name string")
    assert {r["name"]: (r["code"], r["edits"]) for r in clean.fuzzy_codes(names, known).collect()} == {
        "Xermany": ("DEU", 1), "Germayn": ("DEU", 2), "ermany": ("DEU", 1), "Francexyz": (None, None)}


def test_clean_zone_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("A", 2000, "i", 1.0, "x"), ("B", 2001, "i", float("nan"), "y")], FACT)
    zone = str(tmp_path / "zone")
    sinks.write_table(rows, zone + "/panel.parquet")
    sinks.write_table(rows, zone + "/indicator_matrix.parquet")
    got = clean.read_clean_zone(spark, zone + "/*.parquet")
    assert sorted((r["entity"], r["value"]) for r in got.collect()) == [("A", 1.0), ("B", None)]
    sinks.write_table(rows, str(tmp_path / "by_source"), partition_by="source")
    assert sorted(p.name for p in (tmp_path / "by_source").glob("source=*")) == ["source=x", "source=y"]
    assert spark.read.parquet(str(tmp_path / "by_source")).where("source = 'y'").count() == 1
    sinks.write_report(rows, str(tmp_path / "report"))
    assert clean.read_csv(spark, str(tmp_path / "report")).count() == 2
    sinks.write_outputs({"a": rows, "b": rows.limit(1)}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/a")).count() == 2 and spark.read.parquet(str(tmp_path / "out/b")).count() == 1


def test_p_values_by_column(spark):
    r = stats.with_p_values(spark.createDataFrame([(0.5, 0.0, 20)], "pearson double, spearman double, n long")).first()
    assert r["p_pearson"] == pytest.approx(0.0247685, abs=1e-5) and r["p_spearman"] == pytest.approx(1.0)


def test_layers(spark):
    a = spark.createDataFrame([("A", 1)], "entity string, rank int")
    assert tuple(panel.layer({"rank": a}, "rank").first()) == ("A", 1.0)
    with pytest.raises(KeyError):
        panel.layer({"rank": a}, "score")


def test_bootstrap_matches_resampled_matrices(spark):
    rng = np.random.RandomState(12)
    x = rng.randn(14, 4)
    x[:, 1] += x[:, 0]
    names = [f"E{i:02d}" for i in range(14)]
    rows = spark.createDataFrame([(names[i], f"i{j}", float(x[i, j])) for i in range(14) for j in range(4)], "entity string, indicator string, value double")
    comp = stats.principal_components(stats.correlation_matrix(rows)).checkpoint()
    ref = comp.where("kept").toPandas().pivot(index="indicator", columns="component", values="loading").to_numpy()
    drawn = stats.drawn_entities(rows.select("entity"), 30).toPandas()
    assert (drawn.groupby("replicate")["times"].sum() == 14).all() and drawn["replicate"].nunique() == 30
    scores = []
    for _, d in drawn.groupby("replicate"):
        c = np.corrcoef(np.repeat(x[[names.index(e) for e in d["entity"]]], d["times"], axis=0), rowvar=False)
        values, vectors = np.linalg.eigh(c)
        values, vectors = values[::-1][: ref.shape[1]], vectors[:, ::-1][:, : ref.shape[1]]
        u, _, w = np.linalg.svd(vectors.T @ ref)
        scores.append(x @ (vectors @ (u @ w)) @ (values / values.sum()))
    got = stats.bootstrap_composites(rows, comp, 30).toPandas().sort_values("entity")
    assert got["low"].to_numpy() == pytest.approx(np.quantile(scores, 0.05, axis=0), abs=1e-9)
    assert got["high"].to_numpy() == pytest.approx(np.quantile(scores, 0.95, axis=0), abs=1e-9)
