"""Source tables with an atomic switch, sketches merged over sources, and artefacts that may be absent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import sketches
from lattica.plans.artefacts import ARTEFACTS, PAGES, Artefacts, save
from lattica.sources.versions import SourceTable

FACT = "entity string, period int, indicator string, value double, source string"


def facts(spark, source, values):
    return spark.createDataFrame([(f"E{i}", 2000, "i", float(v), source) for i, v in enumerate(values)], FACT)


def state(table, **how):
    out = {}
    for r in table.read(**how).collect():
        out.setdefault(r["source"], []).append(r["value"])
    return {s: sorted(v) for s, v in out.items()}


def test_one_source_is_replaced(spark, tmp_path):
    t = SourceTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError, match="not been written"):
        t.read()
    assert t.versions() == [] and t.vacuum() == 0
    t.replace(facts(spark, "A/1 x=y", [1, 2]).union(facts(spark, "B", [3])))
    assert t.replace(facts(spark, "B", [4, 5])) == 2 == t.replace(facts(spark, "B", [4, 5])) - 1
    assert state(t) == {"A/1 x=y": [1, 2], "B": [4, 5]} and state(t, version=1) == {"A/1 x=y": [1, 2], "B": [3]}
    assert state(t, sources=["B"]) == {"B": [4, 5]} and len(t.read(sources=["B"]).inputFiles()) < len(t.read().inputFiles())
    t.replace(facts(spark, "B", []), ["B", "C"])
    assert state(t) == {"A/1 x=y": [1, 2]}
    assert t.vacuum() == 4 and t.versions() == [4]  # three times B, and the write without rows
    assert t.vacuum() == 0 and state(t) == {"A/1 x=y": [1, 2]}


def test_a_failed_write_changes_nothing(spark, tmp_path):
    t = SourceTable(spark, str(tmp_path / "t"))
    t.replace(facts(spark, "A", [1]).union(facts(spark, "B", [2])))
    broken = facts(spark, "B", [7, 8]).withColumn("value", F.when(F.col("value") > 7, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        t.replace(broken)
    with pytest.raises(ValueError, match="columns"):
        t.replace(facts(spark, "B", [9]).withColumn("value", F.lit("text")))
    with pytest.raises(ValueError, match="among"):
        t.replace(facts(spark, "A", [9]).union(facts(spark, "B", [9])), ["B"])
    assert state(t) == {"A": [1], "B": [2]} and t.versions() == [1]
    t.replace(facts(spark, "B", [3]))
    assert state(t) == {"A": [1], "B": [3]}


def test_a_writer_that_comes_second_keeps_the_first_ones_rows(spark, tmp_path, monkeypatch):
    t, other = (SourceTable(spark, str(tmp_path / "t")) for _ in range(2))
    t.replace(facts(spark, "A", [1]))
    plain, met = t.versions, []

    def late():
        if not met:  # the other writer commits between this one's look and its commit
            met.append(known := plain())
            other.replace(facts(spark, "B", [2]))
            return known
        return plain()

    rows = facts(spark, "C", [3])
    t._check(rows.schema, t.manifest())
    monkeypatch.setattr(t, "versions", late)
    folder = "data/direct"
    rows.write.parquet(f"{tmp_path}/t/{folder}")
    assert t._commit({"C": folder}, rows.schema) == 3
    assert state(t) == {"A": [1], "B": [2], "C": [3]}


def test_sketches_merge_to_the_whole(spark):
    rng = np.random.default_rng(5)
    parts = {"a": rng.normal(size=6000), "b": rng.normal(3, 2, size=4000).round(1), "c": np.full(500, 2.0)}
    rows = spark.createDataFrame([("i", float(v), s) for s, vs in parts.items() for v in vs] + [("i", None, "a"), ("i", float("nan"), "b"), ("k", 1.0, "a"), ("k", 1.0, "b"), ("k", None, "b"), ("n", None, "a")],
                                 "indicator string, value double, source string")
    stored = sketches.quality_sketches(rows.where("source <> 'c'")).union(sketches.quality_sketches(rows.where("source = 'c'")))
    got = {r["indicator"]: r for r in sketches.report(stored).collect()}
    whole = np.concatenate(list(parts.values()))
    r = got["i"]
    assert (r["n_rows"], r["n_missing"], r["least"], r["most"]) == (len(whole) + 2, 2, whole.min(), whole.max())
    assert r["distinct_estimate"] == pytest.approx(len(np.unique(whole)), rel=sketches.DISTINCT_ERROR)
    for q, v in zip((0.01, 0.5, 0.99), r["quantile_estimates"], strict=True):
        assert (whole < v).mean() - sketches.RANK_ERROR <= q <= (whole <= v).mean() + sketches.RANK_ERROR
    assert got["k"]["constant"] and not got["k"]["all_missing"] and got["k"]["distinct_estimate"] == 1
    assert got["n"]["all_missing"] and not got["n"]["constant"] and got["n"]["distinct_estimate"] == 0 and got["n"]["quantile_estimates"] is None
    by_source = {(r["source"], r["indicator"]): r["n_rows"] for r in sketches.report(stored, ("source", "indicator")).collect()}
    assert by_source["c", "i"] == 500 and by_source["a", "i"] == 6001


def test_absent_artefacts_are_empty(spark, tmp_path):
    some = spark.createDataFrame([("A", "B", 0.5), ("A", "C", 0.25), ("B", "A", 1.0)], "src string, dst string, w double")
    steady = spark.createDataFrame([("A", 1), ("B", 2)], "ENTITY string, steady_state int")  # other case, other type, no further column
    save({"coupling": some, "steady_state": steady}, str(tmp_path))
    held = Artefacts(spark, str(tmp_path))
    assert held.present == {"coupling", "steady_state"} and set(held.tables) == set(ARTEFACTS)
    for name in PAGES:
        rows = held.page(name, {"n": 5, "least": 0.1, "entity": "A", "layer": "score"})
        assert rows.count() == {"top_entities": 2, "transmitters": 3, "exposed": 2, "neighbours": 2, "map_layer": 2}.get(name, 0), name
    assert [tuple(r)[:2] for r in held.page("top_entities", {"n": 1}).collect()] == [("B", 2.0)]
    assert [(r["entity"], r["w"]) for r in held.page("neighbours", {"entity": "A", "least": 0.3, "n": 5}).collect()] == [("B", 0.5)]
    none = Artefacts(spark, str(tmp_path / "nowhere"))
    assert none.present == set() and all(none.page(name, {"n": 5, "least": 0.0}).count() == 0 for name in PAGES)
    with pytest.raises(KeyError):
        save({"unheard": some}, str(tmp_path))
