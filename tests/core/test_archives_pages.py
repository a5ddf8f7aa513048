"""Archives and pages as data sources, and which snapshot counts."""

import collections
import json
import os
import zipfile

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from lattica.sources import archives, storage
from lattica.streaming import pages

TABLE = "Name,ISO3,2009,2010,2011,note\nUtopia, uto ,1,2.5,..,x\nLand,LND,,nan,-3e1,y\nShort,SHO,7\n,,1,2,3\n"


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("resources/gain.csv", "﻿" + TABLE)
        z.writestr("resources/ready.csv", "Code,2010\nuto,5\n" + "".join(f"e{k},{k}\n" for k in range(25_000)))
        z.writestr("resources/none.csv", "Name,2010\nUtopia,4\n")
        z.writestr("resources/empty.csv", "")
        z.writestr("readme.txt", "not a table")
    os.makedirs(tmp_path / "deep")
    with zipfile.ZipFile(tmp_path / "deep" / "b.zip", "w") as z:
        z.writestr("resources/gain.csv", "country_code,x2010,2011\nabc,1,9\n" + " " * 100)
    (tmp_path / "placeholder.zip").touch()
    (tmp_path / ".hidden.zip").write_bytes(b"x" * 500)
    return str(tmp_path)


def test_rows_of_archives(spark, folder):
    got = archives.read_archives(spark, folder)
    rows = collections.Counter((r["archive"], r["member"].rsplit("/")[-1], r["entity"], r["period"], r["value"]) for r in got.where("entity not like 'E%'").collect())
    assert rows == collections.Counter([("a.zip", "gain.csv", "UTO", 2009, 1.0), ("a.zip", "gain.csv", "UTO", 2010, 2.5), ("a.zip", "gain.csv", "LND", 2011, -30.0), ("a.zip", "gain.csv", "SHO", 2009, 7.0),
                                        ("a.zip", "ready.csv", "UTO", 2010, 5.0), ("b.zip", "gain.csv", "ABC", 2011, 9.0)])
    assert got.where("entity like 'E%'").count() == 25_000
    assert got.rdd.getNumPartitions() == 5  # a partition for each member


def test_filters_go_to_the_source(spark, folder):
    wanted = archives.read_archives(spark, folder).where("period >= 2010 and period < 2012 and member = 'resources/gain.csv' and value > 0")
    assert wanted.rdd.getNumPartitions() == 2
    assert {(r["entity"], r["period"]) for r in wanted.collect()} == {("UTO", 2010), ("ABC", 2011)}
    reader = archives.ArchiveReader({"path": folder})
    left = list(reader.pushFilters([ds.In(("period",), (2009, 2011)), ds.LessThan(("period",), 2011), ds.EqualTo(("archive",), "a.zip"), ds.IsNotNull(("period",)), ds.GreaterThan(("value",), 0.0), ds.EqualTo(("entity",), "UTO")]))
    assert [type(f) for f in left] == [ds.GreaterThan, ds.EqualTo]
    assert [p for p in range(2005, 2015) if reader.bounds.has_period(p)] == [2009]
    assert len(reader.partitions()) == 4


def test_facts_of_members(spark, folder):
    facts = archives.archived_facts(spark, folder, {"resources/gain.csv": "gain", "resources/missing.csv": "nothing"}, "SRC")
    assert facts.columns == ["entity", "period", "indicator", "value", "source"]
    assert {(r["entity"], r["indicator"], r["source"]) for r in facts.collect()} == {(e, "gain", "SRC") for e in ("UTO", "LND", "SHO", "ABC")}


def test_broken_and_absent_archives(spark, tmp_path):
    assert archives.read_archives(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "bad.zip").write_bytes(b"PK" + b"x" * 1000)
    with pytest.raises(Exception, match="zip"):
        archives.read_archives(spark, str(tmp_path)).count()
    assert archives.read_archives(spark, str(tmp_path), strict=False).count() == 0


def test_archives_are_read_as_written(spark, tmp_path):
    rows = [(f'q"{k},x', float(k), None if k % 3 else k / 7, k) for k in range(50)]
    df = spark.createDataFrame(rows, "code string, a2001 double, b2002 double, other int").repartition(3)
    out = f"file://{tmp_path}/out"
    done = archives.write_archives(df, out, "code", {"m.csv": {"2001": "a2001", "2002": "b2002"}, "n.csv": {"2002": "b2002"}}, entities=10)
    assert done.agg(F.sum("entities")).first()[0] == 50 and done.count() == len(list(storage.files(out, ".zip")))
    got = collections.Counter((r["member"], r["entity"], r["period"], r["value"]) for r in archives.read_archives(spark, out).collect())
    want = [("m.csv", c.upper(), 2001, a) for c, a, _, _ in rows] + [(m, c.upper(), 2002, b) for c, _, b, _ in rows if b is not None for m in ("m.csv", "n.csv")]
    assert got == collections.Counter(want)


def test_newest_snapshot(tmp_path):
    for name, size in (("2024-01-01", 500), ("2024-03-01", 500), ("2024-05-01", 100), ("2024-06-01", None), ("latest", 500)):
        (tmp_path / name).mkdir()
        if size is not None:
            (tmp_path / name / "f.csv").write_bytes(b"x" * size)
    assert storage.newest_snapshot(str(tmp_path)) == f"{tmp_path}/2024-03-01"
    assert storage.newest_snapshot(f"file://{tmp_path}/") == f"file://{tmp_path}/2024-03-01"
    assert storage.newest_snapshot(str(tmp_path / "latest")) is None and storage.newest_snapshot(str(tmp_path / "absent")) is None


SCHEMA = "page string, event_id string, event_date string, n string"


def put(folder, name, ids, **more):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        json.dump({"data": [{"event_id": i, "event_date": f"2024-01-{(k % 28) + 1:02d}", "n": k} for k, i in enumerate(ids)], **more}, f)


def test_stream_of_pages_with_a_restart(spark, tmp_path):
    """A page served twice, a page whose rows come back later, an empty and a broken answer, and a restart in the middle."""
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: pages.land(pages.events_once(pages.page_stream(spark, folder, SCHEMA)), out, state)
    put(folder, "y1/page-0.json", ["a", "b", "c"])
    put(folder, "y1/page-1.json", ["d", "e", "f"])
    put(folder, "y1/page-2.json", ["f", "e", "d"])  # the offset was ignored
    run()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list("abcdef")
    run()  # nothing new
    put(folder, "y2/page-0.json", ["d", "e", "f"])  # again, but in another folder: not the page before; ids are known
    put(folder, "y2/page-1.json", ["g", None, "h"])
    put(folder, "y2/page-2.json", [])
    with open(f"{folder}/y2/page-3.json", "w") as f:
        f.write('{"error": "access denied"}')
    run()
    got = collections.Counter(r["event_id"] for r in spark.read.parquet(out).collect())
    assert got == collections.Counter([*"abcdefgh", None])
    batch = pages.events_once(pages.read_pages(spark, folder, SCHEMA))
    assert collections.Counter(r["event_id"] for r in batch.collect()) == got
    assert pages.read_pages(spark, str(tmp_path / "nowhere"), SCHEMA).count() == 0


def test_offsets_can_be_replayed(tmp_path):
    from pyspark.sql.types import StructType, StructField, StringType

    schema = StructType([StructField("event_id", StringType())])
    put(tmp_path, "p-1.json", ["a"])
    put(tmp_path, "p-2.json", ["b"])
    reader = pages.PageStreamReader(schema, {"path": str(tmp_path)})
    end = reader.latestOffset()
    put(tmp_path, "p-3.json", ["b"])
    read = lambda a, b: [r for p in pages.PageStreamReader(schema, {"path": str(tmp_path)}).partitions(a, b) for r in reader.read(p)]
    assert read(reader.initialOffset(), end) == [("a",), ("b",)] == read(reader.initialOffset(), end)
    assert read(end, reader.latestOffset()) == [] and read(end, end) == []


def test_pages_are_read_as_written(spark, tmp_path):
    df = spark.createDataFrame([(k, f"2024-01-01 00:00:{k % 60:02d}", "x" if k % 2 else None) for k in range(230)], "event_id long, event_date string, n string").repartition(4)
    assert pages.write_pages(df, str(tmp_path / "p"), "event_id", size=20, again=2) >= 12
    got = pages.read_pages(spark, str(tmp_path / "p"), SCHEMA)
    assert collections.Counter(int(r["event_id"]) for r in got.collect()) == collections.Counter(range(230))
    assert got.where("n is null").count() == 115
