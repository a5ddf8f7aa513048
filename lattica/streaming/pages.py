"""Pages of a paged interface as a stream with replayable offsets.

A fetcher lands each answer as a JSON file (``{"data": [records]}``) whose name sorts after those before it; the
offset is the name of the last page read, so a restarted query goes on where its checkpoint says, and a batch that is
run again reads the same pages.  Some interfaces ignore the offset that they are asked for and serve the same page
again: a page with the record ids of the page before it in its folder has no rows.  Pages that come back later are
taken out by id within a watermark.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from lattica.sources.storage import files, opened

FORMAT = "event_pages"


class Page(ds.InputPartition):
    """A page, and the one before it in its folder (empty for a folder's first page)."""

    def __init__(self, path: str, before: str):
        self.path, self.before = path, before


class PageReader:
    """What batch and streaming readers share; options: path, id (the records' id, default event_id)."""

    def __init__(self, schema, options):
        self.path, self.id = options["path"], options.get("id", "event_id")
        self.columns = [f.name for f in schema.fields]

    def pages(self, after: str = "", last: str | None = None) -> list[ds.InputPartition]:
        """Pages whose paths are after ``after``, up to ``last``."""
        out, before = [], ""
        for f in files(self.path, ".json"):
            follows = before.rpartition("/")[0] == f.path.rpartition("/")[0]
            if f.path > after and (last is None or f.path <= last):
                out.append(Page(f.path, before if follows else ""))
            before = f.path
        return out

    def records(self, path: str) -> list[dict]:
        store, _ = opened(self.path)
        with store.open_input_stream(path, compression=None) as f:
            held = json.loads(f.read() or b"{}")
        return [r for r in held.get("data") or [] if isinstance(r, dict)] if isinstance(held, dict) else []

    def rows(self, page: Page) -> Iterator[tuple]:
        records = self.records(page.path)
        ids = {r.get(self.id) for r in records} - {None}
        if page.before and ids and ids == {r.get(self.id) for r in self.records(page.before)} - {None}:
            return
        name = page.path.rsplit("/", 1)[-1]
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        for r in records:
            yield tuple(name if c == "page" else text(r.get(c)) for c in self.columns)


class PageBatchReader(PageReader, ds.DataSourceReader):
    def partitions(self) -> list[ds.InputPartition]:
        return self.pages() or [Page("", "")]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.rows(partition) if partition.path else iter(())


class PageStreamReader(PageReader, ds.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        paths = [f.path for f in files(self.path, ".json")]
        return {"after": max(paths, default="")}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        return self.pages(start["after"], end["after"])

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.rows(partition)


class EventPages(ds.DataSource):
    """Give the records' columns as the schema, all of them strings; a column ``page`` is the page's file name."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "page string, event_id string"

    def reader(self, schema) -> PageBatchReader:
        return PageBatchReader(schema, self.options)

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(schema, self.options)


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All pages as a batch; a page that repeats the one before it has no rows."""
    spark.dataSource.register(EventPages)
    return spark.read.format(FORMAT).schema(schema).load(path)


def page_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    spark.dataSource.register(EventPages)
    return spark.readStream.format(FORMAT).schema(schema).option("path", path).load()


def events_once(records: DataFrame, id: str = "event_id", time: str = "event_date", late: str = "30 days") -> DataFrame:
    """Records with a time, each id once; works on streams (ids are remembered within the watermark) and on tables."""
    rows = records.withColumn("ts", F.col(time).try_cast("timestamp")).where(F.col("ts").isNotNull())
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([id]) if records.isStreaming else rows.dropDuplicates([id])


def land(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append what is there now to a Parquet table, and stop; called again, it goes on where it stopped."""
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_pages(events: DataFrame, folder: str, order: str, size: int = 500, chunk: str = "chunk", again: int = 0) -> int:
    """Write rows as pages of ``size`` records, ``order`` by order; returns the number of pages.

    A task writes the pages of its range into a folder of its own.  ``again`` > 0 writes every ``again``-th page a
    second time right after itself, as an interface that ignores offsets serves it (for fixtures).
    """
    store, root = opened(folder)
    names, run = events.columns, uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, held, count = f"{chunk}-{TaskContext.get().partitionId():06d}", [], 0
        store, root = opened(folder)
        store.create_dir(f"{root}/{place}", recursive=True)

        def page(records: list[dict]) -> None:
            nonlocal count
            for _ in range(2 if again and count % again == again - 1 else 1):
                hidden = f"{root}/{place}/.{run}-{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as f:
                    f.write(json.dumps({"count": len(records), "data": records}).encode())
                store.move(hidden, f"{root}/{place}/page-{count:08d}.json")  # a task that is run again writes the same pages
                count += 1

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= size:
                page(held[:size])
                held = held[size:]
        if held:
            page(held)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["pages"])

    store.create_dir(root, recursive=True)
    text = events.select(*[F.col(c).cast("string").alias(c) for c in names], F.col(order).alias("__order"))
    done = text.repartitionByRange("__order").sortWithinPartitions("__order", *names).drop("__order").mapInArrow(write, "pages long")
    return done.agg(F.sum("pages")).first()[0] or 0
