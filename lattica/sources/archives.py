"""ZIP archives of wide CSV tables as a Spark data source, and as a sink.

``spark.read.format("table_archive")`` lists the archives' directories, makes one input partition per member and
streams a member's rows from its compressed form, so that a task holds a batch of rows whatever a member's size.  A
table is wide: an entity column, found by its name, and a column per period, named by its year.
"""

from __future__ import annotations

import csv
import io
import math
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

from lattica.schema import resolve_column
from lattica.sources.storage import PLACEHOLDER_BYTES, files, opened

FORMAT = "table_archive"
#: Rows of a batch that a reading task yields, and entities of an archive that a writing task makes.
BATCH_ROWS, ARCHIVE_ENTITIES = 10_000, 50_000
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("entity", pa.string()), ("period", pa.int32()), ("value", pa.float64())])


@dataclass(frozen=True)
class Bounds:
    """What the pushed filters leave: periods within [first, last] and among ``only``, and names of members and archives."""

    first: float = -math.inf
    last: float = math.inf
    only: frozenset | None = None
    names: dict[str, frozenset] = field(default_factory=dict)

    def with_filter(self, f: ds.Filter) -> Bounds | None:
        """These bounds and the filter's, or None for a filter that the source can't apply by itself."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column not in ("period", "member", "archive", "entity"):
            return None
        if isinstance(f, ds.IsNotNull):
            return self  # rows that lack one of these are never made
        wanted = frozenset([f.value]) if isinstance(f, ds.EqualTo) else frozenset(f.value) if isinstance(f, ds.In) else None
        if column == "period":
            if isinstance(f, ds.GreaterThanOrEqual | ds.GreaterThan):
                least = f.value + isinstance(f, ds.GreaterThan)
                return Bounds(max(self.first, least), self.last, self.only, self.names)
            if isinstance(f, ds.LessThanOrEqual | ds.LessThan):
                most = f.value - isinstance(f, ds.LessThan)
                return Bounds(self.first, min(self.last, most), self.only, self.names)
            return None if wanted is None else Bounds(self.first, self.last, wanted if self.only is None else self.only & wanted, self.names)
        if wanted is None or column == "entity":
            return None
        return Bounds(self.first, self.last, self.only, self.names | {column: self.names.get(column, wanted) & wanted})

    def has_period(self, period: int) -> bool:
        return self.first <= period <= self.last and (self.only is None or period in self.only)

    def has_name(self, column: str, name: str) -> bool:
        return column not in self.names or name in self.names[column]


@dataclass
class Member(ds.InputPartition):
    archive: str
    member: str

    def __init__(self, archive: str, member: str):
        self.archive, self.member = archive, member


def entity_column(names: Sequence[str]) -> str:
    """The column of entity codes: the first whose name holds "iso" or "code"."""
    return resolve_column(names, lambda c: "iso" in c or "code" in c)


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix, self.strict = options["path"], options.get("suffix", ".zip"), options.get("strict", "true").lower() == "true"
        self.bounds = Bounds()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            narrower = self.bounds.with_filter(f)
            if narrower is None:
                yield f
            else:
                self.bounds = narrower

    def partitions(self) -> list[ds.InputPartition]:
        store, _ = opened(self.path)
        found: list[ds.InputPartition] = []
        for f in files(self.path, self.suffix):
            if f.size <= PLACEHOLDER_BYTES or not self.bounds.has_name("archive", f.base_name):
                continue
            try:
                with store.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                    found += [Member(f.path, m) for m in sorted(z.namelist()) if m.lower().endswith(".csv") and self.bounds.has_name("member", m)]
            except zipfile.BadZipFile:
                if self.strict:
                    raise
        return found or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, _ = opened(self.path)
        with store.open_input_file(partition.archive) as raw, zipfile.ZipFile(raw) as z, z.open(partition.member) as m:
            yield from self.table(partition, csv.reader(io.TextIOWrapper(m, "utf-8-sig", errors="replace", newline="")))

    def table(self, partition: Member, lines: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
        """Batches of one table's rows; a table without an entity column or without years has none."""
        header = [c.strip() for c in next(lines, [])]
        years = [(k, int(c)) for k, c in enumerate(header) if c.isascii() and c.isdigit() and len(c) <= 6 and self.bounds.has_period(int(c))]
        try:
            at = header.index(entity_column(header))
        except KeyError:
            return
        if not years:
            return
        archive, rows = partition.archive.rsplit("/", 1)[-1], []
        for line in lines:
            entity = line[at].strip().upper() if at < len(line) else ""
            for k, year in years if entity else ():
                try:
                    value = float(line[k]) if k < len(line) else math.nan
                except ValueError:
                    continue
                if not math.isnan(value):
                    rows.append((archive, partition.member, entity, year, value))
            if len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class TableArchive(ds.DataSource):
    """Options: path (a folder or its URI), suffix (.zip), strict (false: archives that can't be opened have no rows)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "archive string, member string, entity string, period int, value double"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(archive, member, entity, period, value) of all archives under ``path``.

    Bounds on periods, and equality on members and archives, are applied by the source: years that are not asked for
    are not parsed, and members that are not asked for are not opened.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TableArchive)
    return spark.read.format(FORMAT).option("strict", str(strict)).load(path)


def archived_facts(spark: SparkSession, path: str, members: dict[str, str], source: str, strict: bool = True) -> DataFrame:
    """Fact rows of the members named (member: indicator); a member that an archive lacks has no rows there."""
    names = F.create_map(*[F.lit(x) for kv in members.items() for x in kv])
    rows = read_archives(spark, path, strict).where(F.col("member").isin(*members))
    return rows.select("entity", "period", names[F.col("member")].alias("indicator"), "value", F.lit(source).alias("source"))


def _writer(folder: str, entity: str, members: dict[str, dict[str, str]], entities: int):
    def text(table: pa.Table, columns: dict[str, str]) -> bytes:
        out = io.StringIO()
        lines = csv.writer(out, lineterminator="\n")
        lines.writerow(["Code", *columns])
        lines.writerows(zip(*(table.column(c).to_pylist() for c in (entity, *columns.values())), strict=True))
        return out.getvalue().encode()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        held: list[pa.RecordBatch] = []

        def archive() -> pa.RecordBatch:
            table, name = pa.Table.from_batches(held), f"part-{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{root}/.{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for member, columns in members.items():
                    z.writestr(member, text(table, columns))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(table)], pa.int64())], names=["archive", "entities"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= entities:
                yield archive()
                held = []
        if held:
            yield archive()
    return write


def write_archives(wide: DataFrame, folder: str, entity: str, members: dict[str, dict[str, str]], entities: int = ARCHIVE_ENTITIES) -> DataFrame:
    """Write a wide table as archives of CSV tables: (archive, entities) of the files that count.

    ``members`` says which columns a member holds (header: column).  A task writes archives of about ``entities`` rows
    under hidden names; those that tasks have reported are named afterwards, so that a task that is run twice leaves no
    second copy.
    """
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    columns = list(dict.fromkeys([entity, *(c for m in members.values() for c in m.values())]))
    done = wide.select(*columns).mapInArrow(_writer(folder, entity, members, entities), "archive string, entities long").collect()  # a row per file
    for r in done:
        store.move(f"{root}/.{r['archive']}", f"{root}/{r['archive']}")
    return wide.sparkSession.createDataFrame(done, "archive string, entities long")
