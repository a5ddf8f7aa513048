"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Rows per Arrow batch at most: whole texts travel in these, so that long ones stay within a worker's memory.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a table of keys that is broadcast, at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on: a smaller Arrow batch is kept, a larger one is cut to ``BATCH_ROWS`` rows.

    The setting stays in the session, since Spark reads it when an action runs.  A checkpoint folder is set only
    where there is none.
    """
    if not 0 < int(spark.conf.get(_BATCH, "10000")) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    shared_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one where all tasks run on this machine."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``kept`` has written; only for those that no later result reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("table-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A kept table of keys, broadcast if it has at most ``rows`` rows."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def shared_uri(spark: SparkSession) -> str:
    """The shared folder as a URI that pyarrow can open."""
    base = shared_folder(spark)
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


#: Where a row stands in a written table: its file and its place there.
_FILE, _PLACE = "__file", "__place"


def _attach(folder: str, added: pa.Schema):
    """Add to batches of rows with a file and a place the columns that ``folder`` holds for them; one file's at a time."""
    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        at, places, held = None, None, None
        for batch in batches:
            files = batch.column(_FILE)
            cuts = np.flatnonzero(np.r_[True, pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False), True]) if len(files) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if files[i].as_py() != at:
                    at, path = files[i].as_py(), f"{root}/__name={files[i].as_py()}"
                    known = store.get_file_info(path).type == fs.FileType.Directory
                    held = pq.read_table(path, filesystem=store, partitioning=None).sort_by(_PLACE) if known else pa.schema([(_PLACE, pa.int64()), *added]).empty_table()
                    places = held.column(_PLACE).to_numpy()
                part = batch.slice(i, j - i)
                own = part.column(_PLACE).to_numpy()
                k = np.searchsorted(places, own)
                hit = k < len(places)
                hit[hit] = places[k[hit]] == own[hit]
                row = pa.array(k, mask=~hit)
                rest = part.drop_columns([_FILE, _PLACE])
                more = [held.column(f.name).take(row).combine_chunks().cast(f.type) for f in added]
                yield pa.RecordBatch.from_arrays([*rest.columns, *more], names=[*rest.schema.names, *added.names])
    return attach


def looked_up(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``keys`` (a kept table, one row a key; null where it has none), whatever the rows' width.

    Beyond ``BROADCAST_ROWS`` keys, rows are written as they stand, without an exchange, and only (key, file, place) is joined;
    what belongs to a file's rows is one small file that the task of these rows reads.  A null key finds nothing.
    """
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), key, "left").select(*rows.columns, *[c for c in keys.columns if c != key])
    spark, held = rows.sparkSession, kept(rows)
    where = [F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_PLACE)]
    found = held.select(key, *where).join(keys, key).drop(key).withColumnRenamed(_FILE, "__name")
    folder = f"{shared_uri(spark)}/places-{uuid.uuid4().hex}"
    found.repartition("__name").write.partitionBy("__name").parquet(folder)
    added = [f for f in keys.schema.fields if f.name != key]
    out = StructType([*held.schema.fields, *(StructField(f.name, f.dataType, True) for f in added)])
    return held.select("*", *where).mapInArrow(_attach(folder, to_arrow_schema(StructType(added))), out)


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is not in ``keys`` (a kept table of keys, each once); a null key stays.  Rows are not exchanged."""
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), key, "left_anti").select(*rows.columns)
    marked = kept(keys.select(key, F.lit(True).alias("__found")))
    return looked_up(rows, marked, key).where("__found is null").drop("__found")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_column).cast("string") if isinstance(id_column, str) else id_column.cast("string")) % folds


def hashed_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """At most ``rows`` rows, the first by a hash of ``columns``; the driver sees about twice as many at most.

    Rows outside a share of the hash's range are dropped in the tasks, so that not every task sends ``rows`` rows.
    """
    code = F.xxhash64(*columns)
    share = max(1, df.count() // (2 * rows))
    return df.where(F.pmod(code, F.lit(share)) == 0).orderBy(code, *columns).limit(rows)


def block_count(docs: DataFrame, text: str, target_bytes: int) -> int:
    """How many blocks of about ``target_bytes`` the texts fill (one pass over that column)."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / target_bytes))


#: Copies of one row that a block takes from one deal.
SAME_ROWS = 256


def in_blocks(docs: DataFrame, id_column: str, text: str, blocks: int) -> DataFrame:
    """(block, id, text): a row's block follows from its id and text, so copies of a text are spread.

    Rows that are repeated as they are over ``SAME_ROWS`` times are dealt to as many more blocks, by their place in
    the table; a table that gives its rows in another order when it is read again should be written first.
    """
    code = F.xxhash64(F.col(id_column), F.col(text))
    rows = docs.select(code.alias("_code"), F.col(id_column).alias("id"), F.col(text).alias("text"))
    counts = docs.groupBy(code.alias("_code")).agg(F.count(F.lit(1)).alias("_n"))
    hot = kept(counts.where(F.col("_n") > SAME_ROWS).select("_code", F.ceil(F.col("_n") / SAME_ROWS).alias("_spread")))
    deal = F.lit(0).cast("long")
    if hot.limit(1).count():
        rows = rows.withColumn("_m", F.monotonically_increasing_id()).join(small(hot), "_code", "left")
        deal = F.coalesce(F.pmod(F.xxhash64("_m"), F.col("_spread")), F.lit(0))
    block = F.pmod(F.pmod("_code", F.lit(blocks)) + deal, F.lit(blocks)).cast("int")
    return rows.select(block.alias("block"), "id", "text")


def paired_groups(rows: DataFrame, keys: list[str], identity: str, limit: int) -> DataFrame:
    """Split groups of more than ``limit`` rows for all-pairs work.

    A group of n rows is dealt into b = ceil(n / limit) parts by a hash of ``identity`` and becomes the
    b (b + 1) / 2 groups (pa, pb), pa <= pb, of two parts each; a row is copied to the b groups that its part
    is in.  Every pair of rows meets: in (p, p) if both are of part p, else in (p, q).  Adds part, pa, pb.
    No group holds more than about two limits, whatever the size of the hot key.
    """
    large = kept(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    )
    part = F.coalesce(F.pmod(F.xxhash64(identity), F.col("_parts")).cast("int"), F.lit(0))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    return (
        rows.join(small(large), keys, "left").withColumn("part", part).withColumn("_other", other)
        .withColumn("pa", F.least("part", "_other")).withColumn("pb", F.greatest("part", "_other"))
        .drop("_parts", "_other")
    )


def release_memory() -> None:
    """Give what a Python worker has freed back to the system: workers live on, idle, while other stages run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(work):
    """``work`` on batches (a generator) or on a group's table, which releases memory when it is through."""
    if inspect.isgeneratorfunction(work):
        def run(batches):
            yield from work(batches)
            release_memory()
    else:
        def run(table):
            out = work(table)
            release_memory()
            return out
    return run


class Forest:
    """Union-find over 0..n-1 inside a task; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def labels(self) -> np.ndarray:
        """The root of every member."""
        up = np.array(self.up)
        while (up[up] != up).any():
            up = up[up]
        self.up = up.tolist()
        return up


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return x.view(np.int64)
