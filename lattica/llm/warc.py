"""WARC archives compressed record by record with an embedded Zstandard dictionary.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, followed by one Zstandard frame
per record; the dictionary is trained on a bounded sample of the very records that the archive is made of.  Records
of equal payload are written once, as the response of the smallest id; the others revisit it.  A response holds an
HTTP head and the payload; the payload's digest is that of the payload alone.

Tasks write files under names of their own attempt, and the manifest, a Parquet table, says which of them count;
a task that is lost and run again leaves a file that no manifest names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import hashed_sample, kept, looked_up, prepare, shared_uri

# Fixed value of the WARC-Zstandard convention: the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: The dictionary's size, and the sample it is trained on: so many records of at most so many payload bytes, whole.
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 64 << 10, 500, 64 << 10
#: Payload bytes of a file, about; a file is read back whole by one task.
FILE_BYTES = 16 << 20
#: Smaller payloads are always written as responses.
LEAST_REVISIT = 100
READ_BYTES = 64 << 10


def train_dictionary(rows: DataFrame, repeated: DataFrame, date: str) -> bytes:
    """A dictionary from ``SAMPLE_RECORDS`` records, the first by a hash among those that are not too large (b"" if they are too few)."""
    fit = rows.where(F.octet_length("html") <= SAMPLE_BYTES)
    sample = hashed_sample(fit, SAMPLE_RECORDS, "page_id", "digest").collect()
    firsts = {r["digest"]: r for r in repeated.where(F.col("digest").isin([r["digest"] for r in sample])).collect()}
    found = []
    for k, r in enumerate(sample):
        first = firsts.get(r["digest"])
        again = first is not None and first["first"] != r["page_id"]
        refers = {"refers_to": first["first"] if again else None, "refers_url": first["first_url"] if again else None}
        found.append(record(r.asDict() | refers, date, f"sample-{k}"))
    if len(found) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except zstandard.ZstdError:  # too little in common to build one from
        return b""


def frame(dictionary: bytes) -> bytes:
    """The skippable frame at the head of a file."""
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def _uri(url: str | None) -> str:
    """A header value: what would end the line is escaped."""
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url or "")


def record(row: dict, date: str, name: str) -> bytes:
    """One WARC/1.1 record; a revisit has no block, and says how long the payload it stands for is.

    Record ids are unique in the archive whatever the pages' ids are (``name``: the file and the record's number in
    it); the page's own id, if it has one, and that of the page it revisits are headers of their own.
    """
    payload, revisit = (row["html"] or "").encode(), row["refers_to"] is not None
    block = b"" if revisit else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(row['url'])}",
        f"WARC-Payload-Digest: sha256:{row['digest']}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if row["page_id"] is not None:
        head.append(f"WARC-Page-ID: {row['page_id']}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_uri(row['refers_url'])}",
                 f"WARC-Refers-To-Date: {date}", f"WARC-Refers-To-Page-ID: {row['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    return headers, rest[: int(headers["Content-Length"])]


def _writer(folder: str, dictionary: bytes, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=6, dict_data=shared) if shared else zstandard.ZstdCompressor(level=6)
        out, name, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"part-{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(frame(dictionary))
                raw = record(row, date, f"{name}/{count}")
                out.write(packer.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    done.append((name, count))
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file", "records"])
    return write


def write_archive(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> DataFrame:
    """Write every page as a record to ``folder`` (a URI that pyarrow can open) and return the manifest (file, records).

    Null payloads are empty; a null url is an empty one.  Of equal payloads of ``LEAST_REVISIT`` bytes and more, the
    rows with the smallest id are responses and the others, those with a null id too, revisit it; where all ids are
    null, all are responses.  Rows that repeat an id become records of their own.  ``date`` (now) is that of all
    records.  An empty table writes no file.  Payloads are never exchanged: what repeats is found on ids and digests.
    """
    prepare(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    seen = rows.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    repeated = kept(seen.where("copies > 1 and first is not null").select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")))
    dictionary = train_dictionary(rows, repeated, date)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = looked_up(rows, repeated, "digest").select(
        "page_id", "url", "html", "digest", F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))
    return kept(marked.mapInArrow(_writer(folder, dictionary, date), "file string, records long"))


def unpack(stream) -> Iterator[bytes]:
    """The records of an open file, one after another, in pieces of bounded size."""
    magic, length = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    held = zstandard.ZstdCompressionDict(stream.read(length)) if length else None
    opener = zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()
    rest = stream.read(READ_BYTES)
    while rest:
        one, parts = opener.decompressobj(), []
        while not one.eof:
            if not rest:
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else stream.read(READ_BYTES)
        yield b"".join(parts)
        rest = rest or stream.read(READ_BYTES)


def _number(value: str | None) -> int | None:
    return int(value) if value is not None else None


_COLUMNS = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(),
            "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "record_id": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _COLUMNS.values(), strict=True)], names=list(_COLUMNS))


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows, size = [], 0
                    for raw in unpack(stream):
                        head, block = parse(raw)
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"record {head['WARC-Record-ID']} has another payload than its digest says")
                        rows.append((_number(head.get("WARC-Page-ID")), head["WARC-Target-URI"], payload, int(head["WARC-Payload-Length"]),
                                     digest, kind, _number(head.get("WARC-Refers-To-Page-ID")), head["WARC-Record-ID"]))
                        size += len(block)
                        if size > 4 << 20 or len(rows) >= 1000:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)
    return read


def read_archive(folder: str, manifest: DataFrame) -> DataFrame:
    """Records of the files that ``manifest`` names, with digests checked against payloads; a task reads files one by one.

    Columns: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to, record_id.
    """
    spark = manifest.sparkSession
    tasks = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return manifest.select("file").repartition(tasks).mapInArrow(
        _reader(folder), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for an archive in the shared folder."""
    return f"{shared_uri(spark)}/warc-{uuid.uuid4().hex}"
