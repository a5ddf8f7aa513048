"""Files of any store that pyarrow can open, by URI or path: listing, and which snapshot of a source to read."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession

from lattica.schema import opened

#: A file of so many bytes or fewer is a placeholder of a download that brought nothing.
PLACEHOLDER_BYTES = 100
_DATED = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def files(uri: str, suffix: str = "", recursive: bool = True) -> Iterator[fs.FileInfo]:
    """The files under a folder whose names end with ``suffix``, by path; hidden ones (``.`` or ``_``) don't count."""
    store, root = opened(uri)
    found = store.get_file_info(fs.FileSelector(root, recursive=recursive, allow_not_found=True))
    yield from sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and f.base_name[:1] not in "._"), key=lambda f: f.path)


def newest_snapshot(uri: str, least: int = PLACEHOLDER_BYTES) -> str | None:
    """The newest dated folder (``YYYY-MM-DD``) of a source that holds a file of over ``least`` bytes.

    Later folders that hold placeholders only are passed over; where no folder has data there is no snapshot.
    """
    store, root = opened(uri)
    folders = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    dated = sorted((f.base_name for f in folders if f.type == fs.FileType.Directory and _DATED.fullmatch(f.base_name)), reverse=True)
    for name in dated:
        folder = f"{uri.rstrip('/')}/{name}"
        if any(f.size > least for f in files(folder, recursive=False)):
            return folder
    return None


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` or the session's checkpoint folder names it."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return held.rstrip("/")
