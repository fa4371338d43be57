"""Files that executors write to and read from the shared folder.

Paths are URIs of the shared folder; Arrow's file systems open them, so no local folder is assumed. A writer puts a
file under a name of its own attempt and hands the name on in its result: a task that runs twice leaves an
unreferenced file, never a torn one.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def attempt_name() -> str:
    ctx = TaskContext.get()
    return f"part-{ctx.partitionId() if ctx else 0:06d}-{uuid.uuid4().hex[:12]}"


def create(uri: str) -> pa.NativeFile:
    """A new file; its folder is made if need be."""
    where, path = opened(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(path, compression=None)


def source(uri: str) -> pa.NativeFile:
    where, path = opened(uri)
    return where.open_input_file(path)
