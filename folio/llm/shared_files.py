"""Binary files in the shared folder, opened from Python tasks through Arrow's filesystems; Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a URI such as spark.checkpoint.dir names (file, hdfs, s3, gs ...)."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """An output stream to a new file; its folder is made where that is needed."""
    system, path = resolve(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def opened(uri: str):
    """A random-access input file."""
    system, path = resolve(uri)
    return system.open_input_file(path)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of their texts are Python strings at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def text_batches(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of a text column, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most_bytes, "right")))
            yield batch.slice(a, b - a)
            a = b


def give_back() -> None:
    """Return memory that this worker no longer uses to the system; workers outlive their tasks, so what
    one stage needed would else stand beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
