"""Files and digests out of ordered chunks, so that no row ever holds a whole book.

Chunks are rows (book_id, path, seq, text, data); a file is its chunks in the order of ``seq``, text or, where
that is null, bytes as they are. They are
dealt by file and sorted, and one pass over the sorted rows normalises, joins and hashes them: a
task holds one chunk at a time, and the state of one hash. SHA-256 has to see a file's bytes in
order, so a file is one task's, however many chunks it has; files are spread over tasks.

For digests alone not even the sort is one task's: chunks are sorted in ranges and stored (``sorted_ranges``), and
the task that has a file's first range reads on through the others, batch by batch.

Chunks start with characters that never compose with what stands before them (line feeds, marks,
JSON syntax), so NFC of the chunks is NFC of the file.
"""

from __future__ import annotations

import hashlib
import itertools
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.shared import stored

CHUNKS = "book_id string, path string, seq long, text string, data binary"
DIGESTS = "book_id string, path string, sha256 string, size_bytes long"


def normalised(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def trimmed(texts: Iterable[str]) -> Iterator[str]:
    """The texts of a file without white space at its end, then one line feed. White space is held back until something follows it."""
    held: list[str] = []
    for text in texts:
        body = text.rstrip()
        if body:
            yield from held
            held.clear()
            yield body
        if len(body) < len(text):
            held.append(text[len(body) :])
    yield "\n"


def files(batches: Iterator[pa.RecordBatch], trim: bool) -> Iterator[tuple[str, str, Iterator[bytes]]]:
    """Of sorted chunks: each file's book, path and bytes, chunk by chunk. A file's bytes have to be used up before the next."""

    def rows() -> Iterator[tuple[str, str, str | bytes]]:
        for batch in batches:
            book, path, text, data = (batch.column(batch.schema.get_field_index(x)) for x in ("book_id", "path", "text", "data"))
            for at in range(batch.num_rows):
                yield book[at].as_py(), path[at].as_py(), data[at].as_py() or b"" if text[at].as_py() is None else text[at].as_py()

    for (book, path), own in itertools.groupby(rows(), key=lambda row: row[:2]):
        parts = (row[2] for row in own)
        first = next(parts)
        whole = itertools.chain([first], parts)
        if isinstance(first, bytes):
            yield book, path, whole
        else:
            texts = (normalised(x) for x in whole)
            yield book, path, (x.encode("utf-8", "replace") for x in (trimmed(texts) if trim else texts))


def dealt(chunks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Chunks dealt by file and sorted within the tasks."""
    cut = chunks.repartition(tasks, "book_id", "path") if tasks else chunks.repartition("book_id", "path")
    data = F.col("data") if "data" in chunks.columns else F.lit(None).cast("binary").alias("data")
    return cut.select("book_id", "path", F.col("seq").cast("long").alias("seq"), "text", data).sortWithinPartitions("book_id", "path", "seq")


def texts(chunks: DataFrame, *, trim: bool = False) -> DataFrame:
    """book_id, path and text of each file, a row and a batch each. A task holds one file, in one buffer that grows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book, path, parts in files(batches, trim):
            whole = bytearray()
            for part in parts:
                whole += part
            text = pa.StringArray.from_buffers(1, pa.array([0, len(whole)], pa.int32()).buffers()[1], pa.py_buffer(whole))
            yield pa.RecordBatch.from_arrays([pa.array([book], pa.string()), pa.array([path], pa.string()), text], names=["book_id", "path", "text"])

    return dealt(chunks).mapInArrow(run, "book_id string, path string, text string")


_ORDER = ("book_id", "path", "seq")


def sorted_ranges(chunks: DataFrame, tasks: int | None = None) -> list[str]:
    """Chunks in the order of files and places, stored a range each: the ranges' files, in order."""
    data = F.col("data") if "data" in chunks.columns else F.lit(None).cast("binary").alias("data")
    plain = chunks.select("book_id", "path", F.col("seq").cast("long").alias("seq"), "text", data)
    ranged = plain.repartitionByRange(tasks, *_ORDER) if tasks else plain.repartitionByRange(*_ORDER)
    ranges = stored(ranged.sortWithinPartitions(*_ORDER), "chunks", compression="zstd", **{"parquet.block.size": str(8 << 20)})

    def place(uri: str) -> tuple[int, str]:
        name = uri.rsplit("/", 1)[-1]  # part-<range>-<job>-c<number>
        return int(name.split("-")[1]), name.rsplit("-", 1)[-1]

    return sorted(ranges.inputFiles(), key=place)


def _opened(uri: str) -> pq.ParquetFile:
    store, path = pafs.FileSystem.from_uri(uri)
    return pq.ParquetFile(store.open_input_file(path), pre_buffer=False)


def _keys(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[str, str]]:
    return zip(batch.column("book_id").to_pylist(), batch.column("path").to_pylist(), strict=True)


def _last_key(uri: str) -> tuple[str, str] | None:
    with _opened(uri) as f:
        for group in reversed(range(f.num_row_groups)):
            keys = f.read_row_group(group, columns=["book_id", "path"])
            if keys.num_rows:
                return next(_keys(keys.slice(keys.num_rows - 1)))
    return None


def files_of(ranges: list[str], at: int) -> Iterator[pa.RecordBatch]:
    """The chunks of the files that begin in range ``at``, to the end of the last one, in whichever range that is."""
    before = next((key for uri in reversed(ranges[:at]) if (key := _last_key(uri))), None)
    begun: tuple[str, str] | None = None
    for k in range(at, len(ranges)):
        with _opened(ranges[k]) as f:
            for batch in f.iter_batches(4096):
                if k > at:  # only what is left of the last file
                    own = sum(1 for _ in itertools.takewhile(begun.__eq__, _keys(batch)))
                    if own:
                        yield batch.slice(0, own)
                    if own < batch.num_rows:
                        return
                    continue
                if begun is None:
                    batch = batch.slice(sum(1 for _ in itertools.takewhile(lambda key: key == before, _keys(batch))))
                if batch.num_rows:
                    begun = next(_keys(batch.slice(batch.num_rows - 1)))
                    yield batch
        if begun is None:
            return


def digests(chunks: DataFrame, *, trim: bool = False, tasks: int | None = None) -> DataFrame:
    """DIGESTS: hash and size of each file. With ``trim`` files end in one line feed and no other white space.

    ``tasks`` is the number of ranges, the session's if it is not given."""
    ranges = sorted_ranges(chunks, tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, str, int]] = []
        for at in (x for batch in batches for x in batch.column(0).to_pylist()):
            for book, path, parts in files(files_of(ranges, at), trim):
                sha, size = hashlib.sha256(), 0
                for part in parts:
                    sha.update(part)
                    size += len(part)
                out.append((book, path, sha.hexdigest(), size))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["book_id", "path", "sha256", "size_bytes"])

    return chunks.sparkSession.range(0, len(ranges), 1, max(1, len(ranges))).mapInArrow(run, DIGESTS)
