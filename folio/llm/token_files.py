"""Token-id files: every id in the fewest bits that the vocabulary needs.

One file holds consecutive documents. Layout, little-endian:

    header   magic 8s, width u32, ids per block u32
    blocks   ids per block ids each, packed ``width`` bits an id, lowest bit first; padded to a byte
    index    block offsets u64[n_blocks], document starts u64[n_docs + 1] (in ids),
             document ids i64[n_docs], null marks u8[n_docs]
    trailer  n_ids u64, n_docs u64, n_blocks u64, index offset u64, magic 8s

Block offsets let a reader unpack any range of ids without the blocks before it; a block is
unpacked with numpy as a whole.

``write_documents`` writes one file per task over range-partitioned documents, so files and
the rows in them ascend by id, and returns a manifest that is itself stored: a lost executor
or a repeated task leaves at most a file that no manifest names. ``read_documents`` reads the
files of a manifest back. Defined cases: null text is an empty text (its end id alone); null
ids come first; documents with one id stand in the order of their texts; an empty table gives
no rows; columns besides id and text are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.scratch import materialise, new_folder, task_count
from folio.llm.shared_files import create, give_back, opened, text_batches
from folio.llm.token_ids import documents, encoder

MAGIC = b"IDBLOCK1"
_HEAD, _TAIL = struct.Struct("<8sII"), struct.Struct("<QQQQ8s")
BLOCK_IDS = 1 << 16


def bits_for(vocabulary_size: int) -> int:
    return max(1, (max(1, vocabulary_size) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype("<u4")[:, None] >> np.arange(width, dtype="<u4")) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", count).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=count * width).reshape(count, width)
    return bits.astype("<u4") @ (np.uint32(1) << np.arange(width, dtype="<u4"))


class Writer:
    """Streams documents into one file; holds one block and the document table."""

    def __init__(self, uri: str, width: int, block_ids: int = BLOCK_IDS):
        self.uri, self.width, self.block_ids = uri, width, block_ids
        self.out = create(uri)
        self.out.write(_HEAD.pack(MAGIC, width, block_ids))
        self.at, self.n_ids = _HEAD.size, 0
        self.offsets: list[int] = []
        self.starts: list[int] = [0]
        self.doc_ids: list[int | None] = []
        self.open: list[np.ndarray] = []
        self.n_open = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.open.append(ids)
        self.n_open += len(ids)
        if self.n_open >= self.block_ids:
            rest = np.concatenate(self.open)
            while len(rest) >= self.block_ids:
                self._block(rest[: self.block_ids])
                rest = rest[self.block_ids :]
            self.open, self.n_open = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.width)
        self.offsets.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if self.n_open:
            self._block(np.concatenate(self.open))
        null = np.array([d is None for d in self.doc_ids], dtype=np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], dtype="<i8")
        for part in (np.array(self.offsets, dtype="<u8"), np.array(self.starts, dtype="<u8"), ids, null):
            self.out.write(part.tobytes())
        self.out.write(_TAIL.pack(self.n_ids, len(ids), len(self.offsets), self.at, MAGIC))
        self.out.close()


class Reader:
    """Random access to the documents and ids of one file."""

    def __init__(self, uri: str):
        self.file = opened(uri)
        magic, self.width, self.block_ids = _HEAD.unpack(self._bytes(0, _HEAD.size))
        size = self.file.size()
        self.n_ids, self.n_docs, n_blocks, index, tail = _TAIL.unpack(self._bytes(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{uri} is not a token-id file, or is cut short")
        raw = self._bytes(index, size - _TAIL.size - index)
        self.offsets = np.append(np.frombuffer(raw, "<u8", n_blocks), np.uint64(index)).astype(np.int64)
        self.starts = np.frombuffer(raw, "<u8", self.n_docs + 1, 8 * n_blocks).astype(np.int64)
        at = 8 * (n_blocks + self.n_docs + 1)
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.null = np.frombuffer(raw, np.uint8, self.n_docs, at + 8 * self.n_docs).astype(bool)

    def _bytes(self, at: int, count: int) -> bytes:
        return self.file.read_at(count, at)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the file; reads only the blocks that hold them."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        raw = self._bytes(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        got = []
        for k in range(first, last + 1):
            count = min(self.block_ids, self.n_ids - k * self.block_ids)
            a = int(self.offsets[k] - self.offsets[first])
            got.append(unpack(raw[a : int(self.offsets[k + 1] - self.offsets[first])], self.width, count))
        base = first * self.block_ids
        return np.concatenate(got)[start - base : stop - base]

    def documents(self, most_ids: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of whole documents: first, last + 1, and their ids; about most_ids ids at a time."""
        a = 0
        while a < self.n_docs:
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + most_ids, "right")) - 1)
            yield a, b, self.ids(int(self.starts[a]), int(self.starts[b]))
            a = b


def write_documents(
    docs: DataFrame, vocabulary: str, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, tasks: int | None = None
) -> DataFrame:
    """Encode and write all documents; the manifest: part, path, n_docs, n_ids (stored, one row a file)."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, out = encoder(vocabulary), TaskContext.get().partitionId(), None
        width = bits_for(max(coder.vocabulary_size, (end_id or 0) + 1))
        for batch in text_batches(batches, 1):
            out = out or Writer(f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.bin", width, block_ids)
            for doc_id, ids in zip(batch.column(0).to_pylist(), documents(coder, batch.column(1), end_id), strict=True):
                out.add(doc_id, ids)
        if out:
            out.close()
            give_back()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [out.uri], "n_docs": [len(out.doc_ids)], "n_ids": [out.n_ids]})

    ordered = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).repartitionByRange(tasks or task_count(spark), "id").sortWithinPartitions("id", "text")
    return materialise(ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "token-manifest")


def read_documents(manifest: DataFrame, id_col: str = "doc_id", tasks: int | None = None) -> DataFrame:
    """Per document of the files: id, start (ids before it over all files), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file, however many documents
    placed = manifest.select("part", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"], strict=True):
                file = Reader(path)
                for a, b, ids in file.documents():
                    starts = file.starts[a : b + 1]
                    raw, cuts = memoryview(ids.tobytes()), (4 * (starts - starts[0])).tolist()
                    yield pd.DataFrame({
                        id_col: pd.Series(file.doc_ids[a:b]).astype("Int64").mask(pd.Series(file.null[a:b])),
                        "start": base + starts[:-1],
                        "n_tokens": np.diff(starts),
                        "ids_crc32": [zlib.crc32(raw[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)],
                    })

    spread = placed.repartitionByRange(tasks or task_count(manifest.sparkSession), "part")
    return spread.mapInPandas(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
