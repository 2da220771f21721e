"""Packing documents into fixed windows by minimum bin slack.

Each document's ids (an end id appended) are cut into whole windows of ``capacity`` and a
remainder. The remainders of one task form a multiset of lengths. Each further window starts
with the longest remainder left; a subset-sum dynamic program over the other lengths, a
bitset of reachable sums with each length's count split in powers of two, finds the multiset
that comes closest to the capacity, and backtracking gives how often each length is used. The
same multiset is then used again for as long as the counts allow. Where the best sum leaves
slack, the next longest remainder is cut to fill it. What stays at the end, less than a
window, is cut into windows whose sizes are powers of two, so no window needs padding.

Documents are dealt to tasks by a hash of the id and sorted there, so the result is the same
however the input files are split and whichever executor is lost. A task holds its remainders
only; when these reach ``most_ids`` ids, full windows are made of them, and what is less than a
window waits for the next ones, so only a task's last windows are smaller. Defined cases: null text is an empty text; documents that repeat
an id are packed one after the other; null ids are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.scratch import task_count
from folio.llm.shared_files import give_back, text_batches
from folio.llm.token_ids import documents, encoder


def best_fill(counts: dict[int, int], room: int) -> tuple[dict[int, int], int]:
    """The multiset out of ``counts`` whose sum is the largest up to ``room``: uses by length, sum."""
    full, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, multiplicity, sums reachable before it
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        size = 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    total = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used, total


Piece = tuple[int, int, int, int, int]  # item, start, length, window, offset


class Bins:
    """Windows being filled: whole ones go as they come, remainders wait for others to fit with."""

    def __init__(self, capacity: int):
        self.capacity, self.window, self.total = capacity, 0, 0
        self.stacks: dict[int, deque[tuple[int, int]]] = {}  # remainder's length: item, start

    def add(self, item: int, length: int) -> list[Piece]:
        """The whole windows of an item; its remainder waits."""
        whole, rest = divmod(length, self.capacity)
        pieces = [(item, k * self.capacity, self.capacity, self.window + k, 0) for k in range(whole)]
        self.window += whole
        if rest:
            self.stacks.setdefault(rest, deque()).append((item, length - rest))
            self.total += rest
        return pieces

    def _take(self, length: int, offset: int, size: int) -> Piece:
        """The first ``size`` ids of the oldest remainder of a length; what is left of it waits."""
        stack = self.stacks[length]
        item, start = stack.popleft()
        if not stack:
            del self.stacks[length]
        if size < length:
            self.stacks.setdefault(length - size, deque()).appendleft((item, start + size))
        self.total -= size
        return item, start, size, self.window, offset

    def fill(self) -> Iterator[Piece]:
        """Full windows, until less than one is left."""
        while self.total >= self.capacity:
            longest = max(self.stacks)
            counts = {length: len(stack) for length, stack in self.stacks.items()}
            counts[longest] -= 1
            used, filled = best_fill({k: n for k, n in counts.items() if n}, self.capacity - longest)
            used[longest] = used.get(longest, 0) + 1
            slack = self.capacity - longest - filled
            repeats = 1 if slack else min(len(self.stacks[k]) // n for k, n in used.items())
            lengths = [k for k in sorted(used, reverse=True) for _ in range(used[k])]
            for _ in range(repeats):
                offset = 0
                for length in lengths:
                    yield self._take(length, offset, length)
                    offset += length
                if slack:
                    yield self._take(max(self.stacks), offset, slack)
                self.window += 1

    def finish(self) -> Iterator[Piece]:
        """What is left, in windows whose sizes are powers of two."""
        while self.total:
            size, offset = 1 << (self.total.bit_length() - 1), 0
            while offset < size:
                longest = max(self.stacks)
                piece = self._take(longest, offset, min(longest, size - offset))
                offset += piece[2]
                yield piece
            self.window += 1


def pack_lengths(lengths: list[int], capacity: int) -> list[Piece]:
    """Pieces of items of the given lengths; every window holds ``capacity`` ids, or a power of two
    in the last few."""
    bins = Bins(capacity)
    pieces = [piece for item, length in enumerate(lengths) for piece in bins.add(item, length)]
    return [*pieces, *bins.fill(), *bins.finish()]


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    *,
    capacity: int = 1024,
    end_id: int = 0,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    tasks: int | None = None,
    most_ids: int = 1 << 24,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows(pieces: list[Piece], held: dict[int, tuple[int | None, int, np.ndarray, int]], first: int) -> pa.RecordBatch:
        item, start, length, window, offset = map(list, zip(*pieces, strict=True))
        ids = [held[i][2][s - held[i][3] :][:n] for i, s, n in zip(item, start, length, strict=True)]
        columns = [
            pa.array([held[i][0] for i in item], pa.int64()),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            pa.array([held[i][1] for i in item], pa.int64()),
            pa.array(np.array(window, dtype=np.int64) + first, pa.int64()),
            pa.array(offset, pa.int64()),
        ]
        if with_ids:
            columns.append(pa.array([x.view("<i4") for x in ids], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bins = encoder(vocabulary), Bins(capacity)
        first = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[int | None, int, np.ndarray, int]] = {}  # item: id, tokens, ids from which place on
        items = itertools.count()

        def flush(pieces: Iterator[Piece]) -> Iterator[pa.RecordBatch]:
            for part in itertools.batched(pieces, 50_000):
                yield rows(list(part), held, first)
            waiting = {item for stack in bins.stacks.values() for item, _ in stack}
            for item in held.keys() - waiting:
                del held[item]

        for batch in text_batches(batches, 1):
            whole: list[Piece] = []
            new: dict[int, tuple[int | None, int, np.ndarray, int]] = {}
            for doc_id, ids in zip(batch.column(0).to_pylist(), documents(coder, batch.column(1), end_id), strict=True):
                item = next(items)
                new[item] = (doc_id, len(ids), ids, 0)
                whole += bins.add(item, len(ids))
            for part in itertools.batched(whole, 50_000):
                yield rows(list(part), new, first)
            for item, (doc_id, n, ids, _) in new.items():
                if n % capacity:
                    held[item] = (doc_id, n, ids[n - n % capacity :].copy(), n - n % capacity)
            if bins.total >= most_ids:
                yield from flush(bins.fill())
        yield from flush(bins.fill())
        yield from flush(bins.finish())
        del held
        give_back()

    dealt = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    dealt = dealt.repartition(tasks or task_count(docs.sparkSession), F.xxhash64("id", F.length("text"))).sortWithinPartitions("id", "text")
    return dealt.mapInArrow(pack, schema)
