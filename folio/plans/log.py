"""The commit log of a run: accepted pages of all books in numbered batches, and a head that is written
after them.

A batch is a Parquet table, written by the tasks; it counts once ``head.json`` names it, which is one
atomic write of the driver. So a crash leaves at most a batch that the head does not name, and
``recover`` sets it aside. Failures are numbered the same way. With each batch goes a snapshot of
every book's state, one row a book, so that new pages are folded from there and old ones are not
read again. A book's own head is its state's page count, and only pages that go on from there are
taken.
"""

from __future__ import annotations

import json
import os
import re
import shutil
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.errors import FolioError
from folio.operators import scan, store
from folio.plans.runs import write_atomic
from folio.schemas import PAGES

HEAD_VERSION = 1  # fixed value
_BATCH, _FAILURE, _RECOVERY, _SNAPSHOT = r"batch-(\d{4,})", r"failure-(\d{4,})", r"recovery-(\d{4,})", r"snapshot-(\d{4,})"


def _numbers(folder: str, pattern: str) -> list[int]:
    return sorted(int(m.group(1)) for x in (os.listdir(folder) if os.path.isdir(folder) else ()) if (m := re.fullmatch(pattern, x)))


class Log:
    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.run = spark, run
        self.snapshots_folder = os.path.join(run, "snapshots")
        self.pages_folder, self.failures_folder, self.head_path = (os.path.join(run, x) for x in ("pages", "failures", "head.json"))

    def head(self) -> dict[str, Any]:
        """committed_page_count and batches."""
        try:
            with open(self.head_path) as file:
                head = json.load(file)
        except (OSError, ValueError) as e:
            raise FolioError("invalid-run-layout", f"{self.head_path}: {e}") from e
        if head.get("head_format_version") != HEAD_VERSION:
            raise FolioError("invalid-run-layout", "unknown head version")
        return {"batches": 0} | head

    def _batch(self, number: int) -> str:
        return os.path.join(self.pages_folder, f"batch-{number:04d}")

    def pages(self) -> DataFrame:
        """All committed pages."""
        batches = [self._batch(n) for n in range(1, self.head()["batches"] + 1)]
        if missing := [b for b in batches if not os.path.isdir(b)]:
            raise FolioError("invalid-run-layout", f"{missing[0]} is gone")
        return self.spark.read.schema(PAGES).parquet(*batches) if batches else self.spark.createDataFrame([], PAGES)

    def _snapshot(self, number: int) -> str:
        return os.path.join(self.snapshots_folder, f"snapshot-{number:04d}")

    def snapshots(self) -> DataFrame:
        """The state of every book at its head (scan.SNAPSHOT): stored with the last batch, or folded anew from all pages where it is gone."""
        last = self.head()["batches"]
        if not last:
            return self.spark.createDataFrame([], scan.SNAPSHOT)
        if not os.path.isdir(self._snapshot(last)):
            pages = self.pages()
            scan.snapshot(pages, scan.scan(pages)).write.mode("overwrite").parquet(self._snapshot(last))
        return self.spark.read.schema(scan.SNAPSHOT).parquet(self._snapshot(last))

    def heads(self) -> DataFrame:
        """book_id, committed_page_count."""
        return self.snapshots().select("book_id", F.col("state.processed_page_count").cast("int").alias("committed_page_count"))

    def recover(self) -> list[str]:
        """Sets aside batches past the head, and always takes a recovery number; the names that were moved."""
        last = self.head()["batches"]
        area = os.path.join(self.run, "recovery", f"recovery-{1 + max(_numbers(os.path.join(self.run, 'recovery'), _RECOVERY), default=0):04d}")
        os.makedirs(area)
        moved = [f"batch-{n:04d}" for n in _numbers(self.pages_folder, _BATCH) if n > last]
        for name in moved:
            os.rename(os.path.join(self.pages_folder, name), os.path.join(area, name))
        for n in _numbers(self.snapshots_folder, _SNAPSHOT):  # they can be folded again, so those that no head needs just go
            if n != last:
                shutil.rmtree(self._snapshot(n))
        return moved

    def append(self, pages: DataFrame, snapshots: DataFrame | None = None) -> int:
        """Writes pages that go on from their books' heads as the next batch and the states after them, then the head; how many there are.

        ``snapshots`` are the states after just these pages, where the caller has chosen and folded them; else the stored states are folded on."""
        head = self.head()
        before = self.snapshots()
        taken = pages if snapshots is not None else store.extending(pages, self.heads())
        target = self._batch(head["batches"] + 1)
        taken.select(*self.spark.createDataFrame([], PAGES).columns).write.parquet(target)
        written = self.spark.read.schema(PAGES).parquet(target)
        count = written.count()
        if count:
            after = snapshots if snapshots is not None else scan.snapshot(written, scan.scan(written, before), before)
            after.write.mode("overwrite").parquet(self._snapshot(head["batches"] + 1))
            new = {"head_format_version": HEAD_VERSION, "batches": head["batches"] + 1, "committed_page_count": head["committed_page_count"] + count}
            write_atomic(self.head_path, json.dumps(new, sort_keys=True).encode())
        else:  # nothing to name
            self.recover()
        return count

    def fail(self, stops: DataFrame) -> tuple[str, Any] | None:
        """Stores the stops of books as the next numbered failure and points at it; its name and first row."""
        number = 1 + max(_numbers(self.failures_folder, _FAILURE), default=0)
        name = f"failure-{number:04d}"
        path = os.path.join(self.failures_folder, name)
        stops.write.parquet(path)
        first = self.spark.read.schema(stops.schema).parquet(path).orderBy("book_id").first()
        if first is None:
            shutil.rmtree(path)  # no book stopped, so this is no failure
            return None
        write_atomic(os.path.join(self.failures_folder, "latest.json"), json.dumps({"failure": name}).encode())
        return name, first
