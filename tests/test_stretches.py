"""No task needs a book's content: texts are dealt by document, files are hashed out of ranges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from folio.operators import ordered, publish, state
from folio.sources import carriers as C
from tests.conftest import SF


@pytest.fixture
def one_book(spark, tmp_path):
    """The documents as one source, some of them twice."""
    docs = C.load(spark, SF, "documents").withColumn("source", F.lit("all"))
    docs.unionByName(docs.filter("doc_id % 40 = 0")).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_one_book_is_many_tasks_work(spark, one_book, monkeypatch):
    monkeypatch.setattr(C, "DOCUMENTS_A_TASK", 20)
    pages = C.document_pages(spark, one_book)
    rows = pages.withColumn("task", F.spark_partition_id()).select("page_index", "task").collect()
    assert sorted(r.page_index for r in rows) == list(range(C.load(spark, one_book, "documents").count()))
    shares = [sum(r.task == t for r in rows) for t in {r.task for r in rows}]
    assert max(shares) < len(rows) / 4


def test_blocks_do_not_depend_on_stretches(spark, one_book, monkeypatch):
    pages = state.with_block_ids(C.document_pages(spark, one_book)).localCheckpoint()
    rows = lambda p: sorted(str(r) for r in publish.publication_blocks(p).collect())
    whole = rows(pages)
    at = sorted(r[0] for r in publish.publication_blocks(pages).select("publication_block_index").collect())
    assert at == list(range(len(at)))
    for span in (1, 7, 100_000):
        monkeypatch.setattr(publish, "SPAN", span)
        assert rows(pages.drop("stretch")) == whole


def test_files_are_hashed_across_ranges(spark):
    at = spark.range(3_000).select(F.when(F.col("id") < 2_500, "long").otherwise(F.concat(F.lit("b"), F.col("id") % 40)).alias("book_id"), F.lit("f").alias("path"), F.col("id").alias("seq"), F.concat(F.lit("\n"), F.col("id")).alias("text"))
    want: dict[str, str] = {}
    for r in sorted(at.collect(), key=lambda r: r.seq):
        want[r.book_id] = want.get(r.book_id, "") + r.text
    assert len(ordered.sorted_ranges(at, 6)) > 3
    for tasks in (1, 6, 50):
        got = {r.book_id: (r.sha256, r.size_bytes) for r in ordered.digests(at, tasks=tasks).collect()}
        assert got == {b: (hashlib.sha256(t.encode()).hexdigest(), len(t)) for b, t in want.items()}
