"""The parallel scan against the windows and against a plain fold; snapshots; what plans read."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import scan, state, store
from folio.plans import flows
from folio.plans.log import Log
from folio.schemas import PAGES
from folio.sources.shared import numbered, stored
from tests.conftest import SF


def made(spark, seed, books=6, most=40):
    """Books of random pages: TOC pages with and without entries, openings with and without titles, headings, tails, metadata."""
    rng = random.Random(seed)
    rows = []
    for b in range(books):
        kinds = rng.choice([("toc", "body", "chapter_opening"), ("blank", "toc", "chapter_opening", "body", "figure_page"), ("blank", "figure_page", "toc"), ("body", "toc", "chapter_opening", "chapter_opening")])
        for p in range(rng.randrange(1, most)):
            kind = rng.choice(kinds)
            text = lambda role, level=None, on=False: {"kind": "text", "role": role, "content": [("text", f"{role} {b}.{p} " + "x" * rng.choice([0, 600]))], "heading_level": level, "continues_on_next_page": on}
            blocks = [text(rng.choice(["heading", "paragraph", "chapter_title", "list_item"]), rng.choice([None, 1, 2]), rng.random() < 0.5) for _ in range(rng.randrange(4))]
            fields = ("kind", "role", "content", "label", "caption", "heading_level", "continues_previous", "continues_on_next_page", "bbox", "style", "asset_sha256", "block_id")
            opening = ("part", None, f"O{p}", None, 1) if kind == "chapter_opening" and rng.random() < 0.4 else None
            meta = (rng.choice([None, "", f"T{p}"]), rng.choice([None, f"S{p}"]), rng.choice([[], [f"A{p}"]]), rng.choice([None, "en"])) if rng.random() < 0.5 else None
            entries = [(f"E{p}.{k}", 1, "chapter", None) for k in range(rng.randrange(3))] if kind == "toc" else []
            rows.append((f"b{b}", p, kind, None, opening, meta, entries, [tuple(x.get(f, False if f.startswith("cont") and f != "content" else None) for f in fields) for x in blocks]))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, PAGES)


def by_windows(pages):
    s, section = state.with_state(pages), F.col("section")
    return s.select(
        "book_id", "page_index", "toc_status", "toc_status_before", F.size("toc").alias("n_toc"), "next_expected_opening_index", "previous_page_type", "processed_page_count", "book_metadata",
        section["kind"], section["title"], section["toc_index"], section["started_on_page"], F.when(section.isNotNull(), F.size(section["heading_stack"])).alias("n"), section["recent_headings"], section["open_paragraph_tail"],
    )


def by_scan(pages, snapshots=None, span=scan.SPAN):
    s, section = scan.with_state(pages, snapshots, span), F.col("state.section")
    return s.select(
        "book_id", "page_index", "toc_status", "toc_status_before", "n_toc", "next_expected_opening_index", "previous_page_type", "processed_page_count", "book_metadata",
        section["kind"], section["title"], section["toc_index"], section["started_on_page"], section["n_headings"].alias("n"), section["recent_headings"], scan.open_tail(F.col("state")),
    )


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_of_any_length_give_the_states_of_the_windows(spark, seed):
    pages = stored(made(spark, seed), "made")
    expected = rows(by_windows(pages))
    for span in (1, 4, 10_000):
        assert rows(by_scan(pages, span=span)) == expected
    assert rows(scan.page_context(scan.with_state(pages, span=3))) == rows(state.page_context(state.with_state(pages)))


@pytest.mark.parametrize("seed", [3, 4])
def test_states_go_on_from_snapshots(spark, seed):
    """Wherever books are cut, also twice, the pages after the cut get the states of the whole."""
    pages = stored(made(spark, seed), "made")
    expected = rows(by_windows(pages))
    cut = F.expr("cast(crc32(cast(book_id as binary)) % 17 as int)")
    parts = [pages.filter(F.col("page_index") < cut), pages.filter((F.col("page_index") >= cut) & (F.col("page_index") < cut + 6)), pages.filter(F.col("page_index") >= cut + 6)]
    snapshots, found = None, []
    for part in parts:
        found += by_scan(part, snapshots, span=5).collect()
        snapshots = stored(scan.snapshot(part, scan.scan(part, snapshots), snapshots), "snapshots")
    assert sorted(str(tuple(r)) for r in found) == expected
    ends = state.with_state(pages).groupBy("book_id").agg(F.max_by(F.struct("toc", "toc_status", "processed_page_count"), "page_index").alias("e"))
    whole = {r.book_id: (r.e.toc, r.e.toc_status, r.e.processed_page_count) for r in ends.collect()}
    assert {r.book_id: (r.toc, r.state.toc_status, r.state.processed_page_count) for r in snapshots.collect()} == whole


def test_no_pages(spark):
    none = spark.createDataFrame([], PAGES)
    assert scan.with_state(none).count() == 0 and scan.snapshot(none, scan.scan(none)).count() == 0
    pages = made(spark, 5, books=2)
    kept = scan.snapshot(pages, scan.scan(pages))
    again = scan.snapshot(none, scan.scan(none, kept), kept)
    assert rows(again) == rows(kept)


def test_one_book_is_spread_over_tasks(spark):
    """A book of 2,000 pages in ranges of 100: no task of the page windows holds more than its ranges."""
    one = made(spark, 6, books=1, most=2).drop("page_index").limit(1)
    pages = spark.range(2000).select(F.col("id").cast("int").alias("page_index")).crossJoin(one)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = scan.page_summaries(pages).withColumn("_range", F.floor(F.col("start") / 100).cast("int"))
        sizes = scan.prefixed(ranged, "book_id", "_range").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 1200


def test_resuming_reads_new_pages_and_snapshots_only(spark, tmp_path):
    pages = made(spark, 7)
    head = F.col("page_index") < 10
    pages.filter(head).write.parquet(str(tmp_path / "old"))
    pages.filter(~head).write.parquet(str(tmp_path / "new"))
    old, new = spark.read.parquet(str(tmp_path / "old")), spark.read.parquet(str(tmp_path / "new"))
    scan.snapshot(old, scan.scan(old)).write.parquet(str(tmp_path / "snapshots"))
    resumed = scan.scan(new, spark.read.parquet(str(tmp_path / "snapshots")))
    assert {f.rsplit("/", 2)[1] for f in resumed.inputFiles()} == {"new", "snapshots"}


def test_places_are_counted_without_one_task(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = numbered(df.repartition(7), "place", "k").collect()
    assert sorted((r.k, r.place) for r in got) == [(i, i) for i in range(1000)]
    assert numbered(df.limit(0), "place", "k").collect() == []
    ties = numbered(spark.createDataFrame([(1,), (1,), (None,)], "k int"), "place", "k").collect()
    assert sorted(r.place for r in ties) == [0, 1, 2]


def test_pages_that_extend_their_book(spark):
    new = spark.createDataFrame([("a", p) for p in (2, 3, 5)] + [("b", 0), ("b", 1), ("b", 1), ("b", 2), ("c", 4), ("d", 0), ("d", 1), ("a", 0)], "book_id string, page_index int")
    heads = spark.createDataFrame([("a", 2), ("d", 1)], "book_id string, committed_page_count int")
    assert sorted(map(tuple, store.extending(new, heads).collect())) == [("a", 2), ("a", 3), ("b", 0), ("d", 1)]


def test_books_end_where_their_page_count_says(spark):
    """A book whose TOC is not used up and whose paragraph goes on is fine until its last page has come."""
    pages = made(spark, 8, books=1, most=2).limit(0)
    rows_ = [("go", 0, "toc", None, None, None, [("One", 1, "chapter", None)], []), ("go", 1, "blank", None, None, None, [], [])]
    pages = spark.createDataFrame(rows_, pages.schema)
    counts = lambda n: spark.createDataFrame([("go", n)] if n else [], "book_id string, page_count int")
    assert flows.ingest(pages, page_counts=counts(None))[1].count() == 0
    assert flows.ingest(pages, page_counts=counts(3))[1].count() == 0
    assert [(r.page_index, r.code) for r in flows.ingest(pages, page_counts=counts(2))[1].collect()] == [(1, "toc-not-exhausted")]
    assert flows.ingest(pages)[1].count() == 1


def test_ingest_from_snapshots_finds_what_whole_books_find(spark):
    from folio.sources import carriers as C

    pages = stored(C.event_pages(spark, SF), "events").filter("book_id % 7 = 0")
    whole, stops = flows.ingest(pages, whole_books=False)
    assert stops.count() > 0
    cut = 3
    first, early, snapshots = flows.ingested(pages.filter(F.col("page_index") < cut), whole_books=False)
    snapshots = stored(snapshots, "snapshots")
    rest = store.extending(pages.join(early.select("book_id"), "book_id", "left_anti"), snapshots.select("book_id", F.col("state.processed_page_count").alias("committed_page_count")))
    second, late = flows.ingest(rest, whole_books=False, snapshots=snapshots)
    assert rows(early.unionByName(late)) == rows(stops)
    assert rows(first.select("book_id", "page_index").unionByName(second.select("book_id", "page_index"))) == rows(whole.select("book_id", "page_index"))


def test_snapshots_of_the_log_can_be_folded_again(spark, tmp_path):
    from folio import cli
    import shutil

    source, run = tmp_path / "book.pdf", str(tmp_path / "run")
    source.write_bytes(b"%PDF")
    assert cli.main(["init", "--run", run, "--source", str(source)]) == 0
    log, pages = Log(spark, run), stored(made(spark, 9, books=3), "made")
    assert log.append(pages.filter("page_index < 4")) + log.append(pages) == pages.count()
    stored_states = rows(log.snapshots())
    assert len(stored_states) == 3
    shutil.rmtree(f"{run}/snapshots")
    assert rows(log.snapshots()) == stored_states
