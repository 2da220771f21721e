"""Interpretation in order: contexts of the windows, batches over books, snapshots, stops."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.operators import scan, state
from folio.plans import flows, reading
from folio.sources import carriers as C
from folio.sources import wire
from folio.sources.shared import stored
from tests.conftest import SF

RAW = "book_id string, page_index int, content string"


@flows.register("as-given")
def _as_given(pages):
    return pages["content"]


@flows.register("sized")
def _sized(pages):
    return pages["content"].map(lambda x: json.dumps({"page_type": "body", "printed_page_label": f"{len(pages)}"}))


def wired(pages):
    kept = ("kind", "role", "content", "heading_level", "continues_previous", "continues_on_next_page")
    blocks = F.transform("blocks", lambda b: F.struct(*[b[k].alias("segments" if k == "content" else k) for k in kept]))
    return pages.select("book_id", "page_index", F.to_json(F.struct("page_type", "toc_entries", "opening", "metadata", blocks.alias("blocks"))).alias("content"))


def contexts(df):
    out = {}
    for r in df.collect():
        known = json.loads(r.context)
        known["expected_toc_entries"] = [e["title"] for e in known["expected_toc_entries"]]
        out[r.book_id, r.page_index] = known
    return out


def expected(pages):
    known = state.page_context(state.with_state(pages))
    json_ = F.to_json(F.struct(*[c for c in known.columns if c not in ("book_id", "page_index")]), {"ignoreNullFields": "false"})
    return contexts(known.select("book_id", "page_index", json_.alias("context")))


def test_contexts_are_those_of_the_windows_also_from_snapshots(spark):
    pages = stored(C.event_pages(spark, SF).filter("book_id % 9 = 0"), "events")
    assert contexts(reading.interpreted(wired(pages), "as-given")) == (whole := expected(pages))
    head = F.col("page_index") < 3
    old = pages.filter(head)
    rest = contexts(reading.interpreted(wired(pages.filter(~head)), "as-given", stored(scan.snapshot(old, scan.scan(old)), "snapshots")))
    assert rest and rest == {k: v for k, v in whole.items() if k[1] >= 3}


def test_responses_become_the_pages(spark):
    pages = stored(C.conversation_pages(spark, SF), "conversations")
    read = wire.to_domain(wire.parsed(reading.interpreted(wired(pages), "as-given"), "response"), "book_id", "page_index")
    assert read.count() == pages.count() and read.filter("page_type = 'toc'").count() == pages.filter("page_type = 'toc'").count()


@pytest.mark.parametrize("batch", [1, 4, 64])
def test_batches_hold_pages_of_different_books(spark, batch):
    raw = spark.createDataFrame([(f"b{b}", p, "{}") for b in range(40) for p in range(b % 4)], RAW).coalesce(1)
    rows = reading.interpreted(raw, "sized", batch=batch).collect()
    sizes = [int(json.loads(r.response)["printed_page_label"]) for r in rows]
    assert len(rows) == 60 and max(sizes) <= batch and (batch == 1 or max(sizes) > 1)


def test_books_stop_where_their_order_or_a_response_breaks(spark):
    good = json.dumps({"page_type": "body"})
    rows = [("a", 0, good), ("a", 2, good), ("b", 1, good), ("c", 0, good), ("c", 1, "{"), ("c", 2, good), ("d", 0, good), ("d", 0, good), ("d", 1, good), ("e", 0, json.dumps({"blocks": []})), ("e", 1, good), ("f", 0, good), ("f", 1, good)]
    got = sorted((r.book_id, r.page_index, r.response is not None) for r in reading.interpreted(spark.createDataFrame(rows, RAW), "as-given").collect())
    assert got == [
        ("a", 0, True), ("a", 2, False), ("b", 1, False), ("c", 0, True), ("c", 1, True), ("c", 2, False), ("d", 0, False), ("d", 0, True), ("d", 1, False), ("e", 0, True), ("e", 1, False), ("f", 0, True), ("f", 1, True),
    ]
    assert reading.interpreted(spark.createDataFrame([], RAW), "as-given").count() == 0


@flows.register("unindexed")
def _unindexed(pages):
    return pd.Series([json.dumps({"page_type": "body", "printed_page_label": x}) for x in pages["content"]])


def test_responses_belong_to_the_pages_that_were_asked(spark):
    raw = spark.createDataFrame([("a", 1, "a1"), ("b", 0, "b0"), ("b", 1, "b1")], RAW).coalesce(1)
    got = {(r.book_id, r.page_index): r.response and json.loads(r.response)["printed_page_label"] for r in reading.interpreted(raw, "unindexed").collect()}
    assert got == {("a", 1): None, ("b", 0): "b0", ("b", 1): "b1"}
