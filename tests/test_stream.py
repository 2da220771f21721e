"""The whole reducer as a stream against the windows; rejected pages; restarts."""

import pandas as pd
from pyspark.sql import functions as F

from folio.operators import state
from folio.sources.shared import stored
from folio.streaming.reducer import _PAGE, PageReducer
from folio.streaming.run import stream_in_parts
from tests.test_scan import made


def test_parts_with_restarts_give_the_states_of_the_windows(spark):
    pages = stored(made(spark, 21, books=4, most=25), "made")
    got = stream_in_parts([pages.filter("page_index < 6"), pages.filter("page_index >= 6 AND page_index < 14"), pages.filter("page_index >= 14")])
    section, meta = F.col("section"), F.col("book_metadata")
    shown = F.array_join(F.transform(section["recent_headings"], lambda h: F.concat_ws("/", h["level"].cast("string"), h["text"], h["page_index"].cast("string"))), ";")
    expected = state.with_state(pages).select(
        "book_id", "page_index", "toc_status", F.size("toc").alias("n_toc"), "next_expected_opening_index", section["kind"].alias("section_kind"), section["title"].alias("section_title"), section["toc_index"].alias("toc_index"),
        section["started_on_page"].alias("started_on_page"), F.when(section.isNotNull(), F.size(section["heading_stack"])).alias("n_headings"), shown.alias("recent_headings"), section["open_paragraph_tail"].alias("open_paragraph_tail"),
        F.col("page_type").alias("last_page_type"), "processed_page_count", meta["title"].alias("book_title"), meta["subtitle"].alias("subtitle"), F.array_join(meta["authors"], ",").alias("authors"), meta["language"].alias("language"),
    )
    assert got.filter("NOT accepted").count() == 0
    assert sorted(map(str, map(tuple, got.select(expected.columns).collect()))) == sorted(map(str, map(tuple, expected.collect())))
    openings = got.filter("toc_status = 'committed' AND n_toc > next_expected_opening_index")
    assert openings.count() == 0 or openings.filter("expected = ''").count() == 0


def test_pages_out_of_turn_are_rejected_and_change_nothing(spark):
    """A gap, a repeated page and a late one; with arrival numbers the order of arrival counts, within a micro-batch too."""
    one = made(spark, 22, books=1, most=2).drop("page_index").limit(1)
    rows = lambda *order: spark.createDataFrame([(p, k) for k, p in enumerate(order)], "page_index int, seq long").crossJoin(one).select(*stored(made(spark, 22, books=1), "m").columns, "seq")
    by_page = stream_in_parts([rows(0, 1, 3).drop("seq"), rows(1, 2, 3).drop("seq")])
    assert sorted((r.page_index, r.accepted, r.awaited, r.processed_page_count) for r in by_page.collect()) == [(0, True, 0, 1), (1, False, 2, 2), (1, True, 1, 2), (2, True, 2, 3), (3, False, 2, 2), (3, True, 3, 4)]
    by_arrival = stream_in_parts([rows(1, 0, 1, 2)], arrival=F.col("seq"))
    assert sorted((r.page_index, r.accepted) for r in by_arrival.collect()) == [(0, True), (1, False), (1, True), (2, True)]


class _Store:
    """A state that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.rows = [], None, []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "update":
                self.value = args[0]
            elif name in ("put", "appendList"):
                self.rows = [*(self.rows if name == "appendList" else []), *args[0]]
            elif name == "exists":
                return self.value is not None or bool(self.rows)
            elif name == "get":
                return iter(self.rows) if self.rows else self.value

        return call


def test_lists_are_asked_for_only_where_they_hold_something():
    stores = [_Store(), _Store(), _Store()]
    handle = type("Handle", (), {"getValueState": lambda *_: stores[0], "getListState": lambda _, name, __: stores[1 if name == "headings" else 2]})()
    reducer = PageReducer()
    reducer.init(handle)
    page = dict.fromkeys(_PAGE._fields) | {"page_type": "blank", "headings": "[]", "n_headings": 0}
    frame = lambda *kinds, at: pd.DataFrame([page | {"page_index": at + k, "arrival": at + k, "page_type": kind, "toc_json": '[{"title": "T"}]' if kind == "toc" else None} for k, kind in enumerate(kinds)])
    list(reducer.handleInputRows(("b",), iter([frame("blank", "blank", at=0)]), None))
    assert [s.calls for s in stores] == [["get", "update"], [], []]
    (out,) = reducer.handleInputRows(("b",), iter([frame("toc", "toc", at=2), frame("body", at=4)]), None)
    assert out.toc_status.tolist() == ["collecting", "collecting", "committed"] and out.expected.tolist() == ["", "", "T|T"]
    assert [s.calls[2:] if s is stores[0] else s.calls for s in stores] == [["get", "update"], [], ["appendList"]]
