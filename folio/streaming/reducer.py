"""The page reducer as a stateful stream operator: one state a book, pages in order.

A page whose index is not the next one of its book is rejected, not buffered, and comes back as a
row of its own. The batch windows in ``folio.operators.state`` give the same states.

``advance`` and ``state_stream`` keep the TOC status only. ``PageReducer`` keeps the whole state: a
value for the fields of fixed size, lists for the last headings of the section and for the TOC,
so that a page that adds to neither rewrites neither.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.operators.scan import page_summaries
from folio.operators.state import EXPECTED_ENTRIES, RECENT_HEADINGS

OUTPUT = "book_id string, page_index int, toc_status string, next_expected_opening_index int, accepted boolean"
_STATE = "pages int, status string, entries int, opened int"


def advance(state: tuple[int, str, int, int], page_type: str, entries: int) -> tuple[int, str, int, int]:
    """State after a page: pages seen, TOC status, TOC entries, openings matched."""
    pages, status, held, opened = state
    if status == "collecting" and page_type != "toc":
        status = "committed" if held else "absent"
    if page_type == "toc":
        if status in ("not_seen", "collecting"):
            status, held = "collecting", held + entries
        return pages + 1, status, held, opened
    if status == "not_seen" and page_type in ("chapter_opening", "body"):
        status = "absent"
    return pages + 1, status, held, opened + (page_type == "chapter_opening" and status == "committed")


def _step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (0, "not_seen", 0, 0)
    rows = []
    for page in pd.concat(list(frames)).sort_values("page_index").itertuples(index=False):
        ok = page.page_index == now[0]
        if ok:
            now = advance(now, page.page_type, page.entries)
        rows.append((key[0], page.page_index, now[1], now[3], ok))
    state.update(now)
    yield pd.DataFrame(rows, columns=["book_id", "page_index", "toc_status", "next_expected_opening_index", "accepted"])


def state_stream(pages: DataFrame) -> DataFrame:
    """pages: a stream (or table) of book_id, page_index, page_type, toc_entries."""
    slim = pages.select("book_id", F.col("page_index").cast("int").alias("page_index"), "page_type", F.size("toc_entries").alias("entries"))
    return slim.groupBy("book_id").applyInPandasWithState(_step, OUTPUT, _STATE, "append", "NoTimeout")


_VALUE = (
    "pages int, status string, entries int, opened int, section_kind string, section_title string, section_index int, section_page int, n_headings int, "
    "tail string, last_type string, title string, subtitle string, authors string, language string"
)
_HEADING = "level int, text string, page_index int"
_ENTRY = "title string, level int, kind string, printed_page_label string"
FULL = (
    "book_id string, page_index int, accepted boolean, awaited int, toc_status string, n_toc int, next_expected_opening_index int, section_kind string, section_title string, toc_index int, started_on_page int, "
    "n_headings int, recent_headings string, open_paragraph_tail string, last_page_type string, processed_page_count int, book_title string, subtitle string, authors string, language string, expected string"
)
START: dict[str, Any] = dict.fromkeys(part.split()[0] for part in _VALUE.split(", ")) | {"pages": 0, "status": "not_seen", "entries": 0, "opened": 0, "n_headings": 0}


def reduced_pages(pages: DataFrame, arrival: Column | None = None) -> DataFrame:
    """What the reducer needs of each page, flat; lists of headings and entries as JSON."""
    entries = F.to_json(F.when(F.col("page_type") == "toc", F.col("toc_entries"))).alias("toc_json")
    keyed = page_summaries(pages, entries, (F.col("page_index") if arrival is None else arrival).cast("long").alias("arrival"))
    return keyed.select(
        "book_id", F.col("start").alias("page_index"), "arrival", F.col("last_type").alias("page_type"), "toc_json", F.col("section.kind").alias("kind"), F.col("section.title").alias("section_title"),
        F.to_json("recent").alias("headings"), "n_headings", F.col("tail.open").alias("tail_open"), F.col("tail.text").alias("tail_text"), "title", "subtitle", F.array_join("authors", ",").alias("authors"), "language",
    )


def apply_page(now: dict[str, Any], headings: list[tuple], page: Any) -> list[dict[str, Any]]:
    """Changes the state and the last headings by a page; returns the TOC entries that it adds."""
    for name in ("title", "subtitle", "authors", "language"):
        now[name] = now[name] or getattr(page, name)
    now["pages"], now["last_type"] = now["pages"] + 1, page.page_type
    if now["status"] == "collecting" and page.page_type != "toc":
        now["status"] = "committed" if now["entries"] else "absent"
    if page.page_type == "toc":
        if now["status"] not in ("not_seen", "collecting"):
            return []
        added = json.loads(page.toc_json or "[]")
        now["status"], now["entries"] = "collecting", now["entries"] + len(added)
        return added
    if now["status"] == "not_seen" and page.page_type in ("chapter_opening", "body"):
        now["status"] = "absent"
    if page.page_type == "chapter_opening":
        now |= {"section_kind": page.kind, "section_title": page.section_title, "section_index": now["opened"], "section_page": int(page.page_index), "n_headings": 0, "tail": None}
        headings.clear()
        now["opened"] += now["status"] == "committed"
    if now["section_page"] is not None:
        headings += [(h["level"], h["text"], h["page_index"]) for h in json.loads(page.headings)]
        del headings[:-RECENT_HEADINGS]
        now["n_headings"] += int(page.n_headings)
        if page.tail_text is not None:
            now["tail"] = page.tail_text if page.tail_open else None
    return []


_PAGE = namedtuple("_PAGE", "book_id page_index arrival page_type toc_json kind section_title headings n_headings tail_open tail_text title subtitle authors language")


def _in_order(frames: Iterator[pd.DataFrame]) -> list[_PAGE]:
    """A book's pages by arrival, as plain values; what is missing is None."""
    plain = lambda column: [None if x is None or x != x else x for x in column.tolist()]
    pages = [_PAGE(*values) for frame in frames for values in zip(*[plain(frame[name]) for name in _PAGE._fields], strict=True)]
    return sorted(pages, key=lambda page: page.arrival)


class PageReducer(StatefulProcessor):
    """Rows of ``reduced_pages`` to FULL rows, one for each page that came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._value = handle.getValueState("state", _VALUE)
        self._headings = handle.getListState("headings", _HEADING)
        self._toc = handle.getListState("toc", _ENTRY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # each call to the store is a round trip, so lists are asked for only where the value says that they hold something
        stored = self._value.get()
        now = dict(START) if stored is None else dict(zip(START, stored, strict=True))
        headings = [tuple(h) for h in self._headings.get()] if now["n_headings"] else []
        toc = [h[0] for h in self._toc.get()] if now["entries"] else []
        before, out, new = list(headings), [], []
        for page in _in_order(rows):
            awaited = now["pages"]
            ok = page.page_index == awaited
            if ok and (added := apply_page(now, headings, page)):
                new += [tuple(e.get(name) for name in ("title", "level", "kind", "printed_page_label")) for e in added]
                toc += [e.get("title") for e in added]
            there = now["section_page"] is not None
            expected = toc[now["opened"] : now["opened"] + EXPECTED_ENTRIES] if now["status"] == "committed" else []
            out.append((
                key[0], int(page.page_index), ok, awaited, now["status"], now["entries"], now["opened"], now["section_kind"], now["section_title"], now["section_index"], now["section_page"], now["n_headings"] if there else None,
                ";".join("/".join(map(str, h)) for h in headings) if there else None, now["tail"] if there else None, now["last_type"], now["pages"], now["title"], now["subtitle"], now["authors"] or "", now["language"], "|".join(t or "" for t in expected),
            ))
        if new:
            self._toc.appendList(new)
        self._value.update(tuple(now.values()))
        if headings != before:
            self._headings.put(headings) if headings else self._headings.clear()
        yield pd.DataFrame(out, columns=[part.split()[0] for part in FULL.split(", ")])

    def close(self) -> None:
        pass


def full_stream(pages: DataFrame, arrival: Column | None = None) -> DataFrame:
    """pages: a stream of page records. States after each page, and a row for each page that was not the awaited one.

    Pages of a book that come in one micro-batch are taken by ``arrival`` (a sequence number of the source), or, as a
    micro-batch has no order of its own, by page. What a micro-batch brings of one book is held in memory, without texts."""
    return reduced_pages(pages, arrival).groupBy("book_id").transformWithStateInPandas(PageReducer(), FULL, "Append", "None")
