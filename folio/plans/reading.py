"""Interpretation with context in one pass: pages of many books, each book's in order, inside tasks.

Books are dealt to tasks and a task's rows sorted by page, then book, so the pages that stand next
to each other belong to different books and go to the interpreter as one batch; what a book's page
may know of the pages before is kept in the task, a state of a few fields a book. After a batch its
responses are folded into the books' states, before the next pages are asked for. Nothing is
evaluated twice, however long a book is.

A book stops at a page that does not follow its state, and after a response that cannot be read as
a page: what follows would be interpreted in a wrong context, and is not. Such pages come back with
a null response.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from types import SimpleNamespace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.state import EXPECTED_ENTRIES, RECENT_HEADINGS, TAIL_CHARS
from folio.streaming.reducer import START, apply_page

_BATCH = 64  # pages that go to the interpreter at once
_ROWS = 1024  # rows that go back to Spark at once
_KNOWN = "book_id string, state_json string, toc_json string"


def page_of(response: str) -> SimpleNamespace | None:
    """What the state needs of a response, or None where it is no page."""
    try:
        page = json.loads(response)
        text = lambda block: "".join(s["value"] for s in block.get("segments") or [])
        blocks = [b for b in page.get("blocks") or [] if b["kind"] == "text"]
        of = lambda role: [b for b in blocks if b["role"] == role]
        opening, metadata = page.get("opening") or {}, page.get("metadata") or {}
        toc = page["page_type"] == "toc"
        headings = [] if toc else [{"level": b["heading_level"], "text": text(b), "page_index": None} for b in of("heading") if b.get("heading_level") is not None]
        last = None if toc or not of("paragraph") else of("paragraph")[-1]
        titles = of("chapter_title")
        return SimpleNamespace(
            page_type=page["page_type"], toc_json=json.dumps(page.get("toc_entries") or []), kind=opening.get("kind") or "chapter", section_title=opening["title"] if opening else text(titles[0]) if titles else "",
            headings=headings, n_headings=len(headings), tail_open=bool(last and last.get("continues_on_next_page")), tail_text=text(last)[-TAIL_CHARS:] if last else None,
            title=metadata.get("title"), subtitle=metadata.get("subtitle"), authors=metadata.get("authors") or None, language=metadata.get("language"),
        )
    except (ValueError, TypeError, KeyError, AttributeError):
        return None


class Book:
    """What is known of a book: the reducer's state, its last headings, its TOC."""

    def __init__(self, state: dict[str, Any] | None = None, headings: list[tuple] | None = None, toc: list[dict] | None = None) -> None:
        self.state, self.headings, self.toc, self.stopped = state or dict(START), headings or [], toc or [], False

    def context(self) -> str:
        s = self.state
        at, there = s["opened"], s["section_page"] is not None
        return json.dumps({
            "book_title": s["title"], "authors": s["authors"] or [], "toc_status": s["status"], "expected_toc_entries": self.toc[at : at + EXPECTED_ENTRIES] if s["status"] == "committed" else [],
            "current_section_title": s["section_title"] if there else None, "current_section_headings": [dict(zip(("level", "text", "page_index"), h, strict=True)) for h in self.headings] if there else None,
            "open_paragraph_tail": s["tail"] if there else None, "previous_page_type": s["last_type"],
        }, ensure_ascii=False)

    def take(self, page_index: int, response: str | None) -> None:
        page = None if response is None else page_of(response)
        if page is None:
            self.stopped = True
            return
        page.page_index = page_index
        page.headings = json.dumps([h | {"page_index": page_index} for h in page.headings][-RECENT_HEADINGS:])
        self.toc += apply_page(self.state, self.headings, page)


def _missing(value: object) -> bool:
    return value is None or value != value


def _stored(snapshots: DataFrame) -> DataFrame:
    """Snapshots (scan.SNAPSHOT) as the tasks read them."""
    s, part = F.col("state"), F.col("state.section")
    flat = F.struct(
        s["processed_page_count"].alias("pages"), s["toc_status"].alias("status"), s["n_toc"].alias("entries"), s["next_expected_opening_index"].alias("opened"), part["kind"].alias("section_kind"), part["title"].alias("section_title"),
        part["toc_index"].alias("section_index"), part["started_on_page"].alias("section_page"), F.coalesce(part["n_headings"], F.lit(0)).alias("n_headings"), F.when(part["tail"]["open"], part["tail"]["text"]).alias("tail"),
        s["previous_page_type"].alias("last_type"), s["book_metadata"]["title"].alias("title"), s["book_metadata"]["subtitle"].alias("subtitle"), s["book_metadata"]["authors"].alias("authors"), s["book_metadata"]["language"].alias("language"), part["recent_headings"].alias("recent"),
    )
    return snapshots.select("book_id", F.to_json(flat, {"ignoreNullFields": "false"}).alias("state_json"), F.to_json("toc", {"ignoreNullFields": "false"}).alias("toc_json"))


def interpreted(raw: DataFrame, name: str, snapshots: DataFrame | None = None, batch: int = _BATCH) -> DataFrame:
    """raw: book_id, page_index, content. Rows with context (JSON) and response (wire JSON, null past a book's stop).

    ``snapshots`` are the states to go on from; a book without one starts at its page 0."""
    from folio.plans.flows import INTERPRETERS

    call = INTERPRETERS[name]
    if snapshots is None:
        known = raw.select("*", F.lit(None).cast("string").alias("state_json"), F.lit(None).cast("string").alias("toc_json"))
    else:  # the state travels with a book's first page only
        first = raw.groupBy("book_id").agg(F.min("page_index").alias("page_index"))
        known = raw.join(first.join(_stored(snapshots), "book_id"), ["book_id", "page_index"], "left")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books: dict[str | None, Book] = {}
        done: list[tuple] = []

        def answered(pages: list[tuple]) -> None:
            seen: set[str | None] = set()
            again = [page for page in pages if page[0] in seen or seen.add(page[0])]
            if again:  # a page that is given twice: its book has gone on by then
                kept: set[str | None] = set()
                answered([page for page in pages if not (page[0] in kept or kept.add(page[0]))])
                answered(again)
                return
            asked: list[tuple] = []
            for book_id, page_index, content, state_json, toc_json in pages:
                if not _missing(state_json):
                    state = json.loads(state_json)
                    recent = [(h["level"], h["text"], h["page_index"]) for h in state.pop("recent") or []]
                    books[book_id] = Book(state, recent, json.loads(toc_json))
                book = books.setdefault(book_id, Book())
                book.stopped |= book.state["pages"] != page_index
                if not book.stopped:
                    asked.append((book_id, page_index, content, book.context()))
            responses: dict[str | None, tuple[str, str | None]] = {}
            if asked:
                given = pd.DataFrame(asked, columns=["book_id", "page_index", "content", "context"])
                answer = call(given)
                values = (answer.reindex(given.index) if isinstance(answer, pd.Series) else pd.Series(answer)).tolist()
                for (book_id, page_index, _, context), value in zip(asked, values, strict=True):
                    response = None if _missing(value) else value
                    books[book_id].take(int(page_index), response)
                    responses[book_id] = context, response
            done.extend((page[0], page[1], *responses.get(page[0], (None, None))) for page in pages)

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(done, columns=["book_id", "page_index", "context", "response"])
            done.clear()
            return frame

        waiting: list[tuple] = []
        for frame in frames:
            columns = [frame[name].tolist() for name in ("book_id", "page_index", "content", "state_json", "toc_json")]
            # pages of one number are one batch; a batch is also cut where it is full
            for book_id, *page in zip(*columns, strict=True):
                if waiting and (waiting[-1][1] != page[0] or len(waiting) >= batch):
                    answered(waiting)
                    waiting = []
                    if len(done) >= _ROWS:
                        yield out()
                waiting.append((None if _missing(book_id) else book_id, *page))
        if waiting:
            answered(waiting)
        if done:
            yield out()

    dealt = known.select("book_id", F.col("page_index").cast("int").alias("page_index"), "content", "state_json", "toc_json").repartition("book_id").sortWithinPartitions("page_index", "book_id")
    return dealt.mapInPandas(read, "book_id string, page_index int, context string, response string")
