"""Made pages and wire texts in which each rule fires and just does not, one book or row a case, repeated
for every row of ``nation``."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.schemas import PAGES
from folio.sources.carriers import load


def _text(role: str, *runs: str, **more: Any) -> dict[str, Any]:
    """A text block; a run that begins with ^ is a reference."""
    content = [("footnote_reference", x[1:]) if x[0] == "^" else ("text", x) for x in runs]
    return {"kind": "text", "role": role, "content": content, "continues_previous": False, "continues_on_next_page": False} | more


def _paragraph(*runs: str, on: bool = False, before: bool = False) -> dict[str, Any]:
    return _text("paragraph", *(runs or ("x",)), continues_on_next_page=on, continues_previous=before)


def _note(label: str) -> dict[str, Any]:
    return {"kind": "footnote", "label": label, "content": [("text", "n")]}


def _page(kind: str = "body", *blocks: dict[str, Any], toc: tuple = (), opening: str | None = None) -> dict[str, Any]:
    return {"page_type": kind, "blocks": blocks, "toc_entries": toc, "opening": (("chapter", None, opening, None, 1) if opening is not None else None)}


def _chapter(title: str, *blocks: dict[str, Any]) -> dict[str, Any]:
    return _page("chapter_opening", _text("chapter_title", title), *blocks)


def _toc(*entries: tuple[str, int]) -> dict[str, Any]:
    return _page("toc", toc=tuple((title, level, "chapter", None) for title, level in entries))


def _figure(box: tuple | None = None) -> dict[str, Any]:
    return {"kind": "figure", "label": "F", "bbox": box}


def _heading(level: int) -> dict[str, Any]:
    return _text("heading", "h", heading_level=level)


#: case: pages of a book.
RULE_CASES: dict[str, list[dict[str, Any]]] = {
    "toc-after-commit": [_toc(("One", 1)), _page(), _toc(("Two", 1)), _chapter("One")],
    "toc-on-two-pages": [_toc(("One", 1)), _toc(("Two", 1)), _chapter("One"), _chapter("Two")],
    "toc-empty": [_toc()],
    "toc-blank-title": [_toc(("  ", 1))],
    "toc-jump": [_toc(("One", 1), ("Deep", 3))],
    "toc-steps": [_toc(("One", 1), ("In", 2), ("Two", 1)), _chapter("One"), _chapter("In"), _chapter("Two")],
    "chapter-untitled": [_page("chapter_opening", _paragraph())],
    "chapter-by-opening": [_page("chapter_opening", _paragraph(), opening="One")],
    "chapter-two-titles": [_chapter("One", _text("chapter_title", "Two"))],
    "chapter-beyond-toc": [_toc(("One", 1)), _chapter("One"), _chapter("Two")],
    "chapter-other-title": [_toc(("One", 1)), _chapter("Two")],
    "chapter-folded-title": [_toc(("Straße é ....", 1)), _chapter("STRASSE é:")],
    "heading-jump": [_page("body", _heading(1), _heading(3))],
    "heading-steps": [_page("body", _heading(2), _heading(3), _heading(1))],
    # paragraphs are followed within a section only, so these books begin with one
    "chapter-in-paragraph": [_chapter("One"), _page("body", _paragraph(on=True)), _chapter("One", _paragraph(before=True))],
    "not-continued": [_chapter("One"), _page("body", _paragraph(on=True)), _page("body", _paragraph())],
    "continued": [_chapter("One"), _page("body", _paragraph(on=True)), _page("body", _paragraph(before=True))],
    "outside-a-section": [_page("body", _paragraph(on=True)), _page("body", _paragraph())],
    "continued-from-nothing": [_page("body", _paragraph(before=True))],
    "two-continue": [_chapter("One"), _page("body", _paragraph(on=True)), _page("body", _paragraph(before=True), _paragraph(before=True))],
    "second-continues": [_chapter("One"), _page("body", _paragraph(on=True)), _page("body", _paragraph(), _paragraph(before=True))],
    "two-go-on": [_chapter("One"), _page("body", _paragraph(on=True), _paragraph(on=True)), _page("body", _paragraph(before=True))],
    "first-goes-on": [_chapter("One"), _page("body", _paragraph(on=True), _paragraph())],
    "notes-doubled": [_page("body", _paragraph("a", "^1"), _note("1"), _note("1"))],
    "note-missing": [_page("body", _paragraph("a", "^1", "^2"), _note("1"))],
    "note-orphan": [_page("body", _paragraph("a", "^1"), _note("1"), _note("2"))],
    "notes-matched": [_page("body", _paragraph("a", "^1", "^2", "^1"), _note("1"), _note("2"))],
    "figure-without-box": [_page("body", _figure())],
    "figure-with-box": [_page("body", _figure((0.0, 0.0, 1.0, 1.0)))],
    "figure-page": [_page("figure_page", _figure())],
    "toc-not-used-up": [_toc(("One", 1), ("Two", 1)), _chapter("One")],
    "ends-open": [_chapter("One"), _page("body", _paragraph(on=True))],
    "quote-goes-on": [_page("body", _text("blockquote", "q", continues_on_next_page=True)), _page()],
}

_BLOCK = ("kind", "role", "content", "label", "caption", "heading_level", "continues_previous", "continues_on_next_page", "bbox", "style", "asset_sha256", "block_id")


def _for_each_nation(spark: SparkSession, sf_dir: str, cases: list[dict[str, Any]], kind: str) -> DataFrame:
    """Each row of ``nation`` with all cases; these are one constant, so nothing is joined."""
    each = F.explode(F.from_json(F.lit(json.dumps(cases)), f"array<struct<{kind}>>")).alias("c")
    return load(spark, sf_dir, "nation").select("n_nationkey", each).select("n_nationkey", "c.*")


def rule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of RULE_CASES; a book is named <nation>-<case>."""

    def block(b: dict[str, Any]) -> dict[str, Any]:
        given = dict.fromkeys(_BLOCK) | {"continues_previous": False, "continues_on_next_page": False} | b
        content = None if given["content"] is None else [{"kind": k, "value": v} for k, v in given["content"]]
        return given | {"content": content, "bbox": given["bbox"] and dict(zip(("x0", "y0", "x1", "y1"), given["bbox"], strict=True))}

    rows = [
        {
            "book_id": case, "page_index": k, "page_type": page["page_type"], "blocks": [block(b) for b in page["blocks"]],
            "opening": page["opening"] and dict(zip(("kind", "label", "title", "subtitle", "level"), page["opening"], strict=True)),
            "toc_entries": [dict(zip(("title", "level", "kind", "printed_page_label"), e, strict=True)) for e in page["toc_entries"]],
        }
        for case, pages in RULE_CASES.items() for k, page in enumerate(pages)
    ]
    pages = _for_each_nation(spark, sf_dir, rows, PAGES)
    return pages.withColumn("book_id", F.concat_ws("-", F.col("n_nationkey").cast("string"), "book_id")).drop("n_nationkey")


_SEGMENT = {"kind": "text", "value": "v"}
_GOOD_BLOCK = {"kind": "text", "role": "paragraph", "segments": [_SEGMENT]}
_GOOD_BOX = {"left": 0, "top": 0, "right": 1000, "bottom": 1000}
_ENTRY = {"title": "t", "level": 1, "kind": "chapter"}


def _with(**more: Any) -> str:
    return json.dumps({"page_type": "body"} | more)


def _with_block(**more: Any) -> str:
    return _with(blocks=[_GOOD_BLOCK | more])


#: form: wire text.
WIRE_FORMS: dict[str, str] = {
    "least": _with(), "full block": _with_block(bbox=_GOOD_BOX, relative_size="large", bold=True, italic=None, alignment="left", heading_level=6, continues_previous=True),
    "full page": _with(printed_page_label=None, opening=_ENTRY, metadata={"title": None, "authors": ["A"]}, toc_entries=[_ENTRY, _ENTRY | {"printed_page_label": "5"}], blocks=[]),
    "nulls": _with(opening=None, metadata=None, blocks=[_GOOD_BLOCK, {"kind": "separator", "bbox": None, "label": None}]),
    "no json": "{", "no text": "", "a list": "[]", "a string": '"x"', "no page type": "{}", "other page type": _with(page_type="leaflet"), "page key": _with(odd=1),
    "blocks no list": _with(blocks="no"), "block no object": _with(blocks=[1]), "null block": _with(blocks=[_GOOD_BLOCK, None]), "block key": _with_block(odd=1), "block kind": _with_block(kind="verse"),
    "no block kind": _with(blocks=[{"role": "paragraph"}]), "role": _with_block(role="nobody"), "text without role": _with(blocks=[{"kind": "text"}]), "note without label": _with(blocks=[{"kind": "footnote"}]),
    "heading level 7": _with_block(heading_level=7), "heading level 0": _with_block(heading_level=0), "heading level 1.5": _with_block(heading_level=1.5), "size": _with_block(relative_size="huge"),
    "alignment": _with_block(alignment="diagonal"), "bold no flag": _with_block(bold="very"), "null continues": _with_block(continues_previous=None), "segments null": _with_block(segments=None),
    "segment key": _with_block(segments=[_SEGMENT | {"odd": 1}]), "segment kind": _with_block(segments=[{"kind": "link", "value": "v"}]), "segment without value": _with_block(segments=[{"kind": "text"}]),
    "box key": _with_block(bbox=_GOOD_BOX | {"odd": 1}), "box with one corner": _with_block(bbox={"left": 1}), "box too far": _with_block(bbox=_GOOD_BOX | {"right": 1001}), "box below": _with_block(bbox=_GOOD_BOX | {"top": -1}),
    "opening key": _with(opening=_ENTRY | {"odd": 1}), "opening without level": _with(opening={"kind": "chapter", "title": "t"}), "opening kind": _with(opening=_ENTRY | {"kind": "verse"}), "opening without title": _with(opening={"kind": "chapter", "level": 1}),
    "entry key": _with(toc_entries=[_ENTRY | {"odd": 1}]), "entry level 9": _with(toc_entries=[_ENTRY | {"level": 9}]), "entry kind": _with(toc_entries=[_ENTRY | {"kind": "verse"}]), "entry without title": _with(toc_entries=[{"level": 1, "kind": "chapter"}]),
    "metadata key": _with(metadata={"odd": 1}), "authors no list": _with(metadata={"authors": "A"}), "author no string": _with(metadata={"authors": [1]}), "title no string": _with(metadata={"title": 5}),
}


def wire_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_nationkey, form, json."""
    return _for_each_nation(spark, sf_dir, [{"form": k, "json": v} for k, v in WIRE_FORMS.items()], "form: string, json: string")
