"""Row types and closed value sets of the document model."""

from __future__ import annotations

# The closed string sets of the data model, in their declared order.
PAGE_TYPES = ("cover", "title", "copyright", "dedication", "toc", "preface", "chapter_opening", "body", "figure_page", "appendix", "bibliography", "index", "blank", "other")
TEXT_ROLES = ("book_title", "subtitle", "author", "chapter_title", "heading", "paragraph", "blockquote", "epigraph", "list_item", "caption", "running_header", "running_footer", "page_number", "other")
RELATIVE_SIZES = ("small", "body", "large", "extra_large")
ALIGNMENTS = ("left", "center", "right", "justified", "unknown")
STRUCTURE_KINDS = ("part", "chapter", "section", "subsection", "preface", "appendix", "bibliography", "index", "other")
TOC_STATUSES = ("not_seen", "collecting", "committed", "absent")
BLOCK_KINDS = ("text", "footnote", "figure", "separator")
INLINE_KINDS = ("text", "footnote_reference")
FURNITURE = ("running_header", "running_footer", "page_number")

SEGMENT = "STRUCT<kind: STRING, value: STRING>"
BBOX = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
STYLE = "STRUCT<font_family: STRING, font_size_pt: DOUBLE, relative_size: STRING, bold: BOOLEAN, italic: BOOLEAN, small_caps: BOOLEAN, alignment: STRING>"
BLOCK = (
    f"STRUCT<kind: STRING, role: STRING, content: ARRAY<{SEGMENT}>, label: STRING, caption: STRING, heading_level: INT, "
    f"continues_previous: BOOLEAN, continues_on_next_page: BOOLEAN, bbox: {BBOX}, style: {STYLE}, asset_sha256: STRING, block_id: STRING>"
)
TOC_ENTRY = "STRUCT<title: STRING, level: INT, kind: STRING, printed_page_label: STRING>"
OPENING = "STRUCT<kind: STRING, label: STRING, title: STRING, subtitle: STRING, level: INT>"
METADATA = "STRUCT<title: STRING, subtitle: STRING, authors: ARRAY<STRING>, language: STRING>"
HEADING = "STRUCT<level: INT, text: STRING, page_index: INT>"

PAGES = (
    f"book_id STRING, page_index INT, page_type STRING, printed_page_label STRING, opening {OPENING}, metadata {METADATA}, "
    f"toc_entries ARRAY<{TOC_ENTRY}>, blocks ARRAY<{BLOCK}>"
)

BBOX_1000 = "STRUCT<left: INT, top: INT, right: INT, bottom: INT>"
WIRE_BLOCK = (
    f"STRUCT<kind: STRING, role: STRING, segments: ARRAY<{SEGMENT}>, label: STRING, caption: STRING, heading_level: INT, bbox: {BBOX_1000}, "
    "relative_size: STRING, bold: BOOLEAN, italic: BOOLEAN, alignment: STRING, continues_previous: BOOLEAN, continues_on_next_page: BOOLEAN>"
)
WIRE_PAGE = f"STRUCT<page_type: STRING, printed_page_label: STRING, opening: {OPENING}, metadata: {METADATA}, toc_entries: ARRAY<{TOC_ENTRY}>, blocks: ARRAY<{WIRE_BLOCK}>>"

OUTPUT_FILE = "STRUCT<path: STRING, sha256: STRING, size_bytes: BIGINT>"
