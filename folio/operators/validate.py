"""Structural rules as columns; violations as rows; the accepted prefix of each book.

Every rule of a page is evaluated against the state before that page. Rules have ranks, so the
first violation of a book, which is where a reader stops, is a minimum over (page, rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import scan, state
from folio.operators.state import texts


def _order():
    return Window.partitionBy("book_id").orderBy("page_index")


def _previous_jump(levels: Column) -> Column:
    """Whether some level is more than one above the one before it."""
    return F.exists(F.transform(levels, lambda x, i: x > F.get(levels, i - 1) + 1), lambda jump: F.coalesce(jump, F.lit(False)))


def _facts() -> dict[str, Column]:
    """What rules and state read of a page alone, as flags, numbers and titles. They are taken before any window, so that no window or sort carries blocks."""
    blocks = F.col("blocks")
    toc, chapter = F.col("page_type") == "toc", F.col("page_type") == "chapter_opening"
    entries = F.col("toc_entries")
    titles, paragraphs = texts(blocks, "chapter_title"), texts(blocks, "paragraph")
    observed = F.coalesce(F.col("opening.title"), T.run_text(F.try_element_at(titles, F.lit(1))["content"]), F.lit(""))
    levels = F.transform(F.filter(texts(blocks, "heading"), lambda b: b["heading_level"].isNotNull()), lambda b: b["heading_level"])
    is_on = lambda name: lambda b: F.coalesce(b[name], F.lit(False))
    continuing, closing = F.filter(paragraphs, is_on("continues_previous")), F.filter(paragraphs, is_on("continues_on_next_page"))
    first_on, last_on = is_on("continues_previous")(F.get(paragraphs, F.lit(0))), is_on("continues_on_next_page")(F.try_element_at(paragraphs, F.lit(-1)))
    last = F.try_element_at(paragraphs, F.lit(-1))
    notes = F.transform(F.filter(blocks, lambda b: b["kind"] == "footnote"), lambda b: b["label"])
    refs = F.flatten(F.transform(F.filter(blocks, lambda b: b["kind"] == "text"), lambda b: F.transform(F.filter(b["content"], lambda s: s["kind"] == "footnote_reference"), lambda s: s["value"])))
    bare_figure = F.exists(blocks, lambda b: (b["kind"] == "figure") & b["bbox"].isNull())
    return {
        "_n_entries": F.size(entries),
        "_titles": F.when(toc, F.transform(entries, lambda e: e["title"])),
        "_observed": F.when(chapter, observed),
        "_open": F.when(~toc & last.isNotNull(), last_on & T.non_empty(T.state_text(last["content"]))),
        "_n_continuing": F.size(continuing),
        "_no_entries": toc & (F.size(entries) == 0),
        "_bad_entries": toc & (F.exists(entries, lambda e: T.strip(e["title"]) == "") | _previous_jump(F.transform(entries, lambda e: e["level"]))),
        "_untitled": chapter & (observed == "") & F.col("opening").isNull(),
        "_many_titles": chapter & (F.size(titles) > 1),
        "_jump": _previous_jump(levels),
        "_bad_layout": (F.size(continuing) > 1) | ((F.size(continuing) > 0) & ~first_on) | (F.size(closing) > 1) | ((F.size(closing) > 0) & ~last_on),
        "_doubled": F.size(F.array_distinct(notes)) < F.size(notes),
        "_unresolved": F.size(F.array_except(refs, notes)) > 0,
        "_orphan": F.size(F.array_except(notes, refs)) > 0,
        "_bare_figure": bare_figure & (F.col("page_type") != "figure_page"),
    }


def _compared() -> Column:
    """Pages whose title is held against the TOC's. Exact titles go through Python, so only these do."""
    return (F.col("page_type") == "chapter_opening") & (F.col("toc_status_before") == "committed")


def rules(same_page_footnotes: bool = True, figure_crops: bool = True, exact_titles: bool = True) -> list[tuple[str, Column]]:
    """(code, fails) in order of evaluation, over pages with ``_facts`` and the columns of ``with_state_before``."""
    toc, chapter, compared = F.col("page_type") == "toc", F.col("page_type") == "chapter_opening", _compared()
    observed, expected = F.col("_observed"), F.col("expected_title")
    is_open, continuing = F.col("open_before"), F.col("_n_continuing")
    out = [
        ("unexpected-toc", toc & F.col("toc_status_before").isin("committed", "absent")),
        ("invalid-toc-hierarchy", F.col("_no_entries")),
        ("invalid-toc-hierarchy", F.col("_bad_entries")),
        ("missing-chapter-title", F.col("_untitled")),
        ("multiple-chapter-titles", F.col("_many_titles")),
        ("unexpected-chapter", compared & (F.col("next_before") >= F.col("n_toc_before"))),
        ("toc-chapter-mismatch", compared & (T.normalized_title(F.when(compared, observed), exact_titles) != T.normalized_title(F.when(compared, expected), exact_titles))),
        ("heading-level-jump", F.col("_jump")),
        ("unclosed-paragraph", chapter & is_open),
        ("missing-continuation", is_open & (continuing == 0)),
        ("continuation-without-source", ~is_open & (continuing > 0)),
        ("invalid-continuation-layout", F.col("_bad_layout")),
    ]
    if same_page_footnotes:
        out += [("duplicate-footnote-label", F.col("_doubled")), ("unresolved-footnote", F.col("_unresolved")), ("orphan-footnote", F.col("_orphan"))]
    if figure_crops:
        out.append(("figure-crop-unavailable", F.col("_bare_figure")))
    return out


def with_state_before(pages: DataFrame) -> DataFrame:
    """Adds what the rules read of the state before each page, and _last, whether it is its book's last: from a scan (``scan.with_state``)
    where there is one, or by windows over all of the book's pages, which carry facts instead of pages and lists."""
    if "before" in pages.columns:
        was = F.col("before")
        known = {"n_toc_before": was["n_toc"], "next_before": was["next_expected_opening_index"], "expected_title": F.get("expected_entries", F.lit(0))["title"], "open_before": T.non_empty(scan.open_tail(was))}
        known |= {"next_after": F.col("next_expected_opening_index"), "open_after": T.non_empty(scan.open_tail(F.col("state")))}
        return pages.withColumns(known).withColumn("_last", F.lead("page_index").over(_order()).isNull())
    step = state.counted(pages).withColumn("_last", F.lead("page_index").over(_order()).isNull())
    return state.with_expected_title(step, _compared())


def _ends(last: Column, rank: int) -> list[Column]:
    """The rules of a book's last page."""
    ends = (("toc-not-exhausted", (F.col("toc_status") == "committed") & (F.col("next_after") < F.col("n_toc"))), ("unclosed-paragraph", F.col("open_after")))
    return [F.when(last & F.coalesce(fails, F.lit(False)), F.struct(F.lit(rank + k).alias("rule_rank"), F.lit(code).alias("code"))) for k, (code, fails) in enumerate(ends)]


def with_failed(states: DataFrame, whole_books: bool = False, page_counts: DataFrame | None = None, **options) -> DataFrame:
    """Adds _failed, the (rule_rank, code) of each rule that fails on the page, in order, to pages or to pages with a state.

    The rules of a book's end hold on its last page: with ``page_counts`` (book_id, page_count) that is the
    page with that number, and a book without a count has no end yet; with ``whole_books`` it is the last page there is."""
    table = rules(**options)
    failed = [F.when(F.coalesce(fails, F.lit(False)), F.struct(F.lit(rank).alias("rule_rank"), F.lit(code).alias("code"))) for rank, (code, fails) in enumerate(table)]
    if "wire_error" in states.columns:  # a page that was rejected when it was read comes before every rule
        failed.insert(0, F.when(F.col("wire_error").isNotNull(), F.struct(F.lit(-1).alias("rule_rank"), F.col("wire_error").alias("code"))))
    pages = with_state_before(states.withColumns(_facts()))
    if page_counts is not None:
        pages = pages.join(page_counts.select("book_id", F.col("page_count").alias("_count")), "book_id", "left")
        failed += _ends(F.coalesce(F.col("page_index") + 1 == F.col("_count"), F.lit(False)), len(table))
    elif whole_books:
        failed += _ends(F.col("_last"), len(table))
    return pages.withColumn("_failed", F.array_compact(F.array(*failed))).select(*states.columns, "_failed")


def failures(checked: DataFrame) -> DataFrame:
    """One row per page and failed rule of ``with_failed``: book_id, page_index, rule_rank, code."""
    found = checked.select("book_id", "page_index", F.explode_outer("_failed").alias("v")).filter("v is not null")  # explode alone would have the rules evaluated twice
    return found.select("book_id", "page_index", "v.rule_rank", "v.code")


def violations(states: DataFrame, *, whole_books: bool = False, page_counts: DataFrame | None = None, **options) -> DataFrame:
    """One row per page and failed rule: book_id, page_index, rule_rank, code (see ``with_failed``)."""
    return failures(with_failed(states, whole_books, page_counts, **options))


def accepted(states: DataFrame, *, whole_books: bool = False, tasks: int | None = None, **options) -> DataFrame:
    """The pages before each book's first violation, with their states where they have one.

    ``tasks``: over how many the books are dealt for it, as titles' way through Python gives up the windows' partitioning."""
    checked = with_failed(states, whole_books, **options)
    checked = checked.repartition(tasks, "book_id") if tasks else checked
    stop = F.min(F.when(F.size("_failed") > 0, F.col("page_index"))).over(Window.partitionBy("book_id"))
    return checked.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("page_index") < F.col("_stop"))).select(*states.columns)


def first_violation(found: DataFrame) -> DataFrame:
    """Per book the violation at which processing stops."""
    best = F.min(F.struct("page_index", "rule_rank", "code"))
    return found.groupBy("book_id").agg(best.alias("v")).select("book_id", "v.page_index", "v.code")


def accepted_prefix(pages: DataFrame, found: DataFrame, tasks: int | None = None) -> DataFrame:
    """The pages before each book's first violation, for violations that are stored already."""
    stops = first_violation(found).select("book_id", F.col("page_index").alias("_stop"))
    return scan.dealt_join(pages, stops, tasks, ["book_id"], "left").filter(F.col("_stop").isNull() | (F.col("page_index") < F.col("_stop"))).drop("_stop")


def unresolved_references(blocks: DataFrame) -> DataFrame:
    """References in text blocks without a note on their page: left anti join."""
    return references(blocks).join(notes(blocks), ["book_id", "page_index", "label"], "left_anti")


def orphan_notes(blocks: DataFrame) -> DataFrame:
    """Notes that no text block of their page refers to: left anti join the other way."""
    return notes(blocks).join(references(blocks), ["book_id", "page_index", "label"], "left_anti")


def references(blocks: DataFrame) -> DataFrame:
    inline = blocks.filter("kind = 'text'").select("book_id", "page_index", F.explode("content").alias("s"))
    return inline.filter("s.kind = 'footnote_reference'").select("book_id", "page_index", F.col("s.value").alias("label")).distinct()


def notes(blocks: DataFrame) -> DataFrame:
    return blocks.filter("kind = 'footnote'").select("book_id", "page_index", "label").distinct()
