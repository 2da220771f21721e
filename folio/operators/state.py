"""The running state of every book, as windows instead of a loop over pages.

All windows share one partitioning by ``book_id``: one exchange, however many columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T

RECENT_HEADINGS, TAIL_CHARS, EXPECTED_ENTRIES = 12, 500, 3


def _order():
    return Window.partitionBy("book_id").orderBy("page_index")


def _so_far():
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def _book():
    return Window.partitionBy("book_id")


def texts(blocks: Column, role: str) -> Column:
    return F.filter(blocks, lambda b: (b["kind"] == "text") & (b["role"] == role))


def with_block_ids(pages: DataFrame) -> DataFrame:
    named = F.transform("blocks", lambda b, i: b.withField("block_id", T.block_id(F.col("page_index"), i)))
    return pages.withColumn("blocks", named)


def blocks_of(pages: DataFrame) -> DataFrame:
    """One row per block: book_id, page_index, pos, and the block's fields."""
    return pages.select("book_id", "page_index", "page_type", F.posexplode("blocks").alias("pos", "b")).select("book_id", "page_index", "page_type", "pos", "b.*")


def _toc_steps(pages: DataFrame, n_entries: Column) -> DataFrame:
    """Adds toc_status, toc_status_before, _run (the page's entries are the TOC's) and _matched (an opening that counts). Page types and numbers of entries are all that it reads."""
    is_toc = F.col("page_type") == "toc"
    p = F.col("page_index")
    step = pages.withColumn("_ft", F.min(F.when(is_toc, p)).over(_book())).withColumn("_fc", F.min(F.when(F.col("page_type").isin("chapter_opening", "body"), p)).over(_book()))
    step = step.withColumn("_ok", F.col("_ft").isNotNull() & (F.col("_fc").isNull() | (F.col("_ft") < F.col("_fc"))))
    step = step.withColumn("_fn", F.min(F.when(F.col("_ok") & (p > F.col("_ft")) & ~is_toc, p)).over(_book()))
    in_run = F.col("_ok") & (p >= F.col("_ft")) & (F.col("_fn").isNull() | (p < F.col("_fn")))
    step = step.withColumn("_run", in_run).withColumn("_total", F.sum(F.when(F.col("_run"), n_entries).otherwise(0)).over(_book()))
    ended = F.when(F.col("_total") > 0, "committed").otherwise("absent")
    status = (
        F.when(F.col("_ok"), F.when(p < F.col("_ft"), "not_seen").when(F.col("_run"), "collecting").otherwise(ended))
        .when(F.col("_fc").isNotNull() & (p >= F.col("_fc")), "absent")
        .otherwise("not_seen")
    )
    step = step.withColumn("toc_status", status)
    before = F.coalesce(F.lag("toc_status").over(_order()), F.lit("not_seen"))
    step = step.withColumn("toc_status_before", F.when((before == "collecting") & ~is_toc, ended).otherwise(before))
    opens = (F.col("page_type") == "chapter_opening") & (F.col("toc_status") == "committed")
    return step.withColumn("_matched", opens).drop("_ft", "_fc", "_ok", "_fn", "_total")


def toc_columns(pages: DataFrame) -> DataFrame:
    """Adds toc_status and toc after each page, toc_status_before (with a TOC that ended finalised),
    next_expected_opening_index after each page, previous_page_type and processed_page_count."""
    return _toc_steps(pages, F.size("toc_entries")).select(
        *pages.columns,
        "toc_status",
        "toc_status_before",
        F.flatten(F.collect_list(F.when(F.col("_run"), F.col("toc_entries"))).over(_so_far())).alias("toc"),
        F.sum(F.col("_matched").cast("int")).over(_so_far()).cast("int").alias("next_expected_opening_index"),
        "_matched",
        F.lag("page_type").over(_order()).alias("previous_page_type"),
        (F.col("page_index") + 1).alias("processed_page_count"),
    )


def counted(pages: DataFrame) -> DataFrame:
    """The state that rules are held against, as flags and numbers: no list of the state, however long, is in a row.

    Needs _n_entries and _open (whether the page's last paragraph goes on; null where that says nothing). Adds
    toc_status, toc_status_before, _run, n_toc_before and n_toc, next_before and next_after, open_before and open_after."""
    chapter = F.coalesce(F.col("page_type") == "chapter_opening", F.lit(False))
    step = _toc_steps(pages, F.col("_n_entries"))
    so_far, before = _so_far(), _order().rowsBetween(Window.unboundedPreceding, -1)
    total = lambda x, over: F.coalesce(F.sum(x).over(over), F.lit(0)).cast("int")
    entries, matched = F.when(F.col("_run"), F.col("_n_entries")).otherwise(0), F.col("_matched").cast("int")
    # an opening begins a section without a paragraph; before the first one there is none
    tail = F.when(chapter, F.coalesce("_open", F.lit(False))).otherwise(F.col("_open"))
    is_open = lambda over: F.coalesce(F.max(chapter).over(over) & F.last(tail, ignorenulls=True).over(over), F.lit(False))
    return step.withColumns({
        "n_toc_before": total(entries, before), "n_toc": total(entries, so_far), "next_before": total(matched, before), "next_after": total(matched, so_far),
        "open_before": is_open(before), "open_after": is_open(so_far),
    }).drop("_matched")


def with_expected_title(pages: DataFrame, asks: Column) -> DataFrame:
    """Adds expected_title where ``asks``: the TOC's title at next_before (needs ``counted`` and _titles).

    Entries are rows beside the pages for this, parted by book and place, so it takes no list of a TOC at each page."""
    of_page = F.array(F.struct(F.lit(True).alias("page"), F.when(asks, F.col("next_before")).alias("place"), F.lit(None).cast("string").alias("title")))
    of_entries = F.transform("_titles", lambda title, i: F.struct(F.lit(False).alias("page"), (F.col("n_toc_before") + i).alias("place"), title.alias("title")))
    rows = pages.withColumn("_row", F.explode(F.when(F.col("_run") & F.col("_titles").isNotNull(), F.concat(of_page, of_entries)).otherwise(of_page)))
    rows = rows.withColumns({"_page": F.col("_row.page"), "_place": F.col("_row.place"), "_title": F.col("_row.title")}).drop("_row", "_titles", "_run")
    return rows.withColumn("expected_title", F.max("_title").over(Window.partitionBy("book_id", "_place"))).filter("_page").drop("_page", "_place", "_title")


def section_columns(pages: DataFrame) -> DataFrame:
    """Adds the current section after each page (needs ``toc_columns``)."""
    chapter = F.col("page_type") == "chapter_opening"
    first_title = T.state_text(F.try_element_at(texts(F.col("blocks"), "chapter_title"), F.lit(1))["content"])
    opened = F.struct(
        F.coalesce(F.col("opening.kind"), F.lit("chapter")).alias("kind"),
        F.coalesce(F.col("opening.title"), first_title, F.lit("")).alias("title"),
        (F.col("next_expected_opening_index") - F.col("_matched").cast("int")).alias("toc_index"),
        F.col("page_index").alias("started_on_page"),
    )
    levels = F.filter(texts(F.col("blocks"), "heading"), lambda b: b["heading_level"].isNotNull())
    headings = F.transform(levels, lambda b: F.struct(b["heading_level"].alias("level"), T.state_text(b["content"]).alias("text"), F.col("page_index").alias("page_index")))
    last = F.try_element_at(texts(F.col("blocks"), "paragraph"), F.lit(-1))
    tail = F.struct(F.coalesce(last["continues_on_next_page"], F.lit(False)).alias("open"), F.right(T.state_text(last["content"]), F.lit(TAIL_CHARS)).alias("text"))
    counts = F.col("page_type") != "toc"
    step = pages.withColumn("_section", F.last(F.when(chapter, opened), ignorenulls=True).over(_so_far()))
    step = step.withColumn("_headings", F.when(counts & F.col("_section").isNotNull(), headings)).withColumn("_tail", F.when(counts & last.isNotNull(), tail))
    within = Window.partitionBy("book_id", F.col("_section.started_on_page")).orderBy("page_index").rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumn("_stack", F.flatten(F.collect_list("_headings").over(within))).withColumn("_last", F.last("_tail", ignorenulls=True).over(within))
    section = F.struct(
        "_section.kind",
        "_section.title",
        "_section.toc_index",
        "_section.started_on_page",
        F.col("_stack").alias("heading_stack"),
        F.slice("_stack", F.greatest(F.lit(1), F.size("_stack") - (RECENT_HEADINGS - 1)), F.lit(RECENT_HEADINGS)).alias("recent_headings"),
        F.when(F.col("_last.open"), F.col("_last.text")).alias("open_paragraph_tail"),
    )
    return step.withColumn("section", F.when(F.col("_section").isNotNull(), section)).drop("_section", "_headings", "_tail", "_stack", "_last")


def metadata_columns(pages: DataFrame) -> DataFrame:
    """Adds book_metadata: each field from the earliest page so far that has it."""
    found = lambda name: F.first(F.when(T.non_empty(F.col(f"metadata.{name}")), F.col(f"metadata.{name}")), ignorenulls=True).over(_so_far())
    authors = F.first(F.when(F.size("metadata.authors") > 0, F.col("metadata.authors")), ignorenulls=True).over(_so_far())
    merged = F.struct(found("title").alias("title"), found("subtitle").alias("subtitle"), F.coalesce(authors, F.array().cast("array<string>")).alias("authors"), found("language").alias("language"))
    return pages.withColumn("book_metadata", merged)


def with_state(pages: DataFrame) -> DataFrame:
    """Pages with the whole state after each of them."""
    return metadata_columns(section_columns(toc_columns(pages))).drop("_matched")


def page_context(states: DataFrame) -> DataFrame:
    """What an interpreter may see of each page: the state before it."""
    before = lambda c: F.lag(c).over(_order())
    section = before("section")
    status = F.coalesce(before("toc_status"), F.lit("not_seen"))
    toc, at = before("toc"), F.coalesce(before("next_expected_opening_index"), F.lit(0))
    none = F.array().cast(states.schema["toc"].dataType)
    return states.select(
        "book_id",
        "page_index",
        before("book_metadata")["title"].alias("book_title"),
        F.coalesce(before("book_metadata")["authors"], F.array().cast("array<string>")).alias("authors"),
        status.alias("toc_status"),
        F.when(status == "committed", F.slice(toc, at + 1, F.lit(EXPECTED_ENTRIES))).otherwise(none).alias("expected_toc_entries"),
        section["title"].alias("current_section_title"),
        section["recent_headings"].alias("current_section_headings"),
        section["open_paragraph_tail"].alias("open_paragraph_tail"),
        before("page_type").alias("previous_page_type"),
    )


def toc_status_fold(pages: DataFrame) -> DataFrame:
    """Status and opening index after the last page of each book, by an explicit ordered fold.

    One row a book holds the pages' types; the windows above give the same per page."""
    steps = F.sort_array(F.collect_list(F.struct("page_index", "page_type", F.size("toc_entries").alias("entries"))))
    start = F.struct(F.lit("not_seen").alias("status"), F.lit(0).alias("entries"), F.lit(0).alias("opened"))

    def step(a: Column, x: Column) -> Column:
        toc = x["page_type"] == "toc"
        status = F.when((a["status"] == "collecting") & ~toc, F.when(a["entries"] > 0, "committed").otherwise("absent")).otherwise(a["status"])
        takes = toc & status.isin("not_seen", "collecting")
        after = F.when(takes, "collecting").when(~toc & (status == "not_seen") & x["page_type"].isin("chapter_opening", "body"), "absent").otherwise(status)
        opened = a["opened"] + ((x["page_type"] == "chapter_opening") & (after == "committed")).cast("int")
        return F.struct(after.alias("status"), (a["entries"] + F.when(takes, x["entries"]).otherwise(0)).alias("entries"), opened.alias("opened"))

    return pages.groupBy("book_id").agg(F.aggregate(steps, start, step).alias("s")).select("book_id", F.col("s.status").alias("toc_status"), F.col("s.opened").alias("next_expected_opening_index"))
