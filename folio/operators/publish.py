"""Publication: furniture dropped, notes numbered and moved to the end, continued paragraphs merged.

Notes are numbered at page level from a running sum, so references are rewritten without a join;
blocks are then exploded and continued paragraphs become islands.

Content is dealt by stretches, pages of a book that follow each other, so no task needs a book's. What a book's
windows see of a stretch is one small row (``placed``): its counts, and how its first block begins. Blocks that
stand alone, nearly all, are output where they are; only pieces that go together are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.schemas import FURNITURE


def _pages():
    return Window.partitionBy("book_id").orderBy("page_index")


def _blocks():
    return Window.partitionBy("book_id").orderBy("page_index", "pos")


#: Pages of a book that make a stretch, unless pages come with a column of that name.
SPAN = 64
_PLACES = ("_notes_before", "_opens_before", "_next_joins", "_opens", "_loose")


def _stretch(*order: str):
    return Window.partitionBy("stretch").orderBy(*order)


def _blocks_before():
    return _blocks().rowsBetween(Window.unboundedPreceding, -1)


def _is_kept(b: Column) -> Column:
    kept = ~((b["kind"] == "text") & b["role"].isin(*FURNITURE)) & ~((b["kind"] == "figure") & (F.coalesce(b["asset_sha256"], F.lit("")) == ""))
    return F.coalesce(kept, F.lit(True))


def _is_on(b: Column, name: str) -> Column:
    return (b["kind"] == "text") & F.coalesce(b[name], F.lit(False))


def placed(pages: DataFrame) -> DataFrame:
    """Pages with stretch and what a book has outside it: _notes_before, _opens_before (paragraphs and other islands that
    begin on earlier pages), _next_joins (whether the next block after it goes on with what stands before), and of the
    whole book _opens and _loose (its first block goes on with nothing)."""
    if "stretch" not in pages.columns:
        pages = pages.withColumn("stretch", F.to_json(F.array(F.col("book_id").cast("string"), F.floor(F.col("page_index") / SPAN).cast("string"))))
    body = F.filter("blocks", lambda b: _is_kept(b) & (b["kind"] != "footnote"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    joins = F.transform(body, lambda b: _is_on(b, "continues_previous"))
    seen = pages.select("stretch", "book_id", "page_index", size(F.filter("blocks", lambda b: b["kind"] == "footnote")).alias("notes"), joins.alias("joins"))
    seen = seen.select("stretch", "book_id", "page_index", "notes", size(F.filter("joins", lambda x: ~x)).alias("opens"), F.get("joins", F.lit(0)).alias("first"))
    has = F.when(F.col("first").isNotNull(), F.col("page_index"))
    totals = seen.groupBy("stretch", "book_id").agg(F.min("page_index").alias("start"), F.sum("notes").alias("notes"), F.sum("opens").alias("opens"), F.min_by("first", has).alias("first"))
    book = Window.partitionBy("book_id").orderBy("start")
    before = book.rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select(
        "stretch",
        "book_id",
        F.coalesce(F.sum("notes").over(before), F.lit(0)).alias("_notes_before"),
        F.coalesce(F.sum("opens").over(before), F.lit(0)).alias("_opens_before"),
        F.expr("coalesce(lead(first) IGNORE NULLS OVER (PARTITION BY book_id ORDER BY start), false)").alias("_next_joins"),
    )
    books = totals.groupBy("book_id").agg(F.sum("opens").alias("_opens"), F.coalesce(F.min_by("first", F.when(F.col("first").isNotNull(), F.col("start"))), F.lit(False)).alias("_loose"))
    whole = places.join(books.withColumnRenamed("book_id", "_book"), F.col("book_id").eqNullSafe(F.col("_book"))).drop("_book", "book_id")
    return pages.join(whole, "stretch")


def numbered_notes(pages: DataFrame) -> DataFrame:
    """Adds _labels (of the page's notes) and _base (notes on earlier pages)."""
    labels = F.transform(F.filter("blocks", lambda b: b["kind"] == "footnote"), lambda b: b["label"])
    step = pages.withColumn("_labels", labels)
    if "_notes_before" in pages.columns:
        inside = F.sum(F.size("_labels")).over(_stretch("page_index").rowsBetween(Window.unboundedPreceding, -1))
        return step.withColumn("_base", F.col("_notes_before") + F.coalesce(inside, F.lit(0)))
    return step.withColumn("_base", F.coalesce(F.sum(F.size("_labels")).over(_pages().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _note_id(label: Column) -> Column:
    at = F.array_position("_labels", label)
    return F.when(at > 0, (F.col("_base") + at).cast("string"))


def raw_blocks(pages: DataFrame) -> DataFrame:
    """One row per block that publication keeps, references rewritten: is_note, note_id, content, flags, and
    unresolved (some reference has no note on its page) and bad_flag (continuation flags off a paragraph)."""
    carried = ("stretch", *_PLACES) if "_notes_before" in pages.columns else ()
    blocks = numbered_notes(pages).select("book_id", "page_index", *carried, "_labels", "_base", F.posexplode("blocks").alias("pos", "b"))
    kind, role = F.col("b.kind"), F.col("b.role")
    content = F.transform("b.content", lambda s: F.when(s["kind"] == "footnote_reference", F.struct(s["kind"].alias("kind"), _note_id(s["value"]).alias("value"))).otherwise(s))
    on = lambda name: _is_on(F.col("b"), name)
    return blocks.filter(_is_kept(F.col("b"))).select(
        "book_id",
        "page_index",
        "pos",
        kind.alias("kind"),
        role.alias("role"),
        F.when(kind.isin("text", "footnote"), content).alias("content"),
        F.col("b.heading_level").alias("heading_level"),
        F.when(kind == "footnote", _note_id(F.col("b.label"))).alias("note_id"),
        F.col("b.caption").alias("caption"),
        F.when(kind == "figure", F.col("b.asset_sha256")).alias("asset_sha256"),
        F.col("b.block_id").alias("block_id"),
        on("continues_previous").alias("continues_previous"),
        on("continues_on_next_page").alias("continues_on_next_page"),
        (kind.isin("text", "footnote") & F.exists(F.coalesce(content, F.array().cast("array<struct<kind:string,value:string>>")), lambda s: (s["kind"] == "footnote_reference") & s["value"].isNull())).alias("unresolved"),
        ((on("continues_previous") | on("continues_on_next_page")) & (role != "paragraph")).alias("bad_flag"),
        *carried,
    )


def continuation_errors(raw: DataFrame) -> DataFrame:
    """Per block that cannot be merged: book_id, page_index, pos, code."""
    body = raw.filter("kind <> 'footnote'")
    flagged = F.when(F.col("continues_previous") | F.col("continues_on_next_page"), F.col("continues_on_next_page"))
    step = body.withColumn("_source", F.last(flagged, ignorenulls=True).over(_blocks_before()))
    step = step.withColumn("_open", F.lag("continues_on_next_page").over(_blocks())).withColumn("_page", F.lag("page_index").over(_blocks()))
    code = (
        F.when(~F.coalesce("_source", F.lit(False)), "continuation-without-source")
        .when(~F.coalesce("_open", F.lit(False)), "invalid-continuation-layout")
        .when(F.col("page_index") != F.col("_page") + 1, "invalid-continuation-layout")
    )
    return step.filter("continues_previous").select("book_id", "page_index", "pos", code.alias("code")).filter("code IS NOT NULL")


def publication_errors(pages: DataFrame) -> DataFrame:
    """Per book the error that publishing stops at: doubled labels first, then blocks in order, then merging."""
    doubled = numbered_notes(pages).filter(F.size(F.array_distinct("_labels")) < F.size("_labels")).select("book_id", "page_index", F.lit(0).alias("pos"), F.lit(1).alias("stage"), F.lit("duplicate-footnote-label").alias("code"))
    raw = raw_blocks(pages)
    code = F.when(F.col("bad_flag"), "invalid-continuation-layout").when(F.col("unresolved"), "unresolved-footnote")
    blocks = raw.select("book_id", "page_index", "pos", F.lit(2).alias("stage"), code.alias("code")).filter("code IS NOT NULL")
    merging = continuation_errors(raw).select("book_id", "page_index", "pos", F.lit(3).alias("stage"), "code")
    found = doubled.unionByName(blocks).unionByName(merging)
    return found.groupBy("book_id").agg(F.min(F.struct("stage", "page_index", "pos", "code")).alias("e")).select("book_id", "e.page_index", "e.code")


def publication_blocks(pages: DataFrame) -> DataFrame:
    """Books without errors to publication blocks with their source map.

    book_id, publication_block_index, kind, role, content, heading_level, note_id, caption, asset_sha256,
    source_pages, source_block_ids. Books with errors are to be left out by the caller."""
    raw = raw_blocks(placed(pages))
    is_note = F.col("kind") == "footnote"
    opens = (~F.col("continues_previous") & ~is_note).cast("int")
    order = _stretch("page_index", "pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # notes are islands of their own, counted apart so that they never part a paragraph
    step = raw.withColumns({"is_note": is_note, "_joins": F.when(~is_note, F.col("continues_previous"))})
    following = F.expr("lead(_joins) IGNORE NULLS OVER (PARTITION BY stretch ORDER BY page_index, pos)")
    step = step.withColumns({
        "_number": F.when(is_note, F.col("_notes_before") + F.sum(is_note.cast("int")).over(so_far)).otherwise(F.col("_opens_before") + F.sum(opens).over(so_far)),
        "_following": F.coalesce(following, F.col("_next_joins")),
    })
    # the islands of a book's text, from 0 if its first block goes on with nothing, then its notes
    loose = F.col("_loose").cast("int")
    step = step.withColumn("publication_block_index", (F.col("_number") - 1 + loose + F.when(is_note, F.col("_opens")).otherwise(0)).cast("int"))
    alone = F.col("is_note") | (~F.col("continues_previous") & ~F.col("_following"))
    names = ("kind", "role", "content", "heading_level", "note_id", "caption", "asset_sha256")
    single = step.filter(alone).select("book_id", "publication_block_index", *names, F.array("page_index").alias("source_pages"), F.array_compact(F.array("block_id")).alias("source_block_ids"))
    item = F.struct("page_index", "pos", *names, "block_id")
    merged = step.filter(~alone).groupBy("book_id", "publication_block_index").agg(F.sort_array(F.collect_list(item)).alias("items"))
    first = F.get("items", F.lit(0))
    rest = F.slice("items", F.lit(2), F.size("items"))
    content = F.aggregate(rest, first["content"], lambda a, x: T.merge_content(a, x["content"]))
    pages_of = F.array_distinct(F.transform("items", lambda x: x["page_index"]))
    ids = F.array_distinct(F.array_compact(F.transform("items", lambda x: x["block_id"])))
    shown = [content.alias("content") if name == "content" else first[name].alias(name) for name in names]
    return single.unionByName(merged.select("book_id", "publication_block_index", *shown, pages_of.alias("source_pages"), ids.alias("source_block_ids")))


def publication_metadata(pages: DataFrame) -> DataFrame:
    """Per book: title, subtitle, authors, language, each from the earliest page that has it."""
    earliest = lambda name: F.min_by(F.when(T.non_empty(F.col(f"metadata.{name}")), F.col(f"metadata.{name}")), F.when(T.non_empty(F.col(f"metadata.{name}")), F.col("page_index")))
    has = F.size("metadata.authors") > 0
    authors = F.min_by(F.when(has, F.col("metadata.authors")), F.when(has, F.col("page_index")))
    return pages.groupBy("book_id").agg(earliest("title").alias("title"), earliest("subtitle").alias("subtitle"), F.coalesce(authors, F.array().cast("array<string>")).alias("authors"), earliest("language").alias("language"))
