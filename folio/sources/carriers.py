"""Deterministic page records out of general tables, so that every operator runs at any scale.

conversations: a conversation is a book, a turn a page. events: a user is a book, an event a page.
documents: a source is a book, a document a page. Row numbers need one exchange by book each; that of
events deals books over as many tasks as their rows call for, so a task's share does not grow with the table.
Documents are numbered by their ids alone; their texts are dealt by document, never by book.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import png
from folio.schemas import BLOCK, METADATA, OPENING, TOC_ENTRY
from folio.sources.shared import numbered


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def segment(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def block(kind: str, **fields: Column) -> Column:
    """A block struct; fields that are not given are null, flags false."""
    kinds = {"role": "string", "label": "string", "caption": "string", "heading_level": "int", "asset_sha256": "string", "block_id": "string"}
    none = lambda t: F.lit(None).cast(t)
    get = lambda k: fields.get(k, none(kinds[k]))
    off = F.lit(False)
    return F.struct(
        F.lit(kind).alias("kind"), get("role").alias("role"), fields.get("content", none("array<struct<kind:string,value:string>>")).alias("content"), get("label").alias("label"),
        get("caption").alias("caption"), get("heading_level").cast("int").alias("heading_level"), fields.get("continues_previous", off).alias("continues_previous"),
        fields.get("continues_on_next_page", off).alias("continues_on_next_page"), fields.get("bbox", none("struct<x0:double,y0:double,x1:double,y1:double>")).alias("bbox"),
        none("string").alias("style"), get("asset_sha256").alias("asset_sha256"), get("block_id").alias("block_id"),
    ).withField("style", F.lit(None).cast("struct<font_family:string,font_size_pt:double,relative_size:string,bold:boolean,italic:boolean,small_caps:boolean,alignment:string>"))


_NO_ENTRIES = f"array<{TOC_ENTRY}>"
_NO_BLOCKS = f"array<{BLOCK}>"


def _page(frame: DataFrame, *more: str, toc_entries: Column, blocks: Column, opening: Column | None = None, metadata: Column | None = None) -> DataFrame:
    return frame.select(
        "book_id",
        "page_index",
        "page_type",
        F.lit(None).cast("string").alias("printed_page_label"),
        (opening if opening is not None else F.lit(None)).cast(OPENING).alias("opening"),
        (metadata if metadata is not None else F.lit(None)).cast(METADATA).alias("metadata"),
        toc_entries.cast(_NO_ENTRIES).alias("toc_entries"),
        blocks.cast(_NO_BLOCKS).alias("blocks"),
        *more,
    )


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system: toc, one entry a line; user: chapter_opening, first line its title; assistant: body, first line a heading."""
    t = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("book_id"),
        F.col("turn").cast("int").alias("page_index"),
        F.when(F.col("role") == "system", "toc").when(F.col("role") == "user", "chapter_opening").otherwise("body").alias("page_type"),
        lines_of(F.col("text")).alias("lines"),
    )
    kind = F.col("page_type")

    def line(x: Column, i: Column) -> Column:
        first = i == 0
        role = F.when(first & (kind == "chapter_opening"), "chapter_title").when(first & (kind == "body"), "heading").otherwise("paragraph")
        level = F.when(role == "heading", F.pmod(F.col("page_index"), F.lit(3)) + 1)
        return block("text", role=role, heading_level=level, content=F.array(segment("text", x)))

    entries = F.transform("lines", lambda x: F.struct(x.alias("title"), F.lit(1).alias("level"), F.lit("chapter").alias("kind"), F.lit(None).cast("string").alias("printed_page_label")))
    none = F.array()
    return _page(t, toc_entries=F.when(kind == "toc", entries).otherwise(none.cast("array<struct<title:string,level:int,kind:string,printed_page_label:string>>")), blocks=F.when(kind == "toc", F.array().cast(_NO_BLOCKS)).otherwise(F.transform("lines", line).cast(_NO_BLOCKS)))


#: Of events that one task gets: windows over whole pages hold some 2 KB for each of them.
ROWS_A_TASK = 32_768


#: Of documents that one task gets: some 2 KB of text each, which several sorts hold beside each other.
DOCUMENTS_A_TASK = 8_192


def tasks_for(rows: DataFrame, share: int | None = None) -> int:
    """As many tasks as the rows of a table need, one a core at least. Counting reads no column."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (share or ROWS_A_TASK)))


def document_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Not fewer than the session's partitions, as a join would deal the texts anew then."""
    return max(tasks_for(load(spark, sf_dir, "documents"), DOCUMENTS_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))


def event_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Not fewer than the session's partitions, as a join would deal the pages anew then."""
    return max(tasks_for(load(spark, sf_dir, "events")), int(spark.conf.get("spark.sql.shuffle.partitions")))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, page_index, page_type, event_id, text, continues_on, continues_previous, value."""
    order = Window.partitionBy("book_id").orderBy("ts", "event_id")  # the key that all later windows use
    t = load(spark, sf_dir, "events")
    dealt = t.withColumn("book_id", F.col("user_id").cast("string")).repartition(tasks_for(t), "book_id")
    t = dealt.withColumn("page_index", F.row_number().over(order) - 1)
    kind = F.col("event_type")
    page_type = F.when(kind == "signup", "toc").when(kind == "purchase", "chapter_opening").when(kind == "view", "body").when(kind == "click", "blank").otherwise("figure_page")
    t = t.withColumn("continues_on", F.coalesce(F.col("value") > 60, F.lit(False)))
    before = F.coalesce(F.lag("continues_on").over(order), F.lit(False)) & (F.col("page_index") % 7 != 0)
    return t.select("book_id", "page_index", page_type.alias("page_type"), "event_id", F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("text"), "continues_on", before.alias("continues_previous"), "value", "props")


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paragraph a page; a toc page has one entry, a chapter opening a title first."""
    t = event_rows(spark, sf_dir)
    kind = F.col("page_type")
    content = F.array(segment("text", F.col("text")))
    paragraph = block("text", role=F.lit("paragraph"), content=content, continues_previous=F.col("continues_previous"), continues_on_next_page=F.col("continues_on"))
    title = block("text", role=F.lit("chapter_title"), content=F.array(segment("text", F.concat(F.lit("Part "), (F.col("event_id") % 5).cast("string")))))
    heading = block("text", role=F.lit("heading"), heading_level=F.col("event_id") % 4 + 1, content=content)
    blocks = F.when(kind == "chapter_opening", F.array(title, paragraph)).when(kind == "body", F.array(heading, paragraph)).otherwise(F.array(paragraph))
    entry = F.struct(F.concat(F.lit("PART "), (F.col("event_id") % 5).cast("string"), F.lit(" ....")).alias("title"), (F.col("event_id") % 3 + 1).cast("int").alias("level"), F.lit("chapter").alias("kind"), F.lit(None).cast("string").alias("printed_page_label"))
    entries = F.when(kind == "toc", F.array(entry)).otherwise(F.array().cast("array<struct<title:string,level:int,kind:string,printed_page_label:string>>"))
    meta = F.struct(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("T"), F.col("event_id"))).alias("title"), F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("S"), F.col("event_id"))).alias("subtitle"), F.when(F.col("event_id") % 5 == 0, F.array(F.concat(F.lit("A"), F.col("event_id")))).alias("authors"), F.lit(None).cast("string").alias("language"))
    return _page(t, toc_entries=entries, blocks=blocks, metadata=meta)


def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order of their ids as the pages of one book: three blank pages, a TOC, openings,
    body pages whose paragraph is the whole text, figure pages, and TOC pages in between."""
    t = numbered(load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "page_index", F.col("doc_id"), F.md5("text"))
    p, k = F.col("page_index"), F.col("doc_id")
    page_type = F.when(p < 3, "blank").when((p < 12) | (k % 97 == 0), "toc").when(k % 10 == 0, "chapter_opening").when(k % 7 == 0, "figure_page").otherwise("body")
    t = t.select(F.lit("corpus").alias("book_id"), "page_index", page_type.alias("page_type"), k.alias("doc_id"), "text", (k % 3 == 0).alias("on"))
    kind = F.col("page_type")
    own = F.concat(F.lit("Part "), (F.col("doc_id") % 5).cast("string"))
    paragraph = block("text", role=F.lit("paragraph"), content=F.array(segment("text", F.col("text"))), continues_on_next_page=F.col("on"))
    title = block("text", role=F.lit("chapter_title"), content=F.array(segment("text", own)))
    heading = block("text", role=F.lit("heading"), heading_level=F.col("doc_id") % 4 + 1, content=F.array(segment("text", F.concat(F.lit("Heading "), F.col("doc_id").cast("string")))))
    blocks = F.when(kind == "chapter_opening", F.array(title, paragraph)).when(kind == "body", F.array(heading, paragraph)).otherwise(F.array(paragraph))
    entry = F.struct(own.alias("title"), F.lit(1).alias("level"), F.lit("chapter").alias("kind"), F.lit(None).cast("string").alias("printed_page_label"))
    entries = F.when(kind == "toc", F.array(entry)).otherwise(F.array().cast("array<struct<title:string,level:int,kind:string,printed_page_label:string>>"))
    meta = F.struct(F.when(F.col("page_index") == 2, F.lit("Corpus")).alias("title"), F.lit("").alias("subtitle"), F.when(F.col("page_index") == 3, F.array(F.lit("A. Author"))).alias("authors"), F.lit("en").alias("language"))
    return _page(t, toc_entries=entries, blocks=blocks, metadata=meta)


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document: a heading, paragraphs, an added reference and note, a figure, a separator.

    The last paragraph of every third document goes on in the next one's first paragraph. ``stretch`` names the document,
    rows that repeat it included; texts lie in tasks by it."""
    order = Window.partitionBy("source").orderBy("doc_id")
    t = load(spark, sf_dir, "documents").select("source", "doc_id", "text", F.to_json(F.array("source", F.col("doc_id").cast("string"))).alias("stretch"), F.xxhash64("text").alias("_tie"))
    on = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    counted = t.groupBy("stretch", "source", "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    places = counted.select("stretch", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"), F.coalesce(F.lag(on).over(order), F.lit(False)).alias("_on_first"))
    t = t.repartition(document_tasks(spark, sf_dir), "stretch").join(places, "stretch")
    copy = F.row_number().over(Window.partitionBy("stretch").orderBy("_tie"))
    t = t.withColumn("_copy", copy).withColumns({"page_index": (F.col("_first") + F.col("_copy") - 1).cast("int"), "on": on, "on_before": F.when(F.col("_copy") == 1, F.col("_on_first")).otherwise(on)})
    t = t.select("stretch", F.col("source").alias("book_id"), "page_index", F.when(F.col("page_index") % 10 == 0, "chapter_opening").otherwise("body").alias("page_type"), "doc_id", "on", "on_before", lines_of(F.coalesce("text", F.lit(""))).alias("lines"))
    label = (F.col("doc_id") % 2).cast("string")
    last = F.size("lines") - 1
    noted = F.col("doc_id") % 5 == 0

    def line(x: Column, i: Column) -> Column:
        run = F.array(segment("text", x))
        with_ref = F.array(segment("text", x), segment("footnote_reference", label))
        return block("text", role=F.lit("paragraph"), content=F.when(noted & (i == last), with_ref).otherwise(run), continues_previous=F.col("on_before") & (i == 0), continues_on_next_page=F.col("on") & (i == last))

    title = block("text", role=F.when(F.col("page_type") == "chapter_opening", "chapter_title").otherwise("page_number"), content=F.array(segment("text", F.concat(F.lit("Document "), F.col("doc_id").cast("string")))))
    note = block("footnote", label=label, content=F.array(segment("text", F.concat(F.lit("Note of "), F.col("doc_id").cast("string")))))
    figure = block("figure", caption=F.concat(F.lit("Figure "), F.col("doc_id").cast("string")), asset_sha256=F.when(F.col("doc_id") % 14 == 0, F.sha2(F.col("doc_id").cast("string"), 256)))
    rule = block("separator")
    some = lambda ok, b: F.when(ok, F.array(b).cast(_NO_BLOCKS)).otherwise(F.array().cast(_NO_BLOCKS))
    # figures and rules stand before the lines, so that they never part a continued paragraph's end
    quiet = ~F.col("on_before")
    blocks = F.concat(some(F.lit(True), title), some(quiet & (F.col("doc_id") % 7 == 0), figure), some(quiet & (F.col("doc_id") % 11 == 0), rule), F.transform("lines", line).cast(_NO_BLOCKS), some(noted & (F.size("lines") > 0), note))
    meta = F.struct(F.when(F.col("page_index") == 2, F.concat(F.lit("Source "), F.col("book_id"))).alias("title"), F.lit("").alias("subtitle"), F.when(F.col("page_index") == 3, F.array(F.lit("A. Author"), F.lit("B. Author"))).alias("authors"), F.lit("en").alias("language"))
    return _page(t, "stretch", toc_entries=F.array().cast(_NO_ENTRIES), blocks=blocks, metadata=meta)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, bbox (left, top, right, bottom in 0..1000) out of the first four components."""
    at = lambda i: F.least(F.lit(1000), F.greatest(F.lit(0), F.floor((F.col("embedding")[i].cast("double") + 0.5) * 1000).cast("int"))).cast("int")
    box = F.struct(at(0).alias("left"), at(1).alias("top"), at(2).alias("right"), at(3).alias("bottom"))
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", box.alias("bbox"))


def raster_pages(spark: SparkSession, sf_dir: str, width: int = 64, height: int = 48) -> tuple[DataFrame, DataFrame]:
    """A page for each vector, with a figure in its box, and the page's raster: pixels that the vector's id gives, rows under every filter."""
    b = boxes(spark, sf_dir)
    figure = block("figure", caption=F.lit("Figure"), bbox=G.normalized(F.col("bbox")))
    t = b.select(F.col("vec_id").cast("string").alias("book_id"), F.lit(0).alias("page_index"), F.lit("figure_page").alias("page_type"), "bbox")
    pages = _page(t, toc_entries=F.array().cast(_NO_ENTRIES), blocks=F.array(figure))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(height)[:, None, None] * 7 + np.arange(width)[None, :, None] * 13 + np.arange(3)[None, None, :] * 29
        for batch in batches:
            images = [png.encode(((places + v) % 256).astype(np.uint8), (0, 1, 2, 3, 4)) for v in batch.column(0).to_pylist()]
            yield pa.record_batch({"book_id": batch.column(0).cast(pa.string()), "page_index": pa.array([0] * len(images), pa.int32()), "image": pa.array(images, pa.binary())})

    return pages, b.select("vec_id").mapInArrow(draw, "book_id string, page_index int, image binary")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id (page), pos, kind, role, text: h1, article paragraphs, nav items and the footer of a web page."""
    t = load(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("book_id"), F.coalesce("html", F.lit("")).alias("html"))
    found = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    tagged = lambda role, texts: F.transform(texts, lambda x: F.struct(F.lit(role).alias("role"), x.alias("text")))
    items = F.concat(
        tagged("running_header", found("(?s)<li>(.*?)</li>")),
        tagged("chapter_title", found("(?s)<h1>(.*?)</h1>")),
        tagged("paragraph", found("(?s)<p>(.*?)</p>")),
        tagged("running_footer", found("(?s)<footer>(.*?)</footer>")),
    )
    return t.select("book_id", F.posexplode(items).alias("pos", "b")).select("book_id", "pos", F.lit("text").alias("kind"), "b.role", "b.text")
