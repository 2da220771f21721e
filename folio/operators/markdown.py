"""Publication blocks to Markdown text, one row a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.paths import asset_path
from folio.operators import ordered


def block_lines(normalize=T.nfc) -> Column:
    """The line of a publication block; notes have their own form."""
    text = normalize(T.markdown_text(F.col("content")))
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.col("heading_level") + 1, F.lit(6))), F.lit(" "), text)
    line = (
        F.when(F.col("kind") == "separator", "---")
        .when(F.col("kind") == "figure", F.concat(F.lit("!["), F.coalesce(normalize(F.col("caption")), F.lit("")), F.lit("]("), asset_path(F.col("asset_sha256")), F.lit(")")))
        .when(F.col("kind") == "footnote", F.concat(F.lit("[^"), F.col("note_id"), F.lit("]: "), text))
        .when(F.col("role").isin("chapter_title", "book_title", "subtitle"), F.concat(F.lit("# "), text))
        .when((F.col("role") == "heading") & F.coalesce(F.col("heading_level") > 0, F.lit(False)), heading)
        .when(F.col("role") == "blockquote", F.concat(F.lit("> "), text))
        .otherwise(text)
    )
    return line


def render(blocks: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """book_id, markdown: the chunks, joined where they pass in order. A book's row is all that holds it whole."""
    return ordered.texts(chunks(blocks, metadata).filter("text IS NOT NULL"), trim=True).select("book_id", F.col("text").alias("markdown"))


def chunks(blocks: DataFrame, metadata: DataFrame | None = None, path: str = "book.md") -> DataFrame:
    """A book's text in ordered chunks (see ``ordered``; to be trimmed): a row a block, and the title's lines before."""
    as_is = lambda c: c  # noqa: E731  chunks are normalised where they are joined
    at = F.col("publication_block_index").cast("long")
    line = F.concat(F.when(at == 0, "").otherwise("\n"), block_lines(as_is), F.when(F.col("kind") == "footnote", "").otherwise("\n"))
    out = blocks.select("book_id", F.lit(path).alias("path"), at.alias("seq"), line.alias("text"))
    if metadata is None:
        return out
    part = lambda ok, line: F.when(ok, F.concat(line, F.lit("\n\n"))).otherwise("")
    head = F.concat(
        part(T.non_empty(F.col("title")), F.concat(F.lit("# "), F.col("title"))),
        part(T.non_empty(F.col("subtitle")), F.concat(F.lit("## "), F.col("subtitle"))),
        part(F.coalesce(F.size("authors") > 0, F.lit(False)), F.array_join("authors", ", ")),
    )
    return out.unionByName(metadata.select("book_id", F.lit(path).alias("path"), F.lit(-1).cast("long").alias("seq"), head.alias("text")))


def with_page_marker(rendered: DataFrame, pages: DataFrame) -> DataFrame:
    """Puts a comment that names the book's first page before the text."""
    first = pages.groupBy("book_id").agg((F.min("page_index") + 1).alias("page"))
    marked = F.concat(F.lit("<!-- source-page: "), F.col("page").cast("string"), F.lit(" -->\n"), F.col("markdown"))
    return rendered.join(first, "book_id").select("book_id", marked.alias("markdown"))
