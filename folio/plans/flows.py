"""The two flows: ingest (interpretations to accepted pages) and publish (accepted pages to outputs)."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import identity as I
from folio.functions import paths as P
from folio.functions import text as T
from folio.operators import markdown, ordered, publish, scan, state, validate
from folio.plans.outputs import Output
from folio.schemas import TOC_ENTRY
from folio.sources.shared import stored
from folio.sources.trees import write_files

#: An interpreter turns (book_id, page_index, content, context as JSON) into wire JSON, batch by batch.
Interpreter = Callable[[pd.DataFrame], pd.Series]

INTERPRETERS: dict[str, Interpreter] = {}


def register(name: str) -> Callable[[Interpreter], Interpreter]:
    def put(f: Interpreter) -> Interpreter:
        INTERPRETERS[name] = f
        return f

    return put


@register("noop")
def _noop(pages: pd.DataFrame) -> pd.Series:
    blank = json.dumps({"page_type": "blank", "metadata": {"authors": []}, "toc_entries": [], "blocks": []})
    return pd.Series([blank] * len(pages), index=pages.index)


def with_context(known: DataFrame, raw: DataFrame) -> DataFrame:
    """Of each book's raw pages (book_id, page_index, content) the one after its snapshot (scan.SNAPSHOT), or after
    its committed pages where those are given, with ``context``: what is known from the pages before, as JSON. Books are read side by side, each book's
    pages one after the other: interpret, ingest, commit, and ask again."""
    snapshots = known if "state" in known.columns else scan.snapshot(known, scan.scan(known))
    at = raw.join(snapshots.select("book_id", F.col("state").alias("before"), "toc"), "book_id", "left").withColumn("before", F.coalesce("before", scan.initial()))
    due = at.filter(F.col("page_index") == F.col("before.processed_page_count"))
    entries = F.slice(F.coalesce("toc", F.array().cast(f"array<{TOC_ENTRY}>")), F.col("before.next_expected_opening_index") + 1, F.lit(state.EXPECTED_ENTRIES))
    seen = scan.page_context(due.withColumn("expected_entries", entries))
    context = F.to_json(F.struct(*[c for c in seen.columns if c not in ("book_id", "page_index")]), {"ignoreNullFields": "false"})
    return due.select(*raw.columns).join(seen.select("book_id", "page_index", context.alias("context")), ["book_id", "page_index"])


def interpret(raw: DataFrame, name: str = "noop") -> DataFrame:
    """Rows (book_id, page_index, content, and context if it is known) to rows with ``response``, wire JSON;
    content stays in the tasks."""
    call = INTERPRETERS[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"book_id": frame["book_id"], "page_index": frame["page_index"], "response": call(frame)})

    return raw.mapInPandas(run, "book_id string, page_index int, response string")


def page_range(pages: DataFrame, *, processed: int | Column = 0, through_page: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Pages from ``processed`` on, up to an absolute 1-based page or a number of pages."""
    if through_page is not None and max_pages is not None:
        raise ValueError("through_page and max_pages exclude each other")
    start = processed if isinstance(processed, Column) else F.lit(processed)
    end = F.lit(through_page) if through_page is not None else start + max_pages if max_pages is not None else None
    kept = pages.filter(F.col("page_index") >= start)
    return kept if end is None else kept.filter(F.col("page_index") < end)


def ingest(pages: DataFrame, *, whole_books: bool = True, page_counts: DataFrame | None = None, snapshots: DataFrame | None = None, tasks: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Accepted pages, and the violation at which each other book stopped.

    ``snapshots`` say where books stand before these pages, so earlier ones need not be given. States and verdicts
    are computed once, by ranges of pages, and stored; a book's stop is a minimum over its pages. ``tasks`` as in ``scan.scan``."""
    accepted, stops, _ = ingested(pages, whole_books=whole_books, page_counts=page_counts, snapshots=snapshots, tasks=tasks, **options)
    return accepted.select(*pages.columns), stops


def ingested(pages: DataFrame, *, whole_books: bool = True, page_counts: DataFrame | None = None, snapshots: DataFrame | None = None, tasks: int | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``ingest``, the accepted pages with before and state, and the snapshots after them."""
    states = scan.with_state(state.with_block_ids(pages), snapshots, tasks=tasks)
    checked = stored(validate.with_failed(states, whole_books, page_counts, **options), "checked")
    found = stored(validate.failures(checked), "violations")
    accepted = validate.accepted_prefix(checked.drop("_failed"), found, tasks)
    return accepted, validate.first_violation(found), scan.snapshot(accepted, accepted, snapshots)


_END = 1 << 40  # behind the numbers of all blocks

#: Canonical JSON of the fixed profiles (fixed values), sorted as they stand in a document.
_EPUB = '{"from_format":"markdown+footnotes","include_toc":%s,"profile_format_version":1,"split_level":1,"to_format":"epub3"}'
_MARKDOWN = '{"footnote_style":"document-end","heading_style":"atx","profile_format_version":1}'


def _quoted(value: Column) -> Column:
    """A string as JSON, null as null."""
    text = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def canonical_chunks(blocks: DataFrame, metadata: DataFrame, include_toc: bool = True) -> DataFrame:
    """The canonical JSON of each book's publication in ordered chunks (see ``ordered``): a row a block, and one before and
    after; every block kind writes its own fields."""
    content = F.concat(
        F.lit("["),
        F.array_join(
            F.transform(
                "content",
                lambda s: F.concat(F.lit('{"kind":"'), s["kind"], F.when(s["kind"] == "text", '","text":').otherwise('","label":'), _quoted(s["value"]), F.lit("}")),
            ),
            ",",
        ),
        F.lit("]"),
    )
    number = F.coalesce(F.col("heading_level").cast("string"), F.lit("null"))
    block = (
        F.when(F.col("kind") == "text", F.concat(F.lit('{"content":'), content, F.lit(',"heading_level":'), number, F.lit(',"kind":"text","role":'), _quoted(F.col("role")), F.lit("}")))
        .when(F.col("kind") == "footnote", F.concat(F.lit('{"content":'), content, F.lit(',"kind":"footnote","note_id":'), _quoted(F.col("note_id")), F.lit("}")))
        .when(F.col("kind") == "figure", F.concat(F.lit('{"asset_sha256":'), _quoted(F.col("asset_sha256")), F.lit(',"caption":'), _quoted(F.col("caption")), F.lit(',"kind":"figure"}')))
        .otherwise('{"kind":"separator","separator_kind":"horizontal_rule"}')
    )
    at = F.col("publication_block_index").cast("long")
    lines = blocks.select("book_id", at.alias("seq"), F.concat(F.when(at == 0, "").otherwise(","), I.lower_escapes(block)).alias("text"))
    meta = F.concat(
        F.lit('{"authors":'), F.coalesce(F.to_json("authors"), F.lit("[]")), F.lit(',"language":'), _quoted(F.col("language")),
        F.lit(',"subtitle":'), _quoted(F.col("subtitle")), F.lit(',"title":'), _quoted(F.col("title")), F.lit("}"),
    )
    profiles = f'],"epub_semantic_profile":{_EPUB % str(include_toc).lower()},"identity_format_version":1,"markdown_semantic_profile":{_MARKDOWN},"metadata":'
    first = metadata.select("book_id", F.lit(-1).cast("long").alias("seq"), F.lit('{"blocks":[').alias("text"))
    last = metadata.select("book_id", F.lit(_END).alias("seq"), I.lower_escapes(F.concat(F.lit(profiles), meta, F.lit("}"))).alias("text"))
    return first.unionByName(lines).unionByName(last).withColumn("path", F.lit("publication.json"))


def fingerprints(blocks: DataFrame, metadata: DataFrame, include_toc: bool = True, prefix: str = "document:", tasks: int | None = None) -> DataFrame:
    """Per book: SHA-256 of the normalised canonical JSON, and a name-based URN over ``prefix`` and that hash.

    The JSON is hashed chunk by chunk and never stands in one row."""
    sha = ordered.digests(canonical_chunks(blocks, metadata, include_toc), tasks=tasks).select("book_id", F.col("sha256").alias("fingerprint"))
    return sha.withColumn("identifier", I.urn(I.uuid5(F.concat(F.lit(prefix), F.col("fingerprint")))))


def publish_books(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books to (book_id, markdown, fingerprint, identifier), and the error of each book that has one."""
    errors = publish.publication_errors(pages)
    good = pages.join(errors.select("book_id"), "book_id", "left_anti")
    blocks, metadata = publish.publication_blocks(good), publish.publication_metadata(good)
    return markdown.render(blocks, metadata).join(fingerprints(blocks, metadata), "book_id"), errors


def manifest_chunks(trees: DataFrame, files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each tree's manifest in ordered chunks: files by path, the source map by block.

    trees: book_id, tree, fingerprint, identifier, head; files: LISTED rows of what was written; blocks: publication blocks."""
    quoted = lambda c: _quoted(F.col(c))
    inside = files.join(trees.select("book_id", "tree"), "book_id").withColumn("path", F.expr("substring(path, length(tree) + 2)"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("path"))
    listed = inside.withColumn("_n", place.cast("long"))
    entry = F.concat(F.when(F.col("_n") == 1, "").otherwise(","), F.lit('{"path":'), quoted("path"), F.lit(',"sha256":'), quoted("sha256"), F.lit(',"size_bytes":'), F.col("size_bytes").cast("string"), F.lit("}"))
    at = F.col("publication_block_index").cast("long")
    source = F.concat(
        F.when(at == 0, "").otherwise(","), F.lit('{"publication_block_index":'), at.cast("string"), F.lit(',"source_block_ids":'), F.to_json("source_block_ids"), F.lit(',"source_pages":'), F.to_json("source_pages"), F.lit("}")
    )
    opening = F.concat(F.lit('{"command":"markdown","committed_page_count":'), F.col("head").cast("string"), F.lit(',"files":['))
    middle = F.concat(F.lit('],"output_manifest_format_version":2,"publication_fingerprint":'), quoted("fingerprint"), F.lit(',"publication_identifier":'), quoted("identifier"), F.lit(',"source_map":['))
    row = lambda df, seq, text: df.select("book_id", seq.cast("long").alias("seq"), text.alias("text"))
    parts = [row(trees, F.lit(0), opening), row(listed, F.col("_n"), entry), row(trees, F.lit(_END - 1), middle), row(blocks, F.lit(_END) + at, source), row(trees, F.lit(2 * _END), F.lit("]}\n"))]
    return reduce(DataFrame.unionByName, parts).join(trees.select("book_id", F.concat("tree", F.lit("/manifest.json")).alias("path")), "book_id")


def publish_trees(pages: DataFrame, root: str, assets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Bundles of all books without errors, written by tasks below root/book_id/tree: book.md, assets and the manifest.

    assets: book_id, sha256, content of figures. Back come the trees (book_id, tree, fingerprint, identifier, head) and the
    errors of the other books. Blocks are computed once and stored; no row holds more than a block."""
    errors = stored(publish.publication_errors(pages), "publication-errors")
    good = pages.join(errors.select("book_id"), "book_id", "left_anti")
    blocks, metadata = stored(publish.publication_blocks(good), "publication"), stored(publish.publication_metadata(good), "metadata")
    heads = good.groupBy("book_id").agg((F.max("page_index") + 1).alias("head"))
    trees = stored(fingerprints(blocks, metadata).join(heads, "book_id").withColumn("tree", F.substring("fingerprint", 1, 16)), "trees")
    text = markdown.chunks(blocks, metadata).withColumn("data", F.lit(None).cast("binary"))
    if assets is not None:
        used = blocks.filter("kind = 'figure'").select("book_id", F.col("asset_sha256").alias("sha256")).distinct()
        pictures = assets.dropDuplicates(["book_id", "sha256"]).join(used, ["book_id", "sha256"])
        text = text.unionByName(pictures.select("book_id", P.asset_path(F.col("sha256")).alias("path"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("text"), F.col("content").alias("data")))
    placed = text.join(trees.select("book_id", "tree"), "book_id").withColumn("path", F.concat_ws("/", "tree", "path")).drop("tree")
    written = write_files(placed, root, trim=True)
    write_files(manifest_chunks(trees, written, blocks), root)
    return trees, errors


def write_bundle(folder: str, markdown_text: str, assets: dict[str, bytes], manifest: dict, head: int | None = None) -> None:
    """One book's outputs on the driver, all or nothing: a candidate is written, checked and put in place."""

    def build(candidate: str) -> None:
        files = {"book.md": markdown_text.encode(), **assets}
        for path, content in files.items():
            os.makedirs(os.path.dirname(os.path.join(candidate, path)), exist_ok=True)
            with open(os.path.join(candidate, path), "wb") as out:
                out.write(content)
        listed = [{"path": p, "sha256": hashlib.sha256(c).hexdigest(), "size_bytes": len(c)} for p, c in sorted(files.items())]
        with open(os.path.join(candidate, "manifest.json"), "w") as out:
            json.dump(manifest | ({} if head is None else {"committed_page_count": head}) | {"files": listed}, out, sort_keys=True, ensure_ascii=False)

    Output(folder, manifest.get("command", "markdown")).publish(build, head)
