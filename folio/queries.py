"""Registered queries of the document engine. Each reads whole tables through a carrier."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import identity as I
from folio.functions import paths as P
from folio.functions import png
from folio.functions import prompt as R
from folio.functions import text as T
from folio.operators import figures, inference, markdown, ordered, publish, scan, state, store, validate
from folio.oracles import ORACLES
from folio.plans import flows
from folio.sources import carriers as C
from folio.sources import made as M
from folio.sources import trees, wire
from folio.sources.shared import new_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")


@query
def scan_blocks(spark, d):
    b = state.blocks_of(state.with_block_ids(C.conversation_pages(spark, d)))
    return b.select("book_id", "page_index", "pos", "role", "heading_level", "block_id", T.state_text(F.col("content")).alias("text"))


@query
def wire_to_domain(spark, d):
    e = C.event_rows(spark, d)
    k = F.get_json_object("props", "$.k")
    box = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"left":'), k, F.lit(',"top":0,"right":1000,"bottom":'), k, F.lit("}"))).otherwise("null")
    json = F.concat(
        F.lit('{"page_type":"body","blocks":[{"kind":"text","role":"paragraph","segments":[{"kind":"text","value":"'), F.col("text"), F.lit('"},{"kind":"footnote_reference","value":"'), k,
        F.lit('"}],"bbox":'), box, F.lit("},"), F.lit('{"kind":"figure","label":"L","caption":"C'), k, F.lit('","role":"heading","segments":[{"kind":"text","value":"x"}]}]}'),
    )
    parsed = wire.parsed(e.select("event_id", json.alias("json")), "json")
    b = wire.to_domain(parsed, "event_id").select("event_id", "page_type", F.posexplode("blocks").alias("pos", "b"))
    return b.select("event_id", "page_type", "pos", "b.kind", "b.role", "b.label", "b.caption", T.markdown_text(F.col("b.content")).alias("text"), F.col("b.bbox.x0").alias("x0"), F.col("b.bbox.y1").alias("y1"), F.col("b.style").isNull().alias("no_style"))


@query
def closed_schema_reject(spark, d):
    e = C.event_rows(spark, d)
    extra = F.when(F.col("event_id") % 10 == 0, ',"surprise":1').when(F.col("event_id") % 10 == 1, ',"blocks":[{"kind":"separator","odd":true}]').when(F.col("event_id") % 10 == 2, ',"blocks":[{"kind":"text","role":"nobody"}]').otherwise("")
    page_type = F.when(F.col("event_id") % 10 == 3, "leaflet").otherwise(F.col("page_type"))
    json = F.when(F.col("event_id") % 10 == 4, "not json").otherwise(F.concat(F.lit('{"page_type":"'), page_type, F.lit('"'), extra, F.lit("}")))
    return wire.parsed(e.select("event_id", json.alias("json")), "json").select("event_id", "wire_error", F.col("wire.page_type").alias("page_type"))


@query
def wire_coercion(spark, d):
    """Numbers and flags in every form that reads as one, and in some that do not, beside a block that has them plain."""
    n = (F.col("event_id") % 9).cast("string")
    form = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    forms = F.array(
        form('"heading_level":"', n, '"'), form('"heading_level":', n, ".0"), form('"heading_level":', n, ".5"), form('"heading_level":" ', n, '.0 "'), F.lit('"heading_level":true'), F.lit('"heading_level":null'), form('"bold":', n), form('"bold":"', n, '"'),
        F.lit('"bold":"Yes"'), F.lit('"bold":"off"'), F.lit('"bold":"maybe"'), F.lit('"bold":null'), form('"continues_previous":', n, ".0"), F.lit('"continues_previous":null'), F.lit('"segments":null'), form('"bbox":{"left":"', n, '","top":', n, '.0,"right":true,"bottom":1000}'),
        form('"bbox":{"left":', n, ',"top":1,"right":"1e1","bottom":1000}'),
    )
    plain = '{"page_type":"body","blocks":[{"kind":"text","role":"heading","heading_level":3,"bold":false,"continues_previous":false,"segments":[{"kind":"text","value":"x"}]},{"kind":"text","role":"heading",'
    e = C.event_rows(spark, d).select("event_id", form(plain, F.get(forms, (F.col("event_id") % 17).cast("int")), "}]}").alias("json"))
    b = F.col("wire.blocks")[1]
    return wire.parsed(e, "json").select("event_id", "wire_error", b["heading_level"].alias("heading_level"), b["bold"].alias("bold"), b["continues_previous"].alias("continues_previous"), b["bbox"]["left"].alias("box_left"), b["bbox"]["top"].alias("box_top"), b["bbox"]["right"].alias("box_right"))


@query
def inline_text_three_ways(spark, d):
    b = state.blocks_of(C.document_pages(spark, d)).filter("kind = 'text'")
    c = F.col("content")
    return b.select("book_id", "page_index", "pos", T.state_text(c).alias("state_text"), T.run_text(c).alias("run_text"), T.markdown_text(c).alias("markdown_text"))


@query
def drop_furniture(spark, d):
    b = C.html_blocks(spark, d)
    return b.filter(~F.col("role").isin("running_header", "running_footer", "page_number"))


@query
def html_block_scan(spark, d):
    return C.html_blocks(spark, d).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("role") == "paragraph").alias("n_paragraphs"), F.sum(F.length("text")).alias("n_chars"))


@query
def title_normalize(spark, d):
    b = C.load(spark, d, "documents")
    title = F.concat(F.lit("  "), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), F.lit(" .... "))
    return b.select("doc_id", T.normalized_title(title, exact=False).alias("title"))


@query
def nfc_text_hash(spark, d):
    return C.load(spark, d, "documents").select("doc_id", I.sha256_hex(T.nfc(F.coalesce("text", F.lit("")))).alias("sha256"))


@query
def path_safety(spark, d):
    path = F.regexp_replace("url", "^https?://", "")
    odd = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), path)).when(F.col("page_id") % 5 == 1, F.concat(path, F.lit("/../x"))).when(F.col("page_id") % 5 == 2, F.concat(path, F.lit("//y"))).when(F.col("page_id") % 7 == 0, F.lit("manifest.json")).otherwise(path)
    return C.load(spark, d, "pages").select("page_id", odd.alias("path")).select("page_id", "path", P.safe_relative(F.col("path")).alias("safe"), P.safe_output(F.col("path")).alias("safe_output"))


@query
def artifact_name_rules(spark, d):
    name = F.when(F.col("o_orderkey") % 11 == 0, "provenance.json").when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("a/"), F.col("o_orderkey"))).otherwise(F.concat(F.lit("f"), F.col("o_orderkey") % 100))
    lists = C.load(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(name)).alias("names"))
    return lists.select("o_custkey", F.size("names").alias("n_names"), P.valid_artifact_names(F.col("names")).alias("valid"))


@query
def name_patterns(spark, d):
    n = F.col("o_orderkey")
    name = F.when(n % 4 == 0, F.format_string("page-%04d", n)).when(n % 4 == 1, F.format_string("failure-%d", n)).when(n % 4 == 2, F.concat(F.lit("assets/"), F.sha2(n.cast("string"), 256), F.lit(".png"))).otherwise(F.substring(F.sha2(n.cast("string"), 256), 1, 16))
    named = C.load(spark, d, "orders").select("o_orderkey", name.alias("name"))
    c = F.col("name")
    return named.select("o_orderkey", P.matches(c, "commit").alias("is_commit"), P.matches(c, "failure").alias("is_failure"), P.matches(c, "nonce").alias("is_nonce"), P.asset_sha256(c).alias("asset_sha256"))


@query
def page_range(spark, d):
    pages = C.conversation_pages(spark, d)
    return flows.page_range(pages, processed=1, max_pages=3).select("book_id", "page_index", "page_type")


@query
def toc_state(spark, d):
    return state.toc_columns(C.event_pages(spark, d)).select("book_id", "page_index", "toc_status", "toc_status_before", "processed_page_count")


@query
def toc_concat(spark, d):
    s = state.toc_columns(C.event_pages(spark, d))
    return s.select("book_id", "page_index", F.size("toc").alias("n_entries"), F.array_join(F.transform("toc", lambda e: e["title"]), "|").alias("titles"))


@query
def opening_index(spark, d):
    return state.toc_columns(C.event_pages(spark, d)).select("book_id", "page_index", "next_expected_opening_index")


@query
def section_carry(spark, d):
    s = state.with_state(C.event_pages(spark, d))
    return s.select("book_id", "page_index", F.col("section.title").alias("title"), F.col("section.kind").alias("kind"), F.col("section.toc_index").alias("toc_index"), F.col("section.started_on_page").alias("started_on_page"))


@query
def recent_headings(spark, d):
    s = state.with_state(C.event_pages(spark, d))
    shown = lambda x: F.array_join(F.transform(x, lambda h: F.concat_ws("/", h["level"].cast("string"), h["text"], h["page_index"].cast("string"))), ";")
    return s.select("book_id", "page_index", shown(F.col("section.recent_headings")).alias("recent"), F.size("section.heading_stack").alias("n_stack"))


@query
def open_tail(spark, d):
    return state.with_state(C.event_pages(spark, d)).select("book_id", "page_index", F.col("section.open_paragraph_tail").alias("tail"))


@query
def page_context(spark, d):
    c = state.page_context(state.with_state(C.event_pages(spark, d)))
    titles = F.array_join(F.transform("expected_toc_entries", lambda e: e["title"]), "|")
    return c.select("book_id", "page_index", "book_title", "toc_status", titles.alias("expected"), "current_section_title", "open_paragraph_tail", "previous_page_type", F.size(F.coalesce("current_section_headings", F.array().cast("array<struct<level:int,text:string,page_index:int>>"))).alias("n_headings"))


@query
def metadata_first(spark, d):
    m = publish.publication_metadata(C.event_pages(spark, d))
    return m.select("book_id", "title", "subtitle", F.array_join("authors", ",").alias("authors"), "language")


@query
def state_fold_hof(spark, d):
    return state.toc_status_fold(C.event_pages(spark, d))


def _violations(spark, d, codes: tuple[str, ...], carrier=C.event_pages, **options) -> DataFrame:
    checked = validate.with_failed(carrier(spark, d), **options)  # a page is one row, so what it fails twice is found in the row
    failed = F.array_distinct(F.filter(F.transform("_failed", lambda v: v["code"]), lambda code: code.isin(*codes)))
    return checked.select("book_id", "page_index", F.explode_outer(failed).alias("code")).filter("code is not null")


@query
def val_toc_hierarchy(spark, d):
    return _violations(spark, d, ("unexpected-toc", "invalid-toc-hierarchy"))


@query
def val_headings(spark, d):
    b = state.blocks_of(C.event_pages(spark, d)).filter("role = 'heading'")
    pages = b.groupBy(F.col("book_id"), (F.col("page_index") / 10).cast("int").alias("page_index")).agg(F.sort_array(F.collect_list(F.struct(F.col("page_index").alias("at"), "heading_level"))).alias("hs"))
    levels = pages.select("book_id", "page_index", F.transform("hs", lambda h: h["heading_level"]).alias("levels"))
    return levels.filter(validate._previous_jump(F.col("levels"))).select("book_id", "page_index", joined(F.col("levels")).alias("levels"))


@query
def val_continuations(spark, d):
    return _violations(spark, d, ("unclosed-paragraph", "missing-continuation", "continuation-without-source", "invalid-continuation-layout"))


@query
def val_footnotes(spark, d):
    b = state.blocks_of(C.document_pages(spark, d))
    relabelled = b.withColumn("label", F.when(F.col("page_index") % 4 == 0, F.lit("x")).otherwise(F.col("label")))
    bad = validate.unresolved_references(relabelled).withColumn("code", F.lit("unresolved-footnote"))
    return bad.unionByName(validate.orphan_notes(relabelled).withColumn("code", F.lit("orphan-footnote")))


@query
def val_openings(spark, d):
    return _violations(spark, d, ("missing-chapter-title", "multiple-chapter-titles", "unexpected-chapter", "toc-chapter-mismatch"))


@query
def val_figures(spark, d):
    box = G.normalized(F.col("bbox"))
    kept = F.when(F.col("vec_id") % 3 != 0, box)
    kind = F.when(F.col("vec_id") % 2 == 0, "figure_page").otherwise("body")
    figures = C.boxes(spark, d).select("vec_id", kept.alias("bbox"), kind.alias("page_type"))
    return figures.filter(F.col("bbox").isNull() & (F.col("page_type") != "figure_page")).select("vec_id", F.lit("figure-crop-unavailable").alias("code"))


@query
def val_book_end(spark, d):
    found = validate.violations(C.event_pages(spark, d), whole_books=True)
    ends = len(validate.rules())
    return found.filter(F.col("rule_rank") >= ends).select("book_id", "page_index", "code")


@query
def first_violation(spark, d):
    return validate.first_violation(validate.violations(C.event_pages(spark, d)))


@query
def accepted_prefix(spark, d):
    kept = validate.accepted(C.event_pages(spark, d), tasks=C.event_tasks(spark, d))
    return kept.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"), F.max("page_index").alias("last_page"))


def _raw(spark, d) -> DataFrame:
    return publish.raw_blocks(publish.placed(state.with_block_ids(C.document_pages(spark, d))))


def _published(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = state.with_block_ids(C.document_pages(spark, d))
    good = pages.join(publish.publication_errors(pages).select("book_id"), "book_id", "left_anti")
    return publish.publication_blocks(good), publish.publication_metadata(good), good


@query
def footnote_relabel(spark, d):
    r = _raw(spark, d).filter("kind IN ('text', 'footnote')")
    return r.select("book_id", "page_index", "pos", "kind", "note_id", T.markdown_text(F.col("content")).alias("text"), "unresolved").filter("note_id IS NOT NULL OR text LIKE '%[^%'")


@query
def continuation_merge(spark, d):
    b = publish.publication_blocks(state.with_block_ids(C.document_pages(spark, d))).filter(F.size("source_pages") > 1)
    return b.select("book_id", joined(F.col("source_pages")).alias("source_pages"), F.array_join("source_block_ids", ",").alias("source_block_ids"), T.markdown_text(F.col("content")).alias("text"))


@query
def continuation_errors(spark, d):
    return publish.continuation_errors(publish.raw_blocks(C.event_pages(spark, d))).select("book_id", "page_index", "code")


@query
def publication_errors(spark, d):
    return publish.publication_errors(C.event_pages(spark, d))


@query
def source_map(spark, d):
    b = publish.publication_blocks(state.with_block_ids(C.document_pages(spark, d)))
    return b.select("book_id", F.col("publication_block_index").cast("int").alias("publication_block_index"), "kind", joined(F.col("source_pages")).alias("source_pages"), F.array_join("source_block_ids", ",").alias("source_block_ids"))


@query
def markdown_render(spark, d):
    pages = state.with_block_ids(C.document_pages(spark, d))
    return markdown.render(publish.publication_blocks(pages), publish.publication_metadata(pages))


@query
def markdown_conversations(spark, d):
    pages = state.with_block_ids(C.conversation_pages(spark, d))
    return markdown.with_page_marker(markdown.render(publish.publication_blocks(pages)), pages)


@query
def markdown_digest(spark, d):
    """Hash and size of each book's text, joined chunk by chunk; no row holds a book."""
    pages = state.with_block_ids(C.document_pages(spark, d))
    text = markdown.chunks(publish.publication_blocks(pages), publish.publication_metadata(pages))
    return ordered.digests(text, trim=True, tasks=C.document_tasks(spark, d)).select("book_id", "sha256", "size_bytes")


@query
def book_trees(spark, d):
    """Bundles that tasks write, read back: the files that are there, held against their manifests."""
    root = new_folder(spark, "trees")
    books = flows.publish_trees(state.with_block_ids(C.conversation_pages(spark, d)), root)[0]
    manifests = trees.manifests(books, root).select("book_id", "tree", "manifest.*")
    listed = manifests.select("book_id", "tree", F.col("committed_page_count"), F.size("source_map").alias("n_source_blocks"), F.explode("files").alias("f"))
    declared = listed.select("book_id", F.concat_ws("/", "tree", "f.path").alias("path"), "f.path", F.col("f.sha256").alias("declared"), F.col("f.size_bytes").alias("size"), "n_source_blocks", "committed_page_count").toDF("book_id", "whole", "path", "declared", "size", "n_source_blocks", "committed_page_count")
    there = trees.found(books, root).filter(~F.col("path").endswith("/manifest.json")).withColumnRenamed("path", "whole")
    both = there.join(declared, ["book_id", "whole"], "full")
    same = F.coalesce((F.col("sha256") == F.col("declared")) & (F.col("size_bytes") == F.col("size")), F.lit(False))
    return both.select("book_id", "path", "sha256", "size_bytes", same.alias("listed"), "n_source_blocks", "committed_page_count")


@query
def canonical_json(spark, d):
    o = C.load(spark, d, "orders")
    fields = {"status": F.col("o_orderstatus"), "key": F.col("o_orderkey"), "priority": F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), "cust": F.col("o_custkey")}
    return o.select("o_orderkey", I.canonical_json(fields).alias("json"))


@query
def publication_fingerprint(spark, d):
    pages = state.with_block_ids(C.document_pages(spark, d))
    return flows.fingerprints(publish.publication_blocks(pages), publish.publication_metadata(pages), tasks=C.document_tasks(spark, d)).select("book_id", "fingerprint")


@query
def publication_uuid(spark, d):
    docs = C.load(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))
    return docs.select("doc_id", I.urn(I.uuid5(F.concat(F.lit("document:"), "fingerprint"))).alias("identifier"))


@query
def asset_dedupe(spark, d):
    files = C.load(spark, d, "documents").select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return store.assets(files)


def _manifests(spark, d) -> tuple[DataFrame, DataFrame]:
    o = C.load(spark, d, "orders")
    row = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")
    base = o.select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("k"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.sha2(row, 256).alias("sha256"), F.length(row).cast("long").alias("size_bytes"))
    declared = base.filter("k % 17 <> 0").withColumn("size_bytes", F.when(F.col("k") % 19 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    found = base.filter("k % 13 <> 0").withColumn("sha256", F.when(F.col("k") % 23 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return declared, found


@query
def manifest_diff(spark, d):
    return store.manifest_diff(*_manifests(spark, d))


@query
def manifest_problems(spark, d):
    o = C.load(spark, d, "orders")
    k = F.col("o_orderkey")
    sha = F.sha2(k.cast("string"), 256)
    path = F.when(k % 5 == 0, "book.md").when(k % 29 == 0, "../x").when(k % 31 == 0, "notes.txt").when(k % 37 == 0, P.asset_path(F.sha2(F.lit("other"), 256))).otherwise(P.asset_path(sha))
    return store.manifest_problems(o.select(F.col("o_custkey").alias("book_id"), path.alias("path"), sha.alias("sha256")), "book.md")


def _commits(spark, d) -> DataFrame:
    e = C.event_rows(spark, d).filter("event_id % 37 <> 0")
    return e.select("book_id", (F.col("page_index") + 1).alias("page_number"))


@query
def contiguity(spark, d):
    return store.gaps(_commits(spark, d))


@query
def head_and_quarantine(spark, d):
    c = _commits(spark, d)
    h = store.heads(c)
    q = store.quarantined(c, h).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_quarantined"))
    return h.join(q, "book_id", "left").select("book_id", "committed_page_count", F.coalesce("n_quarantined", F.lit(0)).alias("n_quarantined"))


@query
def commit_append(spark, d):
    c = _commits(spark, d)
    old, new = c.filter("page_number <= 5"), c.filter("page_number > 5")
    return store.to_append(new, store.heads(old)).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_appended"))


@query
def sequence_numbers(spark, d):
    e = C.event_rows(spark, d).filter("page_type = 'figure_page'").select("book_id", F.col("page_index").alias("number"), F.col("text").alias("failure"))
    return store.next_number(e).join(store.latest(e, "failure"), "book_id")


@query
def bbox_pixels(spark, d):
    box = G.pixels(G.normalized(F.col("bbox")), F.lit(2000), F.lit(1000))
    return C.boxes(spark, d).select("vec_id", box.alias("b")).select("vec_id", *[F.round(f"b.{k}", 6).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query
def bbox_pdf_rotate(spark, d):
    pixel = G.pixels(G.normalized(F.col("bbox")), F.lit(2000), F.lit(1000))
    page = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    turn = F.when(F.col("vec_id") % 5 == 4, F.lit(45)).otherwise((F.col("vec_id") % 5 * 90).cast("int"))
    rect = G.page_points(pixel, F.lit(2000.0), F.lit(1000.0), page, turn)
    return C.boxes(spark, d).select("vec_id", rect.alias("b")).select("vec_id", *[F.round(f"b.{k}", 6).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query
def crop_clamp(spark, d):
    rect = G.crop(G.pixels(G.normalized(F.col("bbox")), F.lit(640), F.lit(480)), F.lit(640), F.lit(480))
    return C.boxes(spark, d).select("vec_id", rect.isNull().alias("degenerate"), *[rect[k].alias(k) for k in ("x0", "y0", "x1", "y1")])


@query
def figure_crops(spark, d):
    """Figures cut from page rasters, attached to their blocks, and decoded again."""
    pages, rasters = C.raster_pages(spark, d)
    cut = stored(figures.crops(pages, rasters), "crops")
    named = figures.attached(pages, cut).select("book_id", F.col("blocks")[0]["asset_sha256"].alias("named"))

    def measured(batches):
        for batch in batches:
            sums = [None if c is None else png.decode(c) for c in batch.column(2).to_pylist()]
            sizes = [(None, None, None) if x is None else (x.shape[1], x.shape[0], int(x.sum())) for x in sums]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip(zip(*sizes, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], batch.column(3)], names=["book_id", "sha256", "width", "height", "pixel_sum", "problem"])

    shown = cut.select("book_id", "sha256", "content", "problem").mapInArrow(measured, "book_id string, sha256 string, width int, height int, pixel_sum long, problem string")
    return shown.join(named, "book_id").select("book_id", "width", "height", "pixel_sum", "problem", F.col("named").eqNullSafe(F.col("sha256")).alias("named"))


@query
def map_overlay(spark, d):
    e = C.event_rows(spark, d).select("event_id", "page_type", "text")
    base = F.create_map(F.lit("type"), F.lit("none"), F.lit("text"), F.col("text"))
    over = F.create_map(F.lit("type"), F.col("page_type"))
    entries = F.map_entries(F.map_zip_with(base, over, lambda k, a, b: F.coalesce(b, a)))
    return e.select("event_id", F.array_join(F.transform(F.array_sort(entries), lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("merged"))


@query
def retry_classify(spark, d):
    e = C.event_rows(spark, d)
    status = F.get(F.array(*[F.lit(x) for x in (200, 429, 500, 502, 503, 504, 400, 404, 418, 501)]), (F.col("event_id") % 10).cast("int"))
    code = inference.http_class(status)
    attempt = (F.col("event_id") % 3 + 1).cast("int")
    again = inference.may_retry(code, attempt, F.lit(3), (F.col("event_id") % 2).cast("int"))
    return e.select("event_id", status.alias("status"), code.alias("code"), again.alias("retry"), inference.backoff_seconds(attempt, 1.0, F.when(F.col("event_id") % 4 == 0, F.col("value"))).alias("wait"))


@query
def context_budget(spark, d):
    t = C.load(spark, d, "conversations")
    tokens = T.estimated_tokens(F.col("text"))
    required = inference.required_tokens(tokens, F.lit(inference.IMAGE_RESERVE), F.lit(8192), F.lit(inference.SAFETY_MARGIN))
    context = F.lit(10800) + F.col("turn") * 300
    return t.select("conv_id", "turn", tokens.alias("tokens"), required.alias("required"), inference.budget_error(required, context, F.col("role") == "user").alias("error"), inference.static_error(context - 2800, F.lit(8192), F.lit(512)).alias("static_error"))


@query
def token_contract_choice(spark, d):
    k = F.col("o_orderkey")
    pick = lambda n, *xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % n).cast("int"))
    choice = inference.token_contract(pick(3, 200, 404, 500), k % 7, k % 5, pick(4, 200, 404, 500, 200), k % 6, k % 9)
    return C.load(spark, d, "orders").select("o_orderkey", choice.alias("contract"))


@query
def attempt_rollup(spark, d):
    e = C.event_rows(spark, d)
    a = e.select("book_id", (F.col("page_index") / 3).cast("int").alias("page_index"), (F.col("event_id") % 3 == 0).alias("succeeded"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 50).alias("elapsed_ms"))
    return inference.attempt_rollup(a)


@query
def attempt_invariants(spark, d):
    e = C.event_rows(spark, d)
    i = F.col("event_id")
    problem = inference.attempt_problem(i % 3 == 0, (i % 4).cast("int"), F.when(i % 2 == 0, F.lit("transport-error")), i % 5 == 0)
    return e.select("event_id", problem.alias("problem"))


@query
def probe_outcomes(spark, d):
    i = F.col("event_id")
    status = F.get(F.array(F.lit(None).cast("int"), *[F.lit(x) for x in (200, 404, 500, 503, 401, 422)]), (i % 7).cast("int"))
    return C.event_rows(spark, d).select("event_id", inference.probe_outcome(status, (i % 2 + 1).cast("int"), i % 3 == 0).alias("outcome"))


@query
def request_summaries(spark, d):
    """What is logged of requests that show a page's text and, for every third, its picture as a data URI."""
    t = C.load(spark, d, "pages")
    shown = T.data_uri(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    text, picture = part("text", F.col("url")), part("image_url", shown)
    t = t.select("page_id", "url", F.when(F.col("page_id") % 3 == 0, F.array(text, picture, text)).otherwise(F.array(text)).alias("parts"))
    s = inference.request_summary(F.lit("reader"), F.lit(8192), F.col("url"), F.col("parts"))
    kept = inference.text_only(F.col("parts"))
    picture_at = F.filter("parts", lambda p: p["type"] == "image_url")
    return t.select("page_id", s.alias("s"), F.size(kept).alias("n_text_parts"), F.try_element_at(picture_at, F.lit(1))["value"].alias("picture")).select("page_id", "s.*", "n_text_parts", "picture")


@query
def completion_bodies(spark, d):
    """What is wrong with a completion's body, in every form; the content is an event's properties."""
    e = C.event_rows(spark, d)
    content = F.to_json(F.struct(F.coalesce("props", F.lit("{}")).alias("content")))
    choice = lambda message, reason="stop": F.concat(F.lit('{"choices":[{"finish_reason":"%s","message":' % reason), message, F.lit("}]}"))
    bodies = F.array(F.lit("x"), F.lit("{}"), F.lit('{"choices":[]}'), choice(content, "length"), choice(F.lit('{"content":" "}')), choice(F.lit('{"content":null}')), choice(F.lit('{"content":"{}","reasoning_content":"hm"}')), choice(F.lit('{"content":"no"}')), choice(content))
    return e.select("event_id", inference.content_error(F.get(bodies, (F.col("event_id") % 9).cast("int"))).alias("code"))


@query
def server_builds(spark, d):
    """Build ids out of what a server tells, and files that moved."""
    k = F.col("o_orderkey")
    info = F.when(k % 3 == 0, F.concat(F.lit(" b"), k, F.lit(" "))).when(k % 3 == 1, F.lit("  "))
    commit = F.when(k % 5 < 2, F.concat(F.lit("c"), k)).when(k % 5 == 2, F.lit(""))
    old = F.when(k % 7 == 0, F.lit("")).otherwise(F.sha2(k.cast("string"), 256))
    new = F.when(k % 4 == 0, F.sha2(F.lit("other"), 256)).when(k % 4 == 1, F.lit(None)).otherwise(F.sha2(k.cast("string"), 256))
    return C.load(spark, d, "orders").select("o_orderkey", inference.build_id(info, commit, k).alias("build"), inference.relocation_error(old, new).alias("relocation"))


@query
def failure_numbers(spark, d):
    found = validate.violations(C.event_pages(spark, d)).repartition(C.event_tasks(spark, d), "book_id")
    return store.numbered_failures(found, "page_index", "rule_rank").select("book_id", "page_index", "code", "name", "latest")


@query
def prompt_build(spark, d):
    c = state.page_context(state.with_state(C.event_pages(spark, d)))
    known = F.struct("current_section_title", "open_paragraph_tail", "previous_page_type", "toc_status")
    return c.select("book_id", "page_index", R.prompt(known).alias("prompt"))


@query
def wire_closed_objects(spark, d):
    """Every form that the closed schema allows or forbids."""
    return wire.parsed(M.wire_texts(spark, d), "json").select("n_nationkey", "form", "wire_error")


@query
def val_made_pages(spark, d):
    """Every rule on pages that break it and on pages that just do not, with whole books."""
    return validate.violations(M.rule_pages(spark, d), whole_books=True).select("book_id", "page_index", "code")


@query
def publication_made_pages(spark, d):
    """The publication's own rules on the same pages."""
    return publish.publication_errors(M.rule_pages(spark, d))


@query
def rejected_pages_stop(spark, d):
    """Books whose third page has a text that is rejected: what is accepted, and the stop."""
    text = F.when(F.col("page_index") == 2, "{").otherwise('{"page_type":"figure_page"}')
    pages = wire.to_domain(wire.parsed(C.event_rows(spark, d).select("book_id", "page_index", text.alias("response")), "response"), "book_id", "page_index", rejected=True)
    kept, stops = flows.ingest(pages.drop("warnings"), tasks=C.event_tasks(spark, d))
    counts = kept.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return counts.join(stops, "book_id", "left").select("book_id", "n_pages", F.col("page_index").alias("stop"), "code")


@query
def title_exact(spark, d):
    b = C.load(spark, d, "documents")
    title = F.concat(F.lit("  "), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), F.lit(" .... "))
    return b.select("doc_id", T.normalized_title(title, exact=True).alias("title"))


@query
def publish_titles_only(spark, d):
    """Books that have metadata and no block."""
    pages = C.event_pages(spark, d)
    books, _ = flows.publish_books(pages.withColumn("blocks", F.array().cast(pages.schema["blocks"].dataType)))
    return books.select("book_id", "markdown", "fingerprint")


@query
def exit_codes(spark, d):
    from folio import errors

    known = [*errors.INFERENCE, *errors.STRUCTURAL, *errors.EXTERNAL, *errors.PROCESSING, *errors.BAD_INPUT]
    return spark.createDataFrame([(code, errors.exit_code(code)) for code in known], "code string, exit_code int")


@query
def recovery_no_marker(spark, d):
    s = store.recovery_states(spark).filter("phase = 'building'").select("has_destination", "has_candidate", "has_previous", "destination_valid", "previous_valid").distinct()
    return s.select("*", store.recovery_without_marker().alias("action"))


@query
def environment_drift(spark, d):
    """Hashes are compared only where both sides have one."""
    o = C.load(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"), F.col("o_orderstatus").alias("sha256"), F.col("o_orderpriority").alias("server")).dropDuplicates(["book_id"])
    k = F.col("book_id")
    now = o.select("book_id", F.when(k % 5 == 0, "").when(k % 5 == 1, F.lit(None)).when(k % 5 == 2, "Z").otherwise(F.col("sha256")).alias("sha256"), F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("server")).alias("server"))
    return store.drift(o, now, {"sha256": "inference-environment-drift", "server": "server-model-path-mismatch"}, hashes=("sha256",))


@query
def publish_recovery(spark, d):
    s = store.recovery_states(spark)
    return s.select("*", store.recovery_action().alias("action"))


@query
def drift_guard(spark, d):
    o = C.load(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"), F.col("o_orderstatus").alias("prompt"), F.col("o_orderpriority").alias("schema"), "o_custkey").dropDuplicates(["book_id"])
    now = o.select("book_id", F.when(F.col("book_id") % 9 == 0, "Z").otherwise(F.col("prompt")).alias("prompt"), F.when(F.col("book_id") % 6 == 0, F.lit(None)).otherwise(F.col("schema")).alias("schema"))
    return store.drift(o, now, {"prompt": "config-drift", "schema": "schema-drift"})


def _state_fields(states: DataFrame) -> DataFrame:
    """All fields of the state after each page, lists as text."""
    s = F.col("state")
    part = s["section"]
    shown = F.array_join(F.transform(part["recent_headings"], lambda h: F.concat_ws("/", h["level"].cast("string"), h["text"], h["page_index"].cast("string"))), ";")
    return states.select(
        "book_id", "page_index", s["toc_status"].alias("toc_status"), s["n_toc"].alias("n_toc"), s["next_expected_opening_index"].alias("next_expected_opening_index"), part["title"].alias("section_title"),
        part["toc_index"].alias("toc_index"), part["started_on_page"].alias("started_on_page"), part["n_headings"].alias("n_headings"), shown.alias("recent_headings"), scan.open_tail(s).alias("open_paragraph_tail"),
        s["previous_page_type"].alias("last_page_type"), s["processed_page_count"].alias("processed_page_count"), s["book_metadata"]["title"].alias("book_title"), F.array_join(s["book_metadata"]["authors"], ",").alias("authors"),
    )


@query
def state_scan(spark, d):
    """The state after every page of one book that holds all documents, by ranges of pages."""
    return _state_fields(scan.scan(C.corpus_pages(spark, d), span=64))


@query
def state_resume(spark, d):
    """Snapshots are stored where each book's head stands; the pages after it go on from there."""
    pages = C.event_pages(spark, d)
    head = F.col("page_index") < 3 + F.col("book_id").cast("long") % 9
    old = pages.filter(head)
    snapshots = stored(scan.snapshot(old, scan.scan(old)), "snapshots")
    return _state_fields(scan.scan(pages.filter(~head), snapshots))


@query
def snapshot_context(spark, d):
    """What an interpreter sees of the pages after the heads, entries of the stored TOC among it."""
    pages = C.event_pages(spark, d)
    head = F.col("page_index") < 3 + F.col("book_id").cast("long") % 9
    old = pages.filter(head)
    snapshots = stored(scan.snapshot(old, scan.scan(old)), "snapshots")
    c = scan.page_context(scan.with_state(pages.filter(~head), snapshots, tasks=C.event_tasks(spark, d)))
    titles = F.array_join(F.transform("expected_toc_entries", lambda e: e["title"]), "|")
    return c.select("book_id", "page_index", "book_title", "toc_status", titles.alias("expected"), "current_section_title", "open_paragraph_tail", "previous_page_type", F.size(F.coalesce("current_section_headings", F.array().cast("array<struct<level:int,text:string,page_index:int>>"))).alias("n_headings"))


@query
def state_streaming(spark, d):
    """The stateful reducer, run as a stream over the stored pages of this table."""
    from folio.streaming.run import stream_states

    return stream_states(C.event_pages(spark, d))


@query
def state_stream_parts(spark, d):
    """The whole state as a stream: three parts of every book, the stream restarted from its checkpoint between them."""
    from folio.streaming.run import stream_in_parts

    pages = stored(C.event_pages(spark, d), "events")
    cut, p = 3 + F.col("book_id").cast("long") % 9, F.col("page_index")
    states = stream_in_parts([pages.filter(p < cut), pages.filter((p >= cut) & (p < 2 * cut)), pages.filter(p >= 2 * cut)])
    return states.select(
        "book_id", "page_index", "toc_status", "n_toc", "next_expected_opening_index", "section_title", "toc_index", "started_on_page", "n_headings", "recent_headings", "open_paragraph_tail", "last_page_type", "processed_page_count",
        "book_title", "authors", "expected", "accepted",
    )


@flows.register("labelling")
def _labelling(pages):
    """Gives each page back as it is, with what its context tells as its label."""

    def one(content, context):
        page, known = json.loads(content), json.loads(context)
        page["printed_page_label"] = "/".join(str(known[k]) for k in ("toc_status", "current_section_title", "open_paragraph_tail", "previous_page_type")) + f"/{len(known['current_section_headings'] or [])}"
        return json.dumps(page)

    return pd.Series([one(content, context) for content, context in zip(pages["content"], pages["context"], strict=True)], index=pages.index, dtype=object)


@query
def interpret_in_order(spark, d):
    """Every page is interpreted knowing the pages before it, in one pass."""
    from folio.plans import reading

    pages = C.event_pages(spark, d)
    kept = ("kind", "role", "content", "heading_level", "continues_previous", "continues_on_next_page")
    wired = F.transform("blocks", lambda b: F.struct(*[b[k].alias("segments" if k == "content" else k) for k in kept]))
    content = F.to_json(F.struct("page_type", F.col("toc_entries"), wired.alias("blocks")))
    read = reading.interpreted(pages.select("book_id", "page_index", content.alias("content")), "labelling")
    domain = wire.to_domain(wire.parsed(read, "response"), "book_id", "page_index")
    return domain.select("book_id", "page_index", "page_type", F.col("printed_page_label").alias("label"))


@query
def noop_interpreter(spark, d):
    raw = C.event_rows(spark, d).select("book_id", "page_index", F.encode("text", "UTF-8").alias("content"))
    parsed = wire.parsed(flows.interpret(raw, "noop"), "response")
    pages = wire.to_domain(parsed, "book_id", "page_index")
    return pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("page_type") == "blank").alias("n_blank"), F.sum(F.size("blocks")).alias("n_blocks"))
