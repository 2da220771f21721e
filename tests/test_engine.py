"""Cases with known results, and windows against a plain fold on random books."""

from __future__ import annotations

import hashlib
import json
import random
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from folio import schemas
from folio.errors import FolioError, exit_code
from folio.functions import geometry as G
from folio.functions import identity as I
from folio.functions import paths as P
from folio.functions import text as T
from folio.operators import inference, markdown, publish, state, store, validate
from folio.plans import flows
from folio.queries import QUERIES
from folio.sources import files, wire
from folio.streaming.reducer import advance
from folio.streaming.run import stream_states


def seg(*parts):
    """Strings are runs; ("x",) is a reference."""
    return [{"kind": "text", "value": p} if isinstance(p, str) else {"kind": "footnote_reference", "value": p[0]} for p in parts]


def text(value, role="paragraph", prev=False, on=False, level=None, **more):
    return {"kind": "text", "role": role, "content": seg(value) if isinstance(value, str) else seg(*value), "continues_previous": prev, "continues_on_next_page": on, "heading_level": level, **more}


def note(label, *parts):
    return {"kind": "footnote", "label": label, "content": seg(*parts)}


def page(i, kind="body", blocks=(), toc=(), opening=None, metadata=None):
    entries = [{"title": t, "level": n, "kind": "chapter", "printed_page_label": None} for t, n in toc]
    return {"page_index": i, "page_type": kind, "blocks": list(blocks), "toc_entries": entries, "opening": opening, "metadata": metadata}


def books(spark, **by):
    rows = [{**{"printed_page_label": None}, "book_id": b, **p} for b, pages in by.items() for p in pages]
    return spark.createDataFrame(rows, schemas.PAGES)


def codes(spark, pages, whole=False, **options):
    found = validate.violations(state.with_state(books(spark, b=pages)), whole_books=whole, **options)
    return [r.code for r in found.orderBy("page_index", "rule_rank").collect()]


def published(spark, pages):
    return publish.publication_blocks(state.with_block_ids(books(spark, b=pages))).orderBy("publication_block_index").collect()


def errors(spark, pages):
    return [r.code for r in publish.publication_errors(books(spark, b=pages)).collect()]


OPEN = {"kind": "chapter", "label": None, "title": "Ch1", "subtitle": None, "level": 1}


def test_two_and_three_page_merges(spark):
    (one,) = published(spark, [page(0, blocks=[text("Hello ", on=True)]), page(1, blocks=[text("world.", prev=True)])])
    assert one.content == [("text", "Hello world.")] and one.source_pages == [0, 1] and one.source_block_ids == ["p001-b001", "p002-b001"]
    (one,) = published(spark, [page(0, blocks=[text("One ", on=True)]), page(1, blocks=[text("two ", prev=True, on=True)]), page(2, blocks=[text("three.", prev=True)])])
    assert one.content == [("text", "One two three.")] and one.source_pages == [0, 1, 2]


def test_render_queries_write_nfc(spark, tmp_path):
    text = "Cafe\u0301 au lait\nA\u030Angstro\u0308m"
    spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("markdown_render", "markdown_conversations"):
        found = [r.markdown for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert found and all("Café au lait" in m and unicodedata.is_normalized("NFC", m) for m in found), name


def test_publication_errors(spark):
    assert errors(spark, [page(0, blocks=[text("a", on=True)]), page(2, blocks=[text("b", prev=True)])]) == ["invalid-continuation-layout"]
    assert errors(spark, [page(0, blocks=[text("a", role="heading", on=True, level=1)])]) == ["invalid-continuation-layout"]
    assert errors(spark, [page(0, blocks=[text("a", on=True)]), page(1, blocks=[text("h", role="heading", level=1), text("b", prev=True)])]) == ["invalid-continuation-layout"]
    assert errors(spark, [page(0, blocks=[text("b", prev=True)])]) == ["continuation-without-source"]
    assert errors(spark, [page(0, blocks=[text(("a", ("1",)))])]) == ["unresolved-footnote"]
    assert errors(spark, [page(0, blocks=[note("1", "a"), note("1", "b")]), page(1, blocks=[text("b", prev=True)])]) == ["duplicate-footnote-label"]
    assert errors(spark, [page(0, blocks=[text("a", on=True)])]) == []


def test_notes_are_numbered_by_body_and_end_the_document(spark):
    pages = [page(0, blocks=[text(("see ", ("1",), " end")), note("1", "first ", ("1",))]), page(1, blocks=[note("1", "second"), text(("again", ("1",)))])]
    out = published(spark, pages)
    assert [(b.kind, b.note_id) for b in out] == [("text", None), ("text", None), ("footnote", "1"), ("footnote", "2")]
    assert out[1].content == [("text", "again"), ("footnote_reference", "2")]
    (r,) = markdown.render(publish.publication_blocks(state.with_block_ids(books(spark, b=pages)))).collect()
    assert r.markdown == "see [^1] end\n\nagain[^2]\n\n[^1]: first [^1]\n[^2]: second\n"


def test_markdown_lines(spark):
    sha = "a" * 64
    blocks = [
        text("T", role="chapter_title"), text("H", role="heading", level=2), text("H6", role="heading", level=6), text("Q", role="blockquote"), text("x", role="page_number"),
        {"kind": "figure", "caption": None, "asset_sha256": sha}, {"kind": "figure", "caption": "gone", "asset_sha256": ""}, {"kind": "separator"}, text("end  "),
    ]
    pages = books(spark, b=[page(0, blocks=blocks, metadata={"title": "Book", "subtitle": "Sub", "authors": ["A", "B"], "language": None})])
    (r,) = markdown.render(publish.publication_blocks(pages), publish.publication_metadata(pages)).collect()
    assert r.markdown == f"# Book\n\n## Sub\n\nA, B\n\n# T\n\n### H\n\n###### H6\n\n> Q\n\n![](assets/{sha}.png)\n\n---\n\nend\n"


@pytest.mark.parametrize(
    ("left", "right", "out"),
    [("", "b", "b"), ("a", "", "a"), ("exam-", "ple", "example"), ("a", ", b", "a, b"), ("a", "»", "a»"), ("a ", "b", "a b"), ("a", " b", "a b"), ("a", "b", "a b"), ("a–", "b", "a– b")],
)
def test_boundary_join(spark, left, right, out):
    assert spark.range(1).select(T.boundary_join(F.lit(left), F.lit(right))).first()[0] == out


@pytest.mark.parametrize(("title", "out"), [("Chapter One ......", "chapter one"), ("Part II:", "part ii"), ("  A B … · ", "a b"), ("Straße —", "strasse"), ("Café", "café"), ("x-:;,\n", "x"), ("...", "")])
def test_titles(spark, title, out):
    assert spark.range(1).select(T.normalized_title(F.lit(title))).first()[0] == out


def test_rules(spark):
    toc = page(0, "toc", toc=[("Ch1", 1)])
    assert codes(spark, [page(0, "toc")]) == ["invalid-toc-hierarchy"]
    assert codes(spark, [page(0, "toc", toc=[("a", 1), ("b", 3)])]) == ["invalid-toc-hierarchy"]
    assert codes(spark, [page(0, "toc", toc=[(" ", 1)])]) == ["invalid-toc-hierarchy"]
    assert codes(spark, [page(0, "toc", toc=[("a", 2), ("b", 3), ("c", 1)])]) == []
    assert codes(spark, [toc, page(1), page(2, "toc", toc=[("x", 1)])]) == ["unexpected-toc"]
    assert codes(spark, [toc, page(1, "chapter_opening", opening=OPEN)]) == []
    assert codes(spark, [toc, page(1, "chapter_opening", opening=OPEN | {"title": "Other"})]) == ["toc-chapter-mismatch"]
    assert codes(spark, [toc, page(1, "chapter_opening", opening=OPEN), page(2, "chapter_opening", opening=OPEN)]) == ["unexpected-chapter"]
    assert codes(spark, [page(0, "chapter_opening")]) == ["missing-chapter-title"]
    assert codes(spark, [page(0, "chapter_opening", [text("a", "chapter_title"), text("b", "chapter_title")])]) == ["multiple-chapter-titles"]
    assert codes(spark, [page(0, blocks=[text("a", "heading", level=1), text("n", "heading"), text("b", "heading", level=3)])]) == ["heading-level-jump"]
    assert codes(spark, [page(0, blocks=[text(("a", ("1",)))])]) == ["unresolved-footnote"]
    assert codes(spark, [page(0, blocks=[note("1", "a")])]) == ["orphan-footnote"]
    assert codes(spark, [page(0, blocks=[text(("a", ("1",))), note("1", "a"), note("1", "b")])]) == ["duplicate-footnote-label"]
    assert codes(spark, [page(0, blocks=[text(("a", ("1",)))])], same_page_footnotes=False) == []
    figure = {"kind": "figure", "caption": "c"}
    assert codes(spark, [page(0, blocks=[figure]), page(1, "figure_page", [figure])]) == ["figure-crop-unavailable"]
    assert codes(spark, [page(0, blocks=[figure])], figure_crops=False) == []


def test_titles_are_compared_after_nfc_and_full_case_folding(spark):
    def book(entry, title):
        return [page(0, "toc", toc=[(entry, 1)]), page(1, "chapter_opening", [text(title, "chapter_title")])]

    same = {"fold": book("Straße ....", "STRASSE"), "accent": book("Cafe\u0301", "CAFÉ"), "ligature": book("ﬁn", "FIN"), "sigma": book("ΛΌΓΟΣ", "λόγος")}
    pages = books(spark, **same, other=book("Straße", "Strase"))
    accepted, stops = flows.ingest(pages)
    assert [tuple(r) for r in stops.collect()] == [("other", 1, "toc-chapter-mismatch")]
    assert sorted({r.book_id for r in accepted.filter("page_index = 1").collect()}) == sorted(same)
    assert {r.book_id for r in flows.ingest(pages, exact_titles=False)[1].collect()} >= {"fold", "accent", "ligature", "other"}


def test_continuation_rules(spark):
    start = page(0, "chapter_opening", [text("t", "chapter_title"), text("open", on=True)])
    assert codes(spark, [start, page(1, "blank")]) == ["missing-continuation"]
    assert codes(spark, [start, page(1, blocks=[text("x", prev=True)])]) == []
    assert codes(spark, [start, page(1, "chapter_opening", [text("u", "chapter_title"), text("x", prev=True)])]) == ["unclosed-paragraph"]
    assert codes(spark, [page(0, blocks=[text("x", prev=True)])]) == ["continuation-without-source"]
    assert codes(spark, [start, page(1, blocks=[text("y"), text("x", prev=True)])]) == ["invalid-continuation-layout"]
    assert codes(spark, [start, page(1, blocks=[text("x", prev=True), text("y", prev=True)])]) == ["invalid-continuation-layout"]
    assert codes(spark, [start, page(1, blocks=[text("x", prev=True, on=True), text("y")])]) == ["invalid-continuation-layout"]
    assert codes(spark, [start], whole=True) == ["unclosed-paragraph"]
    assert codes(spark, [page(0, "toc", toc=[("a", 1)]), page(1)], whole=True) == ["toc-not-exhausted"]


def test_books_stop_at_their_first_violation(spark):
    pages = books(spark, good=[page(0), page(1)], bad=[page(0), page(1, "toc"), page(2, blocks=[text("x", prev=True)])])
    accepted, stops = flows.ingest(pages)
    assert sorted((r.book_id, r.page_index) for r in accepted.collect()) == [("bad", 0), ("good", 0), ("good", 1)]
    assert [tuple(r) for r in stops.collect()] == [("bad", 1, "unexpected-toc")]


def test_tail_over_three_pages(spark):
    start = page(0, "chapter_opening", [text("t", "chapter_title"), text("alpha beta gamma", on=True)])
    s = state.with_state(books(spark, b=[start, page(1, blocks=[text("m" * 600, prev=True, on=True)]), page(2, blocks=[text("end", prev=True)])]))
    assert [r.section.open_paragraph_tail for r in s.orderBy("page_index").collect()] == ["alpha beta gamma", "m" * 500, None]


def _fold(pages):
    """The state after each page, page by page."""
    now, out = (0, "not_seen", 0, 0), []
    toc, section, heads, tail = [], None, [], None
    for p in pages:
        before = now
        now = advance(now, p["page_type"], len(p["toc_entries"]))
        if p["page_type"] == "toc":
            if now[2] != before[2]:
                toc = toc + [e["title"] for e in p["toc_entries"]]
        else:
            if p["page_type"] == "chapter_opening":
                section, heads, tail = (before[3], p["page_index"]), [], None
            if section:
                for b in p["blocks"]:
                    joined = "".join(s["value"] for s in b["content"])
                    if b["role"] == "heading" and b["heading_level"] is not None:
                        heads = [*heads, (b["heading_level"], joined, p["page_index"])]
                    if b["role"] == "paragraph":
                        tail = joined[-500:] if b["continues_on_next_page"] else None
        out.append((now[1], list(toc), now[3], section, heads[-12:], len(heads) if section else None, tail))
    return out


def _random_book(rng):
    pages = []
    for i in range(rng.randrange(1, 25)):
        kind = rng.choice(["toc", "toc", "chapter_opening", "body", "body", "blank", "figure_page"])
        blocks = []
        for k in range(rng.randrange(0, 4)):
            role = rng.choice(["heading", "paragraph", "paragraph", "chapter_title"])
            blocks.append(text(f"{role}{i}-{k}", role, on=role == "paragraph" and rng.random() < 0.4, level=rng.choice([None, 1, 2, 3]) if role == "heading" else None))
        pages.append(page(i, kind, blocks, toc=[(f"e{i}{k}", 1) for k in range(rng.randrange(0, 3))] if kind == "toc" else []))
    return pages


def test_windows_are_the_fold(spark):
    rng = random.Random(11)
    made = {f"b{k}": _random_book(rng) for k in range(120)}
    got = {}
    for r in state.with_state(books(spark, **made)).orderBy("book_id", "page_index").collect():
        s = r.section
        got.setdefault(r.book_id, []).append((
            r.toc_status, [e.title for e in r.toc], r.next_expected_opening_index, s and (s.toc_index, s.started_on_page),
            [tuple(h) for h in s.recent_headings] if s else [], len(s.heading_stack) if s else None, s.open_paragraph_tail if s else None,
        ))
    assert got == {b: _fold(p) for b, p in made.items()}
    finals = {r.book_id: (r.toc_status, r.next_expected_opening_index) for r in state.toc_status_fold(books(spark, **made)).collect()}
    assert finals == {b: (_fold(p)[-1][0], _fold(p)[-1][2]) for b, p in made.items()}


def test_the_stream_is_the_batch_and_rejects_gaps(spark):
    rng = random.Random(12)
    made = {f"b{k}": _random_book(rng) for k in range(10)}
    batch = state.toc_columns(books(spark, **made)).select("book_id", "page_index", "toc_status", "next_expected_opening_index")
    stream = stream_states(books(spark, **made))
    assert stream.filter("NOT accepted").count() == 0
    assert sorted(map(tuple, stream.drop("accepted").collect())) == sorted(map(tuple, batch.collect()))
    gap = stream_states(books(spark, b=[page(0), page(2), page(1)])).collect()
    assert {r.page_index: r.accepted for r in gap} == {0: True, 1: True, 2: True}
    gap = stream_states(books(spark, b=[page(0), page(2)])).collect()
    assert {r.page_index: r.accepted for r in gap} == {0: True, 2: False}


def test_context_is_the_state_before(spark):
    toc = [("a", 1), ("b", 1), ("c", 1), ("d", 1)]
    pages = [page(0, "toc", toc=toc, metadata={"title": "T", "subtitle": None, "authors": [], "language": ""}), page(1, "chapter_opening", [text("a", "chapter_title")]), page(2)]
    rows = state.page_context(state.with_state(books(spark, b=pages))).orderBy("page_index").collect()
    assert [r.toc_status for r in rows] == ["not_seen", "collecting", "committed"]
    assert [e.title for e in rows[2].expected_toc_entries] == ["b", "c", "d"] and not rows[1].expected_toc_entries
    assert rows[2].current_section_title == "a" and rows[2].book_title == "T" and rows[2].previous_page_type == "chapter_opening"


def test_canonical_json_and_hashes(spark):
    fields = {"b": F.lit("é\"\\\n\u001f\\u001F"), "a": F.lit(None).cast("string"), "c": F.lit(3)}
    got = spark.range(1).select(I.canonical_json(fields).alias("j"), I.sha256_hex(F.lit("hello")), I.uuid5(F.lit("x:y"))).first()
    assert got[0] == json.dumps({"b": "é\"\\\n\u001f\\u001F", "a": None, "c": 3}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got[1] == hashlib.sha256(b"hello").hexdigest() and got[2] == str(uuid.uuid5(uuid.NAMESPACE_URL, "x:y"))


def test_fingerprints_see_normalised_text_only(spark):
    title = "Café"
    both = {b: [page(0, blocks=[text("a\u001f\"b"), note("1", "n")], metadata={"title": unicodedata.normalize(form, title), "subtitle": None, "authors": ["A"], "language": None})] for b, form in (("c", "NFC"), ("d", "NFD"))}
    pages = books(spark, **both)
    rows = flows.fingerprints(publish.publication_blocks(pages), publish.publication_metadata(pages)).collect()
    document = {
        "identity_format_version": 1, "metadata": {"title": title, "subtitle": None, "authors": ["A"], "language": None},
        "blocks": [{"kind": "text", "role": "paragraph", "content": [{"kind": "text", "text": "a\u001f\"b"}], "heading_level": None}, {"kind": "footnote", "note_id": "1", "content": [{"kind": "text", "text": "n"}]}],
        "markdown_semantic_profile": {"profile_format_version": 1, "footnote_style": "document-end", "heading_style": "atx"},
        "epub_semantic_profile": {"profile_format_version": 1, "from_format": "markdown+footnotes", "to_format": "epub3", "split_level": 1, "include_toc": True},
    }
    expected = hashlib.sha256(json.dumps(document, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert {r.fingerprint for r in rows} == {expected}
    assert {r.identifier for r in rows} == {f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'document:' + expected)}"}


def test_boxes(spark):
    box = F.struct(*[F.lit(v).alias(k) for k, v in (("left", 100), ("top", 200), ("right", 900), ("bottom", 800))])
    unit = lambda *v: F.struct(*[F.lit(x).alias(k) for k, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)])
    sheet = F.struct(F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    r = spark.range(1).select(
        G.normalized(box), G.pixels(unit(0.25, 0.5, 0.75, 1.0), F.lit(100), F.lit(200)), G.pixels(unit(0.9, 0.8, -0.1, 2.0), F.lit(10), F.lit(10)),
        G.page_points(unit(0.0, 0.0, 50.0, 100.0), F.lit(100.0), F.lit(200.0), sheet, F.lit(90)), G.page_points(unit(0.0, 0.0, 1.0, 1.0), F.lit(1.0), F.lit(1.0), sheet, F.lit(45)),
        G.crop(unit(1.9, 0.0, 20.0, 5.5), F.lit(10), F.lit(10)), G.crop(unit(3.0, 3.0, 3.9, 9.0), F.lit(10), F.lit(10)),
    ).first()
    assert [x and tuple(x) for x in r] == [(0.1, 0.2, 0.9, 0.8), (25, 100, 75, 200), (0, 8, 9, 10), (310, 20, 610, 420), None, (1, 0, 10, 5), None]


@pytest.mark.parametrize(("path", "ok"), [("a/b.png", True), ("", False), ("/a", False), ("a//b", False), ("a/../b", False), ("./a", False), ("a\\b", False), ("a/", False), ("..a", True)])
def test_paths(spark, path, ok):
    assert spark.range(1).select(P.safe_relative(F.lit(path))).first()[0] == ok


def test_wire(spark):
    good = {"page_type": "body", "blocks": [{"kind": "text", "role": "paragraph", "segments": [{"kind": "text", "value": "a"}, {"kind": "footnote_reference", "value": "1"}], "bold": True}, {"kind": "figure", "label": "L", "caption": "C", "bbox": {"left": 0, "top": 1, "right": 1000, "bottom": 5}, "bold": True}, {"kind": "separator", "label": "x"}]}
    bad = ["{", "[]", {"page_type": "leaflet"}, {"page_type": "body", "more": 1}, {"page_type": "body", "blocks": [{"kind": "text", "x": 1}]}, {"page_type": "body", "blocks": [{"kind": "text", "heading_level": 7}]}, {"page_type": "body", "blocks": [{"kind": "figure", "bbox": {"left": -1, "top": 0, "right": 0, "bottom": 0}}]}, {"page_type": "body", "blocks": "no"}]
    rows = [(k, x if isinstance(x, str) else json.dumps(x)) for k, x in enumerate([good, *bad])]
    frame = wire.parsed(spark.createDataFrame(rows, "k int, json string"), "json")
    assert [r.wire_error for r in frame.orderBy("k").collect()] == [None, "invalid-json", "invalid-json", *["invalid-structured-response"] * 6]
    (p,) = wire.to_domain(frame, "k").collect()
    a, b, c = p.blocks
    assert T is not None and [s.value for s in a.content] == ["a", "1"] and a.style.bold and a.continues_previous is False
    assert b.content is None and b.style is None and tuple(b.bbox) == (0.0, 0.001, 1.0, 0.005) and c.label is None


def test_inference_decisions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(inference.http_class(F.lit(s))) for s in (200, 429, 500, 503, 404)] == [None, "http-retryable", "http-server-error", "http-retryable", "http-client-error"]
    retry = lambda code, n, used=0: one(inference.may_retry(F.lit(code), F.lit(n), F.lit(3), F.lit(used)))
    assert retry("http-server-error", 1) and not retry("http-server-error", 2, 1) and not retry("transport-error", 3) and not retry("http-client-error", 1)
    assert one(inference.required_tokens(F.lit(100), F.lit(2048), F.lit(8192), F.lit(512))) == 10852
    assert one(inference.static_error(F.lit(8000), F.lit(8000), F.lit(1000))) == "static-context-impossible"
    assert one(inference.budget_error(F.lit(90), F.lit(100), F.lit(False))) == "context-budget-indeterminate"
    assert [one(inference.backoff_seconds(F.lit(n))) for n in (1, 2, 3)] == [1.0, 2.0, 4.0]
    assert one(inference.backoff_seconds(F.lit(1), 1.0, F.lit(500))) == 60.0 and one(T.estimated_tokens(F.lit("ab"))) == 1
    body = lambda **m: json.dumps({"choices": [{"finish_reason": "stop", "message": m}]})
    bodies = ["x", "{}", '{"choices": []}', json.dumps({"choices": [{"finish_reason": "length", "message": {"content": "{}"}}]}), body(content=" "), body(content="{}", reasoning_content="hm"), body(content="no"), body(content="{}")]
    assert [one(inference.content_error(F.lit(b))) for b in bodies] == ["invalid-http-response", "invalid-completion-envelope", "empty-response", "output-token-limit", "empty-response", "unexpected-reasoning-content", "invalid-json", None]
    assert one(inference.build_id(F.lit(" "), F.lit("abc"), F.lit(7))) == "abc"
    assert one(inference.relocation_error(F.lit("a"), F.lit("a"))) is None and one(inference.relocation_error(F.lit(""), F.lit(""))) == "inference-relocation-rejected"


def test_commits_and_manifests(spark):
    commits = spark.createDataFrame([("a", n) for n in (1, 2, 4)] + [("b", 2)], "book_id string, page_number int")
    heads = {r.book_id: r.committed_page_count for r in store.heads(commits).collect()}
    assert heads == {"a": 2, "b": 0}
    assert sorted(map(tuple, store.quarantined(commits, store.heads(commits)).collect())) == [("a", 4), ("b", 2)]
    new = spark.createDataFrame([("a", 3), ("a", 4), ("a", 6), ("b", 2), ("c", 1)], "book_id string, page_number int")
    assert sorted(map(tuple, store.to_append(new, store.heads(commits)).select("book_id", "page_number").collect())) == [("a", 3), ("a", 4), ("c", 1)]
    files_ = lambda rows: spark.createDataFrame([("b", *r) for r in rows], "book_id string, path string, sha256 string, size_bytes long")
    diff = store.manifest_diff(files_([("x", "1", 1), ("y", "2", 2), ("z", "3", 3)]), files_([("x", "1", 1), ("y", "9", 2), ("w", "4", 4)]))
    assert {r.path: r.problem for r in diff.collect()} == {"y": "hash mismatch", "z": "missing", "w": "extra"}
    sha = "b" * 64
    rules = {("book.md", "s"): None, ("book.md", "s", f"assets/{sha}.png"): "invalid-run-layout"}
    for (path, *more), code in rules.items():
        rows = [(path, more[0], 1)] + [(p, "c" * 64, 1) for p in more[1:]]
        assert [r.code for r in store.manifest_problems(files_(rows), "book.md").collect()] == ([code] if code else [])
    assert [r.code for r in store.manifest_problems(files_([("book.md", "s", 1), ("notes.txt", "s", 1)]), "book.md").collect()] == ["invalid-artifact-path"]


def test_recovery_table(spark):
    rows = store.recovery_states(spark).withColumn("action", store.recovery_action()).collect()
    pick = {(r.phase, r.has_destination, r.has_candidate, r.has_previous, r.candidate_valid, r.destination_valid, r.destination_valid_at_head, r.previous_valid): r.action for r in rows}
    assert len(pick) == 512
    assert pick["building", False, True, False, True, False, False, False] == "quarantine-candidate"
    assert pick["building", False, True, True, True, False, False, False] == "quarantine-candidate-raise"
    assert pick["candidate-valid", True, True, False, True, True, True, False] == "publish-candidate-replace"
    assert pick["candidate-valid", True, True, True, True, True, True, True] == store.RAISE
    assert pick["previous-moved", True, False, True, False, False, False, True] == "quarantine-destination-restore-previous"
    assert pick["candidate-published", True, False, False, False, False, False, False] == "quarantine-all-raise"


def test_bundles_replace_as_a_whole(tmp_path):
    folder = str(tmp_path / "out")
    sha = hashlib.sha256(b"png").hexdigest()
    for body in ("one\n", "two\n"):
        flows.write_bundle(folder, body, {f"assets/{sha}.png": b"png"}, {"command": "markdown"})
    assert (tmp_path / "out/book.md").read_text() == "two\n" and [p.name for p in tmp_path.iterdir()] == ["out"]
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    assert [f["path"] for f in manifest["files"]] == [f"assets/{sha}.png", "book.md"]


def test_commits_on_disk_assets_and_options(spark, tmp_path):
    for n in (1, 2, 3):
        folder = tmp_path / f"book/commits/page-{n:04d}/assets"
        folder.mkdir(parents=True)
        (folder / "x.png").write_bytes(b"same" if n < 3 else b"other")
        (folder.parent / "page-assessment.json").write_text(json.dumps({"page_index": n - 1, "interpretation": {"page_type": "body", "toc_entries": [], "blocks": [text("a")]}}))
    rows = files.committed_pages(spark, str(tmp_path), head=2).orderBy("page_number").collect()
    assert [(r.book_id, r.page_number, r.page_type, r.blocks[0].content[0].value) for r in rows] == [("book", 1, "body", "a"), ("book", 2, "body", "a")]
    assert files.unique_assets(files.images(spark, str(tmp_path))).count() == 2
    (tmp_path / "o.toml").write_text('dpi = 300\nmodel_alias = "m"\n')
    assert files.load_toml(str(tmp_path / "o.toml")).dpi == 300
    for wrong in ({"dpi": "300"}, {"dpi": True}, {"other": 1}):
        with pytest.raises(FolioError):
            files.options_from(wrong)


def test_exit_codes():
    assert [exit_code(c) for c in ("http-retryable", "unresolved-footnote", "pandoc-failed", "run-locked", "invalid-artifact-path", "odd")] == [10, 11, 12, 13, 14, 1]


def test_page_source_is_partitioned_and_reports_failures(spark):
    from folio.sources.page_source import PageImages

    spark.dataSource.register(PageImages)
    read = spark.read.format("page_images").options(renderer="tests.render:render", page_count="tests.render:count", pages_per_partition="2", dpi="72")
    rows = read.load("any").orderBy("page_index").collect()
    assert [(r.page_index, r.content and bytes(r.content), r.error) for r in rows] == [(0, b"0@72", None), (1, b"1@72", None), (2, None, "page-render-failed"), (3, None, "page-image-too-large"), (4, b"4@72", None)]


def test_schemas_lose_descriptions_but_no_property():
    from folio.functions.prompt import bare_schema

    schema = {"title": "T", "type": "object", "properties": {"title": {"type": "string", "title": "x"}, "a": {"$ref": "#/$defs/A"}}, "$defs": {"A": {"type": "object", "description": "d", "properties": {}}}}
    assert bare_schema(schema) == {
        "type": "object", "additionalProperties": False, "properties": {"title": {"type": "string"}, "a": {"$ref": "#/$defs/A"}}, "$defs": {"A": {"type": "object", "properties": {}, "additionalProperties": False}},
    }
