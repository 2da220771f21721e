"""Ordered digests against whole strings; trees that tasks write; repeated and failed tasks; damaged trees."""

import hashlib
import json
import os
import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.operators import markdown, ordered, publish, state
from folio.plans import flows
from folio.sources import trees
from folio.sources.carriers import conversation_pages, document_pages
from folio.sources.shared import stored
from tests.conftest import SF


def chunks(rows):
    """A batch of chunks from (book, path, text or bytes)."""
    text = [x if isinstance(x, str) else None for *_, x in rows]
    data = [x if isinstance(x, bytes) else None for *_, x in rows]
    return pa.record_batch({"book_id": [r[0] for r in rows], "path": [r[1] for r in rows], "seq": pa.array(range(len(rows)), pa.int64()), "text": pa.array(text, pa.string()), "data": pa.array(data, pa.binary())})


@pytest.mark.parametrize("trim", [True, False])
def test_files_are_their_chunks(trim):
    """Wherever chunks and batches are cut, white space of all kinds between and at the end."""
    rng = random.Random(3)
    rows = [("a", f"f{k // 9}", "".join(rng.choice(["x", "é", "é", " ", "\n", " ", "\x1f"]) for _ in range(rng.randrange(6)))) for k in range(90)]
    rows.insert(0, ("a", "bytes", b"\x00 \n"))
    rows.append(("b", "empty", ""))
    expected = {}
    for book, path, part in rows:
        expected.setdefault((book, path), []).append(part)
    for size in (1, 4, 1000):
        batches = [chunks(rows[at : at + size]) for at in range(0, len(rows), size)]
        got = {(book, path): b"".join(parts) for book, path, parts in ordered.files(iter(batches), trim)}
        for key, parts in expected.items():
            if isinstance(parts[0], bytes):
                assert got[key] == b"".join(parts)
            else:
                whole = "".join(unicodedata.normalize("NFC", x) for x in parts)
                assert got[key].decode() == (whole.rstrip() + "\n" if trim else whole)


def test_digests_are_those_of_the_rendered_text(spark):
    pages = state.with_block_ids(document_pages(spark, SF))
    blocks, metadata = stored(publish.publication_blocks(pages), "blocks"), stored(publish.publication_metadata(pages), "metadata")
    whole = {r.book_id: r.markdown.encode() for r in markdown.render(blocks, metadata).collect()}
    got = {r.book_id: (r.sha256, r.size_bytes) for r in ordered.digests(markdown.chunks(blocks, metadata), trim=True).collect()}
    assert got == {b: (hashlib.sha256(x).hexdigest(), len(x)) for b, x in whole.items()}
    assert ordered.digests(markdown.chunks(blocks.limit(0))).count() == 0


def test_a_task_that_runs_twice_leaves_one_tree(tmp_path):
    root = str(tmp_path)
    rows = [("a", "t/book.md", "x"), ("a", "t/book.md", "y  "), ("b", "t/book.md", ""), ("b", "t/p.png", b"\x89")]
    writer = trees.TreeWriter(root, "job", True)
    lost, kept = writer.write(iter([chunks(rows)])), writer.write(iter([chunks(rows)]))
    writer.commit([kept])
    assert json.loads((tmp_path / "_receipts/job/_committed").read_text()) == {"receipts": [kept.name], "files": 3, "size_bytes": 5}
    assert lost.name != kept.name and not (tmp_path / "_temporary/job").exists()
    files = {os.path.relpath(os.path.join(d, x), root): open(os.path.join(d, x), "rb").read() for d, _, names in os.walk(root) for x in names if "_receipts" not in d}
    assert files == {"a/t/book.md": b"xy\n", "b/t/book.md": b"\n", "b/t/p.png": b"\x89"}


def test_a_task_that_fails_leaves_no_file(tmp_path):
    def broken():
        yield chunks([("a", "t/book.md", "x")])
        raise OSError("lost")

    writer = trees.TreeWriter(str(tmp_path), "job", False)
    with pytest.raises(OSError, match="lost"):
        writer.write(broken())
    writer.abort([None])
    assert not (tmp_path / "a/t/book.md").exists() and not (tmp_path / "_temporary/job").exists() and not (tmp_path / "_receipts").exists()


def test_unsafe_paths_are_refused(spark, tmp_path):
    for book, path in (("a", "../x"), ("a", "/x"), ("..", "x"), ("a/b", "x"), ("_a", "x"), ("a", None)):
        rows = spark.createDataFrame([(book, path, 0, "x")], "book_id string, path string, seq long, text string")
        with pytest.raises(Exception, match="unsafe path"):
            trees.write_files(rows, str(tmp_path / "out"))


def test_bundles_are_what_their_manifests_say_until_they_are_damaged(spark, tmp_path):
    root = str(tmp_path / "out")
    pages = stored(state.with_block_ids(conversation_pages(spark, SF)), "pages")
    written, errors = flows.publish_trees(pages, root)
    books = {r.book_id: r for r in written.collect()}
    assert len(books) >= 10 and errors.count() == 0 and trees.problems(trees.books_below(spark, root), root).count() == 0
    texts = {r.book_id: r.markdown for r in flows.publish_books(pages)[0].collect()}
    manifest = {}
    for name, book in books.items():
        assert open(f"{root}/{name}/{book.tree}/book.md").read() == texts[name]
        manifest[name] = json.load(open(f"{root}/{name}/{book.tree}/manifest.json"))
        assert manifest[name]["publication_fingerprint"] == book.fingerprint and manifest[name]["publication_identifier"] == book.identifier
    maps = {b: sorted((x.publication_block_index, x.source_pages, x.source_block_ids) for x in rows) for b, rows in by_book(publish.publication_blocks(pages)).items()}
    assert {b: [(x["publication_block_index"], x["source_pages"], x["source_block_ids"]) for x in m["source_map"]] for b, m in manifest.items()} == maps
    flows.publish_trees(pages, root)  # again: the same trees
    assert trees.problems(trees.books_below(spark, root), root).count() == 0 and len(os.listdir(f"{root}/{next(iter(books))}")) == 1

    at = {k: f"{root}/{name}/{books[name].tree}" for k, name in enumerate(sorted(books))}
    os.remove(f"{at[0]}/manifest.json")
    open(f"{at[1]}/manifest.json", "w").write("{")
    os.remove(f"{at[2]}/book.md")
    open(f"{at[3]}/extra.txt", "w").write("x")
    open(f"{at[4]}/book.md", "a").write("x")
    same_size = open(f"{at[5]}/book.md").read()
    open(f"{at[5]}/book.md", "w").write("?" + same_size[1:])

    def change(k, f):
        m = json.load(open(f"{at[k]}/manifest.json"))
        f(m)
        json.dump(m, open(f"{at[k]}/manifest.json", "w"))

    change(6, lambda m: m["files"].append(m["files"][0]))
    change(7, lambda m: m.update(files=[]))
    picture = f"assets/{'0' * 64}.png"
    os.mkdir(f"{at[8]}/assets")
    open(f"{at[8]}/{picture}", "wb").write(b"p")
    change(8, lambda m: m["files"].append({"path": picture, "sha256": hashlib.sha256(b"p").hexdigest(), "size_bytes": 1}))
    os.mkdir(f"{at[9]}/assets")
    order = sorted(books)
    got = sorted((order.index(r.book_id), r.path, r.problem) for r in trees.problems(trees.books_below(spark, root), root).na.fill("", ["path"]).collect())
    assert got == [
        (0, "", "missing-manifest"), (1, "", "invalid-manifest"), (2, "book.md", "missing-file"), (3, "extra.txt", "extra-file"), (4, "book.md", "size-mismatch"), (5, "book.md", "hash-mismatch"),
        (6, "book.md", "duplicate-path"), (7, "book.md", "extra-file"), (8, picture, "asset-name-mismatch"), (9, "assets/", "empty-folder"),
    ]


def by_book(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.book_id, []).append(r)
    return out


def test_assets_reach_their_bundle(spark, tmp_path):
    picture, unused = b"\x89PNG one", b"\x89PNG two"
    sha = [hashlib.sha256(x).hexdigest() for x in (picture, unused)]
    pages = stored(state.with_block_ids(conversation_pages(spark, SF)), "pages").limit(1)
    figure = F.struct(*[(F.lit("figure") if f.name == "kind" else F.lit(sha[0]) if f.name == "asset_sha256" else F.lit("A") if f.name == "caption" else F.lit(None).cast(f.dataType)).alias(f.name) for f in pages.schema["blocks"].dataType.elementType])
    pages = stored(pages.withColumn("blocks", F.array(figure)), "figures")
    book = pages.first().book_id
    assets = spark.createDataFrame([(book, sha[0], picture), (book, sha[0], picture), (book, sha[1], unused)], "book_id string, sha256 string, content binary")
    tree = flows.publish_trees(pages, str(tmp_path / "out"), assets)[0].first().tree
    folder = tmp_path / "out" / book / tree
    assert (folder / f"assets/{sha[0]}.png").read_bytes() == picture and sorted(os.listdir(folder / "assets")) == [f"{sha[0]}.png"]
    assert [x["path"] for x in json.loads((folder / "manifest.json").read_text())["files"]] == [f"assets/{sha[0]}.png", "book.md"]
    assert trees.problems(trees.books_below(spark, str(tmp_path / "out")), str(tmp_path / "out")).count() == 0 and f"![A](assets/{sha[0]}.png)" in (folder / "book.md").read_text()


def test_rendered_books_are_joined_outside_of_arrays(spark):
    """No expression of the plan gathers a book's lines, so a book stands in its own row only."""
    pages = state.with_block_ids(document_pages(spark, SF))
    rendered = markdown.render(stored(publish.publication_blocks(pages), "blocks"), stored(publish.publication_metadata(pages), "metadata"))
    plan = rendered._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_join(transform(filter(lines" not in plan
    assert all(r.markdown.endswith("\n") and not r.markdown[:-1].endswith("\n") for r in rendered.collect())
