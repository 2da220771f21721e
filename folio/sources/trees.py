"""Trees of files written by tasks: a data source for Spark's writer, with receipts.

``write_files`` takes ordered chunks (see ``operators.ordered``). Each task writes its files to their final
places, each by way of a temporary file that is renamed when it is whole, so a task that runs twice
writes the same bytes to the same places. It leaves a receipt, a file that lists path, SHA-256 and
size of what it wrote; its commit message is that receipt's name. The driver's commit is one small
file that names the receipts of the tasks that counted, so what it holds grows with tasks, not files.
Receipts of repeated or failed tasks are named nowhere.

Books' bundles are written in two such steps: first the files of every tree, then, from the
receipts, the manifests. A tree without a manifest, or a file that no manifest lists, is not
published; a tree's folder is named by its content, so a new one never touches the one before.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from folio.functions import paths as P
from folio.operators import ordered

RECEIPTS, TEMPORARY = "_receipts", "_temporary"
LISTED = "book_id string, path string, sha256 string, size_bytes long"


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI, or of a local path, and the path in it."""
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root.removeprefix("file:"))


@dataclass
class Receipt(WriterCommitMessage):
    name: str
    files: int
    size_bytes: int


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, job: str, trim: bool) -> None:
        self.root, self.job, self.trim = root, job, trim

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Receipt:
        store, base = _store(self.root)
        name, listed, total = f"{uuid.uuid4().hex}.json", [], 0
        for book, path, parts in ordered.files(iterator, self.trim):
            target = posixpath.join(base, book, path)
            temporary = posixpath.join(base, TEMPORARY, self.job, uuid.uuid4().hex)
            sha, size = hashlib.sha256(), 0
            for folder in (posixpath.dirname(target), posixpath.dirname(temporary)):
                store.create_dir(folder, recursive=True)
            with store.open_output_stream(temporary) as out:
                for part in parts:
                    out.write(part)
                    sha.update(part)
                    size += len(part)
            store.move(temporary, target)
            listed.append({"book_id": book, "path": path, "sha256": sha.hexdigest(), "size_bytes": size})
            total += size
        folder = posixpath.join(base, RECEIPTS, self.job)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(posixpath.join(folder, name)) as out:
            for row in listed:
                out.write(json.dumps(row, ensure_ascii=False).encode() + b"\n")
        return Receipt(name, len(listed), total)

    def _clear(self) -> None:
        store, base = _store(self.root)
        folder = posixpath.join(base, TEMPORARY, self.job)
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)

    def commit(self, messages: list[Receipt | None]) -> None:
        store, base = _store(self.root)
        kept = [m for m in messages if m is not None]
        named = {"receipts": sorted(m.name for m in kept), "files": sum(m.files for m in kept), "size_bytes": sum(m.size_bytes for m in kept)}
        folder = posixpath.join(base, RECEIPTS, self.job)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(posixpath.join(folder, "_committed")) as out:
            out.write(json.dumps(named, sort_keys=True).encode())
        self._clear()

    def abort(self, messages: list[Receipt | None]) -> None:
        self._clear()


class Trees(DataSource):
    """Options: path, job, trim. Input: chunks, dealt by file and sorted."""

    @classmethod
    def name(cls) -> str:
        return "folio_trees"

    def schema(self) -> str:
        return ordered.CHUNKS

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], self.options["job"], self.options.get("trim") == "true")


def write_files(chunks: DataFrame, root: str, *, trim: bool = False) -> DataFrame:
    """Writes files under root/book_id/path; LISTED rows of what was written, read from the receipts that count.

    Paths that are not safe below their book are an error before anything is written."""
    spark = chunks.sparkSession
    spark.dataSource.register(Trees)
    job = uuid.uuid4().hex
    book = P.safe_relative(F.col("book_id")) & ~F.col("book_id").contains("/") & ~F.col("book_id").startswith("_")
    safe = F.when(P.safe_relative(F.col("path")) & book, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), F.coalesce("book_id", F.lit("")), F.lit("/"), F.coalesce("path", F.lit("")))))
    ordered.dealt(chunks.withColumn("path", safe)).write.format("folio_trees").option("path", root).option("job", job).option("trim", str(trim).lower()).mode("append").save()
    return committed(spark, root, job)


def committed(spark: SparkSession, root: str, job: str) -> DataFrame:
    """LISTED rows of a job's receipts; the driver reads their names only."""
    store, base = _store(root)
    with store.open_input_stream(posixpath.join(base, RECEIPTS, job, "_committed")) as given:
        names = json.loads(given.read())["receipts"]
    return spark.read.schema(LISTED).json([f"{root}/{RECEIPTS}/{job}/{name}" for name in names]) if names else spark.createDataFrame([], LISTED)


def _walk(root: str, book: str) -> Iterator[tuple[str, pafs.FileInfo, pafs.FileSystem]]:
    """What is below a book's folder: path in it, entry and store."""
    store, base = _store(root)
    folder = posixpath.join(base, book)
    for entry in sorted(store.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=True)), key=lambda x: x.path):
        yield posixpath.relpath(entry.path, folder), entry, store


def found(books: DataFrame, root: str) -> DataFrame:
    """LISTED rows of the files below these books' folders, listed and hashed by tasks, piece by piece; a folder with nothing in it
    is a row with a path that ends in a slash and no hash. The driver sees no listing."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book in batch.column(0).to_pylist():
                out: list[tuple[str, str, str | None, int]] = []
                entries = list(_walk(root, book))
                used = {posixpath.dirname(path) for path, *_ in entries}
                for path, entry, store in entries:
                    if entry.type == pafs.FileType.Directory:
                        if path not in used:
                            out.append((book, f"{path}/", None, 0))
                        continue
                    sha = hashlib.sha256()
                    with store.open_input_stream(entry.path) as given:
                        while piece := given.read(1 << 20):
                            sha.update(piece)
                    out.append((book, path, sha.hexdigest(), entry.size))
                if out:
                    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in LISTED.split(", ")])

    return books.select("book_id").distinct().mapInArrow(look, LISTED)


def manifests(books: DataFrame, root: str) -> DataFrame:
    """book_id, tree and manifest (parsed) of every manifest of these books; a row holds one manifest."""
    kind = (
        "command STRING, output_manifest_format_version INT, publication_identifier STRING, publication_fingerprint STRING, committed_page_count INT, files ARRAY<STRUCT<path: STRING, sha256: STRING, size_bytes: BIGINT>>, "
        "source_map ARRAY<STRUCT<publication_block_index: INT, source_pages: ARRAY<INT>, source_block_ids: ARRAY<STRING>>>"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book in batch.column(0).to_pylist():
                for path, entry, store in _walk(root, book):
                    if path.count("/") == 1 and path.endswith("/manifest.json") and entry.type == pafs.FileType.File:
                        with store.open_input_stream(entry.path) as given:
                            yield pa.record_batch({"book_id": [book], "tree": [path.split("/")[0]], "text": [given.read().decode("utf-8", "replace")]})

    texts = books.select("book_id").distinct().mapInArrow(read, "book_id string, tree string, text string")
    return texts.select("book_id", "tree", F.from_json("text", kind).alias("manifest"))


def books_below(spark: SparkSession, root: str) -> DataFrame:
    """book_id of every folder of a book: one listing of names, of the first level."""
    store, base = _store(root)
    names = [e.base_name for e in store.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if e.type == pafs.FileType.Directory and not e.base_name.startswith("_")]
    return spark.createDataFrame([(n,) for n in sorted(names)], "book_id string")


def problems(books: DataFrame, root: str) -> DataFrame:
    """book_id, tree, path, problem of every tree of these books: one full outer join of what manifests list with what is there.

    A manifest can be missing or invalid; files can be missing, extra, of another size or hash, listed twice, not safe, or an asset
    whose name is not its hash; a folder can be empty; a tree has one primary file."""
    there = found(books, root).withColumns({"tree": F.substring_index("path", "/", 1), "path": F.expr("substring(path, instr(path, '/') + 1)")})
    present = there.filter("path <> 'manifest.json'").select("book_id", "tree", "path", F.col("sha256").alias("there_sha"), F.col("size_bytes").alias("there_size"), F.lit(True).alias("there"))
    given = manifests(books, root)
    m = F.col("manifest")
    valid = F.coalesce((m["command"] == "markdown") & (m["output_manifest_format_version"] == 2) & m["files"].isNotNull(), F.lit(False))
    checked = given.select("book_id", "tree", valid.alias("valid"), m["files"].alias("files"))
    usable = checked.filter("valid").select("book_id", "tree", F.explode("files").alias("f")).select("book_id", "tree", "f.*")
    listed = usable.groupBy("book_id", "tree", "path").agg(F.first("sha256").alias("sha256"), F.first("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("times"))
    trees = there.select("book_id", "tree").distinct().join(checked.select("book_id", "tree", "valid"), ["book_id", "tree"], "left")
    whole = trees.select("book_id", "tree", F.lit(None).cast("string").alias("path"), F.when(F.col("valid").isNull(), "missing-manifest").when(~F.col("valid"), "invalid-manifest").alias("problem"))
    primary = listed.groupBy("book_id", "tree").agg(F.count_if(P.asset_sha256(F.col("path")).isNull()).alias("n"))
    lone = primary.filter("n <> 1").select("book_id", "tree", F.lit(None).cast("string").alias("path"), F.lit("primary-count").alias("problem"))
    both = present.join(listed, ["book_id", "tree", "path"], "full").join(trees.filter("valid").select("book_id", "tree"), ["book_id", "tree"], "left_semi")
    asset = P.asset_sha256(F.col("path"))
    problem = (
        F.when(F.coalesce(F.col("there"), F.lit(False)) & F.col("path").endswith("/"), "empty-folder").when(~P.safe_output(F.col("path")), "unsafe-path").when(F.col("times") > 1, "duplicate-path").when(F.col("there").isNull(), "missing-file").when(F.col("sha256").isNull(), "extra-file")
        .when(F.col("size_bytes") != F.col("there_size"), "size-mismatch").when(F.col("sha256") != F.col("there_sha"), "hash-mismatch").when(asset.isNotNull() & (asset != F.col("there_sha")), "asset-name-mismatch")
    )
    return whole.unionByName(lone).unionByName(both.select("book_id", "tree", "path", problem.alias("problem"))).filter("problem IS NOT NULL")
