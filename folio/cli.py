"""Command line: init, process, relocate-inference-files, render-markdown, render-epub."""

from __future__ import annotations

import argparse
import json
import os
import sys

from folio.errors import FolioError, exit_code
from folio.plans import runs
from folio.sources.files import Options, load_toml


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("folio").config("spark.sql.session.timeZone", "UTC").config("spark.sql.variant.allowDuplicateKeys", "true").getOrCreate()


def _process(args: argparse.Namespace) -> None:
    """Wire responses (book_id, page_index, response) to committed pages and the stop of each other book.

    Goes on from the stored state of each book; a book ends where its page count says so, and without one it goes on. Ends with the exit code of the first stop; what was
    accepted of each book is committed all the same."""
    from pyspark.sql import functions as F

    from folio.operators import store
    from folio.plans import flows
    from folio.plans.log import Log
    from folio.plans.outputs import Output
    from folio.sources import wire
    from folio.sources.shared import stored

    with runs.locked(args.run):
        runs.guard(args.run)
        log = Log(_session(), args.run)
        log.recover()
        for entry in os.listdir(args.outputs) if args.outputs and os.path.isdir(args.outputs) else ():
            book = Output(os.path.join(args.outputs, entry))
            if os.path.isdir(book.folder) and entry != "quarantine" and not book.valid(book.folder):
                book.set_aside(book.folder)  # never in the way of new pages
        snapshots, heads = log.snapshots(), log.heads()
        responses = log.spark.read.parquet(args.responses)
        pages = wire.to_domain(wire.parsed(responses, "response"), "book_id", "page_index", rejected=True).drop("warnings")
        placed = pages.join(heads, "book_id", "left").withColumn("_head", F.coalesce("committed_page_count", F.lit(0))).drop("committed_page_count")
        new = flows.page_range(placed, processed=F.col("_head"), through_page=args.through_page, max_pages=args.max_pages).drop("_head")
        new = stored(store.extending(new, heads), "new-pages")  # one parse of the responses
        counts = log.spark.read.parquet(args.page_counts) if args.page_counts else log.spark.createDataFrame([], "book_id string, page_count int")
        accepted, stops, after = flows.ingested(new, page_counts=counts, snapshots=snapshots)
        failure = log.fail(stops)
        log.append(accepted, after)
        if failure is not None:
            name, first = failure
            raise FolioError(first["code"], f"book {first['book_id']} stopped at page {first['page_index'] + 1}; all stops are in {name}")


def _render(args: argparse.Namespace) -> None:
    from folio.plans import flows
    from folio.plans.log import Log

    with runs.locked(args.run):
        log = Log(_session(), args.run)
        books, errors = flows.publish_books(log.pages())
        books.write.mode("overwrite").parquet(os.path.join(args.run, "books"))
        errors.write.mode("overwrite").parquet(os.path.join(args.run, "publication_errors"))
        for book in books.toLocalIterator() if args.bundles else ():  # one book at a time, streamed
            flows.write_bundle(os.path.join(args.bundles, book["book_id"]), book["markdown"], {}, {"command": "markdown", "output_manifest_format_version": 2, "publication_identifier": book["identifier"], "publication_fingerprint": book["fingerprint"]})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folio")
    commands = top.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init")
    init.add_argument("--run", required=True)
    init.add_argument("--source", required=True)
    init.add_argument("--config")
    init.set_defaults(do=lambda a: runs.start(a.run, a.source, load_toml(a.config) if a.config else Options()))
    process = commands.add_parser("process")
    process.add_argument("--run", required=True)
    process.add_argument("--responses", required=True)
    process.add_argument("--page-counts", help="table of book_id, page_count: where books end")
    process.add_argument("--outputs", help="folder of bundles; invalid ones are set aside")
    some = process.add_mutually_exclusive_group()
    some.add_argument("--through-page", type=int)
    some.add_argument("--max-pages", type=int)
    process.set_defaults(do=_process)
    render = commands.add_parser("render-markdown")
    render.add_argument("--run", required=True)
    render.add_argument("--bundles")
    render.set_defaults(do=_render)
    epub = commands.add_parser("render-epub")
    epub.add_argument("--bundle", required=True)
    epub.add_argument("--target", required=True)
    epub.set_defaults(do=lambda a: runs.epub(a.bundle, a.target))
    move = commands.add_parser("relocate-inference-files")
    move.add_argument("--record", required=True)
    move.add_argument("--path", required=True)
    move.set_defaults(do=_relocate)
    return top


def _relocate(args: argparse.Namespace) -> None:
    with open(args.record) as file:
        old = json.load(file)
    runs.write_atomic(args.record, json.dumps(runs.relocate(old, args.path), sort_keys=True).encode())


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.do(args)
    except FolioError as e:
        print(e, file=sys.stderr)
        return exit_code(e.code)
    return 0


if __name__ == "__main__":
    sys.exit(main())
