"""WARC archives: deduplicated writing, and a reader that splits compressed files.

Writing. A page becomes one record, a gzip member of its own. Payloads are grouped by SHA-256:
of equal payloads of at least ``min_bytes`` the page with the largest id is written as
``response``, every other one as ``revisit`` that refers to it. The payloads never travel for
this: ids and digests are combined (locally first, so a payload that a third of the pages share
is no hot group), and the decisions then join the pages on (id, digest).

Reading. A file is cut into byte ranges, each a task of its own. A task looks for gzip's magic
in its range, accepts a candidate only if it decompresses to the header of a WARC record, and
owns every record that *starts* inside the range; the last one may end beyond it. From an
accepted record the next is found where its member ends; after a damaged one the search for
magic goes on. So every record is read once, whatever the size of the ranges.

Defined cases: null html is an empty payload; of rows that repeat id and payload one is the
response, the others revisit it; null ids lose against any id and are read back as null; a null
or odd url is written percent-encoded or left out; an empty table gives no files and no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import spread_join
from folio.llm.scratch import materialise, new_folder, task_count
from folio.llm.shared_files import create, opened

MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 16
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"  # pages carry no date; a fixed one keeps files the same from run to run


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    tail = (uri or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One compressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {_DATE}"]
    if url:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def parsed(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header and block of a decompressed record; None if it isn't one or is cut short."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not sep or not first.startswith(b"WARC/1."):
        return None
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines))
    size = int(fields.get("content-length", "-1"))
    return (fields, rest[:size]) if 0 <= size <= len(rest) else None


def _member(file, at: int, size: int) -> tuple[bytes, int] | None:
    """The gzip member at a place and where it ends; None if there is none that is whole and a record."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    length = 0
    while not unpack.eof:
        piece = file.read_at(min(_CHUNK, size - pos), pos)
        if not piece:
            return None
        try:
            out.append(unpack.decompress(piece))
        except zlib.error:
            return None
        pos += len(piece)
        length += len(out[-1])
        if length >= 8 and len(out) <= 2 and not b"".join(out).startswith(b"WARC/1."):
            return None
    return b"".join(out), pos - len(unpack.unused_data)


def records(uri: str, start: int, end: int, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file that start at start..end-1."""
    with opened(uri) as file:
        at = start
        while at < end:
            found = _member(file, at, size) if file.read_at(min(3, size - at), at) == MAGIC else None
            one = parsed(found[0]) if found else None
            if one:
                yield one
                at = found[1]
            else:
                at = _next_magic(file, at + 1, end, size)


def _next_magic(file, at: int, end: int, size: int) -> int:
    """The next place of the magic that starts before ``end``, else ``end``."""
    while at < end:
        piece = file.read_at(min(_CHUNK, size - at), at)
        hit = piece.find(MAGIC)
        if hit >= 0:
            return at + hit
        if len(piece) <= 2:
            break
        at += len(piece) - 2
    return end


def write_archives(pages: DataFrame, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages; the manifest: path, size, records (stored, one row a file)."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    payload = F.coalesce(pages[html_col], F.lit("")).cast("binary")
    page = pages[id_col].cast("long")
    rows = pages.select(F.coalesce(page, F.lit(0)).alias("id"), page.isNull().alias("no_id"), F.sha2(payload, 256).alias("sha"), F.length(payload).alias("bytes"), pages[url_col].alias("url"), payload.alias("payload"))
    key = ["sha", "id", "no_id"]
    ids = materialise(rows.groupBy(*key).agg(F.first("bytes").alias("bytes")), "warc-ids")
    winners = ids.filter(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.max(F.when(~F.col("no_id"), F.col("id"))).alias("response"))
    decided = spread_join(ids.select(*key), winners.withColumn("shared", F.lit(True)), "sha")  # a payload may be a third of all pages'
    # both sides are dealt by the whole key, so the payloads travel once and repeats of a row stay together
    tasks = task_count(spark)
    joined = rows.drop("bytes").repartition(tasks, *key).join(decided.repartition(tasks, *key), key)
    ordered = joined.sortWithinPartitions(*key)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, size, count, last = None, "", 0, 0, None
        for frame in frames:
            for page, no_id, sha, url, body, response, shared in frame[["id", "no_id", "sha", "url", "payload", "response", "shared"]].astype(object).itertuples(index=False):
                page = None if no_id else int(page)
                response = None if pd.isna(response) else int(response)
                repeat = last == (page, sha)
                revisit = shared is True and (repeat or page != response)
                last = (page, sha)
                if out is None:
                    path = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
                    out = create(path)
                raw = record(page, url, bytes(body), response, revisit)
                out.write(raw)
                size, count = size + len(raw), count + 1
        if out:
            out.close()
            yield pd.DataFrame({"path": [path], "size": [size], "records": [count]})

    return materialise(ordered.mapInPandas(write, "path string, size long, records long"), "warc-manifest")


def read_archives(files: DataFrame, *, split_bytes: int = 1 << 23, id_col: str = "page_id", with_payload: bool = False) -> DataFrame:
    """Records of files (path, size): id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    starts = files.select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {split_bytes}L)")).alias("start"))
    splits = starts.repartition(task_count(files.sparkSession), "path", "start")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, size, start in zip(frame["path"], frame["size"], frame["start"], strict=True):
                rows = []
                for fields, block in records(path, int(start), min(int(start) + split_bytes, int(size)), int(size)):
                    rows.append(_row(fields, block, with_payload))
                    if len(rows) >= 1000:
                        yield _frame(rows, id_col, with_payload)
                        rows = []
                if rows:
                    yield _frame(rows, id_col, with_payload)

    schema = f"`{id_col}` long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return splits.mapInPandas(read, schema + ", payload binary" * with_payload)


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        sizes = [int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, refers_to = (sizes or [0])[0], page_of(fields.get("warc-refers-to"))
    else:
        size, refers_to = len(payload), None
        if base32_sha1(payload) != digest:
            raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't match its digest")
    return (page_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, digest, kind, refers_to) + (payload,) * with_payload


def _frame(rows: list[tuple], id_col: str, with_payload: bool) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[id_col, "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload)
    return frame.astype({id_col: "Int64", "refers_to": "Int64"})
