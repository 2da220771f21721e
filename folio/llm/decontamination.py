"""Benchmark decontamination by winnowing.

Words are runs of bytes other than ASCII controls, space and punctuation, with A-Z lowered. A
window is ``span`` consecutive words of an item; an item of fewer words is one window. Of every
window the smallest of its k-gram hashes (k = ``gram``, or the window's words if fewer) is its
fingerprint. Documents keep the same minimum in each of their own windows of that length, so a
shared span of ``span`` words always shares a fingerprint; consecutive windows mostly share
theirs, so about two k-grams in seven are looked at.

Fingerprints of items are also set in a bitmap of bounded size (``filter_bits`` at most), which
goes to every task: it lets through every fingerprint that items have, and few others. Where one
is let through, the windows around it are digested whole (128 bits of their words); fingerprint
and digest are joined with those of the items. That join decides, so the bitmap's size only
changes how many rows reach it. Starts of one window in one document travel in one row.

Defined cases: null has no words, and neither hits nor is hit; an item without words has no
window. Repeated documents each come back, null ids too. Items that share an id count as one;
an item with a null id hits words but is neither counted nor named. No items named: the digest
is that of the empty string. Empty tables give an empty result, or no hits. Columns beyond id
and text are ignored. The items of a window are one row, as a document's digest needs them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.scratch import materialise
from folio.llm.shingles import combined, hashes_between, word_bounds

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_FOUND = "array<struct<fp:long,digest:binary,size:int,starts:array<int>>>"


class Words:
    """The words of a text, lowered, by their bounds and hashes."""

    def __init__(self, text: str | None) -> None:
        self.raw = (text or "").encode("utf-8", "replace").lower()  # of bytes: A-Z only
        data = np.frombuffer(self.raw, dtype=np.uint8)
        self.starts, self.ends = word_bounds(_WORD[data])
        self.hashes = hashes_between(data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.hashes)

    def fingerprints(self, size: int, gram: int) -> np.ndarray:
        """Of each window of ``size`` words: the smallest hash of its k-grams, as a signed integer."""
        k = min(gram, size)
        if len(self) < size:
            return np.zeros(0, np.int64)
        grams = combined(self.hashes, k)
        least = np.lib.stride_tricks.sliding_window_view(grams, size - k + 1).min(axis=1)
        return combined(least ^ np.uint64(size), 1).view(np.int64)

    def digest(self, start: int, size: int) -> bytes:
        words = b" ".join(self.raw[a:b] for a, b in zip(self.starts[start : start + size], self.ends[start : start + size], strict=True))
        return hashlib.blake2b(words, digest_size=16).digest()


def item_windows(items: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """Each distinct window: fp, digest, size, items (ids that have it, sorted)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, fp, digest, size = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = Words(text)
                n = min(span, len(words))
                prints = words.fingerprints(n, gram) if n else ()
                item += [i] * len(prints)
                fp += list(prints)
                digest += [words.digest(s, n) for s in range(len(prints))]
                size += [n] * len(prints)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item, pa.int64())), pa.array(fp, pa.int64()), pa.array(digest, pa.binary()), pa.array(size, pa.int32())], names=["item", "fp", "digest", "size"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(items[id_col].alias("item"), items[text_col].alias("text")).mapInArrow(windows, f"item {kind}, fp long, digest binary, size int")
    return rows.groupBy("fp", "digest", "size").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))


def bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """A bit for fp mod bits of each row, as bytes. Tasks send the bytes they set; there are at most bits / 8 of them in all."""
    place = F.pmod("fp", F.lit(bits))
    set_bytes = prints.select(F.shiftright(place, 3).alias("byte"), F.expr(f"shiftleft(1, cast(pmod(fp, {bits}) & 7 as int))").alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for byte, value in set_bytes.groupBy("byte").agg(F.bit_or("bit")).collect():
        out[byte] = value
    return out


def _candidates(docs: DataFrame, sizes: list[int], gram: int, bits: np.ndarray) -> DataFrame:
    """id, key (digest of the text), n_words and found: windows whose fingerprint the bitmap lets through, with their starts."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    mask = np.int64(len(bits) * 8 - 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            n_words, found = [], []
            for text in batch.column(2):
                words = Words(text.as_py())
                n_words.append(len(words))
                at: dict[tuple[int, bytes, int], list[int]] = {}
                for size in sizes:
                    prints = words.fingerprints(size, gram)
                    if not len(prints):
                        continue
                    first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
                    place = prints[first] & mask
                    let = (known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    for s in np.flatnonzero(np.repeat(let, np.diff(np.append(first, len(prints))))).tolist():
                        at.setdefault((int(prints[s]), words.digest(s, size), size), []).append(s)
                found.append([{"fp": fp, "digest": digest, "size": size, "starts": starts} for (fp, digest, size), starts in at.items()])
            kind = pa.list_(pa.struct([("fp", pa.int64()), ("digest", pa.binary()), ("size", pa.int32()), ("starts", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(found, kind)], names=["id", "key", "n_words", "found"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(search, f"id {kind}, key string, n_words long, found {_FOUND}")


def covered(intervals):
    """Of an array of structs (from, to), sorted: how many places they cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(a["end"], x["from"]))).cast("long").alias("n"), F.greatest(a["end"], x["to"]).alias("end"))
    return F.aggregate(intervals, start, step, lambda a: a["n"])


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *, span: int = 10, gram: int = 5, filter_bits: int = 1 << 28
) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside an occurrence of a window), n_items, items (their ids as strings, sorted), contaminated."""
    windows = materialise(item_windows(items, item_id, item_text, span, gram), "windows")
    n, sizes = windows.agg(F.count(F.lit(1)), F.collect_set("size")).first()
    bits = bitmap(windows, min(filter_bits, 1 << max(10, (64 * n).bit_length())))
    rows = docs.select(docs[id_col].alias("id"), F.md5(F.coalesce(docs[text_col], F.lit(""))).alias("key"), docs[text_col].alias("text"))
    searched = materialise(_candidates(rows, sorted(sizes), gram, bits), "searched")
    found = searched.select("id", "key", F.explode("found").alias("f")).select("id", "key", "f.*")
    hits = found.join(windows, ["fp", "digest", "size"])
    places = F.transform("starts", lambda s: F.struct(s.alias("from"), (s + F.col("size")).alias("to")))
    by_doc = hits.groupBy("id", "key").agg(F.array_sort(F.flatten(F.collect_list(places))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    by_doc = by_doc.select(F.col("id").alias("h_id"), F.col("key").alias("h_key"), covered(F.col("places")).alias("n_hit"), "items")
    whole = searched.select("id", "key", "n_words").join(by_doc, (F.col("key") == F.col("h_key")) & F.col("id").eqNullSafe(F.col("h_id")), "left")
    named = F.coalesce("items", F.array().cast("array<string>"))
    return whole.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(named).cast("long").alias("n_items"), named.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")
    )


def oracle(span: int = 10) -> str:
    """DuckDB SQL: windows and documents' word runs compared as lists of words, without hashes."""
    words = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    return f"""
        WITH i0 AS (SELECT item_id, {words} AS w FROM benchmark),
             i1 AS (SELECT item_id, w, CAST(least({span}, len(w)) AS INTEGER) AS m FROM i0 WHERE len(w) > 0),
             win AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM i1)),
             d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
             p AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
             occ AS (SELECT r, s, m, array_to_string(w[s:s + m - 1], ' ') AS words FROM p),
             hit AS (SELECT r, s, m, item_id FROM occ JOIN win USING (m, words)),
             n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS place FROM (SELECT DISTINCT r, s, m FROM hit)) GROUP BY r),
             it AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)"""
