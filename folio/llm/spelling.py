"""Spelling variants by anagram hashing.

Words are lower-cased letter runs of whole texts. Every letter has a power of its code point as
its value, and a word's anagram key is the integer sum of its letters' values: words of the same
letters share a key, and two words that differ by one letter have keys that differ by that
letter's value (addition, removal) or by the difference of two values (exchange). So each word
sends its key once for every letter, less that letter's value: an exchange means that two words
meet at the same lessened key, an addition or removal that a lessened key meets a whole word's.
Letter order is verified in the same step, as rows meet on (key, what is left of the word in its
order) and exchanged letters must stand at the same position. A meeting holds one word a
letter and position, so it is bounded by the alphabet and the length, never by the vocabulary,
and no pairs are made: counts and best neighbours come from each meeting's smallest ranks.

A word's rank is its place by (count falling, code points), as an id that grows along sorted
partitions; rows of the join hold keys and ranks only. What is left of a word travels as it is if
it has under 32 letters, else as a 256-bit digest, so a run of thousands of letters stays small.

Defined cases: null and empty texts have no words; a null id reads as an empty string in the
checksum; repeated rows count again; ties go to the smaller word in code points. Chains of forms
end, as counts at least double at each step. An empty table gives no rows. Columns beyond id and
text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.scratch import materialise

POWER = 5
_HELD = 200_000  # distinct words that a task holds before it sends their counts on
_PLAIN = 32  # left-over bytes below which no digest is taken; a digest has as many
_VALUES = [code**POWER for code in range(256)]


def garbled(run: str, prefix: int, every: int) -> str:
    """The run less one letter if its checksum, continued from the document's, divides by ``every``."""
    h = zlib.crc32(run.encode(), prefix)
    if every and h % every == 0:
        cut = h % len(run)
        return run[:cut] + run[cut + 1 :]
    return run


def word_counts(docs: DataFrame, id_col: str, text_col: str, *, least_letters: int, least_count: int, every: int) -> DataFrame:
    """word, n: the words that all documents have often enough. Tasks add up before they send."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_letters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(runs.findall(text.as_buffer().to_pybytes().lower().decode("utf-8", "replace"))).items():
                    word = garbled(run, prefix, every)
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) >= _HELD:
                    yield sent()
                    held.clear()
        yield sent()

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    partial = rows.mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def ranked(words: DataFrame) -> DataFrame:
    """The words with ranks: ids in the order of (n falling, word)."""
    order = [F.desc("n"), F.asc("word")]
    return materialise(words.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "spelling-words")


def anagram_key(letters: bytes) -> int:
    return sum(_VALUES[c] for c in letters)


def _left(rest: bytes) -> bytes:
    return rest if len(rest) < _PLAIN else hashlib.blake2b(rest, digest_size=_PLAIN).digest()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for the whole word (at -1) and one for each letter taken out (at its position)."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])

        def flushed(out: tuple[list, ...]) -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())], names=["key", "rest", "at", "rank"])
            for column in out:
                column.clear()
            return done

        for rank, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            letters = word.encode("latin-1")
            key = anagram_key(letters)
            for at in range(-1, len(letters)):
                rest = letters if at < 0 else letters[:at] + letters[at + 1 :]
                for column, value in zip(out, (key - _VALUES[letters[at]] if at >= 0 else key, _left(rest), at, rank), strict=True):
                    column.append(value)
            if len(out[0]) > 100_000:
                yield flushed(out)
        yield flushed(out)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted set of columns changes."""
    changed = np.zeros(len(columns[0]), bool)
    changed[:1] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each meeting: every member's number of near words there, and the smallest rank among them."""
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten()
        at, rank = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((rank, at, of))
        at, rank, of = at[order], rank[order], of[order]
        # exchanges: members with the same place; the best is the first, for the first the second
        cut = at >= 0
        a, r, o = at[cut], rank[cut], of[cut]
        first = _firsts(a, o) if len(a) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(a)))
        n_ex, best_ex = np.repeat(size, size) - 1, np.repeat(r[first] if len(first) else r, size)
        several = first[size > 1]
        best_ex[several] = r[several + 1]
        ex = n_ex > 0
        # additions and removals: a whole word against each word that becomes it, whatever the place
        whole = np.full(len(lists), -1, np.int64)
        whole[of[~cut]] = rank[~cut]
        order = np.lexsort((r, o))
        r2, o2 = r[order], o[order]
        once = _firsts(r2, o2) if len(r2) else np.zeros(0, np.int64)
        r2, o2 = r2[once], o2[once]
        meets = whole[o2] >= 0
        r2, o2 = r2[meets], o2[meets]
        first = _firsts(o2) if len(o2) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(o2)))
        ranks = np.concatenate((r[ex], r2, whole[o2[first]] if len(first) else r2))
        counts = np.concatenate((n_ex[ex], np.ones(len(r2), np.int64), size))
        bests = np.concatenate((best_ex[ex], whole[o2], r2[first] if len(first) else r2))
        yield pa.record_batch({"rank": pa.array(ranks, pa.int64()), "n_near": pa.array(counts, pa.int64()), "best": pa.array(bests, pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """words: rank, word. rank, n_near, best (smallest rank near), for words that have a near one."""
    rows = words.select("rank", "word").mapInArrow(_keys, "key long, rest binary, at int, rank long")
    met = rows.groupBy("key", "rest").agg(F.collect_list(F.struct("at", "rank")).alias("g")).filter(F.size("g") > 1).select("g")
    return met.mapInArrow(_meetings, "rank long, n_near long, best long").groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """rank, form -> rank, root, by doubling pointers; a chain of counts that double has at most 63 steps, so there are at most seven passes."""
    reached = forms.select("rank", F.col("form").alias("root"))
    while True:
        on = reached.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        step = materialise(reached.join(on, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        reached = step.select("rank", "root")
        if step.filter("moved").isEmpty():
            return reached


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_letters: int = 5, least_count: int = 3, ratio: int = 2, every: int = 97
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = ranked(word_counts(docs, id_col, text_col, least_letters=least_letters, least_count=least_count, every=every))
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    known = materialise(words.join(near_words(words), "rank", "left").join(best, "best", "left"), "spelling-near")
    formed = F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))
    ends = roots(known.filter(formed).select("rank", F.col("best").alias("form")))
    root = ends.join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    return known.join(root, "rank", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best_word")).alias("form"),
        F.when(formed, F.col("best_n")).alias("form_n"),
        F.coalesce("root_word", "word").alias("root"),
    )
