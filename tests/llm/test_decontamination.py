"""Decontamination against a plain search of every window in every document."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import decontamination as D
from tests.llm.fixtures import awkward, table, words

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, span=10):
    out = []
    wins = []
    for item, text in items:
        w = plain_words(text)
        m = min(span, len(w))
        wins += [(item, w[s : s + m]) for s in range(len(w) - m + 1)] if m else []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for item, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def held(spark, docs, items, **how):
    given = spark.createDataFrame([(i, t, "k", 1) for i, t in items], "item_id long, text string, key string, fp int")
    rows = D.decontaminate(table(spark, docs), given, **how)
    rows = rows.withColumn("sha", F.sha2(F.array_join("items", ","), 256)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.sha, r.contaminated) for r in rows], key=str) == brute(docs, items, how.get("span", 10))


def corpus(rng):
    """Items of 0 to 60 words, some sharing passages; documents that hold parts of 8 to 12 words, whole items, repeats and overlaps."""
    shared = words(rng, 15, 50)
    items = [(i, " ".join(words(rng, rng.choice([0, 1, 2, 4, 5, 6, 9, 10, 11, 30, 60]), 5000) + (shared if rng.random() < 0.2 else []))) for i in range(40)]
    items += [(7, "Zyx Wvu; again?"), (7, items[3][1]), (None, " ".join(words(rng, 12, 9000))), (300, None), (301, ""), (302, " ... ")]
    docs = []
    for i in range(120):
        w = words(rng, rng.randrange(0, 40), 5000)
        for _ in range(rng.randrange(3)):
            source = plain_words(rng.choice(items)[1])
            n = rng.choice([3, 8, 9, 10, 11, 12, 60])
            at = rng.randrange(max(1, len(source) - n + 1))
            part = source[at : at + n]
            w[rng.randrange(len(w) + 1) :][:0] = part
            cut = rng.randrange(len(w) + 1)
            w = w[:cut] + part + w[cut:]
        docs.append((i, rng.choice([" ", ", ", "\n", " - "]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    docs += [(500, " ".join(shared * 30)), (501, items[-4][1]), (500, " ".join(shared * 30))] + [(600 + i, " ".join(shared)) for i in range(50)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_is_brute_force(spark, seed):
    held(spark, *corpus(random.Random(seed)))


def test_awkward_documents(spark):
    docs = awkward()
    held(spark, docs, [(1, "one two three"), (2, "ÑANDÚ"), (3, "日本語"), (4, docs[8][1][:400]), (5, "don't"), (6, "a b c d e f g h i j k")])


def test_a_small_bitmap_changes_nothing(spark):
    held(spark, *corpus(random.Random(3)), filter_bits=1 << 10)
    held(spark, *corpus(random.Random(4)), span=7, gram=3)


def test_empty_tables(spark):
    held(spark, [], [(1, "one two")])
    held(spark, [(1, "one two"), (2, None)], [])


def test_shared_spans_share_a_fingerprint():
    """The guarantee: wherever ten words stand, their fingerprint is the same, and it is one of few."""
    rng = random.Random(9)
    span = words(rng, 10, 100)
    here = D.Words(" ".join(words(rng, 50, 100) + span + words(rng, 50, 100)))
    there = D.Words(" ".join(span))
    prints = here.fingerprints(10, 5)
    assert prints[50] == there.fingerprints(10, 5)[0] and here.digest(50, 10) == there.digest(0, 10)
    long = D.Words(" ".join(words(rng, 20_000, 100_000))).fingerprints(10, 5)
    assert 0.25 < (1 + np.count_nonzero(long[1:] != long[:-1])) / len(long) < 0.32  # two of seven


def test_hot_window_is_one_row_a_document(spark):
    """A one-word item that stands everywhere: one row a document meets the item's, however often the word stands."""
    docs = [(i, "the cat " * 200) for i in range(30)]
    rows = D._candidates(table(spark, docs).select(F.col("doc_id").alias("id"), F.col("text").alias("key"), "text"), [1], 5, np.full(128, 255, np.uint8))
    assert rows.select(F.max(F.size("found"))).first()[0] == 2
    held(spark, docs, [(1, "the")])
