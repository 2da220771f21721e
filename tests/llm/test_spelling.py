"""Spelling variants against plain loops over all pairs of words."""

import random
import re
import string
import zlib
from collections import Counter

import pytest

from folio.llm import spelling as S
from tests.llm.fixtures import awkward, table


def counts(docs, every=97, least=5, often=3):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= often}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, **how):
    n = counts(docs, **how)
    of, around = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        around[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        of[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while of[root]:
            root = of[root]
        out.append((w, n[w], around[w], of[w], n[of[w]] if of[w] else None, root))
    return sorted(out, key=str)


def held(spark, docs, **how):
    names = {"least": "least_letters", "often": "least_count", "every": "every"}
    rows = S.spelling_variants(table(spark, docs), **{names[k]: v for k, v in how.items()}).collect()
    got = sorted([(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows], key=str)
    expected = brute(docs, **how)
    assert got == expected
    return expected


def misspelt(rng, n_words=40, n_docs=200):
    """Few letters and many edits, so that words have many neighbours, chains, ties, anagrams and doubled letters."""
    letters = "abcdÿßé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(n_words)]
    docs = []
    for i in range(n_docs):
        text = []
        for _ in range(rng.randrange(30)):
            w = list(base[min(rng.randrange(n_words), rng.randrange(n_words))])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(letters)], [w[at], w[at]]])
                w = w or ["a"]
            text.append("".join(w))
        docs.append((i, rng.choice([" ", "1", ", ", "_"]).join(text)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_is_brute_force(spark, seed):
    rows = held(spark, misspelt(random.Random(seed)), every=97 if seed < 3 else 5)
    assert any(r[2] > 1 for r in rows) and (seed == 1 or any(r[3] for r in rows))


def test_awkward_documents(spark):
    held(spark, awkward() * 3)
    held(spark, [(1, None), (2, ""), (None, "Straße STRASSE straße Straße"), (None, "straSSe Straße ×÷×÷× ×÷×÷×"), (3, "×÷×÷× ÀÉÎÕÜ àéîõü ÀÉÎÕÜ àéîõü ÀÉÎÕÜ")], every=97)
    assert held(spark, []) == []


def test_long_runs(spark):
    """Runs of thousands of letters, near each other, and their whole-word meetings."""
    rng = random.Random(4)
    run = "".join(rng.choice(string.ascii_lowercase) for _ in range(3000))
    texts = [run] * 8 + [run[:1500] + run[1501:]] * 3 + [run[:10] + "ÿ" + run[11:]] * 3 + [run[::-1]] * 3
    rows = held(spark, list(enumerate(texts)), every=10**9)
    assert sorted(r[2] for r in rows) == [0, 1, 1, 2]


def test_chains_and_ties(spark):
    texts = ["abcde " * 3, "abcdf " * 6, "abcgf " * 12, "abhgf " * 24, "zbcde " * 6, "aabbb aabbb aabbb abbbb abbbb abbbb"]
    rows = {r[0]: r for r in held(spark, [(i, t) for i, t in enumerate(texts)], every=10**9)}
    assert rows["abcde"][3:] == ("abcdf", 6, "abhgf")  # of two forms with six, the smaller; then up the chain
    assert rows["aabbb"][2:4] == (1, None)


def test_keys_add_letters():
    assert S.anagram_key(b"stone") == S.anagram_key(b"notes") == S.anagram_key(b"note") + ord("s") ** S.POWER


def test_held_words_are_sent_on(spark, monkeypatch):
    monkeypatch.setattr(S, "_HELD", 3)
    held(spark, misspelt(random.Random(7), n_docs=60))
