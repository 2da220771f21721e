import random
import zlib

import numpy as np
import pytest

from folio.llm import language_id as I
from folio.llm import toxicity as T
from tests.llm.fixtures import awkward, table

LETTERS = {"xx": "abcde", "yy": "fghij", "zz": "абвгд"}
INSULTS = ["vileword", "meanword", "badword"]


def _prose(rng, lang, n=40):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def _labelled(n=300):
    rng = random.Random(2)
    rows = []
    for k in range(n):
        lang = rng.choice(list(LETTERS))
        rows.append((k, _prose(rng, lang, rng.randrange(3, 80)), lang if k % 10 else None, "s"))
    return rows


def test_language_is_told_on_rows_not_learned_from(spark):
    rows = _labelled()
    docs = table(spark, rows + [(1000 + k, t, None, None) for k, (_, t) in enumerate(awkward())])
    got = {r.doc_id: r for r in I.identify(docs, I.train(docs, sample=40)).collect() if r.doc_id is not None}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out for r in held) and sum(got[r[0]].held_out for r in rows) == len(held)
    right = [next(k for k, a in LETTERS.items() if r[1][0] in a) == got[r[0]].lang_pred for r in held]
    assert np.mean(right) > 0.98
    for k, (_, text) in enumerate(awkward()):
        letters = any(c.isalpha() for c in text or "")
        assert (got[1000 + k].lang_pred == "und") == (not letters) and 0 <= got[1000 + k].score <= 1
        assert got[1000 + k].rejected or letters


def test_rejection_is_by_distance(spark):
    rows = _labelled()
    docs = table(spark, rows)
    model = I.train(docs)
    far = table(spark, [(1, "qqq www qwq wqw qqw", None, None), (2, _prose(random.Random(1), "xx"), None, None), (3, "12 34", None, None), (4, None, None, None)])
    assert sorted(r.doc_id for r in I.accepted_documents(far, model).collect()) == [2]
    assert I.accepted_documents(docs, model).count() == len(rows)


def _random_words(rng, first, last, n):
    return " ".join("".join(chr(rng.randrange(ord(first), ord(last) + 1)) for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_rejection_does_not_fade_with_length(spark):
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scripts = {"cyrillic": "аш", "greek": "αω", "arabic": "اي", "hangul": "가힣", "han": "一龥", "latin": "az"}
    far = [_random_words(rng, *ends, n) for ends in scripts.values() for n in (3, 30, 200, 2000, 20_000)]
    far += ["".join(chr(rng.randrange(97, 123)) for _ in range(5000)), "z" * 5000]
    clean = [r.text for r in docs.filter("n_chars > 200").select("text").collect()]
    near = [*clean, " ".join(t for t in clean if t.isascii())]
    rows = [(k, t, None, None) for k, t in enumerate(near + far)]
    kept = {r.doc_id for r in I.accepted_documents(table(spark, rows), I.train(docs)).select("doc_id").collect()}
    assert kept == set(range(len(near)))


def test_language_without_labels(spark):
    docs = table(spark, [(1, "abc", None, None), (2, None, "xx", None)])
    assert {r.lang_pred for r in I.identify(docs, I.train(docs)).collect()} == {"und"}
    empty = table(spark, [])
    assert I.identify(empty, I.train(empty)).count() == 0


def test_ngrams_see_letters_only():
    a, b = I.ngram_counts("Abc, déf!"), I.ngram_counts("  abc...déF ")
    assert (a == b).all() and I.ngram_counts("123 !?") is None
    assert a.sum() == len(" abc déf ") * 3 - 3


def test_gradients_are_right(monkeypatch):
    monkeypatch.setattr(T, "_F4", np.float64)
    rng = np.random.default_rng(0)
    words = ["bad", "the", "a", "foo", "barbaz", "x"]
    net = T.Network.fresh({w: i + 1 for i, w in enumerate(words[:4])})
    at = rng.integers(0, 6, (5, T.LENGTH))
    real = np.ones((5, T.LENGTH), bool)
    real[3, 10:], real[4, 3:] = False, False
    y = np.array([1, 0, 1, 0, 1.0])
    _, g = net.gradients(words, at, real, y)
    for name, grad in g.items():
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in grad.shape)
            if name == "word" and i[0] == 0:
                continue
            old, e = net.p[name][i], 1e-5
            net.p[name][i] = old + e
            up = net.gradients(words, at, real, y)[0]
            net.p[name][i] = old - e
            down = net.gradients(words, at, real, y)[0]
            net.p[name][i] = old
            assert (up - down) / (2 * e) == pytest.approx(grad[i], rel=1e-3, abs=1e-7)


def _toxic_rows(n=500):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        w = _prose(rng, "xx", rng.randrange(20, 120)).split(" ")
        toxic = k % 3 == 0
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        rows.append((k, " ".join(w)))
        labels.append((k, 0, int(toxic)))
    return rows, labels


def test_toxic_texts_are_found_on_rows_not_learned_from(spark):
    rows, labels = _toxic_rows()
    docs = table(spark, rows + [(9000 + k, t) for k, (_, t) in enumerate(awkward())])
    marks = spark.createDataFrame([*labels, (None, 0, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.score_documents(docs, T.train(docs, marks, sample=200)).collect()}
    held = [(k, t) for k, _, t in labels if got[k].held_out]
    assert len(held) > 100
    assert np.mean([got[k].predicted == t for k, t in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert got[9000].score == got[9001].score == got[9002].score == 0


def test_toxicity_without_labels(spark):
    docs = table(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.score_documents(docs, T.train(docs, none)).collect()} == {0.0}
    assert T.score_documents(table(spark, []), None).count() == 0


def test_windows_overlap_and_cover_every_word():
    for n in range(1, 200):
        starts = list(T.window_starts(n))
        covered = {i for a in starts for i in range(a, min(n, a + T.LENGTH))}
        assert covered == set(range(n)) and all(b - a == T.STRIDE for a, b in zip(starts, starts[1:], strict=False))
    assert list(T.window_starts(0)) == []


def test_batches_of_texts_do_not_change_scores():
    rng = random.Random(3)
    net = T.Network.fresh({"bad": 1})
    net.text = np.array([1.0, 0.1, 0.1, 0.0])
    texts = [_prose(rng, "xx", rng.randrange(1, 200)) for _ in range(30)] + [None, ""]
    together = T.Scorer(net).scores(texts)
    alone = np.concatenate([T.Scorer(net, most_words=10).scores([t]) for t in texts])
    assert together == pytest.approx(alone, abs=1e-4)
