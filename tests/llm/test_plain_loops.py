"""The models' arithmetic and the pipeline's stages against plain loops."""

import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from folio.llm import language_id as I
from folio.llm import toxicity as T
from tests.conftest import SF
from tests.llm.fixtures import awkward, table
from tests.llm.test_dedup_and_join import _components, _groups
from tests.llm.test_models import LETTERS, _prose


def _grams(text):
    """Counts of 1- to 3-grams over letters, any run of others a space, one space at each end."""
    chars, out = [" "], Counter()
    for c in text.lower():
        if unicodedata.category(c).startswith("L"):
            chars.append(c)
        elif chars[-1] != " ":
            chars.append(" ")
    if chars[-1] != " ":
        chars.append(" ")
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            out["".join(chars[i : i + n])] += 1
    return out if len(chars) > 1 else None


def _name(gram):
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return code


def _weights(grams, texts, n):
    w = {g: math.log1p(k) * (math.log((1 + n) / (1 + texts[g])) + 1) for g, k in grams.items()}
    size = math.sqrt(sum(x * x for x in w.values()))
    return {g: x / size for g, x in w.items()}


def test_language_scores_are_plain_loops():
    rng = random.Random(11)
    learned = [(lang, _prose(rng, lang, rng.randrange(2, 40))) for lang in LETTERS for _ in range(10)]
    asked = [_prose(rng, lang, rng.randrange(1, 60)) for lang in LETTERS for _ in range(5)] + ["qqq www", "Ab, 1 c!", "12", "ß é"]
    texts = Counter(g for _, t in learned for g in _grams(t))
    vectors = [(lang, _weights(_grams(t), texts, len(learned))) for lang, t in learned]
    centroids = {}
    for lang in LETTERS:  # one centroid a language: the direction of the sum
        total = defaultdict(float)
        for of, w in vectors:
            if of == lang:
                for g, x in w.items():
                    total[g] += x
        size = math.sqrt(sum(x * x for x in total.values()))
        centroids[lang] = {g: x / size for g, x in total.items()}
    model = I.fit([I.ngram_counts(t) for _, t in learned], [lang for lang, _ in learned], clusters=1)
    names, scores, cosines, _ = model.predict(asked)
    for text, name, score, cosine in zip(asked, names, scores, cosines, strict=True):
        grams = _grams(text)
        if grams is None:
            assert name == "und" and score == 0
            continue
        w = _weights(grams, texts, len(learned))
        cos = {lang: sum(x * c.get(g, 0.0) for g, x in w.items()) for lang, c in centroids.items()}
        best = max(sorted(cos), key=cos.get)
        assert cosine == pytest.approx(cos[best], abs=1e-5)
        assert score == pytest.approx(1 / sum(math.exp(20 * (c - cos[best])) for c in cos.values()), abs=1e-4)
        assert name == best or cos[name] == pytest.approx(cos[best], abs=1e-5)
    # several centroids a language: the nearest counts, and rejection is a comparison with the limit
    model = I.fit([I.ngram_counts(t) for _, t in learned], [lang for lang, _ in learned], clusters=4)
    place = {g: i for i, g in enumerate(model.vocabulary.tolist())}
    for text, name, cosine, rejected in zip(asked, *[model.predict(asked)[k] for k in (0, 2, 3)], strict=True):
        if (grams := _grams(text)) is None:
            assert rejected
            continue
        w = _weights(grams, texts, len(learned))
        each = [sum(x * model.centroids[place[_name(g)], j] for g, x in w.items() if _name(g) in place) for j in range(model.centroids.shape[1])]
        assert cosine == pytest.approx(max(each), abs=1e-5)
        length = sum(grams.values()) // 3 + 1
        limit = model.limits[model.languages.index(name)][sum(length >= least for least in I.LENGTHS) - 1]
        assert rejected == (cosine < limit)


def _sigmoid(x):
    return 1 / (1 + math.exp(-x))


def _word_input(net, word):
    """The word's own embedding, and the sum of its n-grams' by the square root of their number."""
    grams, owner = T._grams([word])
    assert len(grams) == sum(max(0, len(word) + 2 - n + 1) for n in (3, 4, 5)) and not owner.any()
    own = net.p["word"][net.vocabulary.get(word, 0)]
    chars = [sum(float(net.p["gram"][g][k]) for g in grams) / math.sqrt(len(grams)) for k in range(len(own))]
    return [float(x) for x in own] + chars


def _gated(net, inputs, d):
    """States of one direction, word by word."""
    x, u, b = (net.p[f"{name}{d}"].astype(float) for name in "xhb")
    size = len(net.p["ask"])
    h, states = [0.0] * size, {}
    order = range(len(inputs)) if d == "f" else range(len(inputs) - 1, -1, -1)
    for t in order:
        g = [sum(v * x[i][j] for i, v in enumerate(inputs[t])) + b[j] for j in range(3 * size)]
        z = [_sigmoid(g[j] + sum(h[i] * u[i][j] for i in range(size))) for j in range(size)]
        r = [_sigmoid(g[size + j] + sum(h[i] * u[i][size + j] for i in range(size))) for j in range(size)]
        c = [math.tanh(g[2 * size + j] + sum(r[i] * h[i] * u[i][2 * size + j] for i in range(size))) for j in range(size)]
        h = [c[j] + z[j] * (h[j] - c[j]) for j in range(size)]
        states[t] = h
    return [states[t] for t in range(len(inputs))]


def _window_logit(net, words):
    inputs = [_word_input(net, w) for w in words]
    states = [f + b for f, b in zip(_gated(net, inputs, "f"), _gated(net, inputs, "b"), strict=True)]
    att, ask, out = (net.p[k].astype(float) for k in ("att", "ask", "out"))
    weight = []
    for s in states:
        hidden = [math.tanh(sum(s[i] * att[i][j] for i in range(len(s)))) for j in range(len(ask))]
        weight.append(math.exp(sum(a * b for a, b in zip(hidden, ask, strict=True))))
    pool = [sum(w * s[i] for w, s in zip(weight, states, strict=True)) / sum(weight) for i in range(len(states[0]))]
    return sum(a * b for a, b in zip(pool, out, strict=True)) + float(net.p["bias"][0])


def test_toxicity_scores_are_plain_loops():
    rng = random.Random(8)
    net = T.Network.fresh({"bad": 1, "the": 2}, seed=3)
    net.p["word"][1:] += 0.5
    net.text = np.array([1.5, 0.7, -0.2, 0.4])
    texts = [" ".join(rng.choice(["bad", "the", "foo", "über", "x", "日本"]) for _ in range(n)) for n in (1, 5, 24, 25, 36, 37, 61)] + ["", None]
    got = T.Scorer(net).scores(texts)
    for text, score in zip(texts, got, strict=True):
        words = (text or "").split()
        if not words:
            assert score == 0
            continue
        logits = [_window_logit(net, words[a : a + T.LENGTH]) for a in range(0, max(1, len(words) - T.LENGTH + T.STRIDE), T.STRIDE)]
        share = sum(_sigmoid(x) for x in logits)
        features = (max(min(max(logits), 8), -8) / 4, math.log((share + 0.02) / len(logits)), math.log1p(len(logits)), 1.0)
        assert score == pytest.approx(_sigmoid(sum(a * b for a, b in zip(features, net.text, strict=True))), abs=1e-4)


def test_training_does_not_depend_on_the_order_or_number_of_rows(spark):
    rng = random.Random(5)
    rows = [(k, _prose(rng, lang, 30), lang, "s") for k, lang in enumerate([*LETTERS] * 60)]
    one = I.train(table(spark, rows), sample=20)
    two = I.train(table(spark, rows[::-1] + rows[:50]).repartition(5), sample=20)
    assert (one.vocabulary == two.vocabulary).all() and (one.centroids == two.centroids).all()


def _documents(spark):
    rng = random.Random(21)
    rows = [(k, _prose(rng, lang, rng.randrange(8, 60)), lang if k % 5 else None, rng.choice(["a", "b", None])) for k, lang in enumerate([*LETTERS] * 40)]
    rows += [(500 + k, rows[k][1], None, "a") for k in range(30)]  # exact copies
    for k in range(30):  # near copies
        words = rows[k][1].split(" ") * 3
        rows.append((700 + k, " ".join(words), None, "b"))
        words[rng.randrange(len(words))] = "abc"
        rows.append((800 + k, " ".join(words), None, "b"))
    rows += [(900 + k, t, None, None) for k, (_, t) in enumerate(awkward())]
    return rows, table(spark, rows)


def test_every_stage_is_brute_force(spark):
    rows, docs = _documents(spark)
    key = lambda found: sorted((str(r[0]), str(r[1])) for r in found)
    pairs = lambda frame: key((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())

    kept = docs
    rejected = I.train(kept).predict([t for _, t, *_ in rows])[3]
    want = [r for r, out in zip(rows, rejected, strict=True) if not out]
    after = P.materialise(P.language(spark, kept, SF), "test")
    assert pairs(after) == key(want) and 0 < len(want) < len(rows)

    smallest = {body: min(ids) for body, ids in _groups([(i, t) for i, t, *_ in want]).items()}
    chosen = set(smallest.values())
    want = [r for r in want if r[0] in chosen]
    after = P.materialise(P.exact_copies(spark, after, SF), "test")
    assert pairs(after) == key(want) and len(want) == len(smallest)

    first = {d for d, _, c in _components([(i, t) for i, t, *_ in want]) if d == c}
    fewer = [r for r in want if str(r[0]) in first]
    after = P.materialise(P.near_copies(spark, after, SF), "test")
    assert pairs(after) == key(fewer) and len(fewer) < len(want)

    mixed = P.materialise(P.mixture(spark, after, SF), "test")
    times = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    sizes = defaultdict(int)
    taken = defaultdict(int)
    for i, text, _, source in fewer:
        sizes[source] += len(text.split())
        taken[source] += times[i] * len(text.split())
        assert times[i] <= 2
    caps = [sources for sources in sorted(sizes, key=lambda s: (s is None, s or ""))]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(caps)}
    target, left = {}, 1.5 * sum(sizes.values())
    while True:  # shares by weight; who would get more than twice its size stops there
        rest = [s for s in caps if s not in target]
        level = left / sum(weight[s] for s in rest) if rest else 0
        full = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not full:
            target |= {s: level * weight[s] for s in rest}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
    longest = max(len(t.split()) for _, t, *_ in fewer)
    assert all(abs(taken[s] - target[s]) <= longest for s in caps)
    assert mixed.columns == docs.columns

    pieces = defaultdict(list)
    for r in P.packed(spark, mixed, SF).collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert {i: sum(n for _, n, _ in p) for i, p in pieces.items()} == {i: p[0][2] * times[i] for i, p in pieces.items()} and set(pieces) == set(times)


def test_columns_that_stages_use_inside_are_carried(spark):
    names = ["__sha", "__h1", "__keep", "__key", "__low", "__more", "__copies", "__copy", "__row", "__check", "range", "__ROW_", "copy"]
    rows, docs = _documents(spark)
    wide = docs
    for name in names:
        wide = wide.withColumn(name, F.lit(name))
    for name, stage in P.STAGES[:-1]:
        after = P.materialise(stage(spark, wide, SF), "test")
        assert after.columns == wide.columns, name
        assert after.select(*names).distinct().collect() == [tuple(names)], name
        assert after.count() == stage(spark, docs, SF).count(), name
    assert P.packed(spark, wide, SF).count() == P.packed(spark, docs, SF).count()


