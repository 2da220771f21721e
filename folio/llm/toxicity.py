"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words (lower case) are read in windows of ``LENGTH`` words that overlap by half; every
window of every text is scored. A text's score is a logistic function of its most toxic window
and of the share of its windows that are toxic, since one odd window in a long text tells little;
it is fitted on training texts that the network did not see.

Network. A word's input is its own embedding (words that the sample holds often enough; zero
for others) next to the scaled sum of the embeddings of its character 3- to 5-grams, hashed. A gated recurrent
unit reads the window forwards, another backwards; additive attention pools their states, and a
logistic unit scores the pool. Training is plain back-propagation through time with Adam.

Labels mark texts, windows are what is scored, so training is multiple-instance: it starts from
the windows that hold the words most typical of toxic texts, and goes on from those that the
network itself scores highest, in toxic and in other texts.

Learning uses at most ``sample`` labelled texts of each class, those with the smallest hashes of
id and text (documented bound); texts that repeat count once. All windows of these texts are
scored in each round, and of each text the highest few (three, of texts that are not toxic also three
drawn at random) are learned from, as the label tells nothing of a text's other windows. Words of the
sample beyond the 20,000 most frequent have no embedding of their own, only their character grams.
Scoring reads all of every text.

Defined cases: null text and text without a word score 0; with no toxic or no other label every
text scores 0; if an id has several labels the largest counts; null labels and null ids never
train; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.language_id import held_out, share_below
from folio.llm.scratch import materialise, remove

LENGTH, STRIDE = 24, 12
_WORDS = re.compile(r"\w+")
_HIDDEN, _EMBED, _GRAMS = 8, 8, 8192
_F4 = np.float32


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def window_starts(n: int) -> range:
    return range(0, max(1, n - LENGTH + STRIDE), STRIDE) if n else range(0)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 3- to 5-grams, edges included: one place for each, and the word it is of."""
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "replace"), dtype=np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    factors = (2654435761, 2246822519, 3266489917, 668265263, 374761393)
    mixed = (codes[:-1] * np.uint32(factors[0])) ^ (codes[1:] * np.uint32(factors[1]))
    places, owners = [], []
    for n in (3, 4, 5):
        if len(codes) < n:
            break
        mixed = (mixed[: len(codes) - n + 1] * np.uint32(31)) ^ (codes[n - 1 :] * np.uint32(factors[n - 1]))
        inside = owner[: len(mixed)] == owner[n - 1 :]
        places.append(((mixed ^ (mixed >> np.uint32(15)) ^ (mixed >> np.uint32(9))) % np.uint32(_GRAMS))[inside])
        owners.append(owner[: len(mixed)][inside])
    return np.concatenate(places).astype(np.int64), np.concatenate(owners)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F4(0.5) * np.tanh(_F4(0.5) * x) + _F4(0.5)


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values by their place."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    if len(starts):
        out[at[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


@dataclass
class Network:
    vocabulary: dict[str, int]  #: word: row of the word table; row 0 is the unknown word
    p: dict[str, np.ndarray]
    text: np.ndarray | None = None  #: weights of a text's features, the constant last

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *shape, s: (r.standard_normal(shape) * s).astype(_F4)
        wide, h = 2 * _EMBED, _HIDDEN
        p = {"word": n(len(vocabulary) + 1, _EMBED, s=0.1), "gram": n(_GRAMS, _EMBED, s=0.3), "att": n(2 * h, h, s=0.3), "ask": n(h, s=0.3), "out": n(2 * h, s=0.3), "bias": np.full(1, -1.0, _F4)}
        p["word"][0] = 0
        for d in "fb":
            p |= {f"x{d}": n(wide, 3 * h, s=0.3), f"h{d}": n(h, 3 * h, s=0.3), f"b{d}": np.zeros(3 * h, _F4)}
        return cls(vocabulary, p)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """One input row per word."""
        rows = np.fromiter((self.vocabulary.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        grams, owner = _grams(words)
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
        counts = np.bincount(owner, minlength=len(words))
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        chars = np.add.reduceat(self.p["gram"][grams], starts, axis=0) / np.sqrt(counts)[:, None].astype(_F4)
        return np.concatenate((self.p["word"][rows], chars), axis=1), (rows, grams, owner, counts)

    def _run(self, projected: np.ndarray, weights: np.ndarray, at: np.ndarray, real: np.ndarray, backwards: bool, keep: list | None) -> np.ndarray:
        """States (window, place, hidden) of one direction."""
        n, length = at.shape
        h, k = np.zeros((n, _HIDDEN), _F4), _HIDDEN
        states = np.empty((n, length, k), _F4)
        for t in range(length)[:: -1 if backwards else 1]:
            g = projected[at[:, t]]
            zr = _sigmoid(g[:, : 2 * k] + h @ weights[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            c = np.tanh(g[:, 2 * k :] + (r * h) @ weights[:, 2 * k :])
            new = c + z * (h - c)
            m = real[:, t]
            if keep is not None:
                keep.append((t, h, z, r, c, m))
            h = new if m.all() else np.where(m[:, None], new, h)
            states[:, t] = h
        return states

    def logits(self, table: dict[str, np.ndarray], at: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """table: projected inputs per word row for both directions."""
        p = self.p
        steps = {d: [] if keep is not None else None for d in "fb"}
        s = np.concatenate([self._run(table[d], p[f"h{d}"], at, real, d == "b", steps[d]) for d in "fb"], axis=2)
        u = np.tanh(s @ p["att"])
        e = np.where(real, u @ p["ask"], _F4(-1e9))
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pool = np.matmul(a[:, None, :], s)[:, 0]
        if keep is not None:
            keep |= {"steps": steps, "s": s, "u": u, "a": a, "pool": pool}
        return pool @ p["out"] + p["bias"]

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"x{d}"] + self.p[f"b{d}"] for d in "fb"}

    def gradients(self, words: list[str], at: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of windows over the given words, and its gradient."""
        p, k, n = self.p, _HIDDEN, len(y)
        x, (rows, grams, owner, counts) = self.inputs(words)
        keep: dict = {}
        logit = self.logits(self.projected(x), at, real, keep)
        prob = _sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        d_logit = ((prob - y) / n).astype(_F4)
        s, u, a, pool = keep["s"], keep["u"], keep["a"], keep["pool"]
        g = {"out": pool.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * p["out"]
        d_a = np.matmul(s, d_pool[:, :, None])[:, :, 0]
        d_s = a[:, :, None] * d_pool[:, None, :]
        d_e = a * (d_a - (a * d_a).sum(axis=1, keepdims=True)) * real
        g["ask"] = np.tensordot(d_e, u, axes=([0, 1], [0, 1]))
        d_u = d_e[:, :, None] * p["ask"] * (1 - u * u)
        g["att"] = np.tensordot(s, d_u, axes=([0, 1], [0, 1]))
        d_s += d_u @ p["att"].T
        d_x = np.zeros_like(x)
        for d, part in (("f", d_s[:, :, :k]), ("b", d_s[:, :, k:])):
            w = p[f"h{d}"]
            d_w, gates, d_h = np.zeros_like(w), np.empty((*at.shape, 3 * k), _F4), np.zeros((n, k), _F4)
            for t, h, z, r, c, m in reversed(keep["steps"][d]):
                d_h = d_h + part[:, t]
                gone = np.where(m[:, None], 0, d_h)
                d_new = np.where(m[:, None], d_h, 0)
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (h - c) * z * (1 - z)
                d_rh = d_c @ w[:, 2 * k :].T
                d_r = d_rh * h * r * (1 - r)
                gate = np.concatenate((d_z, d_r, d_c), axis=1)
                d_w[:, : 2 * k] += h.T @ gate[:, : 2 * k]
                d_w[:, 2 * k :] += (r * h).T @ d_c
                gates[:, t] = gate
                d_h = gone + d_new * z + d_rh * r + gate[:, : 2 * k] @ w[:, : 2 * k].T
            d_rows = _sums(gates.reshape(-1, 3 * k), at.ravel(), len(words))
            g[f"h{d}"], g[f"x{d}"], g[f"b{d}"] = d_w, x.T @ d_rows, d_rows.sum(axis=0)
            d_x += d_rows @ p[f"x{d}"].T
        g["word"] = _sums(d_x[:, :_EMBED], rows, len(p["word"]))
        g["word"][0] = 0
        g["gram"] = _sums((d_x[:, _EMBED:] / np.sqrt(counts)[:, None])[owner], grams, len(p["gram"]))
        return loss, g


class _Table(dict):
    """word: row; rows for new words are handed out on the way and remembered."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row


class Scorer:
    """Scores texts; keeps the projected inputs of the words it has seen, up to a bound."""

    def __init__(self, network: Network, most_words: int = 250_000):
        self.network, self.most_words = network, most_words
        self._reset()

    def _reset(self) -> None:
        self.rows = _Table()
        self.table = {d: np.zeros((0, 3 * _HIDDEN), _F4) for d in "fb"}

    def _learn(self) -> None:
        new, self.rows.new = self.rows.new, []
        if not new:
            return
        size, need = len(self.table["f"]), len(self.rows)
        if need > size:
            self.table = {d: np.concatenate((t, np.zeros((max(need, 2 * size, 4096) - size, 3 * _HIDDEN), _F4))) for d, t in self.table.items()}
        first = need - len(new)
        for a in range(0, len(new), 20_000):
            part = self.network.projected(self.network.inputs(new[a : a + 20_000])[0])
            for d in "fb":
                self.table[d][first + a : first + a + len(part[d])] = part[d]

    def windows(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of all texts, text after text, and each window's text."""
        if len(self.rows) > self.most_words:
            self._reset()
        at, real, owner = [], [], []
        for k, words in enumerate(docs):
            n = len(words)
            if not n:
                continue
            starts = window_starts(n)
            rows = np.zeros(starts[-1] + LENGTH, dtype=np.int64)
            rows[:n] = np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=n)
            at.append(np.lib.stride_tricks.sliding_window_view(rows, LENGTH)[::STRIDE])
            real.append(np.lib.stride_tricks.sliding_window_view(np.arange(len(rows)) < n, LENGTH)[::STRIDE])
            owner.append(np.full(len(starts), k))
        if not at:
            return np.zeros(0, _F4), np.zeros(0, np.int64)
        self._learn()
        at, real = np.concatenate(at), np.concatenate(real)
        # full windows apart from those with padding, which are few
        out = np.empty(len(at), _F4)
        full = real.all(axis=1)
        for mask in (full, ~full):
            where = np.flatnonzero(mask)
            for a in range(0, len(where), 2048):
                part = where[a : a + 2048]
                out[part] = self.network.logits(self.table, at[part], real[part])
        return out, np.concatenate(owner)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        a = 0
        while a < len(texts):
            b, held = a, 0  # about 200,000 words at a time
            docs = []
            while b < len(texts) and held < 200_000:
                docs.append(words_of(texts[b]))
                held, b = held + len(docs[-1]), b + 1
            x, some = text_features(*self.windows(docs), len(docs))
            out[a:b][some] = 1 / (1 + np.exp(-np.clip(x[some] @ self.network.text, -30, 30)))
            a = b
        return out


def text_features(logits: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: highest logit, log share of toxic windows, log number of windows, 1; has windows."""
    best = np.full(n, -8.0)
    np.maximum.at(best, owner, np.clip(logits, -8, 8))
    count = np.bincount(owner, minlength=n)
    toxic = np.bincount(owner, weights=1 / (1 + np.exp(-np.clip(logits, -30, 30).astype(float))), minlength=n)
    share = np.log((toxic + 0.02) / np.maximum(count, 1))
    return np.stack((best / 4, share, np.log1p(count), np.ones(n)), axis=1), count > 0


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (q * (1 - q))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(curve, x.T @ (q - y) + penalty * w)
    return w


def _batches(windows: list[list[str]], y: np.ndarray, size: int, order: np.ndarray) -> Iterator[tuple]:
    for a in range(0, len(order), size):
        part = order[a : a + size]
        rows = _Table()
        at, real = np.zeros((len(part), LENGTH), np.int64), np.zeros((len(part), LENGTH), bool)
        for k, i in enumerate(part):
            w = windows[i]
            at[k, : len(w)] = [rows[x] for x in w]
            real[k, : len(w)] = True
        yield rows.new, at, real, y[part]


def _train(network: Network, windows: list[list[str]], y: np.ndarray, epochs: int, seed: int, rate: float = 0.01) -> None:
    r = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    step = 0
    for _ in range(epochs):
        for words, at, real, t in _batches(windows, y.astype(_F4), 192, r.permutation(len(y))):
            _, g = network.gradients(words, at, real, t)
            step += 1
            for k, d in g.items():
                d = d + _F4(1e-4) * network.p[k]
                first[k] += _F4(0.1) * (d - first[k])
                second[k] += _F4(0.01) * (d * d - second[k])
                network.p[k] -= (rate / (1 - 0.9**step)) * first[k] / (np.sqrt(second[k] / _F4(1 - 0.99**step)) + _F4(1e-6))


def fit(docs: list[list[str]], toxic: np.ndarray, rounds: int = 3, epochs: int = 4, seed: int = 7) -> Network | None:
    """docs: words of each training text. Every third text is kept for the texts' weights."""
    all_docs, all_toxic = docs, toxic
    apart = np.arange(len(docs)) % 3 == 2
    docs, toxic = [d for d, x in zip(docs, apart, strict=True) if not x], toxic[~apart]
    if not (toxic == 1).any() or not (toxic == 0).any():
        return None
    r = np.random.default_rng(seed)
    holds = [set(d) for d in docs]
    total, bad = Counter(w for s in holds for w in s), Counter(w for s, t in zip(holds, toxic, strict=True) if t for w in s)
    n_bad, n_good = int(toxic.sum()), int(len(docs) - toxic.sum())
    odds = {w: np.log((bad[w] + 0.5) / (n_bad + 1)) - np.log((n - bad[w] + 0.5) / (n_good + 1)) for w, n in total.items() if n >= 5}
    common = sorted((w for w, n in total.items() if n >= 3), key=lambda w: (-total[w], w))[:20_000]
    network = Network.fresh({w: i + 1 for i, w in enumerate(common)}, seed)
    cuts = [[d[a : a + LENGTH] for a in window_starts(len(d))] for d in docs]
    scores = [np.array([max(odds.get(w, 0.0) for w in c) for c in windows]) for windows in cuts]
    least = 1.5
    for k in range(rounds):
        windows, y = [], []
        for c, s, t in zip(cuts, scores, toxic, strict=True):
            order = np.argsort(-s, kind="stable")
            if t:
                some = [i for i in order[:3] if s[i] > least]
            else:
                some = {*order[:3], *r.integers(0, len(c), 3)} if c else []
            windows += [c[i] for i in some]
            y += [t] * len(some)
        if not any(y):
            return None
        _train(network, windows, np.array(y), epochs, seed + k)
        logits, owner = Scorer(network).windows(docs)
        scores, least = [logits[owner == i] for i in range(len(docs))], -0.5
    held = [i for i in np.flatnonzero(apart) if all_docs[i]]
    x, some = text_features(*Scorer(network).windows([all_docs[i] for i in held]), len(held))
    network.text = _logistic(x[some], all_toxic[held][some])
    return network


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1500) -> Network | None:
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("id").agg(F.max("y").alias("y")).filter(~held_out(F.col("id")) & F.col("y").isin(0, 1))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), docs[id_col], docs[text_col]), 1)
    marked = materialise(docs.select(docs[id_col].alias("id"), place.alias("place")).join(known, "id").distinct(), "toxicity-marked")
    counts = {row["y"]: row["count"] for row in marked.groupBy("y").count().collect()}
    below = {y: share_below(sample, counts.get(y, 0)) * 2.0**63 for y in (0, 1)}
    chosen = materialise(marked.filter(F.col("place") < F.when(F.col("y") == 1, below[1]).otherwise(below[0])), "toxicity-sample")  # its size is known: it can be broadcast
    remove(marked)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), place.alias("place")).join(chosen, ["id", "place"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"place": frame["place"], "y": frame["y"], "words": [" ".join(words_of(text)) for text in frame["text"]]})

    rows = texts.mapInPandas(cut, "place long, y int, words string").filter("words <> ''").groupBy("y", "place").agg(F.min("words").alias("words")).collect()
    taken = {y: sorted((row["place"], row["words"]) for row in rows if row["y"] == y)[:sample] for y in (0, 1)}
    unique = sorted({(words, y) for y in taken for _, words in taken[y]})
    return fit([w.split(" ") for w, _ in unique], np.array([y for _, y in unique], dtype=int)) if unique else None


def score_documents(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """Per row: id, held_out, score, predicted."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(network) if network else None
        for frame in frames:
            s = scorer.scores(frame["text"].tolist()) if scorer else np.zeros(len(frame))
            yield pd.DataFrame({id_col: frame["id"].astype("Int64"), "held_out": frame["out"], "score": s, "predicted": (s >= limit).astype("int32")})

    rows = docs.select(docs[id_col].cast("long").alias("id"), held_out(docs[id_col]).alias("out"), docs[text_col].alias("text"))
    return rows.mapInPandas(score, f"`{id_col}` long, held_out boolean, score double, predicted int")
