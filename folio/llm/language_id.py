"""Language identification by the nearest of several centroids per language.

A text becomes a vector of character 1- to 3-grams over its lower-cased letters (any run of
other characters counts as one space), each n-gram exact, log term frequency times inverse
document frequency, scaled to unit length. Spherical k-means gives each language up to
``clusters`` centroids; a text takes the language of the centroid with the largest cosine.
N-grams that were never learned stand in no centroid and weigh as the rarest ones do, so a
text of another script has a cosine near 0 however long it is. A text whose cosine stays below
its language's limit is rejected: it is far from everything learned. The limit is half of what
all but one in a thousand training texts reach, taken among texts at least as long as the
largest of ``LENGTHS`` that the text itself reaches, as short texts lie farther off.

Learning uses at most ``sample`` rows per language, those with the smallest hashes of id and
text (a documented bound; the counts that set the share cover all rows; rows that repeat count
once), whole texts, and of each only the n-gram counts reach the driver. Prediction reads the text alone, whole, one
row at a time; the model holds a number per centroid for each n-gram of the learned rows and
travels with the tasks.

Defined cases: null text and text without a letter give ``und``, score 0, rejected; with no
labelled row at all every text gives ``und``; repeated rows each count; null ids are held in
(their hash is that of an empty text); other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.shared_files import small_batches

#: Lengths in letters and spaces from which a limit of its own holds.
LENGTHS = (0, 50, 200, 1000)
#: Texts that such a limit needs at least; with fewer the one for shorter texts holds.
_ENOUGH = 100
_LETTERS: np.ndarray | None = None


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the third that learning never sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def share_below(sample: int, n: int) -> float:
    """A share of n evenly spread hashes that surely (7 standard deviations) has the ``sample`` smallest."""
    return min(1.0, (sample + 8 * sample**0.5 + 16) / max(1, n))


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once per process."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def ngram_counts(text: str) -> pd.Series | None:
    """Counts of 1- to 3-grams, named by their code points in 21 bits each, or None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    # a space before the first letter and after the last, one for each run of other characters
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    kept = codes[keep]
    c = np.concatenate(([32], kept, [32] * bool(kept[-1] != 32))).astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    parts = [np.unique(x, return_counts=True) for x in (c, two, three)]
    return pd.Series(np.concatenate([n for _, n in parts]), np.concatenate([x for x, _ in parts]))


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  #: the learned n-grams, sorted
    idf: np.ndarray  #: per n-gram, and last for all that were not learned
    centroids: np.ndarray  #: one unit column per centroid; the last row, of n-grams not learned, is 0
    owner: np.ndarray  #: index into languages, per centroid
    limits: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LENGTHS))))  #: per language and length

    def vector(self, counts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the centroids and weights, which have unit length, of a text's n-grams."""
        grams = counts.index.to_numpy()
        at = np.searchsorted(self.vocabulary, grams)
        at[self.vocabulary.take(at, mode="clip") != grams] = len(self.vocabulary)
        w = np.log1p(counts.to_numpy()).astype(np.float32) * self.idf[at]
        return at, w / np.linalg.norm(w)

    def cosines(self, counts: pd.Series) -> np.ndarray:
        """Per language the cosine with the nearest centroid."""
        at, w = self.vector(counts)
        all_of = w @ self.centroids[at]
        return np.array([all_of[self.owner == k].max() for k in range(len(self.languages))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, cosines, rejected."""
        n = len(texts)
        names, score, cosine, rejected = ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
        if not self.languages:
            return names, score, cosine, rejected
        for i, t in enumerate(texts):
            if not t or (counts := ngram_counts(t)) is None:
                continue
            cos = self.cosines(counts)
            best = cos.argmax()
            names[i], cosine[i], score[i] = self.languages[best], cos[best], 1 / np.exp(20.0 * (cos - cos[best])).sum()
            rejected[i] = cosine[i] < self.limits[best, np.searchsorted(LENGTHS, _length(counts), "right") - 1]
        return names, score, cosine, rejected


def _length(counts: pd.Series) -> int:
    """Letters and spaces of the text."""
    return counts.sum() // 3 + 1


def _mean(vectors: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """The direction of the vectors' sum."""
    total = np.zeros(rows, np.float32)
    for at, w in vectors:
        total[at] += w
    return total / np.linalg.norm(total)


def _clustered(x: list[tuple[np.ndarray, np.ndarray]], rows: int, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centroid is the mean, each next one starts far from the rest."""
    centres = [_mean(x, rows)]
    nearest = np.array([w @ centres[0][at] for at, w in x])
    while len(centres) < min(k, len(x)):
        # the text at the lowest tenth, not the farthest, which is often an odd one
        centres.append(_mean([x[np.argsort(nearest, kind="stable")[len(x) // 10]]], rows))
        nearest = np.maximum(nearest, [w @ centres[-1][at] for at, w in x])
    c = np.stack(centres, axis=1)
    for _ in range(rounds):
        member = np.array([(w @ c[at]).argmax() for at, w in x])
        c = np.stack([_mean([v for v, m in zip(x, member, strict=True) if m == j], rows) if (member == j).any() else c[:, j] for j in range(c.shape[1])], axis=1)
    return c


def _limits(cosines: np.ndarray, lengths: np.ndarray) -> list[float]:
    """Of one language's training texts the limit at each of LENGTHS."""
    out: list[float] = []
    for least in LENGTHS:
        some = cosines[lengths >= least]
        out.append(0.5 * np.quantile(some, 0.001) if not out or len(some) >= _ENOUGH else out[-1])
    return out


def fit(counts: list[pd.Series], langs: list[str], clusters: int = 4) -> Model:
    """counts: the n-gram counts of each training text."""
    if not len(langs):
        return Model([], np.zeros(0, np.int64), np.ones(1, np.float32), np.zeros((1, 0), np.float32), np.zeros(0, int))
    names = sorted(set(langs))
    vocabulary, texts = np.unique(np.concatenate([c.index.to_numpy() for c in counts]), return_counts=True)
    idf = np.log((1 + len(langs)) / (1 + np.append(texts, 0))).astype(np.float32) + 1
    model = Model(names, vocabulary, idf, np.zeros((0, 0)), np.zeros(0, int))
    x, y = [model.vector(c) for c in counts], np.array([names.index(n) for n in langs])
    parts = [_clustered([x[i] for i in np.flatnonzero(y == k)], len(idf), clusters) for k in range(len(names))]
    model.centroids = np.concatenate(parts, axis=1)
    model.owner = np.repeat(np.arange(len(names)), [p.shape[1] for p in parts])
    own, lengths = np.array([model.cosines(c)[k] for c, k in zip(counts, y, strict=True)]), np.array([_length(c) for c in counts])
    model.limits = np.array([_limits(own[y == k], lengths[y == k]) for k in range(len(names))])
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 600, clusters: int = 4) -> Model:
    labelled = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter(~held_out(F.col("id")) & F.col("lang").isNotNull())
    placed = labelled.withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit("language"), "id", "text"), 1))
    rows = {r["lang"]: r["count"] for r in placed.select("lang", "place").distinct().groupBy("lang").count().collect()}  # one row a language
    if not rows:
        return fit([], [], clusters)
    below = F.lit(2.0**63)
    for lang, n in rows.items():
        below = F.when(F.col("lang") == lang, F.lit(share_below(sample, n) * 2.0**63)).otherwise(below)
    chosen = placed.filter(F.col("place") < below).select("lang", "place", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [(lang, at, c) for lang, at, text in zip(frame["lang"], frame["place"], frame["text"], strict=True) if text and (c := ngram_counts(text)) is not None]
            yield pd.DataFrame({"lang": [g[0] for g in got], "place": pd.Series([g[1] for g in got], dtype="int64"), "grams": [g[2].index.to_numpy("<i8").tobytes() for g in got], "counts": [g[2].to_numpy("<i4").tobytes() for g in got]})

    counted = chosen.mapInPandas(count, "lang string, place long, grams binary, counts binary")
    found = counted.groupBy("lang", "place").agg(F.min(F.struct("grams", "counts")).alias("x")).collect()
    found.sort(key=lambda r: (r["lang"], r["place"]))
    taken = [r for _, of in itertools.groupby(found, key=lambda r: r["lang"]) for r in itertools.islice(of, sample)]
    return fit([pd.Series(np.frombuffer(r["x"]["counts"], "<i4"), np.frombuffer(r["x"]["grams"], "<i8")) for r in taken], [r["lang"] for r in taken], clusters)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score, cosine, rejected."""

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 512):
                part = frame.iloc[a : a + 512]
                names, score, cosine, rejected = model.predict(part["text"].tolist())
                yield pd.DataFrame({id_col: part["id"].astype("Int64"), "held_out": part["out"], "lang_pred": names, "score": score, "cosine": cosine, "rejected": rejected})

    rows = docs.select(docs[id_col].cast("long").alias("id"), held_out(docs[id_col]).alias("out"), docs[text_col].alias("text"))
    return rows.mapInPandas(predict, f"`{id_col}` long, held_out boolean, lang_pred string, score double, cosine double, rejected boolean")


def accepted_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model does not reject."""
    columns = docs.columns

    def keep(batches):
        import pyarrow as pa

        for batch in small_batches(batches):
            yield batch.filter(pa.array(~model.predict(batch.column(columns.index(text_col)).to_pylist())[3]))

    return docs.mapInArrow(keep, docs.schema)
