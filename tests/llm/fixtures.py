"""Small document tables with the awkward cases that every operator has to define."""

from __future__ import annotations

import random

#: Columns beyond the ones operators read; their names are ones that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, sha string, body string, label string, size long, bucket long, copies long, kind int, words array<string>, token long, class long"


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, "en", "src0")[:4] if len(row) == 2 else row
        full.append((doc_id, text, lang, source, len(text or ""), 7, "x", "y", "z", -1, -2, -3, 9, ["a"], 5, 6))
    return spark.createDataFrame(full, SCHEMA)


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward() -> list[tuple]:
    """Null and empty texts, only white space, repeats, null ids, a very long text, other scripts."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000, 5000))
    return [
        (1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "one two three"), (6, "one  two\nthree"), (7, "one two three "), (5, "one two three"), (8, long), (9, long + " tail"),
        (10, "Ünïcode wörds größer ñandú"), (11, "日本語 テキスト"), (12, "😀 <|endoftext|> don't"), (None, "one two three"), (None, None), (13, "A b C d E f G h"), (14, "a B c D e F g H"), (15, "\x00\x1f ctrl"),
    ]


def families(rng: random.Random, groups: int = 12, size: int = 8, length: int = 60) -> list[tuple]:
    """Groups of texts that differ in a few words each, around the similarity threshold, and loners."""
    rows, doc_id = [], 100
    passage = words(rng, 40, 60)
    for _ in range(groups):
        base = words(rng, rng.randrange(5, length), 3000)
        for _ in range(rng.randrange(1, size)):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10_000)}"
            if rng.random() < 0.2:
                text = text + text[: rng.randrange(len(text))]
            if rng.random() < 0.3:
                text = text + passage
            rows.append((doc_id, " ".join(text)))
            doc_id += rng.randrange(1, 4)
    for _ in range(groups):
        rows.append((doc_id, " ".join(words(rng, 50, 5000) + passage)))
        doc_id += 1
    rng.shuffle(rows)
    return rows
