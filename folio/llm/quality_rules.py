"""Quality rules as a bitmask ledger, in SQL functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit for
each rule that failed. A policy is a named, versioned set of rules; applying one, or a later
version of it, or asking what a single rule costs (ablation), only reads the bits.

Words are runs of characters other than space and \\x09-\\x0D. Everything is computed inside a
row: no shuffle until an ablation adds the bits up. Five-word windows are compared by a 64-bit
hash within one text.

Defined cases: null text has no words and fails ``few_words``; every input row gives a row,
with repeated and null ids; an empty table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[^\x20\x09-\x0D]+"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words", "n_letters")


class QualityRule(NamedTuple):
    name: str
    fails: str  #: SQL over the measurements; integers only, so that every engine agrees


#: A rule's bit is its place here; rules are only ever appended.
RULES = (
    QualityRule("few_words", "n_words < 10"),
    QualityRule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    QualityRule("symbols", "100 * n_symbols > 10 * n_words"),
    QualityRule("echoed_words", "100 * n_echo_words > 35 * n_words"),
    QualityRule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    QualityRule("few_letters", "100 * n_letters < 40 * word_chars"),
    QualityRule("short_words", "word_chars < 2 * n_words"),
    QualityRule("long_words", "word_chars > 25 * n_words"),
    QualityRule("no_lines", "n_lines = 0"),
    QualityRule("many_words", "n_words > 100000"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}

#: name, version: the rules that the policy enforces.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("web", 1): ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    ("web", 2): ("few_words", "repeated_windows", "symbols", "repeated_lines", "echoed_words", "few_letters", "short_words", "long_words"),
    ("strict", 1): tuple(BIT),
}


def mask(policy: str, version: int) -> int:
    return sum(BIT[name] for name in POLICIES[policy, version])


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs more than once; hashes: of the window at each word."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last"))
    return F.aggregate(_let(ordered, places), start, step, lambda a: a["n"])


def _repeat_words(hashes: Column) -> Column:
    """hashes: of each word. Texts without a repeated window, most of them, end at the distinct count."""
    windows = lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))
    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w))
    return _let(hashes, lambda h: _let(windows(h), count))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the measurements and ``failed``, the bits of the rules that failed."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    words = F.transform(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("long")
    parts = rows.select(
        "id",
        words.alias("words"),
        lines.alias("lines"),
        without(r"[\x20\x09-\x0D]+").alias("word_chars"),
        without(r"[^#*$%&|<>]+").alias("n_symbols"),
        without(r"\P{L}+").alias("n_letters"),
    )
    measured = parts.select(
        F.col("id"),
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        _let(F.col("words"), lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))).cast("long").alias("n_echo_words"),
        "n_letters",
    )
    bits = " + ".join(f"IF({rule.fails}, {BIT[rule.name]}L, 0L)" for rule in RULES)
    return measured.select(F.col("id").alias(id_col), *MEASURES, F.expr(bits).alias("failed"))


def passes(policy: str, version: int, failed: str = "failed") -> Column:
    """Whether a ledger's row fails none of the policy's rules."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy, version))) == 0


def ablation(rows: DataFrame, policy: str, version: int) -> DataFrame:
    """Per rule of the policy: how many rows fail it, and how many would be kept without it.

    Rows are first counted per pattern of bits, of which there are at most 2 ** rules.
    """
    patterns = rows.groupBy((F.col("failed").bitwiseAND(F.lit(mask(policy, version)))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[policy, version]]))
    each = patterns.select("bits", "n", rule.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(hit & (F.col("bits") == F.col("bit")), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def oracle(policy: str, version: int) -> str:
    """DuckDB SQL for the ledger of ``documents`` under a policy."""
    bits = " + ".join(f"CASE WHEN {rule.fails} THEN {BIT[rule.name]} ELSE 0 END" for rule in RULES)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM t),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM p WHERE i + 4 <= len(words)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(5) AS x(k) WHERE n > 1 GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n_echo_words FROM p WHERE i > 1 AND words[i] = words[i - 1] GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_echo_words, 0) AS n_echo_words,
             length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters
      FROM t LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN d USING (doc_id)),
f AS (SELECT *, {bits} AS failed FROM m)
SELECT *, (failed & {mask("base", 1)}) <> 0 AS base_failed, (failed & {mask("base", 1) | mask(policy, version)}) = 0 AS kept FROM f"""
