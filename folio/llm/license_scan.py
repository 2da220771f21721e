"""Licence scan: ordered signature rules over the words of each text, in SQL functions only.

Words are the runs of ASCII letters and digits and of characters beyond ASCII, A-Z lowered.
A text that holds none of the gate's keywords is done after one pass. Any other is rewritten
as `` 0#word  1#word `` ..., so that a regular expression over words finds whole words only and
says where it stands; each rule whose keyword occurs is then tried. Detections are ordered by
start, longest first, then priority, and folded once: a detection is hidden when one of its
own or a stronger tier, seen before, reaches at least as far (interval containment). All work
is inside one row: no shuffle, no join, and a text's cost does not depend on other texts.

Defined cases: null text is an empty text; a text without words has no places and empty label
strings; every input row gives a row, repeated and null ids included; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.license_rules import CONFIDENCE, Rule, compiled, rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def gate(table: list[Rule]) -> list[str]:
    """Keywords of which every text with a detection holds one, in lower case."""
    keys = {"licen" if any("licen" in w and not w.endswith("?") for w in r.pattern.split(" ")) else r.keyword for r in table}
    return sorted(k for k in keys if not any(o in k for o in keys - {k}))


def _gated(low: Column, table: list[Rule]) -> Column:
    keywords = F.array(*map(F.lit, gate(table)))
    return F.transform(F.array(low), lambda x: F.exists(keywords, lambda k: F.contains(x, k)))[0]


def _table(table: list[Rule]) -> Column:
    """The rules as one constant, given to the engine as one SQL text."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    row = "named_struct('rank', {}, 'label', {}, 'tier', {}, 'keyword', {}, 'pattern', {}, 'base', {})"
    return F.expr("array(" + ", ".join(row.format(i, quoted(r.label), r.tier, quoted(r.keyword), quoted(compiled(r.pattern)), str(r.base).lower()) for i, r in enumerate(table)) + ")")


def _detections(words: Column, low: Column, table: list[Rule]) -> Column:
    """array<struct<start, back (minus end), tier, rank, label, base>> in the order of the fold."""
    body = F.array_join(F.transform(words, lambda w, i: F.concat(F.lit(" "), i.cast("string"), F.lit("#"), w, F.lit(" "))), "")

    def of(s: Column, r: Column) -> Column:
        def one(m: Column) -> Column:
            start = F.ltrim(F.substring_index(m, "#", 1)).cast("long")
            size = F.length(m) - F.length(F.replace(m, F.lit("#"), F.lit("")))
            return F.struct(start.alias("start"), (-(start + size)).alias("back"), r["tier"].alias("tier"), r["rank"].alias("rank"), r["label"].alias("label"), r["base"].alias("base"))

        return F.transform(F.regexp_extract_all(s, r["pattern"], F.lit(0)), one)

    def all_of(t: Column) -> Column:
        tried = F.filter(_table(table), lambda r: F.contains(t["low"], r["keyword"]))
        return F.sort_array(F.flatten(F.transform(tried, lambda r: of(t["body"], r))))

    return F.transform(F.array(F.struct(body.alias("body"), low.alias("low"))), all_of)[0]


def _folded(detections: Column) -> Column:
    """struct<reach array<long> (by tier), labels, best>: the labels that are not hidden."""
    start = F.struct(F.array(*[F.lit(-1).cast("long")] * 4).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"))
    sure = F.array(*[F.lit(CONFIDENCE[t]) for t in sorted(CONFIDENCE)])

    def step(a: Column, d: Column) -> Column:
        end = -d["back"]
        hidden = F.array_max(F.slice(a["reach"], F.lit(1), d["tier"])) >= end
        reach = F.transform(a["reach"], lambda x, i: F.when(i + 1 == d["tier"], F.greatest(x, end)).otherwise(x))
        labels = F.when(hidden, a["labels"]).otherwise(F.array_union(a["labels"], F.array(d["label"])))
        best = F.when(hidden, a["best"]).otherwise(F.greatest(a["best"], F.get(sure, d["tier"] - 1)))
        return F.struct(reach.alias("reach"), labels.alias("labels"), best.alias("best"))

    return F.aggregate(detections, start, step)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    table = table or rules()
    text = F.coalesce(docs[text_col], F.lit(""))
    words = F.regexp_extract_all(F.translate(F.col("text"), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,back:bigint,tier:int,rank:int,label:string,base:boolean>>")
    found = docs.select(docs[id_col].alias("id"), text.alias("text")).select(
        "id",
        F.regexp_count("text", F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"),
        F.when(_gated(F.lower("text"), table), _detections(words, F.lower("text"), table)).otherwise(empty).alias("found"),
    )
    base = F.filter("found", lambda d: d["base"])
    folded = found.select("id", "n_words", "found", base.alias("base"), _folded(F.col("found")).alias("kept"))
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    names = F.transform("base", lambda d: d["label"])
    return folded.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["start"])).alias("last_word"),
        joined(names).alias("base_labels"),
        joined(F.concat(names, F.col("kept.labels"))).alias("labels"),
        F.col("kept.best").alias("score"),
        F.col("found").alias("detections"),
    )


def oracle(table: list[Rule] | None = None) -> str:
    """DuckDB SQL for the scan of ``documents``."""
    table = table or rules()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({i}, {quoted(r.label)}, {r.tier}, {quoted(r.keyword)}, {quoted(compiled(r.pattern))}, {str(r.base).lower()})" for i, r in enumerate(table))
    sure = "CASE tier " + " ".join(f"WHEN {t} THEN {c}" for t, c in CONFIDENCE.items()) + " END"
    return rf"""
WITH rules(rank, label, tier, keyword, pattern, base) AS (VALUES {values}),
w AS (SELECT doc_id, lower(coalesce(text, '')) AS low, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS words FROM documents),
s AS (SELECT doc_id, low, coalesce(array_to_string(list_transform(words, lambda x, i: ' ' || (i - 1) || '#' || x || ' '), ''), '') AS body
      FROM w),
m AS (SELECT doc_id, rank, label, tier, base, unnest(regexp_extract_all(body, pattern)) AS hit FROM s JOIN rules ON contains(low, keyword)),
d AS (SELECT doc_id, rank, label, tier, base, CAST(trim(split_part(hit, '#', 1)) AS BIGINT) AS a,
             CAST(trim(split_part(hit, '#', 1)) AS BIGINT) + length(hit) - length(replace(hit, '#', '')) AS b FROM m),
k AS (SELECT DISTINCT doc_id, label, tier FROM d WHERE NOT EXISTS (
        SELECT 1 FROM d e WHERE e.doc_id = d.doc_id AND e.tier <= d.tier AND e.a <= d.a AND e.b >= d.b
        AND (e.a, -e.b, e.tier, e.rank) < (d.a, -d.b, d.tier, d.rank))),
b AS (SELECT doc_id, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word,
             array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM d WHERE base GROUP BY doc_id),
l AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
      FROM (SELECT doc_id, label FROM k UNION ALL SELECT doc_id, label FROM d WHERE base) GROUP BY doc_id),
c AS (SELECT doc_id, max({sure}) AS score FROM k GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0.0) AS DOUBLE) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)"""
