"""Exact dedup by skew-safe combining.

Texts are equal when they are identical after each run of space, tab, line feed, vertical
tab, form feed or carriage return became one space (no trimming; null counts as empty).

Rows pass three combining stages, each a grouping on the digest *and the whole normalised
text*, so equal digests alone never merge two texts:

1. locally: the map side of the first grouping keeps one row per text and task;
2. salted: (digest, salt, text) meets in one task, salt = hash of the id, so that a text
   that makes up a third of the corpus is spread over ``salts`` tasks;
3. globally: the winners of the salts, at most ``salts`` rows per text, meet per text.

Defined cases: an empty table gives an empty result; null text joins the group of the empty
text; a null id loses against any id, and a group of nulls only keeps one of its rows with
``keep_id`` null; of repeated rows (same id and text) exactly one is kept; columns beyond
id and text are carried or ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.components import spread_join
from folio.llm.scratch import materialise, unused

#: Runs that one space replaces; a lone space is left out, as replacing it changes nothing.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct text: sha, body (normalised), keep_id, group_size."""
    body = normalised(docs[text_col])
    rows = docs.select(
        docs[id_col].alias("id"),
        body.alias("body"),
        F.sha2(body, 256).alias("sha"),
        F.pmod(F.xxhash64(docs[id_col]), F.lit(salts)).alias("salt"),
    )
    salted = rows.groupBy("sha", "salt", "body").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("sha", "body").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    groups = materialise(text_groups(docs, id_col, text_col, salts).select("sha", "keep_id", "group_size"), "dedup-groups")
    members = docs.select(docs[id_col].alias("id"), F.sha2(normalised(docs[text_col]), 256).alias("sha"))
    clashes = groups.groupBy("sha").count().filter("count > 1").select("sha")
    if clashes.isEmpty():
        ranked = materialise(members.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("copies")), "dedup-members")
        joined = spread_join(ranked, groups, "sha", how="inner")
    else:  # two texts share a digest: those digests are joined by text as well
        joined = _joined_by_text(docs, groups, clashes, id_col, text_col, salts)
    copy = F.explode(F.expr("sequence(1L, copies)"))
    return joined.select("id", "keep_id", "group_size", "sha", copy.alias("copy")).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _joined_by_text(docs: DataFrame, groups: DataFrame, clashes: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    body = normalised(docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), body.alias("body"), F.sha2(body, 256).alias("sha"))
    alone = rows.select("id", "sha").join(clashes, "sha", "left_anti").groupBy("id", "sha").agg(F.count(F.lit(1)).alias("copies")).join(groups, "sha")
    texts = text_groups(docs, id_col, text_col, salts).join(clashes, "sha", "left_semi")
    shared = rows.join(clashes, "sha", "left_semi").groupBy("id", "sha", "body").agg(F.count(F.lit(1)).alias("copies")).join(texts, ["sha", "body"])
    columns = ["id", "sha", "copies", "keep_id", "group_size"]
    return alone.select(columns).unionByName(shared.select(columns))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: the smallest id of each text, once."""
    sha, h1, keep = unused(docs.columns, "__sha", "__h1", "__keep")
    groups = materialise(
        text_groups(docs, id_col, text_col, salts).select(F.col("keep_id").alias(keep), F.xxhash64("body").alias(h1), F.col("sha").alias(sha)), "dedup-kept"
    )
    body = normalised(docs[text_col])
    keyed = docs.withColumns({sha: F.sha2(body, 256), h1: F.xxhash64(body)})
    on = (keyed[sha] == groups[sha]) & (keyed[h1] == groups[h1]) & keyed[id_col].eqNullSafe(groups[keep])
    kept = keyed.join(groups, on, "left_semi")
    repeated = keyed.groupBy(id_col, sha, h1).count().filter("count > 1")
    if not repeated.join(groups, [sha, h1], "left_semi").isEmpty():
        kept = kept.dropDuplicates([id_col, sha, h1])
    return kept.drop(sha, h1)
