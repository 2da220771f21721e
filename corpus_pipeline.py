"""A training corpus in five stages, each the next one's input: language ID, exact dedup,
near-duplicate join, mixing to target weights, packing. Part of the ``llm`` subpackage.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``.
An empty table passes through all stages; nulls are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.components import smallest_of, spread_join
from folio.llm.exact_dedup import kept_documents
from folio.llm.jaccard_join import jaccard_components
from folio.llm.language_id import accepted_documents, train
from folio.llm.mixing import mixed_documents
from folio.llm.packing import pack_documents
from folio.llm.queries import byte_bpe
from folio.llm.scratch import materialise, remove, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text no language's centroids are near to, or that have no letter, go.

    Null and empty texts have no letter and go; with no labelled row all go. Repeated rows and ties
    of two languages are judged alike, by the text alone; long texts are read whole; columns other
    than doc_id, text and lang are carried, whatever their names."""
    return accepted_documents(docs, train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest id stays, once if the row is repeated.

    Null counts as empty text, a null id as the largest; all columns are carried."""
    return kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest id stays, a null id last.

    Rows are told apart by hashes of id and text, so an id that stands for two texts, or none,
    does no harm; rows equal in both stay or go together. Documents with an empty set (null or no
    word) are linked with nothing and stay. All columns are carried, whatever their names."""
    names = docs.columns
    row, check = unused(names, "__row", "__check")
    keyed = docs.withColumns({row: F.xxhash64("doc_id", "text"), check: F.xxhash64("text", F.lit(1), "doc_id")})
    members = materialise(jaccard_components(keyed, id_col=row)[0].filter("label IS NOT NULL").select(F.col("doc_id").alias(row), "label"), "near-members")
    several = materialise(smallest_of(members, "label", row).filter("size > 1").select("label"), "near-labels")
    some = materialise(spread_join(members, several, "label", how="inner").distinct(), "near-some")
    rows = keyed.select(F.col("doc_id").alias("id"), row, check).distinct()
    placed = materialise(some.join(rows, row), "near-rows")
    place = F.struct(F.col("id").isNull().alias("last"), "id", row, check)
    first = materialise(smallest_of(placed, "label", place).select("label", "first"), "near-first")
    gone = spread_join(placed, first, "label", how="inner").filter(place != F.col("first")).select(row, check)
    return keyed.join(materialise(gone, "near-gone"), [row, check], "left_anti").select(*names)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target shares of words: documents are left out, stay or come twice.

    Null texts and texts without a word are left out; a null source is a source; repeated rows and
    null ids are documents like any other; ties are broken by hashes of id and size, so reruns
    agree; all columns are carried, whatever their names."""
    return mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens: one row a piece.

    Null text is empty, its end id alone; repeated rows and null ids are packed like any other; a
    very long text goes in whole windows and a remainder; other columns do not matter."""
    return pack_documents(docs, byte_bpe(), capacity=1024, end_id=0)


#: Each stage's rows are written and read again before the next one.
STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learning, rounding by draws and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
