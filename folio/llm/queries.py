"""The registered queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import toxicity
from folio.llm.decontamination import decontaminate
from folio.llm.decontamination import oracle as decontamination_oracle
from folio.llm.exact_dedup import exact_dedup
from folio.llm.jaccard_join import jaccard_join
from folio.llm.language_id import identify, train
from folio.llm.license_scan import license_scan
from folio.llm.license_scan import oracle as license_oracle
from folio.llm.mixing import mix_copies, n_words
from folio.llm.packing import pack_documents
from folio.llm.quality_rules import ledger, passes
from folio.llm.quality_rules import oracle as quality_oracle
from folio.llm.spelling import spelling_variants
from folio.llm.token_files import read_documents, write_documents
from folio.llm.warc import read_archives, write_archives
from folio.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """The public byte-level vocabulary of about 50,000 tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents")).withColumn("base_failed", ~passes("base", 1))
    return rows.withColumn("kept", ~F.col("base_failed") & passes("web", 2))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_documents(table(spark, sf_dir, "documents"), byte_bpe(), end_id=2)
    return read_documents(manifest)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), width=5, percent=75)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), byte_bpe(), capacity=1024, end_id=0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix_copies(docs.select("doc_id", "source", n_words(docs["text"]).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"), min_bytes=0)).drop("url")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), least_letters=5, least_count=3, ratio=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_files": op3_token_files,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_whitening": op11_whitening,
    "op12_decontamination": op12_decontamination,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_oracle(),
    "op2_quality_rules": quality_oracle("web", 2),
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
             g AS (SELECT body, max(page_id) AS last FROM p GROUP BY body),
             h AS (SELECT page_id, body, last, sha1(body) AS hex FROM p JOIN g USING (body))
        SELECT page_id, octet_length(body) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS INTEGER) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM h""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
             g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
        FROM n JOIN g USING (body)""",
    "op12_decontamination": decontamination_oracle(span=10),
}
