"""Files of a run as tables: committed pages, assets, configuration, records."""

from __future__ import annotations

import dataclasses
import json
import tomllib
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.errors import FolioError
from folio.functions.paths import asset_path
from folio.schemas import BLOCK, METADATA, OPENING, TOC_ENTRY

RUN_VERSION = 1
MAX_IMAGE_BYTES = 41_943_040

_ASSESSMENT = (
    "page_index INT, interpretation STRUCT<page_type: STRING, printed_page_label: STRING, "
    f"opening: {OPENING}, metadata: {METADATA}, toc_entries: ARRAY<{TOC_ENTRY}>, blocks: ARRAY<{BLOCK}>>"
)


def committed_pages(spark: SparkSession, path: str, head: int | None = None) -> DataFrame:
    """Page records under ``path``/<book>/commits/page-NNNN/, up to ``head`` pages a book; the schema is given, never inferred."""
    rows = spark.read.schema(_ASSESSMENT).json(f"{path}/*/commits/page-*/page-assessment.json", multiLine=True)
    name = F.input_file_name()
    numbered = rows.withColumn("book_id", F.regexp_extract(name, r"/([^/]+)/commits/", 1)).withColumn("page_number", F.regexp_extract(name, r"/page-(\d{4})/", 1).cast("int"))
    kept = numbered if head is None else numbered.filter(F.col("page_number") <= head)
    return kept.select("book_id", "page_number", "page_index", "interpretation.*")


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Binary files with their hashes: path, size_bytes, sha256, too_large."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), (F.octet_length("content") > MAX_IMAGE_BYTES).alias("too_large"))


def unique_assets(files: DataFrame) -> DataFrame:
    """Files once per content, under the name their hash gives."""
    return files.dropDuplicates(["sha256"]).select("sha256", "size_bytes", asset_path(F.col("sha256")).alias("asset_path"))


def to_render(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """Pages without an image yet; an image made with another resolution does not count."""
    return pages.join(rendered.select("book_id", "page_index", "dpi"), ["book_id", "page_index", "dpi"], "left_anti")


@dataclasses.dataclass(frozen=True)
class Options:
    """Configuration of a run; defaults are the engine's."""

    model_alias: str = ""
    prompt_version: str = "v1"
    dpi: int = 240
    max_output_tokens: int = 8192
    reserved_image_tokens: int = 2048
    safety_margin_tokens: int = 512
    request_timeout_s: float = 300.0
    max_attempts: int = 2
    backoff_base_s: float = 1.0
    require_same_page_footnotes: bool = True
    require_figure_crops: bool = True
    include_toc: bool = True


def options_from(values: dict[str, Any]) -> Options:
    known = {f.name: f for f in dataclasses.fields(Options)}
    if unknown := set(values) - set(known):
        raise FolioError("config-drift", f"unknown options {sorted(unknown)}")
    for name, value in values.items():
        want = type(known[name].default)
        if want is float and type(value) is int:
            continue
        if type(value) is not want:
            raise FolioError("config-drift", f"{name} must be {want.__name__}")
    return Options(**values)


def load_toml(path: str) -> Options:
    with open(path, "rb") as file:
        return options_from(tomllib.load(file))


def run_record(path: str) -> dict[str, Any]:
    """A run's record; its version is checked."""
    with open(path) as file:
        record = json.load(file)
    if record.get("run_format_version") != RUN_VERSION:
        raise FolioError("invalid-run-layout", "unknown run version")
    return record
