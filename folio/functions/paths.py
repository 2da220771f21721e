"""Path and name predicates, and content-addressed asset names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import text as T

# Names that a page's own files and folders take.
RESERVED_NAMES = ("manifest.json", "page-assessment.json", "page-context.json", "interpretation.json", "provenance.json", "assets", "attempts")

# Names of the folders and files of a run.
PATTERNS = {
    "commit": r"^page-[0-9]{4}$",
    "unfinished commit": r"^\.page-[0-9]{4}\.tmp$",
    "candidate": r"^(markdown|epub)\.candidate\.[0-9a-f]{16}$",
    "previous": r"^(markdown|epub)\.previous$",
    "work": r"^(markdown|epub)\.work\.[0-9a-f]{16}$",
    "failure": r"^failure-[0-9]{4}$",
    "recovery": r"^recovery-[0-9]{4}$",
    "preflight": r"^preflight-[0-9]{4}$",
    "nonce": r"^[0-9a-f]{16}$",
    "asset": r"^assets/[0-9a-f]{64}\.png$",
}


def safe_relative(path: Column) -> Column:
    """Not empty or absolute, no backslash, no empty, ``.`` or ``..`` part."""
    parts = F.split(path, "/")
    bad = path.isNull() | (path == "") | path.startswith("/") | path.contains("\\") | F.exists(parts, lambda x: x.isin("", ".", ".."))
    return ~bad


def safe_output(path: Column) -> Column:
    return safe_relative(path) & (path != "manifest.json")


def valid_artifact_names(names: Column, reserved: tuple[str, ...] = RESERVED_NAMES) -> Column:
    """Every name is non-empty, trimmed, without separators, not ``.`` or ``..``, not reserved, and none repeats."""
    bad = F.exists(names, lambda x: x.isNull() | (x == "") | (x != T.strip(x)) | x.contains("/") | x.contains("\\") | x.isin(".", "..", *reserved))
    return ~bad & (F.size(F.array_distinct(names)) == F.size(names))


def asset_path(sha256: Column) -> Column:
    return F.concat(F.lit("assets/"), sha256, F.lit(".png"))


def asset_sha256(path: Column) -> Column:
    """The hash an asset path names, or null."""
    return F.nullif(F.regexp_extract(path, r"^assets/([0-9a-f]{64})\.png$", 1), F.lit(""))


def matches(name: Column, kind: str) -> Column:
    return name.rlike(PATTERNS[kind])
