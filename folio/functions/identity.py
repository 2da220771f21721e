"""Canonical JSON, SHA-256 and name-based UUIDs as Column expressions.

Canonical JSON has sorted keys, no spaces, unescaped non-ASCII characters and explicit nulls. Blocks
are a union: each kind writes its own fields only, so JSON is built per kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 4122 namespace for names that are URLs (a fixed value).
NAMESPACE_URL_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object of the fields, sorted by name; control characters are escaped in lower case."""
    struct = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    text = F.to_json(struct, {"ignoreNullFields": "false"})
    return lower_escapes(text)


def lower_escapes(json: Column) -> Column:
    r"""\u001F as \u001f. Only the 32 control codes are ever written this way, so each letter has its place."""
    for upper in "ABCDEF":
        json = F.regexp_replace(json, rf"(?<!\\)((?:\\\\)*)\\u00([01]){upper}", rf"$1\\u00$2{upper.lower()}")
    return json


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def uuid5(name: Column, namespace_hex: str = NAMESPACE_URL_HEX) -> Column:
    """RFC 4122 version 5 over a namespace and a name, in SQL functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def urn(uuid: Column) -> Column:
    return F.concat(F.lit("urn:uuid:"), uuid)
