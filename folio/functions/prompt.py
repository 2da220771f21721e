"""The prompt of a page as a Column, and the JSON schema a server may be held to."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Instructions around the context; what a reader of pages has to know, in our words.
SECTIONS = (
    "You read one scanned page of a book and describe its structure. Write down only what the page shows.",
    "Name the page type from the closed list of the schema. A table of contents lists its entries; a page that starts a chapter carries its opening.",
    "List blocks in reading order. Every text block has a role; headings have a level from 1 to 6.",
    "A footnote is a block with its label; where the text refers to it, write a reference segment with the same label.",
    "A figure has a caption if one is printed, and a box in thousandths of the page from the top left corner.",
    "Mark a paragraph that goes on from the page before, and one that goes on after this page.",
    "Answer with one JSON object that fits the schema, and nothing else.",
)


def prompt(context: Column) -> Column:
    """Instructions with the page's context as JSON in second place."""
    shown = F.concat(F.lit("What is known so far:\n"), F.to_json(context, {"ignoreNullFields": "false"}))
    return F.concat_ws("\n\n", F.lit(SECTIONS[0]), shown, *map(F.lit, SECTIONS[1:]))


# Fixed values of JSON Schema: keys that only describe, and keys under which further schemas stand.
DESCRIPTIVE = ("title", "description", "default", "examples", "$schema", "$id")
BY_NAME = ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas")
LISTED = ("anyOf", "oneOf", "allOf", "prefixItems")
SINGLE = ("items", "additionalProperties", "contains", "propertyNames", "not", "if", "then", "else")


def bare_schema(schema: dict[str, Any]) -> dict[str, Any]:
    """A JSON schema without descriptive keys; objects that don't say whether they are open are closed.

    Properties keep their names, also those called like a descriptive key, as only schemas are visited."""
    bare = deepcopy(schema)
    waiting = [bare]
    for node in waiting:  # grows while it is read
        for key in DESCRIPTIVE:
            node.pop(key, None)
        if node.get("type") == "object":
            node.setdefault("additionalProperties", False)
        below = [node.get(key) for key in SINGLE]
        below += [x for key in LISTED for x in node.get(key, ())]
        below += [x for key in BY_NAME for x in node.get(key, {}).values()]
        waiting += [x for x in below if isinstance(x, dict)]
    return bare
