"""Text as Column expressions.

Three inline flavours exist on purpose: the running state shows footnote labels, validation reads
text runs only, rendering writes references as ``[^label]``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Marks that join to the text before them without a space.
CLOSING_MARKS = ".,;:!?)]}»\"'"

#: White space as Unicode sees it, and the ASCII separators that text processing also strips.
_SPACE = r"[\p{IsWhite_Space}\x1C-\x1F]"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else x.casefold())


def nfc(text: Column) -> Column:
    """Unicode NFC; the engine has no such function, so Arrow batches go through Python."""
    return _nfc(text)


def casefold(text: Column, exact: bool = True) -> Column:
    """Full case folding, or ``lower`` where the data holds no special folds."""
    return _casefold(text) if exact else F.lower(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{_SPACE}+$", "")


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{_SPACE}+", " "))


def without_leader_dots(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[.·…\p{IsWhite_Space}\x1C-\x1F]+$", ""))


def without_terminal_marks(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[.:;,\-–—]+$", ""))


def normalized_title(text: Column, exact: bool = True) -> Column:
    """NFC, case folding, leader dots, spaces, terminal marks, in this order."""
    folded = casefold(nfc(text) if exact else text, exact)
    return without_terminal_marks(collapse_spaces(without_leader_dots(folded)))


def _joined(segments: Column, shown) -> Column:
    return F.array_join(F.transform(segments, shown), "")


def state_text(content: Column) -> Column:
    return _joined(content, lambda s: s["value"])


def run_text(content: Column) -> Column:
    return _joined(F.filter(content, lambda s: s["kind"] == "text"), lambda s: s["value"])


def markdown_text(content: Column) -> Column:
    return _joined(content, lambda s: F.when(s["kind"] == "text", s["value"]).otherwise(F.concat(F.lit("[^"), s["value"], F.lit("]"))))


def boundary_join(left: Column, right: Column) -> Column:
    """Two pieces of a paragraph that a page break parted."""
    seam_open = F.right(left, F.lit(1)).rlike(f"^{_SPACE}$") | F.left(right, F.lit(1)).rlike(f"^{_SPACE}$")
    return (
        F.when(left == "", right)
        .when(right == "", left)
        .when(left.endswith("-"), F.concat(F.left(left, F.length(left) - 1), right))
        .when(F.instr(F.lit(CLOSING_MARKS), F.left(right, F.lit(1))) > 0, F.concat(left, right))
        .when(seam_open, F.concat(left, right))
        .otherwise(F.concat_ws(" ", left, right))
    )


def merge_content(left: Column, right: Column) -> Column:
    """Segment lists of a paragraph and its continuation; text meets text by ``boundary_join``."""
    last, first = F.try_element_at(left, F.lit(-1)), F.try_element_at(right, F.lit(1))
    seam = F.array(F.struct(F.lit("text").alias("kind"), boundary_join(last["value"], first["value"]).alias("value")))
    text_meets = (last["kind"] == "text") & (first["kind"] == "text")
    return (
        F.when(F.size(left) == 0, right)
        .when(F.size(right) == 0, left)
        .when(text_meets, F.concat(F.slice(left, F.lit(1), F.size(left) - 1), seam, F.slice(right, F.lit(2), F.size(right))))
        .otherwise(F.concat(left, right))
    )


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def block_id(page_index: Column, pos: Column) -> Column:
    """pPPP-bBBB from 0-based places."""
    return F.format_string("p%03d-b%03d", page_index + 1, pos + 1)


def non_empty(text: Column) -> Column:
    """Truthiness of a string: neither null nor empty; nothing is trimmed."""
    return text.isNotNull() & (text != "")


def data_uri(content: Column, mime: str = "image/png") -> Column:
    """Base64 data URI; the engine's base64 breaks lines, a URI must not."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))
