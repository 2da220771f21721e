"""Wire JSON of a page interpretation: parsing, closed schema, conversion to domain pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.geometry import normalized
from folio.schemas import ALIGNMENTS, BLOCK, BLOCK_KINDS, INLINE_KINDS, METADATA, OPENING, PAGE_TYPES, RELATIVE_SIZES, SEGMENT, STRUCTURE_KINDS, STYLE, TEXT_ROLES, TOC_ENTRY, WIRE_BLOCK, WIRE_PAGE

# The keys that each object may have, with the types its values may have. Numbers and flags may come as any
# scalar that reads as one; where elements of a list differ, their common type is a variant, and each is looked at alone.
_TEXT, _NONE = "STRING", "VOID"
_NUMBER = _FLAG = r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)|STRING|BOOLEAN|VOID|VARIANT)"


def _or_null(kind: str) -> str:
    return f"(?:{kind}|{_NONE})"


def _list(kind: str) -> str:
    return f"ARRAY<(?:{kind}|{_NONE})>"


def _object(**keys: str) -> str:
    """Objects with some of these keys, as the schema of a variant is written."""
    each = "|".join(f"{name}: {kind}" for name, kind in keys.items())
    return f"OBJECT<(?:(?:{each})(?:, |(?=>)))*>"


SEGMENT_SHAPE = _object(kind=_TEXT, value=_TEXT)
BBOX_SHAPE = _object(left=_NUMBER, top=_NUMBER, right=_NUMBER, bottom=_NUMBER)
BLOCK_SHAPE = _object(
    kind=_TEXT, role=_or_null(_TEXT), segments=_list(SEGMENT_SHAPE), label=_or_null(_TEXT), caption=_or_null(_TEXT), heading_level=_or_null(_NUMBER), bbox=_or_null(BBOX_SHAPE),
    relative_size=_or_null(_TEXT), bold=_or_null(_FLAG), italic=_or_null(_FLAG), alignment=_or_null(_TEXT), continues_previous=_FLAG, continues_on_next_page=_FLAG,
)
OPENING_SHAPE = _object(kind=_TEXT, label=_or_null(_TEXT), title=_TEXT, subtitle=_or_null(_TEXT), level=_NUMBER)
ENTRY_SHAPE = _object(title=_TEXT, level=_NUMBER, kind=_TEXT, printed_page_label=_or_null(_TEXT))
METADATA_SHAPE = _object(title=_or_null(_TEXT), subtitle=_or_null(_TEXT), authors=_list(_TEXT), language=_or_null(_TEXT))
PAGE_SHAPE = _object(
    page_type=_TEXT, printed_page_label=_or_null(_TEXT), opening=_or_null(OPENING_SHAPE), metadata=_or_null(METADATA_SHAPE), toc_entries=_list(ENTRY_SHAPE), blocks=_list(BLOCK_SHAPE)
)


# The words that read as flags.
TRUE_WORDS, FALSE_WORDS = ("1", "on", "t", "true", "y", "yes"), ("0", "f", "false", "n", "no", "off")

#: The record before numbers, flags and segments are read, element by element.
_LOOSE_BLOCK = (
    f"STRUCT<kind: STRING, role: STRING, segments: VARIANT, label: STRING, caption: STRING, heading_level: VARIANT, bbox: STRUCT<left: VARIANT, top: VARIANT, right: VARIANT, bottom: VARIANT>, "
    "relative_size: STRING, bold: VARIANT, italic: VARIANT, alignment: STRING, continues_previous: VARIANT, continues_on_next_page: VARIANT>"
)
_LOOSE_ENTRY = "STRUCT<title: STRING, level: VARIANT, kind: STRING, printed_page_label: STRING>"
_LOOSE_OPENING = "STRUCT<kind: STRING, label: STRING, title: STRING, subtitle: STRING, level: VARIANT>"
_LOOSE_PAGE = f"STRUCT<page_type: STRING, printed_page_label: STRING, opening: {_LOOSE_OPENING}, metadata: {METADATA}, toc_entries: ARRAY<{_LOOSE_ENTRY}>, blocks: ARRAY<{_LOOSE_BLOCK}>>"


def _bound(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.transform(F.array(value), f)[0]


def integer(v: Column) -> Column:
    """A variant as a whole number: integers, numbers without a fraction, flags, and strings that write one; else null."""
    kind, text, number = F.schema_of_variant(v), F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    written = (kind != "STRING") | text.rlike(r"^\s*[+-]?\d+(?:\.0+)?\s*$")
    return F.when(written & (number == F.floor(number)) & (F.abs(number) < 2**31), number.cast("int"))


def flag(v: Column) -> Column:
    """A variant as a flag: flags, 0 and 1, and words that stand for one; else null."""
    kind, text, number = F.schema_of_variant(v), F.lower(F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$", "double")
    return F.when(kind == "STRING", F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)).otherwise(F.when(number == 1, True).when(number == 0, False))


def _missing(v: Column) -> Column:
    """Neither there nor null: a key that may be null."""
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def _typed_block(b: Column) -> Column:
    """The block with numbers, flags and segments read, and ``ok``: none of them is there and does not read."""
    corners = {side: integer(b["bbox"][side]) for side in ("left", "top", "right", "bottom")}
    box = F.when(b["bbox"].isNotNull(), F.struct(*[c.alias(side) for side, c in corners.items()]))
    level, bold, italic, before, on = integer(b["heading_level"]), flag(b["bold"]), flag(b["italic"]), flag(b["continues_previous"]), flag(b["continues_on_next_page"])
    segments = F.try_variant_get(b["segments"], "$", f"ARRAY<{SEGMENT}>")
    reads = [_missing(b[name]) | value.isNotNull() for name, value in (("heading_level", level), ("bold", bold), ("italic", italic))]
    reads += [b[name].isNull() | value.isNotNull() for name, value in (("continues_previous", before), ("continues_on_next_page", on), ("segments", segments))]
    ok = reads[0]
    for read in reads[1:]:
        ok = ok & read
    return F.struct(
        b["kind"].alias("kind"), b["role"].alias("role"), segments.alias("segments"), b["label"].alias("label"), b["caption"].alias("caption"), level.alias("heading_level"), box.alias("bbox"), b["relative_size"].alias("relative_size"),
        bold.alias("bold"), italic.alias("italic"), b["alignment"].alias("alignment"), before.alias("continues_previous"), on.alias("continues_on_next_page"), ok.alias("ok"),
    )


def _typed_entry(e: Column, *names: str) -> Column:
    return F.struct(*[(integer(e[name]) if name == "level" else e[name]).alias(name) for name in names])


def _typed(r: Column) -> Column:
    opening = r["opening"]
    return F.struct(
        r["page_type"].alias("page_type"), r["printed_page_label"].alias("printed_page_label"), F.when(opening.isNotNull(), _typed_entry(opening, "kind", "label", "title", "subtitle", "level")).alias("opening"),
        r["metadata"].alias("metadata"), F.transform(r["toc_entries"], lambda e: F.when(e.isNotNull(), _typed_entry(e, "title", "level", "kind", "printed_page_label"))).alias("toc_entries"),
        F.transform(r["blocks"], lambda b: F.when(b.isNotNull(), _typed_block(b))).alias("blocks"),
    )


def _all(values: Column, good) -> Column:
    """Whether every element is there and good; true for no list."""
    return F.coalesce(F.forall(values, lambda x: F.coalesce(x.isNotNull() & good(x), F.lit(False))), F.lit(True))


def _among(value: Column, allowed: tuple[str, ...]) -> Column:
    return value.isNull() | value.isin(*allowed)


def _good_block(b: Column) -> Column:
    box = b["bbox"]
    corners = [F.coalesce(box[side].between(0, 1000), F.lit(False)) for side in ("left", "top", "right", "bottom")]
    return (
        F.coalesce(b["kind"].isin(*BLOCK_KINDS), F.lit(False)) & b["ok"] & _among(b["role"], TEXT_ROLES) & _among(b["relative_size"], RELATIVE_SIZES) & _among(b["alignment"], ALIGNMENTS)
        & (b["heading_level"].isNull() | b["heading_level"].between(1, 6))
        & _all(b["segments"], lambda s: s["kind"].isin(*INLINE_KINDS) & s["value"].isNotNull())
        & (box.isNull() | (corners[0] & corners[1] & corners[2] & corners[3]))
        & ((b["kind"] != "text") | b["role"].isNotNull())
        & ((b["kind"] != "footnote") | b["label"].isNotNull())
    )


def _good_entry(e: Column) -> Column:
    """Openings and entries of a table of contents need a title, a level and a kind."""
    return e["title"].isNotNull() & e["level"].between(1, 6) & e["kind"].isin(*STRUCTURE_KINDS)


def parsed(frame: DataFrame, column: str) -> DataFrame:
    """Adds ``wire`` (the typed record, null if it is rejected) and ``wire_error``: null, invalid-json (no
    JSON object) or invalid-structured-response.

    Every object is closed: the text is parsed once, to a variant, and the schema that the variant has
    must be one that the page's shape allows; the record's values must lie in their sets and ranges,
    required ones must be there, a text block has a role and a footnote a label. Numbers and flags are
    read leniently, element by element: "2" and 2.0 are 2, 1 and "yes" are true (see ``integer`` and
    ``flag``); a null stands for a missing value only where the value may be null. Of a key that an object
    repeats, JSON keeps the last; texts that repeat one are rejected here unless the session sets
    ``spark.sql.variant.allowDuplicateKeys``. Both columns come out of a generator of one row, past
    which the optimiser moves no filter, so a filter on either does not parse again."""

    def judged(v: Column) -> Column:
        return _bound(F.struct(F.schema_of_variant(v).alias("shape"), F.try_variant_get(v, "$", _LOOSE_PAGE).alias("loose")), typed)

    def typed(x: Column) -> Column:
        return _bound(F.struct(x["shape"].alias("shape"), F.when(x["loose"].isNotNull(), _typed(x["loose"])).alias("record")), verdict)

    def verdict(x: Column) -> Column:
        r = x["record"]
        valid = (
            x["shape"].rlike(f"^{PAGE_SHAPE}$") & r["page_type"].isin(*PAGE_TYPES) & _all(r["blocks"], _good_block) & _all(r["toc_entries"], _good_entry)
            & (r["opening"].isNull() | _good_entry(r["opening"])) & _all(r["metadata"]["authors"], lambda a: a.isNotNull())
        )
        is_object = F.coalesce(x["shape"].startswith("OBJECT<"), F.lit(False))
        error = F.when(~is_object, "invalid-json").when(~F.coalesce(valid, F.lit(False)), "invalid-structured-response")
        record = F.struct(*[r[name].alias(name) for name in ("page_type", "printed_page_label", "opening", "metadata", "toc_entries")], F.transform(r["blocks"], lambda b: b.dropFields("ok")).alias("blocks"))
        return _bound(error, lambda e: F.struct(F.when(e.isNull(), record).cast(WIRE_PAGE).alias("wire"), e.alias("wire_error")))

    return frame.select("*", F.inline(F.transform(F.array(F.try_parse_json(F.col(column))), judged)))


def style(b: Column) -> Column:
    given = b["relative_size"].isNotNull() | b["bold"].isNotNull() | b["italic"].isNotNull() | b["alignment"].isNotNull()
    full = F.struct(
        F.lit(None).cast("string").alias("font_family"), F.lit(None).cast("double").alias("font_size_pt"), b["relative_size"].alias("relative_size"), b["bold"].alias("bold"),
        b["italic"].alias("italic"), F.lit(None).cast("boolean").alias("small_caps"), b["alignment"].alias("alignment"),
    )
    return F.when(given, full).cast(STYLE)


def domain_block(b: Column) -> Column:
    """A wire block as a domain block: each kind keeps its own fields."""
    text, note, figure = b["kind"] == "text", b["kind"] == "footnote", b["kind"] == "figure"
    written = text | note
    return F.struct(
        b["kind"].alias("kind"),
        F.when(text, b["role"]).alias("role"),
        F.when(written, F.coalesce(b["segments"], F.array().cast("array<struct<kind:string,value:string>>"))).alias("content"),
        F.when(note | figure, b["label"]).alias("label"),
        F.when(figure, b["caption"]).alias("caption"),
        F.when(text, b["heading_level"]).alias("heading_level"),
        F.when(text, F.coalesce(b["continues_previous"], F.lit(False))).alias("continues_previous"),
        F.when(text, F.coalesce(b["continues_on_next_page"], F.lit(False))).alias("continues_on_next_page"),
        F.when(written | figure, normalized(b["bbox"])).alias("bbox"),
        F.when(written, style(b)).alias("style"),
        F.lit(None).cast("string").alias("asset_sha256"),
        F.lit(None).cast("string").alias("block_id"),
    ).cast(BLOCK)


def to_domain(frame: DataFrame, *keys: str, rejected: bool = False) -> DataFrame:
    """Parsed wire records to pages; warnings start empty.

    Pages whose record was rejected are left out, or, with ``rejected``, kept without content and with
    ``wire_error``, at which the rules stop their book."""
    w = F.col("wire")
    pages = frame.select(
        *keys,
        F.coalesce(w["page_type"], F.lit("other")).alias("page_type"),
        w["printed_page_label"].alias("printed_page_label"),
        w["opening"].cast(OPENING).alias("opening"),
        w["metadata"].cast(METADATA).alias("metadata"),
        F.coalesce(w["toc_entries"], F.array().cast(f"array<{TOC_ENTRY}>")).alias("toc_entries"),
        F.transform(F.coalesce(w["blocks"], F.array().cast(f"array<{WIRE_BLOCK}>")), domain_block).alias("blocks"),
        F.array().cast("array<string>").alias("warnings"),
        "wire_error",
    )
    return pages if rejected else pages.filter("wire_error IS NULL").drop("wire_error")
