"""Wire texts: what reads as a number or a flag, element by element; one parse in the plan."""

import json

import pytest
from pyspark.sql import functions as F

from folio.sources import wire

INVALID = "invalid-structured-response"
PLAIN = {"kind": "text", "role": "heading", "heading_level": 3, "bold": False, "continues_previous": False, "segments": [{"kind": "text", "value": "x"}]}


def block(**fields):
    return json.dumps({"page_type": "body", "blocks": [PLAIN, {"kind": "text", "role": "heading"} | fields]})


CASES = {
    "text": (block(heading_level="2"), 2), "fraction": (block(heading_level=2.0), 2), "spaces": (block(heading_level=" 4 "), 4), "flag": (block(heading_level=True), 1), "null": (block(heading_level=None), None),
    "half": (block(heading_level=1.5), INVALID), "half as text": (block(heading_level="1.5"), INVALID), "power": (block(heading_level="1e0"), INVALID), "words": (block(heading_level="two"), INVALID), "object": (block(heading_level={"a": 1}), INVALID),
    "list": (block(heading_level=[1]), INVALID), "seven": (block(heading_level="7"), INVALID), "huge": (block(heading_level=10**30), INVALID),
    "bold one": (block(bold=1), True), "bold no": (block(bold="NO"), False), "bold 0.0": (block(bold=0.0), False), "bold two": (block(bold=2), INVALID), "bold empty": (block(bold=""), INVALID), "bold list": (block(bold=[True]), INVALID),
    "null flag": (block(continues_previous=None), INVALID), "null segments": (block(segments=None), INVALID), "no segments": (block(segments=[]), None), "corner": (block(bbox={"left": "1", "top": 2.0, "right": True, "bottom": 9}), None),
    "null corner": (block(bbox={"left": None, "top": 2, "right": 3, "bottom": 9}), INVALID), "far corner": (block(bbox={"left": "1001", "top": 2, "right": 3, "bottom": 9}), INVALID),
    "levels": (json.dumps({"page_type": "toc", "opening": {"kind": "chapter", "title": "t", "level": "1"}, "toc_entries": [{"title": "a", "level": 1, "kind": "chapter"}, {"title": "b", "level": "2", "kind": "part"}]}), None),
    "null level": (json.dumps({"page_type": "toc", "toc_entries": [{"title": "a", "level": 1, "kind": "chapter"}, {"title": "b", "level": None, "kind": "part"}]}), INVALID),
}


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = wire.parsed(spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "form string, json string"), "json").collect()
    return {r.form: r for r in rows}


@pytest.mark.parametrize("form", CASES)
def test_forms(outcomes, form):
    expected, got = CASES[form][1], outcomes[form]
    if expected == INVALID:
        assert got.wire_error == INVALID and got.wire is None
        return
    assert got.wire_error is None
    if got.wire.blocks:
        b = got.wire.blocks[1]
        assert (b.bold if form.startswith("bold") else b.heading_level) == expected
        assert form != "corner" or tuple(b.bbox) == (1, 2, 1, 9)
    else:
        assert (got.wire.opening.level, [e.level for e in got.wire.toc_entries]) == (1, [1, 2])


def test_texts_are_parsed_once(spark):
    frame = wire.parsed(spark.createDataFrame([("a", block())], "k string, json string"), "json")
    for df in (wire.to_domain(frame, "k"), frame.filter("wire_error IS NULL").select("k", "wire.page_type"), frame.filter(F.col("wire.page_type") == "body")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_repeated_keys(spark):
    text, name = '{"page_type":"toc","page_type":"body"}', "spark.sql.variant.allowDuplicateKeys"
    one = lambda: wire.parsed(spark.createDataFrame([("a", text)], "k string, json string"), "json").select("wire_error", "wire.page_type").first()
    before = spark.conf.get(name, None)
    try:
        for allowed, expected in (("false", ("invalid-json", None)), ("true", (None, "body"))):
            spark.conf.set(name, allowed)
            assert tuple(one()) == expected
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
