"""Rules over pages: what the windows carry, and the verdicts against those of the scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.operators import scan, state, validate
from folio.queries import QUERIES
from folio.sources import carriers as C
from tests.conftest import SF
from tests.test_engine import books, page, text


def _sorted_and_windowed(frame) -> list[str]:
    """The columns that each sort, window and exchange of a plan gets."""
    plan = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    found = re.findall(r"\(\d+\) (?:Sort|Window|Exchange)\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert found
    return [re.sub(r"#\d+L?", "", columns) for columns in found]


@pytest.mark.parametrize("name", ["failure_numbers", "val_book_end", "first_violation", "val_continuations", "val_toc_hierarchy", "val_openings", "accepted_prefix"])
def test_windows_of_rules_carry_no_pages_and_no_lists_of_the_state(spark, name):
    wide = {"blocks", "toc_entries", "toc", "section", "_section", "_stack", "_toc_before"}
    for columns in _sorted_and_windowed(QUERIES[name](spark, SF)):
        assert not wide & set(columns.split(", "))


def test_failures_are_dealt_over_more_tasks_as_events_grow(spark, monkeypatch):
    want = sorted(map(tuple, QUERIES["failure_numbers"](spark, SF).collect()))
    monkeypatch.setattr(C, "ROWS_A_TASK", 37)
    found = QUERIES["failure_numbers"](spark, SF)
    assert found.rdd.getNumPartitions() >= -(-C.load(spark, SF, "events").count() // 37)
    assert sorted(map(tuple, found.collect())) == want


def _book(r: random.Random) -> list[dict]:
    pages = []
    for i in range(r.randrange(1, 40)):
        kind = r.choice(["toc", "toc", "chapter_opening", "body", "blank"] if i > 4 else ["toc", "toc", "toc", "blank"])
        entries = [(r.choice(["A ....", "B", "C", ""]), r.randrange(1, 4)) for _ in range(r.randrange(0, 4))]
        title = [text(r.choice("ABC"), "chapter_title")] if kind == "chapter_opening" and r.random() < 0.9 else []
        paragraphs = [text(r.choice(["x", ""]), prev=r.random() < 0.4, on=r.random() < 0.4) for _ in range(r.randrange(0, 3))]
        pages.append(page(i, kind, title + paragraphs, entries if kind == "toc" or r.random() < 0.1 else ()))
    return pages


@pytest.mark.parametrize("whole", [False, True])
def test_rules_over_pages_are_those_of_the_scan(spark, whole):
    r = random.Random(7)
    pages = books(spark, **{f"b{n}": _book(r) for n in range(60)}).cache()
    rows = lambda found: sorted(map(tuple, found.collect()))
    want = rows(validate.violations(scan.with_state(pages, span=5), whole_books=whole))
    assert rows(validate.violations(pages, whole_books=whole)) == want
    assert rows(validate.violations(state.with_state(pages), whole_books=whole)) == want
    assert len({code for *_, code in want}) >= (8 if whole else 7)
    kept = validate.accepted(state.with_state(pages), whole_books=whole, tasks=3)
    stops = {b: p for b, p in sorted(((b, p) for b, p, *_ in want), reverse=True)}
    everything = [(row.book_id, row.page_index) for row in pages.select("book_id", "page_index").collect()]
    assert sorted((row.book_id, row.page_index) for row in kept.collect()) == sorted((b, p) for b, p in everything if p < stops.get(b, 1 << 30))
    assert kept.columns == state.with_state(pages).columns
    assert kept.filter(F.col("toc").isNull()).count() == 0
