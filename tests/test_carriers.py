"""What carriers ask of the cluster."""

from folio.operators import state
from folio.queries import QUERIES
from folio.sources import carriers as C
from tests.conftest import SF


def test_events_are_dealt_over_more_tasks_as_they_grow(spark, monkeypatch):
    n = C.load(spark, SF, "events").count()
    for rows in (100, 37):
        monkeypatch.setattr(C, "ROWS_A_TASK", rows)
        states = state.with_state(C.event_pages(spark, SF))
        assert states.rdd.getNumPartitions() == -(-n // rows)
    assert states.count() == n


def test_joins_by_page_are_dealt_over_more_tasks_as_events_grow(spark, monkeypatch):
    want = QUERIES["snapshot_context"](spark, SF).collect()
    monkeypatch.setattr(C, "ROWS_A_TASK", 37)
    found = QUERIES["snapshot_context"](spark, SF)
    assert found.rdd.getNumPartitions() >= -(-C.load(spark, SF, "events").count() // 37)
    assert sorted(found.collect(), key=str) == sorted(want, key=str)
