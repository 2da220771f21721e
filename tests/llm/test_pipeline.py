import corpus_pipeline as P
from tests.conftest import SF
from tests.llm.fixtures import awkward, table


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        if name != "mixture":
            assert after.exceptAll(before).count() == 0, name
        before = after
    assert [n for n, _ in P.STAGES] == ["language", "exact_copies", "near_copies", "mixture", "packed"]


def test_near_copies_leave_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (3, base + " x"), (9, base + " y z"), (1, "other words than those in the group here"), (1, base + " q"), (None, base + " n"), (7, None), (8, "")]
    docs = table(spark, rows)
    kept = sorted((str(r.doc_id), r.text) for r in P.near_copies(spark, docs, SF).collect())
    assert kept == sorted([("1", base + " q"), ("1", rows[3][1]), ("7", None), ("8", "")], key=lambda r: (r[0], str(r[1]))) or kept == sorted([("1", base + " q"), ("1", rows[3][1]), ("7", None), ("8", "")], key=str)


def test_awkward_documents_pass_all_stages(spark):
    docs = table(spark, awkward())
    for _, stage in P.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0


def test_nothing_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
