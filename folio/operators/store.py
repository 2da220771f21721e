"""Commits, manifests, heads and output transactions as tables.

What the layout of a run calls files are rows here: a commit is (book_id, page_number, files map), the
head is the length of the contiguous prefix, recovery is a set of joins and one decision table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as T


def _pages():
    return Window.partitionBy("book_id").orderBy("page_number")


def heads(commits: DataFrame) -> DataFrame:
    """Per book the length of the prefix 1, 2, 3, ... of committed page numbers."""
    placed = commits.select("book_id", "page_number").distinct().withColumn("_place", F.row_number().over(_pages()))
    run = F.coalesce(F.max(F.when(F.col("page_number") == F.col("_place"), F.col("page_number"))), F.lit(0))
    return placed.groupBy("book_id").agg(run.cast("int").alias("committed_page_count"))


def gaps(commits: DataFrame) -> DataFrame:
    """Commits whose page number is not the one after the commit before."""
    before = F.coalesce(F.lag("page_number").over(_pages()), F.lit(0))
    return commits.withColumn("previous_page_number", before).filter(F.col("page_number") != F.col("previous_page_number") + 1)


def to_append(new: DataFrame, heads_now: DataFrame) -> DataFrame:
    """Of new pages those that extend their book's head without a gap; others are rejected by being left out."""
    joined = new.join(heads_now, "book_id", "left").withColumn("_head", F.coalesce("committed_page_count", F.lit(0)))
    expected = F.col("_head") + F.row_number().over(_pages())
    return joined.withColumn("_ok", F.min((F.col("page_number") == expected).cast("int")).over(_pages().rowsBetween(Window.unboundedPreceding, 0))).filter("_ok = 1").drop("_ok", "_head", "committed_page_count")


def extending(new: DataFrame, heads_now: DataFrame) -> DataFrame:
    """As ``to_append`` for pages by ``page_index``, without one task a book: a page counts if it is its book's head or has the
    page before it, and each book is kept up to its first page that does not, or that is given twice."""
    heads = heads_now.select("book_id", F.col("committed_page_count").alias("_head"))
    there = new.groupBy("book_id", "page_index").agg(F.count(F.lit(1)).alias("_times"))
    before = there.select("book_id", (F.col("page_index") + 1).alias("page_index"), F.lit(True).alias("_follows"))
    placed = there.join(before, ["book_id", "page_index"], "left").join(heads, "book_id", "left")
    head = F.coalesce("_head", F.lit(0))
    good = (F.col("_times") == 1) & ((F.col("page_index") == head) | (F.coalesce("_follows", F.lit(False)) & (F.col("page_index") > head)))
    stops = placed.filter(~good & (F.col("page_index") >= head)).groupBy("book_id").agg(F.min("page_index").alias("_stop"))
    kept = new.join(stops, "book_id", "left").join(heads, "book_id", "left")
    ok = (F.col("page_index") >= head) & (F.col("_stop").isNull() | (F.col("page_index") < F.col("_stop")))
    return kept.filter(ok).select(*new.columns)


def quarantined(commits: DataFrame, heads_now: DataFrame) -> DataFrame:
    """Commits past the head."""
    return commits.join(heads_now, "book_id", "left").filter(F.col("page_number") > F.coalesce("committed_page_count", F.lit(0))).drop("committed_page_count")


def manifest_diff(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are extra, missing or differ: book_id, path, problem. Full outer join on the path."""
    d = declared.select("book_id", "path", F.col("sha256").alias("declared_sha"), F.col("size_bytes").alias("declared_size"), F.lit(True).alias("in_manifest"))
    f = found.select("book_id", "path", F.col("sha256").alias("found_sha"), F.col("size_bytes").alias("found_size"), F.lit(True).alias("on_disk"))
    both = d.join(f, ["book_id", "path"], "full_outer")
    problem = (
        F.when(F.col("on_disk").isNull(), "missing")
        .when(F.col("in_manifest").isNull(), "extra")
        .when(F.col("declared_size") != F.col("found_size"), "size mismatch")
        .when(F.col("declared_sha") != F.col("found_sha"), "hash mismatch")
    )
    return both.select("book_id", "path", problem.alias("problem")).filter("problem IS NOT NULL")


def manifest_problems(files: DataFrame, primary: str) -> DataFrame:
    """Per book the first rule a manifest's own list of files breaks: book_id, code."""
    from folio.functions.paths import asset_sha256, safe_output

    asset = asset_sha256(F.col("path"))
    per = files.groupBy("book_id").agg(
        F.max((~safe_output(F.col("path"))).cast("int")).alias("unsafe"),
        (F.count(F.lit(1)) - F.countDistinct("path")).alias("doubled"),
        F.count_if(asset.isNotNull() & (asset != F.col("sha256"))).alias("misnamed"),
        F.count_if(F.col("path") == primary).alias("primaries"),
        F.count_if((F.col("path") != primary) & asset.isNull()).alias("strangers"),
    )
    code = F.when((F.col("unsafe") == 1) | (F.col("doubled") > 0), "invalid-artifact-path").when((F.col("misnamed") > 0) | (F.col("primaries") != 1), "invalid-run-layout").when(F.col("strangers") > 0, "invalid-artifact-path")
    return per.select("book_id", code.alias("code")).filter("code IS NOT NULL")


def assets(files: DataFrame) -> DataFrame:
    """Binary files keyed by the hash of their content, each once: sha256, path, size_bytes."""
    from folio.functions.paths import asset_path

    hashed = files.select(F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size_bytes"))
    return hashed.dropDuplicates(["sha256"]).withColumn("path", asset_path(F.col("sha256")))


def next_number(rows: DataFrame, number: str = "number") -> DataFrame:
    """Per book the number after the largest."""
    return rows.groupBy("book_id").agg((F.coalesce(F.max(number), F.lit(0)) + 1).cast("int").alias("next_number"))


def latest(rows: DataFrame, value: str, number: str = "number") -> DataFrame:
    return rows.groupBy("book_id").agg(F.max_by(value, number).alias(value))


def drift(stored: DataFrame, current: DataFrame, fields: dict[str, str], key: str = "book_id", hashes: tuple[str, ...] = ()) -> DataFrame:
    """Per run the first field, in order of ``fields`` (name: error code), whose values differ.

    Fields named in ``hashes`` are compared only where both sides have one (not null, not empty)."""
    s, c = stored.alias("s"), current.alias("c")
    joined = s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"))
    differ = lambda name: ~F.col(f"s.{name}").eqNullSafe(F.col(f"c.{name}"))
    both = lambda name: T.non_empty(F.col(f"s.{name}")) & T.non_empty(F.col(f"c.{name}")) if name in hashes else F.lit(True)
    code = F.coalesce(*[F.when(differ(name) & both(name), F.lit(code)) for name, code in fields.items()])
    return joined.select(F.col(f"s.{key}").alias(key), code.alias("code")).filter("code IS NOT NULL")


def numbered_failures(rows: DataFrame, *order: str) -> DataFrame:
    """Failures of each book in order, numbered from 1 and named; the last one is marked as the latest."""
    place = Window.partitionBy("book_id").orderBy(*order)
    numbered = rows.withColumn("number", F.row_number().over(place)).withColumn("latest", F.lead(F.lit(1)).over(place).isNull())
    return numbered.withColumn("name", F.format_string("failure-%04d", "number"))


# Recovery of an output transaction. Each row: the phase, whether destination, candidate and previous
# exist (None: either), and (condition, action) pairs of which the first that holds is taken.
_C, _D, _DH, _P, _ELSE = "candidate_valid", "destination_valid", "destination_valid_at_head", "previous_valid", "otherwise"
RECOVERY = (
    ("building", None, None, True, ((_ELSE, "quarantine-candidate-raise"),)),
    ("building", None, None, False, ((_ELSE, "quarantine-candidate"),)),
    ("candidate-valid", True, True, False, ((_C, "publish-candidate-replace"), (_D, "quarantine-candidate-keep"), (_ELSE, "quarantine-both"))),
    ("candidate-valid", True, False, False, ((_DH, "keep-destination"), (_ELSE, "quarantine-destination"))),
    ("candidate-valid", False, True, True, ((_C, "publish-candidate-drop-previous"), (_P, "quarantine-candidate-restore-previous"), (_ELSE, "quarantine-candidate"))),
    ("candidate-valid", False, False, True, ((_P, "restore-previous"), (_ELSE, "quarantine-previous"))),
    ("candidate-valid", False, True, False, ((_C, "publish-candidate"), (_ELSE, "quarantine-candidate"))),
    ("previous-moved", False, True, True, ((_C, "publish-candidate-drop-previous"), (_P, "quarantine-candidate-restore-previous"), (_ELSE, "quarantine-candidate"))),
    ("previous-moved", True, False, True, ((_DH, "keep-destination-drop-previous"), (_P, "quarantine-destination-restore-previous"), (_ELSE, "quarantine-both"))),
    ("previous-moved", False, False, True, ((_P, "restore-previous"), (_ELSE, "quarantine-previous"))),
    ("candidate-published", None, None, None, ((_DH, "finish"), (_P, "quarantine-destination-restore-previous"), (_ELSE, "quarantine-all-raise"))),
)
RAISE = "raise-corruption"


def recovery_action() -> Column:
    """The action for a row of: phase, has_destination, has_candidate, has_previous and the validity flags."""
    out: Column | None = None
    for phase, d, c, p, choices in RECOVERY:
        here = F.col("phase") == phase
        for name, want in (("has_destination", d), ("has_candidate", c), ("has_previous", p)):
            if want is not None:
                here = here & (F.col(name) == F.lit(want))
        action = F.coalesce(*[F.when(F.lit(True) if cond == _ELSE else F.col(cond), F.lit(act)) for cond, act in choices])
        out = F.when(here, action) if out is None else out.when(here, action)
    return out.otherwise(RAISE)


def recovery_without_marker() -> Column:
    """The action where no marker tells the phase: stray candidates are always set aside; a valid destination
    stays and a previous beside it is stale; an invalid destination is set aside, and then, or where
    there is none, a valid previous comes back and an invalid one is set aside. A flag of what does not
    exist counts for nothing."""
    valid, invalid = F.col("has_destination") & F.col(_D), F.col("has_destination") & ~F.col(_D)
    previous = F.col("has_previous")
    back = F.when(F.col(_P), "restore-previous").otherwise("quarantine-previous")
    steps = F.array(
        F.when(F.col("has_candidate"), "quarantine-candidate"),
        F.when(invalid, "quarantine-destination"),
        F.when(valid & previous, "quarantine-previous"),
        F.when(~valid & previous, back),
    )
    return F.array_join(F.array_compact(steps), ",")


def recovery_states(spark: SparkSession) -> DataFrame:
    """All combinations of phase and flags as rows (at most 4 * 2 ** 7)."""
    flags = ("has_destination", "has_candidate", "has_previous", _C, _D, _DH, _P)
    phases = F.array(*[F.lit(x) for x in ("building", "candidate-valid", "previous-moved", "candidate-published")])
    rows = spark.range(1 << len(flags)).select("id", F.explode(phases).alias("phase"))
    return rows.select("phase", *[(F.shiftright("id", k).bitwiseAND(F.lit(1).cast("long")) == 1).alias(name) for k, name in enumerate(flags)])
