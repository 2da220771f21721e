"""The running state by a parallel scan: books of any length, and states that go on from a snapshot.

What a stretch of pages does to the state before it is a summary of fixed size: where its first
TOC page, its first content page and the ends of its TOC runs are, how many entries and openings
it holds, its last section, and the headings and the paragraph since then. Summaries of stretches
that follow each other make the summary of both (``prefixed``), and ``applied`` gives the state
after a stretch from the one before it. That is a monoid and its action, so a book is cut into ranges of ``span``
pages: prefixes inside the ranges, prefixes over the ranges' totals (one small row a range),
and the state before each range carried into it. No task needs more than one range of pages, or
one row a range of a book, at a time.

A snapshot is the state after the last page that a book had; ``scan`` starts from it where there
is one, and reads new pages only. Pages need a book id: where it is null, the state is null.

The TOC status follows from the summary in closed form: from ``not_seen`` it depends on whether a
TOC page comes before any content, from ``collecting`` on the run that goes on at the start; once
``committed`` or ``absent`` it stays. Openings are content, so all of a stretch's openings stand
behind its TOC run; they count if the status after the stretch is ``committed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.state import EXPECTED_ENTRIES, RECENT_HEADINGS, TAIL_CHARS, texts
from folio.schemas import HEADING, METADATA, TOC_ENTRY

SPAN = 4096
_TAIL = "STRUCT<open: BOOLEAN, text: STRING>"
_OPENED = "STRUCT<kind: STRING, title: STRING, started_on_page: INT, openings_before: INT>"
SECTION = f"STRUCT<kind: STRING, title: STRING, toc_index: INT, started_on_page: INT, n_headings: INT, recent_headings: ARRAY<{HEADING}>, tail: {_TAIL}>"
STATE = (
    f"STRUCT<toc_status: STRING, n_toc: INT, next_expected_opening_index: INT, section: {SECTION}, previous_page_type: STRING, "
    f"processed_page_count: INT, book_metadata: {METADATA}>"
)
SNAPSHOT = f"book_id STRING, state {STATE}, toc ARRAY<{TOC_ENTRY}>"
_FIELDS = ("last_type", "last", "ft", "fc", "fn0", "fn", "entries0", "entries1", "openings", "section", "n_headings", "recent", "tail", "title", "subtitle", "authors", "language")


def initial() -> Column:
    """The state before any page."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        F.lit("not_seen").alias("toc_status"), F.lit(0).alias("n_toc"), F.lit(0).alias("next_expected_opening_index"), none(SECTION).alias("section"), none("string").alias("previous_page_type"),
        F.lit(0).alias("processed_page_count"), F.struct(none("string").alias("title"), none("string").alias("subtitle"), F.array().cast("array<string>").alias("authors"), none("string").alias("language")).alias("book_metadata"),
    ).cast(STATE)


def page_summaries(pages: DataFrame, *more: Column) -> DataFrame:
    """book_id, start (the page's index) and the summary of each single page, and columns that are carried along."""
    p, kind = F.col("page_index"), F.col("page_type")
    toc, chapter = kind == "toc", kind == "chapter_opening"
    entries = F.when(toc, F.size("toc_entries")).otherwise(0)
    first_title = T.state_text(F.try_element_at(texts(F.col("blocks"), "chapter_title"), F.lit(1))["content"])
    opened = F.struct(F.coalesce("opening.kind", F.lit("chapter")).alias("kind"), F.coalesce("opening.title", first_title, F.lit("")).alias("title"), p.alias("started_on_page"), F.lit(0).alias("openings_before"))
    levels = F.filter(texts(F.col("blocks"), "heading"), lambda b: b["heading_level"].isNotNull())
    headings = F.transform(levels, lambda b: F.struct(b["heading_level"].alias("level"), T.state_text(b["content"]).alias("text"), p.alias("page_index")))
    headings = F.when(~toc, headings).otherwise(F.array()).cast(f"array<{HEADING}>")
    last = F.try_element_at(texts(F.col("blocks"), "paragraph"), F.lit(-1))
    tail = F.struct(F.coalesce(last["continues_on_next_page"], F.lit(False)).alias("open"), F.right(T.state_text(last["content"]), F.lit(TAIL_CHARS)).alias("text"))
    some = lambda name: F.when(T.non_empty(F.col(f"metadata.{name}")), F.col(f"metadata.{name}"))
    return pages.select(
        "book_id", p.alias("start"), kind.alias("last_type"), p.alias("last"), F.when(toc, p).alias("ft"), F.when(kind.isin("chapter_opening", "body"), p).alias("fc"), F.when(~toc, p).alias("fn0"), F.lit(None).cast("int").alias("fn"),
        entries.alias("entries0"), entries.alias("entries1"), chapter.cast("int").alias("openings"), F.when(chapter, opened).cast(_OPENED).alias("section"), F.size(headings).alias("n_headings"), _latest(headings).alias("recent"),
        F.when(~toc & last.isNotNull(), tail).cast(_TAIL).alias("tail"), some("title").alias("title"), some("subtitle").alias("subtitle"), F.when(F.size("metadata.authors") > 0, F.col("metadata.authors")).alias("authors"), some("language").alias("language"), *more,
    )


def _latest(headings: Column) -> Column:
    return F.slice(headings, F.greatest(F.lit(1), F.size(headings) - (RECENT_HEADINGS - 1)), F.lit(RECENT_HEADINGS))


def prefixed(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with summaries of stretches that follow each other by ``start`` within ``keys``: each with the summary of all up to it."""
    order = Window.partitionBy(*keys).orderBy("start")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    step = rows.withColumns({"_first_toc": F.min("ft").over(Window.partitionBy(*keys)), "_ended": F.min("fn0").over(before), "_earlier": F.coalesce(F.sum("openings").over(before), F.lit(0)).cast("int")})
    own, later = c("ft") == c("_first_toc"), c("start") > c("_first_toc")
    step = step.withColumn("_fn", F.when(own, c("fn")).when(later, c("fn0")))
    step = step.withColumns({
        "_run_ended": F.min("_fn").over(before),
        "_section": F.last(F.when(c("section").isNotNull(), c("section").withField("openings_before", c("section.openings_before") + c("_earlier"))), ignorenulls=True).over(so_far),
    })
    step = step.withColumns({
        "_entries0": F.sum(F.when(c("_ended").isNull(), c("entries0")).otherwise(0)).over(so_far).cast("int"),
        "_entries1": F.sum(F.when(own, c("entries1")).when(later & c("_run_ended").isNull(), c("entries0")).otherwise(0)).over(so_far).cast("int"),
        "_ft": F.min("ft").over(so_far), "_fc": F.min("fc").over(so_far), "_fn0": F.min("fn0").over(so_far), "_last_fn": F.min("_fn").over(so_far), "_openings": F.sum("openings").over(so_far).cast("int"),
        **{f"_{name}": F.first(name, ignorenulls=True).over(so_far) for name in ("title", "subtitle", "authors", "language")},
    })
    has = F.size("recent") > 0
    step = step.withColumns({"_part": F.coalesce(c("_section.started_on_page"), F.lit(-1)), "_has": has})
    within = Window.partitionBy(*keys, "_part").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    carriers = Window.partitionBy(*keys, "_part", "_has").orderBy("start").rowsBetween(1 - RECENT_HEADINGS, 0)
    step = step.withColumn("_lately", F.when(has, _latest(F.flatten(F.collect_list("recent").over(carriers)))))
    step = step.withColumns({"_n": F.sum("n_headings").over(within).cast("int"), "_recent": F.coalesce(F.last("_lately", ignorenulls=True).over(within), c("recent")), "_tail": F.last("tail", ignorenulls=True).over(within)})
    named = {"ft": "_ft", "fc": "_fc", "fn0": "_fn0", "fn": "_last_fn", "entries0": "_entries0", "entries1": "_entries1", "openings": "_openings", "section": "_section", "n_headings": "_n", "recent": "_recent", "tail": "_tail"}
    named |= {name: f"_{name}" for name in ("title", "subtitle", "authors", "language")}
    kept = [x for x in rows.columns if x not in named]
    return step.select(*kept, *[c(mine).alias(name) for name, mine in named.items()])


def applied(state: Column, s: Column) -> Column:
    """The state after a stretch with summary ``s``; a null summary (no page) changes nothing."""
    ended = lambda n: F.when(n > 0, "committed").otherwise("absent")
    fresh = s["ft"].isNotNull() & (s["fc"].isNull() | (s["ft"] < s["fc"]))
    status = (
        F.when(state["toc_status"] == "collecting", F.when(s["fn0"].isNull(), "collecting").otherwise(ended(state["n_toc"] + s["entries0"])))
        .when(state["toc_status"] != "not_seen", state["toc_status"])
        .when(fresh, F.when(s["fn"].isNull(), "collecting").otherwise(ended(s["entries1"])))
        .otherwise(F.when(s["fc"].isNull(), "not_seen").otherwise("absent"))
    )
    taken = F.when(state["toc_status"] == "collecting", s["entries0"]).when((state["toc_status"] == "not_seen") & fresh, s["entries1"]).otherwise(0)
    counts = status == "committed"
    was, opened = state["section"], s["section"]
    section = F.when(
        opened.isNotNull() | was.isNotNull(),
        F.struct(
            F.coalesce(opened["kind"], was["kind"]).alias("kind"),
            F.coalesce(opened["title"], was["title"]).alias("title"),
            F.when(opened.isNotNull(), state["next_expected_opening_index"] + F.when(counts, opened["openings_before"]).otherwise(0)).otherwise(was["toc_index"]).cast("int").alias("toc_index"),
            F.coalesce(opened["started_on_page"], was["started_on_page"]).alias("started_on_page"),
            (F.when(opened.isNotNull(), 0).otherwise(was["n_headings"]) + s["n_headings"]).cast("int").alias("n_headings"),
            F.when(opened.isNotNull(), s["recent"]).otherwise(_latest(F.concat(was["recent_headings"], s["recent"]))).alias("recent_headings"),
            F.when(opened.isNotNull(), s["tail"]).otherwise(F.coalesce(s["tail"], was["tail"])).alias("tail"),
        ),
    )
    known = state["book_metadata"]
    metadata = F.struct(
        F.coalesce(known["title"], s["title"]).alias("title"), F.coalesce(known["subtitle"], s["subtitle"]).alias("subtitle"),
        F.when(F.size(known["authors"]) > 0, known["authors"]).otherwise(F.coalesce(s["authors"], known["authors"])).alias("authors"), F.coalesce(known["language"], s["language"]).alias("language"),
    )
    after = F.struct(
        status.alias("toc_status"), (state["n_toc"] + taken).cast("int").alias("n_toc"), (state["next_expected_opening_index"] + F.when(counts, s["openings"]).otherwise(0)).cast("int").alias("next_expected_opening_index"),
        section.alias("section"), s["last_type"].alias("previous_page_type"), (s["last"] + 1).alias("processed_page_count"), metadata.alias("book_metadata"),
    ).cast(STATE)
    return F.when(s["last"].isNull(), state).otherwise(after)


def _summary() -> Column:
    return F.struct(*_FIELDS)


def dealt_join(left: DataFrame, right: DataFrame, tasks: int | None, keys: list[str], how: str = "inner") -> DataFrame:
    """A join over so many tasks, or the session's. Both sides are dealt, as the planner would take the number of the side that is not."""
    if tasks:
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.join(right, keys, how)


def scan(pages: DataFrame, snapshots: DataFrame | None = None, span: int = SPAN, tasks: int | None = None) -> DataFrame:
    """book_id, page_index, before and state of each page. ``snapshots`` (book_id, state) say where books stand before these pages.

    ``tasks``: over how many the joins by page and range are dealt, for tables that call for more than the session's partitions."""
    ranged = page_summaries(pages).withColumn("_range", F.floor(F.col("start") / span).cast("int"))
    local = prefixed(ranged, "book_id", "_range").select("book_id", "_range", "start", _summary().alias("s"))
    # the last prefix of a range is its total
    totals = local.groupBy("book_id", "_range").agg(F.max_by("s", "start").alias("s"), F.min("start").alias("start")).select("book_id", "_range", "start", "s.*")
    over = Window.partitionBy("book_id").orderBy("start")
    earlier = prefixed(totals, "book_id").select("book_id", "_range", F.lag(_summary()).over(over).alias("e"))
    start = initial()
    if snapshots is not None:
        earlier = earlier.join(snapshots.select("book_id", F.col("state").alias("_stored")), "book_id", "left")
        start = F.coalesce("_stored", initial())
    carried = earlier.select("book_id", "_range", start.alias("_start"), "e").select("book_id", "_range", applied(F.col("_start"), F.col("e")).alias("carry"))
    # a left join, as an inner one would filter one side for nulls and so keep both from sharing an exchange
    after = dealt_join(local, carried, tasks, ["book_id", "_range"], "left").select("book_id", "_range", "start", "carry", applied(F.col("carry"), F.col("s")).alias("state"))
    here = Window.partitionBy("book_id", "_range").orderBy("start")
    return after.select("book_id", F.col("start").alias("page_index"), F.coalesce(F.lag("state").over(here), F.col("carry")).alias("before"), "state")


def collected(pages: DataFrame, states: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """book_id, toc: the entries that each book's TOC has collected, once a book."""
    taking = states.filter(F.col("before.toc_status").isin("not_seen", "collecting")).select("book_id", "page_index")
    entries = pages.filter("page_type = 'toc'").select("book_id", "page_index", "toc_entries").join(taking, ["book_id", "page_index"])
    rows = entries.select("book_id", F.struct("page_index", "toc_entries").alias("e"))
    if snapshots is not None:
        rows = rows.unionByName(snapshots.select("book_id", F.struct(F.lit(-1).alias("page_index"), F.col("toc").alias("toc_entries")).alias("e")))
    return rows.groupBy("book_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["toc_entries"])).alias("toc"))


def snapshot(pages: DataFrame, states: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """SNAPSHOT rows: each book's state after its last page; books without new pages keep theirs."""
    last = states.groupBy("book_id").agg(F.max_by("state", "page_index").alias("state"))
    now = last.join(collected(pages, states, snapshots), "book_id", "left").select("book_id", "state", F.coalesce("toc", F.array().cast(f"array<{TOC_ENTRY}>")).alias("toc"))
    if snapshots is None:
        return now
    return now.unionByName(snapshots.select("book_id", "state", "toc").join(now.select("book_id"), "book_id", "left_anti"))


def with_state(pages: DataFrame, snapshots: DataFrame | None = None, span: int = SPAN, tasks: int | None = None) -> DataFrame:
    """Pages with before and state, the fields that rules and contexts read, and expected_entries: the
    TOC entries that openings from this page on are held against, three at most."""
    states = scan(pages, snapshots, span, tasks)
    tocs = collected(pages, states, snapshots)
    joined = dealt_join(dealt_join(pages, states, tasks, ["book_id", "page_index"]), tocs, tasks, ["book_id"], "left")
    was, now = F.col("before"), F.col("state")
    none = F.array().cast(f"array<{TOC_ENTRY}>")
    # entries past the page's own are not known yet; slices of the book's list are all that rows keep
    known = F.slice(F.coalesce("toc", none), F.lit(1), was["n_toc"])
    finalised = F.when((was["toc_status"] == "collecting") & (F.col("page_type") != "toc"), F.when(was["n_toc"] > 0, "committed").otherwise("absent")).otherwise(was["toc_status"])
    return joined.select(
        *pages.columns, "before", "state", now["toc_status"].alias("toc_status"), finalised.alias("toc_status_before"), now["n_toc"].alias("n_toc"), now["next_expected_opening_index"].alias("next_expected_opening_index"),
        was["previous_page_type"].alias("previous_page_type"), now["processed_page_count"].alias("processed_page_count"), now["book_metadata"].alias("book_metadata"),
        F.slice(known, was["next_expected_opening_index"] + 1, F.lit(EXPECTED_ENTRIES)).alias("expected_entries"),
    )


def open_tail(state: Column) -> Column:
    return F.when(state["section"]["tail"]["open"], state["section"]["tail"]["text"])


def page_context(states: DataFrame) -> DataFrame:
    """What an interpreter may see of each page, from ``with_state``."""
    was = F.col("before")
    return states.select(
        "book_id", "page_index", was["book_metadata"]["title"].alias("book_title"), was["book_metadata"]["authors"].alias("authors"), was["toc_status"].alias("toc_status"),
        F.when(was["toc_status"] == "committed", F.col("expected_entries")).otherwise(F.array().cast(f"array<{TOC_ENTRY}>")).alias("expected_toc_entries"),
        was["section"]["title"].alias("current_section_title"), was["section"]["recent_headings"].alias("current_section_headings"), open_tail(was).alias("open_paragraph_tail"), was["previous_page_type"].alias("previous_page_type"),
    )
