"""Mixing sources to target weights by pivotal dependent rounding.

Targets. Sources in code-point order, null last, take the weights in turn and share ``share``
times all words; a target stops at ``most`` times its source's words and what is above goes to
the others by weight, until none is above. In closed form the targets are min(cap, level *
weight) for one level, found with running sums over the table of sources.

Rounding. A document of a source with target / words = r is taken floor(r) times and once more
with probability r - floor(r). Pairs of fractional documents of one source and size class (power
of two) meet: words move from one to the other, the direction drawn so that expectations stay,
until one of the two is integral; it is done, the other goes on. So the words taken per source
never change while documents are settled. Documents are dealt to buckets by a hash; each bucket
leaves at most one fractional document per source and class, and these meet in a tree of
``fan_in`` until one group per source is left. There, the few that remain (one a class) are
rounded together to the combination that comes closest to their common number of words.

A bucket is streamed in sorted order, so memory does not grow with it, and a source that holds
a third of all rows is spread over all buckets. All draws come from hashes of ids: reruns agree,
whatever the cluster. Defined cases: null text has size 0, and documents without words are left out; null source is a
source of its own; repeated rows and null ids are documents like any other; an empty table gives
an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.scratch import materialise, task_count, unused

_WORD = r"[^\x20\x09-\x0D]+"
_ROW = "doc_id long, source string, size long, source_size long, target double, bucket long, copies long, part double, kind int, hash long, done boolean"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def running(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with exclusive running sums over all of them in an order: sums within ranges of the
    order, and of whole ranges before them, of which there are as many as tasks."""
    (part,) = unused(rows.columns, "range")
    dealt = materialise(rows.repartitionByRange(task_count(rows.sparkSession), *order).withColumn(part, F.spark_partition_id()), "mix-ranges")
    whole = dealt.groupBy(part).agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()]).orderBy(part).collect()
    at = dict.fromkeys(sums, 0.0)
    before = []
    for row in whole:
        before.append((row[part], *at.values()))
        at = {n: at[n] + (row[n] or 0.0) for n in at}
    names = unused([*rows.columns, part, *sums], *[f"before_{n}" for n in sums])
    offsets = rows.sparkSession.createDataFrame(before, f"`{part}` int, " + ", ".join(f"`{n}` double" for n in names))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.select("*", *[F.coalesce(F.sum(c).over(inside).cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])
    joined = here.join(F.broadcast(offsets), part)
    return joined.select(*rows.columns, *[(F.col(n) + F.col(b)).alias(n) for n, b in zip(sums, names, strict=True)])


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source: source_size, n_docs, target. However many sources there are, no task holds them all."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    numbered = running(sources, [F.col("source").isNull(), F.col("source")], {"number": F.lit(1)})
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights)).cast("int"))
    caps = numbered.select("source", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    by_level = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    below = materialise(running(caps, by_level, {"caps": F.col("cap"), "weights": F.col("weight")}), "mix-levels")
    total = below.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    # the level if exactly the sources before this one (by cap / weight) stop at their caps; the first
    # fit is the lowest level of all fits, as a level only falls from there on
    level = (F.lit(float(total["size"] or 0) * float(share)) - F.col("caps")) / (F.lit(float(total["weight"] or 0)) - F.col("weights"))
    chosen = below.filter(level <= F.col("cap") / F.col("weight")).agg(F.max(level).alias("level")).first()["level"]
    target = F.col("cap") if chosen is None else F.least(F.col("cap"), F.lit(chosen) * F.col("weight"))
    return below.select("source", "source_size", "n_docs", target.alias("target"))


def _uniform(a: int, b: int) -> float:
    """A number in [0, 1) from two row hashes."""
    z = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = ((z ^ (z >> shift)) * factor) & 0xFFFFFFFFFFFFFFFF
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def transfer(size_a: int, part_a: float, size_b: int, part_b: float, draw: float) -> tuple[float, float]:
    """Move words between two fractional documents until one is 0 or 1; size * part stays in sum."""
    to_b = min(size_a * part_a, size_b * (1 - part_b))
    to_a = min(size_b * part_b, size_a * (1 - part_a))
    if draw * (to_a + to_b) < to_a:
        moved = to_b
        new_a = 0.0 if size_a * part_a <= moved else part_a - moved / size_a
        new_b = 1.0 if size_b * (1 - part_b) <= moved else part_b + moved / size_b
    else:
        moved = to_a
        new_a = 1.0 if size_a * (1 - part_a) <= moved else part_a + moved / size_a
        new_b = 0.0 if size_b * part_b <= moved else part_b - moved / size_b
    return new_a, new_b


def closest(sizes: list[int], parts: list[float], most: int = 18) -> list[int]:
    """0 or 1 for each document so that the words taken come closest to sum(size * part)."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    goal = sum(s * p for s, p in zip(sizes, parts, strict=True))
    out = [0] * len(sizes)
    head, tail = order[: max(0, len(order) - most)], order[max(0, len(order) - most) :]
    due = 0.0
    for i in head:  # the largest beyond ``most``: one by one, each makes up for the ones before
        due += sizes[i] * parts[i]
        out[i] = int(due >= sizes[i] / 2)
        due -= out[i] * sizes[i]
        goal -= out[i] * sizes[i]
    sums = np.zeros(1)
    for i in tail:
        sums = np.concatenate((sums, sums + sizes[i]))
    pick = int(np.abs(sums - goal).argmin())
    for k, i in enumerate(tail):
        out[i] = pick >> k & 1
    return out


def _settle(frames: Iterator[pd.DataFrame], root: bool) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket, source and class; yields them done, or open with a part left.

    At the root a few of each class stay open until the end, for the common rounding."""
    names = [c.split(" ")[0] for c in _ROW.split(", ")]
    keep = 3 if root else 1
    group: tuple | None = None
    kind, left, waiting = None, [], []

    def finish() -> list[tuple]:
        rows = waiting + left
        if not rows or not root:
            return [tuple(r) for r in rows]
        taken = closest([r[2] for r in rows], [r[7] for r in rows])
        return [(*r[:6], r[6] + t, 0.0, *r[8:10], True) for r, t in zip(rows, taken, strict=True)]

    for frame in frames:
        out: list[tuple] = []
        for values in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False):
            row = list(values)
            if (row[5], row[1]) != group:
                out += finish()
                group, kind, left, waiting = (row[5], row[1]), None, [], []
            if row[7] <= 0.0:
                row[10] = True
                out.append(tuple(row))
                continue
            if row[8] != kind:
                waiting, kind, left = waiting + left, row[8], []
            left.append(row)
            if len(left) <= keep:
                continue
            pair, left = left[:2], left[2:]
            (one, two) = pair
            one[7], two[7] = transfer(one[2], one[7], two[2], two[7], _uniform(one[9], two[9]))
            for each in pair:
                if each[7] in (0.0, 1.0):
                    each[6], each[7], each[10] = each[6] + int(each[7]), 0.0, True
                    out.append(tuple(each))
                else:
                    left.insert(0, each)
        if out:
            yield _frame(out, names)
    if rest := finish():
        yield _frame(rest, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "size": "int64", "source_size": "int64", "bucket": "int64", "copies": "int64", "kind": "int32", "hash": "int64", "part": "float64", "target": "float64", "done": "bool"})


def mix_copies(
    sized: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, bucket_rows: int = 1024, fan_in: int = 16, seed: int = 1
) -> DataFrame:
    """Per row of ``sized`` (doc_id, source, size): these, source_size, target and copies."""
    sized = materialise(sized.select("doc_id", "source", "size"), "mix-sizes")
    targets = materialise(source_targets(sized, weights, share, most), "mix-targets")
    rows = targets.agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, -(-rows // bucket_rows))

    joined = sized.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    hashed = F.xxhash64(F.lit(seed), "doc_id", "size")
    open_rows = joined.withColumn("ratio", F.when(F.col("size") > 0, ratio).otherwise(F.lit(0.0))).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.col("size").cast("long").alias("size"),
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        F.pmod(hashed, F.lit(buckets)).alias("bucket"),
        F.floor("ratio").cast("long").alias("copies"),
        (F.col("ratio") - F.floor("ratio")).alias("part"),
        F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(F.lit(0)).cast("int").alias("kind"),
        F.xxhash64(F.lit(seed + 1), "doc_id", "size").alias("hash"),
        F.lit(False).alias("done"),
    )
    settled: DataFrame | None = None
    while True:
        root = buckets == 1
        dealt = open_rows.repartition("bucket", "source").sortWithinPartitions("bucket", "source", "kind", "hash", "doc_id")
        level = materialise(dealt.mapInPandas(lambda frames, root=root: _settle(frames, root), _ROW), "mix-level")
        done = level.filter("done")
        settled = done if settled is None else settled.unionByName(done)
        if root:
            break
        buckets = -(-buckets // fan_in)
        open_rows = level.filter("not done").withColumn("bucket", F.floor(F.col("bucket") / fan_in))
    return settled.select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken.

    Decisions meet the documents on (id, source, size); rows that share all three share them out.
    """
    names = docs.columns
    key, low, more, copies_, copy = unused(names, "__key", "__low", "__more", "__copies", "__copy")
    of_docs = F.to_json(F.struct(docs[id_col].cast("long").alias("i"), docs[source_col].alias("s"), n_words(docs[text_col]).alias("n")))
    sized = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"))
    copies = mix_copies(sized, **options)
    per_key = copies.groupBy(F.to_json(F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("n"))).alias(key)).agg(
        F.min("copies").alias(low), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias(more)
    )
    joined = docs.withColumn(key, of_docs).join(per_key, key)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(text_col)))
    taken = joined.withColumn(copies_, F.col(low) + F.when(place <= F.col(more), 1).otherwise(0))
    return taken.filter(F.col(copies_) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies_).cast("int")))).select(*names)
