"""Connected components of an edge table by contraction, and joins whose keys may be hot; all distributed.

Each pass gives every node the smallest node among itself and its neighbours, jumps once along
these pointers, and replaces the edges by the distinct edges between the new labels. Stars and
small groups vanish in a pass or two. A node with a third of all edges is no hot group: minima
combine before they travel, and the joins have one row per node on one side.

Defined cases: edges from a node to itself and repeated edges change nothing, a null end matches
nothing, no edges give no labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.scratch import materialise, task_count


def contract(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """edges: u, v (long). Labels so far: node, label; back come the labels after adding the edges.

    Nodes that have no row are their own label."""
    if labels is not None:
        edges = relabelled(edges, labels)
    edges = materialise(edges.filter("u <> v").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"))
        next_ = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = materialise(near.join(next_, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
        if labels is None:
            labels = step
        else:
            moved = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = materialise(moved.unionByName(step.join(labels.select("node"), "node", "left_anti")), "labels")
        edges = materialise(relabelled(edges, step).filter("u <> v").distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def relabelled(edges: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """The edges with labels in the place of their nodes; columns in ``more`` are kept."""
    of_u = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
    of_v = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    joined = edges.join(of_u, "u", "left").join(of_v, "v", "left")
    return joined.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"), *more)


def smallest_of(rows: DataFrame, group: str, value: str | Column) -> DataFrame:
    """Per group that is not null: its smallest value (``first``; nulls don't count) and ``size``."""
    return rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(value).alias("first"), F.count(F.lit(1)).alias("size"))


def spread_join(left: DataFrame, right: DataFrame, key: str, *, how: str = "left") -> DataFrame:
    """``left`` joined with ``right`` on a key of which ``right`` has one row each (``how``: left or inner).

    Keys that hold more than a task's share of ``left``'s rows are joined by broadcast: there are
    fewer such keys than tasks. All others go through a shuffle, in which none makes a task large.
    ``left`` is read three times, so it should be stored."""
    counts = left.groupBy(key).count().filter(F.col(key).isNotNull())
    total = left.count()
    often = [r[0] for r in counts.filter(F.col("count") > max(1, total // task_count(left.sparkSession))).collect()]
    if not often:
        return left.join(right, key, how)
    hot = F.coalesce(F.col(key).isin(often), F.lit(False))
    return left.filter(hot).join(F.broadcast(right.filter(hot)), key, how).unionByName(left.filter(~hot).join(right.filter(~hot), key, how))
