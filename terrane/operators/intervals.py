"""Interval labels on trees: whoever lies inside an interval is below it.

Every node gets the places where an Euler tour enters and leaves it, and its
depth.  The tour is numbered by contraction: leaves fold into their parents
round by round while that shrinks the tree, and what is left (long chains)
is ranked by pointer jumping over its tour.  Questions about ancestors then
are comparisons, or one scan in the order of the tour; no closure is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

WS = "workspace_id"
#: Above every root; one per workspace.
ROOT = "\u0000"
#: Children of a node are numbered slice by slice, so a parent of very many is no single task.
SLICES = 64
#: A round of folding must take this share of the nodes, else the rest is ranked.
SHRINK = 0.25


def interval_labels(hierarchy: DataFrame) -> DataFrame:
    """(workspace_id, id, parent_id, enter, exit, depth) of every node of ``hierarchy`` (workspace_id, id, parent_id).

    ``a`` is an ancestor of ``b`` when a.enter < b.enter and b.exit < a.exit.
    A parent without a row of its own is a root; a node that names itself has
    no parent.  Cycles and nodes with several parents raise ValueError.
    """
    links = hierarchy.filter("parent_id IS NOT NULL AND parent_id <> id").select(WS, "id", "parent_id").distinct()
    own = F.struct(F.col("id").alias("id"), F.col("parent_id").alias("parent_id"))
    above = F.struct(F.col("parent_id").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    rows = links.select(WS, F.explode(F.array(own, above)).alias("n")).select(WS, "n.*").unionByName(
        hierarchy.select(WS, "id", F.lit(None).cast("string").alias("parent_id"))
    )
    nodes = rows.groupBy(WS, "id").agg(F.max("parent_id").alias("parent_id"), F.min("parent_id").alias("_least"))
    tree = written(
        nodes.select(WS, "id", F.coalesce("parent_id", F.lit(ROOT)).alias("parent_id"), (F.col("_least") != F.col("parent_id")).alias("_torn"), F.lit(0).cast("long").alias("inner")), "tree"
    )
    if not tree.filter("_torn").isEmpty():
        raise ValueError("a node has several parents")
    top = tree.select(WS).distinct().select(WS, F.lit(ROOT).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("inner"))
    rest = written(tree.drop("_torn").unionByName(top), "rest")
    left, folded = rest.count(), []
    while True:
        leaves, rest, size = _fold(rest)
        folded.append(leaves)
        taken, left = left - size, size
        if taken <= SHRINK * (left + taken):
            break
    labels = _ranked(rest, left)
    for leaves in reversed(folded):
        up = labels.select(WS, F.col("id").alias("parent_id"), F.col("enter").alias("_e"), F.col("depth").alias("_d"))
        placed = leaves.join(up, [WS, "parent_id"]).select(
            WS, "id", "parent_id", (F.col("_e") + F.col("place")).alias("enter"), (F.col("_e") + F.col("place") + F.col("inner") + 1).alias("exit"), (F.col("_d") + 1).alias("depth")
        )
        labels = labels.unionByName(written(placed, "labels"))
    return labels.filter(F.col("id") != ROOT).withColumn("parent_id", F.nullif("parent_id", F.lit(ROOT)))


def _fold(rest: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(leaves with their place behind the parent's entry, the tree without them, its size)."""
    parents = rest.filter("parent_id IS NOT NULL").select(WS, F.col("parent_id").alias("id")).distinct()
    bare = rest.join(parents, [WS, "id"], "left_anti").filter("parent_id IS NOT NULL")
    sliced = bare.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SLICES))).withColumn("_w", F.col("inner") + 2)
    earlier = Window.partitionBy(WS, "parent_id", "_s").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    inside = written(sliced.withColumn("_within", F.coalesce(F.sum("_w").over(earlier), F.lit(0))), "leaves")
    per_slice = inside.groupBy(WS, "parent_id", "_s").agg(F.sum("_w").alias("_w"))
    before = Window.partitionBy(WS, "parent_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(WS, "parent_id", "_s", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_before"))
    had = rest.select(WS, F.col("id").alias("parent_id"), F.col("inner").alias("_had"))
    leaves = inside.join(offsets, [WS, "parent_id", "_s"]).join(had, [WS, "parent_id"]).select(
        WS, "id", "parent_id", "inner", (1 + F.col("_had") + F.col("_before") + F.col("_within")).alias("place")
    )
    grown = per_slice.groupBy(WS, F.col("parent_id").alias("id")).agg(F.sum("_w").alias("_more"))
    kept = rest.join(inside.select(WS, "id"), [WS, "id"], "left_anti").join(grown, [WS, "id"], "left").select(
        WS, "id", "parent_id", (F.col("inner") + F.coalesce("_more", F.lit(0))).alias("inner")
    )
    kept = written(kept, "kept")
    return leaves, kept, kept.count()


def _ranked(rest: DataFrame, size: int) -> DataFrame:
    """Labels of a tree of ``size`` nodes that hold ``inner`` folded places, by list ranking of its tour."""
    sliced = rest.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SLICES)))
    near = Window.partitionBy(WS, "parent_id", "_s").orderBy("id")
    beside = sliced.filter("parent_id IS NOT NULL").withColumn("_next", F.lead("id").over(near))
    firsts = beside.groupBy(WS, "parent_id", "_s").agg(F.min("id").alias("_first"))
    by_slice = Window.partitionBy(WS, "parent_id").orderBy("_s")
    firsts = firsts.withColumn("_after", F.lead("_first").over(by_slice)).withColumn("_rank", F.row_number().over(by_slice))
    after = beside.join(firsts.select(WS, "parent_id", "_s", "_after"), [WS, "parent_id", "_s"]).select(WS, "id", F.coalesce("_next", "_after").alias("_sibling"))
    child = firsts.filter("_rank = 1").select(WS, F.col("parent_id").alias("id"), F.col("_first").alias("_child"))
    linked = rest.join(after, [WS, "id"], "left").join(child, [WS, "id"], "left")
    # a place of the tour is a node and a side: 0 entering, 1 leaving
    goes_in = F.struct(
        F.lit(0).alias("side"), F.coalesce("_child", "id").alias("to"), F.when(F.col("_child").isNull(), 1).otherwise(0).alias("to_side"),
        (F.col("inner") + 1).alias("width"), F.lit(1).cast("long").alias("deeper"),
    )
    goes_out = F.struct(
        F.lit(1).alias("side"), F.coalesce("_sibling", "parent_id").alias("to"), F.when(F.col("_sibling").isNull(), 1).otherwise(0).alias("to_side"),
        F.lit(1).cast("long").alias("width"), F.lit(-1).cast("long").alias("deeper"),
    )
    tour = written(linked.select(WS, "id", F.explode(F.array(goes_in, goes_out)).alias("e")).select(WS, "id", "e.*"), "tour")
    # every round doubles the reach of a pointer, and a tour has two places a node
    for _ in range((2 * size).bit_length() + 1):
        if tour.filter("to IS NOT NULL").isEmpty():
            break
        onward = tour.select(
            WS, F.col("id").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("_to"), F.col("to_side").alias("_side"), F.col("width").alias("_width"), F.col("deeper").alias("_deeper")
        )
        tour = written(
            tour.join(onward, [WS, "to", "to_side"], "left").select(
                WS, "id", "side", F.col("_to").alias("to"), F.col("_side").alias("to_side"),
                (F.col("width") + F.coalesce("_width", F.lit(0))).alias("width"), (F.col("deeper") + F.coalesce("_deeper", F.lit(0))).alias("deeper"),
            ), "tour",
        )
    else:
        raise ValueError("parent links form a cycle")
    total = tour.groupBy(WS).agg(F.max("width").alias("_total"))
    sides = tour.groupBy(WS, "id").agg(
        F.max(F.when(F.col("side") == 0, F.col("width"))).alias("_in"), F.max(F.when(F.col("side") == 1, F.col("width"))).alias("_out"),
        F.max(F.when(F.col("side") == 0, F.col("deeper"))).alias("_deeper"),
    )
    # what remains to be climbed is the depth; the root above all roots counts as none
    return written(
        sides.join(total, WS).join(rest.select(WS, "id", "parent_id"), [WS, "id"]).select(
            WS, "id", "parent_id", (F.col("_total") - F.col("_in")).alias("enter"), (F.col("_total") - F.col("_out")).alias("exit"), (-F.col("_deeper") - 1).alias("depth")
        ), "ranked",
    )


def below(upper: str, lower: str) -> Column:
    """Whether the node labelled ``<lower>_enter``, ``<lower>_exit`` lies under the one of ``upper``."""
    return (F.col(f"{upper}_enter") < F.col(f"{lower}_enter")) & (F.col(f"{lower}_exit") < F.col(f"{upper}_exit"))


def _scan(events: DataFrame) -> DataFrame:
    """``events`` (workspace_id, at, kind, id, step) in tour order, with ``open``: the sum of ``step`` up to and with each.

    One range sort; sums run inside partitions and totals carry over, so a
    workspace with most of the rows is no single task.
    """
    order = [WS, "at", "kind", "id"]
    spread = events.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(spread.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "events")
    totals = rows.groupBy(WS, "part").agg(F.sum("step").alias("_t"))
    earlier = Window.partitionBy(WS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(WS, "part", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_carried"))
    running = Window.partitionBy(WS, "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum("step").over(running)).join(carried, [WS, "part"]).withColumn("open", F.col("_sum") + F.col("_carried")).drop("_sum", "_carried")


def _events(df: DataFrame, at: str, kind: int, step: int) -> DataFrame:
    return df.select(WS, F.col(at).alias("at"), F.lit(kind).alias("kind"), "id", F.lit(step).alias("step"))


def open_over(asked: DataFrame, intervals: DataFrame, strictly: bool) -> DataFrame:
    """(workspace_id, id, open): how many ``intervals`` contain each asked node; itself counts unless ``strictly``.

    Both have workspace_id, id, enter and exit.
    """
    questions = _events(asked, "enter", 0 if strictly else 2, 0)
    both = questions.unionByName(_events(intervals, "enter", 1, 1)).unionByName(_events(intervals, "exit", 3, -1))
    return _scan(both).filter(F.col("step") == 0).select(WS, "id", "open")


def holding(containers: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of ``containers`` with at least one of ``points`` strictly inside."""
    counted = _scan(_events(containers, "enter", 2, 0).unionByName(_events(containers, "exit", 3, 0)).unionByName(_events(points, "enter", 1, 1)))
    per = counted.filter("step = 0").groupBy(WS, "id").agg((F.max("open") - F.min("open")).alias("_inside"))
    return containers.join(per.filter("_inside > 0").select(WS, "id"), [WS, "id"], "left_semi")


def nearest(asked: DataFrame, intervals: DataFrame) -> DataFrame:
    """(workspace_id, id, shown): the innermost of ``intervals`` that contains each asked node, itself included.

    Intervals are nested, so the one that is open at a place with n others
    around it is the last one entered at that level.
    """
    both = _events(asked, "enter", 2, 0).unionByName(_events(intervals, "enter", 1, 1)).unionByName(_events(intervals, "exit", 3, -1))
    rows = _scan(both).filter("step >= 0")
    entered = F.when(F.col("step") == 1, F.col("id"))
    near = Window.partitionBy(WS, "part", "open").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("shown", F.last(entered, ignorenulls=True).over(near)).filter("step = 0")
    # a place before any entry of its level in its part: the last entry of an earlier part
    tails = rows.groupBy(WS, "open", "part").agg(F.max_by(entered, F.when(F.col("step") == 1, F.col("seq"))).alias("_last"))
    parts = Window.partitionBy(WS, "open").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(WS, "open", "part", F.last("_last", ignorenulls=True).over(parts).alias("_carried"))
    joined = found.join(carried, [WS, "open", "part"], "left")
    return joined.select(WS, "id", F.when(F.col("open") > 0, F.coalesce("shown", "_carried")).alias("shown"))
