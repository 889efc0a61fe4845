"""Folder trees, visibility and edge roll-up to the visible ancestor.

A hierarchy is ``(workspace_id, id, kind, label, path, parent_id,
is_external)``.  Questions about ancestors are asked of its interval labels
(``intervals.interval_labels``), never of a closure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..session import written
from .intervals import below, holding, nearest, open_over
from .iterate import ancestor_closure, k_hop

WS = "workspace_id"
# The bucket of external nodes, kind names, overview thresholds.
EXTERNAL_FOLDER = "folder::__external__"
MODULE_KINDS = ["module", "file", "package"]
FUNCTION_KINDS = ["function", "method"]
CONTAINMENT_KINDS = ["contains", "containment", "owns"]
DEPENDENCY_KINDS = {"import": "import", "imports": "import", "call": "call", "calls": "call", "inherits": "inherits", "inheritance": "inherits"}
OPEN_MODULES_UP_TO = 18
#: Depth is below two to this power.
MAX_DOUBLINGS = 32
OPEN_FOLDER_DEPTHS = [(150, 3), (500, 2)]


def node_kind(c: Column | str) -> Column:
    low = F.lower(F.coalesce(ids.as_col(c), F.lit("")))
    return (
        F.when(low.isin(MODULE_KINDS), "module").when(low == "class", "class")
        .when(low.isin(FUNCTION_KINDS), "function").otherwise("unknown")
    )


def resolve_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent_id): declared parent, else a containing node, else the longest dotted prefix that exists.

    Of several containing nodes the smallest id is taken, so the answer does
    not depend on edge order.  Modules never use the prefix rule.
    """
    known = nodes.select(WS, F.col("id").alias("_p"))
    declared = (
        nodes.filter("parent_id IS NOT NULL AND parent_id <> id").select(WS, "id", F.col("parent_id").alias("_p"))
        .join(known, [WS, "_p"], "left_semi").select(WS, "id", F.col("_p").alias("parent"), F.lit(0).alias("rank"))
    )
    holding = (
        edges.filter(F.lower("type").isin(CONTAINMENT_KINDS) & (F.col("source") != F.col("target")))
        .select(WS, F.col("target").alias("id"), F.col("source").alias("_p"))
        .join(known, [WS, "_p"], "left_semi").groupBy(WS, "id").agg(F.min("_p").alias("parent")).withColumn("rank", F.lit(1))
    )
    by_name = (
        nodes.filter(node_kind("type") != "module")
        .select(WS, "id", F.posexplode(ids.dotted_prefixes("id")).alias("pos", "_p"))
        .join(known, [WS, "_p"], "left_semi").select(WS, "id", F.col("_p").alias("parent"), (F.col("pos") + 2).alias("rank"))
    )
    best = declared.unionByName(holding).unionByName(by_name).groupBy(WS, "id").agg(F.min_by("parent", "rank").alias("parent_id"))
    return nodes.select(WS, "id").distinct().join(best, [WS, "id"], "left")


def synthesize_folders(nodes: DataFrame) -> DataFrame:
    """Hierarchy with a folder per directory that holds orphans; external orphans share one bucket."""
    parts = F.filter(F.split(ids.parent_path("path"), "/"), lambda p: p != "")
    folder = F.array_join(parts, "/")
    orphan = F.col("parent_id").isNull()
    placed = nodes.withColumn("_dir", F.when(orphan & ~F.col("is_external"), folder))
    parent = (
        F.when(~orphan, F.col("parent_id")).when(F.col("is_external"), EXTERNAL_FOLDER)
        .when(F.length("_dir") > 0, F.concat(F.lit("folder::"), "_dir"))
    )
    rows = placed.select(WS, "id", node_kind("kind").alias("kind"), "label", "path", parent.alias("parent_id"), "is_external")
    # every ancestor directory, the directory itself included
    chain = F.transform(F.sequence(F.lit(1), F.size(F.split("_dir", "/"))), lambda i: F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), i), "/"))
    folders = placed.filter(F.length("_dir") > 0).select(WS, "_dir").distinct().select(WS, F.explode(chain).alias("path")).distinct().select(
        WS, F.concat(F.lit("folder::"), "path").alias("id"), F.lit("folder").alias("kind"), F.substring_index("path", "/", -1).alias("label"), "path",
        F.when(F.col("path").contains("/"), F.concat(F.lit("folder::"), ids.parent_path("path"))).alias("parent_id"), F.lit(False).alias("is_external"),
    )
    outside = placed.filter(orphan & F.col("is_external")).select(WS).distinct().select(
        WS, F.lit(EXTERNAL_FOLDER).alias("id"), F.lit("folder").alias("kind"), F.lit("External packages").alias("label"),
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("is_external"),
    )
    return rows.unionByName(folders).unionByName(outside)


def collapse_folder_chains(hierarchy: DataFrame) -> DataFrame:
    """Merge every folder whose only child is a folder with that child.

    The top folder keeps its id, takes the joined label and the deepest path,
    and becomes the parent of whatever hung below the chain.
    """
    only = (
        hierarchy.filter("parent_id IS NOT NULL").groupBy(WS, F.col("parent_id").alias("top"))
        .agg(F.count("*").alias("n"), F.min("id").alias("child"), F.min("kind").alias("kind"))
        .filter("n = 1 AND kind = 'folder'")
    )
    folders = hierarchy.filter("kind = 'folder'").select(WS, F.col("id").alias("top"))
    links = only.join(folders, [WS, "top"], "left_semi").select(WS, F.col("child").alias("id"), F.col("top").alias("parent_id"))
    chain = ancestor_closure(links)
    head = chain.groupBy(WS, "id").agg(F.max_by("ancestor", "distance").alias("head"), F.max("distance").alias("depth"))
    inner = head.join(hierarchy.select(WS, "id", "label", "path"), [WS, "id"])
    # a chain is at most as long as a path is deep
    merged = inner.groupBy(WS, F.col("head").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "label"))), lambda s: s["label"]), "/").alias("_tail"),
        F.max_by("path", "depth").alias("_path"),
    )
    moved = head.select(WS, F.col("id").alias("parent_id"), F.col("head").alias("_head"))
    kept = hierarchy.join(head.select(WS, "id"), [WS, "id"], "left_anti").join(merged, [WS, "id"], "left")
    return kept.join(moved, [WS, "parent_id"], "left").select(
        WS, "id", "kind", F.concat_ws("/", "label", "_tail").alias("label"),
        F.when(F.col("_tail").isNotNull(), F.col("_path")).otherwise(F.col("path")).alias("path"),
        F.coalesce("_head", "parent_id").alias("parent_id"), "is_external",
    )


def dedupe_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, kind) with kinds import, call, inherits; self edges, loose ends and copies dropped."""
    pairs = [F.lit(x) for kv in DEPENDENCY_KINDS.items() for x in kv]
    known = nodes.select(WS, "id")
    return (
        edges.select(WS, "source", "target", F.try_element_at(F.create_map(*pairs), F.lower("type")).alias("kind"))
        .filter("kind IS NOT NULL AND source <> target")
        .join(known.withColumnRenamed("id", "source"), [WS, "source"], "left_semi")
        .join(known.withColumnRenamed("id", "target"), [WS, "target"], "left_semi")
        .select(WS, "source", "target", "kind").distinct()
    )


def breadcrumbs(hierarchy: DataFrame) -> DataFrame:
    """Labels from the root down to each node, joined by ``/``; one entry per level of depth.

    Every round puts the text of the node a row points at before its own and
    doubles the reach, so a tree of depth d takes log2(d) rounds of one row a node.
    """
    parent = F.when(F.col("parent_id") != F.col("id"), F.col("parent_id"))
    rows = written(hierarchy.select(WS, "id", F.col("label").alias("breadcrumb"), parent.alias("up")), "crumbs")
    for _ in range(MAX_DOUBLINGS):
        if rows.filter("up IS NOT NULL").isEmpty():
            return rows.select(WS, "id", "breadcrumb")
        above = rows.select(WS, F.col("id").alias("up"), F.col("breadcrumb").alias("_text"), F.col("up").alias("_up"))
        rows = written(rows.join(above, [WS, "up"], "left").select(WS, "id", F.concat_ws("/", "_text", "breadcrumb").alias("breadcrumb"), F.col("_up").alias("up")), "crumbs")
    raise ValueError("parent links form a cycle")


def _placed(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(workspace_id, id, enter, exit, depth) of the nodes that have labels."""
    return labels.select(WS, "id", "enter", "exit", "depth").join(nodes.select(WS, "id").distinct(), [WS, "id"], "left_semi")


def resolve_visible(wanted: DataFrame, labels: DataFrame, visible: DataFrame) -> DataFrame:
    """(id, shown): the id itself if visible, else its nearest visible ancestor, else NULL."""
    asked = wanted.select(WS, "id").distinct()
    near = nearest(_placed(asked, labels), _placed(visible, labels))
    # an id outside the tree can only show itself
    seen = visible.select(WS, "id", F.col("id").alias("_self")).distinct()
    return asked.join(near, [WS, "id"], "left").join(seen, [WS, "id"], "left").select(WS, "id", F.coalesce("_self", "shown").alias("shown"))


def lift_edges(deps: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """Both ends of each edge replaced by their nearest ancestor in ``targets``; pairs that meet are dropped."""
    deps = written(deps, "deps")
    ends = deps.select(WS, F.explode(F.array("source", "target")).alias("id")).distinct()
    shown = written(resolve_visible(ends, labels, targets).filter("shown IS NOT NULL"), "shown")
    left = shown.select(WS, F.col("id").alias("source"), F.col("shown").alias("_s"))
    right = shown.select(WS, F.col("id").alias("target"), F.col("shown").alias("_t"))
    lifted = deps.join(left, [WS, "source"]).join(right, [WS, "target"])
    rest = [c for c in deps.columns if c not in (WS, "source", "target")]
    return lifted.filter("_s <> _t").select(WS, F.col("_s").alias("source"), F.col("_t").alias("target"), *rest)


def rollup_edges(deps: DataFrame, labels: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges between visible ancestors with their count and stroke width.

    Counts are taken before ends are compared, so one row per pair and kind
    meets the labels of its ends; a pair in line is dropped.
    """
    counted = deps.groupBy(WS, "source", "target", "kind").agg(F.count("*").alias("n"))
    per = lift_edges(counted, labels, visible).groupBy(WS, "source", "target", "kind").agg(F.sum("n").alias("count"))
    ends = {end: labels.select(WS, F.col("id").alias(end), F.col("enter").alias(f"{end}_enter"), F.col("exit").alias(f"{end}_exit")) for end in ("source", "target")}
    both = per.join(ends["source"], [WS, "source"], "left").join(ends["target"], [WS, "target"], "left")
    apart = ~F.coalesce(below("source", "target") | below("target", "source"), F.lit(False))
    return both.filter(apart).select(WS, "source", "target", "kind", "count", F.least(F.lit(6.0), F.lit(1.4) + F.log2(F.col("count") + 1)).alias("width"))


def rollup_degrees(rolled: DataFrame) -> DataFrame:
    """Distinct aggregated edges out of and into each shown node (not weighted)."""
    out = F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    sided = rolled.select(WS, F.explode(F.array(out, into)).alias("e")).select(WS, "e.*")
    return sided.groupBy(WS, "id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def filter_nodes(
    nodes: DataFrame, show_external: bool = True, show_functions: bool = True, high_complexity_only: bool = False, risk: str = "all"
) -> DataFrame:
    """Nodes passing the display filters; folders face only the external one."""
    ok = F.lit(True)
    if not show_functions:
        ok = ok & (F.col("kind") != "function")
    if high_complexity_only:
        ok = ok & (F.coalesce("complexity", F.lit(0)) >= 10)
    if risk != "all":
        ok = ok & (F.coalesce("risk", F.lit("low")) == risk)
    passed = (F.col("kind") == "folder") | ok
    return nodes.filter(passed if show_external else passed & ~F.col("is_external"))


def folders_with_keepers(hierarchy: DataFrame, labels: DataFrame, kept: DataFrame) -> DataFrame:
    """Folders with at least one surviving node that is not a folder below them."""
    folders = hierarchy.filter("kind = 'folder'")
    holders = holding(_placed(folders, labels), _placed(kept.filter("kind <> 'folder'"), labels))
    return folders.join(holders, [WS, "id"], "left_semi")


def search_labels(kept: DataFrame, labels: DataFrame, text: str) -> DataFrame:
    """(id, role): role ``match`` for labels holding the text, ``open`` for every ancestor of a match."""
    needle = text.strip().lower()
    if not needle:
        return kept.filter(F.lit(False)).select(WS, "id", F.lit("match").alias("role"))
    matches = kept.filter(F.lower("label").contains(needle)).select(WS, "id").distinct()
    opened = holding(labels, _placed(matches, labels)).select(WS, "id")
    return matches.withColumn("role", F.lit("match")).unionByName(opened.withColumn("role", F.lit("open")))


def focus_neighborhood(rolled: DataFrame, visible: DataFrame, focus: DataFrame, depth: int = 1) -> DataFrame:
    """Shown nodes within ``depth`` hops of the focused ones over rolled-up edges."""
    return k_hop(visible, rolled, focus, depth)


def default_expansion(
    hierarchy: DataFrame, labels: DataFrame, folder_depths: Sequence[tuple[int, int]] = OPEN_FOLDER_DEPTHS, modules_up_to: int = OPEN_MODULES_UP_TO
) -> DataFrame:
    """Containers open at first sight: folders to a depth set by project size, and modules of small projects.

    ``folder_depths`` lists (modules at most, folders open down to), smallest
    first; larger projects open one level.  ``modules_up_to`` is the largest
    project whose modules open too.
    """
    sizes = hierarchy.filter("kind = 'module' AND NOT is_external").groupBy(WS).agg(F.count("*").alias("_modules"))
    n = F.coalesce("_modules", F.lit(0))
    limit = F.lit(1)
    for most, depth in reversed(folder_depths):
        limit = F.when(n <= most, depth).otherwise(limit)
    sized = hierarchy.join(labels.select(WS, "id", "depth"), [WS, "id"]).join(sizes, [WS], "left")
    folder = (F.col("kind") == "folder") & (F.col("depth") < limit)
    module = (F.col("kind") == "module") & (n <= modules_up_to) & (F.col("depth") <= limit)
    return sized.filter(folder | module).select(WS, "id")


def visible_set(hierarchy: DataFrame, labels: DataFrame, expanded: DataFrame, passing: DataFrame) -> DataFrame:
    """Nodes that pass and whose ancestors all pass and are expanded: none of those that do not lies around them."""
    ok = passing.select(WS, "id").distinct()
    open_ = ok.join(expanded.select(WS, "id"), [WS, "id"], "left_semi")
    shut = labels.join(open_, [WS, "id"], "left_anti")
    free = open_over(_placed(ok, labels), shut, strictly=True).filter("open = 0").select(WS, "id")
    return hierarchy.select(WS, "id").join(free, [WS, "id"], "left_semi")


def sibling_edges(deps: DataFrame, labels: DataFrame, siblings: DataFrame) -> DataFrame:
    """Distinct pairs of a container's children joined by something beneath them."""
    pairs = deps.select(WS, "source", "target").distinct()
    return lift_edges(pairs, labels, siblings).distinct()


def child_counts(hierarchy: DataFrame, show_external: bool = True) -> DataFrame:
    shown = hierarchy if show_external else hierarchy.filter("NOT is_external")
    n = shown.filter("parent_id IS NOT NULL").groupBy(WS, F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    return hierarchy.select(WS, "id").join(n, [WS, "id"], "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("bigint"))
