"""Graph queries and exports over ``nodes`` and ``edges`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, rules
from .iterate import k_hop

WS = "workspace_id"


def keep_nodes(nodes: DataFrame, level: int = 3) -> DataFrame:
    """Nodes shown at a level: modules always, classes and plain functions from 2, methods at 3."""
    is_type = F.col("type")
    shown = is_type == "module"
    if level >= 2:
        plain = is_type == "function" if level >= 3 else (is_type == "function") & (F.coalesce("class", F.lit("")) == "")
        shown = shown | (is_type == "class") | plain
    return nodes.filter(ids.is_semantic_id("id") & ~ids.is_noise_namespace("id") & shown)


def allowed_edges(edges: DataFrame, level: int = 3) -> DataFrame:
    return edges.filter(F.col("type").isin(rules.EDGE_TYPES_BY_LEVEL[max(1, min(level, 3))]))


def induced_subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are in ``nodes``.

    Plain semi joins: adaptive execution splits a hub's partition on the
    edge side, and the node side has one row per key.
    """
    kept = nodes.select(WS, "id")
    return (
        edges.join(kept.withColumnRenamed("id", "source"), [WS, "source"], "left_semi")
        .join(kept.withColumnRenamed("id", "target"), [WS, "target"], "left_semi")
        .select(*edges.columns)
    )


def neighbor_pairs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge in one pass over the table."""
    ends = F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("neighbor")),
                   F.struct(F.col("target").alias("id"), F.col("source").alias("neighbor")))
    return edges.select(WS, F.explode(ends).alias("e")).select(WS, "e.id", "e.neighbor")


def node_risk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """coupling (in + out degree), complexity (distinct neighbours) and risk band.

    Counting runs in two steps, first per pair of neighbours: a hub's edges
    spread over tasks before its totals meet.  A pair moves once, whichever way
    its edges point; an edge from a node to itself counts twice, one neighbour.
    """
    # A missing end comes first, so that both directions of a pair meet.
    ahead = F.col("source").isNull() | F.coalesce(F.col("source") <= F.col("target"), F.lit(False))
    x, y = F.when(ahead, F.col("source")).otherwise(F.col("target")), F.when(ahead, F.col("target")).otherwise(F.col("source"))
    per_pair = edges.select(WS, x.alias("x"), y.alias("y")).groupBy(WS, "x", "y").agg(F.count("*").alias("n"))
    alone = F.col("x").eqNullSafe(F.col("y"))
    ends = F.when(alone, F.array(F.struct(F.col("x").alias("id"), (2 * F.col("n")).alias("n")))).otherwise(
        F.array(F.struct(F.col("x").alias("id"), "n"), F.struct(F.col("y").alias("id"), "n"))
    )
    per_end = per_pair.select(WS, F.explode(ends).alias("e")).select(WS, "e.id", "e.n")
    totals = per_end.groupBy(WS, "id").agg(F.sum("n").alias("coupling"), F.count("*").alias("complexity"))
    scored = nodes.join(totals, [WS, "id"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("coupling", "complexity")}
    )

    def beyond(band: dict) -> Column:
        return (F.col("coupling") >= band["coupling"]) | (F.col("complexity") >= band["complexity"])

    return scored.withColumn("risk", F.when(beyond(rules.RISK_HIGH), "high").when(beyond(rules.RISK_MEDIUM), "medium").otherwise("low"))


def parent_id() -> Column:
    """Containing node of a symbol row: its class, else its module."""
    module, cls = F.col("module"), F.col("class")
    has_module = F.coalesce(F.length(module), F.lit(0)) > 0
    has_class = F.coalesce(F.length(cls), F.lit(0)) > 0
    owner = F.when(F.col("type") == "class", module).when(
        F.col("type") == "function", F.when(has_class, F.concat_ws(".", module, cls)).otherwise(module)
    )
    return F.when(has_module, owner)


def with_parent(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("parent_id", parent_id())


def export_graph(nodes: DataFrame, edges: DataFrame, level: int = 3) -> tuple[DataFrame, DataFrame]:
    """(export nodes, export edges): level filter, risk on all surviving edges, labels and ids."""
    kept = keep_nodes(nodes, level)
    inner = induced_subgraph(kept, edges)
    out_nodes = with_parent(node_risk(kept, inner)).withColumn("display_name", ids.display_name("id"))
    out_edges = allowed_edges(inner, level).select(
        WS, ids.edge_id("source", "target", "type").alias("id"), "source", "target", "type"
    )
    return out_nodes, out_edges


def lookup_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Node rows for a table of ids; unknown ids are simply absent."""
    return nodes.join(wanted.select(WS, "id"), [WS, "id"], "left_semi")


def dependencies(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Direct successors of each wanted id."""
    asked = wanted.select(WS, F.col("id").alias("source"))
    return edges.join(asked, [WS, "source"], "left_semi").select(WS, F.col("source").alias("id"), F.col("target").alias("dependency")).distinct()


def dependents(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Direct predecessors of each wanted id."""
    asked = wanted.select(WS, F.col("id").alias("target"))
    return edges.join(asked, [WS, "target"], "left_semi").select(WS, F.col("target").alias("id"), F.col("source").alias("dependent")).distinct()


def export_neighborhood(nodes: DataFrame, edges: DataFrame, centers: DataFrame, depth: int = 2, level: int = 3) -> tuple[DataFrame, DataFrame]:
    """Export of the k-hop neighbourhood; risk is recomputed inside it."""
    near = k_hop(nodes, edges, centers, depth).select(WS, "id")
    inside = nodes.join(near, [WS, "id"], "left_semi")
    return export_graph(inside, induced_subgraph(inside, edges), level)


def change_impact(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """How many modules depend on each changed module, and the resulting risk.

    Only counts travel; the names are one row each in ``affected_dependents``.
    """
    degree = (
        edges.select(WS, "source", "target").distinct().groupBy(WS, F.col("target").alias("module_name"))
        .agg(F.count("*").alias("num_affected"))
    )
    n = F.coalesce("num_affected", F.lit(0)).cast("bigint")
    band = F.when(F.col("removes_symbol"), "critical").when(n > 20, "high").when(n > 5, "medium").otherwise("low")
    return changes.join(degree, [WS, "module_name"], "left").withColumn("num_affected", n).withColumn("risk_level", band)


def affected_dependents(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per (changed path, dependent)."""
    changed = paths.select(WS, "path", ids.module_id("path").alias("target")).distinct()
    return edges.select(WS, "source", "target").distinct().join(changed, [WS, "target"]).select(WS, "path", F.col("source").alias("dependent"))


def adjacency_with_labels(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """In and out edges of wanted nodes, labelled by the other end's label or id."""
    asked = wanted.select(WS, "id")
    outward = F.struct(F.col("source").alias("id"), F.lit("out").alias("direction"), F.col("target").alias("other"))
    inward = F.struct(F.col("target").alias("id"), F.lit("in").alias("direction"), F.col("source").alias("other"))
    both = edges.select(WS, "type", F.explode(F.array(outward, inward)).alias("e")).select(WS, "type", "e.*")
    labels = nodes.select(WS, F.col("id").alias("other"), F.col("label")).dropDuplicates([WS, "other"])
    return (
        both.join(asked, [WS, "id"], "left_semi").join(labels, [WS, "other"], "left")
        .select(WS, "id", "direction", "other", F.coalesce("label", "other").alias("label"), "type")
    )


def merge_snapshots(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = (WS, "id")) -> DataFrame:
    """Upsert: the newcomer's row replaces the old one of the same key."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_age", *rest)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def _first_present(df: DataFrame, names: list[str]) -> Column:
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def normalize_edges(edges: DataFrame) -> DataFrame:
    """Accept ``from/to/kind`` spellings, plural kinds and missing ids; drop edges without ends."""
    kind = F.lower(F.coalesce(_first_present(edges, ["type", "kind"]), F.lit("")))
    kind = F.when(kind == "imports", "import").when(kind == "calls", "call").when(kind == "", "unknown").otherwise(kind)
    named = edges.select(
        WS, F.coalesce(_first_present(edges, ["source", "from"]), F.lit("")).alias("source"),
        F.coalesce(_first_present(edges, ["target", "to"]), F.lit("")).alias("target"), kind.alias("type"),
        _first_present(edges, ["id"]).alias("id"),
    ).filter("source <> '' AND target <> ''")
    made = F.concat("source", F.lit("->"), "target", F.lit(":"), "type")
    return named.withColumn("id", F.coalesce("id", made))


def normalize_nodes(nodes: DataFrame) -> DataFrame:
    """Label falls back to display name, then id; ``type`` stands in for ``kind``."""
    return nodes.withColumns({
        "label": _first_present(nodes, ["label", "display_name", "id"]),
        "kind": _first_present(nodes, ["kind", "type"]),
    })


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts per type, and in total as type ``all``."""

    def counted(df: DataFrame, what: str) -> DataFrame:
        per = df.groupBy(WS, "type").agg(F.count("*").alias("n"))
        return per.unionByName(per.groupBy(WS).agg(F.sum("n").alias("n")).withColumn("type", F.lit("all"))).withColumn("what", F.lit(what))

    return counted(nodes, "node").unionByName(counted(edges, "edge"))


def snapshot_needs_rebuild(nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """Per workspace: noise among its nodes or an outdated builder; empty graphs never."""
    noisy = nodes.groupBy(WS).agg(F.bool_or(ids.is_noise_namespace("id")).alias("noisy"))
    return (
        meta.join(noisy, WS, "left")
        .withColumn("needs_rebuild", F.col("noisy").isNotNull() & (F.col("noisy") | (F.coalesce("builder_version", F.lit(0)) < rules.BUILDER_VERSION)))
        .select(WS, "needs_rebuild")
    )
