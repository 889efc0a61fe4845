"""Typed dependency graph from resolved tables.

``nodes(workspace_id, id, type, path, language, module, class, is_external,
declared)`` and ``edges(workspace_id, source, target, type)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, rules
from ..session import cut_lineage
from . import resolve

WS = "workspace_id"
NODE_COLUMNS = [WS, "id", "type", "path", "language", "module", "class", "is_external", "declared"]


def _nodes(df: DataFrame, id_, kind, declared: bool, external, path=None, language=None, module=None, cls=None) -> DataFrame:
    def text(c):
        return F.lit(None).cast("string") if c is None else F.col(c) if isinstance(c, str) else c

    return df.select(
        WS, ids.as_col(id_).alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        text(path).alias("path"), text(language).alias("language"), text(module).alias("module"), text(cls).alias("class"),
        (F.lit(external) if isinstance(external, bool) else external).alias("is_external"), F.lit(declared).alias("declared"),
    )


def module_nodes(modules: DataFrame) -> DataFrame:
    named = modules.filter(ids.is_semantic_id("module_name"))
    return _nodes(named, "module_name", "module", True, False, path="path", language=ids.language("path"))


def import_edges(resolved: DataFrame) -> DataFrame:
    return (
        resolved.filter(F.col("target") != F.col("module_name"))
        .select(WS, F.col("module_name").alias("source"), "target", F.lit("imports").alias("type")).distinct()
    )


def _stubs(targets: DataFrame, kind: str, modules: DataFrame, owner) -> DataFrame:
    """Nodes for edge ends nobody declared; external unless their owner is a project module."""
    project = modules.select(WS, F.col("module_name").alias("_owner"), F.lit(True).alias("_known")).distinct()
    placed = targets.select(WS, F.col("target").alias("id")).distinct().withColumn("_owner", owner).join(project, [WS, "_owner"], "left")
    return _nodes(placed, "id", kind, False, F.col("_known").isNull())


def import_stubs(resolved: DataFrame, modules: DataFrame) -> DataFrame:
    targets = import_edges(resolved)
    known = modules.filter(ids.is_semantic_id("module_name")).select(WS, F.col("module_name").alias("target"))
    return _stubs(targets.join(known, [WS, "target"], "left_anti"), "module", modules, F.col("id"))


def _at_level(symbols: DataFrame, level: int) -> DataFrame:
    return symbols.filter(F.col("kind").isin(["class", "function"] + (["method"] if level >= 3 else []))) if level >= 2 else symbols.filter(F.lit(False))


def symbol_nodes(symbols: DataFrame, level: int = 3) -> DataFrame:
    kind = F.when(F.col("kind") == "class", "class").otherwise("function")
    return _nodes(_at_level(symbols, level), "symbol_id", kind, True, False, module="module_name", cls="class_name")


def contains_edges(symbols: DataFrame, level: int = 3) -> DataFrame:
    owner = F.concat_ws(".", "module_name", "class_name")
    return _at_level(symbols, level).select(WS, owner.alias("source"), F.col("symbol_id").alias("target"), F.lit("contains").alias("type")).distinct()


def inherit_edges(resolved: DataFrame) -> DataFrame:
    return (
        resolved.filter((F.col("target") != F.col("class_id")) & ~ids.is_noise_namespace("target"))
        .select(WS, F.col("class_id").alias("source"), "target", F.lit("inherits").alias("type")).distinct()
    )


def base_stubs(resolved: DataFrame, classes: DataFrame, modules: DataFrame) -> DataFrame:
    known = classes.select(WS, F.col("symbol_id").alias("target"))
    missing = inherit_edges(resolved).join(known, [WS, "target"], "left_anti")
    return _stubs(missing, "class", modules, ids.prefix_of("id"))


def call_edges(resolved: DataFrame) -> DataFrame:
    return (
        resolved.filter((F.col("target") != F.col("caller_id")) & ids.is_semantic_id("target"))
        .select(WS, F.col("caller_id").alias("source"), "target", F.lit("calls").alias("type")).distinct()
    )


def call_stubs(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    known = symbols.select(WS, F.col("symbol_id").alias("target"))
    missing = call_edges(resolved).join(known, [WS, "target"], "left_anti").select(WS, F.col("target").alias("id")).distinct()
    return _nodes(missing, "id", "function", False, True)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id: declared beats stub, then module, class, function."""
    rank = F.struct(
        (~F.col("declared")).alias("stub"), F.array_position(F.array(*map(F.lit, ["module", "class", "function"])), F.col("type")).alias("t"),
        F.coalesce("path", F.lit("")).alias("p"), F.coalesce("module", F.lit("")).alias("m"), F.coalesce("class", F.lit("")).alias("c"),
    )
    rest = [c for c in nodes.columns if c not in (WS, "id")]
    best = nodes.groupBy(WS, "id").agg(F.min_by(F.struct(*rest), rank).alias("n"))
    return best.select(WS, "id", *[F.col(f"n.{c}").alias(c) for c in rest])


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per ordered pair by fixed precedence, independent of file order."""
    rank = F.array_position(F.array(*map(F.lit, rules.EDGE_PRECEDENCE)), F.col("type"))
    return edges.groupBy(WS, "source", "target").agg(F.min_by("type", rank).alias("type"))


def build_graph(
    modules: DataFrame, imports: DataFrame, symbols: DataFrame, calls: DataFrame, bases: DataFrame, level: int = 3
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, graph_meta) at an abstraction level clamped to 1..3."""
    level = max(1, min(int(level), 3))
    modules = modules.filter(ids.is_semantic_id("module_name"))
    resolved = cut_lineage(resolve.resolve_imports(imports, modules))
    nodes = module_nodes(modules).unionByName(import_stubs(resolved, modules))
    edges = import_edges(resolved)
    if level >= 2:
        classes = symbols.filter("kind = 'class'")
        resolved_bases = resolve.resolve_bases(bases, classes, resolve.import_scope(resolved))
        nodes = nodes.unionByName(symbol_nodes(symbols, level)).unionByName(base_stubs(resolved_bases, classes, modules))
        edges = edges.unionByName(contains_edges(symbols, level)).unionByName(inherit_edges(resolved_bases))
    if level >= 3:
        resolved_calls = resolve.resolve_calls(calls, symbols, modules, level)
        nodes = nodes.unionByName(call_stubs(resolved_calls, symbols))
        edges = edges.unionByName(call_edges(resolved_calls))
    meta = modules.select(WS).distinct().select(
        WS, F.lit(rules.BUILDER_VERSION).alias("builder_version"), F.lit(level).alias("graph_level")
    )
    return merge_nodes(nodes), merge_edges(edges), meta
