"""Graph tables on disk: parquet by workspace, and node-link JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import NODE_COLUMNS

WS = "workspace_id"
NODE = ", ".join(f"`{c}` {'boolean' if c in ('is_external', 'declared') else 'string'}" for c in NODE_COLUMNS if c != WS)
LINK = "source string, target string, type string"


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """One parquet table per name, laid out by workspace so that reads prune to it."""
    for name, df in tables.items():
        df.hint("rebalance", WS).write.mode("overwrite").partitionBy(WS).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str, workspace_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/{name}").withColumn(WS, F.col(WS).cast("string"))
    return df if workspace_id is None else df.filter(F.col(WS) == workspace_id)


def graph_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workspace_id, record): one JSON object per node and per link.

    Lines rather than one document per workspace, so that no task ever has
    to hold a whole graph.
    """
    inner = [c for c in nodes.columns if c != WS]
    n = nodes.select(WS, F.to_json(F.struct(F.struct(*inner).alias("node"))).alias("record"))
    e = edges.select(WS, F.to_json(F.struct(F.struct("source", "target", "type").alias("link"))).alias("record"))
    return n.unionByName(e)


def parse_graph_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = records.select(WS, F.from_json("record", f"node struct<{_colons(NODE)}>, link struct<{_colons(LINK)}>").alias("r"))
    nodes = parsed.filter("r.node IS NOT NULL").select(WS, "r.node.*")
    edges = parsed.filter("r.link IS NOT NULL").select(WS, "r.link.*")
    return nodes, edges


def _colons(ddl: str) -> str:
    return ", ".join(":".join(part.rsplit(" ", 1)) for part in ddl.split(", "))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graph_records(nodes, edges).write.mode("overwrite").partitionBy(WS).text(path)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges written by ``write_graph_json``."""
    return parse_graph_records(spark.read.text(path).select(WS, F.col("value").alias("record")))


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, meta) of node-link documents ``{graph, nodes, links or edges}``, one per file; the file's folder names the workspace."""
    schema = f"graph struct<builder_version:int,graph_level:int>, nodes array<struct<{_colons(NODE)}>>, links array<struct<{_colons(LINK)}>>, edges array<struct<{_colons(LINK)}>>"
    docs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    docs = docs.withColumn(WS, F.element_at(F.split(F.input_file_name(), "/"), -2))
    nodes = docs.select(WS, F.inline("nodes"))
    edges = docs.select(WS, F.inline(F.coalesce("links", "edges")))
    return nodes, edges, docs.select(WS, "graph.builder_version", "graph.graph_level")
