"""Helpers the operators share: staged tables, training rows, label lookup, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder

#: White space of the contracts: a blank, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Labelled rows a classifier is fitted on, at most.
TRAINING_ROWS = 20_000
MAX_ROUNDS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Cuts the lineage, survives lost executors, and keeps column pruning.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/llm/{re.sub(r'[^A-Za-z0-9]', '_', name)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_hash(doc_id: str | Column) -> Column:
    """crc32 of the id as text; null ids hash as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no label may be learnt from."""
    return id_hash(doc_id) % 4 == 2


def training_labels(labels: DataFrame, label: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, y): at most ``rows`` labelled ids outside the held-out fold.

    An id labelled more than once takes the mean of its labels; null ids and
    null labels teach nothing.  The choice follows a hash of the id, so it is
    the same for every run.
    """
    seen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    )
    return seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id it can reach.

    Large-star and small-star steps in turn (Kiveris et al., 2014).  Each
    keeps one minimum per node through a combining aggregate, so the links of
    a hub are never gathered; every round ends in a written table.
    """
    links = staged(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    for _ in range(MAX_ROUNDS):
        if _is_star_forest(links):
            return links.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(
                links.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
            )
        ends = F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))
        sided = links.select(F.explode(ends).alias("e")).select("e.u", "e.v")
        least = sided.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sided.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = staged(large, "large_star")
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pulled = large.join(first, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = staged(pulled.unionByName(first.select("hi", F.col("m").alias("lo"))).distinct(), "small_star")
    raise RuntimeError("components did not settle")


def _is_star_forest(links: DataFrame) -> bool:
    """Every node hangs on one root, and no root hangs on another node."""
    sides = links.select(F.col("hi").alias("id"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(
        links.select(F.col("lo").alias("id"), F.lit(0).alias("above"), F.lit(1).alias("below"))
    )
    counted = sides.groupBy("id").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return counted.filter("above > 1 OR (above = 1 AND below = 1)").isEmpty()


def only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns; whatever else the caller's table holds stays out of the plan."""
    return df.select(*columns)
