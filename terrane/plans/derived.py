"""Turn the derived views into Spark DataFrames or DuckDB ``WITH`` chains."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_folder
from .views import SCALED, VIEWS

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _mentions(sql: str, names) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [n for n in names if n in words]


def _needed(sql: str, views: dict[str, str]) -> list[str]:
    """Views ``sql`` depends on, transitively, in definition order."""
    found: set[str] = set()
    todo = _mentions(sql, views)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += [n for n in _mentions(views[name], views) if n != name]
    return [n for n in views if n in found]


def oracle(body: str, rec: str = "", **extra: str) -> str:
    """One DuckDB statement: needed views as CTEs, ``extra`` CTEs, a recursive one, ``body``."""
    views = {**VIEWS, **extra}
    ctes = [f"{n} AS ({views[n].strip()})" for n in _needed(body + " " + rec, views)]
    if rec:
        ctes.append(rec)
    if not ctes:
        return body
    return f"WITH {'RECURSIVE ' if rec else ''}" + ",\n".join(ctes) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A text table spread over the cores when its file is too small to split; large inputs stay as they lie."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


#: Derived inputs that no query joins, written with a denser codec.
DENSE = ("fx_pairs",)
_written: dict[tuple[str, str, str], str] = {}


def _path(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> str:
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    if key not in _written:
        tag = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
        path = f"{checkpoint_folder(spark)}/terrane-views/{app}/{tag}/{name}"
        # join sides keep the usual codec: Spark picks broadcasts by file size, which a denser one would understate
        make().write.mode("overwrite").options(**({"compression": "zstd"} if name in DENSE else {})).parquet(path)
        _written[key] = path
    return _written[key]


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived input written once per application to the shared checkpoint folder.

    Views nest, and most queries read several of them; as parquet they keep
    column pruning and filter pushdown, and survive the loss of an executor.
    """
    return spark.read.parquet(_path(spark, sf_dir, name, make))


def _stored(spark: SparkSession, sf_dir: str, name: str) -> str:
    return _path(spark, sf_dir, name, lambda: query(spark, sf_dir, SCALED.get(name, VIEWS[name])))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(_stored(spark, sf_dir, name))


def query(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """Spark SQL over the driver tables and the derived views."""
    ctes = [f"{n} AS (SELECT * FROM parquet.`{sf_dir}/{n}.parquet`)" for n in _mentions(body, TABLES)]
    ctes += [f"{n} AS (SELECT * FROM parquet.`{_stored(spark, sf_dir, n)}`)" for n in _mentions(body, VIEWS)]
    return spark.sql("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else spark.sql(body)
