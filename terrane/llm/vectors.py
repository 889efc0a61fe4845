"""Vectors in double precision, and classes of equal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(embedding: str = "v"):
    """Neither null nor zero, without null or non-finite components."""
    ok = f"{embedding} IS NOT NULL AND size({embedding}) > 0 AND forall({embedding}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({embedding}, x -> x <> 0)"
    return F.expr(f"coalesce({ok}, false)")


def as_doubles(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of ``rows`` (vec_id, embedding, ...)."""
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """(rep, v, copies, least): equal valid vectors fall together; ``least`` holds their ``ids`` smallest ids.

    Only those can be among the ``ids - 1`` nearest of anything, so that
    many copies cost no more than a few.  Copies combine before the shuffle.
    """
    good = as_doubles(rows).filter(valid() & F.col("vec_id").isNotNull())
    # Minus zero equals zero.
    clean = good.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    if ids == 1:
        return clean.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", "v", "copies", F.array("rep").alias("least"))
    # A few ids for each of many salts, then of all: no copy group meets in one place.
    some = clean.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("s")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, ids).alias("l"), F.count("*").alias("c"))
    all_ = some.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, ids).alias("least"), F.sum("c").alias("copies"))
    return all_.select(F.element_at("least", 1).alias("rep"), "v", "copies", "least")
