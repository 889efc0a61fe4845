"""Session-level helpers: lineage cuts, checked broadcasts, slices of hot keys.

Skewed joins are left to adaptive execution (``spark.sql.adaptive.skewJoin``).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key is "hot" beyond this many rows; its running totals are taken slice by slice.
HOT_ROWS = 2_000_000
# Jobs that are submitted side by side.
JOBS = 6


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only local runs may default."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrane-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written tables."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` without its history, settled once; survives executor loss."""
    return written(df, "cut")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the checkpoint folder: computed once, pruned by column, and of known size to later joins."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_once(work: dict[str, Callable]) -> dict:
    """Results of independent steps that each run Spark jobs; a few jobs share the cluster."""
    with ThreadPoolExecutor(JOBS) as pool:
        return dict(zip(work, pool.map(lambda step: step(), work.values())))


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after counting that ``df`` stays within ``max_rows``.

    Beyond the bound the frame is returned untouched and the join shuffles.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def sliced(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    hot_rows: int = HOT_ROWS,
    slice_rows: int = HOT_ROWS // 4,
) -> DataFrame | None:
    """Add ``_slice``: an ascending piece number along ``order`` inside each key; None if no key is hot.

    Cold keys form one slice.  A hot key is cut at approximate quantiles of
    its order column, so no later window ever sees more than about
    ``slice_rows`` rows of it; results stay exact because slices follow the
    order column and callers carry totals from slice to slice.
    """
    keys = list(keys)
    epoch = F.unix_micros(F.col(order).cast("timestamp")) if dict(df.dtypes)[order].startswith("timestamp") else F.col(order).cast("long")
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).persist(StorageLevel.MEMORY_AND_DISK)
    if hot.isEmpty():
        hot.unpersist()
        return None
    pieces = [i / 256 for i in range(1, 256)]
    largest = hot.agg(F.max("_n")).first()[0]
    if largest > 256 * slice_rows:
        n = int(largest // slice_rows) + 1
        pieces = [i / n for i in range(1, n)]
    cuts = (
        df.join(bounded_broadcast(hot.select(*keys), 200_000), keys, "left_semi")
        .withColumn("_o", epoch)
        .groupBy(*keys)
        .agg(F.percentile_approx("_o", pieces, 10000).alias("_cuts"))
    )
    cut = df.join(bounded_broadcast(cuts, 10_000), keys, "left")
    return cut.withColumn(
        "_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c < epoch)), F.lit(0))
    ).withColumn("_slice", F.greatest("_slice", F.lit(0))).drop("_cuts")


def running_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, hot_rows: int = HOT_ROWS,
    slice_rows: int | None = None,
) -> DataFrame:
    """1-based position of each row inside its key, exact for hot keys too."""
    keys = list(keys)
    parts = sliced(df, keys, order[0], hot_rows, slice_rows or max(1, hot_rows // 4))
    if parts is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    sizes = parts.groupBy(*keys, "_slice").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = parts.withColumn("_rn", F.row_number().over(within))
    cond = [numbered[k].eqNullSafe(offsets[k]) for k in keys + ["_slice"]]
    joined = numbered.join(offsets, cond, "left")
    return joined.select(*[numbered[c] for c in df.columns], (F.col("_rn") + F.col("_before")).cast("long").alias(out))
