"""A result cache that is read only where it may answer.

The cache is a bucketed table by key.  Every bucket has a filter: words of
64 bits, in one of which each key of the bucket sets four.  A request whose
bits are not all set has no result, so it never meets the cache; the others
open the buckets their keys fall into.  A bucket that is rewritten gets its
filter anew, so invalidated keys leave it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import written
from ..sources.bucketed import BUCKETS, Change, Snapshot, Store, bucket_of

#: Words of a filter; about six keys a word keep false answers below one in fifty.
WORDS = 1024
KEY, RESULTS, FILTERS = "key", "results", "filters"


def _word(words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("word"), KEY), F.lit(words)).cast("int")


def _bits() -> Column:
    """Four bits of a word, from one hash of the key."""
    h = F.xxhash64(F.lit("bits"), KEY)
    out = F.lit(0).cast("long")
    for i in range(4):
        at = F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return out


def _filters(results: DataFrame, buckets: Sequence[int], total: int, words: int) -> DataFrame:
    """(bucket, words array) of the given buckets; a bucket without keys has words of zeros."""
    spark = results.sparkSession
    empty = spark.createDataFrame([(int(b),) for b in buckets], "bucket int").select("bucket", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("word"), F.lit(0).cast("long").alias("bits"))
    set_ = results.select(bucket_of([KEY], total).alias("bucket"), _word(words).alias("word"), _bits().alias("bits"))
    merged = set_.unionByName(empty).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    # a word each, so an array of a fixed length
    return merged.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))


def create_cache(spark: SparkSession, root: str, results: DataFrame, buckets: int = BUCKETS, words: int = WORDS) -> Store:
    """A cache of ``results`` (key, …); of a key that comes twice one result is kept."""
    store = Store(spark, root, buckets)
    one = written(results.dropDuplicates([KEY]), "results")
    store.create({RESULTS: (one, [KEY]), FILTERS: (_filters(one, range(store.buckets), store.buckets, words), ["bucket"])})
    return store


def _width(cache: Snapshot) -> int:
    """Words of a filter, the same in every bucket."""
    return cache.table(FILTERS).select(F.size("words")).first()[0]


def _refilter(change: Change, touched: Sequence[int]) -> None:
    if touched:
        words = _width(change.base)
        change.upsert(FILTERS, written(_filters(change.current(RESULTS, touched), touched, change.store.buckets, words), "filters"))


def put_results(change: Change, results: DataFrame) -> None:
    """Add results, or replace those of their keys."""
    one = written(results.dropDuplicates([KEY]), "results")
    touched = change.base.touched(RESULTS, one)
    change.merge(RESULTS, one, one, buckets=touched)
    _refilter(change, touched)


def invalidate(change: Change, keys: DataFrame) -> None:
    """Drop the results of ``keys``."""
    gone = written(keys.select(KEY).distinct(), "gone")
    touched = change.base.touched(RESULTS, gone)
    change.merge(RESULTS, gone, change.base.table(RESULTS, []), buckets=touched)
    _refilter(change, touched)


def cached_results(requests: DataFrame, cache: Snapshot) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): requests by cache key; ``force_refresh`` never hits, changed content changes the key.

    ``requests`` has task, path, content, extra and force_refresh.  Misses
    carry nothing into a join with the cache but those a filter mistakes.
    """
    keyed = requests.withColumn(KEY, text.cache_key("task", "path", "content", "extra"))
    askable = keyed.filter("NOT force_refresh")
    total = cache.store.buckets
    filters = cache.table(FILTERS)
    asked = written(askable.select(KEY).distinct(), "asked")
    probed = asked.select(KEY, bucket_of([KEY], total).alias("bucket"), _word(_width(cache)).alias("_word"), _bits().alias("_bits"))
    maybe = probed.join(filters, "bucket").filter(F.get("words", F.col("_word")).bitwiseAND(F.col("_bits")) == F.col("_bits")).select(KEY)
    maybe = written(maybe, "maybe")
    found = cache.table(RESULTS, cache.touched(RESULTS, maybe)).join(maybe, KEY, "left_semi")
    hits = askable.join(found, KEY)
    misses = askable.join(found.select(KEY), KEY, "left_anti").unionByName(keyed.filter("force_refresh"))
    return hits, misses
