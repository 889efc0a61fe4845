"""The cache is opened only where a filter lets a key pass."""

from pyspark.sql import functions as F

from terrane.functions import text
from terrane.operators import result_cache as rc

REQUEST = "n long, task string, path string, content string, extra string, force_refresh boolean"


def requests(spark, ids, changed=(), forced=()):
    return spark.createDataFrame([(i, "explain", f"p{i}", "new" if i in changed else f"text {i}", "", i in forced) for i in ids], REQUEST)


def keyed(spark, ids):
    return requests(spark, ids).select(text.cache_key("task", "path", "content", "extra").alias("key"), (F.col("n") * 10).alias("result"))


def asked(spark, store, *args, **kwargs):
    snapshot = store.snapshot()
    hits, misses = rc.cached_results(requests(spark, *args, **kwargs), snapshot)
    got = {r.n: r.result for r in hits.collect()}, {r.n for r in misses.collect()}
    return got, {b for t, b in snapshot.reads if t == rc.RESULTS}


def test_reads_are_bounded_by_hits(spark, tmp_path):
    store = rc.create_cache(spark, str(tmp_path / "c"), keyed(spark, range(500)).unionByName(keyed(spark, range(5))), 64, 128)
    (hits, misses), read = asked(spark, store, [3, 400, *range(1000, 1060)])
    assert hits == {3: 30, 400: 4000} and misses == set(range(1000, 1060)) and len(read) <= 8
    (hits, misses), read = asked(spark, store, range(2000, 2030))
    assert hits == {} and len(misses) == 30 and len(read) <= 6
    (hits, misses), _ = asked(spark, store, [1, 2, 3], changed=[2], forced=[3])
    assert hits == {1: 10} and misses == {2, 3}


def test_every_key_is_found_and_goes(spark, tmp_path):
    store = rc.create_cache(spark, str(tmp_path / "c"), keyed(spark, range(60)), 8, 16)
    (hits, misses), _ = asked(spark, store, range(70))
    assert hits == {i: 10 * i for i in range(60)} and misses == set(range(60, 70))
    store.transact(lambda c: rc.put_results(c, keyed(spark, range(55, 65)).withColumn("result", F.lit(-1).cast("long"))))
    store.transact(lambda c: rc.invalidate(c, keyed(spark, [0, 1, 999])))
    (hits, misses), _ = asked(spark, store, range(70))
    assert hits == {i: -1 if i >= 55 else 10 * i for i in range(2, 65)} and misses == {0, 1, *range(65, 70)}
    store.transact(lambda c: rc.invalidate(c, keyed(spark, range(70))))
    (hits, misses), read = asked(spark, store, range(70))
    assert hits == {} and len(misses) == 70 and not read  # no bit is left in any filter


def test_empty_cache(spark, tmp_path):
    store = rc.create_cache(spark, str(tmp_path / "c"), keyed(spark, [0]).limit(0), 4, 8)
    assert asked(spark, store, range(3))[0] == ({}, {0, 1, 2})
