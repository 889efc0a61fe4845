"""Streams give the answers of the batch operators, whatever order files arrive in."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from terrane.operators import learning
from terrane.plans import pipelines
from terrane.streaming import learners
from terrane.streaming.sync import sync_batch, sync_stream

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def drop_files(spark, rows, schema, folder, parts):
    """Write rows as several files in the given order, one per micro-batch."""
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("totals", [learners.stream_topic_totals, learners.stream_topics])
def test_profiles_match_batch(spark, tmp_path, totals):
    rng = random.Random(2)
    rows = [(i, rng.randrange(4), at(rng.randrange(5000)), rng.choice(["api", "ui"]), rng.choice([None, "understood", "confused", "mastered"])) for i in range(120)]
    schema = "event_id long, user_id long, ts timestamp_ntz, topic string, outcome string"
    stream = drop_files(spark, rows, schema, tmp_path / "in", 4)
    out = str(tmp_path / "rows")
    run = (
        totals(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        .foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/part{n}")).start()
    )
    run.awaitTermination()
    last = spark.read.parquet(f"{out}/*").groupBy("user_id", "topic").agg(F.max_by(F.struct("n", "last", "judged", "decision"), "batch").alias("t"))
    got = learning.profiles(last.select("user_id", "topic", "t.*")).orderBy("user_id").collect()
    assert got == learning.profile_report(spark.createDataFrame(rows, schema)).orderBy("user_id").collect()


def test_untouched_topics_expire(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp_ntz, topic string, outcome string"

    def arrive(rows, ttl_hours, expected):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = []
        run = (
            learners.stream_topics(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ttl_hours).writeStream.outputMode("update")
            .option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: seen.extend(df.collect())).trigger(processingTime="1 second").start()
        )
        for _ in range(80):
            if len(seen) >= expected or run.exception():
                break
            time.sleep(0.5)
        run.stop()
        return sorted((r.user_id, r.topic, r.n, r.judged, r.decision) for r in seen)

    seconds = 3 / 3600
    first = [(1, 1, at(0), "api", "confused"), (2, 1, at(1), "api", None), (3, 2, at(2), "ui", None)]
    assert arrive(first, seconds, 2) == [(1, "api", 2, 1, "confused"), (2, "ui", 1, 0, None)]
    time.sleep(3.5)
    assert arrive([(4, 1, at(3), "api", None)], seconds, 1) == [(1, "api", 1, 0, None)]  # the old total is gone


def test_sessions_match_batch(spark, tmp_path):
    sessions = [(s, at(s * 10), f"topic{s}", "beginner") for s in range(8)]
    rng = random.Random(4)
    evals = [(100 + i, at(s * 10 + rng.choice([5, 60, 119, 120, 121, 300])), s if i % 6 else None) for i, s in enumerate(rng.choices(range(9), k=40))]
    rng.shuffle(evals)
    e_schema = "eval_id long, eval_ts timestamp, session_id long"
    s_schema = "session_id long, created_at timestamp, concept_focus string, difficulty string"
    tick = [(999, at(100_000), 555)]
    rows = evals + tick
    spark.createDataFrame(rows, e_schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    e = spark.readStream.schema(e_schema).parquet(str(tmp_path / "e"))
    s = drop_files(spark, sessions, s_schema, tmp_path / "s", 1)
    run = (
        learners.stream_sessions(s, e).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    evals_df = spark.createDataFrame(evals, e_schema)
    got = spark.read.parquet(str(tmp_path / "out")).unionByName(learners.sessionless(evals_df)).select("eval_id", "consumed", "focus").collect()
    none = F.lit(None).cast("string")
    batch = learning.join_evaluations(
        evals_df.withColumns({"user_id": F.lit(1), "question": F.lit(""), "concept_focus": none, "difficulty": none}), spark.createDataFrame(sessions, s_schema)
    ).select("eval_id", "consumed", F.when(F.col("consumed"), F.col("focus")).alias("focus")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and any(r["consumed"] for r in got)


def test_late_events_change_nothing(spark, tmp_path):
    (tmp_path / "e").mkdir()
    e_schema, s_schema = "eval_id long, eval_ts timestamp, session_id long", "session_id long, created_at timestamp, concept_focus string, difficulty string"
    batches = [[(1, at(20), 7)], [(2, at(10_000), 8)], [(3, at(5), 7)], [(4, at(20_000), 9)]]
    spark.createDataFrame([(7, at(0), "x", "beginner")], s_schema).write.parquet(str(tmp_path / "s"))
    for rows in batches:
        spark.createDataFrame(rows, e_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        s, e = spark.readStream.schema(s_schema).parquet(str(tmp_path / "s")), spark.readStream.schema(e_schema).parquet(str(tmp_path / "e"))
        run = (
            learners.stream_sessions(s, e).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    got = {r["eval_id"]: r["consumed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.get(1) is True and 3 not in got


def test_sync_equals_rebuild(spark, tmp_path):
    first = [("w", "a.py", "import b\ndef f():\n    g()\n"), ("w", "b.py", "class C:\n    pass\n"), ("w", "web/x.ts", "import y from './y';\n"), ("v", "a.py", "x = 1\n")]
    second = [("w", "a.py", "import b\ndef f2():\n    pass\n"), ("w", "b.py", "class C:\n    pass\n"), ("w", "web/x.ts", "import y from './y';\n"), ("w", "web/y.ts", "const y = 1;\n")]
    schema = "workspace_id string, path string, content string"

    def plain(store, *tables):
        return {t: sorted(map(str, store[t].select(sorted(store[t].columns)).collect())) for t in tables}

    everything = ("modules", "imports", "symbols", "chunks", "vectors", "nodes", "edges")
    want = plain(pipelines.rebuild(spark.createDataFrame(second, schema)), *everything)
    store, report = pipelines.sync(spark.createDataFrame(second, schema), pipelines.rebuild(spark.createDataFrame(first, schema)))
    assert plain(store, *everything) == want
    assert ("w", "web.x", "web.y", "imports") in {tuple(r) for r in store["edges"].select("workspace_id", "source", "target", "type").collect()}
    counts = {(r["workspace_id"], r["path"]): (r["chunks_updated"], r["chunks_added"], r["chunks_removed"]) for r in report.collect()}
    assert counts == {("w", "a.py"): (1, 0, 0), ("w", "web/y.ts"): (0, 1, 0), ("v", "a.py"): (0, 0, 1)}

    events = [(*r, 1, False) for r in first] + [(*second[0], 2, False), ("w", "a.py", "stale", 0, False)]
    later = [(*second[3], 3, False), ("v", "a.py", None, 3, True)]
    e_schema = schema + ", version long, deleted boolean"
    for rows in (events, later):
        spark.createDataFrame(rows, e_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(e_schema).parquet(str(tmp_path / "in"))
        sync_stream(stream, str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    version = pipelines.latest_version(spark, str(tmp_path / "store"))
    got = pipelines.read_store(spark, str(tmp_path / "store"), version)
    assert version == 1 and plain(got, *everything) == want


def test_a_batch_builds_its_graph_once(spark, tmp_path, monkeypatch):
    calls, build = [], pipelines._graph
    monkeypatch.setattr(pipelines, "_graph", lambda *a: calls.append(1) or build(*a))
    events = spark.createDataFrame([("w", "a.py", 1, "import b\n", False), ("w", "b.py", 1, "x = 1\n", False)], "workspace_id string, path string, version long, content string, deleted boolean")
    sync_batch(events, str(tmp_path / "s"), 0)
    assert len(calls) == 1
    store = pipelines.read_store(spark, str(tmp_path / "s"), 0)
    assert set(store) == set(pipelines.TABLES) and [(r.source, r.target) for r in store["edges"].collect()] == [("a", "b")] and store["nodes"].count() == 2
