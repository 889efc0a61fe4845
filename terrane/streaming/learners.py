"""Learner profiles and session matching as streams over keyed state with timers and expiry."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import rules
from ..operators import learning

# Keyed state with timers lives in this store.
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISIVE = ("confused", "mastered")


def _keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def stream_topic_totals(interactions: DataFrame) -> DataFrame:
    """Running totals per (user, topic), for update-mode sinks keyed by both.

    A built-in streaming aggregate: state is one row per (user, topic),
    events combine before the shuffle, and ``learning.profiles`` turns the
    sink's table into profiles.  Its state never expires.
    """
    return learning.topic_totals(interactions)


_PART = ["user_id", "topic", "n", "last_us", "judged", "decision", "at_us", "at_id"]
_NOTHING = -(2**63)


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals per (user, topic) of rows that are totals already: counts add up, the latest decision stays."""
    ordered = pdf.sort_values(["at_us", "at_id"], kind="stable")
    return ordered.groupby(["user_id", "topic"], as_index=False, dropna=False, sort=False).agg(
        n=("n", "sum"), last_us=("last_us", "max"), judged=("judged", "sum"), decision=("decision", "last"), at_us=("at_us", "max"), at_id=("at_id", "last")
    )


class TopicTotals(StatefulProcessor):
    """A user's topics as map state; a topic that nothing touches for the time to live is forgotten."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.topics = handle.getMapState("topics", "topic string", "n bigint, last_us bigint, judged bigint, decision string, at_us bigint, at_id bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = _combine(pd.concat(list(rows), ignore_index=True)[_PART])
        out = []
        for r in fresh.itertuples(index=False):
            n, last, judged, decision, at, at_id = (r.n, r.last_us, r.judged, r.decision, r.at_us, r.at_id)
            if self.topics.containsKey((r.topic,)):
                old = self.topics.getValue((r.topic,))
                n, last, judged = n + old[0], max(last, old[1]), judged + old[2]
                if (old[4], old[5]) > (at, at_id):
                    decision, at, at_id = old[3], old[4], old[5]
            decision = None if pd.isna(decision) else decision
            self.topics.updateValue((r.topic,), (int(n), int(last), int(judged), decision, int(at), int(at_id)))
            out.append((key[0], r.topic, int(n), int(last), int(judged), decision))
        yield pd.DataFrame(out, columns=["user_id", "topic", "n", "last_us", "judged", "decision"])

    def close(self) -> None:
        pass


def stream_topics(interactions: DataFrame, ttl_hours: float | None = None) -> DataFrame:
    """Totals like ``stream_topic_totals`` from map state that expires: a topic untouched for ``ttl_hours`` starts anew.

    Events combine per task before they are shuffled, so a user with very
    many events sends one row a task and topic.  For update-mode sinks.  With
    a time to live the query looks at the clock in every batch, so it runs
    until it is stopped; an ``availableNow`` trigger never ends it.
    """
    spark = interactions.sparkSession
    _keyed_state(spark)
    kind = dict(interactions.dtypes)["user_id"]
    decisive = F.col("outcome").isin(*DECISIVE)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    single = interactions.select(
        "user_id", "topic", F.lit(1).cast("bigint").alias("n"), us.alias("last_us"), F.col("outcome").isNotNull().cast("bigint").alias("judged"),
        F.when(decisive, F.col("outcome")).alias("decision"), F.when(decisive, us).otherwise(F.lit(_NOTHING)).alias("at_us"),
        F.when(decisive, F.col("event_id").cast("bigint")).otherwise(F.lit(_NOTHING)).alias("at_id"),
    )

    def per_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield _combine(pdf)[_PART]

    parts = single.mapInPandas(per_task, single.schema)
    ttl = None if ttl_hours is None else int(ttl_hours * 3_600_000)
    totals = parts.groupBy("user_id").transformWithStateInPandas(
        TopicTotals(ttl), f"user_id {kind}, topic string, n bigint, last_us bigint, judged bigint, decision string", "Update", "None" if ttl is None else "ProcessingTime"
    )
    last = F.timestamp_micros("last_us").cast(dict(interactions.dtypes)["ts"])
    return totals.select("user_id", "topic", "n", last.alias("last"), "judged", "decision")


# moments cross into Python as microseconds, free of any session time zone
_OUT = "eval_id bigint, session_id bigint, eval_us bigint, consumed boolean, focus string, difficulty string"
_COLUMNS = ["eval_id", "session_id", "eval_us", "consumed", "focus", "difficulty"]
_IN = ["session_id", "unnamed", "is_session", "us", "eval_id", "concept_focus", "difficulty"]


#: Keys of the state: the sessions that share one are read and written together.
BUCKETS = 1024
_OPEN = pa.schema([
    ("session_id", pa.int64()), ("created_us", pa.int64()), ("focus", pa.string()), ("difficulty", pa.string()), ("eval_us", pa.int64()), ("eval_id", pa.int64()), ("due_ms", pa.int64()),
])


@dataclass(slots=True)
class Open:
    """A session that is not settled: what is known of it, its earliest evaluation so far, and when it is due."""

    created_us: int | None = None
    focus: str | None = None
    difficulty: str | None = None
    eval_us: int | None = None
    eval_id: int | None = None
    due_ms: int = 0


def _known(v):
    return None if v is None or v != v else v


class Sessions(StatefulProcessor):
    """The open sessions of a bucket and their earliest evaluations; a timer settles those nothing earlier can reach any more.

    A bucket's sessions are one value of state, so that a batch costs a few
    calls to the store a bucket rather than a dozen a session.
    """

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("open", "rows binary")

    def _load(self) -> dict[int | None, Open]:
        if not self.held.exists():
            return {}
        table = pa.ipc.open_stream(bytes(self.held.get()[0])).read_all()
        return {key: Open(*rest) for key, *rest in zip(*(c.to_pylist() for c in table.columns))}

    def _keep(self, sessions: dict[int | None, Open], watermark_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not sessions:
            self.held.clear()
            return
        rows = zip(*((k, s.created_us, s.focus, s.difficulty, s.eval_us, s.eval_id, s.due_ms) for k, s in sessions.items()))
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(rows, _OPEN.types)], schema=_OPEN)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _OPEN) as out:
            out.write_batch(batch)
        self.held.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(max(min(s.due_ms for s in sessions.values()), watermark_ms + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sessions, watermark = self._load(), timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            lost = []
            for session_id, unnamed, is_session, us, eval_id, focus, difficulty in zip(*(pdf[c] for c in _IN)):
                name, us = None if unnamed else int(session_id), _known(us)
                s = sessions.setdefault(name, Open())
                if is_session:
                    s.created_us, s.focus, s.difficulty = None if us is None else int(us), _known(focus), _known(difficulty)
                elif us is None:
                    # without a moment it is never the earliest
                    lost.append((_known(eval_id), name, None, False, None, None))
                elif s.eval_us is None:
                    s.eval_us, s.eval_id = int(us), int(eval_id)
                else:
                    first, other = sorted(((s.eval_us, s.eval_id), (int(us), int(eval_id))))
                    s.eval_us, s.eval_id = first
                    lost.append((other[1], name, other[0], False, None, None))
                last = max((x for x in (None if s.created_us is None else s.created_us + self.limit_us, s.eval_us) if x is not None), default=0)
                s.due_ms = max(last // 1000 + 1, watermark + 1)
            yield _answers(lost)
        self._keep(sessions, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions, watermark = self._load(), timerValues.getCurrentWatermarkInMs()
        rows, later = [], {}
        for name, s in sessions.items():
            if s.due_ms > watermark:
                later[name] = s
            elif s.eval_us is not None:
                used = s.created_us is not None and 0 <= s.eval_us - s.created_us <= self.limit_us
                rows.append((s.eval_id, name, s.eval_us, used, s.focus if used else None, s.difficulty if used else None))
        self._keep(later, watermark)
        yield _answers(rows)

    def close(self) -> None:
        pass


def _answers(rows: list[tuple]) -> pd.DataFrame:
    """Rows as objects: a missing id or moment must not turn the others into floats."""
    return pd.DataFrame(rows, columns=_COLUMNS, dtype=object)


def stream_sessions(sessions: DataFrame, evals: DataFrame, lateness: str = "10 minutes", hours: int = rules.SESSION_HOURS) -> DataFrame:
    """Evaluations with the live session they consume, once the watermark has settled it.

    ``sessions``: session_id, created_at, concept_focus, difficulty.
    ``evals``: eval_id, eval_ts, session_id.  The earliest evaluation within
    the limit consumes the session, whatever order events arrive in.  State
    per session is the session and its earliest evaluation so far; an
    evaluation that loses its place is emitted at once, so a session with
    countless evaluations still holds one; event-time timers end it.  Sessions
    are dealt to ``BUCKETS`` keys, whose state is read and written at once.
    Evaluations without a session bypass the state.
    """
    _keyed_state(sessions.sparkSession)
    nothing = F.lit(None)
    opened = sessions.select(
        F.col("session_id").cast("bigint").alias("session_id"), F.lit(True).alias("is_session"), F.col("created_at").cast("timestamp").alias("ts"),
        nothing.cast("bigint").alias("eval_id"), "concept_focus", "difficulty",
    )
    judged = evals.filter("session_id IS NOT NULL").select(
        F.col("session_id").cast("bigint").alias("session_id"), F.lit(False).alias("is_session"), F.col("eval_ts").cast("timestamp").alias("ts"),
        F.col("eval_id").cast("bigint").alias("eval_id"), nothing.cast("string").alias("concept_focus"), nothing.cast("string").alias("difficulty"),
    )
    matched = (
        opened.unionByName(judged).withColumns({
            "us": F.unix_micros("ts"), "unnamed": F.col("session_id").isNull(), "session_id": F.coalesce("session_id", F.lit(0).cast("bigint")),
            "bucket": F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)),
        }).withWatermark("ts", lateness).groupBy("bucket")
        .transformWithStateInPandas(Sessions(hours * 3_600_000_000), _OUT, "Append", "EventTime")
    )
    return matched.select("eval_id", "session_id", F.timestamp_micros("eval_us").alias("eval_ts"), "consumed", "focus", "difficulty")


def sessionless(evals: DataFrame) -> DataFrame:
    """Evaluations that name no session, in the shape of ``stream_sessions``; needs no state."""
    none = F.lit(None).cast("string")
    return evals.filter("session_id IS NULL").select(
        "eval_id", F.lit(None).cast("bigint").alias("session_id"), F.col("eval_ts").cast("timestamp").alias("eval_ts"), F.lit(False).alias("consumed"), none.alias("focus"), none.alias("difficulty")
    )
