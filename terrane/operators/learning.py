"""Learner analytics over event tables.

A learner may own a large share of all events, so nothing here sorts a
learner's whole history in one task: thresholds come from bounded top-n
windows, running positions from sliced windows, states from combining
aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.ids import as_col
from ..session import HOT_ROWS, running_row_number, sliced


def infer_topic(c: Column | str) -> Column:
    """First listed topic that occurs anywhere in the text, else ``general``."""
    low = F.lower(as_col(c))
    found = F.when(low.contains(rules.TOPICS[0]), rules.TOPICS[0])
    for t in rules.TOPICS[1:]:
        found = found.when(low.contains(t), t)
    return found.otherwise("general")


def level_for(prior: Column) -> Column:
    """Proficiency after ``prior`` interactions."""
    return (
        F.when(prior > rules.ADVANCED_ABOVE, "advanced").when(prior > rules.INTERMEDIATE_ABOVE, "intermediate").otherwise("beginner")
    )


def proficiency(interactions: DataFrame, order: tuple[str, str] = ("ts", "event_id")) -> DataFrame:
    """Adds the proficiency each interaction was met with, from the interactions before it.

    Only two moments per user matter, the events that fill each threshold.
    A bounded top-n finds them and every event is compared with them.  Events
    without a user count together, as those of one nameless user.
    """
    key = F.struct(*order)
    last = rules.ADVANCED_ABOVE + 1
    first = Window.partitionBy("user_id").orderBy(*order)
    early = interactions.select("user_id", *order).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= last)
    marks = early.groupBy("user_id").agg(
        F.max(F.when(F.col("_n") == rules.INTERMEDIATE_ABOVE + 1, key)).alias("_mid"), F.max(F.when(F.col("_n") == last, key)).alias("_high")
    )
    level = F.when(key > F.col("_high"), "advanced").when(key > F.col("_mid"), "intermediate").otherwise("beginner")
    named = marks.withColumnRenamed("user_id", "_user")
    joined = interactions.join(named, F.col("user_id").eqNullSafe(F.col("_user")), "left")
    return joined.withColumn("proficiency", level).drop("_user", "_mid", "_high")


def topic_attempts(interactions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the running attempt number per (user, topic), the current one included."""
    return running_row_number(interactions, ["user_id", "topic"], ["ts", "event_id"], "attempts", hot_rows)


def attempt_map(interactions: DataFrame) -> DataFrame:
    """(user_id, attempts map): final count per topic."""
    per = interactions.groupBy("user_id", "topic").agg(F.count("*").cast("int").alias("n"))
    return per.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "n")))).alias("topic_attempts"))


def topic_state(interactions: DataFrame) -> DataFrame:
    """(user_id, topic, state): weak or strong after all outcomes.

    The last of confused and mastered decides; with neither, any understood
    makes the topic strong.
    """
    key = F.struct("ts", "event_id")
    decisive = F.col("outcome").isin("confused", "mastered")
    agg = interactions.filter("outcome IS NOT NULL").groupBy("user_id", "topic").agg(
        F.max_by(F.when(decisive, F.col("outcome")), F.when(decisive, key)).alias("_last"),
    )
    return agg.select("user_id", "topic", F.when(F.col("_last") == "confused", "weak").otherwise("strong").alias("state"))


def topic_state_before(interactions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the state of the event's topic just before it (NULL for none yet).

    Each slice is scanned on its own; its last decision and whether anything
    was understood in it are carried to the slices after it.
    """
    keys, order = ["user_id", "topic"], ["ts", "event_id"]
    parts = sliced(interactions, keys, "ts", hot_rows, max(1, hot_rows // 4))
    decisive = F.when(F.col("outcome").isin("confused", "mastered"), F.col("outcome"))
    understood = F.coalesce(F.col("outcome") == "understood", F.lit(False))

    def state(decided: Column, known: Column) -> Column:
        known = F.coalesce(known, F.lit(False))
        return F.when(decided == "confused", "weak").when(decided == "mastered", "strong").when(known, "strong")

    if parts is None:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return interactions.withColumn("state", state(F.last(decisive, ignorenulls=True).over(whole), F.max(understood).over(whole)))
    per_slice = parts.groupBy(*keys, "_slice").agg(
        F.max_by(decisive, F.when(decisive.isNotNull(), F.struct(*order))).alias("_d"), F.bool_or(understood).alias("_u")
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(*keys, "_slice", F.last("_d", ignorenulls=True).over(earlier).alias("_cd"), F.max("_u").over(earlier).alias("_cu"))
    before = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumns({"_ld": F.last(decisive, ignorenulls=True).over(before), "_lu": F.max(understood).over(before)})
    joined = local.join(carried, [*keys, "_slice"], "left")
    known = F.coalesce("_lu", F.lit(False)) | F.coalesce("_cu", F.lit(False))
    return joined.select(*interactions.columns, state(F.coalesce("_ld", "_cd"), known).alias("state"))


def guidance(rows: DataFrame) -> DataFrame:
    """Guidance level and weak/strong flags from ``proficiency`` and the topic ``state`` at the time."""
    level = F.when(F.col("proficiency") == "beginner", "questions").when(F.col("proficiency") == "advanced", "explanation").otherwise("hints")
    return rows.withColumns({
        "guidance_level": level, "is_weak_area": F.coalesce(F.col("state") == "weak", F.lit(False)),
        "is_strong_area": F.coalesce(F.col("state") == "strong", F.lit(False)),
    })


def escalate(level: Column | str, attempts: Column | str) -> Column:
    """More direct help after the second attempt at a topic."""
    level, again = as_col(level), as_col(attempts) > 2
    return F.when(again & (level == "questions"), "hints").when(again & (level == "hints"), "explanation").otherwise(level)


def live_sessions(sessions: DataFrame, now: Column, hours: int = rules.SESSION_HOURS) -> DataFrame:
    """Sessions no older than the limit at ``now``; exactly the limit is still live."""
    return sessions.filter(now - F.col("created_at") <= F.expr(f"INTERVAL '{hours}' HOUR"))


def join_evaluations(evals: DataFrame, sessions: DataFrame, hours: int = rules.SESSION_HOURS) -> DataFrame:
    """Evaluations with focus and level, taken from the session they consume if it is live.

    Only the first evaluation of a session consumes it.  Explicit fields
    win, then the session's, then the topic of the question, then defaults.
    ``evals``: eval_id, user_id, eval_ts, session_id, question, concept_focus,
    difficulty.  ``sessions``: session_id, created_at, concept_focus, difficulty.
    """
    first = (
        evals.filter("session_id IS NOT NULL").groupBy("session_id")
        .agg(F.min(F.struct("eval_ts", "eval_id")).alias("f")).select("session_id", "f.eval_ts", "f.eval_id")
    )
    live = (
        first.join(sessions, "session_id")
        .filter((F.col("eval_ts") >= F.col("created_at")) & (F.col("eval_ts") - F.col("created_at") <= F.expr(f"INTERVAL '{hours}' HOUR")))
        .select("eval_id", F.col("concept_focus").alias("_focus"), F.col("difficulty").alias("_level"), F.lit(True).alias("consumed"))
    )

    def filled(c: str) -> Column:
        return F.when(F.length(F.trim(c)) > 0, F.col(c))

    focus = F.trim(F.coalesce(filled("concept_focus"), filled("_focus"), infer_topic("question")))
    level = F.lower(F.trim(F.coalesce(filled("difficulty"), filled("_level"), F.lit("beginner"))))
    return evals.join(live, "eval_id", "left").withColumns({
        "focus": focus, "level": F.when(level.isin(rules.LEVELS), level).otherwise("beginner"), "consumed": F.coalesce("consumed", F.lit(False)),
    }).drop("_focus", "_level")


def normal_score(c: Column | str) -> Column:
    """Score as a number in 0..1; unreadable becomes 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(as_col(c).try_cast("double"), F.lit(0.0))))


def outcome(is_correct: Column | str, score: Column | str) -> Column:
    s = as_col(score)
    good = F.coalesce(as_col(is_correct), F.lit(False)) | (s >= rules.UNDERSTOOD_FROM)
    return F.when(good, "understood").when(s <= rules.CONFUSED_TO, "confused")


def topic_totals(interactions: DataFrame) -> DataFrame:
    """(user_id, topic) totals a profile is made of; the same aggregate serves batch and stream."""
    decisive = F.col("outcome").isin("confused", "mastered")
    return interactions.groupBy("user_id", "topic").agg(
        F.count("*").alias("n"), F.max("ts").alias("last"), F.count("outcome").alias("judged"),
        F.max_by(F.when(decisive, F.col("outcome")), F.when(decisive, F.struct("ts", "event_id"))).alias("decision"),
    )


def profiles(totals: DataFrame) -> DataFrame:
    """One row per user from topic totals; a user's row gathers one entry per topic."""
    named = totals.withColumn("state", F.when(F.col("decision") == "confused", "weak").when(F.col("judged") > 0, "strong"))

    def topics(which: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("state") == which, F.col("topic"))))

    total = F.sum("n")
    return named.groupBy("user_id").agg(
        level_for(total).alias("proficiency"), total.alias("interaction_count"), F.max("last").alias("last_active"),
        topics("weak").alias("weak_areas"), topics("strong").alias("strong_areas"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", F.col("n").cast("int"))))).alias("topic_attempts"),
    )


def profile_report(interactions: DataFrame) -> DataFrame:
    """One row per user: level, counts, last activity, weak and strong topics, attempts per topic."""
    return profiles(topic_totals(interactions))


def recent_interactions(interactions: DataFrame, n: int = 5) -> DataFrame:
    """Last ``n`` interactions per user, numbered from the oldest of them."""
    back = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    kept = interactions.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= n)
    forth = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return kept.withColumn("position", F.row_number().over(forth)).drop("_back")


def drop_users(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("user_id").distinct(), "user_id", "left_anti")


def interaction_log(teach: DataFrame, evals: DataFrame) -> DataFrame:
    """Teach and evaluate events in one log with a type and a query text."""
    taught = teach.select("user_id", "ts", F.lit("teach").alias("type"), F.col("query"))
    judged = evals.select("user_id", F.col("eval_ts").alias("ts"), F.lit("evaluate").alias("type"), F.concat(F.lit("EVALUATE: "), "focus").alias("query"))
    return taught.unionByName(judged)
