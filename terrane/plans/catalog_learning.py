"""Queries over learner events, evaluations and model responses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import learning as ln
from ..operators import responses as rs
from ..operators import result_cache
from ..session import checkpoint_folder
from .derived import oracle, query, table, view
from .registry import register


def seen(spark, sf):
    return view(spark, sf, "fx_interactions")


TOPIC_CASE = "CASE " + " ".join(f"WHEN contains(lower(text), '{t}') THEN '{t}'" for t in ("auth", "api", "database", "ui", "validation", "error", "test", "cache")) + " ELSE 'general' END"
LEVEL = "CASE WHEN {n} > 50 THEN 'advanced' WHEN {n} > 20 THEN 'intermediate' ELSE 'beginner' END"


@register("infer_topics", f"SELECT conv_id, turn, {TOPIC_CASE} AS topic FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", ln.infer_topic("text").alias("topic"))


PRIOR = "SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, row_number() OVER (PARTITION BY user_id, topic ORDER BY ts, event_id) AS attempts FROM fx_interactions"


@register("proficiency", oracle(f"SELECT event_id, user_id, {LEVEL.format(n='prior')} AS proficiency FROM prior_", prior_=PRIOR))
def _(spark, sf):
    return ln.proficiency(seen(spark, sf)).select("event_id", "user_id", "proficiency")


@register("topic_attempts", oracle("SELECT event_id, user_id, topic, attempts FROM prior_", prior_=PRIOR))
def _(spark, sf):
    return ln.topic_attempts(seen(spark, sf)).select("event_id", "user_id", "topic", "attempts")


@register("attempt_maps", oracle("SELECT user_id, topic, CAST(count(*) AS INT) AS n FROM fx_interactions GROUP BY ALL"))
def _(spark, sf):
    return ln.attempt_map(seen(spark, sf)).select("user_id", F.explode("topic_attempts").alias("topic", "n"))


STATE = """SELECT *, CASE d WHEN 'confused' THEN 'weak' WHEN 'mastered' THEN 'strong' ELSE CASE WHEN u THEN 'strong' END END AS state FROM (
  SELECT *, last_value(CASE WHEN outcome IN ('confused', 'mastered') THEN outcome END IGNORE NULLS) OVER w AS d, coalesce(bool_or(outcome = 'understood') OVER w, false) AS u
  FROM prior_ WINDOW w AS (PARTITION BY user_id, topic ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s"""
GUIDED = f"""SELECT *, CASE proficiency WHEN 'beginner' THEN 'questions' WHEN 'advanced' THEN 'explanation' ELSE 'hints' END AS guidance_level FROM (SELECT *, {LEVEL.format(n='prior')} AS proficiency FROM state) g"""
GUIDE_CTES = {"prior_": PRIOR, "state": STATE, "guided": GUIDED}


@register("topic_state_before", oracle("SELECT event_id, user_id, topic, state FROM state", **GUIDE_CTES))
def _(spark, sf):
    return ln.topic_state_before(seen(spark, sf)).select("event_id", "user_id", "topic", "state")


def guided(spark, sf):
    return ln.guidance(ln.topic_state_before(ln.proficiency(seen(spark, sf))))


@register("guidance_levels", oracle("SELECT event_id, proficiency, guidance_level, coalesce(state = 'weak', false) AS is_weak_area, coalesce(state = 'strong', false) AS is_strong_area FROM guided", **GUIDE_CTES))
def _(spark, sf):
    return guided(spark, sf).select("event_id", "proficiency", "guidance_level", "is_weak_area", "is_strong_area")


@register("escalate", oracle("""
SELECT event_id, attempts, CASE WHEN attempts > 2 AND guidance_level = 'questions' THEN 'hints' WHEN attempts > 2 AND guidance_level = 'hints' THEN 'explanation' ELSE guidance_level END AS guidance_level FROM guided""", **GUIDE_CTES))
def _(spark, sf):
    rows = ln.topic_attempts(guided(spark, sf))
    return rows.select("event_id", "attempts", ln.escalate("guidance_level", "attempts").alias("guidance_level"))


SESSIONS = "SELECT event_id AS session_id, user_id, ts AS created_at, topic AS concept_focus, CASE k % 4 WHEN 0 THEN 'advanced' WHEN 1 THEN ' Intermediate ' WHEN 2 THEN 'expert' END AS difficulty FROM fx_interactions WHERE event_type = 'click'"


@register("live_sessions", oracle("SELECT session_id, user_id FROM s WHERE (SELECT max(ts) FROM fx_interactions) - created_at <= INTERVAL 2 HOUR", s=SESSIONS))
def _(spark, sf):
    now = seen(spark, sf).agg(F.max("ts")).first()[0]
    return ln.live_sessions(query(spark, sf, SESSIONS), F.lit(str(now)).cast("timestamp_ntz")).select("session_id", "user_id")


# half of the evaluations come soon after their question, so that some sessions are live
EVALS = """SELECT eval_id, s.user_id, CASE WHEN eval_id % 2 = 0 THEN i.ts + INTERVAL '30' MINUTE ELSE eval_ts END AS eval_ts, s.session_id,
  'how does the build cache work' AS question, CASE WHEN eval_id % 7 = 0 THEN 'api' END AS concept_focus, CASE WHEN eval_id % 11 = 0 THEN 'Advanced' END AS difficulty
FROM fx_sessions s LEFT JOIN fx_interactions i ON i.event_id = s.session_id"""
JOINED = """
SELECT eval_id, user_id, eval_ts, session_id, consumed, coalesce(concept_focus, CASE WHEN consumed THEN sf END, 'ui') AS focus,
  CASE WHEN lvl IN ('beginner', 'intermediate', 'advanced') THEN lvl ELSE 'beginner' END AS level FROM (
  SELECT e.*, s.concept_focus AS sf, coalesce(s.session_id IS NOT NULL AND e.rn = 1 AND e.eval_ts >= s.created_at AND e.eval_ts - s.created_at <= INTERVAL 2 HOUR, false) AS consumed,
    lower(trim(coalesce(e.difficulty, CASE WHEN e.rn = 1 AND e.eval_ts >= s.created_at AND e.eval_ts - s.created_at <= INTERVAL 2 HOUR THEN s.difficulty END, 'beginner'))) AS lvl
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY eval_ts, eval_id) AS rn FROM e) e LEFT JOIN s ON s.session_id = e.session_id) x
"""


def joined_evals(spark, sf):
    return ln.join_evaluations(query(spark, sf, EVALS), query(spark, sf, SESSIONS))


@register("join_evaluations", oracle("SELECT eval_id, session_id, consumed, focus, level FROM j", s=SESSIONS, e=EVALS, j=JOINED))
def _(spark, sf):
    return joined_evals(spark, sf).select("eval_id", "session_id", "consumed", "focus", "level")


@register("interaction_log", oracle("""
SELECT user_id, ts, 'teach' AS type, topic AS query FROM fx_interactions WHERE event_type = 'click' UNION ALL SELECT user_id, eval_ts, 'evaluate', 'EVALUATE: ' || focus FROM j""", s=SESSIONS, e=EVALS, j=JOINED))
def _(spark, sf):
    teach = seen(spark, sf).filter("event_type = 'click'").withColumn("query", F.col("topic"))
    return ln.interaction_log(teach, joined_evals(spark, sf))


@register("outcomes", oracle("SELECT event_id, CASE WHEN k % 5 = 0 OR score >= 0.75 THEN 'understood' WHEN score <= 0.35 THEN 'confused' END AS result FROM fx_interactions"))
def _(spark, sf):
    return seen(spark, sf).select("event_id", ln.outcome(F.col("k") % 5 == 0, "score").alias("result"))


@register("topic_states", oracle("""
SELECT user_id, topic, CASE arg_max(outcome, (ts, event_id)) FILTER (WHERE outcome IN ('confused', 'mastered')) WHEN 'confused' THEN 'weak' ELSE 'strong' END AS state
FROM fx_interactions WHERE outcome IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    return ln.topic_state(seen(spark, sf))


@register("profile_report", oracle(f"""
SELECT user_id, {LEVEL.format(n='sum(n)')} AS proficiency, CAST(sum(n) AS BIGINT) AS interaction_count, max(last) AS last_active,
  coalesce(string_agg(topic, ',' ORDER BY topic) FILTER (WHERE state = 'weak'), '') AS weak_areas, coalesce(string_agg(topic, ',' ORDER BY topic) FILTER (WHERE state = 'strong'), '') AS strong_areas,
  string_agg(topic || '=' || n, ',' ORDER BY topic) AS topic_attempts
FROM (SELECT user_id, topic, count(*) AS n, max(ts) AS last,
    CASE WHEN count(outcome) = 0 THEN NULL WHEN arg_max(outcome, (ts, event_id)) FILTER (WHERE outcome IN ('confused', 'mastered')) = 'confused' THEN 'weak' ELSE 'strong' END AS state
  FROM fx_interactions GROUP BY ALL) t GROUP BY user_id"""))
def _(spark, sf):
    p = ln.profile_report(seen(spark, sf))
    attempts = F.array_join(F.transform(F.map_entries("topic_attempts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return p.withColumns({"weak_areas": F.array_join("weak_areas", ","), "strong_areas": F.array_join("strong_areas", ","), "topic_attempts": attempts})


@register("recent_interactions", oracle("""
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM fx_interactions) r WHERE back <= 5"""))
def _(spark, sf):
    return ln.recent_interactions(seen(spark, sf)).select("user_id", "event_id", "position")


@register("drop_users", oracle("SELECT event_id, user_id FROM fx_interactions WHERE user_id NOT IN (SELECT user_id FROM fx_interactions WHERE outcome = 'mastered' AND k > 90)"))
def _(spark, sf):
    return ln.drop_users(seen(spark, sf), seen(spark, sf).filter("outcome = 'mastered' AND k > 90")).select("event_id", "user_id")


# --- model responses ---------------------------------------------------------

JSON = """SELECT response_id, CASE response_id % 5 WHEN 0 THEN replace(regexp_extract(content, '(?s)(\\{.*\\})', 1), '",}', '"}') WHEN 1 THEN content WHEN 2 THEN '{"is_correct": false, "score": "0.25"}' END AS json FROM fx_llm"""


def extracted(spark, sf):
    return view(spark, sf, "fx_llm").select("response_id", rs.extract_json("content").alias("json"))


@register("extract_json", oracle("SELECT response_id, CASE WHEN json_valid(json) THEN json END AS json FROM j", j=JSON))
def _(spark, sf):
    return extracted(spark, sf)


EVALUATED = f"""
SELECT response_id, json IS NULL AS lost, coalesce(least(1.0, greatest(0.0, TRY_CAST(json->>'score' AS DOUBLE))), 0.0) AS score,
  CASE WHEN json IS NULL THEN false ELSE coalesce(CAST(json->>'is_correct' AS BOOLEAN), least(1.0, greatest(0.0, TRY_CAST(json->>'score' AS DOUBLE))) >= 0.75) END AS is_correct,
  CASE WHEN json IS NULL THEN '{rs.FALLBACKS["evaluate"]["feedback"].replace("'", "''")}' ELSE trim(coalesce(json->>'feedback', '')) END AS feedback,
  CASE WHEN json IS NULL THEN '{rs.FALLBACKS["evaluate"]["ideal_answer"]}' ELSE trim(coalesce(json->>'ideal_answer', '')) END AS ideal_answer
FROM (SELECT response_id, CASE WHEN json_valid(json) THEN json END AS json FROM j) v
"""


@register("normalize_evaluate", oracle("SELECT response_id, score, is_correct, feedback, ideal_answer FROM ev", j=JSON, ev=EVALUATED))
def _(spark, sf):
    return rs.normalize_response(extracted(spark, sf), "evaluate").select("response_id", "score", "is_correct", "feedback", "ideal_answer")


@register("normalize_scores", oracle("SELECT response_id, score FROM ev", j=JSON, ev=EVALUATED))
def _(spark, sf):
    raw = extracted(spark, sf).select("response_id", F.get_json_object("json", "$.score").alias("raw"))
    return raw.select("response_id", ln.normal_score("raw").alias("score"))


TEACH = """SELECT event_id, topic, CASE WHEN k < 50 THEN 'beginner' ELSE 'advanced' END AS level,
  CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN '{"question": " why ' || topic || '? ", "hint": "look", "concept_focus": " "}' ELSE '{"question": "how?", "concept_focus": "deep ' || topic || '", "difficulty": "intermediate"}' END AS json FROM fx_interactions"""


@register("normalize_teach", oracle(f"""
SELECT event_id, CASE WHEN json IS NULL THEN '{rs.FALLBACKS["teach"]["question"]}' ELSE trim(json->>'question') END AS question,
  CASE WHEN json IS NULL THEN '{rs.FALLBACKS["teach"]["hint"]}' ELSE coalesce(json->>'hint', '') END AS hint,
  coalesce(nullif(trim(json->>'concept_focus'), ''), topic) AS concept_focus, coalesce(json->>'difficulty', level) AS difficulty FROM t""", t=TEACH))
def _(spark, sf):
    return rs.normalize_response(query(spark, sf, TEACH), "teach").select("event_id", "question", "hint", "concept_focus", "difficulty")


EXPLAIN = """SELECT event_id, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN '{"summary": " about ' || topic || ' ", "responsibilities": ["a", " ", "b' || CAST(k AS STRING) || '"], "risks": ["r"]}' ELSE '{"summary": "only", "key_components": [{"name": "n", "role": "x"}]}' END AS json, topic, k FROM fx_interactions"""


@register("normalize_explain", oracle(f"""
SELECT event_id, CASE k % 3 WHEN 0 THEN '{rs.FALLBACKS["explain"]["summary"]}' WHEN 1 THEN 'about ' || topic ELSE 'only' END AS summary,
  CASE k % 3 WHEN 0 THEN 'LLM returned non-JSON output' WHEN 1 THEN 'r' ELSE '' END AS risks, CASE k % 3 WHEN 2 THEN 1 ELSE 0 END AS components,
  CASE k % 3 WHEN 0 THEN '{rs.FALLBACKS["explain"]["summary"]}' WHEN 1 THEN 'about ' || topic || chr(10) || chr(10) || 'Responsibilities:' || chr(10) || '- a' || chr(10) || '- b' || k ELSE 'only' END AS text FROM x""", x=EXPLAIN))
def _(spark, sf):
    e = rs.normalize_response(query(spark, sf, EXPLAIN), "explain")
    return e.select("event_id", "summary", F.array_join("risks", ",").alias("risks"), F.size("key_components").alias("components"), "text")


REFACTOR = """SELECT event_id, 'old ' || topic AS content, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN '{"suggested_code": " new ' || topic || ' ", "reasoning": "because", "risks": ["r1", "r2"]}' ELSE '{"reasoning": "none"}' END AS json, topic, k FROM fx_interactions"""


@register("normalize_refactor", oracle(f"""
SELECT event_id, CASE k % 3 WHEN 1 THEN 'new ' || topic ELSE 'old ' || topic END AS suggested_code,
  CASE k % 3 WHEN 0 THEN '{rs.FALLBACKS["refactor"]["reasoning"]}' WHEN 1 THEN 'because' ELSE 'none' END AS reasoning,
  CASE k % 3 WHEN 0 THEN 'LLM returned non-JSON output' WHEN 1 THEN 'r1,r2' ELSE '' END AS risks FROM x""", x=REFACTOR))
def _(spark, sf):
    r = rs.normalize_response(query(spark, sf, REFACTOR), "refactor")
    return r.select("event_id", "suggested_code", "reasoning", F.array_join("risks", ",").alias("risks"))


@register("first_acceptable", oracle("""
SELECT request_id, CASE cls WHEN 0 THEN 'accepted' WHEN 1 THEN 'last_response' ELSE 'error' END AS result, model, candidate_order FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cls, CASE WHEN cls = 0 THEN candidate_order ELSE -candidate_order END) AS rn FROM (
    SELECT *, CASE WHEN status = 200 AND accepted THEN 0 WHEN status = 200 THEN 1 ELSE 2 END AS cls FROM fx_attempts) a) b WHERE rn = 1"""))
def _(spark, sf):
    return rs.first_acceptable(view(spark, sf, "fx_attempts"))


@register("dead_models", oracle("""
SELECT event_id, is_dead, status = 429 OR status >= 500 AS retryable, is_dead AND NOT bool_and(is_dead) OVER (PARTITION BY request_id) AS skipped FROM (
  SELECT *, coalesce(max(CASE WHEN status IN (404, 403) THEN 1 END) OVER (PARTITION BY model ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS is_dead FROM fx_attempts) a"""))
def _(spark, sf):
    return rs.dead_models(view(spark, sf, "fx_attempts")).select("event_id", "is_dead", "retryable", "skipped")


LISTS = "SELECT event_id, ' ' || model || ' ,,m' || CAST(event_id % 3 AS STRING) || ', ' || model || ',x ' AS raw FROM fx_attempts"


@register("parse_candidates", oracle("SELECT event_id, model || CASE WHEN model = 'm' || (event_id % 3) THEN '' ELSE '|m' || (event_id % 3) END || '|x' AS models FROM fx_attempts"))
def _(spark, sf):
    return query(spark, sf, LISTS).select("event_id", F.array_join(rs.parse_candidates("raw"), "|").alias("models"))


TASKED = "SELECT CASE doc_id % 5 WHEN 0 THEN 'explain' WHEN 1 THEN 'refactor' WHEN 2 THEN 'teach' WHEN 3 THEN 'evaluate' ELSE 'other' END AS task, doc_id, source AS path, text AS content FROM documents"


@register("prompt_table", oracle(r"""
SELECT doc_id, task, sha256(path || chr(10) || chr(10) || content) AS seed, fb AS file_budget, cb AS chunk_budget, gb AS graph_budget, sha256(body) AS body,
  greatest(2048, CAST(floor(len(regexp_extract_all(body, '[^ \t\n\x0B\f\r]+')) * 1.3) AS BIGINT)) AS output_budget
FROM (SELECT *, CASE WHEN fb = 0 THEN '' WHEN len(w) <= fb THEN content ELSE array_to_string(regexp_extract_all(content, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+')[1:fb], '') || chr(10) || chr(10) || '# ... truncated to fit context budget ...' END AS body FROM (
  SELECT *, regexp_extract_all(content, '[^ \t\n\x0B\f\r]+') AS w,
    CASE task WHEN 'refactor' THEN 100000 WHEN 'teach' THEN 20000 WHEN 'evaluate' THEN 0 ELSE 60000 END AS fb,
    CASE task WHEN 'teach' THEN 6000 WHEN 'evaluate' THEN 4000 ELSE 8000 END AS cb, CASE task WHEN 'evaluate' THEN 0 ELSE 2000 END AS gb FROM t) a) b""", t=TASKED))
def _(spark, sf):
    p = rs.prompt_table(query(spark, sf, TASKED))
    return p.select("doc_id", "task", text.checksum("seed").alias("seed"), "file_budget", "chunk_budget", "graph_budget", text.checksum("body").alias("body"), "output_budget")


# --- result cache ------------------------------------------------------------

@register("cache_keys", "SELECT doc_id, sha256('explain:' || source || ':' || sha256(text) || ':' || lang) AS key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.cache_key(F.lit("explain"), "source", "text", "lang").alias("key"))


REQUESTS = "SELECT doc_id, 'explain' AS task, CAST(doc_id AS STRING) AS path, text AS content, '' AS extra, doc_id % 13 = 0 AS force_refresh FROM documents"
CACHED = "SELECT 'explain' AS task, CAST(doc_id AS STRING) AS path, text AS content, '' AS extra, doc_id AS result FROM fx_docs_v2"


@register("cached_results", oracle("""
SELECT r.doc_id, coalesce(NOT r.force_refresh AND c.content IS NOT NULL, false) AS hit FROM r LEFT JOIN c ON c.path = r.path AND c.content = r.content""", r=REQUESTS, c=CACHED))
def _(spark, sf):
    cache = query(spark, sf, CACHED).select(text.cache_key("task", "path", "content", "extra").alias("key"), "result")
    store = result_cache.create_cache(spark, f"{checkpoint_folder(spark)}/caches/{uuid.uuid4().hex}", cache, 16)
    hits, misses = result_cache.cached_results(query(spark, sf, REQUESTS), store.snapshot())
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))
