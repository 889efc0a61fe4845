"""Model responses as tables: JSON recovery, normalisation, candidate choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.ids import as_col
from .learning import normal_score


def extract_json(c: Column | str) -> Column:
    """JSON object text inside a response, fences stripped and trailing commas repaired; NULL if none parses."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(as_col(c), F.lit(" \t\n\r\f\x0b")), r"(?i)^```(?:json)?[ \t\n\x0B\f\r]*", ""), r"[ \t\n\x0B\f\r]*```$", "")
    body = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    mended = F.regexp_replace(body, r",[ \t\n\x0B\f\r]*([\]}])", "$1")

    def parses(x: Column) -> Column:
        return F.try_parse_json(x).isNotNull()

    return F.when(parses(body), body).when(parses(mended), mended)


# Texts used when no structured answer could be read.
FALLBACKS = {
    "explain": {"summary": "File explanation unavailable in structured form.", "risks": ["LLM returned non-JSON output"]},
    "teach": {
        "question": "What is the smallest part of the code you can inspect to validate your assumption?",
        "hint": "Start by identifying the input, output, and one invariant you can check.",
    },
    "refactor": {"reasoning": "Structured output unavailable; no changes applied.", "risks": ["LLM returned non-JSON output"]},
    "evaluate": {
        "feedback": "I couldn't evaluate that answer in a structured way. Try answering in 2-4 sentences and name one concrete code artifact (function/class/file) you inspected.",
        "ideal_answer": "A good answer states the key idea, ties it to a specific part of the code, and mentions one implication or tradeoff.",
    },
}
SCHEMAS = {
    "explain": "summary string, responsibilities array<string>, key_components array<struct<name:string,role:string>>, dependencies array<string>, risks array<string>, insights array<string>",
    "teach": "question string, hint string, concept_focus string, difficulty string",
    "refactor": "suggested_code string, reasoning string, risks array<string>",
    "evaluate": "is_correct boolean, score string, feedback string, ideal_answer string",
}


def normalize_response(responses: DataFrame, task: str, json_col: str = "json") -> DataFrame:
    """Columns of the task's schema with defaults; rows without JSON get the fallback.

    ``teach`` reads defaults from columns ``topic`` and ``level``;
    ``refactor`` from ``content``.
    """
    parsed = responses.withColumn("_p", F.from_json(json_col, SCHEMAS[task]))
    none = F.col(json_col).isNull()
    spare = FALLBACKS[task]

    def field(name: str, default: Column | str = "") -> Column:
        default = F.lit(default) if isinstance(default, str) else default
        read = F.trim(F.coalesce(F.col(f"_p.{name}"), default))
        return F.when(none, F.lit(spare[name])).otherwise(read) if name in spare else F.when(none, default).otherwise(read)

    def items(name: str, kind: str = "array<string>") -> Column:
        empty = F.array().cast(kind)
        lost = F.array(*map(F.lit, spare[name])) if name in spare else empty
        return F.when(none, lost).otherwise(F.coalesce(F.col(f"_p.{name}"), empty))

    if task == "evaluate":
        score = F.when(none, F.lit(0.0)).otherwise(normal_score("_p.score"))
        correct = F.when(none, F.lit(False)).otherwise(F.coalesce(F.col("_p.is_correct"), score >= rules.UNDERSTOOD_FROM))
        made = {"score": score, "is_correct": correct, "feedback": field("feedback"), "ideal_answer": field("ideal_answer")}
    elif task == "teach":
        made = {
            "question": field("question"), "hint": field("hint"),
            "concept_focus": F.coalesce(F.nullif(field("concept_focus", F.col("topic")), F.lit("")), "topic"),
            "difficulty": F.coalesce(F.nullif(field("difficulty", F.col("level")), F.lit("")), "level"),
        }
    elif task == "refactor":
        made = {
            "suggested_code": F.when(none, F.col("content")).otherwise(F.trim(F.coalesce("_p.suggested_code", "content"))),
            "reasoning": field("reasoning"), "risks": items("risks"),
        }
    elif task == "explain":
        parts = "array<struct<name:string,role:string>>"
        made = {"summary": field("summary"), "key_components": items("key_components", parts)}
        made |= {n: items(n) for n in ("responsibilities", "dependencies", "risks", "insights")}
    else:
        raise ValueError(f"unknown task {task!r}")
    out = parsed.withColumns(made).drop("_p")
    if task == "explain":
        bullets = F.transform(F.filter("responsibilities", lambda r: F.trim(r) != ""), lambda r: F.concat(F.lit("- "), r))
        listed = F.when(F.size("responsibilities") > 0, F.concat(F.array(F.lit("\nResponsibilities:")), bullets)).otherwise(F.array().cast("array<string>"))
        whole = F.array_join(F.filter(F.concat(F.array("summary"), listed), lambda x: x != ""), "\n")
        out = out.withColumn("text", F.trim(whole, F.lit(" \n")))
    return out


def first_acceptable(attempts: DataFrame) -> DataFrame:
    """(request_id, result, model, candidate_order): the answer each request ends with.

    By candidate order: first success that passes; else the last response;
    else the last error.  A request has as many rows as it had candidates,
    and the choice is a combining aggregate.
    """
    ok = F.col("status") == 200
    good = ok & F.col("accepted")
    at = F.struct("candidate_order", "model")
    best = attempts.groupBy("request_id").agg(
        F.min(F.when(good, at)).alias("a"), F.max(F.when(ok, at)).alias("r"), F.max(F.when(~ok, at)).alias("e")
    )
    pick = F.coalesce("a", "r", "e")
    result = F.when(F.col("a").isNotNull(), "accepted").when(F.col("r").isNotNull(), "last_response").otherwise("error")
    return best.select("request_id", result.alias("result"), pick["model"].alias("model"), pick["candidate_order"].alias("candidate_order"))


def dead_models(attempts: DataFrame) -> DataFrame:
    """Adds ``is_dead`` (model answered 404/403 earlier), ``retryable`` and ``skipped``.

    Candidates that are dead when their turn comes are skipped, unless every
    candidate of the request is.  A model dies once, so its first death is one
    aggregate rather than a running scan of its history.
    """
    died = attempts.filter(F.col("status").isin(404, 403)).groupBy("model").agg(F.min(F.struct("ts", "event_id")).alias("_death"))
    dead = F.coalesce(F.struct("ts", "event_id") > F.col("_death"), F.lit(False))
    seen = attempts.join(died, ["model"], "left").withColumn("is_dead", dead)
    whole = seen.groupBy("request_id").agg(F.bool_and("is_dead").alias("_all"))
    return seen.join(whole, "request_id").withColumns({
        "retryable": (F.col("status") == 429) | (F.col("status") >= 500), "skipped": F.col("is_dead") & ~F.col("_all"),
    }).drop("_death", "_all")


def parse_candidates(c: Column | str) -> Column:
    """Comma list as trimmed unique names in order."""
    return F.array_distinct(F.filter(F.transform(F.split(as_col(c), ","), lambda x: F.trim(x)), lambda x: x != ""))


def budget(task: Column | str, kind: str) -> Column:
    """Token budget of a task; unknown tasks read as explain."""
    rows = [F.lit(x) for t, b in rules.TOKEN_BUDGETS.items() for x in (t, b[kind])]
    return F.coalesce(F.try_element_at(F.create_map(*rows), as_col(task)), F.lit(rules.TOKEN_BUDGETS["explain"][kind]))


def prompt_table(
    files: DataFrame, mode: str = "words", seed_chars: int | None = None, least_output: int = 2048, most_output: int | None = None
) -> DataFrame:
    """Retrieval seed, file cut to its budget, and output budget per (task, path, content).

    The seed holds the whole text unless ``seed_chars`` is given; the output
    budget is 1.3 times the shown tokens, within the two bounds.
    """
    from .chunks import truncate_head

    has = F.coalesce(F.length("content"), F.lit(0)) > 0
    seed = F.when(has, F.concat("path", F.lit("\n\n"), "content" if seed_chars is None else F.left("content", F.lit(seed_chars)))).otherwise(F.col("path"))
    body = files.withColumns({"seed": seed, "file_budget": budget("task", "file"), "chunk_budget": budget("task", "chunks"), "graph_budget": budget("task", "graph")})
    cut = body.withColumn("body", truncate_head("content", F.col("file_budget")))
    grown = F.floor(text.token_count("body", mode) * F.lit(1.3)).cast("bigint")
    return cut.withColumn("output_budget", F.greatest(F.lit(least_output).cast("bigint"), grown if most_output is None else F.least(F.lit(most_output).cast("bigint"), grown)))
