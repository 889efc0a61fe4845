"""Queries over extraction jobs and change analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import changes as ch
from ..operators import extract, js
from ..session import checkpoint_folder
from ..sources.bucketed import Store
from .code import source_files
from .derived import oracle, query, table, view
from .registry import register

WS = "workspace_id"
PY = "SELECT workspace_id, module_name, path, k FROM fx_modules WHERE path LIKE 'src/%.py'"
WEB = "SELECT workspace_id, module_name, path, k FROM fx_modules WHERE path LIKE 'src/%' AND path NOT LIKE '%.py'"
LANG = {"py": PY, "web": WEB}


def parsed(spark, sf, *tags):
    return extract.split_python(extract.parse_python(source_files(spark, sf), tags))


@register("extract_python_modules", oracle("SELECT workspace_id, path, module_name, 'python' AS language, CAST(0 AS INT) AS complexity FROM py", **LANG))
def _(spark, sf):
    return parsed(spark, sf, "module")["modules"].select(WS, "path", "module_name", "language", "complexity")


@register("extract_python_imports", oracle("SELECT i.workspace_id, i.module_name, type, raw_module, coalesce(name, raw_module) AS name FROM fx_imports i JOIN py USING (workspace_id, module_name)", **LANG))
def _(spark, sf):
    return parsed(spark, sf, "import")["imports"].select(WS, "module_name", "type", "raw_module", "name")


@register("extract_python_symbols", oracle("""
SELECT s.workspace_id, s.module_name, kind, class_name, name, symbol_id, CAST(CASE kind WHEN 'function' THEN 0 ELSE ord - CASE WHEN kind = 'class' THEN 0 ELSE 1 END END AS INT) AS ord,
  CASE kind WHEN 'function' THEN 'a,b:int,c,**d' WHEN 'method' THEN 'self,*rest' END AS args, CASE kind WHEN 'function' THEN 'str' END AS returns, CASE kind WHEN 'class' THEN 'size' END AS attributes
FROM fx_symbols s JOIN py USING (workspace_id, module_name) WHERE ord < 4""", **LANG))
def _(spark, sf):
    s = parsed(spark, sf, "symbol")["symbols"]
    args = F.array_join(F.transform("args", lambda a: F.concat_ws(":", a["name"], a["annotation"])), ",")
    return s.select(WS, "module_name", "kind", "class_name", "name", "symbol_id", "ord", args.alias("args"), "returns", F.array_join("attributes", ",").alias("attributes"))


@register("extract_python_calls", oracle("SELECT DISTINCT c.workspace_id, c.module_name, caller_id, raw_target FROM fx_calls c JOIN py USING (workspace_id, module_name)", **LANG))
def _(spark, sf):
    return parsed(spark, sf, "call")["calls"].drop("path")


@register("extract_python_bases", oracle("SELECT DISTINCT b.workspace_id, b.module_name, class_id, raw_base FROM fx_bases b JOIN py USING (workspace_id, module_name)", **LANG))
def _(spark, sf):
    return parsed(spark, sf, "base")["bases"].drop("path")


@register("mine_js_imports", oracle("""
SELECT i.workspace_id, path, CAST(row_number() OVER (PARTITION BY i.workspace_id, path ORDER BY ord % 3, ord) - 1 AS INT) AS ord,
  CASE ord % 3 WHEN 0 THEN 'import' WHEN 1 THEN 'require' ELSE 'dynamic_import' END AS type, raw_module AS spec FROM fx_imports i JOIN web USING (workspace_id, module_name)""", **LANG))
def _(spark, sf):
    return js.mine_js_imports(source_files(spark, sf).filter("path NOT LIKE '%.py'"))


def blocks(spark, sf):
    return js.segment_js_blocks(source_files(spark, sf).filter("path NOT LIKE '%.py'"))


JS_BASE = "SELECT workspace_id, class_id, min(raw_base) AS base FROM fx_bases WHERE NOT contains(raw_base, '.') GROUP BY ALL"


@register("segment_js_blocks", oracle("""
SELECT s.workspace_id, w.path, s.kind, s.name, b.base, 1 + coalesce(i.n, 0) AS start_line,
  coalesce(i.n, 0) + CASE WHEN s.kind = 'class' THEN 6 + coalesce(c.n, 0) ELSE 2 + coalesce(c.n, 0) END AS end_line
FROM fx_symbols s JOIN web w USING (workspace_id, module_name) LEFT JOIN bases b ON b.workspace_id = s.workspace_id AND b.class_id = s.symbol_id
LEFT JOIN (SELECT workspace_id, module_name, count(*) AS n FROM fx_imports GROUP BY ALL) i ON i.workspace_id = s.workspace_id AND i.module_name = s.module_name
LEFT JOIN (SELECT workspace_id, module_name, count(DISTINCT (caller_id, raw_target)) AS n FROM fx_calls GROUP BY ALL) c ON c.workspace_id = s.workspace_id AND c.module_name = s.module_name
WHERE s.ord < 2""", **LANG, bases=JS_BASE))
def _(spark, sf):
    return blocks(spark, sf).select(WS, "path", "kind", "name", "base", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


CALLED = """SELECT DISTINCT workspace_id, path, kind, name, callee FROM (
  SELECT w.workspace_id, w.path, s.kind, s.name, string_split(c.raw_target, '.')[-1] AS callee FROM fx_symbols s JOIN web w USING (workspace_id, module_name)
    JOIN fx_calls c ON c.workspace_id = s.workspace_id AND c.module_name = s.module_name WHERE s.ord < 2
  UNION ALL SELECT w.workspace_id, w.path, 'class', s.class_name, s.name FROM fx_symbols s JOIN web w USING (workspace_id, module_name) WHERE s.kind = 'method'
  UNION ALL SELECT w.workspace_id, w.path, 'function', s.name, 'async' FROM fx_symbols s JOIN web w USING (workspace_id, module_name) WHERE s.kind = 'function' AND s.ord = 1) x"""


@register("mine_js_calls", oracle("SELECT * FROM called", **LANG, called=CALLED))
def _(spark, sf):
    return js.mine_js_calls(blocks(spark, sf))


@register("mine_js_methods", oracle("""
SELECT w.workspace_id, w.path, class_name, CAST(ord - 2 AS INT) AS ord, s.name, (SELECT string_agg(callee, ',' ORDER BY callee) FROM called c WHERE c.workspace_id = w.workspace_id AND c.path = w.path) AS calls
FROM fx_symbols s JOIN web w USING (workspace_id, module_name) WHERE s.kind = 'method'""", **LANG, called=CALLED))
def _(spark, sf):
    return js.mine_js_methods(blocks(spark, sf)).drop("block_ord").withColumn("calls", F.array_join("calls", ","))


@register("extract_corpus", oracle("""
SELECT s.workspace_id, s.module_name, kind, class_name, name, symbol_id FROM fx_symbols s JOIN fx_modules m ON m.workspace_id = s.workspace_id AND m.module_name = s.module_name AND m.path LIKE 'src/%' WHERE ord < 4"""))
def _(spark, sf):
    return extract.extract_corpus(source_files(spark, sf))["symbols"].select(WS, "module_name", "kind", "class_name", "name", "symbol_id")


@register("chunk_ast", oracle("""
SELECT s.workspace_id, path AS source, CASE kind WHEN 'class' THEN 'ClassDef' WHEN 'method' THEN 'FunctionDef' ELSE 'AsyncFunctionDef' END AS type, name, class_name AS parent_class,
  1 + coalesce(i.n, 0) + CASE kind WHEN 'method' THEN 2 + CASE WHEN name = 'm1' THEN 1 + greatest(c.n, 1) ELSE 0 END ELSE 0 END AS start_line FROM fx_symbols s JOIN py USING (workspace_id, module_name)
LEFT JOIN (SELECT workspace_id, module_name, count(*) AS n FROM fx_imports GROUP BY ALL) i ON i.workspace_id = s.workspace_id AND i.module_name = s.module_name
LEFT JOIN (SELECT p.workspace_id, p.module_name, count(DISTINCT raw_target) AS n FROM py p LEFT JOIN fx_calls c ON c.workspace_id = p.workspace_id AND c.module_name = p.module_name GROUP BY ALL) c ON c.workspace_id = s.workspace_id AND c.module_name = s.module_name
WHERE ord < 4""", **LANG))
def _(spark, sf):
    return extract.chunk_ast(source_files(spark, sf)).select(WS, "source", "type", "name", "parent_class", F.col("start_line").cast("bigint").alias("start_line"))


@register("split_definitions", oracle("SELECT s.workspace_id, path, name, count(*) AS n FROM fx_symbols s JOIN py USING (workspace_id, module_name) WHERE ord < 4 GROUP BY ALL", **LANG))
def _(spark, sf):
    return extract.split_definitions(source_files(spark, sf)).groupBy(WS, "path", "name").agg(F.count("*").alias("n"))


@register("chunk_corpus", oracle("""
SELECT m.workspace_id, path AS source, CASE WHEN path LIKE '%.py' AND s.n > 0 THEN s.n ELSE CASE WHEN coalesce(i.n, 0) + coalesce(s.n, 0) > 0 THEN 1 ELSE 0 END END AS chunks FROM fx_modules m
LEFT JOIN (SELECT workspace_id, module_name, count(*) AS n FROM fx_symbols WHERE ord < 4 GROUP BY ALL) s ON s.workspace_id = m.workspace_id AND s.module_name = m.module_name
LEFT JOIN (SELECT workspace_id, module_name, count(*) AS n FROM fx_imports GROUP BY ALL) i ON i.workspace_id = m.workspace_id AND i.module_name = m.module_name
WHERE path LIKE 'src/%' AND coalesce(i.n, 0) + coalesce(s.n, 0) > 0"""))
def _(spark, sf):
    files = source_files(spark, sf)
    return extract.chunk_corpus(files, 2000, 64).groupBy(WS, "source").agg(F.count("*").alias("chunks"))


# --- changes -----------------------------------------------------------------

def pairs(spark, sf):
    return view(spark, sf, "fx_pairs")


@register("unified_diff")
def _(spark, sf):
    return ch.diff_pairs(pairs(spark, sf)).select("doc_id", "diff")


@register("diff_summary")
def _(spark, sf):
    return ch.diff_summary(ch.diff_pairs(pairs(spark, sf))).select("doc_id", "lines_added", "lines_removed", F.round("percent_change", 6).alias("percent_change"))


@register("lines_changed")
def _(spark, sf):
    d = ch.diff_summary(ch.diff_pairs(pairs(spark, sf)))
    delta = pairs(spark, sf).select("doc_id", text.complexity_delta(text.keyword_complexity("old_text"), text.keyword_complexity("new_text")).alias("delta"))
    return d.join(delta, "doc_id").select("doc_id", "lines_changed", "summary", ch.change_sentence("lines_changed", "delta").alias("sentence"))


TYPED = r"""
SELECT diff_id, CAST(i - 1 AS INT) AS pos, CASE WHEN regexp_matches(raw, '^(--- |\+\+\+ )') THEN 'meta' WHEN starts_with(raw, '@@') THEN 'hunk' WHEN starts_with(raw, '+') THEN 'add' WHEN starts_with(raw, '-') THEN 'remove' ELSE 'context' END AS type, raw,
  regexp_extract(raw, '^@@ -([0-9]+)', 1) AS o, regexp_extract(raw, ' [+]([0-9]+)[^+]* @@', 1) AS n
FROM (SELECT diff_id, unnest(string_split(diff, chr(10))) AS raw, generate_subscripts(string_split(diff, chr(10)), 1) AS i FROM fx_diffs) l WHERE raw <> ''"""


@register("parse_diff", oracle("""
SELECT diff_id, pos, type, CASE WHEN type IN ('remove', 'context') THEN CAST(max(TRY_CAST(o AS INT)) OVER h + count(*) FILTER (WHERE type IN ('remove', 'context')) OVER b AS INT) END AS old_line,
  CASE WHEN type IN ('add', 'context') THEN CAST(max(TRY_CAST(n AS INT)) OVER h + count(*) FILTER (WHERE type IN ('add', 'context')) OVER b AS INT) END AS new_line,
  CASE WHEN type IN ('add', 'remove') OR (type = 'context' AND starts_with(raw, ' ')) THEN substring(raw, 2) ELSE raw END AS content
FROM (SELECT *, count(*) FILTER (WHERE type = 'hunk') OVER (PARTITION BY diff_id ORDER BY pos) AS hunk FROM typed) t
WINDOW h AS (PARTITION BY diff_id, hunk), b AS (PARTITION BY diff_id, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", typed=TYPED))
def _(spark, sf):
    return ch.parse_diff(view(spark, sf, "fx_diffs"))


LINES = """SELECT DISTINCT doc_id, side, line FROM (SELECT doc_id, 'old' AS side, unnest(string_split(regexp_replace(old_text, '\\n$', ''), chr(10))) AS line FROM fx_pairs WHERE old_text <> ''
UNION ALL SELECT doc_id, 'new', unnest(string_split(regexp_replace(new_text, '\\n$', ''), chr(10))) FROM fx_pairs WHERE new_text <> '') l"""


@register("line_set_diff", oracle("""
SELECT doc_id, CASE side WHEN 'new' THEN 'added' ELSE 'removed' END AS side, line FROM lines l WHERE NOT EXISTS (SELECT 1 FROM lines r WHERE r.doc_id = l.doc_id AND r.side <> l.side AND r.line = l.line)""", lines=LINES))
def _(spark, sf):
    d = pairs(spark, sf).select("doc_id", ch.line_set_diff("old_text", "new_text").alias("d"))
    return d.select("doc_id", F.explode(F.map_from_arrays(F.array(F.lit("added"), F.lit("removed")), F.array("d.added", "d.removed"))).alias("side", "lines")).select(
        "doc_id", "side", F.explode("lines").alias("line")
    )


def complexity_sql(c: str) -> str:
    terms = [rf"len(regexp_extract_all({c}, '\b{w}\b'))" for w in ("if", "for", "while", "catch", "switch", "case")]
    terms += [f"(length({c}) - length(replace({c}, '{m}', ''))) // {len(m)}" for m in ("&&", "||", "?")]
    return "(" + " + ".join(terms) + ")"


DELTA = f"CASE WHEN c0 = 0 THEN 0 ELSE CAST(trunc((c1 - c0) / c0 * 100) AS INT) END"
SCORED = f"SELECT doc_id, {complexity_sql('old_text')} AS c0, {complexity_sql('new_text')} AS c1 FROM fx_pairs"


@register("change_summary", oracle(f"""
SELECT doc_id, CAST(a AS INT) AS lines_added, CAST(r AS INT) AS lines_removed, round(CASE WHEN greatest(o, n) > 0 THEN (a - r) / greatest(o, n) * 100 ELSE 0.0 END, 2) AS percent_change, {DELTA} AS complexity_delta
FROM (SELECT p.doc_id, s.c0, s.c1, count(l.line) FILTER (WHERE side = 'old') AS o, count(l.line) FILTER (WHERE side = 'new') AS n, count(l.line) FILTER (WHERE side = 'new' AND lone) AS a, count(l.line) FILTER (WHERE side = 'old' AND lone) AS r
  FROM fx_pairs p JOIN scored s USING (doc_id) LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY doc_id, line) = 1 AS lone FROM lines) l ON l.doc_id = p.doc_id GROUP BY ALL) t""", lines=LINES, scored=SCORED))
def _(spark, sf):
    return ch.change_summary(pairs(spark, sf)).select("doc_id", "lines_added", "lines_removed", "percent_change", "complexity_delta")


@register("keyword_complexity", f"SELECT doc_id, {complexity_sql('text')} AS complexity FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.keyword_complexity("text").alias("complexity"))


@register("complexity_delta", oracle(f"SELECT doc_id, {DELTA} AS delta FROM scored", scored=SCORED))
def _(spark, sf):
    return pairs(spark, sf).select("doc_id", text.complexity_delta(text.keyword_complexity("old_text"), text.keyword_complexity("new_text")).alias("delta"))


LATER = "SELECT s.* FROM fx_symbols s WHERE NOT EXISTS (SELECT 1 FROM fx_changes c WHERE c.removes_symbol AND c.workspace_id = s.workspace_id AND c.module_name = s.module_name)"


@register("removed_symbols", oracle("""
SELECT workspace_id, module_name, kind, CASE kind WHEN 'class' THEN 'Removed classes: ' ELSE 'Removed functions: ' END || string_agg(DISTINCT name, ', ' ORDER BY name) AS message FROM fx_symbols
WHERE kind IN ('class', 'function') AND (workspace_id, module_name) IN (SELECT (workspace_id, module_name) FROM fx_changes WHERE removes_symbol) GROUP BY workspace_id, module_name, kind"""))
def _(spark, sf):
    return ch.removed_symbols(view(spark, sf, "fx_symbols"), query(spark, sf, LATER))


@register("removed_imports", oracle("SELECT DISTINCT workspace_id, module_name, coalesce(name, raw_module) AS import FROM fx_imports WHERE raw_module LIKE 'ext_pkg_%'"))
def _(spark, sf):
    imports = view(spark, sf, "fx_imports")
    return ch.removed_imports(imports, imports.filter("raw_module NOT LIKE 'ext_pkg_%'"))


# a new version of each Python file: one in three unchanged, one without imports, one that no longer parses

def edited(spark, sf):
    files = source_files(spark, sf).filter("path LIKE '%.py'").join(view(spark, sf, "fx_modules").select(WS, "path", "k"), [WS, "path"])
    bare = F.regexp_replace("content", r"(?m)^(import|from) .*\n?", "")
    new = F.when(F.col("k") % 3 == 0, F.col("content")).when(F.col("k") % 3 == 1, bare).otherwise(F.concat("content", F.lit("\ndef broken(:\n")))
    return files.select(WS, "path", F.col("content").alias("old_text"), new.alias("new_text"))


CODE_LINES = """SELECT s.workspace_id, s.module_name, sum(CASE kind WHEN 'class' THEN 2 ELSE 1 + greatest(1, coalesce(c.n, 0)) END) AS n FROM fx_symbols s
LEFT JOIN (SELECT workspace_id, caller_id, count(DISTINCT raw_target) AS n FROM fx_calls GROUP BY ALL) c ON c.workspace_id = s.workspace_id AND c.caller_id = s.symbol_id WHERE ord < 4 GROUP BY ALL"""


@register("syntax_check", oracle("""
SELECT workspace_id, path, CAST(greatest(1, coalesce(i.n, 0) + coalesce(s.n, 0)) + 1 AS INT) AS line FROM py
LEFT JOIN (SELECT workspace_id, module_name, count(*) AS n FROM fx_imports GROUP BY ALL) i USING (workspace_id, module_name)
LEFT JOIN code_lines s USING (workspace_id, module_name) WHERE k % 3 = 2""", **LANG, code_lines=CODE_LINES))
def _(spark, sf):
    new = edited(spark, sf).select(WS, "path", F.col("new_text").alias("content"))
    return ch.syntax_check(new).select(WS, "path", "line")


@register("validate_changes", oracle("""
SELECT p.workspace_id, p.path, k % 3 = 0 OR (k % 3 = 1 AND coalesce(i.n, 0) = 0) AS is_valid, CASE k % 3 WHEN 2 THEN CAST(1 AS BIGINT) ELSE 0 END AS syntax_errors, CASE k % 3 WHEN 1 THEN coalesce(i.n, 0) ELSE 0 END AS import_errors,
  CAST(0 AS BIGINT) AS breaking_changes, coalesce(d.n, 0) AS affected_dependents, 0 AS complexity_delta FROM py p
LEFT JOIN (SELECT workspace_id, module_name, count(DISTINCT coalesce(name, raw_module)) AS n FROM fx_imports GROUP BY ALL) i ON i.workspace_id = p.workspace_id AND i.module_name = p.module_name
LEFT JOIN (SELECT workspace_id, target, count(DISTINCT source) AS n FROM fx_edges GROUP BY ALL) d ON d.workspace_id = p.workspace_id AND d.target = p.module_name""", **LANG))
def _(spark, sf):
    return ch.validate_changes(edited(spark, sf), view(spark, sf, "fx_edges"))


@register("batch_verdicts", oracle("SELECT workspace_id, batch_id, path, bool_and(is_valid) OVER (PARTITION BY workspace_id, batch_id) AS applied FROM fx_changes"))
def _(spark, sf):
    return ch.batch_verdict(view(spark, sf, "fx_changes")).select(WS, "batch_id", "path", "applied")


STORE = "SELECT workspace_id, path, k AS version FROM fx_modules"


@register("apply_batch", oracle("""
SELECT m.workspace_id, m.path, CASE WHEN v.applied THEN -1 ELSE m.k END AS version FROM fx_modules m LEFT JOIN (
  SELECT workspace_id, path, bool_and(is_valid) OVER (PARTITION BY workspace_id, batch_id) AS applied FROM fx_changes) v ON v.workspace_id = m.workspace_id AND v.path = m.path"""))
def _(spark, sf):
    changed = view(spark, sf, "fx_changes").withColumn("version", F.lit(-1).cast("bigint"))
    store = Store(spark, f"{checkpoint_folder(spark)}/files/{uuid.uuid4().hex}", 16)
    store.create({"files": (query(spark, sf, STORE), [WS, "path"])})
    return ch.commit_batch(store, "files", changed).table("files")


# each change is stamped with the moment of the event of the same batch
STAMPED = "SELECT c.workspace_id, c.path, e.ts AS changed_at FROM fx_changes c JOIN events e ON e.event_id = c.batch_id"


@register("versioned_snapshot", oracle("""
SELECT s.workspace_id, s.path, k AS version, regexp_replace(s.path, '[.][a-z]+$', '') || '_backup_' || strftime(changed_at, '%Y%m%d_%H%M%S') || regexp_extract(s.path, '[.][a-z]+$') AS backup_path
FROM stamped t JOIN fx_modules s ON s.workspace_id = t.workspace_id AND s.path = t.path""", stamped=STAMPED))
def _(spark, sf):
    return ch.versioned_snapshot(query(spark, sf, STORE), query(spark, sf, STAMPED)).select(WS, "path", "version", "backup_path")


VERSIONS = "SELECT workspace_id, path, changed_at, path AS text FROM ({s}) s UNION ALL SELECT workspace_id, path, changed_at - INTERVAL '5' DAY, 'older' FROM ({s}) s".format(s=STAMPED)


@register("restore_versions", oracle("SELECT workspace_id, path, arg_max(text, changed_at) AS text FROM v WHERE changed_at <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL", v=VERSIONS))
def _(spark, sf):
    return ch.restore(query(spark, sf, VERSIONS), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select(WS, "path", "text")
