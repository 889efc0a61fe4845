"""Derived input views over the driver tables, as SQL both engines read.

Each view is plain ANSI SQL (see FIXTURES.md for what it exercises).  The
same text feeds Spark (as a chain of CTEs over parquet) and the DuckDB
oracle (as a chain of CTEs over its registered tables), so an input never
differs between the two sides.  ``SCALED`` holds Spark forms of single views
that give the same rows and move fewer bytes; a test compares them.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

# workspace_id string; k bigint; path string; module_name string
VIEWS["fx_modules"] = """
SELECT w.workspace_id, k, path, regexp_replace(replace(path, '/', '.'), '[.](py|tsx|ts|js)$', '') AS module_name FROM (
  SELECT p_partkey AS k, 'src/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '_') || '/part_' || CAST(p_partkey AS STRING)
    || CASE WHEN p_partkey % 10 < 6 THEN '.py' WHEN p_partkey % 10 < 8 THEN '.ts' WHEN p_partkey % 10 = 8 THEN '.js' ELSE '.tsx' END AS path FROM part
  UNION ALL SELECT p_partkey, 'lib/part_' || CAST(p_partkey + 1 AS STRING) || '.py' FROM part WHERE p_partkey % 20 = 0
  UNION ALL SELECT p_partkey, 'alt/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '_') || '/part_' || CAST(p_partkey AS STRING) || '.py' FROM part WHERE p_partkey % 20 = 10
  UNION ALL SELECT p_partkey, 'deep/k' || CAST(p_partkey AS STRING) || '/only/inner/part_' || CAST(p_partkey AS STRING) || '.py' FROM part WHERE p_partkey % 50 = 7
) m CROSS JOIN (SELECT 'w0' AS workspace_id UNION ALL SELECT 'w1') w
"""

# workspace_id string; a bigint; b bigint
VIEWS["fx_pairs_ab"] = """
SELECT DISTINCT 'w' || CAST(o % 2 AS STRING) AS workspace_id, a, b FROM (
  SELECT l_orderkey AS o, l_partkey AS a,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS b FROM lineitem) t
WHERE b IS NOT NULL AND a <> b
"""

# workspace_id string; a bigint; b bigint; source string; target string (module names of a and b, joined once for the views below)
VIEWS["fx_named"] = """
SELECT e.workspace_id, e.a, e.b, ma.module_name AS source, e.target FROM (
  SELECT p.workspace_id, p.a, p.b, mb.module_name AS target FROM fx_pairs_ab p
  JOIN fx_modules mb ON mb.workspace_id = p.workspace_id AND mb.k = p.b AND mb.path LIKE 'src/%') e
JOIN fx_modules ma ON ma.workspace_id = e.workspace_id AND ma.k = e.a AND ma.path LIKE 'src/%'
"""

# workspace_id string; module_name string; ord bigint; type string; raw_module string; name string; alias string; level int
VIEWS["fx_imports"] = """
SELECT e.workspace_id, ma.module_name, CAST(e.b AS BIGINT) AS ord,
  CASE WHEN (a + b) % 7 IN (1, 5) THEN 'from_import' ELSE 'import' END AS type,
  CASE (a + b) % 7 WHEN 0 THEN mb.module_name
    WHEN 1 THEN regexp_replace(mb.module_name, '[.][^.]*$', '')
    WHEN 2 THEN mb.module_name || '.symbol'
    WHEN 3 THEN 'root.' || mb.module_name
    WHEN 4 THEN substring(mb.module_name, 5)
    WHEN 5 THEN substring(regexp_replace(mb.module_name, '[.][^.]*$', ''), 5)
    ELSE 'ext_pkg_' || CAST(b % 20 AS STRING) END AS raw_module,
  CASE WHEN (a + b) % 7 IN (1, 5) THEN 'part_' || CAST(b AS STRING) END AS name,
  CAST(NULL AS STRING) AS alias, 0 AS level
FROM fx_pairs_ab e
JOIN fx_modules ma ON ma.workspace_id = e.workspace_id AND ma.k = e.a AND ma.path LIKE 'src/%'
JOIN fx_modules mb ON mb.workspace_id = e.workspace_id AND mb.k = e.b AND mb.path LIKE 'src/%'
"""

# id string; kind string; label string; parent_id string; is_external boolean
VIEWS["fx_tree"] = """
SELECT 'r' || CAST(r_regionkey AS STRING) AS id, 'folder' AS kind, lower(r_name) AS label, CAST(NULL AS STRING) AS parent_id, false AS is_external FROM region
UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'folder', lower(n_name), 'r' || CAST(n_regionkey AS STRING), false FROM nation
UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 'module', lower(s_name), 'n' || CAST(s_nationkey AS STRING), s_acctbal < 0 FROM supplier
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'class', lower(c_name), 's' || CAST(c_custkey % (SELECT count(*) FROM supplier) AS STRING), false FROM customer
"""

# source string; target string; type string
VIEWS["fx_deps"] = """
SELECT DISTINCT 'c' || CAST(o_custkey AS STRING) AS source, 's' || CAST(l_suppkey AS STRING) AS target,
  CASE l_returnflag WHEN 'R' THEN 'imports' WHEN 'A' THEN 'calls' ELSE 'inherits' END AS type
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
"""

# event_id bigint; user_id bigint; ts timestamp_ntz; event_type string; k int; topic string; outcome string; score double
VIEWS["fx_interactions"] = """
SELECT event_id, user_id, ts, event_type, k,
  CASE k % 9 WHEN 0 THEN 'auth' WHEN 1 THEN 'api' WHEN 2 THEN 'database' WHEN 3 THEN 'ui' WHEN 4 THEN 'validation' WHEN 5 THEN 'error' WHEN 6 THEN 'test' WHEN 7 THEN 'cache' ELSE 'general' END AS topic,
  CASE event_type WHEN 'purchase' THEN 'understood' WHEN 'error' THEN 'confused' WHEN 'signup' THEN 'mastered' END AS outcome,
  round(value / 100, 4) AS score
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""

# eval_id bigint; user_id bigint; eval_ts timestamp_ntz; score double; session_id bigint
VIEWS["fx_sessions"] = """
SELECT event_id AS eval_id, user_id, ts AS eval_ts, score,
  max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS session_id
FROM fx_interactions WHERE event_type IN ('click', 'view')
"""

# response_id bigint; content string
VIEWS["fx_llm"] = """
SELECT event_id AS response_id, CASE event_id % 5
  WHEN 0 THEN '```json' || chr(10) || '{"is_correct": true, "score": ' || CAST(CAST(k AS INT) AS STRING) || ', "feedback": " ok ",}' || chr(10) || '```'
  WHEN 1 THEN '{"score": 0.' || CAST(k AS STRING) || ', "feedback": "fine", "ideal_answer": "x"}'
  WHEN 2 THEN 'Sure! {"is_correct": false, "score": "0.25"} hope it helps'
  WHEN 3 THEN 'no json here' ELSE '' END AS content FROM fx_interactions
"""

# event_id bigint; request_id bigint; candidate_order bigint; model string; ts timestamp_ntz; status int; accepted boolean
VIEWS["fx_attempts"] = """
SELECT event_id, CAST(floor(event_id / 4) AS BIGINT) AS request_id, event_id % 4 AS candidate_order, 'm' || CAST(user_id % 6 AS STRING) AS model, ts,
  CASE WHEN k < 60 THEN 200 WHEN k < 75 THEN 429 WHEN k < 90 THEN 500 WHEN k < 95 THEN 404 ELSE 403 END AS status, k % 3 <> 0 AS accepted FROM fx_interactions
"""

# workspace_id string; k bigint; module_name string; kind string; class_name string; name string; symbol_id string; ord int
VIEWS["fx_symbols"] = """
SELECT workspace_id, k, module_name, kind, class_name, name, module_name || '.' || coalesce(class_name || '.', '') || name AS symbol_id, ord FROM (
  SELECT workspace_id, k, module_name, 'class' AS kind, CAST(NULL AS STRING) AS class_name, 'C' || CAST(k AS STRING) AS name, 0 AS ord FROM fx_modules WHERE path LIKE 'src/%' AND k % 3 = 0
  UNION ALL SELECT workspace_id, k, module_name, 'function', NULL, 'f' || CAST(k AS STRING), 1 FROM fx_modules WHERE path LIKE 'src/%' AND k % 3 = 1
  UNION ALL SELECT workspace_id, k, module_name, 'method', 'C' || CAST(k AS STRING), 'm0', 2 FROM fx_modules WHERE path LIKE 'src/%' AND k % 3 = 0
  UNION ALL SELECT workspace_id, k, module_name, 'method', 'C' || CAST(k AS STRING), 'm1', 3 FROM fx_modules WHERE path LIKE 'src/%' AND k % 3 = 0
  UNION ALL SELECT workspace_id, k, module_name, 'function', NULL, 'Call(x' || CAST(k AS STRING) || ')', 4 FROM fx_modules WHERE path LIKE 'src/%' AND k % 101 = 0) s
"""

# workspace_id string; module_name string; caller_id string; raw_target string
VIEWS["fx_calls"] = """
SELECT e.workspace_id, ma.module_name, ma.module_name || CASE WHEN a % 3 = 0 THEN '.C' || CAST(a AS STRING) || '.m0' ELSE '.f' || CAST(a AS STRING) END AS caller_id,
  CASE (a + b) % 5 WHEN 0 THEN 'self.m1' WHEN 1 THEN 'f' || CAST(a AS STRING) WHEN 2 THEN mb.module_name || '.f' || CAST(b AS STRING) WHEN 3 THEN 's.strip' ELSE 'unknown_call' END AS raw_target
FROM fx_pairs_ab e
JOIN fx_modules ma ON ma.workspace_id = e.workspace_id AND ma.k = e.a AND ma.path LIKE 'src/%'
JOIN fx_modules mb ON mb.workspace_id = e.workspace_id AND mb.k = e.b AND mb.path LIKE 'src/%' WHERE a % 3 < 2
"""

# workspace_id string; module_name string; class_id string; raw_base string
VIEWS["fx_bases"] = """
SELECT e.workspace_id, ma.module_name, ma.module_name || '.C' || CAST(a AS STRING) AS class_id,
  CASE (a + b) % 4 WHEN 0 THEN 'C' || CAST(a AS STRING) WHEN 1 THEN 'part_' || CAST(b AS STRING) || '.C' || CAST(b AS STRING) WHEN 2 THEN 'Base' || CAST(b % 10 AS STRING) ELSE 'root.node_modules.X' END AS raw_base
FROM fx_pairs_ab e JOIN fx_modules ma ON ma.workspace_id = e.workspace_id AND ma.k = e.a AND ma.path LIKE 'src/%' WHERE a % 3 = 0
"""

# workspace_id string; id string; type string; path string; module string; class string; is_external boolean
VIEWS["fx_nodes"] = """
SELECT workspace_id, module_name AS id, 'module' AS type, path, CAST(NULL AS STRING) AS module, CAST(NULL AS STRING) AS class, false AS is_external FROM fx_modules
UNION ALL SELECT workspace_id, symbol_id, CASE kind WHEN 'class' THEN 'class' ELSE 'function' END, NULL, module_name, class_name, false FROM fx_symbols
UNION ALL SELECT DISTINCT workspace_id, raw_module, 'module', NULL, NULL, NULL, true FROM fx_imports WHERE raw_module LIKE 'ext_pkg_%'
UNION ALL SELECT workspace_id, 'x.node_modules.y' || CAST(k AS STRING), 'module', NULL, NULL, NULL, true FROM fx_modules WHERE path LIKE 'src/%' AND k % 97 = 0
"""

# workspace_id string; source string; target string; type string
VIEWS["fx_edges"] = """
SELECT e.workspace_id, ma.module_name AS source, mb.module_name AS target, 'imports' AS type FROM fx_pairs_ab e
  JOIN fx_modules ma ON ma.workspace_id = e.workspace_id AND ma.k = e.a AND ma.path LIKE 'src/%' JOIN fx_modules mb ON mb.workspace_id = e.workspace_id AND mb.k = e.b AND mb.path LIKE 'src/%'
UNION ALL SELECT DISTINCT workspace_id, module_name, raw_module, 'imports' FROM fx_imports WHERE raw_module LIKE 'ext_pkg_%'
UNION ALL SELECT workspace_id, module_name || coalesce('.' || class_name, ''), symbol_id, 'contains' FROM fx_symbols
UNION ALL SELECT e.workspace_id, sa.symbol_id, sb.symbol_id, CASE WHEN sa.kind = 'class' THEN 'inherits' ELSE 'calls' END FROM fx_pairs_ab e
  JOIN fx_symbols sa ON sa.workspace_id = e.workspace_id AND sa.k = e.a AND sa.ord < 2
  JOIN fx_symbols sb ON sb.workspace_id = e.workspace_id AND sb.k = e.b AND sb.kind = sa.kind AND sb.ord < 2
"""

# workspace_id string; batch_id int; path string; module_name string; removes_symbol boolean; is_valid boolean
VIEWS["fx_changes"] = """
SELECT workspace_id, CAST(floor(k / 5) AS INT) AS batch_id, path, module_name, k % 4 = 0 AS removes_symbol, k % 9 <> 0 AS is_valid FROM fx_modules WHERE path LIKE 'src/%'
"""

# workspace_id string; doc_id bigint; path string; size bigint
VIEWS["fx_paths"] = """
SELECT 'w' || CAST(doc_id % 3 AS STRING) AS workspace_id, doc_id, CASE doc_id % 10
  WHEN 0 THEN 'app/src/d' || CAST(doc_id AS STRING) || '.py' WHEN 1 THEN 'app/node_modules/x/d' || CAST(doc_id AS STRING) || '.js'
  WHEN 2 THEN 'app/.git/d' || CAST(doc_id AS STRING) WHEN 3 THEN 'app/.github/d' || CAST(doc_id AS STRING) || '.py'
  WHEN 4 THEN 'app/Build/d' || CAST(doc_id AS STRING) || '.ts' WHEN 5 THEN '../evil/d' || CAST(doc_id AS STRING) || '.py'
  WHEN 6 THEN '/abs/d' || CAST(doc_id AS STRING) || '.py' WHEN 7 THEN 'app/.env'
  WHEN 8 THEN 'app/pkg/__pycache__/d' || CAST(doc_id AS STRING) || '.pyc' ELSE source || '/' || lang || '/d' || CAST(doc_id AS STRING) || '.tsx' END AS path, n_chars AS size FROM documents
"""

# workspace_id string; k bigint; ref string
VIEWS["fx_refs"] = """
SELECT workspace_id, k, CASE k % 6 WHEN 0 THEN path WHEN 1 THEN module_name WHEN 2 THEN module_name || '.C' || CAST(k AS STRING) || '.m0'
  WHEN 3 THEN regexp_replace(path, '[.][a-z]+$', '') WHEN 4 THEN 'part_' || CAST(k AS STRING) ELSE 'no/such/ref_' || CAST(k AS STRING) END AS ref FROM fx_modules WHERE path LIKE 'src/%'
"""

# workspace_id string; importer string; target_path string; spec string
VIEWS["fx_js_specs"] = """
SELECT e.workspace_id, ma.path AS importer, mb.path AS target_path, CASE (a + b) % 4
  WHEN 0 THEN '../../' || regexp_replace(replace(mb.path, 'src/', ''), '[.][a-z]+$', '')
  WHEN 1 THEN '../../' || replace(mb.path, 'src/', '')
  WHEN 2 THEN '../../' || regexp_replace(replace(mb.path, 'src/', ''), '[.][a-z]+$', '') || '.js' ELSE 'react' END AS spec
FROM fx_pairs_ab e JOIN fx_modules ma ON ma.workspace_id = e.workspace_id AND ma.k = e.a AND ma.path LIKE 'src/%'
JOIN fx_modules mb ON mb.workspace_id = e.workspace_id AND mb.k = e.b AND mb.path LIKE 'src/%' AND mb.path NOT LIKE '%.py'
"""

# doc_id bigint; text string
VIEWS["fx_docs_v2"] = """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'changed line' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 11 = 0
"""

# doc_id bigint; old_text string; new_text string
VIEWS["fx_pairs"] = """
SELECT o.doc_id, o.text AS old_text, n.text AS new_text FROM documents o JOIN fx_docs_v2 n ON n.doc_id = o.doc_id
UNION ALL SELECT a.doc_id + 2000000, a.text, b.text FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
"""

# diff_id bigint; diff string
VIEWS["fx_diffs"] = """
SELECT doc_id AS diff_id, '--- a/d' || chr(10) || '+++ b/d' || chr(10) || '@@ -' || CAST(doc_id % 50 + 1 AS STRING) || ',3 +' || CAST(doc_id % 40 + 1 AS STRING) || ',3 @@' || chr(10) || ' keep'
  || chr(10) || '-old' || chr(10) || '+new ' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '@@ -' || CAST(doc_id % 50 + 90 AS STRING) || ' +' || CAST(doc_id % 40 + 91 AS STRING) || ' @@' || chr(10) || '+tail' ELSE '' END AS diff FROM documents
"""

# workspace_id string; path string; content string
VIEWS["fx_manifests"] = """
SELECT 'w' || CAST(s_suppkey AS STRING) AS workspace_id, CASE s_suppkey % 7 WHEN 0 THEN 'package.json' WHEN 1 THEN 'package.json' WHEN 2 THEN 'requirements.txt' WHEN 3 THEN 'pyproject.toml' WHEN 4 THEN 'manage.py' WHEN 5 THEN 'tsconfig.json' ELSE 'readme.md' END AS path,
  CASE s_suppkey % 7 WHEN 0 THEN '{"dependencies": {"react": "1", "next": "2"}}' WHEN 1 THEN '{"devDependencies": {"express": "4"}}' WHEN 2 THEN 'Flask==3' || chr(10) || 'fastapi' WHEN 3 THEN 'django = "5"' ELSE 'x' END AS content FROM supplier
"""

#: Views that Spark derives by another plan with the same rows.
SCALED: dict[str, str] = {}

# rows of one order that agree on line number and part are the same to their neighbours: further columns need not move
SCALED["fx_pairs_ab"] = """
SELECT DISTINCT 'w' || CAST(o % 2 AS STRING) AS workspace_id, a, b FROM (
  SELECT l_orderkey AS o, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) t
WHERE b IS NOT NULL AND a <> b
"""

# the joins with fx_modules, and with the class or function of a module, are those of fx_named
_NAMED = "SELECT workspace_id, a, b, source AS a_name, target AS b_name FROM fx_named"

SCALED["fx_imports"] = f"""
SELECT workspace_id, a_name AS module_name, CAST(b AS BIGINT) AS ord,
  CASE WHEN (a + b) % 7 IN (1, 5) THEN 'from_import' ELSE 'import' END AS type,
  CASE (a + b) % 7 WHEN 0 THEN b_name
    WHEN 1 THEN regexp_replace(b_name, '[.][^.]*$', '')
    WHEN 2 THEN b_name || '.symbol'
    WHEN 3 THEN 'root.' || b_name
    WHEN 4 THEN substring(b_name, 5)
    WHEN 5 THEN substring(regexp_replace(b_name, '[.][^.]*$', ''), 5)
    ELSE 'ext_pkg_' || CAST(b % 20 AS STRING) END AS raw_module,
  CASE WHEN (a + b) % 7 IN (1, 5) THEN 'part_' || CAST(b AS STRING) END AS name,
  CAST(NULL AS STRING) AS alias, 0 AS level
FROM ({_NAMED}) e
"""

SCALED["fx_calls"] = f"""
SELECT workspace_id, a_name AS module_name, a_name || CASE WHEN a % 3 = 0 THEN '.C' || CAST(a AS STRING) || '.m0' ELSE '.f' || CAST(a AS STRING) END AS caller_id,
  CASE (a + b) % 5 WHEN 0 THEN 'self.m1' WHEN 1 THEN 'f' || CAST(a AS STRING) WHEN 2 THEN b_name || '.f' || CAST(b AS STRING) WHEN 3 THEN 's.strip' ELSE 'unknown_call' END AS raw_target
FROM ({_NAMED}) e WHERE a % 3 < 2
"""

# a module has a class if its key leaves 0 by 3, a function if it leaves 1 (fx_symbols below ord 2)
SCALED["fx_edges"] = f"""
SELECT workspace_id, a_name AS source, b_name AS target, 'imports' AS type FROM ({_NAMED}) e
UNION ALL SELECT DISTINCT workspace_id, module_name, raw_module, 'imports' FROM fx_imports WHERE raw_module LIKE 'ext_pkg_%'
UNION ALL SELECT workspace_id, module_name || coalesce('.' || class_name, ''), symbol_id, 'contains' FROM fx_symbols
UNION ALL SELECT workspace_id, a_name || '.' || CASE a % 3 WHEN 0 THEN 'C' ELSE 'f' END || CAST(a AS STRING), b_name || '.' || CASE b % 3 WHEN 0 THEN 'C' ELSE 'f' END || CAST(b AS STRING),
  CASE a % 3 WHEN 0 THEN 'inherits' ELSE 'calls' END FROM ({_NAMED}) e WHERE a % 3 = b % 3 AND a % 3 IN (0, 1)
"""

# a text moves once, to the block of its id, and sees the texts of its id and of the id before; the last id of a block is
# lent to the next (side 1), a text of fx_docs_v2 under a moved id goes to that id's block (side 2)
SCALED["fx_pairs"] = """
SELECT CASE WHEN n.id = id THEN id ELSE id - 1 + 2000000 END AS doc_id, CASE WHEN n.id = id THEN text ELSE n.text END AS old_text,
  CASE WHEN n.id < id THEN text WHEN n.side = 0 AND id % 5 = 0 THEN n.text || chr(10) || 'changed line' ELSE n.text END AS new_text
FROM (SELECT id, text, explode(near) AS n FROM (
  SELECT *, collect_list(struct(id, side, text)) OVER (PARTITION BY block ORDER BY id RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM (
    SELECT shiftright(doc_id, 8) AS block, doc_id AS id, 0 AS side, text FROM documents WHERE doc_id IS NOT NULL
    UNION ALL SELECT shiftright(doc_id + 1, 8), doc_id, 1, text FROM documents WHERE (doc_id & 255) = 255
    UNION ALL SELECT shiftright(doc_id + 1000000, 8), doc_id + 1000000, 2, text FROM documents WHERE doc_id % 11 = 0) m) w WHERE side = 0) p
WHERE (n.id < id AND n.side < 2) OR (n.id = id AND (n.side = 2 OR id % 7 <> 0))
"""
