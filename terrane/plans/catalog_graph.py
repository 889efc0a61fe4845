"""Queries over resolution, graph construction and graph export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, rules
from ..operators import build, graph, iterate, resolve
from .derived import oracle, query, view
from .registry import register

WS = "workspace_id"

# --- shared oracle fragments -------------------------------------------------

NOISE = "list_has_any(string_split(lower({c}), '.'), ['venv','env','node_modules','site-packages','__pycache__','dist','build'])"


def semantic(c: str) -> str:
    marks = " OR ".join(f"contains({c}, '{m}')" for m in rules.SYNTAX_DUMP_MARKERS)
    return f"(coalesce(trim({c}), '') <> '' AND NOT ({marks} OR regexp_matches(trim({c}), '[ \\t\\n=<>]') OR starts_with({c}, 'ast.')))"


def noise(c: str) -> str:
    return NOISE.format(c=c)


SUFFIX_INDEX = """
SELECT workspace_id, suffix, CASE WHEN count(*) FILTER (WHERE d = md) = 1 THEN min(module_name) FILTER (WHERE d = md) END AS target
FROM (SELECT *, min(d) OVER (PARTITION BY workspace_id, suffix) AS md FROM (
  SELECT DISTINCT workspace_id, module_name, len(p) AS d, array_to_string(p[i:], '.') AS suffix
  FROM (SELECT workspace_id, module_name, string_split(module_name, '.') AS p FROM fx_modules) s, unnest(range(2, len(p) + 1)) AS u(i)) a) b
GROUP BY workspace_id, suffix
"""

def resolved_sql(imports: str, mods: str, suffixes: str) -> str:
    """Imports with their targets; every lookup is a join on equal keys."""
    parts = f"SELECT workspace_id, raw_module, string_split(raw_module, '.') AS p FROM (SELECT DISTINCT workspace_id, raw_module FROM {imports}) d"
    within = """(SELECT c.workspace_id, c.raw_module, max_by(m.module_name, length(m.module_name)) AS hit FROM (
    SELECT workspace_id, raw_module, array_to_string({slice}, '.') AS key FROM ({parts}) s, unnest(range({first}, len(p))) AS u(k)) c
  JOIN {mods} m ON m.workspace_id = c.workspace_id AND m.module_name = c.key GROUP BY c.workspace_id, c.raw_module)"""
    prefix = within.format(slice="p[1:k]", first=1, parts=parts, mods=mods)
    tail = within.format(slice="p[k:]", first=2, parts=parts, mods=mods)
    return f"""
SELECT i.*, coalesce(m1.module_name, m2.module_name, pre.hit, post.hit, CASE WHEN contains(i.raw_module, '.') THEN coalesce(s1.target, s2.target) END, i.raw_module) AS target
FROM {imports} i
LEFT JOIN {mods} m1 ON m1.workspace_id = i.workspace_id AND m1.module_name = i.raw_module
LEFT JOIN {mods} m2 ON m2.workspace_id = i.workspace_id AND m2.module_name = i.raw_module || '.' || i.name
LEFT JOIN {prefix} pre ON pre.workspace_id = i.workspace_id AND pre.raw_module = i.raw_module
LEFT JOIN {tail} post ON post.workspace_id = i.workspace_id AND post.raw_module = i.raw_module
LEFT JOIN {suffixes} s1 ON s1.workspace_id = i.workspace_id AND s1.suffix = i.raw_module
LEFT JOIN {suffixes} s2 ON s2.workspace_id = i.workspace_id AND s2.suffix = i.raw_module || '.' || i.name
WHERE {semantic('i.raw_module')} AND NOT {noise('i.raw_module')}
"""


RESOLVED_IMPORTS = resolved_sql("fx_imports", "mods", "suffix_index")

IMPORT_CTES = {
    "mods": "SELECT DISTINCT workspace_id, module_name FROM fx_modules",
    "suffix_index": SUFFIX_INDEX,
    "resolved": RESOLVED_IMPORTS,
}
SCOPE = """
SELECT workspace_id, module_name, 'symbol' AS kind, coalesce(alias, name) AS name,
  arg_max(CASE WHEN ends_with(target, '.' || name) THEN target ELSE target || '.' || name END, ord) AS target
FROM resolved WHERE target <> module_name AND type = 'from_import' GROUP BY ALL
UNION ALL
SELECT workspace_id, module_name, 'module', name, arg_max(target, (strength, ord)) FROM (
  SELECT workspace_id, module_name, coalesce(alias, string_split(target, '.')[-1]) AS name, target, 1 AS strength, ord FROM resolved WHERE target <> module_name AND type <> 'from_import'
  UNION ALL SELECT workspace_id, module_name, string_split(target, '.')[1], string_split(target, '.')[1], 0, ord FROM resolved WHERE target <> module_name AND type <> 'from_import') x
GROUP BY workspace_id, module_name, name
"""
RESOLVED_BASES = f"""
SELECT b.*, CASE WHEN NOT contains(raw_base, '.') THEN coalesce(c.symbol_id, s.target, raw_base)
  ELSE coalesce(coalesce(m.target, s.target) || substring(raw_base, strpos(raw_base, '.')), raw_base) END AS target
FROM fx_bases b
LEFT JOIN fx_symbols c ON c.workspace_id = b.workspace_id AND c.module_name = b.module_name AND c.kind = 'class' AND c.name = string_split(raw_base, '.')[1]
LEFT JOIN scope s ON s.workspace_id = b.workspace_id AND s.module_name = b.module_name AND s.kind = 'symbol' AND s.name = string_split(raw_base, '.')[1]
LEFT JOIN scope m ON m.workspace_id = b.workspace_id AND m.module_name = b.module_name AND m.kind = 'module' AND m.name = string_split(raw_base, '.')[1]
WHERE {semantic('raw_base')}
"""
RESOLVED_CALLS = f"""
SELECT * FROM (
  SELECT c.*, coalesce(mt.id, fn.id, CASE WHEN EXISTS (SELECT 1 FROM fx_modules m WHERE m.workspace_id = c.workspace_id
      AND m.module_name = regexp_extract(c.raw_target, '^(.*)\\.[^.]*$', 1)) THEN c.raw_target END) AS target
  FROM fx_calls c
  LEFT JOIN (SELECT workspace_id, module_name, name, arg_min(symbol_id, ord) AS id FROM fx_symbols WHERE kind = 'method' GROUP BY ALL) mt
    ON mt.workspace_id = c.workspace_id AND mt.module_name = c.module_name AND mt.name = string_split(c.raw_target, '.')[-1]
  LEFT JOIN (SELECT workspace_id, module_name, name, min(symbol_id) AS id FROM fx_symbols WHERE kind = 'function' GROUP BY ALL) fn
    ON fn.workspace_id = c.workspace_id AND fn.module_name = c.module_name AND fn.name = string_split(c.raw_target, '.')[-1]
  WHERE {semantic('c.raw_target')} AND NOT {noise('c.raw_target')}) t WHERE target IS NOT NULL
"""
GRAPH_CTES = {**IMPORT_CTES, "scope": SCOPE, "resolved_bases": RESOLVED_BASES, "resolved_calls": RESOLVED_CALLS}


# --- resolution --------------------------------------------------------------

@register("semantic_ids", oracle(f"SELECT workspace_id, k, ref, {semantic('ref')} AS ok FROM (SELECT workspace_id, k, CASE WHEN k % 6 = 5 THEN 'Call(' || ref || ')' WHEN k % 6 = 4 THEN ref || ' = x' ELSE ref END AS ref FROM fx_refs) r"))
def _(spark, sf):
    refs = query(spark, sf, "SELECT workspace_id, k, CASE WHEN k % 6 = 5 THEN 'Call(' || ref || ')' WHEN k % 6 = 4 THEN ref || ' = x' ELSE ref END AS ref FROM fx_refs")
    return refs.withColumn("ok", ids.is_semantic_id("ref"))


@register("noise_namespaces", oracle(f"SELECT workspace_id, id, {noise('id')} AS noisy FROM fx_nodes"))
def _(spark, sf):
    return view(spark, sf, "fx_nodes").select(WS, "id", ids.is_noise_namespace("id").alias("noisy"))


@register("module_suffix_index", oracle("SELECT * FROM suffix_index", suffix_index=SUFFIX_INDEX))
def _(spark, sf):
    return resolve.module_suffix_index(view(spark, sf, "fx_modules"))


@register("absolutize_imports", oracle("""
SELECT workspace_id, module_name, ord, lvl AS level, raw_module,
  CASE WHEN lvl = 0 THEN raw_module ELSE array_to_string(list_concat(pkg[1:greatest(len(pkg) - (lvl - 1), 0)], string_split(raw_module, '.')), '.') END AS abs_module
FROM (SELECT workspace_id, module_name, ord, CAST(ord % 4 AS INT) AS lvl, raw_module, string_split(module_name, '.')[1:-2] AS pkg FROM fx_imports) i"""))
def _(spark, sf):
    imports = view(spark, sf, "fx_imports").withColumn("level", (F.col("ord") % 4).cast("int"))
    return resolve.absolutize_imports(imports).select(WS, "module_name", "ord", "level", "raw_module", "abs_module")


def js_specs(spark, sf):
    return view(spark, sf, "fx_js_specs")


@register("resolve_js_specifiers", oracle("""
SELECT workspace_id, importer, spec, CASE WHEN spec = 'react' THEN spec ELSE regexp_replace(replace(target_path, '/', '.'), '[.](tsx|ts|js)$', '') END AS target FROM fx_js_specs"""))
def _(spark, sf):
    specs = js_specs(spark, sf)
    return resolve.resolve_js_specifiers(specs, view(spark, sf, "fx_modules")).select(WS, "importer", "spec", "target")


def resolved_imports(spark, sf):
    return resolve.resolve_imports(view(spark, sf, "fx_imports"), view(spark, sf, "fx_modules"))


@register("resolve_imports", oracle("SELECT workspace_id, module_name, ord, raw_module, target FROM resolved", **IMPORT_CTES))
def _(spark, sf):
    return resolved_imports(spark, sf).select(WS, "module_name", "ord", "raw_module", "target")


def resolved_calls(spark, sf):
    return resolve.resolve_calls(view(spark, sf, "fx_calls"), view(spark, sf, "fx_symbols"), view(spark, sf, "fx_modules"))


@register("resolve_calls", oracle("SELECT workspace_id, module_name, caller_id, raw_target, target FROM resolved_calls", **GRAPH_CTES))
def _(spark, sf):
    return resolved_calls(spark, sf)


def resolved_bases(spark, sf):
    scope = resolve.import_scope(resolved_imports(spark, sf))
    return resolve.resolve_bases(view(spark, sf, "fx_bases"), view(spark, sf, "fx_symbols").filter("kind = 'class'"), scope)


@register("resolve_bases", oracle("SELECT workspace_id, module_name, class_id, raw_base, target FROM resolved_bases", **GRAPH_CTES))
def _(spark, sf):
    return resolved_bases(spark, sf)


@register("import_scope", oracle("SELECT * FROM scope", **GRAPH_CTES))
def _(spark, sf):
    return resolve.import_scope(resolved_imports(spark, sf))


# --- construction ------------------------------------------------------------

@register("module_nodes", oracle("""
SELECT workspace_id, module_name AS id, 'module' AS type, path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' ELSE 'typescript' END AS language, false AS is_external FROM fx_modules"""))
def _(spark, sf):
    return build.module_nodes(view(spark, sf, "fx_modules")).select(WS, "id", "type", "path", "language", "is_external")


@register("import_edges", oracle("""
SELECT DISTINCT workspace_id, module_name AS source, target, 'imports' AS type, target NOT IN (SELECT module_name FROM fx_modules) AS to_external FROM resolved WHERE target <> module_name""", **IMPORT_CTES))
def _(spark, sf):
    resolved, modules = resolved_imports(spark, sf), view(spark, sf, "fx_modules")
    stubs = build.import_stubs(resolved, modules).select(WS, F.col("id").alias("target"), F.lit(True).alias("stub"))
    edges = build.import_edges(resolved).join(stubs, [WS, "target"], "left")
    return edges.select(WS, "source", "target", "type", F.coalesce("stub", F.lit(False)).alias("to_external"))


@register("symbol_nodes", oracle("""
SELECT workspace_id, symbol_id AS id, CASE kind WHEN 'class' THEN 'class' ELSE 'function' END AS type, module_name AS module, class_name AS class,
  module_name || coalesce('.' || class_name, '') AS container FROM fx_symbols"""))
def _(spark, sf):
    symbols = view(spark, sf, "fx_symbols")
    owner = build.contains_edges(symbols).select(WS, F.col("target").alias("id"), F.col("source").alias("container"))
    return build.symbol_nodes(symbols).join(owner, [WS, "id"]).select(WS, "id", "type", "module", "class", "container")


INHERIT = f"SELECT DISTINCT workspace_id, class_id AS source, target, 'inherits' AS type FROM resolved_bases WHERE target <> class_id AND NOT {noise('target')}"


@register("inherit_edges", oracle("""
SELECT e.*, coalesce(s.external, false) AS stub_external FROM inh e LEFT JOIN (
  SELECT DISTINCT workspace_id, target, (workspace_id, regexp_extract(target, '^(.*)\\.[^.]*$', 1)) NOT IN (SELECT (workspace_id, module_name) FROM fx_modules) AS external FROM inh
  WHERE (workspace_id, target) NOT IN (SELECT (workspace_id, symbol_id) FROM fx_symbols WHERE kind = 'class')) s
ON s.workspace_id = e.workspace_id AND s.target = e.target""", **GRAPH_CTES, inh=INHERIT))
def _(spark, sf):
    bases, symbols = resolved_bases(spark, sf), view(spark, sf, "fx_symbols")
    stubs = build.base_stubs(bases, symbols.filter("kind = 'class'"), view(spark, sf, "fx_modules"))
    stubs = stubs.select(WS, F.col("id").alias("target"), F.col("is_external").alias("stub_external"))
    edges = build.inherit_edges(bases).join(stubs, [WS, "target"], "left")
    return edges.select(WS, "source", "target", "type", F.coalesce("stub_external", F.lit(False)).alias("stub_external"))


@register("call_edges", oracle("""
SELECT DISTINCT workspace_id, caller_id AS source, target, 'calls' AS type, (workspace_id, target) NOT IN (SELECT (workspace_id, symbol_id) FROM fx_symbols) AS to_stub FROM resolved_calls WHERE target <> caller_id""", **GRAPH_CTES))
def _(spark, sf):
    calls, symbols = resolved_calls(spark, sf), view(spark, sf, "fx_symbols")
    stubs = build.call_stubs(calls, symbols).select(WS, F.col("id").alias("target"), F.lit(True).alias("s"))
    edges = build.call_edges(calls).join(stubs, [WS, "target"], "left")
    return edges.select(WS, "source", "target", "type", F.coalesce("s", F.lit(False)).alias("to_stub"))


DOUBLED = "SELECT * FROM fx_edges UNION ALL SELECT workspace_id, source, target, 'imports' FROM fx_edges WHERE type = 'contains'"


@register("merge_graph", oracle("SELECT workspace_id, source, target, type FROM fx_edges"))
def _(spark, sf):
    return build.merge_edges(query(spark, sf, DOUBLED))


BUILT_EDGES = f"""
SELECT workspace_id, source, target, arg_min(type, CASE type WHEN 'contains' THEN 1 WHEN 'inherits' THEN 2 WHEN 'imports' THEN 3 ELSE 4 END) AS type FROM (
  SELECT workspace_id, module_name AS source, target, 'imports' AS type FROM resolved WHERE target <> module_name
  UNION ALL SELECT workspace_id, module_name || coalesce('.' || class_name, ''), symbol_id, 'contains' FROM fx_symbols
  UNION ALL SELECT * FROM inh
  UNION ALL SELECT workspace_id, caller_id, target, 'calls' FROM resolved_calls WHERE target <> caller_id) u GROUP BY workspace_id, source, target
"""


def built_graph(spark, sf, level=3):
    parts = [view(spark, sf, f"fx_{n}") for n in ("modules", "imports", "symbols", "calls", "bases")]
    return build.build_graph(*parts, level=level)


@register("build_graph", oracle("SELECT * FROM built", **GRAPH_CTES, inh=INHERIT, built=BUILT_EDGES))
def _(spark, sf):
    return built_graph(spark, sf)[1]


@register("build_graph_nodes", oracle(f"""
SELECT workspace_id, id, type, is_external FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, id ORDER BY stub, t) AS rn FROM (
  SELECT workspace_id, module_name AS id, 'module' AS type, false AS is_external, 0 AS stub, 1 AS t FROM fx_modules
  UNION ALL SELECT workspace_id, symbol_id, CASE kind WHEN 'class' THEN 'class' ELSE 'function' END, false, 0, CASE kind WHEN 'class' THEN 2 ELSE 3 END FROM fx_symbols
  UNION ALL SELECT workspace_id, target, 'module', true, 1, 1 FROM resolved
  UNION ALL SELECT workspace_id, target, 'class', (workspace_id, regexp_extract(target, '^(.*)\\.[^.]*$', 1)) NOT IN (SELECT (workspace_id, module_name) FROM fx_modules), 1, 2 FROM inh
  UNION ALL SELECT workspace_id, target, 'function', true, 1, 3 FROM resolved_calls) u) v WHERE rn = 1""", **GRAPH_CTES, inh=INHERIT))
def _(spark, sf):
    return built_graph(spark, sf)[0].select(WS, "id", "type", "is_external")


# --- graph queries -----------------------------------------------------------

def nodes_edges(spark, sf):
    return view(spark, sf, "fx_nodes"), view(spark, sf, "fx_edges")


KEPT = f"SELECT * FROM fx_nodes WHERE {semantic('id')} AND NOT {noise('id')}"
KEPT2 = f"SELECT * FROM fx_nodes WHERE {semantic('id')} AND NOT {noise('id')} AND (type IN ('module', 'class') OR (type = 'function' AND class IS NULL))"
INDUCED = "SELECT e.* FROM fx_edges e WHERE (workspace_id, source) IN (SELECT (workspace_id, id) FROM kept) AND (workspace_id, target) IN (SELECT (workspace_id, id) FROM kept)"
PAIRS = "SELECT workspace_id, source AS id, target AS o FROM induced UNION ALL SELECT workspace_id, target, source FROM induced"
RISK = """
SELECT *, CASE WHEN coupling >= 30 OR complexity >= 25 THEN 'high' WHEN coupling >= 12 OR complexity >= 10 THEN 'medium' ELSE 'low' END AS risk FROM (
  SELECT n.*, CAST(coalesce(c.coupling, 0) AS BIGINT) AS coupling, CAST(coalesce(c.complexity, 0) AS BIGINT) AS complexity
  FROM kept n LEFT JOIN (SELECT workspace_id, id, count(*) AS coupling, count(DISTINCT o) AS complexity FROM pairs GROUP BY ALL) c ON c.workspace_id = n.workspace_id AND c.id = n.id) r
"""
EXPORT_CTES = {"kept": KEPT, "induced": INDUCED, "pairs": PAIRS, "risky": RISK}


@register("keep_nodes", oracle("SELECT workspace_id, id, type FROM kept", kept=KEPT2))
def _(spark, sf):
    return graph.keep_nodes(view(spark, sf, "fx_nodes"), 2).select(WS, "id", "type")


@register("allowed_edges", oracle("SELECT * FROM fx_edges WHERE type IN ('imports', 'contains', 'inherits')"))
def _(spark, sf):
    return graph.allowed_edges(view(spark, sf, "fx_edges"), 2)


@register("induced_subgraph", oracle("SELECT * FROM induced", kept=KEPT2, induced=INDUCED))
def _(spark, sf):
    nodes, edges = nodes_edges(spark, sf)
    return graph.induced_subgraph(graph.keep_nodes(nodes, 2), edges)


@register("node_risk", oracle("SELECT workspace_id, id, coupling, complexity, risk FROM risky", **EXPORT_CTES))
def _(spark, sf):
    nodes, edges = nodes_edges(spark, sf)
    kept = graph.keep_nodes(nodes, 3)
    return graph.node_risk(kept, graph.induced_subgraph(kept, edges)).select(WS, "id", "coupling", "complexity", "risk")


@register("parent_ids", oracle("SELECT workspace_id, id, CASE type WHEN 'class' THEN module WHEN 'function' THEN module || coalesce('.' || class, '') END AS parent_id FROM fx_nodes"))
def _(spark, sf):
    return graph.with_parent(view(spark, sf, "fx_nodes")).select(WS, "id", "parent_id")


@register("display_names", oracle("SELECT workspace_id, id, string_split(id, '.')[-1] AS display_name FROM fx_nodes"))
def _(spark, sf):
    return view(spark, sf, "fx_nodes").select(WS, "id", ids.display_name("id").alias("display_name"))


@register("edge_ids", oracle(r"SELECT workspace_id, source, target, regexp_replace(source || '>' || target || ':' || type, '[^A-Za-z0-9_:\-.>]+', '_', 'g') AS id FROM fx_edges"))
def _(spark, sf):
    return view(spark, sf, "fx_edges").select(WS, "source", "target", ids.edge_id("source", "target", "type").alias("id"))


@register("export_graph_nodes", oracle("""
SELECT workspace_id, id, string_split(id, '.')[-1] AS display_name, type, risk, complexity, coupling, path,
  CASE type WHEN 'class' THEN module WHEN 'function' THEN module || coalesce('.' || class, '') END AS parent_id, is_external FROM risky""", **EXPORT_CTES))
def _(spark, sf):
    nodes, _ = graph.export_graph(*nodes_edges(spark, sf), level=3)
    return nodes.select(WS, "id", "display_name", "type", "risk", "complexity", "coupling", "path", "parent_id", "is_external")


@register("export_graph_edges", oracle(r"""
SELECT workspace_id, regexp_replace(source || '>' || target || ':' || type, '[^A-Za-z0-9_:\-.>]+', '_', 'g') AS id, source, target, type FROM induced WHERE type <> 'calls'""", kept=KEPT2, induced=INDUCED))
def _(spark, sf):
    return graph.export_graph(*nodes_edges(spark, sf), level=2)[1]


CHANGED = "SELECT DISTINCT workspace_id, module_name AS id FROM fx_changes WHERE removes_symbol"


@register("lookup_nodes", oracle("SELECT n.* FROM fx_nodes n WHERE (workspace_id, id) IN (SELECT (workspace_id, id) FROM changed)", changed=CHANGED))
def _(spark, sf):
    return graph.lookup_nodes(view(spark, sf, "fx_nodes"), query(spark, sf, CHANGED))


@register("dependencies", oracle("SELECT DISTINCT e.workspace_id, e.source AS id, e.target AS dependency FROM fx_edges e WHERE (workspace_id, source) IN (SELECT (workspace_id, id) FROM changed)", changed=CHANGED))
def _(spark, sf):
    return graph.dependencies(view(spark, sf, "fx_edges"), query(spark, sf, CHANGED))


@register("dependents", oracle("SELECT DISTINCT e.workspace_id, e.target AS id, e.source AS dependent FROM fx_edges e WHERE (workspace_id, target) IN (SELECT (workspace_id, id) FROM changed)", changed=CHANGED))
def _(spark, sf):
    return graph.dependents(view(spark, sf, "fx_edges"), query(spark, sf, CHANGED))


EXTERNAL = "SELECT DISTINCT workspace_id, id FROM fx_nodes WHERE id IN ('ext_pkg_0', 'ext_pkg_1')"
HOPS = """
SELECT workspace_id, id, CAST(min(hop) AS INT) AS hop FROM (
  SELECT workspace_id, id, 0 AS hop FROM centers
  UNION ALL SELECT a.workspace_id, a.o, 1 FROM centers c JOIN around a ON a.workspace_id = c.workspace_id AND a.id = c.id
  UNION ALL SELECT DISTINCT b.workspace_id, b.o, 2 FROM centers c JOIN around a ON a.workspace_id = c.workspace_id AND a.id = c.id JOIN around b ON b.workspace_id = a.workspace_id AND b.id = a.o) h
GROUP BY workspace_id, id
"""
HOP_CTES = {
    "around": "SELECT workspace_id, source AS id, target AS o FROM fx_edges UNION SELECT workspace_id, target, source FROM fx_edges",
    "centers": EXTERNAL, "hops": HOPS,
}


@register("k_hop", oracle("SELECT * FROM hops", **HOP_CTES))
def _(spark, sf):
    nodes, edges = nodes_edges(spark, sf)
    return iterate.k_hop(nodes, edges, query(spark, sf, EXTERNAL), 2)


@register("export_neighborhood", oracle("SELECT workspace_id, id, coupling, complexity, risk FROM risky", **HOP_CTES,
    kept=f"SELECT n.* FROM fx_nodes n WHERE (workspace_id, id) IN (SELECT (workspace_id, id) FROM hops) AND {semantic('id')} AND NOT {noise('id')}",
    induced=INDUCED, pairs=PAIRS, risky=RISK))
def _(spark, sf):
    nodes, edges = nodes_edges(spark, sf)
    return graph.export_neighborhood(nodes, edges, query(spark, sf, EXTERNAL), 2, 3)[0].select(WS, "id", "coupling", "complexity", "risk")


IMPACT_EDGES = "SELECT workspace_id, source, target, type FROM fx_edges UNION ALL SELECT 'deps', source, target, type FROM fx_deps"
IMPACT_CHANGES = "SELECT workspace_id, path, module_name, removes_symbol FROM fx_changes UNION ALL SELECT 'deps', label, id, false FROM fx_tree WHERE kind = 'module'"


@register("change_impact", oracle("""
SELECT workspace_id, path, module_name, removes_symbol, n AS num_affected, CASE WHEN removes_symbol THEN 'critical' WHEN n > 20 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END AS risk_level FROM (
  SELECT c.*, (SELECT count(DISTINCT source) FROM ie e WHERE e.workspace_id = c.workspace_id AND e.target = c.module_name) AS n FROM ic c) c""",
    ie=IMPACT_EDGES, ic=IMPACT_CHANGES))
def _(spark, sf):
    return graph.change_impact(query(spark, sf, IMPACT_EDGES), query(spark, sf, IMPACT_CHANGES))


@register("affected_dependents", oracle("SELECT DISTINCT c.workspace_id, c.path, e.source AS dependent FROM fx_changes c JOIN fx_edges e ON e.workspace_id = c.workspace_id AND e.target = c.module_name"))
def _(spark, sf):
    return graph.affected_dependents(view(spark, sf, "fx_edges"), view(spark, sf, "fx_changes"))


LABELLED = "SELECT workspace_id, id, CASE WHEN type = 'class' THEN upper(id) END AS label FROM fx_nodes"


@register("adjacency_with_labels", oracle("""
SELECT a.workspace_id, a.id, direction, other, coalesce(l.label, other) AS label, type FROM (
  SELECT workspace_id, source AS id, 'out' AS direction, target AS other, type FROM fx_edges UNION ALL SELECT workspace_id, target, 'in', source, type FROM fx_edges) a
JOIN (SELECT DISTINCT workspace_id, id FROM fx_nodes) n ON n.workspace_id = a.workspace_id AND n.id = a.id
LEFT JOIN labelled l ON l.workspace_id = a.workspace_id AND l.id = a.other""", labelled=LABELLED))
def _(spark, sf):
    nodes = query(spark, sf, LABELLED)
    return graph.adjacency_with_labels(nodes, view(spark, sf, "fx_edges"), nodes)


NEWER = "SELECT workspace_id, module_name AS id, 'function' AS type, true AS is_external FROM fx_changes UNION ALL SELECT workspace_id, module_name || '.fresh', 'class', false FROM fx_changes WHERE removes_symbol"


@register("merge_snapshots", oracle("""
SELECT * FROM newer UNION ALL SELECT workspace_id, id, type, is_external FROM fx_nodes WHERE (workspace_id, id) NOT IN (SELECT (workspace_id, id) FROM newer)""", newer=NEWER))
def _(spark, sf):
    return graph.merge_snapshots(view(spark, sf, "fx_nodes").select(WS, "id", "type", "is_external"), query(spark, sf, NEWER))


RAW_EDGES = "SELECT workspace_id, CASE WHEN type <> 'calls' THEN source END AS source, CASE WHEN type = 'calls' THEN source END AS \"from\", target AS \"to\", CASE WHEN type = 'inherits' THEN '' WHEN type = 'imports' THEN 'Imports' ELSE type END AS kind FROM fx_edges UNION ALL SELECT workspace_id, source, NULL, NULL, type FROM fx_edges"


@register("normalize_payload", oracle("""
SELECT workspace_id, source, target, type, source || '->' || target || ':' || type AS id FROM (
  SELECT workspace_id, source, target, CASE type WHEN 'imports' THEN 'import' WHEN 'calls' THEN 'call' WHEN 'inherits' THEN 'unknown' ELSE type END AS type FROM fx_edges) e"""))
def _(spark, sf):
    return graph.normalize_edges(query(spark, sf, RAW_EDGES.replace('"', "`")))


@register("normalize_nodes", oracle("SELECT workspace_id, id, id AS label, type AS kind FROM fx_nodes"))
def _(spark, sf):
    return graph.normalize_nodes(view(spark, sf, "fx_nodes")).select(WS, "id", "label", "kind")


@register("graph_stats", oracle("""
SELECT workspace_id, 'node' AS what, coalesce(type, 'all') AS type, count(*) AS n FROM fx_nodes GROUP BY GROUPING SETS ((workspace_id, type), (workspace_id))
UNION ALL SELECT workspace_id, 'edge', coalesce(type, 'all'), count(*) FROM fx_edges GROUP BY GROUPING SETS ((workspace_id, type), (workspace_id))"""))
def _(spark, sf):
    return graph.graph_stats(*nodes_edges(spark, sf))


META = "SELECT DISTINCT workspace_id, 2 AS builder_version FROM fx_nodes UNION ALL SELECT DISTINCT 'clean_' || workspace_id, CASE WHEN workspace_id = 'w0' THEN 1 ELSE 2 END FROM fx_nodes UNION ALL SELECT 'empty', 1"
META_NODES = f"SELECT workspace_id, id FROM fx_nodes UNION ALL SELECT 'clean_' || workspace_id, id FROM fx_nodes WHERE type = 'class'"


@register("snapshot_needs_rebuild", oracle(f"""
SELECT m.workspace_id, coalesce((SELECT count(*) > 0 AND (bool_or({noise('id')}) OR m.builder_version < 2) FROM mn n WHERE n.workspace_id = m.workspace_id), false) AS needs_rebuild FROM meta m""", meta=META, mn=META_NODES))
def _(spark, sf):
    return graph.snapshot_needs_rebuild(query(spark, sf, META_NODES), query(spark, sf, META))


@register("risky_modules", oracle("""
SELECT m.workspace_id, m.path, coalesce(d.coupling, 0) AS coupling, coalesce(d.complexity, 0) AS complexity, coalesce(i.n, 0) AS num_affected,
  CASE WHEN coalesce(d.coupling, 0) >= 30 OR coalesce(d.complexity, 0) >= 25 THEN 'high' WHEN coalesce(d.coupling, 0) >= 12 OR coalesce(d.complexity, 0) >= 10 THEN 'medium' ELSE 'low' END AS risk
FROM fx_modules m
LEFT JOIN (SELECT workspace_id, id, count(*) AS coupling, count(DISTINCT o) AS complexity FROM (
    SELECT workspace_id, source AS id, target AS o FROM ie UNION ALL SELECT workspace_id, target, source FROM ie) p GROUP BY ALL) d ON d.workspace_id = m.workspace_id AND d.id = m.module_name
LEFT JOIN (SELECT workspace_id, target, count(*) AS n FROM ie GROUP BY ALL) i ON i.workspace_id = m.workspace_id AND i.target = m.module_name""",
    **IMPORT_CTES, ie="SELECT DISTINCT workspace_id, module_name AS source, target FROM resolved WHERE target <> module_name"))
def risky_modules(spark, sf):
    """Which modules are risky, and how many others depend on them."""
    modules = view(spark, sf, "fx_modules")
    edges = build.import_edges(resolve.resolve_imports(view(spark, sf, "fx_imports"), modules))
    scored = graph.node_risk(build.module_nodes(modules), edges)
    impact = graph.change_impact(edges, scored.select(WS, "path", F.col("id").alias("module_name"), "coupling", "complexity", "risk", F.lit(False).alias("removes_symbol")))
    return impact.select(WS, "path", "coupling", "complexity", "num_affected", "risk")


@register("connected_components", oracle("SELECT workspace_id, id, component FROM cc", rec="""
cc(workspace_id, id, component) USING KEY (workspace_id, id) AS (
  SELECT workspace_id, id, id FROM fx_nodes
  UNION
  SELECT a.workspace_id, a.o, min(c.component) FROM cc c JOIN around a ON a.workspace_id = c.workspace_id AND a.id = c.id
    JOIN recurring.cc r ON r.workspace_id = a.workspace_id AND r.id = a.o WHERE c.component < r.component GROUP BY a.workspace_id, a.o)""",
    inner_edges="SELECT e.* FROM fx_edges e WHERE (workspace_id, source) IN (SELECT (workspace_id, id) FROM fx_nodes) AND (workspace_id, target) IN (SELECT (workspace_id, id) FROM fx_nodes)",
    around="SELECT workspace_id, source AS id, target AS o FROM inner_edges UNION SELECT workspace_id, target, source FROM inner_edges"))
def _(spark, sf):
    nodes, edges = nodes_edges(spark, sf)
    return iterate.connected_components(nodes, edges)
