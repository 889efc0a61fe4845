"""Queries over folder trees and rolled-up edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, hierarchy as tree_ops
from ..operators.intervals import interval_labels
from ..operators.iterate import ancestor_closure
from .derived import oracle, query, stored, view
from .registry import register

WS = "workspace_id"
TREE = "SELECT 'w' AS workspace_id, id, kind, label, CAST(NULL AS STRING) AS path, parent_id, is_external FROM fx_tree"
DEPS = "SELECT 'w' AS workspace_id, source, target, CASE type WHEN 'imports' THEN 'import' WHEN 'calls' THEN 'call' ELSE type END AS kind FROM fx_deps"
# what is drawn: folders and internal modules; symbols roll up to them
SHOWN = "SELECT 'w' AS workspace_id, id FROM fx_tree WHERE kind IN ('folder', 'module') AND NOT is_external"

ANC = """anc(id, ancestor, distance) AS (
  SELECT id, parent_id, 1 FROM fx_tree WHERE parent_id IS NOT NULL
  UNION ALL SELECT a.id, t.parent_id, a.distance + 1 FROM anc a JOIN fx_tree t ON t.id = a.ancestor WHERE t.parent_id IS NOT NULL),
near(id, shown) AS (SELECT id, arg_min(x, d) FROM (
  SELECT id, id AS x, 0 AS d FROM fx_tree UNION ALL SELECT id, ancestor, distance FROM anc) u WHERE x IN (SELECT id FROM shown) GROUP BY id),
rolled(workspace_id, source, target, kind, count) AS (
  SELECT 'w', s.shown, t.shown, d.kind, count(*) FROM deps d JOIN near s ON s.id = d.source JOIN near t ON t.id = d.target
  WHERE s.shown <> t.shown AND (s.shown, t.shown) NOT IN (SELECT (id, ancestor) FROM anc) AND (t.shown, s.shown) NOT IN (SELECT (id, ancestor) FROM anc) GROUP BY ALL)"""


def tree_oracle(body: str, **extra: str) -> str:
    return oracle(body, rec=ANC, shown=SHOWN, deps=DEPS, **extra)


def tree(spark, sf):
    return query(spark, sf, TREE)


def tree_labels(spark, sf):
    """Interval labels of the tree: an index of the snapshot, written once like the tree itself."""
    return stored(spark, sf, "tree_labels", lambda: interval_labels(tree(spark, sf)))


def labelled(spark, sf):
    return tree(spark, sf), tree_labels(spark, sf)


def rolled_up(spark, sf):
    return tree_ops.rollup_edges(query(spark, sf, DEPS), labelled(spark, sf)[1], query(spark, sf, SHOWN))


DECLARED = "SELECT workspace_id, id, type, CASE WHEN type = 'class' THEN module WHEN type = 'module' THEN id END AS parent_id FROM fx_nodes"


@register("resolve_parents", oracle("""
SELECT n.workspace_id, n.id, coalesce(
  (SELECT min(p.id) FROM fx_nodes p WHERE p.workspace_id = n.workspace_id AND p.id = n.parent_id AND p.id <> n.id),
  (SELECT min(e.source) FROM fx_edges e WHERE e.workspace_id = n.workspace_id AND e.target = n.id AND e.type = 'contains' AND (e.workspace_id, e.source) IN (SELECT (workspace_id, id) FROM fx_nodes)),
  px.pid) AS parent_id FROM declared n
LEFT JOIN (SELECT workspace_id, id, arg_max(pid, length(pid)) AS pid FROM (
    SELECT d.workspace_id, d.id, array_to_string(string_split(d.id, '.')[1:k], '.') AS pid FROM declared d, unnest(range(1, len(string_split(d.id, '.')))) AS u(k) WHERE d.type <> 'module') c
  WHERE (workspace_id, pid) IN (SELECT (workspace_id, id) FROM fx_nodes) GROUP BY ALL) px ON px.workspace_id = n.workspace_id AND px.id = n.id""", declared=DECLARED))
def _(spark, sf):
    return tree_ops.resolve_parents(query(spark, sf, DECLARED), view(spark, sf, "fx_edges"))


ORPHANS = """SELECT workspace_id, id, type AS kind, id AS label, path, CASE WHEN type <> 'module' THEN module END AS parent_id, is_external FROM fx_nodes"""
FOLDERS = """
SELECT workspace_id, id, CASE WHEN kind IN ('module', 'class', 'function') THEN kind ELSE 'unknown' END AS kind, label, path,
  CASE WHEN parent_id IS NOT NULL THEN parent_id WHEN is_external THEN 'folder::__external__' ELSE 'folder::' || regexp_replace(path, '/[^/]*$', '') END AS parent_id, is_external FROM orphans
UNION ALL SELECT DISTINCT workspace_id, 'folder::' || dir, 'folder', string_split(dir, '/')[-1], dir, CASE WHEN contains(dir, '/') THEN 'folder::' || regexp_replace(dir, '/[^/]*$', '') END, false FROM (
  SELECT workspace_id, array_to_string(string_split(path, '/')[1:i], '/') AS dir FROM orphans, unnest(range(1, len(string_split(path, '/')))) AS u(i) WHERE parent_id IS NULL AND NOT is_external) d
UNION ALL SELECT DISTINCT workspace_id, 'folder::__external__', 'folder', 'External packages', NULL, NULL, true FROM orphans WHERE parent_id IS NULL AND is_external
"""


def foldered(spark, sf):
    return tree_ops.synthesize_folders(query(spark, sf, ORPHANS))


@register("synthesize_folders", oracle(FOLDERS, orphans=ORPHANS))
def _(spark, sf):
    return foldered(spark, sf)


@register("collapse_folder_chains", oracle("""
SELECT workspace_id, id, kind, coalesce(rl, label) AS label, coalesce(rp, path) AS path, coalesce(ph, parent_id) AS parent_id, is_external FROM (
  SELECT f.*, r.label AS rl, r.path AS rp, p.head AS ph FROM folders f
  LEFT JOIN (SELECT workspace_id, head, arg_max(label, d) AS label, arg_max(path, d) AS path FROM run GROUP BY ALL) r ON r.workspace_id = f.workspace_id AND r.head = f.id
  LEFT JOIN (SELECT workspace_id, id, head FROM run WHERE d > 0) p ON p.workspace_id = f.workspace_id AND p.id = f.parent_id
  WHERE (f.workspace_id, f.id) NOT IN (SELECT (workspace_id, child) FROM single)) x""",
    rec="""run(workspace_id, head, id, d, label, path) AS (
  SELECT f.workspace_id, f.id, f.id, 0, f.label, f.path FROM folders f JOIN single s ON s.workspace_id = f.workspace_id AND s.top = f.id
    WHERE (f.workspace_id, f.id) NOT IN (SELECT (workspace_id, child) FROM single)
  UNION ALL SELECT r.workspace_id, r.head, s.child, r.d + 1, r.label || '/' || c.label, c.path FROM run r
    JOIN single s ON s.workspace_id = r.workspace_id AND s.top = r.id JOIN folders c ON c.workspace_id = s.workspace_id AND c.id = s.child)""",
    orphans=ORPHANS, folders=FOLDERS,
    single="SELECT workspace_id, parent_id AS top, min(id) AS child FROM folders WHERE parent_id LIKE 'folder::%' GROUP BY ALL HAVING count(*) = 1 AND min(kind) = 'folder'"))
def _(spark, sf):
    return tree_ops.collapse_folder_chains(foldered(spark, sf))


MESSY = "SELECT * FROM fx_edges UNION ALL SELECT workspace_id, source, target, 'IMPORTS' FROM fx_edges WHERE type = 'contains' UNION ALL SELECT workspace_id, source, source, 'calls' FROM fx_edges UNION ALL SELECT * FROM fx_edges"


@register("dedupe_dependencies", oracle("""
SELECT DISTINCT workspace_id, source, target, CASE WHEN type ILIKE 'imports' THEN 'import' WHEN type = 'calls' THEN 'call' ELSE type END AS kind FROM messy
WHERE type <> 'contains' AND source <> target AND (workspace_id, source) IN (SELECT (workspace_id, id) FROM fx_nodes) AND (workspace_id, target) IN (SELECT (workspace_id, id) FROM fx_nodes)""", messy=MESSY))
def _(spark, sf):
    return tree_ops.dedupe_dependencies(view(spark, sf, "fx_nodes"), query(spark, sf, MESSY))


@register("ancestor_closure", tree_oracle("SELECT 'w' AS workspace_id, id, ancestor, distance FROM anc"))
def _(spark, sf):
    return ancestor_closure(tree(spark, sf))


@register("interval_labels", tree_oracle("""
SELECT 'w' AS workspace_id, t.id, t.parent_id, (SELECT count(*) FROM anc a WHERE a.id = t.id) AS depth, (SELECT count(*) FROM anc a WHERE a.ancestor = t.id) AS below FROM fx_tree t"""))
def _(spark, sf):
    """What the labels say of each node: its depth, and half of its interval's places are its descendants'."""
    return interval_labels(tree(spark, sf)).select(WS, "id", "parent_id", "depth", F.expr("CAST((exit - enter - 1) DIV 2 AS BIGINT)").alias("below"))


@register("breadcrumbs", tree_oracle("""
SELECT 'w' AS workspace_id, t.id, coalesce(u.up || '/', '') || t.label AS breadcrumb FROM fx_tree t
LEFT JOIN (SELECT a.id, string_agg(p.label, '/' ORDER BY distance DESC) AS up FROM anc a JOIN fx_tree p ON p.id = a.ancestor GROUP BY a.id) u ON u.id = t.id"""))
def _(spark, sf):
    return tree_ops.breadcrumbs(tree(spark, sf))


@register("resolve_visible", tree_oracle("SELECT 'w' AS workspace_id, t.id, n.shown FROM fx_tree t LEFT JOIN near n ON n.id = t.id"))
def _(spark, sf):
    t, labels = labelled(spark, sf)
    return tree_ops.resolve_visible(t, labels, query(spark, sf, SHOWN))


@register("rollup_edges", tree_oracle("SELECT *, round(least(6.0, 1.4 + log2(count + 1)), 6) AS width FROM rolled"))
def _(spark, sf):
    return rolled_up(spark, sf).withColumn("width", F.round("width", 6))


@register("rollup_degrees", tree_oracle("""
SELECT workspace_id, id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT workspace_id, source AS id, 1 AS o, 0 AS i FROM rolled UNION ALL SELECT workspace_id, target, 0, 1 FROM rolled) x GROUP BY ALL"""))
def _(spark, sf):
    return tree_ops.rollup_degrees(rolled_up(spark, sf))


SCORED = """SELECT workspace_id, id, type AS kind, is_external, length(id) % 20 AS complexity, CASE length(id) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS risk FROM fx_nodes
UNION ALL SELECT workspace_id, 'folder::' || path, 'folder', false, NULL, NULL FROM fx_modules"""


@register("filter_nodes", oracle("SELECT workspace_id, id, kind FROM scored WHERE NOT is_external AND (kind = 'folder' OR (kind <> 'function' AND complexity >= 10 AND coalesce(risk, 'low') = 'low'))", scored=SCORED))
def _(spark, sf):
    return tree_ops.filter_nodes(query(spark, sf, SCORED), False, False, True, "low").select(WS, "id", "kind")


INTERNAL = "SELECT * FROM fx_tree WHERE NOT is_external"


@register("folders_with_keepers", tree_oracle("""
SELECT 'w' AS workspace_id, f.id FROM fx_tree f WHERE kind = 'folder' AND id IN (SELECT ancestor FROM anc a JOIN fx_tree t ON t.id = a.id WHERE t.kind <> 'folder' AND NOT t.is_external)"""))
def _(spark, sf):
    t, labels = labelled(spark, sf)
    return tree_ops.folders_with_keepers(t, labels, tree_ops.filter_nodes(t, show_external=False)).select(WS, "id")


@register("search_labels", tree_oracle("""
SELECT 'w' AS workspace_id, id, 'match' AS role FROM fx_tree WHERE NOT is_external AND contains(label, '7')
UNION ALL SELECT DISTINCT 'w', ancestor, 'open' FROM anc WHERE id IN (SELECT id FROM fx_tree WHERE NOT is_external AND contains(label, '7'))"""))
def _(spark, sf):
    t, labels = labelled(spark, sf)
    return tree_ops.search_labels(tree_ops.filter_nodes(t, show_external=False), labels, " 7 ")


FOCUS = "SELECT 'w' AS workspace_id, id FROM fx_tree WHERE id IN ('s1', 'n3')"


@register("focus_neighborhood", tree_oracle("""
SELECT workspace_id, id, CAST(min(hop) AS INT) AS hop FROM (
  SELECT 'w' AS workspace_id, id, 0 AS hop FROM start
  UNION ALL SELECT 'w', t, 1 FROM start JOIN side ON s = id
  UNION ALL SELECT 'w', b.t, 2 FROM start JOIN side a ON a.s = id JOIN side b ON b.s = a.t) x GROUP BY ALL""".replace("FROM start", "FROM (SELECT id FROM focus WHERE id IN (SELECT id FROM shown)) start").replace("side", "(SELECT source AS s, target AS t FROM rolled UNION SELECT target, source FROM rolled)"), focus=FOCUS))
def _(spark, sf):
    return tree_ops.focus_neighborhood(rolled_up(spark, sf), query(spark, sf, SHOWN), query(spark, sf, FOCUS), 2)


OPEN = """, cnt AS (SELECT count(*) AS n FROM fx_tree WHERE kind = 'module' AND NOT is_external),
lim AS (SELECT n, CASE WHEN n <= 150 THEN 3 WHEN n <= 500 THEN 2 ELSE 1 END AS l FROM cnt),
dep AS (SELECT t.*, (SELECT count(*) FROM anc a WHERE a.id = t.id) AS depth FROM fx_tree t),
opened AS (SELECT id FROM dep, lim WHERE (kind = 'folder' AND depth < l) OR (kind = 'module' AND n <= 18 AND depth <= l))"""


@register("default_expansion", oracle("SELECT 'w' AS workspace_id, id FROM opened", rec=ANC + OPEN, shown=SHOWN, deps=DEPS))
def _(spark, sf):
    return tree_ops.default_expansion(*labelled(spark, sf))


@register("visible_set", oracle("""
SELECT 'w' AS workspace_id, t.id FROM fx_tree t WHERE NOT t.is_external
AND NOT EXISTS (SELECT 1 FROM anc a JOIN fx_tree p ON p.id = a.ancestor WHERE a.id = t.id AND (p.is_external OR p.id NOT IN (SELECT id FROM opened)))""", rec=ANC + OPEN, shown=SHOWN, deps=DEPS))
def _(spark, sf):
    t, labels = labelled(spark, sf)
    return tree_ops.visible_set(t, labels, tree_ops.default_expansion(t, labels), tree_ops.filter_nodes(t, show_external=False))


SIBLINGS = "SELECT 'w' AS workspace_id, id FROM fx_tree WHERE kind = 'folder' AND parent_id = 'r1'"


@register("sibling_edges", oracle("""
SELECT DISTINCT 'w' AS workspace_id, s.a AS source, t.a AS target FROM deps d
JOIN (SELECT id, ancestor AS a FROM anc WHERE ancestor IN (SELECT id FROM siblings)) s ON s.id = d.source
JOIN (SELECT id, ancestor AS a FROM anc WHERE ancestor IN (SELECT id FROM siblings)) t ON t.id = d.target WHERE s.a <> t.a""", rec=ANC, shown=SHOWN, deps=DEPS, siblings=SIBLINGS))
def _(spark, sf):
    return tree_ops.sibling_edges(query(spark, sf, DEPS), labelled(spark, sf)[1], query(spark, sf, SIBLINGS))


@register("child_counts", oracle("SELECT 'w' AS workspace_id, t.id, (SELECT count(*) FROM fx_tree c WHERE c.parent_id = t.id AND NOT c.is_external) AS children FROM fx_tree t"))
def _(spark, sf):
    return tree_ops.child_counts(tree(spark, sf), show_external=False)
