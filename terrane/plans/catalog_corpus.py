"""Queries over file tables, archives and graph storage."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import corpus
from ..sources import files as source
from ..sources import graph_json
from ..session import checkpoint_folder
from .code import source_files
from .derived import oracle, query, table, view
from .registry import register

WS = "workspace_id"


def quoted(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PARTS = "list_filter(string_split(lower(path), '/'), lambda p: p <> '')"


@register("scan_sources", oracle("SELECT workspace_id, path, path LIKE '%.py' AS python FROM fx_modules WHERE path LIKE 'src/%'"))
def _(spark, sf):
    """Every file of the derived corpus, written as a tree of files and scanned."""
    root = f"{checkpoint_folder(spark)}/trees/{uuid.uuid4().hex}"
    source.write_sources(source_files(spark, sf), root)
    found = source.scan_sources(spark, root).filter("workspace_id IN ('w0', 'w1')")
    # the text of a file is that of its row
    same = found.join(source_files(spark, sf).select(WS, "path", F.col("content").alias("was")), [WS, "path"]).filter("content = was")
    return same.select(WS, "path", F.col("path").endswith(".py").alias("python"))


@register("drop_skipped_paths", oracle(f"""
SELECT workspace_id, doc_id, path FROM fx_paths WHERE NOT (list_has_any({PARTS}, {quoted(rules.SKIP_DIRS)}) OR (
  len(list_filter({PARTS}, lambda p: starts_with(p, '.') AND p NOT IN ('.', '..'))) > 0 AND NOT list_has_any({PARTS}, ['.github', '.gitignore'])))"""))
def _(spark, sf):
    return corpus.drop_skipped_paths(view(spark, sf, "fx_paths")).select(WS, "doc_id", "path")


KEPT = f"""SELECT * FROM fx_paths WHERE NOT (starts_with(path, '/') OR list_contains({PARTS}, '..') OR list_has_any({PARTS}, {quoted(rules.ARCHIVE_SKIP_DIRS)})
  OR lower(string_split(path, '/')[-1]) = '.env' OR regexp_matches(lower(path), '[^/][.](pyc|pyo|pyd|so|dll)$'))"""


@register("filter_archive_members", oracle("SELECT workspace_id, doc_id, path FROM kept", kept=KEPT))
def _(spark, sf):
    return corpus.filter_archive_members(view(spark, sf, "fx_paths")).select(WS, "doc_id", "path")


ROOTED = "SELECT CASE WHEN path LIKE 'app/%' THEN 'app_only' ELSE workspace_id END AS workspace_id, path FROM fx_paths UNION ALL SELECT 'app_only', '__MACOSX/x' UNION ALL SELECT 'app_only', 'readme.md' UNION ALL SELECT 'flat', 'readme.md'"


@register("detect_repo_root", oracle("""
SELECT workspace_id, CASE WHEN count(DISTINCT top) = 1 THEN min(top) ELSE '' END AS root FROM (
  SELECT workspace_id, CASE WHEN contains(path, '/') AND string_split(path, '/')[1] NOT IN ('__MACOSX', 'graph_store') THEN string_split(path, '/')[1] END AS top FROM rooted) r GROUP BY ALL""", rooted=ROOTED))
def _(spark, sf):
    return corpus.detect_repo_root(query(spark, sf, ROOTED))


@register("tag_modules", oracle("""
SELECT workspace_id, path, module_name, regexp_extract(path, '([.][a-z]+)$', 1) AS suffix,
  CASE regexp_extract(path, '([.][a-z]+)$', 1) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' ELSE 'typescript' END AS language FROM fx_modules"""))
def _(spark, sf):
    return corpus.tag_modules(view(spark, sf, "fx_modules").select(WS, "path"))


# module files plus one virtual environment and some hidden entries per workspace
LISTED = """SELECT workspace_id, path, k AS size FROM fx_modules UNION ALL SELECT workspace_id, 'tools39/pyvenv.cfg', 1 FROM fx_modules GROUP BY workspace_id
UNION ALL SELECT workspace_id, 'tools39/lib/x.py', 1 FROM fx_modules GROUP BY workspace_id UNION ALL SELECT workspace_id, 'src/app.egg-info/y.py', 1 FROM fx_modules GROUP BY workspace_id
UNION ALL SELECT workspace_id, 'old.ZIP', 1 FROM fx_modules GROUP BY workspace_id UNION ALL SELECT workspace_id, 'README.md', 7 FROM fx_modules GROUP BY workspace_id"""
SHOWN = "SELECT * FROM listed WHERE NOT regexp_matches(path, '^tools39/|egg-info/|ZIP$')"
ENTRIES = """SELECT workspace_id, path, 'file' AS kind, size FROM shown
UNION ALL SELECT DISTINCT workspace_id, array_to_string(string_split(path, '/')[1:i], '/'), 'folder', NULL FROM shown, unnest(range(1, len(string_split(path, '/')))) AS u(i)"""


@register("tree_listing", oracle("""
SELECT workspace_id, path, string_split(path, '/')[-1] AS name, kind, size, CASE WHEN kind = 'file' THEN CASE regexp_extract(path, '[^.]*$') WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'md' THEN 'markdown' ELSE 'typescript' END END AS language, CAST(rn AS INT) AS position, CAST(len(string_split(path, '/')) AS INT) AS depth FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace_id, len(string_split(path, '/')), regexp_extract(path, '^(.*)/', 1) ORDER BY kind <> 'folder', lower(string_split(path, '/')[-1]), path) AS rn FROM entries) e""",
    listed=LISTED, shown=SHOWN, entries=ENTRIES))
def _(spark, sf):
    return corpus.tree_listing(query(spark, sf, LISTED)).select(WS, "path", "name", "kind", "size", "language", "position", "depth")


@register("folder_rollup", oracle("""
SELECT workspace_id, array_to_string(string_split(path, '/')[1:i], '/') AS folder, count(*) AS files, CAST(sum(k) AS BIGINT) AS bytes
FROM fx_modules, unnest(range(1, len(string_split(path, '/')))) AS u(i) GROUP BY ALL"""))
def _(spark, sf):
    return corpus.folder_rollup(view(spark, sf, "fx_modules").withColumnRenamed("k", "size"))


@register("resolve_file_refs", oracle("""
SELECT r.workspace_id, r.k, r.ref, CASE k % 6 WHEN 5 THEN NULL WHEN 4 THEN (SELECT arg_min(m.path, (CASE string_split(m.path, '.')[-1] WHEN 'py' THEN 1 WHEN 'ts' THEN 2 WHEN 'tsx' THEN 3 ELSE 4 END, m.path)) FROM fx_modules m
    WHERE m.workspace_id = r.workspace_id AND regexp_replace(string_split(m.path, '/')[-1], '[.][a-z]+$', '') = r.ref)
  ELSE (SELECT min(m.path) FROM fx_modules m WHERE m.workspace_id = r.workspace_id AND m.k = r.k AND m.path LIKE 'src/%') END AS path FROM fx_refs r"""))
def _(spark, sf):
    return corpus.resolve_file_refs(view(spark, sf, "fx_refs"), view(spark, sf, "fx_modules")).select(WS, "k", "ref", "path")


MESSY = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/' || path WHEN 1 THEN './' || replace(path, '/', '\\\\') WHEN 2 THEN path ELSE 'app' END AS path FROM fx_paths"


@register("strip_root_prefix", oracle("""
SELECT doc_id, CASE WHEN rel = 'app' THEN '' WHEN starts_with(rel, 'app/') THEN substring(rel, 5) ELSE rel END AS path FROM (
  SELECT doc_id, regexp_replace(ltrim(replace(path, chr(92), '/'), '/'), '^[.]/', '') AS rel FROM messy) m""", messy=MESSY.replace("\\\\", "\\")))
def _(spark, sf):
    return query(spark, sf, MESSY).select("doc_id", corpus.strip_root_prefix("path", F.lit("/home/x/app")).alias("path"))


COUNTS = "SELECT workspace_id, count(*) FILTER (WHERE path LIKE '%.py') AS py, count(*) FILTER (WHERE path LIKE '%.ts' OR path LIKE '%.tsx') AS ts, count(*) FILTER (WHERE path LIKE '%.js') AS js FROM {f} GROUP BY workspace_id"
# workspaces with different mixes of languages
MIXED = """SELECT workspace_id, path FROM fx_modules UNION ALL SELECT 'web', path FROM fx_modules WHERE path LIKE '%.ts' OR path LIKE '%.js' UNION ALL SELECT 'script', path FROM fx_modules WHERE path LIKE '%.js'
UNION ALL SELECT 'typed', path FROM fx_modules UNION ALL SELECT DISTINCT 'typed', 'tsconfig.json' FROM fx_modules UNION ALL SELECT DISTINCT 'notes', 'a.md' FROM fx_modules"""


@register("language_counts", oracle(COUNTS.format(f="mixed"), mixed=MIXED))
def _(spark, sf):
    return corpus.language_counts(query(spark, sf, MIXED)).drop("has_tsconfig")


@register("detect_language", oracle("""
SELECT workspace_id, CASE WHEN workspace_id = 'typed' THEN 'typescript' WHEN py > 0 AND py >= ts AND py >= js THEN 'python' WHEN ts > 0 THEN 'typescript' WHEN js > 0 THEN 'javascript' ELSE 'unknown' END AS language FROM c""",
    mixed=MIXED, c=COUNTS.format(f="mixed")))
def _(spark, sf):
    return corpus.detect_language(query(spark, sf, MIXED))


@register("dominant_extension", oracle("""
SELECT workspace_id, ext AS extension FROM (SELECT workspace_id, ext, row_number() OVER (PARTITION BY workspace_id ORDER BY count(*) DESC, ext) AS rn FROM (
  SELECT workspace_id, string_split(path, '.')[-1] AS ext FROM mixed) m GROUP BY workspace_id, ext) x WHERE rn = 1""", mixed=MIXED))
def _(spark, sf):
    return corpus.dominant_extension(query(spark, sf, MIXED))


@register("detect_framework", oracle("""
SELECT workspace_id, CASE path WHEN 'package.json' THEN CASE WHEN contains(content, '"next"') THEN 'Next.js' ELSE 'Express' END WHEN 'requirements.txt' THEN 'FastAPI' WHEN 'pyproject.toml' THEN 'Django' WHEN 'manage.py' THEN 'Django' ELSE 'Unknown' END AS framework,
  CASE path WHEN 'requirements.txt' THEN 'python' WHEN 'pyproject.toml' THEN 'python' WHEN 'manage.py' THEN 'python' WHEN 'tsconfig.json' THEN 'typescript' ELSE 'unknown' END AS language,
  CASE path WHEN 'package.json' THEN CASE WHEN contains(content, '"next"') THEN 'frontend' ELSE 'backend' END WHEN 'tsconfig.json' THEN 'unknown' WHEN 'readme.md' THEN 'unknown' ELSE 'backend' END AS project_type FROM fx_manifests"""))
def _(spark, sf):
    return corpus.detect_framework(view(spark, sf, "fx_manifests"))


@register("search_files", oracle("""
SELECT workspace_id, path FROM (SELECT workspace_id, path, string_split(path, '/')[-1] AS name, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' ELSE 'typescript' END AS kind FROM fx_modules) f
WHERE (contains(name, '_1') OR contains(kind, '_1')) AND contains(kind, 'script')"""))
def _(spark, sf):
    named = corpus.tag_modules(view(spark, sf, "fx_modules")).withColumns({"name": F.substring_index("path", "/", -1), "kind": F.col("language")})
    return corpus.search_files(named, " _1 ", "Script").select(WS, "path")


@register("graph_json_round_trip", oracle("""
SELECT workspace_id, id AS a, type AS b, module AS c, is_external FROM fx_nodes UNION ALL SELECT workspace_id, source, target, type, NULL FROM fx_edges"""))
def _(spark, sf):
    nodes, edges = graph_json.parse_graph_records(graph_json.graph_records(view(spark, sf, "fx_nodes"), view(spark, sf, "fx_edges")))
    return nodes.select(WS, F.col("id").alias("a"), F.col("type").alias("b"), F.col("module").alias("c"), "is_external").unionByName(
        edges.select(WS, F.col("source").alias("a"), F.col("target").alias("b"), F.col("type").alias("c"), F.lit(None).cast("boolean").alias("is_external"))
    )


@register("decode_content", r"""
SELECT doc_id, sha256(CASE WHEN regexp_full_match(text, '[\x00-\x7F]*') THEN CASE WHEN doc_id % 3 = 0 THEN text || chr(8220) || chr(128) WHEN doc_id % 3 = 1 THEN text || chr(8220) ELSE chr(65279) || text END
  ELSE text END) AS checksum FROM (SELECT doc_id, text FROM documents) d""".replace("text || chr(8220) || chr(128)", "text || chr(147) || chr(129)"))
def _(spark, sf):
    raw = table(spark, sf, "documents").withColumn("utf8", F.encode("text", "UTF-8"))
    plain = F.col("text").rlike(r"^[\x00-\x7F]*$")
    third = F.col("doc_id") % 3
    made = (
        F.when(~plain, F.col("utf8")).when(third == 0, F.concat("utf8", F.unhex(F.lit("9381"))))
        .when(third == 1, F.concat("utf8", F.unhex(F.lit("93")))).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), "utf8"))
    )
    return raw.select("doc_id", text.checksum(source.decode_content(made)).alias("checksum"))


def zipped(frames):
    """Each document as a zip of its text and members that must not survive."""
    for pdf in frames:
        blobs = []
        for doc_id, body in zip(pdf["doc_id"], pdf["text"]):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"app/d{doc_id}.txt", body)
                for junk in ("__MACOSX/x", "../evil.py", "app/.env", "app/node_modules/a.js", "app/b.pyc"):
                    z.writestr(junk, "x")
            blobs.append(held.getvalue() if doc_id % 10 else b"not a zip")
        yield pd.DataFrame({"workspace_id": pdf["source"], "path": [f"d{i}.zip" for i in pdf["doc_id"]], "content": blobs})


@register("expand_archives", """
SELECT source AS workspace_id, 'd' || doc_id || '.zip' AS archive, CASE WHEN doc_id % 10 > 0 THEN 'app/d' || doc_id || '.txt' END AS path, CASE WHEN doc_id % 10 > 0 THEN sha256(text) END AS checksum, doc_id % 10 = 0 AS failed FROM documents""")
def _(spark, sf):
    zips = table(spark, sf, "documents").select("doc_id", "source", "text").mapInPandas(zipped, "workspace_id string, path string, content binary")
    out = source.expand_archives(zips)
    return out.select(WS, "archive", "path", F.sha2("content", 256).alias("checksum"), F.col("error").isNotNull().alias("failed"))
