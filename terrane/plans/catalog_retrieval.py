"""Queries over chunks, embeddings and retrieval context."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import chunks as ck
from ..operators import context, vectors
from ..operators.knn import knn
from ..session import checkpoint_folder
from ..sources.bucketed import Store
from .derived import oracle, query, stored, table, texts, view
from .registry import register

WS = "workspace_id"
NOT_BLANK = r"[^ \t\n\x0B\f\r]+"


def words_sql(c: str) -> str:
    return f"regexp_extract_all({c}, '{NOT_BLANK}')"


def windows_sql(src: str, key: str, size: int, stride: int) -> str:
    """Word windows of every text in ``src`` as DuckDB SQL."""
    return f"""
SELECT {key}, CAST(s // {stride} AS BIGINT) AS ord, CAST(s AS INT) AS start_token, CAST(least(s + {size}, len(w)) AS INT) AS end_token,
  CAST(l[s + 1] AS INT) AS start_line, CAST(l[least(s + {size}, len(w))] AS INT) AS end_line, array_to_string(w[s + 1:least(s + {size}, len(w))], ' ') AS text,
  CAST(least(s + {size}, len(w)) - s AS INT) AS token_count
FROM (SELECT {key}, {words_sql('text')} AS w, flatten(list_transform(string_split(text, chr(10)), lambda x, i: list_transform({words_sql('x')}, lambda v: i))) AS l FROM {src}) t,
  unnest(range(0, len(w), {stride})) AS u(s)"""


def docs(spark, sf):
    return texts(spark, sf)


@register("token_counts", f"SELECT doc_id, len({words_sql('text')}) AS words, length(text) // 4 AS chars4 FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", text.token_count("text").alias("words"), text.token_count("text", "chars4").alias("chars4"))


@register("chunk_tokens", oracle("""
SELECT doc_id, source, ord, source || '::chunk_' || ord AS id, start_token, end_token, start_line, end_line, token_count, sha256(text) AS checksum,
  sha256('# File: ' || source || chr(10) || chr(10) || text) AS embed_checksum FROM windows""", windows=windows_sql("documents", "doc_id, source", 512, 448)))
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", "source", "text")
    return ck.chunk_tokens(d).select(
        "doc_id", "source", "ord", "id", "start_token", "end_token", "start_line", "end_line", "token_count", "checksum", text.checksum("embed_text").alias("embed_checksum")
    )


SMALL = windows_sql("documents", "doc_id", 40, 32)


def small_chunks(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("source"), "text")
    return ck.chunk_tokens(d, 40, 8)


@register("merge_small_chunks", oracle("""
SELECT doc_id, head AS ord, doc_id || '::chunk_' || head AS id, arg_min(start_line, ord) AS start_line, arg_max(end_line, ord) AS end_line, CAST(sum(token_count) AS BIGINT) AS token_count, count(*) AS merged,
  sha256(string_agg(text, chr(10) || chr(10) ORDER BY ord)) AS checksum
FROM folded JOIN small USING (doc_id, ord) GROUP BY doc_id, head""", small=SMALL, rec="""folded(doc_id, ord, head, cur) AS (
  SELECT doc_id, ord, ord, token_count FROM small WHERE ord = 0
  UNION ALL SELECT s.doc_id, s.ord, CASE WHEN f.cur < 100 AND f.cur + s.token_count <= 512 THEN f.head ELSE s.ord END,
    CASE WHEN f.cur < 100 AND f.cur + s.token_count <= 512 THEN f.cur + s.token_count ELSE s.token_count END
  FROM folded f JOIN small s ON s.doc_id = f.doc_id AND s.ord = f.ord + 1)"""))
def _(spark, sf):
    merged = ck.merge_small_chunks(small_chunks(spark, sf).drop("source"), keys=("doc_id",))
    return merged.select("doc_id", "ord", "id", "start_line", "end_line", "token_count", "merged", "checksum")


@register("chunk_ids", "SELECT doc_id, source || '::L' || doc_id || '-L' || (doc_id + 9) AS by_line, source || '::chunk_' || doc_id AS by_token FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", text.line_chunk_id("source", "doc_id", F.col("doc_id") + 9).alias("by_line"), text.token_chunk_id("source", "doc_id").alias("by_token"))


@register("checksums", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", text.checksum("text").alias("checksum"))


@register("embed_texts", "SELECT doc_id, '# File: ' || source || CASE WHEN lang <> 'en' THEN chr(10) || '# Symbol: ' || lang ELSE '' END || chr(10) || chr(10) || text AS embed_text FROM documents")
def _(spark, sf):
    symbol = F.when(F.col("lang") != "en", F.col("lang"))
    return docs(spark, sf).select("doc_id", text.embed_text("source", symbol, "text").alias("embed_text"))


DIFFED = dict(v1=windows_sql("documents", "doc_id", 512, 448), v2=windows_sql("fx_docs_v2", "doc_id", 512, 448))
DIFF = "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.doc_id, n.doc_id) || '::chunk_' || coalesce(o.ord, n.ord) AS id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM v1 o FULL JOIN v2 n ON n.doc_id = o.doc_id AND n.ord = o.ord WHERE o.text IS DISTINCT FROM n.text"


def version_chunks(spark, sf):
    old = docs(spark, sf).select(F.col("doc_id").cast("string").alias("source"), "text")
    new = view(spark, sf, "fx_docs_v2").select(F.col("doc_id").cast("string").alias("source"), "text")
    return ck.chunk_tokens(old), ck.chunk_tokens(new)


@register("diff_chunks", oracle("SELECT id, CAST(doc_id AS STRING) AS source, change FROM d", **DIFFED, d=DIFF))
def _(spark, sf):
    return ck.diff_chunks(*version_chunks(spark, sf))


@register("truncate_head", rf"""
SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '' WHEN len(w) <= 100 THEN text ELSE array_to_string(regexp_extract_all(text, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+')[1:100], '') || chr(10) || chr(10) || '# ... truncated to fit context budget ...' END AS head
FROM (SELECT doc_id, text, {words_sql('text')} AS w FROM documents) d""")
def _(spark, sf):
    budget = F.when(F.col("doc_id") % 50 == 0, 0).otherwise(100)
    return docs(spark, sf).select("doc_id", ck.truncate_head("text", budget).alias("head"))


SECTIONS = f"""
SELECT doc_id, CAST(ord AS INT) AS ord, CASE WHEN ord = 1 THEN 'docstring' WHEN ord % 10 = 0 THEN 'signature' ELSE 'body' END AS kind, len({words_sql('line')}) AS size
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents) l"""


def sections(spark, sf):
    return stored(spark, sf, "sections", lambda: cut_sections(spark, sf))


def cut_sections(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    ord_ = F.col("pos") + 1
    kind = F.when(ord_ == 1, "docstring").when(ord_ % 10 == 0, "signature").otherwise("body")
    return lines.select("doc_id", ord_.alias("ord"), kind.alias("kind"), text.word_count("line").alias("size"))


@register("pack_sections", oracle("""
SELECT s.doc_id, s.ord, s.kind, s.size, s.kind <> 'body' OR coalesce(w.kept, false) AS kept FROM sections s LEFT JOIN walk w ON w.doc_id = s.doc_id AND w.ord = s.ord""",
    sections=SECTIONS, bodies="SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, ord) AS rn FROM sections WHERE kind = 'body'",
    rec="""walk(doc_id, rn, ord, used, kept) AS (
  SELECT doc_id, 0, CAST(NULL AS INT), coalesce(sum(size) FILTER (WHERE kind <> 'body'), 0), false FROM sections GROUP BY doc_id
  UNION ALL SELECT b.doc_id, b.rn, b.ord, w.used + CASE WHEN w.used + b.size <= 150 THEN b.size ELSE 0 END, w.used + b.size <= 150 FROM walk w JOIN bodies b ON b.doc_id = w.doc_id AND b.rn = w.rn + 1)"""))
def _(spark, sf):
    return ck.pack_sections(sections(spark, sf), 150)


# --- vectors -----------------------------------------------------------------

ADLER = """
SELECT token, ((length(token) + list_sum(list_transform(range(1, length(token) + 1), lambda i: (length(token) - i + 1) * ascii(token[i])))) % 65521) * 65536
  + (1 + list_sum(list_transform(range(1, length(token) + 1), lambda i: ascii(token[i])))) % 65521 AS adler FROM (SELECT DISTINCT token FROM tokens) v"""
EMBED = dict(
    tokens="SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS token FROM documents",
    vocab=ADLER, filled="SELECT doc_id, CAST(adler % 384 AS INT) AS bucket, count(*) AS n FROM tokens JOIN vocab USING (token) GROUP BY ALL",
)


@register("hash_embed", oracle("SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM filled", **EMBED))
def _(spark, sf):
    return vectors.hash_embed(docs(spark, sf)).withColumn("weight", F.round("weight", 6))


@register("hash_vectors", oracle("""
SELECT doc_id, CAST(384 AS INT) AS dim, CAST(count(*) AS INT) AS filled, 1.0::DOUBLE AS norm FROM filled GROUP BY doc_id""", **EMBED))
def _(spark, sf):
    v = vectors.embed_with(docs(spark, sf).select("doc_id", "text"))
    norm = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4)
    return v.select("doc_id", F.size("embedding").alias("dim"), F.size(F.filter("embedding", lambda x: x > 0)).alias("filled"), norm.alias("norm"))


def shape_model(texts: list[str]) -> np.ndarray:
    """A stand-in user model: length and number of spaces."""
    return np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)


@register("embed_with_model", "SELECT doc_id, CAST(length(e) AS FLOAT) AS chars, CAST(length(e) - length(replace(e, ' ', '')) AS FLOAT) AS spaces FROM (SELECT doc_id, '# File: ' || source || chr(10) || chr(10) || text AS e FROM documents) d")
def _(spark, sf):
    ready = docs(spark, sf).select("doc_id", text.embed_text("source", None, "text").alias("embed_text"), "text")
    v = vectors.embed_with(ready, shape_model)
    return v.select("doc_id", F.col("embedding")[0].alias("chars"), F.col("embedding")[1].alias("spaces"))


NEW_VECTORS = "SELECT vec_id * 2 AS vec_id, embedding, label + 100 AS label FROM embeddings"
GONE = "SELECT vec_id * 3 AS vec_id FROM embeddings"


def vector_store(spark, sf):
    """The embeddings as a bucketed table, of which changes rewrite the buckets they touch."""
    store = Store(spark, f"{checkpoint_folder(spark)}/vectors/{uuid.uuid4().hex}", 16)
    store.create({"vectors": (table(spark, sf, "embeddings"), ["vec_id"])})
    return store


@register("upsert_vectors", oracle("SELECT vec_id, label FROM nv UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM nv)", nv=NEW_VECTORS))
def _(spark, sf):
    store = vector_store(spark, sf)
    return store.transact(lambda change: change.upsert("vectors", query(spark, sf, NEW_VECTORS))).table("vectors").select("vec_id", "label")


@register("delete_vectors", oracle("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM gone)", gone=GONE))
def _(spark, sf):
    store = vector_store(spark, sf)
    return store.transact(lambda change: change.delete("vectors", query(spark, sf, GONE))).table("vectors").select("vec_id", "label")


HITS = """SELECT q AS query_id, v AS vec_id, CAST(rank AS INT) AS rank, d * d AS distance FROM (
  SELECT q, v, d, row_number() OVER (PARTITION BY q ORDER BY d, v) AS rank FROM (
    SELECT a.vec_id AS q, b.vec_id AS v, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a CROSS JOIN embeddings b) x) y WHERE rank <= 5"""


def hits(spark, sf):
    store = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return knn(store.withColumnRenamed("vec_id", "query_id"), store, 5)


@register("knn", oracle("SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM hits", hits=HITS))
def _(spark, sf):
    return hits(spark, sf).withColumn("distance", F.round("distance", 6))


@register("similarity", oracle("SELECT query_id, vec_id, round(1 / (1 + distance), 6) AS score FROM hits", hits=HITS))
def _(spark, sf):
    return hits(spark, sf).select("query_id", "vec_id", F.round(vectors.similarity("distance"), 6).alias("score"))


@register("get_chunks", oracle("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM fx_docs_v2)"))
def _(spark, sf):
    return vectors.get_chunks(docs(spark, sf), view(spark, sf, "fx_docs_v2"), "doc_id").select("doc_id", "n_chars")


@register("list_chunks", "SELECT doc_id, n_chars FROM documents WHERE source = 'src1'")
def _(spark, sf):
    return vectors.list_chunks(docs(spark, sf), "src1").select("doc_id", "n_chars")


@register("store_stats", "SELECT count(*) AS chunks, CAST(max(len(embedding)) AS INT) AS dim, count(*) > 0 AS has_index FROM embeddings")
def _(spark, sf):
    return vectors.store_stats(table(spark, sf, "embeddings"))


@register("scope_workspaces", oracle("""
SELECT requested, workspace_id, count(*) AS modules FROM (SELECT 'w0' AS requested, 'w0' AS s UNION ALL SELECT 'w1', 'w1' UNION ALL SELECT 'unknown', 'w0') r JOIN fx_modules m ON m.workspace_id = r.s GROUP BY ALL"""))
def _(spark, sf):
    asked = query(spark, sf, "SELECT DISTINCT workspace_id FROM fx_modules UNION ALL SELECT 'unknown'")
    return vectors.scope(view(spark, sf, "fx_modules"), asked, "w0").groupBy("requested", WS).agg(F.count("*").alias("modules"))


FILES_OF = "SELECT vec_id, workspace_id, path AS source FROM embeddings JOIN fx_modules ON k = vec_id AND path LIKE 'src/%'"


@register("retrieve_context", oracle("""
SELECT query_id, workspace_id, id, CAST(min(hop) AS INT) AS hop FROM (
  SELECT query_id, workspace_id, id, 0 AS hop FROM cen
  UNION ALL SELECT DISTINCT c.query_id, c.workspace_id, a.o, 1 FROM cen c JOIN around a ON a.workspace_id = c.workspace_id AND a.id = c.id) x GROUP BY ALL""",
    hits=HITS, files_of=FILES_OF, around="SELECT workspace_id, source AS id, target AS o FROM fx_edges UNION SELECT workspace_id, target, source FROM fx_edges",
    cen="SELECT DISTINCT query_id, f.workspace_id, regexp_replace(replace(source, '/', '.'), '[.](py|tsx|ts|js)$', '') AS id FROM hits JOIN files_of f USING (vec_id)"))
def _(spark, sf):
    return context.retrieve_context(hits(spark, sf), query(spark, sf, FILES_OF), view(spark, sf, "fx_nodes"), view(spark, sf, "fx_edges"))


@register("pack_context", oracle(f"""
SELECT query_id, rank, tokens, run <= 900 AS shown, count(*) FILTER (WHERE run > 900) OVER (PARTITION BY query_id) AS omitted FROM (
  SELECT query_id, rank, tokens, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM (
    SELECT query_id, rank, 8 + len({words_sql('text')}) AS tokens FROM hits JOIN documents ON doc_id = vec_id) t) u""", hits=HITS))
def _(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("vec_id"), "source", "text", F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    ranked = hits(spark, sf).join(d, "vec_id").withColumn("score", vectors.similarity("distance"))
    return context.pack_context(ranked, 900).select("query_id", "rank", "tokens", "shown", "omitted")


ORDERED = "SELECT workspace_id || ':' || source AS query_id, row_number() OVER (PARTITION BY workspace_id, source ORDER BY target) AS ord, source, target, type FROM fx_edges"


@register("pack_edges", oracle("""
SELECT o.query_id, CAST(ord AS INT) AS ord, '- ' || source || ' --' || type || '--> ' || target AS line, n - least(n, 40) AS remaining FROM ordered o
JOIN (SELECT query_id, count(*) AS n FROM ordered GROUP BY query_id) t ON t.query_id = o.query_id WHERE ord <= 40""", ordered=ORDERED))
def _(spark, sf):
    return context.pack_edges(query(spark, sf, ORDERED), 160)
