"""The numbered queries over the driver's tables, and SQL where it can express one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_folder
from . import caps, conversations, hnsw, infill, linededup, minhash, mixing, packing, quality, repeats, tokenfiles, toxicity, wrappers
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary() -> str:
    """Where the installed tokenizer files keep the vocabulary of the packing queries."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op1_wrappers")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.extract(table(spark, sf, "pages"))


@query("op2_caps")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf, "embeddings"))


@query("op3_hnsw")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf, "embeddings"))


@query("op4_minhash")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), width=3, least=85, of=100)


@query("op5_quality")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_mixing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"))


@query("op7_suffixes")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_packing")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), vocabulary())


LINES_SQL = r"""
WITH lines AS (
    SELECT doc_id, place, line, lower_key AS key FROM (
        SELECT doc_id, place, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
        FROM (
            SELECT doc_id, unnest(range(len(parts))) AS place, unnest(parts) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
        )
    )
), owners AS (
    SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
    SELECT doc_id, place, line, keeper IS NULL OR keeper = doc_id AS stays FROM lines LEFT JOIN owners USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op10_lines", LINES_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return linededup.line_report(table(spark, sf, "documents"))


@query("op11_repair")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf, "conversations"))


@query("op12_tokens")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/llm/tokens-{uuid.uuid4().hex}"
    return tokenfiles.token_report(table(spark, sf, "documents"), vocabulary(), folder)


INFILL_SQL = """
WITH drawn AS (
    SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM (
        SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
            sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    )
), formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, abs(h1 % (n + 1) - h2 % (n + 1)) AS m,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), cut AS (
    SELECT doc_id, text, n, form, p, m, substr(text, 1, p) AS prefix, substr(text, p + 1, m) AS middle, substr(text, p + m + 1, n - p - m) AS suffix
    FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut
"""


@query("op13_infill", INFILL_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return infill.infill_report(table(spark, sf, "documents"))
