"""Registry rules, and a cross-section of queries against DuckDB at the smallest scale.

``tools/check.py`` compares every query; this keeps the suite short.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from terrane.plans.catalog import ORACLES, QUERIES
from terrane.plans.derived import TABLES
from tools.check import norm

ROWS_ONLY = {"unified_diff", "diff_summary", "lines_changed"}
SAMPLE = [
    "resolve_imports", "resolve_bases", "build_graph_nodes", "node_risk", "export_graph_edges", "change_impact", "resolve_parents", "collapse_folder_chains",
    "chunk_tokens", "hash_embed", "pack_context", "proficiency", "profile_report", "normalize_evaluate", "dead_models", "tree_listing", "resolve_file_refs",
    "detect_framework", "parse_diff", "validate_changes",
]


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert {"path", "risk", "num_affected"} <= set(df.columns) and df.count() > 0


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(str([norm(r[c]) for c in sorted(names)]) for r in df.collect())
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(str([norm(r[i]) for i in order]) for r in rel.fetchall())
    assert got == want and got
