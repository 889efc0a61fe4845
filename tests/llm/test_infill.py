import hashlib

import duckdb
import numpy as np
import pytest

from terrane.llm import infill as I
from terrane.llm.queries import INFILL_SQL, LINES_SQL


def expected(doc_id, text):
    text = text or ""
    n = len(text)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = hashlib.sha256(text.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (n, "plain", None, None, sha, sha)
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (n, form, low, high - low, hashlib.sha256(out.encode()).hexdigest(), sha)


def check(df, rows):
    got = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output_sha256, r.restored_sha256) for r in df.collect())
    want = sorted((str(d), e[0], e[1], str(e[2]), str(e[3]), e[4], e[5]) for d, e in ((d, expected(d, t)) for d, t in rows))
    assert got == want


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(I.infill_report(docs), rows)
    assert {expected(*r)[1] for r in rows} == {"plain", "psm", "spm"}


def test_edge_cases(spark, documents):
    rows = [(i, "né🙂 " * i + "end") for i in range(60)]
    rows += [(1, None), (2, ""), (None, "text of none"), (70, "a<P>b"), (71, "a<S"), (72, "<M>"), (5, "same"), (5, "same"), (80, "x\x00y z"), (81, "長" * 200_001)]
    check(I.infill_report(documents(rows)), rows)
    assert I.infill_report(documents([])).count() == 0


@pytest.mark.parametrize("units", [1, 2, 3, 7])
def test_small_frames(spark, documents, units):
    rows = [(i, ("ab🙂d<S é<" * 5)[:i]) for i in range(45)] + [(90, "x<P>y")]
    made = I.fill_in_middle(I.plan(I.store_texts(documents(rows), units)))
    check(I.digests(made), rows)
    for r in I.output_texts(made).collect():
        assert len(r.text) == r.n + (0 if r.form == "plain" else 9)
        assert hashlib.sha256(r.text.encode()).hexdigest() == expected(r.doc_id, dict(rows)[r.doc_id])[4]


def test_only_cut_frames_are_expanded():
    squeeze, expand = I._tools()
    rng = np.random.default_rng(0)
    text = "".join(chr(int(c)) for c in rng.integers(97, 123, 1000))
    framed = I.FramedText(I._framed(text, 10, squeeze))
    opened = []

    def counted(data):
        opened.append(data)
        return expand(data)

    for first, end in ((0, 1000), (15, 15), (15, 18), (15, 985), (20, 30), (999, 1000), (0, 0)):
        opened.clear()
        got = b"".join(expand(d) for _, d in framed.span(first, end, squeeze, counted)).decode()
        assert got == text[first:end] and len(opened) <= 2
    for mark in ("zz", text[8:12], text[995:], text[100:103], "nowhere"):
        for first in (0, 5, 9, 500):
            assert framed.find(mark, first, expand) == text.find(mark, first)


@pytest.mark.parametrize("sql", [INFILL_SQL, LINES_SQL])
def test_sql_parses_and_runs(sql):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert len(con.execute(sql).fetchall()) == 200
