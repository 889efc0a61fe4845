import json
import os
import uuid
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from terrane.llm import tokenfiles as T
from terrane.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


@pytest.fixture
def folder(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [T.END_ID], "<u4")


def expected(library, rows):
    """(doc_id, start, n_tokens, crc) of rows (doc_id, text); rows of one id as a set of their lengths and sums."""
    out, start = [], 0
    for doc, ids in sorted(((d, ids_of(library, t)) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]))):
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def reported(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_report_matches_the_library(spark, library, folder, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert reported(T.token_report(docs.repartition(5), vocabulary(), folder)) == expected(library, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    manifest = json.load(open(f"{folder}/manifest.json"))
    assert sum(f["docs"] for f in manifest["files"]) == len(rows) and len(manifest["files"]) > 1
    assert os.path.exists(f"{folder}/dictionary-{manifest['dictionary']}")
    if sf == "0.01":
        size = sum(os.path.getsize(f"{folder}/{f['name']}") for f in manifest["files"])
        assert os.path.getsize(f"{folder}/dictionary-{manifest['dictionary']}") and size < 2 * sum(f["ids"] for f in manifest["files"])
    wanted = [rows[3][0], rows[-1][0], -1]
    few = T.read_tokens(spark, folder, wanted).collect()
    assert sorted(r.doc_id for r in few) == sorted(wanted[:2])
    by_id = dict(rows)
    for r in few:
        assert np.array_equal(np.frombuffer(bytes(r.ids), "<u4"), ids_of(library, by_id[r.doc_id]))


def test_edge_cases(spark, documents, library, folder):
    odd = "a<|endoftext|>b   x y　z 's 'T we'll 12345 ½²ﬁ İstanbul ß ẞ İ \x00\x01 🙂🙂 naïve Ångström <|startoftext|>"
    rows = [(3, "word " * 40_000), (1, None), (2, ""), (None, "null id"), (3, "word " * 40_000), (3, odd), (-7, " \n\t "), (9, odd * 50), (10, "\n".join(["línea"] * 5))]
    got = reported(T.token_report(documents(rows), vocabulary(), folder))
    assert got == expected(library, rows)
    with pytest.raises(Exception, match="already holds"):
        T.write_tokens(documents(rows), vocabulary(), folder)
    assert reported(T.read_tokens(spark, folder).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) AS ids_crc32")) == got


def test_empty_table_and_text_ids(spark, documents, library, folder):
    assert T.token_report(documents([]), vocabulary(), folder).count() == 0
    named = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "x")], "doc_id string, text string")
    rows = T.token_report(named, vocabulary(), folder + "s").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, "a", "b"] and [r.start for r in rows] == [0, 2, 4]


def test_damaged_files_are_noticed(spark, documents, folder):
    T.write_tokens(documents([(i, f"text number {i} " * 20) for i in range(50)]), vocabulary(), folder)
    name = json.load(open(f"{folder}/manifest.json"))["files"][0]["name"]
    data = open(f"{folder}/{name}", "rb").read()
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data[:-5])
    with pytest.raises(Exception, match="cut short"):
        T.read_tokens(spark, folder).collect()


def test_several_files_a_task(spark, documents, library, folder, monkeypatch):
    monkeypatch.setattr(T, "FILE_IDS", 100)
    rows = [(i, f"some text {i} " * 10) for i in range(40)]
    writer = T.FrameWriter(folder, "bigint", "0" * 64, 2)
    os.makedirs(folder)

    class Context:
        @staticmethod
        def get():
            return type("C", (), {"partitionId": lambda self: 0})()

    monkeypatch.setattr(T, "TaskContext", Context)
    import pyarrow as pa
    import zstandard

    frames = [zstandard.ZstdCompressor().compress(ids_of(library, t).astype("<u2").tobytes()) for _, t in rows]
    batch = pa.record_batch([pa.array([d for d, _ in rows]), pa.array([len(ids_of(library, t)) for _, t in rows]), pa.array(frames)], ["doc_id", "n_tokens", "frame"])
    message = writer.write(iter([batch]))
    assert len(message.files) > 5 and sum(f["docs"] for f in message.files) == 40
    writer.abort([message, None])
    assert not os.listdir(folder)
