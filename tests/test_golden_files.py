"""Bytes, archives, directories and diffs with rows typed from the semantics."""

import time
import zipfile

import pytest
from pyspark.sql import functions as F

from terrane.operators import changes, corpus
from terrane.sources import files as source
from terrane.sources import graph_json, tree


def test_decoding(spark):
    data = [(1, "é".encode()), (2, b"\xef\xbb\xbfa"), (3, b"\x93hi\x94 \x80"), (4, b"\x81\x93")]
    df = spark.createDataFrame(data, "k int, content binary").select("k", source.decode_content("content").alias("t"))
    assert {r["k"]: r["t"] for r in df.collect()} == {1: "é", 2: "\ufeffa", 3: "“hi” €", 4: "\x81\x93"}


def test_scan(spark, tmp_path):
    for name in ("w1/src/a.py", "w1/src/__init__.py", "w1/src/B.TS", "w1/node_modules/x.js", "w1/.git/y.py", "w1/.github/z.py", "w2/c.txt", "w2/d.mjs"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    got = {(r["workspace_id"], r["path"], r["size"], r["content"]) for r in source.scan_sources(spark, str(tmp_path)).collect()}
    assert got == {("w1", "src/a.py", 1, "x"), ("w1", "src/__init__.py", 1, "x"), ("w1", "src/B.TS", 1, "x"), ("w1", ".github/z.py", 1, "x"), ("w2", "d.mjs", 1, "x")}
    assert source.scan_sources(spark, str(tmp_path), content=False).columns == ["workspace_id", "path", "size", "modified"]


def test_filters_reach_the_scan(spark, tmp_path):
    rows = [(w, p, f"{w} {p}") for w in ("w1", "w2", "w3") for p in ("src/a.py", "src/b/__init__.py", "lib/c.ts", "top.js", "node_modules/x.js", "src/b/read.me")]
    root = str(tmp_path / "tree")
    source.write_sources(spark.createDataFrame(rows, "workspace_id string, path string, content string"), root)
    assert [p.name for p in tmp_path.iterdir()] == ["tree"]
    want = {(w, p, t) for w, p, t in rows if p.endswith((".py", ".ts", ".js")) and "node_modules" not in p}

    def found(df):
        return {(r.workspace_id, r.path, r.content) for r in df.collect()}

    for folders in ("1", "2", "256"):
        read = source._tree(spark).option("folders", folders).option("bytes", "1").load(root).withColumn("content", source.decode_content("content"))
        assert found(read) == want
    some = source.scan_sources(spark, root).filter("workspace_id = 'w2' AND path LIKE 'src/%'")
    assert found(some) == {r for r in want if r[0] == "w2" and r[1].startswith("src/")}
    assert found(source.scan_sources(spark, root).filter("path IN ('top.js', 'nowhere.py')")) == {r for r in want if r[1] == "top.js"}
    reader = tree.TreeReader({"path": root})
    kept = list(reader.pushFilters([tree.EqualTo(("workspace_id",), "w2"), tree.StringStartsWith(("path",), "src/b"), tree.EqualTo(("size",), 3)]))
    assert kept == [tree.EqualTo(("size",), 3)]
    assert {f[:2] for p in reader.partitions() for f in p.files} | {f for p in reader.partitions() for f in p.folders} == {("w2", "src/b/__init__.py")}
    with pytest.raises(Exception, match="outside the tree"):
        source.write_sources(spark.createDataFrame([("w", "../up.py", "x")], "workspace_id string, path string, content string"), root)
    assert [p.name for p in tmp_path.iterdir()] == ["tree"] and found(source.scan_sources(spark, root)) == want


def test_arriving_files_stream(spark, tmp_path):
    root, schema = str(tmp_path / "tree"), "workspace_id string, path string, content string"

    def run():
        q = source.stream_sources(spark, root).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    source.write_sources(spark.createDataFrame([("w", "a.py", "one")], schema), root)
    time.sleep(1.2)
    run()
    source.write_sources(spark.createDataFrame([("w", "b.py", "two"), ("v", "c/d.ts", "three")], schema), root)
    time.sleep(1.2)
    run()
    got = sorted((r.workspace_id, r.path, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("v", "c/d.ts", "three"), ("w", "a.py", "one"), ("w", "b.py", "two")]


def test_archives(spark, tmp_path):
    good = tmp_path / "good.zip"
    with zipfile.ZipFile(good, "w") as z:
        for name in ("repo/a.py", "repo\\b.py", "__MACOSX/a.py", "../up.py", "/abs.py", "repo/.env", "repo/build/x.py", "repo/c.so"):
            z.writestr(name, "data")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select(F.lit("w").alias("workspace_id"), F.substring_index("path", "/", -1).alias("path"), "content")
    got = {(r["archive"], r["path"], r["error"] is not None) for r in source.expand_archives(raw).collect()}
    assert got == {("good.zip", "repo/a.py", False), ("good.zip", "repo/b.py", False), ("bad.zip", None, True)}


def test_file_references(spark):
    files = spark.createDataFrame([("w", p) for p in ("app/models.py", "web/view.tsx", "web/index.ts", "lib/index.ts", "node_modules/only.py")], "workspace_id string, path string")
    refs = {"app/models.py": "app/models.py", "app.models": "app/models.py", "app.models.User.save": "app/models.py", "web/view": "web/view.tsx", "index": "lib/index.ts", "only": None, "/app/models.py/": "app/models.py"}
    df = spark.createDataFrame([("w", r) for r in refs], "workspace_id string, ref string")
    assert {r["ref"]: r["path"] for r in corpus.resolve_file_refs(df, files).collect()} == refs


def test_diffs(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc\n", "a\nx\nc\nd\n"), (2, "same\n", "same\n")], "doc_id long, old_text string, new_text string")
    d = changes.diff_summary(changes.diff_pairs(pairs))
    got = {r["doc_id"]: (r["matched"], r["lines_added"], r["lines_removed"], r["percent_change"], r["lines_changed"], r["summary"]) for r in d.collect()}
    assert got == {1: (2, 2, 1, 25.0, 2, "2 lines added, 1 lines removed"), 2: (1, 0, 0, 0.0, 0, "No changes")}
    typed = changes.parse_diff(d.select(F.col("doc_id").alias("diff_id"), "diff")).filter("diff_id = 1").orderBy("pos").collect()
    assert [(r["type"], r["old_line"], r["new_line"], r["content"]) for r in typed] == [
        ("meta", None, None, "--- a/1"), ("meta", None, None, "+++ b/1"), ("hunk", None, None, "@@ -1,3 +1,4 @@"), ("context", 1, 1, "a"),
        ("remove", 2, None, "b"), ("add", None, 2, "x"), ("context", 3, 3, "c"), ("add", None, 4, "d"),
    ]


def test_graph_files_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("007", "a", "module", "a.py", "python", None, None, False, True)], "workspace_id string, id string, type string, path string, language string, module string, `class` string, is_external boolean, declared boolean")
    edges = spark.createDataFrame([("007", "a", "b", "imports")], "workspace_id string, source string, target string, type string")
    graph_json.write_graph_json(nodes, edges, str(tmp_path / "g"))
    n, e = graph_json.read_graph_json(spark, str(tmp_path / "g"))
    assert n.drop("workspace_id").collect() == nodes.drop("workspace_id").collect() and e.select("source", "target", "type").collect() == [("a", "b", "imports")]
    graph_json.write_tables({"nodes": nodes}, str(tmp_path / "t"))
    assert graph_json.read_table(spark, str(tmp_path / "t"), "nodes").count() == 1
    doc = tmp_path / "j" / "w9"
    doc.mkdir(parents=True)
    (doc / "graph.json").write_text('{"graph": {"builder_version": 2, "graph_level": 3}, "nodes": [{"id": "a", "type": "module", "is_external": false}], "edges": [{"source": "a", "target": "b", "type": "imports"}]}')
    n, e, meta = graph_json.read_node_link(spark, str(tmp_path / "j"))
    assert [(r["workspace_id"], r["id"]) for r in n.collect()] == [("w9", "a")]
    assert [tuple(r) for r in e.collect()] == [("w9", "a", "b", "imports")] and meta.first()["builder_version"] == 2
