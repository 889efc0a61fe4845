"""Memory and work of single steps, on rows made here."""

import pickle
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from terrane.functions import ids
from terrane.operators import extract, knn, vectors
from terrane.plans import incremental, pipelines
from terrane.sources import tree
from terrane.streaming import learners


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_commit_of_a_tree_holds_no_list_of_its_files(tmp_path):
    root, messages = tmp_path / "tree", []
    for n, space in ((3, "w"), (3000, "v")):
        rows = [(space, f"d{i % 7}/a\n{i}.py", f"x{i}") for i in range(n)]
        batch = pa.record_batch([pa.array(c) for c in zip(*rows)], ["workspace_id", "path", "content"])
        writer = tree.TreeWriter(str(root)) if not messages else writer
        messages.append(writer.write(iter([batch])))
    assert abs(len(pickle.dumps(messages[0])) - len(pickle.dumps(messages[1]))) < 50
    tree.MADE, kept = 2, tree.MADE
    try:
        writer.commit([*messages, None])
    finally:
        tree.MADE = kept
    assert [p.name for p in tmp_path.iterdir()] == ["tree"]
    files = [p for p in root.rglob("*") if p.is_file()]
    assert len(files) == 3003 and (root / "v/d1/a\n2997.py").read_text() == "x2997"


def test_distances_of_a_shard_are_held_a_step_at_a_time():
    draw = np.random.default_rng(1)
    asked, store = draw.normal(size=(1200, 8)), draw.normal(size=(40_000, 8))
    tracemalloc.start()
    found = {i: names.tolist() for i, names, _ in knn._best(asked, np.arange(len(store)), store, 3)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    for i in (0, 7, 1199):
        assert found[i] == np.lexsort((np.arange(len(store)), ((store - asked[i]) ** 2).sum(1)))[:3].tolist()


def test_dense_embedding_is_made_in_its_row(spark):
    texts = spark.createDataFrame([(1, "Alpha beta alpha"), (2, ""), (3, None), (4, "x_1 É y"), (5, " \n ")], "doc_id bigint, text string")
    made = vectors.embed_with(texts)
    assert "Aggregate" not in plan(made)
    was = vectors.densify(vectors.hash_embed(texts))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, was.collect())) and {r[0] for r in made.collect()} == {1, 4}


FILES = [("w", "a.py", "import os\nclass A:\n    def m(self):\n        return 1\n"), ("w", "bad.py", "def ("), ("w", "c.ts", "const f = async (a) => {\n}"), ("w", "n.py", None)]


def test_a_file_is_parsed_once_for_tables_and_chunks(spark):
    files = spark.createDataFrame(FILES, "workspace_id string, path string, content string")
    store = pipelines.rebuild(files)
    assert not any("MapIn" in plan(store[k]) for k in ("chunks", "modules", "symbols", "errors"))
    alone = pipelines._chunks(files, extract.parse_python(files, ("chunk",)))
    assert sorted(map(tuple, store["chunks"].collect())) == sorted(map(tuple, alone.collect()))
    assert "MapIn" not in plan(extract.chunk_corpus(files))
    assert [r.path for r in store["errors"].collect()] == ["bad.py"]


def test_texts_that_cannot_be_cut_keep_their_tables(monkeypatch):
    def fails(*_):
        raise ValueError("no")

    monkeypatch.setattr(extract._Lines, "of", fails)
    code = "def f():\n    pass\n"
    assert [r["tag"] for r in extract._tagged_rows(code, frozenset({"chunk"}))] == ["error"]
    assert [r["tag"] for r in extract._tagged_rows(code, frozenset({"symbol", "chunk"}))] == ["symbol"]


class Value:
    def __init__(self, calls):
        self.calls, self.v = calls, None

    def exists(self):
        self.calls.append("exists")
        return self.v is not None

    def get(self):
        self.calls.append("get")
        return self.v

    def update(self, v):
        self.calls.append("update")
        self.v = v

    def clear(self):
        self.calls.append("clear")
        self.v = None


def test_sessions_of_a_bucket_cost_a_few_calls_to_the_state():
    calls, timers = [], set()
    value = Value(calls)
    handle = SimpleNamespace(
        getValueState=lambda *_: value, listTimers=lambda: (calls.append("list"), list(timers))[1],
        deleteTimer=lambda t: (calls.append("delete"), timers.discard(t)), registerTimer=lambda t: (calls.append("register"), timers.add(t)),
    )
    s = learners.Sessions(1000)
    s.init(handle)
    rows = []
    for i in range(500):
        rows += [(i, False, True, 10_000 * i, None, "focus", "hard"), (i, False, False, 10_000 * i + 900 + i % 2 * 200, i, None, None), (i, False, False, 10_000 * i + 5000, 1000 + i, None, None)]
    rows += [(0, True, False, 70, 7, None, None), (3, False, False, None, 8, None, None)]
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    lost = pd.concat(s.handleInputRows((1,), iter([pd.DataFrame(rows[:700], columns=learners._IN, dtype=object), pd.DataFrame(rows[700:], columns=learners._IN, dtype=object)]), now))
    assert len(calls) < 10 and len(timers) == 1
    assert sorted(lost["eval_id"]) == [8, *range(1000, 1500)] and not lost["consumed"].any()
    assert len(pd.concat(s.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 2000), None))) == 201
    rest = pd.concat(s.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10_000), None))
    assert len(rest) == 300 and list(rest["consumed"]) == [e % 2 == 0 for e in rest["eval_id"]] and value.v is None


def test_dotted_keys_and_watched_keys(spark):
    texts = ["", ".", "a", "a.b.c", "a..b", ".a", "a.", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.p, r.n) for r in df.select("t", ids.dotted_prefixes("t").alias("p"), ids.dots("t").alias("n")).collect()}
    for t in texts:
        parts = (t or "").split(".")
        assert got[t] == ([".".join(parts[:i]) for i in range(len(parts) - 1, 0, -1)], None if t is None else len(parts) - 1)
    linked = spark.createDataFrame([("w", "m", "a.b", "n", 0)], "workspace_id string, module_name string, raw_module string, name string, level int")
    # the requests once; their keys are made distinct with those of the calls
    assert plan(incremental._import_keys(linked)).count("Aggregate") == 1
