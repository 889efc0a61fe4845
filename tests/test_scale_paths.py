"""The paths taken for hot keys and large blocks give the plain answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import chunks as ck
from terrane.operators import graph
from terrane.operators import iterate
from terrane.operators import learning as ln
from terrane.operators import resolve
from terrane.operators.iterate import ancestor_closure, connected_components, k_hop
from terrane.operators.intervals import holding, interval_labels, nearest, open_over
from terrane.operators.knn import build_index, knn, search, visited
from terrane.plans import derived
from terrane.plans.views import SCALED, VIEWS
from terrane.session import running_row_number


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def _events(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        user = 1 if i % 3 == 0 else rng.randrange(2, 9)
        data.append((i, user, rng.choice(["api", "ui"]), rng.randrange(0, 400), rng.choice([None, "understood", "confused", "mastered"])))
    return spark.createDataFrame(data, "event_id long, user_id long, topic string, s long, outcome string").withColumn(
        "ts", F.timestamp_seconds("s").cast("timestamp_ntz")
    ).drop("s")


def test_running_numbers_of_a_hot_key(spark):
    e = _events(spark)
    hot = running_row_number(e, ["user_id"], ["ts", "event_id"], "n", hot_rows=50, slice_rows=10)
    cold = running_row_number(e, ["user_id"], ["ts", "event_id"], "n")
    assert rows(hot.select("event_id", "n")) == rows(cold.select("event_id", "n"))


def test_states_of_a_hot_key(spark):
    e = _events(spark)
    hot = ln.topic_state_before(e, hot_rows=40).select("event_id", F.coalesce("state", F.lit("")).alias("s"))
    cold = ln.topic_state_before(e).select("event_id", F.coalesce("state", F.lit("")).alias("s"))
    assert rows(hot) == rows(cold)


def _fold(sizes, low, high):
    groups, current = [], None
    for i, t in enumerate(sizes):
        if current is not None and current < low and current + t <= high:
            current += t
            groups[-1].append(i)
        else:
            current = t
            groups.append([i])
    return groups


def test_merge_blocks_match_a_plain_fold(spark):
    rng = random.Random(3)
    data, want = [], []
    for source in ("a", "b", "c"):
        sizes = [rng.choice([0, 1, 3, 20, 60, 99, 100, 300, 512, 600]) for _ in range(200)]
        data += [(source, i, f"{source}{i}", i, i + 1, f"t{i}", t) for i, t in enumerate(sizes)]
        want += [(source, g[0], len(g), "\n\n".join(f"t{i}" for i in g)) for g in _fold(sizes, 100, 512)]
    df = spark.createDataFrame(data, "source string, ord long, id string, start_line int, end_line int, text string, token_count int")
    for block in (7, 50, 1000):
        got = ck.merge_small_chunks(df, block_rows=block).select("source", "ord", "merged", "text")
        assert rows(got) == sorted(want), block


def test_pack_sections_with_hot_sizes(spark):
    rng = random.Random(5)
    data = [(1, i, "body", rng.choice([3, 3, 3, 7, 40])) for i in range(200)] + [(1, 200, "imports", 10), (2, 0, "body", 500)]
    df = spark.createDataFrame(data, "doc_id long, ord int, kind string, size long")
    left, want = 100 - 10, {(1, 200), }
    for _, ord_, _, size in sorted((r for r in data if r[0] == 1 and r[2] == "body"), key=lambda r: (-r[3], r[1])):
        if size <= left:
            left -= size
            want.add((1, ord_))
    got = ck.pack_sections(df, 100, hot_rows=20).filter("kept").select("doc_id", "ord")
    assert set(rows(got)) == want


def test_knn_is_exact_across_cells_and_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[100:200] = base[100]  # a third are copies of one vector
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<float>")
    queries = store.withColumnRenamed("vec_id", "query_id")
    got = knn(queries, store, 4, pivots=20, shard_bytes=2000, query_bytes=1000).select("query_id", "rank", "vec_id")
    d = ((base[:, None, :].astype(float) - base[None, :, :]) ** 2).sum(2)
    want = [(q, r + 1, v) for q in range(300) for r, v in enumerate(sorted(range(300), key=lambda v: (d[q, v], v))[:4])]
    assert rows(got) == sorted(want)


def test_knn_visits_only_cells_that_can_win(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 6)) * 50
    base = (centres[np.arange(600) % 20] + rng.normal(size=(600, 6))).astype(np.float32)
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<float>").repartition(5)
    queries = store.withColumnRenamed("vec_id", "query_id")
    index = build_index(store, pivots=40)
    assert index.counts.sum() == 600
    visits = visited(index, queries, 3).collect()
    assert len(visits) == 600 and sum(r.visited for r in visits) < 0.3 * sum(r.cells for r in visits)
    d = ((base[:, None, :].astype(float) - base[None, :, :]) ** 2).sum(2)
    want = [(q, r + 1, v) for q in range(600) for r, v in enumerate(sorted(range(600), key=lambda v: (d[q, v], v))[:3])]
    assert rows(search(index, queries, 3).select("query_id", "rank", "vec_id")) == sorted(want)


def test_knn_of_few_rows(spark):
    store = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 4.0]), ("n", None)], "vec_id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, None)], "query_id int, embedding array<float>")
    assert rows(knn(queries.dropDuplicates(), store, 5).select("query_id", "rank", "vec_id", "distance")) == [(1, 1, "a", 0.0), (1, 2, "b", 25.0)]
    assert rows(knn(queries, store.limit(0), 5)) == []
    assert rows(knn(queries.limit(0), store, 5)) == []


def _random_tree(rng, n, shape):
    ids = [f"n{i:03d}" for i in range(n)]
    parent = {}
    for i, x in enumerate(ids):
        if i and rng.random() < 0.97:
            parent[x] = ids[i - 1] if shape == "chain" or (shape == "mixed" and rng.random() < 0.7) else ids[0] if shape == "star" else ids[rng.randrange(i)]
    return ids, parent


@pytest.mark.parametrize("shape", ["chain", "star", "mixed", "random"])
def test_interval_labels(spark, shape):
    rng = random.Random(shape)
    ids, parent = _random_tree(rng, 120, shape)
    parent["n119"] = "has no row"
    data = [(w, x, parent.get(x)) for w in ("a", "b") for x in ids] + [("c", "self", "self")]
    df = spark.createDataFrame(data, "workspace_id string, id string, parent_id string")
    labels = interval_labels(df)
    got = {(r.workspace_id, r.id): r for r in labels.collect()}
    assert set(got) == {(w, x) for w, x, _ in data} | {("a", "has no row"), ("b", "has no row")}
    closure = {}
    for x in [*ids, "has no row"]:
        up, at = [], x
        while at in parent:
            at = parent[at]
            up.append(at)
        closure[x] = up
    for w in ("a", "b"):
        for x in closure:
            assert got[w, x].depth == len(closure[x]) and got[w, x].parent_id == parent.get(x)
            for y in closure:
                inside = got[w, y].enter < got[w, x].enter and got[w, x].exit < got[w, y].exit
                assert inside == (y in closure[x])
    kept = set(rng.sample(ids, 25))
    shown = spark.createDataFrame([("a", x) for x in kept], "workspace_id string, id string")
    placed = labels.join(shown, ["workspace_id", "id"], "left_semi")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts
    try:
        near = {r.id: r.shown for r in nearest(labels.filter("workspace_id = 'a'"), placed).collect()}
        count = {r.id: r.open for r in open_over(labels.filter("workspace_id = 'a'"), placed, True).collect()}
        held = {r.id for r in holding(labels.filter("workspace_id = 'a'"), placed).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert near == {x: next((y for y in [x, *closure[x]] if y in kept), None) for x in closure}
    assert count == {x: sum(y in kept for y in closure[x]) for x in closure}
    assert held == {y for x in kept for y in closure[x]}


def test_labels_refuse_what_is_no_tree(spark):
    schema = "workspace_id string, id string, parent_id string"
    with pytest.raises(ValueError, match="cycle"):
        interval_labels(spark.createDataFrame([("w", "a", "b"), ("w", "b", "c"), ("w", "c", "a"), ("w", "d", None)], schema))
    with pytest.raises(ValueError, match="several"):
        interval_labels(spark.createDataFrame([("w", "a", "b"), ("w", "a", "c")], schema))
    assert interval_labels(spark.createDataFrame([], schema)).count() == 0


def _graph(spark):
    rng = random.Random(11)
    names = [f"n{i:03d}" for i in range(120)]
    edges = [("w", rng.choice(names), rng.choice(names)) for _ in range(90)] + [("w", "n000", n) for n in names[60:100]]
    nodes = spark.createDataFrame([("w", n) for n in names], "workspace_id string, id string")
    return names, edges, nodes, spark.createDataFrame(edges, "workspace_id string, source string, target string")


def test_components_partition_the_nodes(spark):
    names, edges, nodes, df = _graph(spark)
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r["id"]: r["component"] for r in connected_components(nodes, df).collect()}
    assert got == {n: find(n) for n in names}


def test_component_rounds_move_numbers_and_keep_the_smallest_id(spark, monkeypatch):
    kept, cut = [], iterate.cut_lineage
    monkeypatch.setattr(iterate, "cut_lineage", lambda df: kept.append(df.dtypes) or cut(df))
    nodes = [("w", i) for i in ("b", "a\u00e9", "az", "B", "\U0001f600", "\uffee", "lone", "b", "b", None)] + [("v", "b"), ("v", "az"), (None, "x"), (None, "y")]
    edges = [("w", "b", "az"), ("w", "az", "a\u00e9"), ("w", "\U0001f600", "\uffee"), ("w", "B", "gone"), ("w", "lone", "lone"), ("w", "b", "az"), ("v", "b", "az"), ("v", "b", "B"), (None, "x", "y"), ("w", None, "b")]
    got = connected_components(spark.createDataFrame(nodes, "workspace_id string, id string"), spark.createDataFrame(edges, "workspace_id string, source string, target string"))
    want = [("w", "b", "az"), ("w", "az", "az"), ("w", "a\u00e9", "az"), ("w", "B", "B"), ("w", "lone", "lone"), ("w", "\uffee", "\uffee"), ("w", "\U0001f600", "\uffee"),
            ("w", None, None), ("v", "az", "az"), ("v", "b", "az"), (None, "x", "x"), (None, "y", "y")]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert kept and {t for types in kept for _, t in types} == {"bigint"}  # each round shuffled and wrote the ids themselves


def test_k_hop_grows_with_depth(spark):
    _, edges, nodes, df = _graph(spark)
    centers = spark.createDataFrame([("w", "n001"), ("w", "missing")], "workspace_id string, id string")
    around = {}
    for _, a, b in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    reached = {"n001": 0}
    for depth in range(4):
        got = {r["id"]: r["hop"] for r in k_hop(nodes, df, centers, depth).collect()}
        assert got == {n: h for n, h in reached.items() if h <= depth}
        for n in [n for n, h in reached.items() if h == depth]:
            for o in around.get(n, ()):
                reached.setdefault(o, depth + 1)


def test_many_searches_share_a_pass(spark):
    names, edges, nodes, df = _graph(spark)
    around = {}
    for _, a, b in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    asked = [("w", q, f"n{(q * 7 + i) % 120:03d}") for q in range(150) for i in range(1 + q % 3)]
    centers = spark.createDataFrame(asked + [("w", 999, "missing")], "workspace_id string, query_id int, id string")
    got = {(r.query_id, r.id): r.hop for r in k_hop(nodes, df, centers, 2, ["query_id"]).collect()}
    want = {}
    for _, q, n in asked:
        layer = {n}
        for hop in range(3):
            for x in layer:
                want[q, x] = min(hop, want.get((q, x), 9))
            layer = set().union(*(around.get(x, set()) for x in layer))
    assert got == want


def test_closure_of_a_long_chain(spark):
    chain = [("w", f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    df = spark.createDataFrame(chain, "workspace_id string, id string, parent_id string")
    got = {(r["id"], r["ancestor"], r["distance"]) for r in ancestor_closure(df).collect()}
    assert got == {(f"n{i}", f"n{j}", i - j) for i in range(40) for j in range(i)}


def test_text_pairs_move_a_text_once_and_give_the_rows_of_the_view(spark, tmp_path):
    ids = [*range(40), *range(250, 260), 511, 511, 512, 512, -256, -257, 1_000_000, 1_000_001, 1_000_011, 1_000_022, 2_000_022, 2_000_033, 3, 3, 22, 22, None, None, -1, -7, -11]
    rows = [(i, None if n % 9 == 4 else "" if n % 13 == 0 else f"text {n}\nmore") for n, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = (derived.query(spark, str(tmp_path), views["fx_pairs"]) for views in (SCALED, VIEWS))
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 80
    # two joins shuffled and sorted the texts three times, after the newer texts had been written
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_views_on_pairs_of_modules_join_them_once_and_give_the_rows_of_the_views(spark, tmp_path):
    keys = [*range(1, 60), 7, 7, 9, 101, 202, None, -3, -4, -5, 0]
    part = [(k, f"TYPE {n % 4}", f"Brand#{n % 3}") if n % 11 else (k, None, "Brand#1") for n, k in enumerate(keys)]
    spark.createDataFrame(part, "p_partkey bigint, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(None if n % 50 == 49 else n // 6, keys[(n * 7 + n // 5) % len(keys)], n % 3, None if n % 17 == 3 else n % 4, float(n % 9), float(n % 2)) for n in range(900)]
    lines += lines[:100] + [(1, 5000, 9, 1, 1.0, 1.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("fx_pairs_ab", "fx_imports", "fx_calls", "fx_edges"):
        got, want = (derived.query(spark, str(tmp_path), views[name]) for views in (SCALED, VIEWS))
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 80
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_risk_moves_a_pair_of_neighbours_once(spark):
    ends = ["a", "b", "c", None]
    edges = spark.createDataFrame([("w", ends[i % 4], ends[(i // 4) % 4], "t") for i in range(40)], "workspace_id string, source string, target string, type string")
    nodes = spark.createDataFrame([("w", x) for x in ("a", "b", "c", "z", "a")], "workspace_id string, id string")
    out = graph.node_risk(nodes, edges)
    # the plain way: both directions of every edge
    plain = graph.neighbor_pairs(edges).groupBy("id", "neighbor").count().groupBy("id").agg({"count": "sum", "neighbor": "count", "*": "count"})
    want = {r["id"]: (r["sum(count)"], r["count(1)"]) for r in plain.collect()}
    got = [(r["id"], (r["coupling"], r["complexity"])) for r in out.collect()]
    assert len(got) == 5 and all(v == want.get(i, (0, 0)) for i, v in got)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    # rows are counted for a pair before its ends are parted
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate") < text.rindex("Aggregate")


def test_guesses_that_begin_like_no_key_are_dropped(spark, monkeypatch):
    modules = spark.createDataFrame([("w", m) for m in ("src.a.b", "src.c", "lib.x", "top")], "workspace_id string, module_name string")
    asked = [("src.a.b", "b"), ("src.a", "b"), ("src.c.f", "f"), ("root.src.a.b", "q"), ("a.b", ""), ("a", "b"), ("top.y", "y"), ("numpy.linalg.norm", "norm"), ("x", None), ("other.lib.x.z", None)]
    imports = spark.createDataFrame([("w", "me", i, m, n, 0) for i, (m, n) in enumerate(asked)], "workspace_id string, module_name string, ord int, raw_module string, name string, level int")
    resolved = lambda: rows(resolve.resolve_imports(imports, modules).select("ord", "target"))
    kept, sift = [], resolve._possible
    monkeypatch.setattr(resolve, "_possible", lambda g, b: kept.append((g.count(), sift(g, b).count())) or sift(g, b))
    sifted = resolved()
    monkeypatch.setattr(resolve, "BEGINNINGS", 0)
    assert sifted == resolved() and [t for _, t in sifted][:4] == ["src.a.b", "src.a.b", "src.c", "src.a.b"]
    assert kept[1][0] == kept[1][1] and kept[0][1] < kept[0][0] / 2
