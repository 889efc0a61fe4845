import random
from collections import defaultdict

import numpy as np
import pytest

from terrane.llm import caps, hnsw

KIND = "vec_id long, embedding array<float>, label int, rep long, v string, filter int"


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], KIND)

    return make


def clustered(n=500, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((20, dims))
    out = [(i, (heads[i % 20] + rng.standard_normal(dims) * rng.choice([0.05, 0.15, 0.6])).astype(np.float32).tolist()) for i in range(n)]
    return out + [(n + i, out[3][1]) for i in range(8)]


BAD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [float("inf")] + [1.0] * 15), (9005, [None] + [1.0] * 15), (9006, [])]


def near_by_force(rows, cosine=0.95):
    ids, v = [i for i, _ in rows], np.array([x for _, x in rows], float)
    n = np.linalg.norm(v, axis=1)
    close = v @ v.T / (n[:, None] * n[None, :]) >= cosine
    np.fill_diagonal(close, False)
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            low = min([label[i], *(label[j] for j in np.flatnonzero(close[i]))])
            changed |= low < label[i]
            label[i] = low
    least = defaultdict(lambda: 1 << 60)
    for i, x in zip(ids, label):
        least[x] = min(least[x], i)
    return {i: (int(close[k].sum()), least[label[k]], least[label[k]] == i) for k, i in enumerate(ids)}


@pytest.mark.parametrize("side", [caps.SIDE, 16])
def test_links_match_brute_force(table, monkeypatch, side):
    monkeypatch.setattr(caps, "SIDE", side)
    rows = clustered()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.near_vectors(table(rows + BAD)).collect()}
    want = near_by_force(rows) | {i: (0, i, True) for i, _ in BAD}
    assert got == want


@pytest.mark.parametrize("sketch_side, side, most", [(8, caps.SIDE, caps.MOST_PARTS), (caps.SKETCH_SIDE, 16, 1), (8, 16, 2)])
def test_large_filters_and_groups_match_brute_force(table, monkeypatch, sketch_side, side, most):
    monkeypatch.setattr(caps, "SKETCH_SIDE", sketch_side)
    monkeypatch.setattr(caps, "SIDE", side)
    monkeypatch.setattr(caps, "MOST_PARTS", most)
    rows = clustered(700, 24, 5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.near_vectors(table(rows + BAD)).collect()}
    assert got == near_by_force(rows) | {i: (0, i, True) for i, _ in BAD}


def test_vectors_are_not_written_once_a_filter(table, monkeypatch):
    seen, keep = {}, caps.staged

    def counted(df, name="stage"):
        out = keep(df, name)
        if "v" in out.columns:
            seen[name] = out.count()
        return out

    monkeypatch.setattr(caps, "staged", counted)
    rows = clustered()
    assert caps.near_vectors(table(rows)).count() == len(rows)
    assert seen and max(seen.values()) <= len(rows)


def test_sketches_keep_pairs_at_the_cosine():
    for dims in (8, 24, 64, 200):
        fine = caps.Sketch(dims, 0.95)
        x, y = caps._pairs(np.random.default_rng(11), dims, 0.95, 20_000)
        assert (fine.alike(*fine.of(x), *fine.of(y)) >= fine.least).all()
        x, y = caps._pairs(np.random.default_rng(12), dims, 0.3, 20_000)
        assert (fine.alike(*fine.of(x), *fine.of(y)) >= fine.least).mean() < 0.01


def test_near_vectors_edge_cases(table):
    assert caps.near_vectors(table([])).count() == 0
    got = caps.near_vectors(table([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [-0.0, 1.0]), (4, [0.0, 1.0])])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got if r.vec_id) == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False)]
    assert [r.kept for r in got if r.vec_id is None] == [True]


def nearest_by_force(rows, k=10, every=100):
    out = {}
    for q, v in rows:
        if q % every == 0:
            far = sorted((float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, x in rows if i != q)
            out[q] = far[:k]
    return out


def test_graph_recall_and_exact_scores(table, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 400)
    random.seed(2)
    rows = clustered(3000, seed=4)
    got = defaultdict(list)
    for r in hnsw.nearest(table(rows + BAD)).collect():
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    want = nearest_by_force(rows)
    assert set(got) == set(want)
    by_id = {i: np.array(v) for i, v in rows}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        for _, score, i in found:
            assert score == pytest.approx(float(np.sqrt(((by_id[q] - by_id[i]) ** 2).sum())), abs=1e-12)
        hits += len({f[2] for f in found} & {i for _, i in want[q]})
    assert hits / (10 * len(want)) >= 0.95


def test_nearest_edge_cases(table):
    assert hnsw.nearest(table([])).count() == 0
    assert hnsw.nearest(table(BAD)).count() == 0
    few = [(0, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (8, [0.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id) for r in hnsw.nearest(table(few)).orderBy("rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 7), (0, 3, 8)]


@pytest.mark.parametrize("dims, rows", [(8, 1_000_000), (12, 1_000_000), (16, 1_000_000)])
def test_short_vectors_share_filters_in_large_tables(dims, rows):
    code = caps.Code(rows, dims, 0.95)
    rng = np.random.default_rng(11)
    x, y = rng.standard_normal((2, 500, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    assert all(len(np.intersect1d(a, b)) for a, b in zip(code.decode(x), code.decode(y)))
