import random
from collections import defaultdict

import numpy as np
import pytest

from terrane.llm import minhash as M
from terrane.llm.shingles import shingle_set


def plain_shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, least, of):
    sets = {d: plain_shingles(t, width) for d, t in rows}
    ids = list(sets)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and of * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def answer(df, *how):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df, *how).collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(60)]
    rows, n = [], 1
    # One dense group about the threshold, with a passage that unrelated texts share.
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(60)] = rng.choice(words)
        rows.append((n, " ".join(copy)))
        n += 1
    for _ in range(40):
        rows.append((n, " ".join(base[:12] + [rng.choice(words) for _ in range(30)])))
        n += 1
    rows += [(n, rows[70][1].upper()), (n + 1, "one two"), (n + 2, "ONE\ttwo "), (n + 3, "one"), (n + 4, ""), (n + 5, "  \n"), (n + 6, None), (n + 7, " ".join(words * 60))]
    rng.shuffle(rows)
    return rows


def test_components_match_brute_force(documents, corpus):
    assert answer(documents(corpus), 3, 85, 100) == brute(corpus, 3, 85, 100)


def test_open_postings_alone_find_all_links(documents, corpus, monkeypatch):
    monkeypatch.setattr(M, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(M, "SIDE", 16)
    assert answer(documents(corpus), 3, 85, 100) == brute(corpus, 3, 85, 100)


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_of_a_square_find_all_links(documents, corpus, monkeypatch, block):
    monkeypatch.setattr(M, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(M, "BLOCK", block)
    assert answer(documents(corpus), 3, 85, 100) == brute(corpus, 3, 85, 100)


def test_a_posting_of_hundreds_is_one_square(documents, monkeypatch):
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, shared + " " + " ".join(f"r{rng.randrange(10**9)}" for _ in range(20))) for i in range(600)]
    seen = {}
    keep = M.staged

    def counted(df, name="stage"):
        out = keep(df, name)
        seen.setdefault(name, out)
        return out

    monkeypatch.setattr(M, "staged", counted)
    assert {c for _, c, _ in answer(documents(rows), 3, 85, 100).values()} == set(range(600))
    largest = seen["open_postings"].agg({"rows": "max"}).first()[0]
    assert 256 < largest <= M.SIDE


def test_texts_of_ids_asked_about(documents, spark, monkeypatch):
    ids = [5, -3, 2**62, 77, 0]
    docs = documents([(i, f"t{i}") for i in [*ids, 77, 6, 8, None, *range(1000, 4000)]])
    asked = spark.createDataFrame([(i,) for i in [*ids, 99]], "doc_id long")
    for least in (M.LEAST_BITS, M.BITMAP):
        monkeypatch.setattr(M, "LEAST_BITS", least)
        got = sorted((r.doc_id, r.text) for r in M.texts_of(docs, asked).collect())
        assert got == sorted((i, f"t{i}") for i in [*ids, 77])
    assert M.texts_of(docs, asked.limit(0)).count() == 0
    plan = M.texts_of(docs, asked)._jdf.queryExecution().executedPlan().toString()
    assert "bitmap" in plan


def test_edge_cases(documents):
    text = " ".join(f"t{i}" for i in range(50))
    got = M.near_duplicates(documents([(None, text), (7, text), (7, text), (3, text), (3, "other words than those of the rest here")]), 3, 85, 100).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    # Null ids stay out; rows of one id are one document.
    assert by == {None: {(None, True)}, 7: {(3, False)}, 3: {(3, True)}} and len(got) == 5
    assert M.near_duplicates(documents([])).count() == 0
    kept = M.keep_one(documents([(1, text), (2, text + " more"), (3, None), (4, "")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and "sig" in kept.columns


def test_shingles_follow_the_contract():
    assert len(shingle_set("A b  c\td", 3)) == 2 and len(shingle_set("a a a a", 3)) == 1
    assert np.array_equal(shingle_set("É A", 3), shingle_set("É a", 3)) and not np.array_equal(shingle_set("É", 3), shingle_set("é", 3))
