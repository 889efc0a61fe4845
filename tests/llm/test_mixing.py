import random
from collections import Counter, defaultdict

import pytest

from terrane.llm import mixing as M


def level_targets(sizes):
    """Weighted shares of all words, the excess over three times a source dealt anew until none is over."""
    names = sorted(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        out = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix_meets_targets(documents):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice("aaabbcde")) for i in range(800)] + [(900, None, "a"), (901, "x\ty  z\n", None), (902, "", "empty")]
    got = M.mix_report(documents(rows)).collect()
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    sums, taken = Counter(), Counter()
    for doc, _, source in rows:
        sums["~" if source is None else source] += size[doc]
    want = level_targets(sums)
    source = {r[0]: "~" if r[2] is None else r[2] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        key = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sums[key] and r.target == pytest.approx(want[key])
        assert r.taken <= 3 * r.size and r.taken == r.size * len(r.shards)
        taken[key] += r.taken
    assert all(abs(taken[s] - want[s]) <= 21 for s in want)
    again = {r.doc_id: (r.taken, r.shards) for r in M.mix_report(documents(rows[::-1])).collect()}
    assert again == {r.doc_id: (r.taken, r.shards) for r in got}


def test_mix_rows_are_the_plan(documents):
    rows = [(i, "a b c", "s" if i % 3 else "t") for i in range(90)] + [(None, "x y", None), (5, "a b c", "s")]
    df = documents(rows)
    plan = Counter({r.doc_id: 0 for r in M.mix_report(df).collect()})
    for r in M.mix_report(df).collect():
        plan[r.doc_id] += len(r.shards)
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +plan
    assert M.mix(documents([])).count() == 0 and M.mix_report(documents([(1, None)])).first().taken == 0


def test_quotas_split_exactly_and_evenly(spark):
    quotas = spark.createDataFrame([("a", 500), ("b", 37), ("c", 0), ("d", 1)], "skey string, n long")
    nodes = M.split_quotas(quotas, levels=3).collect()
    assert len(nodes) == 8
    assert [sum(r.q[i] for r in nodes) for i in range(4)] == [500, 37, 0, 1]
    assert max(sum(r.q) for r in nodes) - min(sum(r.q) for r in nodes) <= 1


def test_draws_follow_the_hypergeometric(spark):
    draw = M._hypergeometric("30L", "100L", "50L", "u")
    got = Counter(r[0] for r in spark.range(4000).selectExpr("(id + 0.5D) / 4000 AS u").selectExpr(f"{draw} AS x").collect())
    from math import comb

    for k in range(10, 21):
        assert abs(got[k] / 4000 - comb(30, k) * comb(70, 50 - k) / comb(100, 50)) < 0.001
    by_seed = defaultdict(set)
    for seed in (1, 2):
        by_seed[seed] = {tuple(r.q) for r in M.split_quotas(spark.createDataFrame([("a", 64), ("b", 64)], "skey string, n long"), 3, seed).collect()}
    assert by_seed[1] != by_seed[2]
