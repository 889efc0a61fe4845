import zlib

import numpy as np
import pytest

from terrane.llm import quality, toxicity, trees


def auc(score, y):
    values, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count / 2)[place]
    return (rank[y == 1].mean() - y.sum() / 2) / (len(y) - y.sum())


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def judged(scored, labels, label):
    rows = scored.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", label).toPandas()
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    rows = rows[rows["held_out"]]
    return rows["score"].to_numpy(), rows[label].to_numpy(), rows["predicted"].to_numpy()


def test_quality_on_held_out_rows(tables):
    score, y, predicted = judged(quality.classify_quality(*tables), tables[1], "quality")
    assert auc(score, y) > 0.99 and (predicted == y).mean() > 0.97


def test_toxicity_on_held_out_rows(tables):
    score, y, predicted = judged(toxicity.classify_toxicity(*tables), tables[1], "toxic")
    assert auc(score, y) > 0.97 and predicted[y == 1].mean() > 0.85 and predicted[y == 0].mean() < 0.03


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(0)
    x = rng.random((800, 4))
    y = (x[:, 0] > 0.5) ^ (x[:, 2] > 0.7)
    forest = trees.fit(x, y.astype(float), trees=30)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    for row in x[:20]:
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] + (row[forest.feature[node]] > forest.threshold[node])
            total += forest.value[node]
        assert forest.margin(row[None])[0] == pytest.approx(total)
    assert trees.fit(np.zeros((0, 4)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]
    assert (trees.fit(x, np.ones(len(x))).score(x) > 0.9).all()


def test_edge_cases(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "word " * 50_000), (3, "word " * 50_000), (None, "text"), (4, "\x00\x01 ok")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for run in (quality.classify_quality, toxicity.classify_toxicity):
        rows = run(docs, labels).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert run(documents([]), labels).count() == 0
        untrained = run(docs, labels.limit(0)).collect()
        assert {r.score for r in untrained} == {0.5}
    kept = quality.keep_good(docs, labels.limit(0), 0.5)
    assert kept.columns == docs.columns and kept.count() == 6


def test_toxic_phrases_of_ordinary_words():
    rng = np.random.default_rng(3)
    usual = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)] + ["nobody", "wants", "them"]
    texts, y = [], np.arange(1200) % 3 == 0
    for bad in y:
        words = list(rng.choice(usual, 60))
        if bad:
            at = int(rng.integers(0, 57))
            words[at : at + 3] = ["nobody", "wants", "them"]
        texts.append(" ".join(words))
    model = toxicity.fit_texts(texts[:800], y[:800].astype(float))
    assert b"nobody wants" in model.dictionaries.toxic
    assert auc(model.score(texts[800:]), y[800:]) > 0.95
