import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from terrane.llm import repeats as R
from terrane.llm import suffixes as S


def brute(rows, length=200):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for doc, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def answer(df):
    return sorted(map(tuple, R.repeat_report(df).collect()), key=str)


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh", b"a"])
def test_suffixes_sort_in_two_stages(letters):
    rng = random.Random(5)
    for _ in range(60):
        text = np.array([rng.choice(letters) for _ in range(rng.randint(1, 250))], np.uint8)
        depth = rng.choice([4, 8, 13, 40])
        rows = np.array(sorted(rng.sample(range(len(text)), rng.randint(1, len(text)))))
        order = S.two_stage(text, rows, depth)
        keys = [bytes(text[i : i + depth]) for i in order]
        assert keys == sorted(keys) and set(rows) <= set(order.tolist()) and len(set(order.tolist())) == len(order)
        rows = rows[rows + depth <= len(text)]
        if len(rows):
            count = Counter(bytes(text[i : i + depth]) for i in rows)
            assert S.repeated_starts(text, rows, depth).tolist() == [count[bytes(text[i : i + depth])] > 1 for i in rows]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)

    def noise(n):
        return "".join(rng.choice("abcdefghij klmnö") for _ in range(n))

    passage, header = noise(330), noise(120)
    rows = [(i, header + noise(150) + (passage[: rng.randint(190, 330)] if i % 3 == 0 else "") + noise(90)) for i in range(50)]
    rows += [(60, rows[1][1]), (61, rows[2][1][:-1] + "x"), (62, "ab" * 400), (63, noise(199)), (64, ""), (65, None), (66, passage[40:260] + noise(50) + passage[40:260]), (67, "z" * 199), (68, "y" * 201), (69, noise(5000) * 2)]
    return rows


def test_removed_bytes_match_brute_force(documents, corpus):
    assert answer(documents(corpus)) == brute(corpus)


def test_hot_anchors_give_the_same(documents, corpus, monkeypatch):
    monkeypatch.setattr(R, "HOT_SEGMENTS", 1)
    assert answer(documents(corpus)) == brute(corpus)


def test_edge_cases(documents):
    text = "0123456789" * 25
    rows = [(None, text[:210] + "!"), (4, "abc" * 100), (4, "abc" * 100), (5, None)]
    assert answer(documents(rows)) == brute(rows)
    assert R.repeat_report(documents([])).count() == 0
