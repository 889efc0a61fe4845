import hashlib
import random
import string

import numpy as np

from terrane.llm import linededup as L
from terrane.llm.cuckoo import CuckooFilter

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANKS = " \t\n\x0b\x0c\r"


def brute(rows):
    owner = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            owner.setdefault(key, set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(BLANKS).translate(LOWER)) < 10 or min(owner[k]) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def report(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in L.line_report(df).collect()}


def test_cuckoo_filter_holds_what_it_was_given_and_gives_it_back():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64)
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all() and len(f) == len(keys)
    assert f.contains(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)).mean() < 0.01
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and len(f) == 20_000
    assert CuckooFilter.load(f.dump()).contains(keys[10_000:]).all()
    full = CuckooFilter.of(np.arange(13, dtype=np.uint64))
    assert full.contains(np.arange(13, dtype=np.uint64)).all()
    assert not CuckooFilter.sized(1).insert(np.zeros(100, np.uint64))


def test_lines_match_brute_force(documents):
    rng = random.Random(1)
    pool = ["A common line of text", "  a COMMON line of text\t", "short", "", "Größe der Überschrift ÄÖ", "unique"]
    rows = [(i, "\n".join(rng.choice(pool) + (str(i) if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 6)))) for i in range(1, 60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "A common line of text\n" * 500 + "end"), (104, "x" * 200_000)]
    assert report(documents(rows)) == brute(rows)


def test_edge_cases(documents):
    twin = "the same long line\nown line of this text"
    got = L.line_report(documents([(None, twin), (5, twin), (5, twin)])).collect()
    # A null id counts as the last document; a repeated row loses nothing to itself.
    assert sorted((r.doc_id or 0, r.n_dropped) for r in got) == [(0, 2), (5, 0), (5, 0)]
    assert L.line_report(documents([])).count() == 0
    kept = L.dedup_lines(documents([(1, twin), (2, twin + "\nmore of it")])).orderBy("doc_id").collect()
    assert [r.text for r in kept] == [twin, "more of it"] and kept[1].n_chars == 10 and kept[1].h1 == 1


def test_insert_and_delete_are_reverses(documents):
    first, second = [(1, "line number one\nshared text here"), (2, "shared text here")], [(3, "shared text here\nline number one\nbrand new line"), (4, "another fresh line")]
    whole = L.insert(None, documents(first + second))
    grown = L.insert(L.insert(None, documents(first)), documents(second))

    def state(index):
        return sorted(map(tuple, index.counts.collect())), sum(len(CuckooFilter.load(bytes(r.body))) for r in index.filters.collect())

    assert state(whole) == state(grown)
    spark = whole.refs.sparkSession
    shrunk = L.delete(grown, spark.createDataFrame([(1,), (3,)], "doc_id long"))
    alone = L.insert(None, documents([(2, "shared text here"), (4, "another fresh line")]))
    assert state(shrunk) == state(alone)
    # Known documents are left as they are.
    assert state(L.insert(grown, documents(second))) == state(grown)
