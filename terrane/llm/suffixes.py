"""Suffix arrays of byte strings by two-stage sorting, to a fixed depth, in numpy."""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it sorts before its successor; the last one does not."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    # A run of equal bytes takes the answer of its end.
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out[:-1] = np.where(at < n - 1, step[np.minimum(at, n - 2)] > 0, False)
    return out


def direct_sort(text: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """``rows`` in the order of their first ``depth`` bytes; eight bytes a round, ties only."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    weights = [np.uint64(1 << (56 - 8 * i)) for i in range(8)]

    def word(at: np.ndarray) -> np.ndarray:
        return sum((padded[at + i].astype(np.uint64) * w for i, w in enumerate(weights)), np.zeros(len(at), np.uint64))

    rows = rows[np.argsort(word(rows), kind="stable")]
    value = word(rows)
    edge = np.r_[True, value[1:] != value[:-1]] if len(rows) else np.zeros(0, bool)
    for at in range(8, depth, 8):
        group = np.cumsum(edge)
        alone = edge & np.r_[edge[1:], True]
        open_ = np.flatnonzero(~alone)
        if len(open_) == 0:
            break
        value = word(rows[open_] + at)
        order = np.lexsort((value, group[open_]))
        rows[open_] = rows[open_][order]
        value, tied = value[order], group[open_]
        edge[open_] |= np.r_[True, (value[1:] != value[:-1]) | (tied[1:] != tied[:-1])]
    return rows


def two_stage(text: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` starting at ``rows``, and a few more, in the order of ``depth`` bytes.

    Suffixes smaller than their successors are sorted directly.  The others
    follow by one scan over the buckets of first bytes: the successor of each
    has been met in order by the time its own bucket is reached.
    """
    small = smaller_than_next(text)
    wanted = np.zeros(len(text) + 1, bool)
    wanted[rows] = True
    while True:
        # What is induced needs its successor in the array.
        more = np.flatnonzero(wanted[:-1] & ~small) + 1
        more = more[~wanted[more] & (more < len(text))]
        if len(more) == 0:
            break
        wanted[more] = True
    held = np.flatnonzero(wanted[:-1])
    direct = direct_sort(text, held[small[held]], depth)
    first = text[direct]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    last = len(text) - 1
    if len(text) and wanted[last]:
        waiting[text[last]].append(np.array([last]))
    out = []
    for c in range(256):
        queue = list(waiting[c])
        larger = []
        while queue:
            bucket = np.concatenate(queue)
            larger.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[wanted[before] & ~small[before]]
            queue = [before[text[before] == c]] if (text[before] == c).any() else []
            _deal(text, before[text[before] > c], waiting)
        sorted_ = direct[first == c]
        before = sorted_[sorted_ > 0] - 1
        _deal(text, before[wanted[before] & ~small[before] & (text[before] > c)], waiting)
        out += [*larger, sorted_]
    return np.concatenate(out) if out else held


def _deal(text: np.ndarray, rows: np.ndarray, waiting: list) -> None:
    """Append ``rows``, in order, to the buckets of their first bytes."""
    if len(rows) == 0:
        return
    heads = text[rows]
    order = np.argsort(heads, kind="stable")
    rows, heads = rows[order], heads[order]
    for part in np.split(rows, np.flatnonzero(np.diff(heads)) + 1):
        waiting[text[part[0]]].append(part)


def common_with_next(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, up to ``depth``, of each suffix in ``order`` and the one after it."""
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    for i in range(depth):
        left = left[(padded[a[left] + i] == padded[b[left] + i]) & (a[left] + i < len(text)) & (b[left] + i < len(text))]
        if len(left) == 0:
            break
        out[left] += 1
    return out


def repeated_starts(text: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """Which of ``rows`` start a string of ``depth`` bytes that another of ``rows`` starts as well."""
    asked = np.zeros(len(text) + 1, bool)
    asked[rows] = True
    order = two_stage(text, rows, depth)
    order = order[asked[order]]
    twin = common_with_next(text, order, depth) >= depth
    hit = np.r_[twin, False] | np.r_[False, twin]
    found = np.zeros(len(text) + 1, bool)
    found[order[hit[: len(order)]]] = True
    return found[rows]
