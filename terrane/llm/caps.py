"""Embedding near-dedup with spherical-cap filters.

Filter directions are a structured product code: after a random rotation a
vector is parted into blocks, each with a small random codebook, and every
combination of code words is a direction.  A vector is decoded to the list of
all directions whose inner product with it exceeds a bound, by enumerating
code words in falling order.  Vectors meet in the filters they share.

What meets there are sketches of two bits a projection, whose likeness rules
out nearly all unrelated vectors; what they leave hangs together in groups.
A vector goes to its group once, with its components, and there cosines are
computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, staged
from .shingles import mixed
from .vectors import as_doubles, classes, valid

COSINE = 0.95
BLOCKS = 2
#: Filters a close pair is expected to share: it is missed with a likelihood near exp(-EXPECTED).
EXPECTED = 36.0
#: Independent rotations the directions are shared among: one product code alone leaves some vectors few filters.
ROTATIONS = 8
#: Pairs drawn to measure that; with fewer dimensions than these there is one filter, and all is compared in squares.
PROBES, LEAST_DIMS = 300, 8
#: Pairs none of which may share no filter; words of a block at most, and the bound below which one filter serves as well.
CHECKED, MOST_WORDS, LEAST_BOUND = 2000, 2048, 0.5
#: Unrelated vectors in one filter, which sets how selective filters are.
FILTER_ROWS = 24
#: Share of the largest score, sqrt(dims), that a bound starts from at most; short vectors reach no more with few words.
REACH = 0.86
#: Rows one task compares in one go; larger filters are cut into squares of this side.
SIDE = 1024
#: Postings dealt to one group of filters.
GROUP_ROWS = 20_000
SEED = 7
#: Projections of a sketch, and the two-bit quantizer of normal variables: its cut and levels.
PROJECTIONS, CUT, LOW, HIGH = 64, 0.9816, 0.4528, 1.510
#: A sketch rejects a pair only this many standard deviations below what pairs at the cosine show.
DEVIATIONS = 8.0
#: Vectors decoded in one go, sketches in one task, and in one part of a filter that has more.
DECODE_ROWS, TASK_SKETCHES, SKETCH_SIDE = 1000, 200_000, 8192
#: Vectors drawn to see which filters have more; that decides how work is dealt, not what is found.
DRAWN = 20_000
#: Groups of more squares a side are compared filter by filter.
MOST_PARTS = 64
#: A sketch under a filter: key of the filter, class, signs, and which projections are large.
POSTING = np.dtype([("key", "<u4"), ("rep", "<i8"), ("signs", "<u8"), ("large", "<u8")])


def _tail(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


def _both(t: float, rho: float) -> float:
    """P(both of two normal variables with correlation ``rho`` exceed ``t``)."""
    x = np.linspace(t, t + 10, 4001)
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    above = np.array([_tail((t - rho * a) / math.sqrt(1 - rho * rho)) for a in x])
    return float(np.trapezoid(density * above, x))


def _pairs(rng, dims: int, cosine: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors, and others at the cosine to them."""
    x, y = rng.standard_normal((2, n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * y


class Code:
    """The directions of one run: chosen from the number of vectors and their length."""

    def __init__(self, vectors: int, dims: int, cosine: float):
        rng = np.random.default_rng(SEED)
        share = min(0.25, FILTER_ROWS / max(vectors, 1))
        low, high = 0.0, 8.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if _tail(mid) > share else (low, mid)
        self.bound = min(low, REACH * math.sqrt(dims))
        self.blocks = min(BLOCKS, dims)
        self.dims, self.rotations = dims, ROTATIONS
        if dims < LEAST_DIMS:
            self._one_filter(rng)
            return
        self.words = self._start(cosine)
        # At high bounds the directions stray from the normal law, and beyond sqrt(dims) none is reached: what pairs at the
        # cosine share is measured.  A bound that takes too many words is lowered; its larger filters are cut into squares.
        few, many = (_pairs(np.random.default_rng(SEED + k), dims, cosine, n) for k, n in ((1, PROBES), (2, CHECKED)))
        tries = 0
        while self.bound >= LEAST_BOUND:
            self._draw(rng)
            shared = self._shared(few)
            mean = float(shared.mean())
            if mean >= 0.6 * EXPECTED and shared.min() > 0 and self._shared(many).min() > 0:
                return
            words = math.ceil(self.words * max(1.2, min(4.0, EXPECTED / max(mean, 0.1)) ** (1 / self.blocks)))
            tries += 1
            if words > MOST_WORDS or tries == 8:
                self.bound, tries = self.bound * 0.9, 0
                self.words = self._start(cosine)
            else:
                self.words = words
        self._one_filter(rng)

    def _start(self, cosine: float) -> int:
        joint = max(_both(self.bound, min(cosine, 0.9999)), 1e-30)
        return min(MOST_WORDS, max(2, math.ceil((EXPECTED / ROTATIONS / joint) ** (1 / self.blocks))))

    def _one_filter(self, rng) -> None:
        """All vectors meet in one filter, and are compared in squares."""
        self.bound, self.blocks, self.words, self.rotations = -math.inf, 1, 1, 1
        self._draw(rng)

    def _shared(self, probes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """How many filters each pair shares."""
        return np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*map(self.decode, probes))])

    def _draw(self, rng) -> None:
        dims = self.dims
        cuts = np.linspace(0, dims, self.blocks + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        # Scaled so that the inner product of a unit vector and a direction varies as a standard normal.
        self.codes = [
            (np.linalg.qr(rng.standard_normal((dims, dims)))[0], [self._book(rng, p.stop - p.start) for p in self.parts]) for _ in range(self.rotations)
        ]

    def _book(self, rng, size: int) -> np.ndarray:
        """Orthogonal frames of equal length, as many as give the words."""
        frames = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(math.ceil(self.words / size))]
        return np.concatenate(frames)[: self.words] * math.sqrt(size)

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """The filters of each unit vector, sorted."""
        rows, ids = self.flat(units)
        order = np.lexsort((ids, rows))
        return np.split(ids[order], np.cumsum(np.bincount(rows, minlength=len(units)))[:-1])

    def flat(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters of the unit vectors."""
        rows, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = self.words**self.blocks
        for at in range(0, len(units), DECODE_ROWS):
            for r, code in enumerate(self.codes):
                of, own = self._decode(units[at : at + DECODE_ROWS], *code)
                rows.append(of + at), ids.append(own + r * size)
        return np.concatenate(rows), np.concatenate(ids)

    def _decode(self, units: np.ndarray, rotation: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        turned = units @ rotation
        scores = [turned[:, p] @ b.T for p, b in zip(self.parts, books)]
        # Partial sums that cannot reach the bound with the best words still to come are cut off.
        best = np.cumsum([s.max(1) for s in scores][::-1], axis=0)[::-1]
        rows, ids, sums = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units))
        for k, s in enumerate(scores):
            to_come = best[k + 1] if k + 1 < self.blocks else np.zeros(len(units))
            at, word = np.nonzero(s[rows] >= (self.bound - sums - to_come[rows])[:, None])
            rows, ids, sums = rows[at], ids[at] * self.words + word, sums[at] + s[rows[at], word]
        return rows, ids


class Sketch:
    """Two bits for each of some projections, and how alike those of a pair at the cosine are at least."""

    def __init__(self, dims: int, cosine: float):
        rng = np.random.default_rng(SEED)
        frames = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(math.ceil(PROJECTIONS / dims))]
        self.turn = np.concatenate(frames, axis=1)[:, :PROJECTIONS] * math.sqrt(dims)
        x, y = _pairs(rng, dims, cosine, CHECKED)
        alike = self.alike(*self.of(x), *self.of(y))
        self.least = float(alike.mean() - DEVIATIONS * alike.std())

    def of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signs, large) of each unit vector, a bit a projection."""
        turned = units @ self.turn
        return tuple(np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0] for bits in (turned < 0, np.abs(turned) > CUT))

    @staticmethod
    def alike(sa: np.ndarray, la: np.ndarray, sb: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """Cosine of the quantized projections."""
        ones = lambda bits: np.bitwise_count(bits).astype(float)
        step, apart, both = HIGH - LOW, sa ^ sb, la & lb
        na, nb = ones(la), ones(lb)
        dot = LOW * LOW * (PROJECTIONS - 2 * ones(apart)) + LOW * step * (na + nb - 2 * ones(apart & la) - 2 * ones(apart & lb)) + step * step * (ones(both) - 2 * ones(apart & both))
        norm = lambda n: LOW * LOW * PROJECTIONS + (HIGH * HIGH - LOW * LOW) * n
        return dot / np.sqrt(norm(na) * norm(nb))


def _pack(x: np.ndarray) -> bytes:
    """Single precision where that is exact, which halves what is shuffled."""
    small = x.astype(np.float32)
    return small.tobytes() if (small == x).all() else x.tobytes()


def _unpack(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * dims else np.float64).astype(float)


def _units(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def alike(vectors: DataFrame, n: int, code: Code, fine: Sketch) -> DataFrame:
    """(a, b): classes whose sketches are alike in a filter they share, linked as far as it takes to hang together.

    A filter's sketches meet in one task, which a task of many small filters
    shares; a filter of more than ``SKETCH_SIDE`` rows is dealt into squares.
    """
    drawn = vectors.select("v").sample(min(1.0, DRAWN / n), SEED).limit(2 * DRAWN).collect() if n > DRAWN else vectors.select("v").collect()
    each, rows = np.unique(code.flat(_units(np.array([r[0] for r in drawn], float)))[1], return_counts=True) if drawn else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    scale = n / max(1, len(drawn))
    parts = np.ceil(rows * scale / SKETCH_SIDE).astype(np.int64)
    hot, hot_parts = each[parts > 1], parts[parts > 1]
    tasks = max(8, math.ceil((rows.sum() + (rows * (parts - 1)).sum()) * scale / TASK_SKETCHES))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            units, reps = _units(np.array(b.column("v").to_pylist(), float)), b.column("rep").to_numpy()
            at, filters = code.flat(units)
            key = mixed(filters.astype(np.uint64))
            if len(hot):
                place = np.minimum(np.searchsorted(hot, filters), len(hot) - 1)
                s = np.where(hot[place] == filters, hot_parts[place], 1)
                # Row r of an s by s grid meets every part once: the cells (least, greatest) that hold its part.
                part = (mixed(reps.astype(np.uint64))[at] % s.astype(np.uint64)).astype(np.int64)
                other = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                at, key, part, s = (np.repeat(x, s) for x in (at, key, part, s))
                cell = np.minimum(part, other) * s + np.maximum(part, other)
                key = np.where(s > 1, mixed(key + cell.astype(np.uint64)), key)
            signs, large = fine.of(units)
            task = (key % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(task, kind="stable")
            out = np.empty(len(order), POSTING)
            out["key"], out["rep"] = (key[order] >> np.uint64(32)).astype(np.uint32), reps[at[order]]
            out["signs"], out["large"] = signs[at[order]], large[at[order]]
            named, first = np.unique(task[order], return_index=True)
            yield pa.record_batch([pa.array(named, pa.int64()), pa.array([x.tobytes() for x in np.split(out, first[1:])], pa.binary())], ["task", "rows"])

    def link(part: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(part["rows"]), POSTING)
        rows = rows[np.argsort(rows["key"], kind="stable")]
        heads = _hang_together(rows, fine)
        hung = np.flatnonzero(heads != np.arange(len(rows)))
        links = np.stack([rows["rep"][hung], rows["rep"][heads[hung]]], axis=1)
        return pd.DataFrame(np.unique(links[links[:, 0] != links[:, 1]], axis=0), columns=["a", "b"])

    packed = vectors.select("rep", "v").mapInArrow(post, "task long, rows binary")
    return packed.groupBy("task").applyInPandas(link, "a long, b long")


def _hang_together(rows: np.ndarray, fine: Sketch) -> np.ndarray:
    """For each row of ``rows``, sorted by key, the first row of its key that alike sketches lead to."""
    key, signs, large = (np.ascontiguousarray(rows[c]) for c in ("key", "signs", "large"))
    head = np.arange(len(rows))
    left, step = head, 0
    while len(left):
        step += 1
        left = left[left + step < len(rows)]
        left = left[key[left] == key[left + step]]
        a = left[head[left] != head[left + step]]
        a = a[fine.alike(signs[a], large[a], signs[a + step], large[a + step]) >= fine.least]
        if len(a) == 0:
            continue
        # Heads that meet take the least of them, until nothing moves.
        onto = np.arange(len(rows))
        p, q = head[a], head[a + step]
        while (moves := onto[p] != onto[q]).any():
            p, q = p[moves], q[moves]
            x, y = onto[p], onto[q]
            np.minimum.at(onto, np.maximum(x, y), np.minimum(x, y))
            while (further := onto[onto] != onto).any():
                onto = onto[onto]
        head = onto[head]
    return head


def compare_groups(placed: DataFrame, dims: int, cosine: float) -> DataFrame:
    """(rep, links, joined) as of ``compare``, of all pairs within the groups of ``placed`` (rep, v, copies, component, s)."""
    tasks = max(1, math.ceil(placed.count() / GROUP_ROWS))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("s")).cast("int"))
    cells = dealt.select("*", F.explode(F.expr("transform(sequence(0, s - 1), o -> struct(least(part, o) AS x, greatest(part, o) AS y))")).alias("cell"))
    keyed = cells.select(
        "rep", "v", "copies", "component", "part", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"),
        F.when(F.col("s") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(-1 - F.pmod(F.xxhash64("component", "cell"), F.lit((1 << 62)))).alias("task"),
    )

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, int] = {}
        joined: list[tuple[int, int]] = []
        for (_, x, y), group in rows.groupby(["component", "x", "y"], sort=False):
            left, right = group[group["part"] == x], group[group["part"] == y]
            _compare(left, right, x == y, None, dims, cosine, out, joined)
        return _found(out, joined)

    return keyed.groupBy("task").applyInPandas(links, "rep long, links long, a long, b long")


def _found(out: dict, joined: list) -> pd.DataFrame:
    """(rep, links, a, b): link counts, and links."""
    pairs = pd.DataFrame(joined, columns=["a", "b"], dtype="int64").drop_duplicates()
    counted = pd.DataFrame({"rep": list(out), "links": list(out.values())}, dtype="int64")
    return pd.concat([
        counted.assign(a=None, b=None).astype({"a": "Int64", "b": "Int64"}),
        pairs.assign(rep=None, links=None).astype({"rep": "Int64", "links": "Int64", "a": "Int64", "b": "Int64"}),
    ])[["rep", "links", "a", "b"]]


def links_of(vectors: DataFrame, n: int, dims: int, cosine: float) -> DataFrame:
    """(rep, links, joined) as of ``compare``, for ``n`` classes of one length."""
    code = Code(n, dims, cosine)
    if code.bound == -math.inf:
        return compare(postings(vectors, code), dims, cosine)
    groups = staged(components(alike(vectors, n, code, Sketch(dims, cosine))).withColumnRenamed("id", "rep"), "vector_groups")
    parts = groups.groupBy("component").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("s"))
    placed = staged(vectors.select("rep", "v", "copies").join(groups.join(parts, "component"), "rep"), "placed_vectors")
    found = compare_groups(placed.filter(F.col("s") <= MOST_PARTS), dims, cosine)
    wide = placed.filter(F.col("s") > MOST_PARTS)
    return found if wide.isEmpty() else found.unionByName(compare(postings(wide, code), dims, cosine))


def postings(vectors: DataFrame, code: Code) -> DataFrame:
    """(rep, v, copies, filters, filter): every class under each of its filters; ``filters`` is their sorted list.

    ``v`` and ``filters`` are packed numbers.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("v").to_pylist(), float)
            if len(x) == 0:
                continue
            filters = code.decode(_units(x))
            yield pa.record_batch(
                [b.column("rep"), pa.array([_pack(r) for r in x], pa.binary()), b.column("copies"), pa.array([f.tobytes() for f in filters], pa.binary()), pa.array(filters, pa.list_(pa.int64()))],
                ["rep", "v", "copies", "filters", "each"],
            )

    found = vectors.select("rep", "v", "copies").mapInArrow(decode, "rep long, v binary, copies long, filters binary, each array<bigint>")
    return found.select("rep", "v", "copies", "filters", F.explode("each").alias("filter"))


def compare(posted: DataFrame, dims: int, cosine: float) -> DataFrame:
    """(rep, links, joined): link counts of each class, and a spanning set of its links, filter by filter.

    A pair is counted in the smallest filter its two vectors share.  A
    filter's rows are dealt into squares of ``SIDE``, so that no task holds a
    large filter whole; small filters share a task.
    """
    flat = staged(posted, "filter_postings")
    sizes = flat.groupBy("filter").agg(F.count("*").alias("n"))
    squares = sizes.select("filter", F.greatest(F.lit(1), F.ceil(F.col("n") / SIDE)).cast("int").alias("s"))
    total = flat.count()
    groups = max(1, math.ceil(total / GROUP_ROWS))
    dealt = flat.join(squares, "filter").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("s")).cast("int"))
    # Row r of an s by s grid meets every part once: the cells (least, greatest) that hold its part.
    cells = dealt.select("*", F.explode(F.expr("transform(sequence(0, s - 1), o -> struct(least(part, o) AS x, greatest(part, o) AS y))")).alias("cell"))
    keyed = cells.select(
        "rep", "v", "copies", "filters", "filter", "part", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"),
        F.when(F.col("s") == 1, F.pmod(F.xxhash64("filter"), F.lit(groups))).otherwise(-1 - F.pmod(F.xxhash64("filter", "cell"), F.lit((1 << 62)))).alias("task"),
    )

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, int] = {}
        joined: list[tuple[int, int]] = []
        for (_, x, y), group in rows.groupby(["filter", "x", "y"], sort=False):
            left, right = group[group["part"] == x], group[group["part"] == y]
            _compare(left, right, x == y, int(group["filter"].iloc[0]), dims, cosine, out, joined)
        return _found(out, joined)

    return keyed.groupBy("task").applyInPandas(links, "rep long, links long, a long, b long")


def _compare(left: pd.DataFrame, right: pd.DataFrame, same: bool, filter_id: int | None, dims: int, cosine: float, out: dict, joined: list) -> None:
    if len(left) == 0 or len(right) == 0:
        return
    a, b = (np.stack([_unpack(r, dims) if isinstance(r, bytes) else r for r in side["v"]]).astype(float) for side in (left, right))
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    close = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]) >= cosine
    if same:
        close = np.triu(close, 1)
    ia, ib = np.nonzero(close)
    if len(ia) == 0:
        return
    if filter_id is not None:
        first = _first_shared(*([np.frombuffer(f, np.int64) for f in side["filters"]] for side in (left, right)), ia, ib, filter_id)
        ia, ib = ia[first], ib[first]
    ra, rb, ca, cb = left["rep"].to_numpy(), right["rep"].to_numpy(), left["copies"].to_numpy(), right["copies"].to_numpy()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in zip(ia.tolist(), ib.tolist()):
        p, q = int(ra[i]), int(rb[j])
        out[p] = out.get(p, 0) + int(cb[j])
        out[q] = out.get(q, 0) + int(ca[i])
        if root(p) != root(q):
            parent[root(p)] = root(q)
            joined.append((p, q))


def _first_shared(fa: list, fb: list, ia: np.ndarray, ib: np.ndarray, filter_id: int) -> np.ndarray:
    """Which pairs (ia, ib) share no filter below ``filter_id``."""
    # Short lists of the smaller filters, padded with numbers that never agree.
    low = [[f[f < filter_id] for f in side] for side in (fa, fb)]
    wide = [max(1, max(map(len, side))) for side in low]
    tables = [np.stack([np.pad(f, (0, w - len(f)), constant_values=pad) for f in side]) for side, w, pad in zip(low, wide, (-1, -2))]
    out = np.zeros(len(ia), bool)
    for at in range(0, len(ia), 100_000):
        left = np.arange(at, min(at + 100_000, len(ia)))
        # Close pairs share many filters, so most drop out at the first few.
        for k in range(wide[0]):
            left = left[~(tables[0][ia[left], k, None] == tables[1][ib[left]]).any(1)]
        out[left] = True
    return out


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, embedding, ...).

    A vector that is null, zero, or holds null or non-finite components links
    with nothing; neither do vectors of different lengths, nor null ids
    (no component, kept).  Equal vectors are linked and compared once.  Rows that
    repeat an id count as vectors of their own, and show the links of all
    rows of the id.  An empty table gives none.
    """
    # Components that came in single precision are moved so.
    held = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    made = staged(classes(rows, 1).select("rep", F.col("v").cast(held).alias("v"), "copies"), "vector_classes")
    base = as_doubles(rows)
    good = valid() & F.col("vec_id").isNotNull()
    found = None
    # Vectors of one length at a time; the lengths of a table are few.
    for dims, n in sorted((r[0], r[1]) for r in made.groupBy(F.size("v")).count().collect()):
        part = staged(links_of(made.filter(F.size("v") == dims), n, dims, cosine), "vector_links")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = made.select(F.col("rep"), F.col("copies").alias("links"), F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    counts = found.filter("rep IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(found.filter("a IS NOT NULL").select("a", "b")).withColumnRenamed("id", "rep")
    # 128 bits stand for the components; minus zero equals zero.
    wide = F.transform(F.col("v").cast("array<double>"), lambda x: x + F.lit(0.0))
    bits = [F.xxhash64(wide), F.xxhash64(F.lit(SEED), wide)]
    named = made.select("rep", "copies", *(b.alias(f"k{i}") for i, b in enumerate(bits)))
    known = named.join(counts, "rep", "left").join(reached, "rep", "left").select(
        "k0", "k1", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = base.select("vec_id", *(F.when(good, b).alias(f"k{i}") for i, b in enumerate(bits))).join(known, ["k0", "k1"], "left")
    shown = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return shown.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
