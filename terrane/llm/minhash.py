"""MinHash near-dedup: an inverted join over signature coordinates.

Texts with equal shingle sets form a class; only one of each class goes on.
A class is posted under each (coordinate, value) of its signature.  Two
classes that agree on ``matches`` of ``coords`` values share one of the
``coords - matches + 1`` rarest postings of either, so only these prefixes
are merged, and values that occur once are skipped.  Merging counts the
agreements of whole signatures, and pairs that reach ``matches`` are
confirmed on full shingle sets.

A posting never yields all its pairs.  Its members are first compared with
one leader each, in a few rounds.  What has joined one component by then needs
no further comparison.  Postings that still hold several components are dealt
into squares of bounded size; a task compares the members of a square that
lie in different components, by size, signature, a finer sketch and at last
their full sets, and passes on a spanning set of the links it finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, only, staged
from .shingles import bins, digest, shingle_set, signature

COORDS = 16
MATCHES = 6
LEADER_ROUNDS = 1
#: Side of a square of a posting, rows of it compared with the others in one go, and rows that one task of small squares gets.
SIDE = 8192
BLOCK = 64
TASK_ROWS = 2000
#: Bits of a filter of ids for each id asked about, and the least and most of all; one row of it holds BITMAP bits.
ID_BITS, LEAST_BITS, MOST_BITS, BITMAP = 16, 1 << 20, 1 << 26, 1 << 15
#: A sketch rejects a pair only this many standard deviations below the threshold.
DEVIATIONS = 5.0


def sketch(docs: DataFrame, width: int, coords: int = COORDS) -> DataFrame:
    """(doc_id, n_shingles, digest, sig, bins) of every row; texts without words have no signature."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, marks, sigs, fine = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, width)
                sizes.append(len(s)), marks.append(digest(s)), sigs.append(signature(s, coords).tolist() if len(s) else None), fine.append(bins(s))
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(fine, pa.binary())],
                ["doc_id", "n_shingles", "digest", "sig", "bins"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, "doc_id long, n_shingles long, digest binary, sig array<bigint>, bins binary")


def prefixes(classes: DataFrame, coords: int, matches: int) -> DataFrame:
    """(j, v, rep, sig, n): the rarest postings of each class that others share."""
    posted = classes.select("rep", F.posexplode("sig").alias("j", "v"))
    shared = posted.groupBy("j", "v").agg(F.count("*").alias("n")).filter("n > 1")
    # Postings of one class only come first in its order, and join with nothing.
    ranked = posted.join(shared, ["j", "v"]).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "j", "v"))).alias("p"))
    rare = ranked.filter(F.size("p") >= matches).select("rep", F.explode(F.expr(f"slice(p, 1, size(p) - {matches - 1})")).alias("e"))
    return rare.join(classes.select("rep", "sig", "n_shingles"), "rep").select("e.j", "e.v", "rep", "sig", F.col("n_shingles").alias("n"))


def _agree(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)"


def texts_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids in ``asked`` (doc_id, distinct).

    A bitmap of hashed ids, of bounded size, goes to every task first, so that
    only texts asked about, and few others, are moved to the join.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, BITMAP * math.ceil(ID_BITS * asked.count() / BITMAP)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    maps = asked.select((place % BITMAP).alias("bit"), F.floor(place / BITMAP).alias("piece")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("piece", F.floor(place / BITMAP))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(place % BITMAP / 8) + 1, F.lit(1))), 16, 10).cast("int")
    maybe = rows.join(F.broadcast(maps), "piece").filter(F.getbit(byte, (place % 8).cast("int")) == 1)
    return maybe.select("doc_id", "text").join(asked, "doc_id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, digests: DataFrame, width: int, least: int, of: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets meet ``of * |both| >= least * |either|``.

    Texts are fetched for the ids asked about only, and the sets are built
    again from whole texts; a row whose text is not the one asked for (the
    id repeats) is passed over.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = texts_of(docs, staged(asked, "asked")).join(digests, "doc_id").distinct()
    sided = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"), F.col("digest").alias("da")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"), F.col("digest").alias("db")), "b"
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            known: tuple[str, object] = ("", None)
            for a, b, ta, da, tb, db in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "da", "tb", "db"))):
                if known[0] != ta or known[1] is None:
                    known = (ta, shingle_set(ta, width))
                sa, sb = known[1], shingle_set(tb, width)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if of * both >= least * (len(sa) + len(sb) - both) and digest(sa) == da and digest(sb) == db:
                    links.append((a, b))
            yield pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return sided.select("a", "b", "ta", "da", "tb", "db").mapInArrow(test, "a long, b long")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Posting members with the component they have reached."""
    reached = components(links).withColumnRenamed("id", "rep")
    return members.join(reached, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def class_links(classes: DataFrame, docs: DataFrame, width: int, least: int, of: int, coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """(a, b): links between class representatives that join the same components as all links would."""
    members = staged(prefixes(classes, coords, matches), "postings")
    digests = classes.select(F.col("rep").alias("doc_id"), "digest")
    links = members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    labelled = members.withColumn("component", F.col("rep"))
    for turn in range(LEADER_ROUNDS):
        # Postings with one component left are done.
        mixed = labelled.groupBy("j", "v").agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            F.min(F.struct(F.xxhash64(F.lit(turn), "component"), F.xxhash64(F.lit(turn), "rep"), "rep", "sig", "n", "component")).alias("lead"),
        ).filter("low <> high")
        near = labelled.join(mixed.select("j", "v", "lead"), ["j", "v"]).filter(
            f"component <> lead.component AND {of} * least(n, lead.n) >= {least} * greatest(n, lead.n) AND {_agree('sig', 'lead.sig')} >= {matches}"
        )
        found = near.select(F.least("rep", F.col("lead.rep")).alias("a"), F.greatest("rep", F.col("lead.rep")).alias("b")).distinct()
        found = staged(likely_pairs(found, classes, least / of), "candidates")
        links = links.unionByName(staged(confirm(found, docs, digests, width, least, of), "links"))
        labelled = staged(_labelled(members, links), "labelled")
    return links.unionByName(staged(square_links(labelled, classes, docs, width, least, of, matches), "links"))


def square_links(labelled: DataFrame, classes: DataFrame, docs: DataFrame, width: int, least: int, of: int, matches: int) -> DataFrame:
    """(a, b): links across components, from the postings that hold several."""
    open_ = labelled.groupBy("j", "v").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows")).filter("low <> high")
    rows = staged(labelled.join(open_.select("j", "v", "rows"), ["j", "v"]).withColumn("posting", F.xxhash64("j", "v")), "open_postings")
    # A pair is looked at in the first posting it shares.
    keys = rows.groupBy("rep").agg(F.sort_array(F.collect_set("posting")).alias("keys"))
    squares = F.greatest(F.lit(1), F.ceil(F.col("rows") / SIDE)).cast("int")
    dealt = rows.select("posting", "rep", "sig", "n", "component", squares.alias("s"), F.pmod(F.xxhash64("rep"), squares).cast("int").alias("part"))
    groups = max(1, math.ceil(rows.count() / TASK_ROWS))
    cells = dealt.select("*", F.explode(F.expr("transform(sequence(0, s - 1), o -> struct(least(part, o) AS x, greatest(part, o) AS y))")).alias("cell")).select(
        "posting", "rep", "sig", "n", "component", "part", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"),
        F.when(F.col("s") == 1, F.pmod("posting", F.lit(groups))).otherwise(-1 - F.pmod(F.xxhash64("posting", "cell"), F.lit(1 << 62))).alias("task"),
    )

    asked = cells.join(keys, "rep").join(classes.select("rep", "digest", "bins"), "rep")
    columns = asked.columns

    def pairs(part: pd.DataFrame) -> Iterator[list[tuple[int, int]]]:
        """Per block of a square, the pairs of rows that only full sets can decide."""
        reps, comps, sizes, side, keys_ = (part[c].to_numpy() for c in ("rep", "component", "n", "part", "keys"))
        sigs, fine = np.stack(part["sig"].to_numpy()), np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(len(part), 256)
        for (posting, x, y), at in part.groupby(["posting", "x", "y"], sort=False).indices.items():
            whole, right = at[side[at] == x], at[side[at] == y]
            for start in range(0, len(whole), BLOCK):
                left = whole[start : start + BLOCK]
                # Within one part, a row meets those after it.
                others = right[start:] if x == y else right
                apart = comps[left][:, None] != comps[others][None, :]
                a, b = sizes[left][:, None], sizes[others][None, :]
                apart &= of * np.minimum(a, b) >= least * np.maximum(a, b)
                if x == y:
                    apart = np.triu(apart, 1)
                ia, ib = np.nonzero(apart)
                ia, ib = left[ia], others[ib]
                close = (sigs[ia] == sigs[ib]).sum(1) >= matches
                found = _likely(fine, ia[close], ib[close], least / of)
                yield [(i, j) for i, j, _ in found if _first_key(keys_[i], keys_[j]) == posting]

    def open_rows(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        rows = sorted({i for square in pairs(part) for pair in square for i in pair})
        return part.loc[rows, columns]

    def test(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        reps, comps, texts_, digests_ = (part[c].to_numpy() for c in ("rep", "component", "text", "digest"))
        sets: dict[int, np.ndarray | None] = {}
        parent: dict[int, int] = {}
        links: list[tuple[int, int]] = []

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def full(row: int) -> np.ndarray | None:
            rep = int(reps[row])
            if sets.get(rep) is None:
                # An id that repeats comes with each of its texts.
                s = shingle_set(texts_[row], width)
                sets[rep] = s if digest(s) == digests_[row] else None
            return sets[rep]

        for square in pairs(part):
            for i, j in square:
                p, q = root(int(comps[i])), root(int(comps[j]))
                if p == q:
                    continue
                sa, sb = full(i), full(j)
                if sa is None or sb is None:
                    continue
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if of * both >= least * (len(sa) + len(sb) - both):
                    parent[p] = q
                    links.append((int(reps[i]), int(reps[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    # Texts are fetched for rows that have an undecided pair only.
    undecided = staged(asked.groupBy("task").applyInPandas(open_rows, asked.schema), "undecided")
    asked_ids = staged(undecided.select(F.col("rep").alias("doc_id")).distinct(), "asked")
    texts = texts_of(docs, asked_ids).withColumnRenamed("doc_id", "rep").distinct()
    return undecided.join(texts, "rep").groupBy("task").applyInPandas(test, "a long, b long")


def likely_pairs(found: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``found`` that the finer sketch does not rule out."""
    fine = classes.select("rep", "bins")
    sided = found.join(fine.select(F.col("rep").alias("a"), F.col("bins").alias("fa")), "a").join(fine.select(F.col("rep").alias("b"), F.col("bins").alias("fb")), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                both = np.frombuffer(b"".join(batch.column("fa").to_pylist() + batch.column("fb").to_pylist()), np.uint8).reshape(2 * n, 256)
                kept = pa.array([i for i, _, _ in _likely(both, np.arange(n), np.arange(n, 2 * n), threshold)], pa.int64())
                yield pa.record_batch([batch.column("a").take(kept), batch.column("b").take(kept)], ["a", "b"])

    return sided.select("a", "b", "fa", "fb").mapInArrow(test, "a long, b long")


def _likely(fine: np.ndarray, ia: np.ndarray, ib: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Pairs whose share of equal bins does not rule out ``threshold``, the likeliest first."""
    out = []
    for at in range(0, len(ia), 50_000):
        a, b = fine[ia[at : at + 50_000]], fine[ib[at : at + 50_000]]
        used = np.maximum(((a > 0) | (b > 0)).sum(1), 1)
        share = ((a == b) & (a > 0)).sum(1) / used
        ok = share >= threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / used)
        out += zip(ia[at : at + 50_000][ok].tolist(), ib[at : at + 50_000][ok].tolist(), share[ok].tolist())
    return sorted(out, key=lambda x: -x[2])


def _first_key(a, b) -> int | None:
    shared = np.intersect1d(a, b, assume_unique=True)
    return int(shared[0]) if len(shared) else None


def near_duplicates(
    docs: DataFrame, width: int = 5, least: int = 80, of: int = 100, coords: int = COORDS, matches: int = MATCHES
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents with ``of * |both| >= least * |either|`` are linked, and a
    component is what links reach.  A pair at the threshold misses ``matches``
    of ``coords`` equal coordinates with a likelihood below 1 in 30,000 (0.8)
    or 1 in 500,000 (0.85).  Null, empty and wordless texts have no shingles and
    no links; null ids are linked with nothing, have no component, and are
    kept.  Rows that share an id are one document.
    """
    rows = staged(sketch(docs, width, coords), "sketches")
    worded = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(worded.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.min("bins").alias("bins"), F.min("n_shingles").alias("n_shingles")), "classes")
    links = class_links(classes, docs, width, least, of, coords, matches)
    # Copies hang on their class; an id with several texts ties their classes together.
    copies = worded.join(classes.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
    split_ids = copies.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    many = copies.join(split_ids.select("doc_id", "a"), "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b"))
    reached = staged(components(links.unionByName(many)), "components")
    of_digest = classes.select("digest", "rep").join(reached.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("of_class")
    )
    named = rows.join(of_digest, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("of_class", "doc_id")).otherwise(F.col("doc_id"))
    return named.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest id; all columns stay.

    Documents without words, and null ids, stay.
    """
    names = docs.columns
    kept = near_duplicates(docs, width, least, of).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").cast("long").alias("_id"))
    with_id = inner.filter("_id IS NOT NULL").join(kept, "_id", "left_semi")
    # Rows that repeat a kept id are copies of it.
    once = with_id.dropDuplicates(["_id"])
    return once.unionByName(inner.filter("_id IS NULL")).drop("_id").toDF(*names)
