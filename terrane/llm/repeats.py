"""Exact removal of long repeated byte strings, with suffix arrays in shards.

Every window of ``LENGTH`` bytes belongs to one anchor, the ``GRAM`` bytes
with the smallest hash inside it, so equal windows have equal anchors.  The
windows of one anchor make a segment.  Anchors that occur once are done;
equal segments repeat whole.  Of each different segment that shares its
anchor with another, one goes to the shard of the anchor, where a suffix array
of all its segments is built by two-stage sorting, and common prefixes of
neighbours tell which windows occur again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, staged
from .suffixes import repeated_starts

LENGTH = 200
GRAM = 48
#: Bytes of segments a shard holds on average.
SHARD_BYTES = 1 << 20
#: Anchors with more different segments are settled by counting their windows instead, which any number of tasks share.
HOT_SEGMENTS = 10_000
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def rolling(data: np.ndarray, length: int, factor: int) -> np.ndarray:
    """64-bit hash of every ``length`` bytes, by doubling."""
    h, have, out, done, power = _TABLE[data], 1, None, 0, np.array([factor], np.uint64)
    rest = length
    while rest:
        if rest & 1:
            # The hash so far, followed by the next ``have`` bytes.
            out = h.copy() if out is None else out[: len(h) - done] * power + h[done : done + len(out)] if len(h) > done else out[:0]
            done += have
        rest >>= 1
        if rest:
            h = h[: max(len(h) - have, 0)] * power + h[have:]
            power *= power
            have *= 2
    out = out[: max(len(data) - length + 1, 0)]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, start, bytes, twice) of the segments of one text, in order; none if it is too short.

    ``twice``: the anchor stands in the segment more than once, so that the
    segment may repeat within itself.
    """
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    hashes = rolling(data, gram, _FACTORS[0])
    span = length - gram + 1
    # Smallest hash in each window: blockwise running minima from both sides.
    n = len(hashes)
    padded = np.concatenate([hashes, np.full(-n % span, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - span + 1], ahead[span - 1 : n])
    # A change of the smallest hash ends a segment.  A longer run than one anchor can cause repeats
    # its anchor, and is cut, so that its parts meet as segments of one anchor.
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    runs = np.diff(np.r_[starts, len(least)])
    parts = -(-runs // span)
    if (parts > 1).any():
        starts = np.repeat(starts, parts) + span * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    ends = np.r_[starts[1:], len(least)]
    sizes = ends - starts + length - 1
    places = np.flatnonzero(np.isin(hashes, least[starts]))
    twice = np.zeros(len(starts), bool)
    values, counts = np.unique(hashes[places], return_counts=True)
    for i in np.flatnonzero(np.isin(least[starts], values[counts > 1])):
        inside = places[np.searchsorted(places, starts[i]) : np.searchsorted(places, starts[i] + sizes[i] - gram, side="right")]
        twice[i] = (hashes[inside] == least[starts[i]]).sum() > 1
    return least[starts], starts, sizes, twice


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, segment, rid, at, n, twice): every segment of every text; ``segment`` is a hash of its bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                h, at, n, twice = segments(np.frombuffer(raw, np.uint8))
                if len(h):
                    own = np.fromiter((xxhash.xxh3_64_intdigest(raw[s : s + m]) for s, m in zip(at.tolist(), n.tolist())), np.uint64, len(h))
                    for part, x in zip(parts, (h.view(np.int64), own.view(np.int64), np.full(len(h), rid), at, n.astype(np.int32), twice)):
                        part.append(x)
            if parts[0]:
                yield pa.record_batch([pa.array(np.concatenate(p)) for p in parts], ["anchor", "segment", "rid", "at", "n", "twice"])

    return docs.select("rid", "text").mapInArrow(scan, "anchor long, segment long, rid long, at long, n int, twice boolean")


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (anchor, segment, copies, rid, at, n) with the bytes of each segment."""
    asked = wanted.groupBy("rid").agg(F.collect_list(F.struct("anchor", "segment", "copies", "at", "n")).alias("list"))
    # Equal rows have one rid; one of them is enough.
    joined = docs.select("rid", "text").join(asked, "rid").dropDuplicates(["rid"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rid, text, items in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), b.column("list").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(x["anchor"], x["segment"], x["copies"], rid, x["at"], raw[x["at"] : x["at"] + x["n"]]) for x in items]
            names = ["anchor", "segment", "copies", "rid", "at", "body"]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            for start in range(0, len(rows), 50_000):
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[start : start + 50_000]), kinds)], names)

    return joined.mapInArrow(cut, "anchor long, segment long, copies long, rid long, at long, body binary")


def _by_suffix_array(bodies: DataFrame) -> DataFrame:
    """(rid, at, till): repeated stretches of segments, from the suffix array of each shard."""

    def sort(part: pd.DataFrame) -> pd.DataFrame:
        bodies, rids, ats = part["body"].tolist(), part["rid"].to_numpy(), part["at"].to_numpy()
        sizes = np.array([len(b) for b in bodies])
        text = np.frombuffer(b"".join(bodies), np.uint8)
        heads = np.r_[0, np.cumsum(sizes)[:-1]]
        windows = sizes - LENGTH + 1
        of = np.repeat(np.arange(len(bodies)), windows)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = repeated_starts(text, heads[of] + offset, LENGTH)
        of, offset = of[hit], offset[hit]
        cut = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(of) else np.zeros(0, int)
        last = np.r_[cut[1:], len(of)][: len(cut)] - 1
        return pd.DataFrame({"rid": rids[of[cut]], "at": ats[of[cut]] + offset[cut], "till": ats[of[cut]] + offset[last] + LENGTH})

    return bodies.groupBy("shard").applyInPandas(sort, "rid long, at long, till long")


def _by_count(bodies: DataFrame) -> DataFrame:
    """The same for hot anchors: windows are hashed to 128 bits and counted."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, at, body in zip(b.column("rid").to_pylist(), b.column("at").to_pylist(), b.column("body").to_pylist()):
                data = np.frombuffer(body, np.uint8)
                a, c = (rolling(data, LENGTH, f).view(np.int64) for f in _FACTORS)
                yield pa.record_batch([pa.array(a), pa.array(c), pa.array(np.full(len(a), rid)), pa.array(at + np.arange(len(a)))], ["w1", "w2", "rid", "at"])

    flat = staged(bodies.select("rid", "at", "body").mapInArrow(windows, "w1 long, w2 long, rid long, at long"), "hot_windows")
    again = flat.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1").select("w1", "w2")
    return flat.join(again, ["w1", "w2"], "left_semi").select("rid", "at", (F.col("at") + LENGTH).alias("till"))


def repeated(docs: DataFrame) -> DataFrame:
    """(rid, at, till): stretches of bytes of ``docs`` (rid, text) that a repeated string covers."""
    rows = staged(anchors(docs), "anchors")
    often = rows.groupBy("anchor").agg(F.count("*").alias("c"), F.min("segment").alias("low"), F.max("segment").alias("high"), F.max("twice").alias("twice"))
    shared = staged(
        rows.join(often.filter("c > 1 OR twice").select("anchor", (F.col("twice") | (F.col("low") != F.col("high"))).alias("mixed")), "anchor"), "shared_anchors"
    )
    whole = shared.filter("NOT mixed").select("rid", "at", (F.col("at") + F.col("n")).alias("till"))
    mixed = shared.filter("mixed")
    # One of each different segment, the rest of which repeat whole.
    kinds = staged(mixed.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "at", "n")).alias("one")), "segments")
    whole = whole.unionByName(
        mixed.join(kinds.filter("copies > 1").select("anchor", "segment"), ["anchor", "segment"], "left_semi").select("rid", "at", (F.col("at") + F.col("n")).alias("till"))
    )
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("k"))
    hot = sizes.filter(F.col("k") > HOT_SEGMENTS).select("anchor")
    bodies = staged(_fetch(docs, kinds.select("anchor", "segment", "copies", "one.rid", "one.at", "one.n")), "segment_bodies")
    total = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    calm = bodies.join(hot, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return whole.unionByName(_by_suffix_array(calm)).unionByName(_by_count(bodies.join(hot, "anchor", "left_semi")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the bytes that stay.

    A byte goes if a string of ``LENGTH`` bytes that also starts anywhere
    else covers it; all is judged on the input.  Null and empty texts have no
    bytes; texts shorter than ``LENGTH`` keep all; a row that stands twice is
    its own repetition, as any two equal texts are; ids, null or repeated,
    play no part.
    """
    kind = dict(docs.dtypes)["doc_id"]
    keyed = only(docs, ["doc_id", "text"]).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    spans = repeated(keyed).groupBy("rid").agg(F.collect_list(F.struct("at", "till")).alias("spans"))
    joined = keyed.join(spans, "rid", "left").select("doc_id", "text", "spans.at", "spans.till")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, at, till in zip(*(b.column(c).to_pylist() for c in ("text", "at", "till"))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                covered = np.zeros(len(raw) + 1, np.int64)
                if at:
                    np.add.at(covered, at, 1)
                    np.add.at(covered, till, -1)
                gone = covered.cumsum()[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for part, x in zip(out, (len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept)):
                    part.append(x)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
