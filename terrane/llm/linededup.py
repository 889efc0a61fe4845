"""Line dedup that can be undone: exact reference counts behind sharded cuckoo filters.

``LineIndex`` is three tables: ``refs`` (h1, h2, doc_id, row, at: which
documents hold a line, and where), ``counts`` (h1, h2, n_docs, keeper) and
``filters`` (shard, body).  Inserting documents asks the filters which of
their lines may be known; only those meet the exact counts.  Deleting
documents lowers the counts, and takes the keys that reach zero out of the
filters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, only, staged
from .cuckoo import CuckooFilter

#: Lines shorter than this are never dropped.
LEAST_CHARS = 10
#: Keys a shard holds on average, when an index is first filled.
SHARD_KEYS = 200_000
#: Where null ids stand: one document after all others.
NO_ID = (1 << 63) - 1
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["h1", "h2"]


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def line_refs(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, doc_id, row, at): each key of each document, with its line numbers.

    Two 64-bit hashes stand for the key.  ``row`` tells rows of one repeated
    id apart by their text; equal rows fall together.
    """
    lines = only(docs, ["doc_id", "text"]).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"),
    )
    keys = lines.select("doc_id", "row", "at", F.translate(F.btrim("line", F.lit(SPACES)), _LETTERS, _LETTERS.lower()).alias("key"))
    hashed = keys.filter(F.length("key") >= least_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row", "at")
    return hashed.groupBy("h1", "h2", "doc_id", "row").agg(F.collect_set("at").alias("at"))


def _counted(refs: DataFrame) -> DataFrame:
    """Exact reference counts; hot keys combine before they are shuffled."""
    # Rows of one repeated id are few: a second row counts only if it is the id's first.
    first = refs.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    return first.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("keeper"))


def _shard(shards: int):
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")


def _update(filters: DataFrame, keys: DataFrame, shards: int, delete: bool) -> DataFrame:
    """Filters with distinct ``keys`` (h1, h2) put in or taken out; one task holds one shard."""

    def change(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        hashes = new["h1"].to_numpy(np.int64) ^ (new["h2"].to_numpy(np.int64) << 1)
        if len(old) == 0:
            if delete:
                return pd.DataFrame({"shard": [], "body": [], "members": []})
            return pd.DataFrame({"shard": [key[0]], "body": [CuckooFilter.of(hashes.view(np.uint64)).dump()], "members": [hashes.tobytes()]})
        body, members = CuckooFilter.load(old["body"].iloc[0]), np.frombuffer(old["members"].iloc[0], np.int64)
        if delete:
            body.delete(hashes.view(np.uint64))
            members = _without(members, hashes)
        else:
            members = np.concatenate([members, hashes])
            room = 0.85 * body.table.size
            if len(members) > room or not body.insert(hashes.view(np.uint64)):
                body = CuckooFilter.of(members.view(np.uint64))
        return pd.DataFrame({"shard": [key[0]], "body": [body.dump()], "members": [members.tobytes()]})

    return filters.groupBy("shard").cogroup(keys.select("h1", "h2", _shard(shards)).groupBy("shard")).applyInPandas(
        change, "shard int, body binary, members binary"
    )


def _without(members: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``members`` less one copy of each of ``gone``."""
    values, counts = np.unique(np.concatenate([members, gone]), return_counts=True)
    lost, times = np.unique(gone, return_counts=True)
    counts[np.searchsorted(values, lost)] -= 2 * times
    return np.repeat(values, np.maximum(counts, 0))


def _maybe(filters: DataFrame, rows: DataFrame, shards: int, salts: int) -> DataFrame:
    """The ``rows`` (with h1, h2, doc_id) whose key a filter may hold.

    Rows of a shard are dealt over ``salts`` tasks by document, so a hot line
    spreads; the filter of the shard is repeated for each.
    """
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    spread = filters.select("shard", "body", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = rows.select("*", _shard(shards), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    names = rows.columns

    def probe(body: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if len(body) == 0 or len(asked) == 0:
            return asked[names].iloc[:0]
        hashes = asked["h1"].to_numpy(np.int64) ^ (asked["h2"].to_numpy(np.int64) << 1)
        return asked.loc[CuckooFilter.load(body["body"].iloc[0]).contains(hashes.view(np.uint64)), names]

    return spread.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt")).applyInPandas(probe, schema)


def empty_index(spark: SparkSession, shards: int) -> LineIndex:
    return LineIndex(
        spark.createDataFrame([], "h1 long, h2 long, doc_id long, row long, at array<int>"), spark.createDataFrame([], "h1 long, h2 long, n_docs long, keeper long"),
        spark.createDataFrame([], "shard int, body binary, members binary"), shards,
    )


def insert(index: LineIndex | None, docs: DataFrame) -> LineIndex:
    """The index with ``docs`` added; documents it knows already are left as they are."""
    refs = line_refs(docs)
    if index is None:
        refs = staged(refs, "line_refs")
        counts = staged(_counted(refs), "line_counts")
        shards = max(1, math.ceil(counts.count() / SHARD_KEYS))
        fresh = empty_index(docs.sparkSession, shards)
        return LineIndex(refs, counts, staged(_update(fresh.filters, counts, shards, False), "line_filters"), shards)
    refs = staged(refs.join(index.refs.select("doc_id", "row").distinct(), ["doc_id", "row"], "left_anti"), "line_refs")
    batch = staged(refs.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")), "line_keys")
    asked = _maybe(index.filters, batch, index.shards, 1)
    known = staged(index.counts.join(asked.select(KEY), KEY, "left_semi").select(KEY), "known_keys")
    all_refs = staged(index.refs.unionByName(refs), "line_refs")
    # Only keys of the batch are counted again.
    touched = _counted(all_refs.join(batch.select(KEY), KEY, "left_semi"))
    counts = staged(index.counts.join(batch.select(KEY), KEY, "left_anti").unionByName(touched), "line_counts")
    fresh_keys = batch.join(known, KEY, "left_anti")
    return LineIndex(all_refs, counts, staged(_update(index.filters, fresh_keys, index.shards, False), "line_filters"), index.shards)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents in ``doc_ids`` (doc_id): the reverse of ``insert``."""
    gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
    lost = index.refs.join(gone, "doc_id", "left_semi").select(KEY).distinct()
    refs = staged(index.refs.join(gone, "doc_id", "left_anti"), "line_refs")
    touched = staged(_counted(refs.join(lost, KEY, "left_semi")), "line_counts")
    counts = staged(index.counts.join(lost, KEY, "left_anti").unionByName(touched), "line_counts")
    zero = lost.join(touched.select(KEY), KEY, "left_anti")
    return LineIndex(refs, counts, staged(_update(index.filters, zero, index.shards, True), "line_filters"), index.shards)


def repeated_lines(index: LineIndex) -> DataFrame:
    """(doc_id, row, at): line numbers that lose to the smallest document holding the line.

    A filter over the keys of two documents or more thins the references
    before they meet the exact counts.
    """
    repeated = index.counts.filter("n_docs > 1")
    fresh = empty_index(repeated.sparkSession, index.shards)
    filters = staged(_update(fresh.filters, repeated, index.shards, False), "repeated_filters")
    salts = max(1, math.ceil(index.refs.count() / (2 * index.shards * SHARD_KEYS)))
    maybe = _maybe(filters, index.refs, index.shards, salts)
    return (
        maybe.join(repeated, KEY).filter("doc_id <> keeper")
        .groupBy("doc_id", "row").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    )


def drop_repeated(docs: DataFrame, index: LineIndex) -> DataFrame:
    """``docs`` with two more columns: ``kept_lines`` (their text without the lost lines) and ``lost`` (how many).

    Every row stays.  Null and empty texts are one empty line; null ids are
    one document after all others; a repeated row loses what its twin loses.
    """
    names = docs.columns
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    lost = repeated_lines(index).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("at").alias("_at"))
    keyed = inner.select("*", F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_row"))
    joined = keyed.join(lost, ["_id", "_row"], "left").select(*inner.columns, "_at")
    columns, schema = inner.columns, ", ".join(f"{n} {t}" for n, t in inner.dtypes) + ", kept string, lost long"

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            kept, lost = [], []
            for body, at in zip(b.column(text).to_pylist(), b.column("_at").to_pylist()):
                gone = set(at or ())
                kept.append("\n".join(x for i, x in enumerate((body or "").split("\n")) if i not in gone) if gone else body or "")
                lost.append(len(gone))
            whole = [b.column(c) for c in columns]
            yield pa.record_batch([*whole, pa.array(kept, pa.string()), pa.array(lost, pa.int64())], [*columns, "kept", "lost"])

    return joined.mapInArrow(cut, schema).toDF(*names, "kept_lines", "lost")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that an earlier document holds taken out of their text; ``n_chars`` follows the text."""
    cut = drop_repeated(docs, insert(None, docs))
    text = F.when(F.col("lost") > 0, F.col("kept_lines")).otherwise(F.col("text"))
    out = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lost") > 0, F.length("kept_lines").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    cut = drop_repeated(only(docs, ["doc_id", "text"]), insert(None, docs))
    return cut.select(
        "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), F.col("lost").alias("n_dropped"),
        F.sha2(F.col("kept_lines").cast("binary"), 256).alias("kept_sha256"),
    )
