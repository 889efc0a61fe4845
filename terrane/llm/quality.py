"""Quality classifier: boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TRAINING_ROWS, held_out, only, training_labels
from .trees import Forest, fit

#: Bytes whose share in the text is a statistic of its own.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]_{|}~"
STATISTICS = [
    "log_bytes", "upper", "lower", "digit", "blank", "newline", "beyond_ascii", "control", "marks", *[f"mark_{c:02x}" for c in MARKS],
    "log_words", "word_length", "longest_word", "distinct_words", "distinct_pairs", "top_word", "short_words", "marked_words", "sentence_ends",
    "log_lines", "distinct_lines", "line_words", "longest_line", "empty_lines",
]
_UPPER, _LOWER, _DIGIT = (np.arange(ord(a), ord(z) + 1) for a, z in ("AZ", "az", "09"))
_MARKS = np.frombuffer(MARKS, np.uint8)
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_PLAIN = np.array([chr(c).isalnum() or c > 127 for c in range(256)])
_END = np.isin(np.arange(256), list(b".!?"))


def statistics(text: str | None) -> np.ndarray:
    """Numbers that describe a text, in the order of ``STATISTICS``; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    share = np.bincount(data, minlength=256) / max(len(raw), 1)
    marks = share[_MARKS]
    words = raw.split()
    n = max(len(words), 1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[data], [True])).view(np.int8)))
    lengths, last = edges[1::2] - edges[::2], data[edges[1::2] - 1]
    lines = raw.split(b"\n")
    return np.array([
        np.log1p(len(raw)), share[_UPPER].sum(), share[_LOWER].sum(), share[_DIGIT].sum(), share[32], share[10], share[128:].sum(),
        share[:32].sum() - share[10], marks.sum(), *marks,
        np.log1p(len(words)), lengths.sum() / n, min(lengths.max(initial=0), 1000), len(counts) / n, pairs, max(counts.values(), default=0) / n,
        (lengths < 3).sum() / n, (~_PLAIN[last]).sum() / n, _END[last].sum() / n,
        np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines), np.log1p(max(map(len, lines))), sum(not x.strip() for x in lines) / len(lines),
    ])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS, **how) -> Forest:
    """Fit on at most ``rows`` labelled documents outside the held-out fold.

    Only their statistics come to the driver, ``len(STATISTICS)`` numbers a
    row.  The chosen labels are bounded by ``rows``, hence broadcast.
    """
    chosen = F.broadcast(training_labels(labels, label, rows))
    known = only(docs, ["doc_id", "text"]).join(chosen, "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(x, pa.list_(pa.float64())), b.column("y")], ["doc_id", "x", "y"])

    # The bound is on ids; ids that repeat could exceed it, so it is stated again on rows.
    measured = known.mapInArrow(measure, f"doc_id {dict(known.dtypes)['doc_id']}, x array<double>, y double").orderBy(F.xxhash64("doc_id", "x"), "y").limit(rows).toPandas()
    x = np.array(measured["x"].tolist(), float).reshape(len(measured), len(STATISTICS))
    return fit(x, measured["y"].to_numpy(float), **how)


def score_quality(docs: DataFrame, forest: Forest, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default doc_id) with ``score``, the likelihood of label 1.

    One pass without a shuffle.  A null text scores as the empty one, every
    row of a repeated document gets the same score, and an untrained model
    answers 0.5.
    """
    keep = columns or ["doc_id"]
    inside = only(docs, keep if "text" in keep else [*keep, "text"]).withColumnRenamed("text", "_text")
    inside = inside.select(*[F.col("_text" if c == "text" else c).alias(f"c{i}") for i, c in enumerate(keep)], "_text")
    schema = ", ".join(f"c{i} {t}" for i, t in enumerate(dict(inside.dtypes)[f"c{i}"] for i in range(len(keep)))) + ", score double"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").to_pylist()
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
            kept = [b.column(f"c{i}") for i in range(len(keep))]
            yield pa.record_batch([*kept, pa.array(forest.score(x), pa.float64())], [*[f"c{i}" for i in range(len(keep))], "score"])

    return inside.mapInArrow(judge, schema).toDF(*keep, "score")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Documents with a score of ``threshold`` or more, with all their columns, whatever their names."""
    held = [f"c{i}" for i in range(len(docs.columns))]
    scored = score_quality(docs, fit_quality(docs, labels), docs.columns).toDF(*held, "_score")
    return scored.filter(F.col("_score") >= threshold).select(*held).toDF(*docs.columns)
