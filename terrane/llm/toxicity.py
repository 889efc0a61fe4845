"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled texts: one of the pieces
ordinary texts repeat, one with the pieces that toxic texts repeat and
ordinary ones lack: words, and runs of words that may each be ordinary.  A
text is cut into windows of one and of three words, at every start.  A window that the toxic dictionary compresses better than the
ordinary one speaks for toxicity; how many windows do, and by how many bytes,
are turned into a likelihood by boosted trees fitted on labelled texts that
the dictionaries have not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TRAINING_ROWS, held_out, only, training_labels
from .trees import Forest, fit

LEVEL = 3
#: Pieces of the ordinary dictionary.
ORDINARY_PIECES = 12_000
#: A piece belongs to the toxic dictionary if this share of toxic texts holds it, and ordinary texts hold it so many times less often.
TOXIC_SHARE, TOXIC_RATIO = 0.02, 100
#: Words of the longest piece, and of the longer windows; the shortest match zstandard makes.
RUN, LEAST_MATCH = 3, 4
#: Gains are counted up to so many bytes.
MOST_GAIN = 8
#: Single words remembered with their gain, a matter of speed only.
WORDS_KEPT = 200_000
_EDGE = b".,!?;:*%#$&|\"'()[]{}<>"


def pieces(text: str | None) -> list[bytes]:
    """Words in lower case (A to Z)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Dictionaries:
    """Raw content of both dictionaries; the toxic one continues the ordinary one, so that only its own pieces tell."""

    ordinary: bytes
    toxic: bytes

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "_pair": None}

    def compressors(self) -> tuple:
        if self._pair is None:
            def of(raw: bytes):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress

            self._pair = of(self.ordinary or b" " * 8), of((self.ordinary + self.toxic) or b" " * 8)
            self._words, self._own = {}, self._grams(b" " + self.toxic)
        return self._pair

    def _grams(self, raw: bytes) -> set[bytes]:
        return {raw[i : i + LEAST_MATCH] for i in range(len(raw) - LEAST_MATCH + 1)}

    def gain(self, window: bytes) -> int:
        """Bytes the toxic dictionary saves over the ordinary one."""
        ordinary, toxic = self.compressors()
        return len(ordinary(window)) - len(toxic(window))

    def features(self, text: str | None) -> np.ndarray:
        """How many windows gain how many bytes, as counts and shares, for windows of one and of three words."""
        self.compressors()
        words = pieces(text)
        known = self._words
        if len(known) > WORDS_KEPT:
            known.clear()
        single, near = [], []
        for w in words:
            g = known.get(w)
            if g is None:
                window = b" " + w.strip(_EDGE) + b" "
                # What shares no match with the toxic pieces gains nothing by them.
                close = not self._own.isdisjoint(self._grams(window))
                g = known[w] = (self.gain(window) if close else 0, close)
            single.append(g[0])
            near.append(g[1])
        bare = [w.strip(_EDGE) for w in words] if any(near) else []
        triple = [
            self.gain(b" " + b" ".join(bare[i : i + RUN]) + b" ") if any(near[i : i + RUN]) else 0 for i in range(max(1, len(words) - RUN + 1) if words else 0)
        ]
        out = [np.log1p(len(words))]
        for gains in (single, triple):
            counts = np.bincount(np.clip(gains, 0, MOST_GAIN), minlength=MOST_GAIN + 1) if gains else np.zeros(MOST_GAIN + 1)
            above = counts[::-1].cumsum()[::-1][1:]
            out += [*above, *(above / max(len(gains), 1)), np.mean(gains) if gains else 0.0, max(gains, default=0)]
        return np.array(out, float)


def _runs(text: str, width: int) -> set[bytes]:
    words = [p.strip(_EDGE) for p in pieces(text)]
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _parts(run: bytes) -> list[bytes]:
    """The shorter runs within a run."""
    words = run.split(b" ")
    return [b" ".join(words[i : i + n]) for n in range(1, len(words)) for i in range(len(words) - n + 1)]


def build(texts: list[str], toxic: np.ndarray) -> Dictionaries:
    """Dictionaries from labelled texts; a piece, of one word or a run of up to ``RUN``, counts once for each text that holds it."""
    held = {flag: Counter() for flag in (False, True)}
    for t, y in zip(texts, toxic):
        held[bool(y)].update(_runs(t, 1))
    n = {flag: max(int((toxic == flag).sum()), 1) for flag in held}
    ordinary = sorted(held[False].items(), key=lambda x: (-x[1], x[0]))[:ORDINARY_PIECES]
    least = max(3.0, TOXIC_SHARE * n[True])
    own: list[tuple[int, bytes]] = []
    for width in range(1, RUN + 1):
        if width > 1:
            # Runs of one length at a time; only those that enough toxic texts hold are counted in ordinary ones.
            held = {True: Counter(w for t, y in zip(texts, toxic) if y for w in _runs(t, width))}
            often = {w for w, c in held[True].items() if c >= least}
            held[False] = Counter(w for t, y in zip(texts, toxic) if not y for w in _runs(t, width) & often)
        shorter = {w for _, w in own}
        own += [
            (c, w) for w, c in held[True].items()
            if c >= least and held[False][w] / n[False] * TOXIC_RATIO < c / n[True] and not any(p in shorter for p in _parts(w))
        ]
    own.sort()
    # The commonest pieces come last, where they are cheapest to point to.
    return Dictionaries(b" ".join([w for w, _ in ordinary][::-1]) + b" ", b" ".join(w for _, w in own) + b" ")


@dataclass
class Model:
    dictionaries: Dictionaries
    forest: Forest

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.dictionaries.features(t) for t in texts]).reshape(len(texts), 1 + 2 * (2 * MOST_GAIN + 2))
        return self.forest.score(x)


def fit_texts(texts: list[str], y: np.ndarray) -> Model:
    """Dictionaries from the even texts, thresholds from the odd ones."""
    first = np.arange(len(texts)) % 2 == 0
    made = build([t for t, a in zip(texts, first) if a], y[first] >= 0.5)
    rest = [t for t, a in zip(texts, first) if not a]
    x = np.array([made.features(t) for t in rest]).reshape(len(rest), 1 + 2 * (2 * MOST_GAIN + 2))
    return Model(made, fit(x, y[~first]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS // 2) -> Model:
    """Fit on at most ``rows`` whole labelled texts outside the held-out fold, brought to the driver."""
    chosen = F.broadcast(training_labels(labels, label, rows))
    known = only(docs, ["doc_id", "text"]).join(chosen, "doc_id").select("doc_id", "text", "y").orderBy(F.xxhash64("doc_id", "text")).limit(rows).toPandas()
    return fit_texts(known["text"].fillna("").tolist(), known["y"].to_numpy(float))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, in one pass without a shuffle.

    Null and empty texts have no windows; they get the score such texts get.
    An untrained model answers 0.5.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array(model.score(b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return only(docs, ["doc_id", "text"]).mapInArrow(judge, f"doc_id {kind}, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
