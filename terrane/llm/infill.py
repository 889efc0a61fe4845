"""Fill-in-middle over seekable compressed texts.

A text is stored as independent zstandard frames with cumulative counts of
code points.  To cut it, only the frames that hold a cut are decompressed;
all others move whole into the output, which is a text of the same kind.
Digests and the way back stream the output's frames in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

#: Code points of a frame.
FRAME_UNITS = 16_384
LEVEL = 1
MARKS = ("<P>", "<S>", "<M>")
#: Shares, in per cent, of documents that are transformed, and of those that put the suffix first.
TRANSFORMED = 90
SUFFIX_FIRST = 20
Frame = tuple[int, bytes]


def _tools():
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress, zstandard.ZstdDecompressor().decompress


class FramedText:
    """Frames in order, and how many code points precede each."""

    def __init__(self, frames: Iterable[Frame]):
        self.frames = list(frames)
        self.before = [0, *accumulate(n for n, _ in self.frames)]

    def span(self, first: int, end: int, squeeze, expand) -> Iterator[Frame]:
        """The frames of code points [first, end): whole ones as they are, cut ones made anew."""
        for at in range(self._holding(first), len(self.frames)):
            start, stop = self.before[at], self.before[at + 1]
            if start >= end:
                return
            if first <= start and stop <= end:
                if stop > start:
                    yield self.frames[at]
            elif stop > first:
                part = expand(self.frames[at][1]).decode()[max(0, first - start) : end - start]
                yield len(part), squeeze(part.encode())

    def _holding(self, unit: int) -> int:
        low, high = 0, len(self.frames)
        while low < high:
            mid = (low + high) // 2
            if self.before[mid + 1] <= unit:
                low = mid + 1
            else:
                high = mid
        return low

    def find(self, mark: str, first: int, expand) -> int:
        """Code points before ``mark``, at ``first`` or later; -1 if it is nowhere.  A mark may lie across frames."""
        at = self._holding(first)
        tail, tail_at = "", 0
        for (_, data), start in zip(self.frames[at:], self.before[at:]):
            text = tail + expand(data).decode()
            base = tail_at if tail else start
            found = text.find(mark, max(0, first - base))
            if found >= 0:
                return base + found
            tail = text[-(len(mark) - 1) :]
            tail_at = base + len(text) - len(tail)
        return -1


def _framed(text: str, units: int, squeeze) -> list[Frame]:
    return [(len(p), squeeze(p.encode())) for p in (text[i : i + units] for i in range(0, len(text), units))]


_FRAMES = "array<struct<units:bigint,data:binary>>"
_FRAMES_ARROW = pa.list_(pa.struct([("units", pa.int64()), ("data", pa.binary())]))


def _frames_column(rows: list[list[Frame]]) -> pa.Array:
    return pa.array([[{"units": n, "data": d} for n, d in frames] for frames in rows], _FRAMES_ARROW)


def _frames_of(cell: list[dict]) -> list[Frame]:
    return [(f["units"], f["data"]) for f in cell]


def store_texts(docs: DataFrame, units: int = FRAME_UNITS) -> DataFrame:
    """(doc_id, n, marked, frames): every text as frames; ``marked`` if it holds one of the marks.  Null texts are empty."""
    if units < 1:
        raise ValueError("units must be positive")
    docs = only(docs, ["doc_id", "text"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, _ = _tools()
        for whole in batches:
            for b in _slices(whole, "text"):
                texts = [t or "" for t in b.column("text").to_pylist()]
                yield pa.record_batch(
                    [
                        b.column("doc_id"), pa.array(map(len, texts), pa.int64()),
                        pa.array([any(m in t for m in MARKS) for t in texts], pa.bool_()), _frames_column([_framed(t, units, squeeze) for t in texts]),
                    ],
                    ["doc_id", "n", "marked", "frames"],
                )

    return docs.mapInArrow(store, f"doc_id {dict(docs.dtypes)['doc_id']}, n bigint, marked boolean, frames {_FRAMES}")


def _slices(batch: pa.RecordBatch, column: str, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def plan(stored: DataFrame) -> DataFrame:
    """``stored`` with form, prefix_chars and middle_chars, drawn from the id alone (null ids: the empty id).

    plain if the text is empty or holds a mark, or by share; else spm or psm.
    """
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    n = F.col("n")
    form = F.when((n == 0) | F.col("marked") | (h[2] % 100 >= TRANSFORMED), "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    cut = F.col("form") != "plain"
    return stored.withColumn("form", form).withColumn("prefix_chars", F.when(cut, F.least(one, two))).withColumn(
        "middle_chars", F.when(cut, F.abs(one - two))
    )


def fill_in_middle(planned: DataFrame) -> DataFrame:
    """``planned`` with ``output``: frames of the transformed text.

    plain is the text; psm is <P>prefix<S>suffix<M>middle; spm is
    <S>suffix<P>prefix<M>middle.  At most two frames of a text are decompressed.
    """

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, expand = _tools()
        marks = {m: (len(m), squeeze(m.encode())) for m in MARKS}
        for whole in batches:
            for b in _slices(whole, "frames"):
                made = []
                for cell, n, form, prefix, middle in zip(*(b.column(c).to_pylist() for c in ("frames", "n", "form", "prefix_chars", "middle_chars"))):
                    text = FramedText(_frames_of(cell))
                    if form == "plain":
                        made.append(text.frames)
                        continue
                    cuts = {"<P>": (0, prefix), "<M>": (prefix, prefix + middle), "<S>": (prefix + middle, n)}
                    order = ("<P>", "<S>", "<M>") if form == "psm" else ("<S>", "<P>", "<M>")
                    made.append([f for m in order for f in (marks[m], *text.span(*cuts[m], squeeze, expand))])
                names = [c for c in b.schema.names if c not in ("frames", "marked")]
                yield pa.record_batch([*(b.column(c) for c in names), _frames_column(made)], [*names, "output"])

    kinds = dict(planned.dtypes)
    kept = [c for c in planned.columns if c not in ("frames", "marked")]
    return planned.mapInArrow(transform, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", output {_FRAMES}")


def restored_spans(output: FramedText, form: str, expand) -> list[tuple[int, int]]:
    """Where prefix, middle and suffix lie in an output, in the order of the text."""
    end = output.before[-1]
    if form == "plain":
        return [(0, end)]
    first, second = ("<P>", "<S>") if form == "psm" else ("<S>", "<P>")
    cut = output.find(second, len(first), expand)
    last = output.find("<M>", cut + len(second), expand)
    one, two, middle = (len(first), cut), (cut + len(second), last), (last + len("<M>"), end)
    return [one, middle, two] if form == "psm" else [two, middle, one]


def digests(made: DataFrame) -> DataFrame:
    """``made`` without its frames, with output_sha256 and restored_sha256.

    The text is rebuilt from the output and the form alone; frames stream
    through both digests one at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, expand = _tools()
        for whole in batches:
            for b in _slices(whole, "output"):
                shown, back = [], []
                for cell, form in zip(b.column("output").to_pylist(), b.column("form").to_pylist()):
                    output = FramedText(_frames_of(cell))
                    shown.append(_sha(output.frames, expand))
                    back.append(_sha((f for s in restored_spans(output, form, expand) for f in output.span(*s, squeeze, expand)), expand))
                names = [c for c in b.schema.names if c != "output"]
                yield pa.record_batch([*(b.column(c) for c in names), pa.array(shown, pa.string()), pa.array(back, pa.string())], [*names, "output_sha256", "restored_sha256"])

    kinds = dict(made.dtypes)
    kept = [c for c in made.columns if c != "output"]
    return made.mapInArrow(digest, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", output_sha256 string, restored_sha256 string")


def _sha(frames: Iterable[Frame], expand) -> str:
    out = hashlib.sha256()
    for _, data in frames:
        out.update(expand(data))
    return out.hexdigest()


def output_texts(made: DataFrame) -> DataFrame:
    """``made`` with its frames replaced by ``text``, the whole transformed text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, expand = _tools()
        for whole in batches:
            for b in _slices(whole, "output"):
                texts = [b"".join(expand(f["data"]) for f in cell).decode() for cell in b.column("output").to_pylist()]
                names = [c for c in b.schema.names if c != "output"]
                yield pa.record_batch([*(b.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])

    kinds = dict(made.dtypes)
    kept = [c for c in made.columns if c != "output"]
    return made.mapInArrow(read, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", text string")


def infill_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of ``docs``.

    Reads doc_id and text, whatever else the table holds.  Rows are
    independent: repeated rows give repeated results, an empty table none;
    a text of any length is cut by frames.
    """
    return digests(fill_in_middle(plan(store_texts(docs))))
