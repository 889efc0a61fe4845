"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

MAX_TOKENS = 4096
MAX_SEGMENTS = 256
MAX_LOSS = 4096
#: Documents looked at together; what they leave over goes on to the next ones.
POOL = 512
END_ID = 2
#: Bytes of text encoded in one step.
STEP_BYTES = 4 << 20
#: Words remembered with their ids, a matter of speed only.
WORDS_KEPT = 300_000
FIELDS = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"

# Chunks the fast path may cut itself: Latin letters, digits and printable ASCII, which
# normalization leaves alone but for their case.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


class WordTokenizer:
    """A word-level BPE vocabulary file, applied blank-separated chunk by chunk.

    Merges never cross a blank, so the ids of a text are those of its chunks
    in order; chunks are looked up before they are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks: dict[str, list[int]] = {"": []}
        self.pieces: dict[str, list[int]] = {}
        # The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(kept)]
        self.alphabet = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def encode(self, text: str) -> np.ndarray:
        chunks = text.replace("\n", " ").split(" ")
        known = self.chunks
        new = [c for c in set(chunks) if c not in known]
        if new:
            if len(known) > WORDS_KEPT:
                known.clear()
                known[""] = []
                self.pieces.clear()
                new = list(set(chunks) - {""})
            odd = []
            for c in new:
                if _PLAIN.fullmatch(c) and "<|" not in c:
                    known[c] = self._plain(c.lower())
                else:
                    odd.append(c)
            if odd:
                known.update(zip(odd, (e.ids for e in self.tokenizer.encode_batch(odd, add_special_tokens=False))))
        return np.fromiter(chain.from_iterable(map(known.__getitem__, chunks)), np.uint32)

    def _plain(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in _PIECES.findall(chunk):
            ids = self.pieces.get(piece)
            if ids is None:
                byte_text = piece if piece.isascii() else "".join(self.alphabet[b] for b in piece.encode())
                ids = self.pieces[piece] = [t.id for t in self.model.tokenize(byte_text)]
            out += ids
        return out


@dataclass
class Item:
    """What is left of a document: ids from ``start``; those from ``loss_from`` on bear loss."""

    doc: int
    start: int
    ids: np.ndarray
    loss_from: int

    def left(self) -> int:
        return len(self.ids) - self.start

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.loss_from))

    def fit(self, tokens: int, loss: int) -> int:
        """Ids that can be cut off within both limits."""
        free = max(0, self.loss_from - self.start)
        return min(self.left(), tokens, free + loss)


class Packer:
    """Fills one sequence after another from a pool of items.

    Each step takes, of the items that fit whole, the one whose demand
    (tokens, segments, loss) has the largest dot product with what the
    sequence has left; when none fits, the largest is cut.  At the end the
    rest goes into sequences of a power of two, which need no padding.
    """

    def __init__(self, tokens: int, segments: int, loss: int):
        self.limits = np.array([tokens, segments, loss], float)
        self.pool: list[Item] = []
        self.number = 0

    def add(self, item: Item) -> None:
        self.pool.append(item)

    def fill(self, last: bool) -> Iterator[tuple[Item, int, int, int, int]]:
        """(item, start, length, sequence, offset) of each piece placed.

        Unless it is the last time, stops when less than a pool of small
        items is left.
        """
        left = np.array([i.left() for i in self.pool], float)
        free = np.array([max(0, i.loss_from - i.start) for i in self.pool], float)
        total = left.sum()
        open_items = len(left)
        while open_items and (last or open_items > POOL // 2 or total >= 64 * self.limits[0]):
            size = self.limits[0] if total >= self.limits[0] else 1 << (int(total).bit_length() - 1)
            rest = np.array([min(size, self.limits[0]), self.limits[1], self.limits[2]])
            offset = 0
            while rest[0] >= 1 and rest[1] >= 1 and open_items:
                loss = np.maximum(left - free, 0)
                fits = (left > 0) & (left <= rest[0]) & (loss <= rest[2])
                # Demand and rest, each as a share of its limit.
                gain = (left * rest[0] / self.limits[0] ** 2 + rest[1] / self.limits[1] ** 2 + loss * rest[2] / self.limits[2] ** 2)
                if fits.any():
                    at = int(np.where(fits, gain, -1).argmax())
                    length = int(left[at])
                else:
                    room = np.minimum(np.minimum(left, rest[0]), free + rest[2])
                    at = int(room.argmax())
                    length = int(room[at])
                    if length < 1:
                        break
                item = self.pool[at]
                bears = item.loss(length)
                yield item, item.start, length, self.number, offset
                item.start += length
                left[at] -= length
                free[at] = max(0, item.loss_from - item.start)
                open_items -= left[at] == 0
                total -= length
                offset += length
                rest -= (length, 1, bears)
            self.number += 1
        self.pool = [i for i, n in zip(self.pool, left) if n > 0]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
    loss_from: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``docs`` has doc_id and text, and may have a column named by
    ``loss_from``: how many first ids of the document bear no loss (null: 0).
    Null and empty texts are the end id alone; every row, repeated or not, is
    packed; nothing is dropped.  Each task packs what it reads, so nothing is
    shuffled; sequences are numbered by task, hence ``docs`` should be a
    written table, whose splits a repeated task finds again.
    """
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    frame = only(docs, ["doc_id", "text"]) if loss_from is None else docs.select("doc_id", "text", F.col(loss_from).cast("long").alias("loss_from"))
    kind = dict(frame.dtypes)["doc_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import steps, tokenizer_of

        tokenizer, packer = tokenizer_of(tokenizer_path), Packer(max_tokens, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        kept: dict[int, object] = {}
        number = 0

        def placed(last: bool) -> None:
            for item, start, length, sequence, offset in packer.fill(last):
                # fill() moves item.start on after this step.
                piece = item.ids[start : start + length]
                rows.append((kept[item.doc], start, length, zlib.crc32(piece.tobytes()), len(item.ids), base + sequence, offset, item.loss(length)))
            alive = {i.doc for i in packer.pool}
            for doc in [d for d in kept if d not in alive]:
                del kept[doc]

        for whole in batches:
            for b in steps(whole, size=STEP_BYTES):
                froms = b.column("loss_from").to_pylist() if "loss_from" in b.schema.names else [0] * b.num_rows
                every, ends = tokenizer.encode_column(b.column("text"))
                at = 0
                for doc, end, first in zip(b.column("doc_id").to_pylist(), ends.tolist(), froms):
                    ids = np.append(every[at:end], np.uint32(END_ID)).astype("<u4")
                    at = end
                    kept[number] = doc
                    packer.add(Item(number, 0, ids, max(0, first or 0)))
                    number += 1
                    if len(packer.pool) >= POOL:
                        placed(False)
                if rows:
                    yield _batch(rows, b.schema.field("doc_id").type)
                    rows.clear()
        tokenizer.forget()
        placed(True)
        if rows:
            yield _batch(rows, _arrow(kind))

    return frame.mapInArrow(place, FIELDS.format(id=kind))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    return pa.record_batch([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)
