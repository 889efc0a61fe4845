"""Token ids of Arrow text columns by distinct chunks."""

from __future__ import annotations

import ctypes
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .packing import _PIECES, _PLAIN, WordTokenizer

#: Bytes of text encoded in one step; a longer text is a step of its own.
STEP_BYTES = 12 << 20
#: Distinct chunks remembered with their ids, a matter of speed only.
CHUNKS_KEPT = 200_000


class BatchTokenizer(WordTokenizer):
    """Encodes whole columns: every distinct blank-separated chunk is looked up once a step.

    Ids are those of the tokenizer file without special tokens: merges never
    cross a blank, so a text's ids are its chunks' ids in order.  Ids of
    chunks are kept as bytes, little-endian uint32.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text ends); nulls are empty texts."""
        parts = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = pc.dictionary_encode(parts.flatten())
        distinct = words.dictionary.to_pylist()
        self._learn(distinct)
        found = [self.chunks[c] for c in distinct]
        starts = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) >> 2, out=starts[1:])
        pool = np.frombuffer(b"".join(found), "<u4")
        taken = pc.take(pa.LargeListArray.from_arrays(pa.array(starts), pa.array(pool)), words.indices)
        edges = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        return taken.values.to_numpy(), taken.offsets.to_numpy()[edges[1:]]

    def forget(self) -> None:
        """Drop what a task remembered and give free memory back, so that an idle worker holds little."""
        self.chunks.clear()
        self.pieces.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    def _learn(self, distinct: list[str]) -> None:
        known, pieces = self.chunks, self.pieces
        new = [c for c in distinct if c not in known]
        if len(known) + len(new) > CHUNKS_KEPT:
            known.clear()
            pieces.clear()
            new = distinct
        odd = []
        for c in new:
            if c.isascii() and c.isalpha():
                low = c.lower()
                known[c] = pieces.get(low) or self._piece(low)
            elif _PLAIN.fullmatch(c) and "<|" not in c:
                known[c] = b"".join([pieces.get(p) or self._piece(p) for p in _PIECES.findall(c.lower())])
            elif c:
                odd.append(c)
            else:
                known[c] = b""
        for c, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else ()):
            known[c] = array("I", e.ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        byte_text = piece if piece.isascii() else "".join([self.alphabet[b] for b in piece.encode()])
        ids = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(byte_text)]).tobytes()
        return ids


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> BatchTokenizer:
    """One tokenizer for all the tasks a worker process runs."""
    return BatchTokenizer(path)


def steps(batch: pa.RecordBatch, column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about ``size`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, length in enumerate(sizes):
        if i > first and held + length > size:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += length
    if first < batch.num_rows:
        yield batch.slice(first)
