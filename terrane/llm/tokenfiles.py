"""Token-id files: one zstandard frame per document over a shared dictionary, with an index for short access.

A folder holds ``dictionary-<sha256>`` (trained on serialized id arrays), data
files, and ``manifest.json``, which lists the files that count, in document
order, with their id counts and id ranges.  A data file is

    magic, header length (uint32), header (JSON: dictionary hash, bytes per id)
    frames, one per document: little-endian ids, compressed on their own
    index (Arrow stream: doc_id, offset, size, n_tokens), in document order
    index offset (uint64), index length (uint64), magic

Files are written by a Spark data source: every task sends the names of what
it finished with its commit message, and only the commit writes the manifest,
so repeated or lost tasks leave nothing that readers see.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import only, staged
from .tokens import steps, tokenizer_of

FORMAT = "token_frames"
MAGIC = b"TKF1"
END_ID = 1
#: The dictionary is trained on at most this many documents, on at most this many ids of each;
#: it changes the size of files, never what is read from them.
DICTIONARY_DOCS = 2000
DICTIONARY_IDS = 2048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Ids after which a task begins another file, and bytes of ids given out at once.
FILE_IDS = 128 << 20
BATCH_BYTES = 16 << 20
_TAIL = struct.Struct("<QQ4s")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(path)


def _read(path: str) -> bytes:
    system, place = filesystem(path)
    with system.open_input_stream(place) as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    """Whole or not at all: written beside its place, then moved there."""
    system, place = filesystem(path)
    beside = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as f:
        f.write(data)
    system.move(beside, place)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


# --- encoding ----------------------------------------------------------------

def _encoder(tokenizer_path: str, end_id: int, most: int | None, dictionary: bytes, width: int):
    """Arrow batches of documents to (doc_id, n_tokens, frame); without a dictionary level, raw id bytes of ``most`` ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last = tokenizer_of(tokenizer_path), end_id.to_bytes(width, "little")
        if most is None:
            held = _dictionary(dictionary)
            squeeze = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **({"dict_data": held} if held else {})).compress
        else:
            squeeze = bytes
        for whole in batches:
            for b in steps(whole):
                ids, ends = tokenizer.encode_column(b.column("text"))
                serial = ids.astype(f"<u{width}").tobytes()
                counts = np.diff(ends, prepend=0) + 1
                frames, first = [], 0
                for end in (ends * width).tolist():
                    mine = serial[first:end] + last
                    frames.append(squeeze(mine if most is None else mine[: most * width]))
                    first = end
                yield pa.record_batch(
                    [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n_tokens", "frame"]
                )
        tokenizer.forget()

    return encode


def id_width(tokenizer_path: str) -> int:
    """Bytes that hold every id of the tokenizer."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def train(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> bytes:
    """A dictionary from the serialized ids of documents chosen by a hash; empty when there is too little to learn."""
    rows = docs.count()
    if not rows:
        return b""
    rate = int(min(1.0, DICTIONARY_DOCS / rows) * (1 << 30)) + 1
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < rate).repartition(4)
    width = id_width(tokenizer_path)
    made = chosen.mapInArrow(_encoder(tokenizer_path, end_id, DICTIONARY_IDS, b"", width), _frame_schema(docs))
    samples = [bytes(r.frame) for r in made.select("frame").limit(2 * DICTIONARY_DOCS).collect()]
    if sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()


def _frame_schema(docs: DataFrame) -> str:
    return f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, frame binary"


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text), each followed by ``end_id``, in ascending doc_id order.

    Null and empty texts are the end id alone; null ids come first; rows with
    one id lie side by side, by length and content, so reruns agree.  Other
    columns are left aside.  ``folder`` must be reachable by every executor
    and hold no manifest yet.
    """
    docs = only(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    width, dictionary = id_width(tokenizer_path), train(docs, tokenizer_path, end_id)
    mark = hashlib.sha256(dictionary).hexdigest()
    system, place = filesystem(folder)
    system.create_dir(place, recursive=True)
    _write(f"{folder}/dictionary-{mark}", dictionary)
    # staged: the range partitioner reads its input twice, and encoding is the dear part
    frames = staged(docs.mapInArrow(_encoder(tokenizer_path, end_id, None, dictionary, width), _frame_schema(docs)), "frames")
    keys = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("frame")]
    spread = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.xxhash64("frame")]
    spark.dataSource.register(TokenFrames)
    (
        frames.repartitionByRange(*spread).sortWithinPartitions(spread[0], spread[1], spread[2], keys[2])
        .write.format(FORMAT).option("dictionary", mark).option("width", width).mode("append").save(folder)
    )


def read_tokens(spark: SparkSession, folder: str, doc_ids: Sequence | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian uint32 bytes, ``start`` the ids of all documents before.

    With ``doc_ids`` only those documents: files that cannot hold one are not
    opened, and of the others only the index and the wanted frames are read.
    """
    spark.dataSource.register(TokenFrames)
    reader = spark.read.format(FORMAT)
    if doc_ids is not None:
        reader = reader.option("doc_ids", json.dumps(list(doc_ids)))
    return reader.load(folder)


# --- the data source ---------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    """Files of one task: name, ids, documents, first and last id."""

    partition: int
    files: list[dict]


@dataclass
class Piece(InputPartition):
    """One data file and the ids before it."""

    name: str
    before: int


class TokenFrames(DataSource):
    """Spark data source over a folder of token files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _folder(self) -> str:
        return self.options["path"]

    def schema(self) -> StructType | str:
        kind = json.loads(_read(f"{self._folder()}/manifest.json"))["doc_id"]
        return f"doc_id {kind}, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        wanted = self.options.get("doc_ids")
        return FrameReader(self._folder(), schema["doc_id"].dataType.simpleString(), None if wanted is None else json.loads(wanted))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        kind = schema["doc_id"].dataType.simpleString()
        return FrameWriter(self._folder(), kind, self.options["dictionary"], int(self.options["width"]))


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, kind: str, dictionary: str, width: int):
        self.folder, self.kind, self.dictionary, self.width = folder, kind, dictionary, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        partition = TaskContext.get().partitionId()
        done: list[dict] = []
        file: _OpenFile | None = None
        for batch in iterator:
            for doc, n, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame"))):
                if file is None:
                    file = _OpenFile(self.folder, f"ids-{partition:06d}-{len(done):04d}-{uuid.uuid4().hex}", self.dictionary, self.width, batch.schema.field("doc_id").type)
                file.add(doc, n, frame)
                if file.ids >= FILE_IDS:
                    done.append(file.close())
                    file = None
        if file is not None:
            done.append(file.close())
        return Written(partition, done)

    def commit(self, messages: list[Written | None]) -> None:
        system, place = filesystem(f"{self.folder}/manifest.json")
        if system.get_file_info(place).type != fs.FileType.NotFound:
            raise ValueError(f"{self.folder} already holds token files")
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files]
        body = {"doc_id": self.kind, "dictionary": self.dictionary, "width": self.width, "files": files}
        _write(f"{self.folder}/manifest.json", json.dumps(body).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for f in m.files if m else []:
                system, place = filesystem(f"{self.folder}/{f['name']}")
                system.delete_file(place)


class _OpenFile:
    """A data file being written; frames go out as they come, the index stays until the end."""

    def __init__(self, folder: str, name: str, dictionary: str, width: int, kind: pa.DataType):
        system, place = filesystem(f"{folder}/{name}")
        self.name, self.kind, self.ids = name, kind, 0
        self.stream = system.open_output_stream(place)
        header = json.dumps({"dictionary": dictionary, "width": width}).encode()
        self.stream.write(MAGIC + struct.pack("<I", len(header)) + header)
        self.at = len(MAGIC) + 4 + len(header)
        self.rows: tuple[list, list, list, list] = ([], [], [], [])

    def add(self, doc, n: int, frame: bytes) -> None:
        self.stream.write(frame)
        for column, value in zip(self.rows, (doc, self.at, len(frame), n)):
            column.append(value)
        self.at += len(frame)
        self.ids += n

    def close(self) -> dict:
        columns = [pa.array(self.rows[0], self.kind), *(pa.array(c, pa.int64()) for c in self.rows[1:])]
        index = pa.record_batch(columns, ["doc_id", "offset", "size", "n_tokens"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(index)
        data = sink.getvalue().to_pybytes()
        self.stream.write(data + _TAIL.pack(self.at, len(data), MAGIC))
        self.stream.close()
        named = [d for d in (self.rows[0][0], self.rows[0][-1]) if d is not None]
        first, last = (self.rows[0][0], self.rows[0][-1]) if len(named) == 2 else (None, None)
        return {"name": self.name, "ids": self.ids, "docs": len(index), "first": first, "last": last}


class FrameReader(DataSourceReader):
    def __init__(self, folder: str, kind: str, wanted: list | None):
        self.folder, self.kind, self.wanted = folder, kind, None if wanted is None else set(wanted)
        self.manifest = json.loads(_read(f"{folder}/manifest.json"))

    def partitions(self) -> Sequence[Piece]:
        before, out = 0, []
        for f in self.manifest["files"]:
            if self.wanted is None or f["first"] is None or any(f["first"] <= w <= f["last"] for w in self.wanted if w is not None):
                out.append(Piece(f["name"], before))
            before += f["ids"]
        # a reader needs a partition, also when there is nothing to read
        return out or [Piece("", 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, place = filesystem(f"{self.folder}/{partition.name}")
        with system.open_input_file(place) as f:
            header, index = _head(f), _index(f)
            raw = _read(f"{self.folder}/dictionary-{header['dictionary']}")
            if hashlib.sha256(raw).hexdigest() != header["dictionary"]:
                raise ValueError(f"the dictionary of {partition.name} does not match its hash")
            held = _dictionary(raw)
            expand = zstandard.ZstdDecompressor(**({"dict_data": held} if held else {})).decompress
            docs, offsets, sizes, counts = (c.to_pylist() for c in index.columns)
            rows: list[tuple] = []
            start, taken = partition.before, 0
            for doc, offset, size, n in zip(docs, offsets, sizes, counts):
                if self.wanted is None or doc in self.wanted:
                    ids = np.frombuffer(expand(f.read_at(size, offset)), f"<u{header['width']}")
                    if len(ids) != n:
                        raise ValueError(f"a frame of {partition.name} holds {len(ids)} ids instead of {n}")
                    rows.append((doc, start, n, ids.astype("<u4").tobytes()))
                    taken += 4 * n
                    if taken >= BATCH_BYTES:
                        yield _rows(rows, index.schema.field("doc_id").type)
                        rows, taken = [], 0
                start += n
            if rows:
                yield _rows(rows, index.schema.field("doc_id").type)


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = (kind, pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "n_tokens", "ids"])


def _head(f: pa.NativeFile) -> dict:
    magic, size = struct.unpack("<4sI", f.read_at(8, 0))
    if magic != MAGIC:
        raise ValueError("not a token file")
    return json.loads(f.read_at(size, 8))


def _index(f: pa.NativeFile) -> pa.RecordBatch:
    at, size, magic = _TAIL.unpack(f.read_at(_TAIL.size, f.size() - _TAIL.size))
    if magic != MAGIC:
        raise ValueError("the token file is cut short")
    with pa.ipc.open_stream(pa.BufferReader(f.read_at(size, at))) as stream:
        return stream.read_all().combine_chunks().to_batches()[0]


def token_report(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from token files written to ``folder``."""
    write_tokens(docs, tokenizer_path, folder, end_id)
    back = read_tokens(docs.sparkSession, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
