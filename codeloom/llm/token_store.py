"""Token-id files: one zstandard frame for each document, a shared dictionary, an offset index.

File format (little-endian): 8-byte magic, 32-byte SHA-256 of the dictionary; then the frames, one for each
document, each the compression of its ids as unsigned 32-bit integers; then the index, one entry of
``INDEX`` for each document; then a trailer: index place (u64), documents (u64), CRC-32 of the index (u32),
4 bytes 0, magic. Files follow each other in ascending document-id order. The dictionary lies beside them
in ``dictionary.zdict``. One document is read with the trailer, its index entry and its frame alone.

Cases: a null text is an empty one; a null id sorts after all others; rows that share an id each keep their
own entry, in the order of a hash of their texts, and may lie in several files that follow each other; a very long text
is one frame; further columns are left out, whatever their names; an empty table makes no file and no row.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, in_order, small_batches, tidy
from .tokens import encode_documents

MAGIC = b"CLTOKEN1"
TRAILER = struct.Struct("<QQII8s")
INDEX = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("at", "<u8"), ("size", "<u4"), ("n_tokens", "<u4")])
#: The dictionary is fitted on about this many documents, chosen by a hash of the id, and has this size in bytes.
SAMPLE_DOCS, DICT_BYTES = 1024, 64 * 1024
#: Ids that the sample takes of a document: all, or of a longer one a stretch of this many at a place drawn from its checksum.
SAMPLE_IDS = 4096
#: Bytes of frames read at once.
READ_BYTES = 4 << 20


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary; of too few samples, their bytes themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError, ZeroDivisionError):
        return b"".join(samples)[:size]


def fit_dictionary(docs: DataFrame, tokenizer: str, end_id: int | None, sample: int = SAMPLE_DOCS) -> bytes:
    """Fit on about ``sample`` documents (all, of a table with fewer); at most twice as many reach the driver, ``SAMPLE_IDS`` ids of each."""
    step = max(1, docs.count() // sample)
    chosen = docs.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).limit(2 * sample)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            arrays = encode_documents(tokenizer, b.column("text").to_pylist(), end_id)
            places = [zlib.crc32(a.tobytes()) % max(1, len(a) - SAMPLE_IDS + 1) for a in arrays]
            yield pa.RecordBatch.from_pydict({"ids": pa.array([a[k : k + SAMPLE_IDS].tobytes() for a, k in zip(arrays, places)], pa.binary())})

    return train_dictionary([bytes(r.ids) for r in chosen.mapInArrow(ids, "ids binary").collect()])


def frame_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


class Writer:
    """Writes one file; its bytes reach storage as they come, only the index is kept."""

    def __init__(self, sink: io.RawIOBase, dictionary: bytes, level: int = 3):
        self.sink, self.at, self.entries = sink, 0, []
        shared = frame_dictionary(dictionary)
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True) if shared else zstandard.ZstdCompressor(level=level)
        self._put(MAGIC + hashlib.sha256(dictionary).digest())

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.pack.compress(ids.astype("<u4", copy=False).tobytes())
        self.entries.append((doc_id or 0, doc_id is None, self.at, len(frame), len(ids)))
        self._put(frame)

    def finish(self) -> None:
        at, index = self.at, np.array(self.entries, INDEX).tobytes()
        self._put(index)
        self._put(TRAILER.pack(at, len(self.entries), zlib.crc32(index), 0, MAGIC))


class Reader:
    """Reads a file by its index; raises ValueError where magic, dictionary hash or checksum don't hold."""

    def __init__(self, source: pa.NativeFile, dictionary: bytes):
        self.source, size = source, source.size()
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC or source.read(32) != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file, or of another dictionary")
        source.seek(size - TRAILER.size)
        at, n, crc, _, magic = TRAILER.unpack(source.read(TRAILER.size))
        source.seek(at)
        raw = source.read(n * INDEX.itemsize)
        if magic != MAGIC or zlib.crc32(raw) != crc:
            raise ValueError("the index is damaged")
        self.index = np.frombuffer(raw, INDEX)
        shared = frame_dictionary(dictionary)
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(frame, max_output_size=4 * int(n)) if n else b"", "<u4")

    def get(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document; only its frame is read."""
        e = self.index[k]
        self.source.seek(int(e["at"]))
        return self._ids(self.source.read(int(e["size"])), e["n_tokens"])

    def __iter__(self) -> Iterator[tuple[np.void, np.ndarray]]:
        k, total = 0, len(self.index)
        while k < total:
            first, until = int(self.index[k]["at"]), k
            while until < total and (until == k or int(self.index[until]["at"]) + int(self.index[until]["size"]) - first <= READ_BYTES):
                until += 1
            last = self.index[until - 1]
            self.source.seek(first)
            block = memoryview(self.source.read(int(last["at"]) + int(last["size"]) - first))
            for e in self.index[k:until]:
                a = int(e["at"]) - first
                yield e, self._ids(block[a : a + int(e["size"])], e["n_tokens"])
            k = until


def write_tokens(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> tuple[
    list[dict], bytes]:
    """Encode whole texts and write them as files under ``path`` in ascending id order.

    Returns the files in order (uri, n_docs, n_tokens) and the dictionary. A task names its file anew at each
    attempt, so a lost or repeated attempt leaves a file that no list names. What reaches the driver is one
    row a file.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dictionary = fit_dictionary(docs, tokenizer, end_id)
    store, root = filesystem(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, writer, tokens = TaskContext.get().partitionId(), uuid.uuid4().hex, None, 0
        for b in small_batches(batches):
            if writer is None:
                here, top = filesystem(path)
                here.create_dir(top, recursive=True)
                sink = here.open_output_stream(f"{top}/{part:06d}-{name}.tok")
                writer = Writer(sink, dictionary)
            for i, ids in zip(b.column("id").to_pylist(), encode_documents(tokenizer, b.column("text").to_pylist(), end_id)):
                writer.add(i, ids)
                tokens += len(ids)
        if writer:
            writer.finish()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "uri": [f"{path}/{part:06d}-{name}.tok"],
                "n_docs": pa.array([len(writer.entries)], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    # rows of one id, or without one, are told apart by their texts and their places in the input, so that no id needs one task
    tied = docs.withColumn("_tie", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
    keys = in_order(["id", "_tie", "_place"])
    placed = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    files = placed.mapInArrow(tidy(write, keep_encoder=True), "part long, uri string, n_docs long, n_tokens long").collect()
    return [r.asDict() for r in sorted(files, key=lambda r: r.part)], dictionary


def read_tokens(spark, files: list[dict], dictionary: bytes) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32, and where its frame lies."""
    base, rows = 0, []
    for f in files:
        rows.append((f["uri"], base))
        base += f["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, frame_at long, frame_bytes long, dictionary_sha256 string"
    if not rows:
        return spark.createDataFrame([], schema)
    digest = hashlib.sha256(dictionary).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("base").to_pylist()):
                store, at = filesystem(uri)
                with store.open_input_file(at) as source:
                    reader = Reader(source, dictionary)
                    crcs = np.fromiter((zlib.crc32(ids.tobytes()) for _, ids in reader), "i8", len(reader.index))
                    x = reader.index
                    n = x["n_tokens"].astype("i8")
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(x["doc_id"], mask=x["null_id"].astype(bool)), "start": pa.array(start + np.cumsum(n) - n),
                            "n_tokens": pa.array(n), "ids_crc32": pa.array(crcs),
                        "file": [uri] * len(x), "frame_at": pa.array(x["at"].astype("i8")), "frame_bytes": pa.array(x["size"].astype("i8")),
                            "dictionary_sha256": [digest] * len(x),
                    })

    listed = spark.createDataFrame(rows, "uri string, base long").repartition(len(rows))
    return listed.mapInArrow(tidy(read), schema)


def token_digest(df: DataFrame, tokenizer: str, end_id: int | None = None, **columns: str) -> DataFrame:
    """Write ``df``'s ids to the shared folder and read them back."""
    path = fresh_path(df.sparkSession, "tokens")
    files, dictionary = write_tokens(df, path, tokenizer, end_id=end_id, **columns)
    return read_tokens(df.sparkSession, files, dictionary)
