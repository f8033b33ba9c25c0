"""Token-id files: every document compressed by itself with a shared zstandard dictionary.

Short documents compress badly alone, and a file of large blocks cannot be read document by document. Here a
dictionary trained on serialized id arrays is shared by all documents of a data set; each document is a frame of its
own, and an offset index gives single-document access.

A data set is a folder: ``dictionary.zdict`` and one ``part-*.ztok`` file per range of document ids. File layout, all
integers little-endian::

    magic     8 bytes  b"ZTOK\\x00\\x00\\x00\\x01"
    header    u64 documents n, u64 tokens, u32 id width in bytes (2 or 4), u32 zero, 32 bytes SHA-256 of the dictionary
    index     n times: i64 doc_id, u8 1 if the id is null, u64 first token in this file, u64 end of its frame
    frames    n zstandard frames, one after another; frame k spans [end of k-1, end of k), from the first frame's start

Files are written by tasks straight into the shared folder, each attempt under a name of its own; the attempts
that Spark accepts return their names, and only the table of those names (the manifest) makes a file part of the data
set. So files of lost or repeated attempts are never read. Documents are in ascending id (nulls first, rows with
equal ids by text checksum), across files as inside them.

Defined results: a null or empty text is the end id alone; repeated rows are separate documents; an empty table
gives a data set without files. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolink.llm.tokens import crc32, encoded_rows, worker_encoder
from taxolink.session import scratch_path, write_and_read

MAGIC = b"ZTOK\x00\x00\x00\x01"
HEADER = struct.Struct("<QQII32s")
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("first", "<u8"), ("end", "<u8")])

#: Documents that train the dictionary, the bytes taken of each (cut in the task; the dictionary only helps compression), its size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 64 << 10, 64 << 10


def serialize(ids: np.ndarray, width: int) -> bytes:
    if width == 2 and len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError(f"id {int(ids.max())} does not fit two bytes: write with width 4")
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def deserialize(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype(np.uint32)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from serialized id arrays; raw content when there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Shared folders are named by URI; a plain path is a local one."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class TokenFileWriter:
    """Collects one file's documents as compressed frames; :meth:`write` writes the file."""

    def __init__(self, dictionary: bytes, width: int, level: int = 3):
        self.digest, self.width = hashlib.sha256(dictionary).digest(), width
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=shared)
        self.ids: list[int | None] = []
        self.frames: list[bytes] = []
        self.counts: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.frames.append(self.packer.compress(serialize(ids, self.width)))
        self.counts.append(len(ids))
        self.tokens += len(ids)

    def write(self, uri: str) -> None:
        index = np.zeros(len(self.ids), INDEX)
        index["doc_id"] = [d or 0 for d in self.ids]
        index["null"] = [d is None for d in self.ids]
        index["first"] = np.cumsum([0, *self.counts[:-1]])
        index["end"] = np.cumsum([len(f) for f in self.frames])
        fs, path = _file_system(uri)
        with fs.open_output_stream(path) as out:
            out.write(MAGIC)
            out.write(HEADER.pack(len(self.ids), self.tokens, self.width, 0, self.digest))
            out.write(index.tobytes())
            for f in self.frames:
                out.write(f)


class TokenFile:
    """Random access to one file: :meth:`get` reads a single document's bytes."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = _file_system(uri)
        self.file = fs.open_input_file(path)
        if self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.n, self.tokens, self.width, _, digest = HEADER.unpack(self.file.read(HEADER.size))
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.index = np.frombuffer(self.file.read(self.n * INDEX.itemsize), INDEX)
        self.base = len(MAGIC) + HEADER.size + self.n * INDEX.itemsize
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpacker = zstandard.ZstdDecompressor(dict_data=shared)

    def get(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document."""
        begin = int(self.index["end"][k - 1]) if k else 0
        self.file.seek(self.base + begin)
        return deserialize(self.unpacker.decompress(self.file.read(int(self.index["end"][k]) - begin)), self.width)

    def find(self, doc_id: int) -> np.ndarray:
        """Ids of a document by its id."""
        valid = int(self.index["null"].sum())
        k = valid + int(np.searchsorted(self.index["doc_id"][valid:], doc_id))
        if k == self.n or self.index["doc_id"][k] != doc_id:
            raise KeyError(doc_id)
        return self.get(k)


@lru_cache(maxsize=4)
def read_dictionary(folder: str) -> bytes:
    fs, path = _file_system(f"{folder}/dictionary.zdict")
    with fs.open_input_file(path) as f:
        return f.read()


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, width: int = 2,
                      spaced: bool = False, partitions: int | None = None, file_docs: int = 1 << 17,
                      file_tokens: int = 1 << 24, special: bool = False) -> DataFrame:
    """Write documents ``(doc_id, text)`` as token files; returns the manifest.

    The manifest has ``file`` (URI), ``part``, ``chunk`` (their order), ``docs`` and ``tokens``. Texts are shuffled once, by
    ranges of document ids; a task writes its range in files of ``file_docs`` documents, or once they have ``file_tokens`` ids, so it
    holds one file's compressed frames at a time.
    """
    spark = docs.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path, spaced, special)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([serialize(ids, width)[:SAMPLE_BYTES] for _, ids in encoded_rows(encoder, batch, end_id)], pa.binary())],
                names=["ids"])

    # the ids with the smallest hashes, so the sample and the dictionary are the same on each run
    first = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    chosen = write_and_read(first.distinct(), "token-sample")
    some = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text")
    samples = [bytes(r[0]) for r in some.mapInArrow(sampled, "ids binary").limit(SAMPLE_DOCS).collect()]
    dictionary = train_dictionary(sorted(samples)) if samples else b""
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary.zdict") as f:
        f.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, attempt, chunk = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        encoder, shared = worker_encoder(tokenizer_path, spaced, special), read_dictionary(folder)
        file = TokenFileWriter(shared, width)

        def flush() -> pa.RecordBatch:
            uri = f"{folder}/part-{part:05d}-{chunk:05d}-{attempt}.ztok"
            file.write(uri)
            return pa.RecordBatch.from_pylist(
                [{"file": uri, "part": part, "chunk": chunk, "docs": len(file.ids), "tokens": file.tokens}],
                schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("chunk", pa.int32()),
                                  ("docs", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, ids in encoded_rows(encoder, batch, end_id):
                file.add(names[i], ids)
                if len(file.ids) >= file_docs or file.tokens >= file_tokens:
                    yield flush()
                    chunk += 1
                    file = TokenFileWriter(shared, width)
        if file.ids:
            yield flush()

    ordered = (rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce("text", F.lit("")))))
    manifest = ordered.mapInArrow(write, "file string, part int, chunk int, docs long, tokens long")
    return write_and_read(manifest, "token-manifest")


def _spans(batches: Iterator[pa.RecordBatch], folder: str, docs: int = 512
           ) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray]]]:
    """Ids, starts and token arrays of the documents of manifest rows ``(file, before)``, some at a time."""
    dictionary = read_dictionary(folder)
    for batch in batches:
        for row in batch.to_pylist():
            f = TokenFile(row["file"], dictionary)
            for lo in range(0, f.n, docs):
                part = f.index[lo:lo + docs]
                yield (pa.array(part["doc_id"], mask=part["null"].astype(bool)),
                       pa.array(part["first"].astype(np.int64) + row["before"]),
                       [f.get(k) for k in range(lo, lo + len(part))])
            f.file.close()


def _files(manifest: DataFrame) -> DataFrame:
    """Manifest rows with the number of ids in all files before, dealt out over the cluster.

    One row per file: the running count is a sum over the manifest, not over documents.
    """
    order = Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))
    return files.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """Read a data set back: ``(doc_id, start, ids)``; ``start`` counts the ids of all documents before."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, starts, arrays in _spans(batches, folder):
            yield pa.RecordBatch.from_arrays([ids, starts, pa.array(arrays, pa.list_(pa.int64()))],
                                             names=["doc_id", "start", "ids"])
    return _files(manifest).mapInArrow(read, "doc_id long, start long, ids array<bigint>")


def token_file_digests(folder: str, manifest: DataFrame) -> DataFrame:
    """Per document of a data set: ``(doc_id, start, n_tokens, ids_crc32)``, read from its files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, starts, arrays in _spans(batches, folder):
            yield pa.RecordBatch.from_arrays(
                [ids, starts, pa.array([len(a) for a in arrays], pa.int64()),
                 pa.array([crc32(a) for a in arrays], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return _files(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for a data set under the shared folder, as a full URI: a path without a scheme means to the workers what
    it means to Spark."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "token-files"))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
