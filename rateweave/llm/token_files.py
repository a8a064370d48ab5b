"""Token ids in binary shard files that can be read in part.

File format (integers are little-endian):

* a zstandard frame for each run of documents, independent of the others: the documents' ids one
  after another, as unsigned 16-bit integers if the vocabulary allows, else 32-bit;
* a skippable frame (magic 0x184D2A5D) with the directory: a compressed table of the documents,
  each with its id, the number of its frame and the number of its token ids;
* a skippable frame (magic 0x184D2A5E), the seek table: for each frame its compressed size, its
  content size and the crc32 of its content, 4 bytes each; then the number of frames (4 bytes), the
  bytes per token id (1 byte), the size of the directory (4 bytes), and the closing magic 0x8F92EAB1.

Any zstandard reader can decompress such a file; this reader starts at the end, takes the seek table
and the directory, and then reads only the frames that hold requested documents.

Shards hold the documents in ascending id order (null ids first), dealt by range over partitions. A task
writes files of its own name; the manifest, written by Spark's own commit, lists those that count, so files of
lost or repeated tasks are ignored. The folder must be reachable by pyarrow's file systems (file://, hdfs://, s3://
and others).

Defined results: null and empty texts hold only the end id; documents with the same id are all
kept, in an arbitrary order among themselves; an empty table gives an empty manifest. Extra columns
are not stored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rateweave.llm.common import slices
from rateweave.session import fresh_path, materialize

DIRECTORY_MAGIC, SEEK_MAGIC, CLOSING_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: Content bytes from which a frame is closed. One document is never split.
FRAME_BYTES = 1 << 18
#: Content bytes from which a task starts another file.
FILE_BYTES = 256 << 20
#: Bytes of documents that are encoded together.
SLICE_BYTES = 4 << 20
#: Files are read by a task each, up to this many tasks.
MOST_TASKS = 50_000
LEVEL = 3
ENTRY = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("frame", "<u4"), ("n", "<u8")])
MANIFEST = "part int, file_no int, path string, docs long, tokens long"
CLOSING = struct.Struct("<IBII")


class Damaged(ValueError):
    """A file or frame that isn't what its seek table says."""


class ShardWriter:
    """Writes one shard file."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.entries: list[tuple] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        content = ids.astype(f"<u{self.width}").tobytes()
        self.entries.append((doc_id is not None, doc_id or 0, len(self.frames), len(ids)))
        self.open.append(content)
        self.open_bytes += len(content)
        self.bytes += len(content)
        self.tokens += len(ids)
        if self.open_bytes >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            content = b"".join(self.open)
            frame = self.compressor.compress(content)
            self.out.write(frame)
            self.frames.append((len(frame), len(content), zlib.crc32(content)))
            self.open, self.open_bytes = [], 0

    def close(self) -> None:
        self.end_frame()
        directory = self.compressor.compress(np.array(self.entries, ENTRY).tobytes())
        self.out.write(struct.pack("<II", DIRECTORY_MAGIC, len(directory)) + directory)
        seek = np.array(self.frames, "<u4").tobytes()
        seek += CLOSING.pack(len(self.frames), self.width, len(directory), CLOSING_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)
        self.out.close()


class ShardReader:
    """Reads the tables of one shard file and, on request, single frames."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n, self.width, directory, magic = CLOSING.unpack(self.at(size - CLOSING.size, CLOSING.size))
        if magic != CLOSING_MAGIC:
            raise Damaged("no seek table at the end of the file")
        table = size - CLOSING.size - 12 * n
        self.frames = np.frombuffer(self.at(table, 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        self.decompressor = zstandard.ZstdDecompressor()
        entries = self.decompressor.decompress(self.at(table - 8 - directory, directory), max_output_size=ENTRY.itemsize << 28)
        self.entries = np.frombuffer(entries, ENTRY)

    def at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> np.ndarray:
        packed, size, crc = map(int, self.frames[k])
        content = self.decompressor.decompress(self.at(int(self.starts[k]), packed), max_output_size=size) if size else b""
        if len(content) != size or zlib.crc32(content) != crc:
            raise Damaged(f"frame {k} doesn't match its checksum")
        return np.frombuffer(content, f"<u{self.width}")

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents in stored order: all, or those with the ids of ``wanted``. Other frames stay unread."""
        entries = self.entries
        ends = np.cumsum(entries["n"], dtype=np.int64)
        chosen = np.arange(len(entries))
        if wanted is not None:
            hit = np.isin(entries["doc_id"], [i for i in wanted if i is not None]) & (entries["known"] == 1)
            chosen = np.flatnonzero(hit | (entries["known"] == 0) if None in wanted else hit)
        at, content, base = -1, None, 0
        first = np.searchsorted(entries["frame"], np.arange(len(self.frames)))
        for i in chosen:
            e = entries[i]
            if e["frame"] != at:
                at = int(e["frame"])
                content, base = self.frame(at), int(ends[first[at]] - entries["n"][first[at]])
            end = int(ends[i]) - base
            yield (int(e["doc_id"]) if e["known"] else None), content[end - int(e["n"]) : end]


def write(docs: DataFrame, encode: Callable[[list[str | None]], list[bytes]], end_id: int, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write ``docs`` to a new folder in the shared one; return the manifest.

    ``encode`` turns texts into packed 32-bit ids, on the executors. ``size`` is that of the vocabulary.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-files")
    width = 2 if max(size - 1, end_id) < 1 << 16 else 4
    last = np.array([end_id], "<u4")

    def run(batches):
        from pyspark import TaskContext

        part, file_no, writer = TaskContext.get().partitionId(), 0, None
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        done = []

        def finish():
            writer.close()
            done.append((part, file_no, path, len(writer.entries), writer.tokens))

        for piece in slices(batches, size=SLICE_BYTES):
            for i, ids in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist())):
                if writer is None:
                    name = f"{part:06d}-{file_no:04d}-{uuid.uuid4().hex}.tokens"
                    path, writer = f"{folder}/{name}", ShardWriter(files.open_output_stream(f"{base}/{name}"), width)
                writer.add(i, np.concatenate([np.frombuffer(ids, "<u4"), last]))
                if writer.bytes >= FILE_BYTES:
                    finish()
                    file_no, writer = file_no + 1, None
        if writer is not None:
            finish()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        columns = zip(*done) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(columns, kinds)], names=["part", "file_no", "path", "docs", "tokens"]
        )

    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    )
    return materialize(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of the files: doc_id, start (ids stored before it), n_tokens and token_ids (packed 32-bit).

    ``doc_ids`` is a short list of documents to look up; only their frames are decompressed.
    """
    # one row per file, each of many megabytes: the running sum is over a short list
    before = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches):
        for part in slices(batches):
            for path, base in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    yield from rows(ShardReader(file), base)

    def rows(shard: ShardReader, base: int):
        before_entry = dict_starts(shard, base, wanted)
        group, held = [], 0
        for (i, ids), start in zip(shard.documents(wanted), before_entry):
            group.append((i, start, len(ids), ids.astype("<u4").tobytes()))
            held += 4 * len(ids)
            if held >= 8 << 20:
                yield batch(group)
                group, held = [], 0
        if group:
            yield batch(group)

    def batch(group):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(zip(*group), kinds)], names=["doc_id", "start", "n_tokens", "token_ids"]
        )

    # the rows are tiny, but each stands for a file of many megabytes: the number of tasks must not follow their size
    return files.repartition(max(1, min(manifest.count(), MOST_TASKS)), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, token_ids binary")


def dict_starts(shard: ShardReader, base: int, wanted: set | None) -> Iterator[int]:
    """The start of each document that ``documents(wanted)`` gives."""
    starts = base + np.cumsum(shard.entries["n"], dtype=np.int64) - shard.entries["n"].astype(np.int64)
    for e, start in zip(shard.entries, starts):
        if wanted is None or (int(e["doc_id"]) if e["known"] else None) in wanted:
            yield int(start)


def open_reader(spark: SparkSession, path: str) -> ShardReader:
    """A reader of one file, for use without Spark."""
    store, name = pafs.FileSystem.from_uri(path)
    return ShardReader(store.open_input_file(name))
