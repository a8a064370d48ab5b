"""Web archives (WARC 1.1) with a two-level capture index.

Archives. Each page is a record in a gzip member of its own, so that a record can be read by its byte range. Of
pages with equal payloads of at least ``LEAST_REVISIT_BYTES`` bytes, that with the largest id is a ``response``; the others are
``revisit`` records that name it and have no payload. A task writes files of its own name, up to about ``FILE_BYTES`` each.

Index. The captures' keys are URLs with the host reversed (``com,example)/path``) followed by the id. They are sorted by range over
partitions, and each partition writes its lines in compressed blocks of ``BLOCK_LINES``, and beside them the sparse directory of its
blocks (first key and id, byte range). The directory of all blocks is also a table written by Spark.

Lookup. ``find`` sorts the wanted keys by range, and each task searches for its own: by binary search first among the files' first
keys, then in that file's directory for the last block that can hold the key, then in the block, of which it reads the byte range.
``records`` reads the byte ranges of the captures found. A task holds the first keys of the files (one for each partition that wrote the
index), one file's directory and one block at a time.

Both writers return tables written by Spark's own commit, so that files of lost or repeated tasks don't count. The folder
must be reachable by pyarrow's file systems (file://, hdfs://, s3:// and others).

Defined results: a null html is an empty payload; a null url has the key ``-``; rows without id are written and read back with a
null id, and are never referred to. Rows with the same id and payload as the winner are all responses. Empty tables give
empty archives. Other columns are not stored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, functions as F

from rateweave.llm.common import slices
from rateweave.session import fresh_path, materialize

LEAST_REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
BLOCK_LINES = 3000
#: Index blocks, and bytes of archives, that a reading task is given; beyond MOST_TASKS tasks, each gets more.
TASK_BLOCKS = 8
TASK_BYTES = 4 << 20
MOST_TASKS = 100_000
LEVEL = 4
#: What the file with an index file's sparse directory has at the end of its name.
SPARSE = ".directory"
DATE = "2024-01-01T00:00:00Z"
CAPTURES = "key string, page_id long, record_type string, path string, start long, size long"
DIRECTORY = "first_key string, first_id long, path string, start long, size long, lines long"
CAPTURE_KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())


def batch(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)


def reversed_host_key(url: str | None) -> str:
    """``http://www.example.com:80/a?b`` becomes ``com,example,www:80)/a?b``."""
    if url is None:
        return "-"
    rest = url.split("://", 1)[-1].split("#", 1)[0].replace("\n", "%0A").replace("\t", "%09")
    cut = min((i for c in "/?" if (i := rest.find(c)) >= 0), default=len(rest))
    host, _, port = rest[:cut].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:] or "/")


def payload_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{page_id if page_id is not None else 'unknown-' + uuid.uuid4().hex}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_name(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", digest),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_name(refers_to)),
        ]
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode("utf-8") + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def page_of(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix("urn:page:")
    return int(number) if number.lstrip("-").isdigit() else None


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives and return their captures: key, page_id, record_type, path, start and size of each record."""
    folder = fresh_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= LEAST_REVISIT_BYTES, F.sha1("payload")))
    winners = rows.where("digest is not null and page_id is not null").groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    # one small row per payload that occurs twice or more; a frequent payload's pages are split over tasks
    rows = rows.join(winners.where("n > 1").select("digest", "winner"), "digest", "left").select(
        "page_id", "url", "payload", F.expr("nullif(winner, page_id)").alias("refers_to")
    )

    def run(batches):
        from pyspark import TaskContext

        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        part, out, path, at = TaskContext.get().partitionId(), None, None, 0
        for piece in slices(batches):
            done = []
            for i, address, body, refers_to in zip(*(c.to_pylist() for c in piece.columns)):
                if out is None:
                    name = f"{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    path, out, at = f"{folder}/{name}", files.open_output_stream(f"{base}/{name}", compression=None), 0
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = packer.compress(record(i, address, body, payload_digest(body), refers_to)) + packer.flush()
                out.write(data)
                kind = "response" if refers_to is None else "revisit"
                done.append((reversed_host_key(address), i, kind, path, at, len(data)))
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            yield batch(done, ["key", "page_id", "record_type", "path", "start", "size"], CAPTURE_KINDS)
        if out is not None:
            out.close()

    return materialize(rows.mapInArrow(run, CAPTURES), "captures")


def line_of(key: str, page_id: int | None, record_type: str, path: str, start: int, size: int) -> str:
    return "\t".join((key, "" if page_id is None else str(page_id), record_type, path, str(start), str(size)))


def capture_of(line: str) -> tuple:
    key, page_id, record_type, path, start, size = line.split("\t")
    return key, int(page_id) if page_id else None, record_type, path, int(start), int(size)


def write_index(captures: DataFrame) -> DataFrame:
    """Write the index blocks and return the directory, sorted by its first keys within and over partitions."""
    folder = fresh_path(captures.sparkSession, "capture-index")

    def run(batches):
        from pyspark import TaskContext

        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.idx"
        packer, done, open_lines, at = zstandard.ZstdCompressor(level=LEVEL), [], [], 0
        with files.open_output_stream(f"{base}/{name}", compression=None) as out:

            def end_block():
                nonlocal at, open_lines
                data = packer.compress("\n".join(open_lines).encode("utf-8"))
                out.write(data)
                done.append((*capture_of(open_lines[0])[:2], f"{folder}/{name}", at, len(data), len(open_lines)))
                at, open_lines = at + len(data), []

            for piece in slices(batches):
                for row in zip(*(c.to_pylist() for c in piece.columns)):
                    open_lines.append(line_of(*row))
                    if len(open_lines) >= BLOCK_LINES:
                        end_block()
            if open_lines:
                end_block()
        with files.open_output_stream(f"{base}/{name}{SPARSE}", compression=None) as out:
            out.write(packer.compress("\n".join(line_of(key, i, "block", *place) for key, i, *place, _ in done).encode("utf-8")))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield batch(done, ["first_key", "first_id", "path", "start", "size", "lines"], kinds)

    # keys in byte order, as the binary search compares them; equal keys of a frequent URL are parted by id
    ordered = captures.select("key", "page_id", "record_type", "path", "start", "size")
    ordered = ordered.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "path", "start")
    return materialize(ordered.mapInArrow(run, DIRECTORY), "capture-directory")


def range_of(path: str, start: int, size: int) -> bytes:
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        file.seek(start)
        return file.read(size)


def unpacked(data: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read().decode("utf-8").split("\n")


def block_lines(path: str, start: int, size: int) -> list[str]:
    return unpacked(range_of(path, start, size))


def sparse_directory(path: str) -> list[tuple]:
    """The blocks of an index file, as captures are given, under their first keys."""
    store, name = pafs.FileSystem.from_uri(path + SPARSE)
    with store.open_input_file(name) as file:
        return [capture_of(line) for line in unpacked(file.read())]


def place_of(key: str, page_id: int | None) -> tuple[bytes, bool, int]:
    """The order of the index: keys by their bytes, rows without id first."""
    return key.encode("utf-8"), page_id is not None, page_id or 0


class Searcher:
    """Finds captures by key and id; keeps the last directory and block that it read."""

    def __init__(self, files: list[tuple]):
        self.files = sorted((place_of(key, i), path) for key, i, path in files)
        self.heads = [head for head, _ in self.files]
        self.path = self.at = None

    def blocks(self, path: str) -> tuple[list, list]:
        if path != self.path:
            self.own = sparse_directory(path)
            self.path, self.firsts = path, [place_of(*b[:2]) for b in self.own]
        return self.firsts, self.own

    def lines(self, block: tuple) -> tuple[list, list]:
        if block[3:] != self.at:
            self.rows = [capture_of(line) for line in block_lines(*block[3:])]
            self.at, self.places = block[3:], [place_of(*r[:2]) for r in self.rows]
        return self.places, self.rows

    def find(self, key: str, page_id: int | None) -> Iterator[list[tuple]]:
        """Captures of the key and id, block by block."""
        wanted = place_of(key, page_id)
        # what is equal may begin in the one before the first that starts with it
        f = max(bisect.bisect_left(self.heads, wanted) - 1, 0)
        while f < len(self.heads) and self.heads[f] <= wanted:
            firsts, blocks = self.blocks(self.files[f][1])
            k = max(bisect.bisect_left(firsts, wanted) - 1, 0)
            while k < len(firsts) and firsts[k] <= wanted:
                places, rows = self.lines(blocks[k])
                yield rows[bisect.bisect_left(places, wanted) : bisect.bisect_right(places, wanted)]
                k += 1
            f += 1


def find(directory: DataFrame, wanted: DataFrame, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """The captures of each distinct pair of URL and id in ``wanted``; null is a URL and an id like others."""
    names, kinds = ["key", "page_id", "record_type", "path", "start", "size"], CAPTURE_KINDS

    def keyed(batches):
        for part in slices(batches, 4096):
            keys = [reversed_host_key(u) for u in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), part.column(1)], names=["key", "page_id"])

    asked = wanted.select(F.col(url).cast("string").alias("url"), F.col(page_id).cast("long").alias("page_id"))
    asked = asked.mapInArrow(keyed, "key string, page_id long").distinct()
    asked = asked.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    # as many rows as partitions wrote the index
    files = [tuple(r) for r in directory.groupBy("path").agg(F.min(F.struct("first_key", "first_id")).alias("f")).select("f.*", "path").collect()]

    def run(batches):
        searcher = Searcher(files)
        for part in slices(batches):
            held = []
            for key, i in zip(*(c.to_pylist() for c in part.columns)):
                for found in searcher.find(key, i):
                    held += found
                    if len(held) >= BLOCK_LINES:
                        yield batch(held, names, kinds)
                        held = []
            yield batch(held, names, kinds)

    return asked.mapInArrow(run, CAPTURES)


class Lookup:
    """Finds captures of single URLs outside of jobs; holds the whole sparse directory. For many URLs take ``find``."""

    def __init__(self, directory: DataFrame):
        self.blocks = sorted(directory.select("first_key", "path", "start", "size").collect(), key=lambda r: r[0].encode("utf-8"))
        self.keys = [r[0].encode("utf-8") for r in self.blocks]

    def captures(self, url: str) -> list[tuple]:
        key = reversed_host_key(url)
        wanted = key.encode("utf-8")
        found = []
        # a key may begin in the block before the first one that starts with it
        k = max(bisect.bisect_left(self.keys, wanted) - 1, 0)
        while k < len(self.keys) and self.keys[k] <= wanted:
            lines = block_lines(*self.blocks[k][1:])
            keys = [line.split("\t", 1)[0].encode("utf-8") for line in lines]
            found += map(capture_of, lines[bisect.bisect_left(keys, wanted) : bisect.bisect_right(keys, wanted)])
            k += 1
        return found

    def record(self, capture: tuple) -> tuple[dict[str, str], bytes]:
        return parsed(zlib.decompress(range_of(*capture[3:]), 31))


def index_captures(directory: DataFrame) -> DataFrame:
    """All captures that the index blocks list."""

    def run(batches):
        for part in slices(batches, 16):
            for path, start, size in zip(*(c.to_pylist() for c in part.columns)):
                rows = [capture_of(line) for line in block_lines(path, start, size)]
                yield batch(rows, ["key", "page_id", "record_type", "path", "start", "size"], CAPTURE_KINDS)

    # directory rows are tiny, but each stands for a block of thousands of lines: tasks are counted in blocks
    blocks = directory.select("path", "start", "size")
    return blocks.repartition(tasks(directory.count(), TASK_BLOCKS), "path", "start").mapInArrow(run, CAPTURES)


def tasks(amount: int | None, of_task: int) -> int:
    return max(1, min(-(-(amount or 0) // of_task), MOST_TASKS))


def read(directory: DataFrame) -> DataFrame:
    """The ``records`` of all captures in the index."""
    return records(index_captures(directory))


def records(captures: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, digest (header) and payload of each record, by the captures' byte ranges.

    The ranges are dealt by file and read in file order, each file opened once in a task.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        file = at = None
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = ["page_id", "url", "record_type", "refers_to", "digest", "payload"]
        for part in slices(batches):
            rows = []
            for path, start, size in zip(*(c.to_pylist() for c in part.columns)):
                if path != at:
                    if file is not None:
                        file.close()
                    store, name = pafs.FileSystem.from_uri(path)
                    file, at = store.open_input_file(name), path
                file.seek(start)
                headers, payload = parsed(zlib.decompress(file.read(size), 31))
                rows.append((
                    page_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], headers["WARC-Type"],
                    page_of(headers.get("WARC-Refers-To")), headers["WARC-Payload-Digest"], payload,
                ))
            yield batch(rows, names, kinds)
        if file is not None:
            file.close()

    ranges = materialize(captures.select("path", "start", "size"), "ranges")
    # the rows are tiny, but stand for megabytes: tasks are counted in bytes, and a file's ranges are cut into stretches
    stretch = F.floor(F.col("start") / F.lit(TASK_BYTES))
    n = tasks(ranges.agg(F.sum("size")).first()[0], TASK_BYTES)
    ranges = ranges.repartition(n, "path", stretch).sortWithinPartitions("path", "start")
    return ranges.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, digest string, payload binary")
