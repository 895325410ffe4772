"""Media columns: payloads stored as images in archives, read by a Spark data source.

Writing: each task streams its rows into one tar archive (a member a row) and
an offset sidecar, under names of its own attempt, and returns what it wrote;
a manifest in the folder lists the archives of finished tasks.

Reading: the data source ``archive_members`` plans byte ranges over the
manifest's archives; a range owns the members whose headers start in it.  A
range is read member by member through Arrow batches of bounded bytes; a
member that fails is read again by its offset, alone, a given number of times.

An image is a PNG of 8-bit grey samples, 64 a row, and a text chunk with the
payload's length before padding, so the same bytes give the same file.

Defined results: a null text is empty; an empty payload is one row of zeros;
a null id stays null; repeated rows are separate members with equal media; an
empty table gives no members; extra columns aren't read.  A member whose image
is damaged gives a row of nulls but for its id, the stored form's size and
digest, and ``damaged`` with the reason as its feature.  A range is read into
memory at once, so a task holds ``rangeBytes`` and one member more.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cloneweave.llm import blobs
from cloneweave.llm.common import fresh_path, staged

ROW = 64
BLOCK = 512
MANIFEST = "_manifest.json"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEMBERS = "archive string, offset long, member string, content binary"


def padded(data: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of ROW."""
    return data + bytes(max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def encode_png(data: bytes, level: int = 1) -> bytes:
    body = np.frombuffer(padded(data), dtype=np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(body), ROW + 1), dtype=np.uint8)  # filter type 0 before each line
    lines[:, 1:] = body
    head = ROW.to_bytes(4, "big") + len(body).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\x00%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """The samples, and the length before padding; raises if a chunk is damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, n, width = 8, [], 0, 0
    while at < len(media):
        size, kind = int.from_bytes(media[at : at + 4], "big"), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(media[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            width = int.from_bytes(body[:4], "big")
        elif kind == b"tEXt":
            n = int(body.partition(b"\x00")[2])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter type that this reader doesn't know")
    return lines[:, 1:].tobytes(), n


def feature(samples: bytes) -> str:
    """Rows, mean and deviation of the samples, and a 64-bit hash of which columns are above the mean."""
    x = np.frombuffer(samples, dtype=np.uint8).reshape(-1, ROW)
    mean, columns = float(x.mean()), x.mean(0)
    return f"{len(x)}:{mean:.4f}:{float(x.std()):.4f}:{int.from_bytes(np.packbits(columns > mean).tobytes(), 'big'):016x}"


def tar_header(name: str, size: int) -> bytes:
    """A ustar header; sizes from 8 GiB on take the base-256 form."""
    digits = b"%011o\x00" % size if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    head = bytearray(BLOCK)
    for at, field in ((0, name.encode()[:100]), (100, b"0000644\x00"), (108, b"0000000\x00"), (116, b"0000000\x00"), (124, digits), (136, b"00000000000\x00"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(field)] = field
    head[148:156] = b"%06o\x00 " % sum(head)
    return bytes(head)


def tar_size(head: bytes) -> tuple[str, int]:
    """Name and size of a member from its header; raises if the header's sum doesn't hold."""
    total = sum(head) - sum(head[148:156]) + 8 * 32
    if len(head) < BLOCK or not head[148:154].isdigit() or int(head[148:154], 8) != total:
        raise ValueError("not a member header")
    field = head[124:136]
    size = int.from_bytes(field[1:], "big") if field[0] == 0x80 else int(field.rstrip(b"\x00 "), 8)
    return head[:100].rstrip(b"\x00").decode(), size


def write_archives(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write one member a row; returns the folder, whose manifest lists the finished archives."""
    spark = documents.sparkSession
    folder = fresh_path(spark, "media")

    def write(batches):
        part, at, offsets, name, out = TaskContext.get().partitionId(), 0, [], None, None
        try:
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if out is None:
                        name = blobs.attempt_name(folder, part, ".tar")
                        out = blobs.writer(name)
                    media = encode_png((text or "").encode())
                    block = tar_header(f"{'null' if key is None else key}.png", len(media)) + media + bytes(-len(media) % BLOCK)
                    out.write(block)
                    offsets.append(at)
                    at += len(block)
            if out is not None:
                out.write(bytes(2 * BLOCK))
        finally:
            if out is not None:
                out.close()
        if name:
            with blobs.writer(name + ".idx") as f:
                f.write(np.array(offsets, dtype="<i8").tobytes())
            yield pa.record_batch([pa.array([name]), pa.array([at], pa.int64()), pa.array([len(offsets)], pa.int64())], ["archive", "bytes", "members"])

    done = staged(documents.select(F.col(id_col), F.col(text_col)).mapInArrow(write, "archive string, bytes long, members long"), "archives")
    entries = [r.asDict() for r in done.orderBy("archive").collect()]  # a row an archive
    with blobs.writer(f"{folder}/{MANIFEST}") as f:
        f.write(json.dumps(entries).encode())
    return folder


class ByteRange(InputPartition):
    def __init__(self, archive: str, begin: int, end: int, size: int):
        self.archive, self.begin, self.end, self.size = archive, begin, end, size


class ArchiveMembers(DataSource):
    """Options: path (folder), rangeBytes, batchBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.range_bytes, self.batch_bytes, self.retries = (int(options.get(k, v)) for k, v in (("rangeBytes", 16 << 20), ("batchBytes", 4 << 20), ("retries", 3)))

    def partitions(self) -> list[ByteRange]:
        system, path = blobs.opened(f"{self.path}/{MANIFEST}")
        with system.open_input_stream(path) as f:
            entries = json.loads(f.read())
        return [ByteRange(e["archive"], a, min(a + self.range_bytes, e["bytes"]), e["bytes"]) for e in entries for a in range(0, e["bytes"], self.range_bytes)]

    def read(self, part: ByteRange | None):
        if part is None:  # what Spark passes where there is no partition
            return
        system, path = blobs.opened(part.archive)
        with system.open_input_stream(path + ".idx") as f:
            offsets = np.frombuffer(f.read(), dtype="<i8")
        first, last = np.searchsorted(offsets, part.begin), np.searchsorted(offsets, part.end)
        mine = offsets[first:last]
        if not len(mine):
            return
        after = int(offsets[last]) if last < len(offsets) else part.size
        block = self.block(system, path, int(mine[0]), after)
        rows, size = [], 0
        for at in map(int, mine):
            found = self.within(block, at - int(mine[0]))
            rows.append((part.archive, at, *(found or self.member(system, path, at))))
            size += len(rows[-1][3])
            if size >= self.batch_bytes:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def block(self, system, path: str, begin: int, end: int) -> bytes:
        """The bytes of a range of members; empty if they can't be read, so that each is tried alone."""
        try:
            with self.handle(system, path) as f:
                f.seek(begin)
                return f.read(end - begin)
        except OSError:
            return b""

    @staticmethod
    def within(block: bytes, at: int) -> tuple[str, bytes] | None:
        """Name and content of a member in a block, None if it isn't there whole."""
        try:
            name, size = tar_size(block[at : at + BLOCK])
        except ValueError:
            return None
        content = block[at + BLOCK : at + BLOCK + size]
        return (name, content) if len(content) == size else None

    def member(self, system, path: str, at: int) -> tuple[str, bytes]:
        """Name and content of the member at an offset, tried again alone when reading or its header fails."""
        for left in range(self.retries, -1, -1):
            try:
                with self.handle(system, path) as f:
                    f.seek(at)
                    name, size = tar_size(f.read(BLOCK))
                    content = f.read(size)
                    if len(content) < size:
                        raise OSError("the archive ends within a member")
                    return name, content
            except (OSError, ValueError):
                if not left:
                    raise
        raise AssertionError

    def handle(self, system, path: str):
        return system.open_input_file(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    a, o, m, c = zip(*rows)
    return pa.record_batch([pa.array(a, pa.string()), pa.array(o, pa.int64()), pa.array(m, pa.string()), pa.array(c, pa.binary())], ["archive", "offset", "member", "content"])


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    reader = spark.read.format("archive_members")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(folder)


def features(members: DataFrame) -> DataFrame:
    """The digest columns of every member, from its stored bytes."""

    def run(batches):
        for b in batches:
            rows = []
            for name, media in zip(b.column("member").to_pylist(), b.column("content").to_pylist()):
                key = name.rpartition(".")[0]
                try:
                    samples, n = decode_png(media)
                except (ValueError, zlib.error) as e:
                    rows.append((None if key == "null" else int(key), None, None, None, None, len(media), hashlib.sha256(media).hexdigest(), f"damaged: {e}"))
                    continue
                rows.append((None if key == "null" else int(key), n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    return members.select("member", "content").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
