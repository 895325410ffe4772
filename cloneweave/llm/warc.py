"""Legacy archives to WARC.

``write_arc`` writes rows as ARC files, versions 1 and 2 by turns of the
files.  ``parse_arc`` streams an ARC file: the version block says how many
fields a record's header line has (5 or 10), and each record has the length
that its line declares.  ``to_warc`` gives every ARC record a WARC identifier
(a name-based UUID of its key), an ISO time from the 14 digits, a type and
SHA-256 digests; a record whose payload another one has in full becomes a
revisit of the one with the smallest key.  ``parse_warc`` reads WARC files.

Spark's text writer makes the files on any store it knows, gzipped, and with
its commit protocol: a record's last byte, a line feed, is the writer's line
separator.  Readers stream files through gzip and hold one record at a time.

Defined results: a null payload is empty; a null key is written empty and read
as null, and such a record revisits the smallest key of its payload if there
is one; rows that repeat the smallest key of a payload are all responses; a
null URL is ``urn:unknown``; extra columns aren't read; payloads may have any
length; an empty table gives no records.

A payload that very many records share is not joined by a shuffle: payloads of
more than 1/65,536 of all records, and of 65,536 at least, are fewer than 65,536
and are broadcast.  Short payloads, which need no join, are spread.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneweave.llm import blobs
from cloneweave.llm.common import fresh_path, staged

KEY = "X-Record-Key"
FIRST = "X-Refers-To-Key"
FIELDS = {1: 5, 2: 10}
NAMES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:archive-record")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    date: str = "20240101000000"
    least: int = 100  # bytes of a payload that can be revisited
    batch_bytes: int = 4 << 20
    hot: int = 1 << 16  # records of a payload, and payloads that are broadcast, at most
    records: int = 100_000  # of a WARC file at most


def http_block(key: str, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{KEY}: {key}\r\n\r\n".encode() + payload


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:]), payload


def arc_line(version: int, url: str, date: str, kind: str, length: int, digest: str = "-", offset: int = 0, name: str = "-") -> bytes:
    mid = ["200", digest, "-", str(offset), name] if version == 2 else []
    return (" ".join([url, "0.0.0.0", date, kind, *mid, str(length)]) + "\n").encode()


def write_arc(rows: DataFrame, key: str, url: str, payload: str, params: WarcParams | None = None) -> str:
    """Write key, url, payload as ARC files; returns their folder."""
    p, spark = params or WarcParams(), rows.sparkSession
    folder = fresh_path(spark, "arc")

    def build(batches):
        part, begun = TaskContext.get().partitionId(), False
        version = 1 + part % 2
        for b in batches:
            out = []
            for k, u, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not begun:
                    about = f"{version} 0 cloneweave\n{NAMES[version]}\n".encode()
                    out.append(arc_line(version, f"filedesc://part-{part}.arc", p.date, "text/plain", len(about)) + about)
                    begun = True
                data = (text or "").encode()
                block = http_block("" if k is None else str(k), data)
                u = "".join(f"%{ord(c):02X}" if c <= " " else c for c in u) if u else "urn:unknown"
                out.append(arc_line(version, u, p.date, "text/html", len(block), hashlib.sha256(data).hexdigest()) + block)
            yield pa.record_batch([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    rows.select(key, url, payload).mapInArrow(build, "value string").write.option("compression", "gzip").text(folder)
    return folder


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the folder's files; their content isn't read."""
    return spark.read.format("binaryFile").load(folder).select("path")


def parse_arc(read, line) -> Iterator[tuple[str, str, str, bytes]]:
    """(url, 14-digit date, content type, block) of each record, from read(n) and line() of a stream."""
    head = line().decode().rstrip("\n").split(" ")
    if head == [""]:  # a file without records
        return
    about = read(int(head[-1])).decode().split("\n")
    version = int(about[0].split(" ")[0])
    if about[1].count(" ") + 1 != FIELDS[version]:
        raise ValueError(f"ARC version {version} names {about[1]!r}")
    while (text := line()) != b"":
        if text == b"\n":
            continue
        part = text.decode().rstrip("\n").split(" ")
        if len(part) != FIELDS[version]:
            raise ValueError(f"ARC version {version} has a line of {len(part)} fields")
        block = read(int(part[-1]))
        if len(block) != int(part[-1]):
            raise ValueError("an ARC record ends early")
        yield part[0], part[2], part[3], block


def stream(path: str):
    system, at = blobs.opened(path)
    return gzip.open(system.open_input_stream(at, compression=None), "rb") if path.endswith(".gz") else system.open_input_stream(at)


def arc_records(paths: DataFrame, params: WarcParams | None = None, payloads: bool = True) -> DataFrame:
    """key, url, date, mime, digest, size and, if asked for, payload of every ARC record."""
    p = params or WarcParams()
    kinds = {"key": pa.string(), "url": pa.string(), "date": pa.string(), "mime": pa.string(), "digest": pa.string(), "size": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                with stream(path) as f:
                    for url, date, mime, block in parse_arc(f.read, f.readline):
                        head, payload = split_http(block)
                        row = (head.get(KEY) or None, url, date, mime, hashlib.sha256(payload).hexdigest(), len(payload))
                        rows.append((*row, payload) if payloads else row)
                        held += len(payload) if payloads else 200
                        if held >= p.batch_bytes:
                            yield _batch(rows, kinds)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds)

    names = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return paths.mapInArrow(run, ", ".join(f"{k} {names[t]}" for k, t in kinds.items()))


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


def record_id(key: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, key if key is not None else 'null ' + digest)}>"


def warc_record(kind: str, record: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its last line feed."""
    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    head = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", iso), *fields, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r"


def to_warc(spark: SparkSession, arc_folder: str, params: WarcParams | None = None) -> str:
    """Convert a folder of ARC files; returns the folder of WARC files.  Keys are compared as numbers where they are."""
    p = params or WarcParams()
    paths = files(spark, arc_folder)
    number = F.expr("try_cast(key as bigint)")
    first = F.min(F.when(F.col("key").isNotNull(), F.struct(number, F.col("key")))).alias("first")
    twins = arc_records(paths, p, False).filter(F.col("size") >= p.least).groupBy(F.col("digest").alias("_digest")).agg(first, F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twins = staged(twins.select("_digest", F.col("first.key").alias("refers"), "_n"), "twins")
    most = max(p.hot, int(twins.agg(F.sum("_n")).first()[0] or 0) // p.hot)
    often, others = (twins.filter(x).drop("_n") for x in (F.col("_n") > most, F.col("_n") <= most))
    often = often.withColumnsRenamed({"_digest": "_often", "refers": "_first"})  # fewer than ``hot`` rows
    rows = arc_records(paths, p).join(F.broadcast(often), (F.col("digest") == F.col("_often")) & (F.col("size") >= p.least), "left")
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64("key", "url", "digest"), F.lit(1 << 20)))  # is no digest
    rows = rows.withColumn("_at", F.when(F.col("_often").isNull() & (F.col("size") >= p.least), F.col("digest")).otherwise(spread))
    rows = rows.join(others, F.col("_at") == F.col("_digest"), "left").withColumn("refers", F.coalesce("_first", "refers"))
    folder = fresh_path(spark, "warc")

    def build(batches):
        begun = False
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not begun:
                    about = b"software: cloneweave\r\nformat: WARC File Format 1.1\r\n"
                    out.append(warc_record("warcinfo", f"<urn:uuid:{uuid.uuid5(SPACE, f'info {TaskContext.get().partitionId()}')}>", p.date, [("Content-Type", "application/warc-fields")], about))
                    begun = True
                again = r["refers"] is not None and r["refers"] != r["key"]
                block = http_block(r["key"] or "", r["payload"])
                fields = [("WARC-Target-URI", r["url"]), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha256:" + r["digest"])]
                if again:
                    block = block[: len(block) - len(r["payload"])]
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(r["refers"], r["digest"])), (FIRST, r["refers"])]
                out.append(warc_record("revisit" if again else "response", record_id(r["key"], r["digest"]), r["date"], fields, block))
            yield pa.record_batch([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    rows.select("key", "url", "date", "digest", "payload", "refers").mapInArrow(build, "value string").write.option("compression", "gzip").option("maxRecordsPerFile", p.records).text(folder)
    return folder


def parse_warc(read, line) -> Iterator[tuple[dict[str, str], bytes]]:
    while (text := line()) != b"":
        if not text.strip():
            continue
        if not text.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (text := line()) not in (b"\r\n", b""):
            k, _, v = text.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        block = read(int(head["Content-Length"]))
        if "sha256:" + hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"]:
            raise ValueError("a WARC block doesn't have its digest")
        yield head, block


def warc_records(paths: DataFrame) -> DataFrame:
    """key, record_type, payload_bytes, payload_digest, record_id, refers_id, refers_key of every response and revisit."""
    kinds = {"key": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_id": pa.string(), "refers_id": pa.string(), "refers_key": pa.string()}

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with stream(path) as f:
                    for head, block in parse_warc(f.read, f.readline):
                        if head["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, payload = split_http(block)
                        digest = head["WARC-Payload-Digest"].partition(":")[2]
                        if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError("a payload doesn't have its digest")
                        rows.append((http.get(KEY) or None, head["WARC-Type"], int(http["Content-Length"]), digest, head["WARC-Record-ID"], head.get("WARC-Refers-To"), head.get(FIRST)))
                        if len(rows) == 4096:
                            yield _batch(rows, kinds)
                            rows = []
                if rows:
                    yield _batch(rows, kinds)

    return paths.mapInArrow(run, ", ".join(f"{k} {'long' if t == pa.int64() else 'string'}" for k, t in kinds.items()))
