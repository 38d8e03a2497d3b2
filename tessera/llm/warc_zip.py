"""WARC records in ZIP-packaged archives, read by range without extraction.

An archive is a ZIP file whose members are stored: ``archive/data.warc.gz`` (one
gzip member per record) and ``indexes/index.cdx`` (key, offset and length of
each record).  The reader parses the end-of-directory record, its ZIP64 form and
the central directory, finds where members begin from their local headers, reads
the index, and then only the byte ranges of the records.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.runtime import small_batches

#: Payloads from this size on are stored once and revisited by their copies.
REVISIT_BYTES = 100
#: Bytes of compressed records after which a task begins another archive.
ARCHIVE_BYTES = 16 << 20
#: Records that one reading task takes from an archive at a time.
RANGE_RECORDS = 200
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
BIG = 0xFFFFFFFF


# ---------------------------------------------------------------- ZIP

def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ZIP64 where sizes need it or ``zip64`` is set."""
    out, directory = io.BytesIO(), io.BytesIO()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), out.tell()
        wide = zip64 or len(data) >= BIG or at >= BIG
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = BIG if wide else len(data)
        out.write(struct.pack("<4s5H3I2H", b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        out.write(data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        directory.write(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, BIG if wide else at) + raw + extra)
    at, n, listed = out.tell(), len(members), directory.getvalue()
    out.write(listed)
    wide = zip64 or at >= BIG or n >= 0xFFFF
    if wide:
        end = out.tell()
        out.write(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(listed), at))
        out.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
    out.write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF if wide else n, 0xFFFF if wide else n, BIG if wide else len(listed), BIG if wide else at, 0))
    return out.getvalue()


def members(f: BinaryIO, size: int) -> dict[str, tuple[int, int]]:
    """Name to (start of data, length) of every stored member, from the directories alone."""
    tail_at = max(0, size - 65_557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    _, _, _, n, length, start = struct.unpack_from("<4H2I", tail, at + 4)
    if 0xFFFF in (n,) or BIG in (length, start):
        if at < 20 or tail[at - 20 : at - 16] != b"PK\6\7":
            raise ValueError("ZIP64 locator is missing")
        f.seek(struct.unpack_from("<Q", tail, at - 12)[0])
        wide = f.read(56)
        if wide[:4] != b"PK\6\6":
            raise ValueError("ZIP64 end of central directory is missing")
        n, length, start = struct.unpack_from("<3Q", wide, 32)
    f.seek(start)
    listed, at, out = f.read(length), 0, {}
    for _ in range(n):
        if listed[at : at + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", listed, at + 10)[0]
        packed, plain, name_n, extra_n, note_n = struct.unpack_from("<2I3H", listed, at + 20)
        local = struct.unpack_from("<I", listed, at + 42)[0]
        name = listed[at + 46 : at + 46 + name_n].decode()
        extra, e = listed[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while e + 4 <= len(extra):
            kind, m = struct.unpack_from("<2H", extra, e)
            if kind == 1:  # the wide fields, in this order, of those that are all ones
                values = iter(struct.unpack_from(f"<{m // 8}Q", extra, e + 4))
                plain = next(values) if plain == BIG else plain
                packed = next(values) if packed == BIG else packed
                local = next(values) if local == BIG else local
            e += 4 + m
        at += 46 + name_n + extra_n + note_n
        if method == 0:
            f.seek(local)
            head = f.read(30)
            if head[:4] != b"PK\3\4":
                raise ValueError("damaged local header")
            out[name] = (local + 30 + sum(struct.unpack_from("<2H", head, 26)), packed)
    return out


# ---------------------------------------------------------------- WARC

def record(key: str, url: str, kind: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record as a gzip member; a revisit has no payload."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{key}>"), ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        block = b""
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def marked(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of every row.

    Of equal payloads of at least REVISIT_BYTES bytes the smallest page_id is the
    response (all rows that carry it, if it repeats); null ids sort last."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    copies = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(copies, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return rows.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``marked`` as archives below ``folder`` (a URI that all executors share).

    Returns a lazy table of archive URI, bytes and records.  A task names its
    archives by its partition and attempt and renames each into place when complete: an attempt that runs again or beside another, and may get
    its rows in another order, touches no archive of the other, and only those of the attempt that counts are listed.  Null addresses are written as empty ones, null and
    empty payloads as empty records; rows may repeat; other columns are ignored; an empty table gives no archives."""
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("archive_bytes", T.LongType()), T.StructField("records", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        data, index, number, done = io.BytesIO(), [], 0, []

        def close() -> None:
            nonlocal data, index, number
            if not index:
                return
            name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.wacz"
            whole = zip_bytes([("datapackage.json", json.dumps({"profile": "data-package", "records": len(index)}).encode()), (DATA, data.getvalue()), (INDEX, "".join(index).encode())])
            spare = f"{root}/.{name}"
            with fs.open_output_stream(spare) as f:
                f.write(whole)
            fs.move(spare, f"{root}/{name}")
            done.append((f"{folder}/{name}", len(whole), len(index)))
            data, index, number = io.BytesIO(), [], number + 1

        for batch in batches:
            for r in batch.to_pylist():
                key = "" if r["page_id"] is None else str(r["page_id"])
                member = record(key, r["url"], r["record_type"], r["digest"], r["payload"].encode(), None if r["refers_to"] is None else str(r["refers_to"]))
                index.append(f"{key} {data.tell()} {len(member)}\n")
                data.write(member)
                if data.tell() >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=schema.names)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def locate_records(archives: DataFrame) -> DataFrame:
    """Byte ranges of the records of each archive, in blocks: archive, starts, lengths.

    An archive without records gives no rows, as does an empty table; archives that are listed twice are read twice."""
    schema = "archive string, starts array<long>, lengths array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, at = _open(uri)
                with fs.open_input_file(at) as f:
                    found = members(f, f.size())
                    f.seek(found[INDEX][0])
                    lines = f.read(found[INDEX][1]).decode().splitlines()
                spots = [tuple(map(int, x.rsplit(" ", 2)[1:])) for x in lines]
                for i in range(0, len(spots), RANGE_RECORDS):
                    block = spots[i : i + RANGE_RECORDS]
                    yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([[found[DATA][0] + a for a, _ in block]], pa.list_(pa.int64())), pa.array([[n for _, n in block]], pa.list_(pa.int64()))], names=["archive", "starts", "lengths"])

    return archives.select("archive").mapInArrow(run, schema)


def read_records(ranges: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the records of the ranges: page_id (text), record_type, refers_to (text),
    payload_bytes, payload_digest, and the payload if asked for (null for a revisit).

    A response whose payload doesn't have its digest raises an error.  Ids and what they refer to are null where the record
    names none; an empty table gives no rows."""
    import hashlib

    schema = T.StructType([T.StructField(n, t) for n, t in (("page_key", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_key", T.StringType()), *[("payload", T.BinaryType())] * with_payload)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, at = _open(r["archive"])
                cols: list[list] = [[], [], [], [], [], []]
                with fs.open_input_file(at) as f:
                    for start, n in zip(r["starts"], r["lengths"]):
                        f.seek(start)
                        fields, payload = parse_record(f.read(n))
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].partition(":")[2]
                        size = int(fields["X-Payload-Length"])
                        if kind == "response":
                            digest, size, stated = hashlib.sha256(payload).hexdigest(), len(payload), digest
                            if digest != stated:
                                raise ValueError(f"payload digest differs in {r['archive']} at {start}")
                        key = fields["WARC-Record-ID"][10:-1]
                        refers = fields.get("WARC-Refers-To")
                        for c, v in zip(cols, (key or None, size, digest, kind, refers and refers[10:-1], payload if kind == "response" else None)):
                            c.append(v)
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays[: len(schema.names)], names=schema.names)

    return ranges.mapInArrow(run, schema)
