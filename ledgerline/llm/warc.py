"""Archives of web pages: WARC 1.1 records, compressed one by one against a Zstandard dictionary of their own archive.

A task writes one archive. It holds records until they suffice to build a dictionary, writes the dictionary as a skippable
frame in front, then each record as a frame of its own; so any record can be read with nothing but its frame and the head of
the file. Of equal payloads one record holds the content and the others revisit it. A file's name is new in each attempt, and
the list of archives is written by Spark with the tasks' results, so what lost or repeated attempts leave behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, ids, longs, spread_join

#: Payloads of fewer bytes are stored whenever they come.
REVISIT_BYTES = 1000
#: Groups of equal payloads, of some 64 bytes each, whose list may be broadcast.
BROADCAST_GROUPS = 1 << 18
#: The largest dictionary; records of a hundred times its bytes are held to build one of a hundredth of theirs.
DICTIONARY_BYTES = 1 << 16
#: Fixed values of the formats: the skippable frame of a dictionary, a frame, the profile of revisits.
DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f0a2f0e-30a5-4c39-9d52-6cf7c5e0d7b1")
MANIFEST = "archive string, n_records long, n_bytes long, dictionary_bytes long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
CHUNK = 1 << 16


def _judged(pages: DataFrame, revisit_bytes: int, broadcast_groups: int) -> DataFrame:
    """page_id, url, payload, and for payloads of a group of equal ones ``grouped`` and ``response_id``, the page that holds the content."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    large, sha = F.octet_length("payload") >= revisit_bytes, F.unhex(F.sha2("payload", 256))
    sizes = rows.filter(large).groupBy(sha.alias("sha")).agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).withColumn("grouped", F.col("n") > 1)
    groups, keyed = cut(sizes.filter("grouped")), rows.withColumn("sha", F.when(large, sha))
    if groups.count() <= broadcast_groups:
        return keyed.join(F.broadcast(groups), "sha", "left").drop("sha", "n")
    met = spread_join(keyed.filter("sha is not null"), cut(sizes), ["sha"], "n").drop("sha", "n")
    return met.unionByName(keyed.filter("sha is null").drop("sha").withColumns({"response_id": F.lit(None).cast("long"), "grouped": F.lit(False)}))


def _record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest.hex()}')}>"


def _record(kind: str, record_id: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    named = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named) + "\r\n").encode() + block + b"\r\n\r\n"


def _page(page_id: int | None, url: str | None, payload: bytes, response_id: int | None, grouped: bool, date: str) -> bytes:
    digest = hashlib.sha1(payload).digest()
    fields = [("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:  # a control character or a space would end the field or the record's head
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not grouped or page_id == response_id:
        return _record("response", _record_id(page_id, digest), date, fields, block + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(response_id, digest)), ("Refers-To-Page-ID", str(response_id))]
    return _record("revisit", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'revisit:{page_id}:{digest.hex()}')}>", date, fields, block)


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of a hundredth of the records' bytes; none where they are too few or too short for one."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, records)) // 100), records)
    except (zstandard.ZstdError, ValueError):
        return None


def _archiver(folder: str, date: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "response_id", "grouped")), strict=True))
        records = (_page(*x, date) for x in rows)
        held, size = [], 0
        for record in records:
            held.append(record)
            size += len(record)
            if size >= 100 * DICTIONARY_BYTES:
                break
        if not held:
            return
        name, dictionary = f"{uuid.uuid4().hex}.warc.zst", _dictionary(held)
        filesystem, path = fs.FileSystem.from_uri(folder)
        made = zstandard.ZstdCompressor(level=level, write_checksum=True, **({"dict_data": dictionary} if dictionary else {}))
        n = 0
        with filesystem.open_output_stream(f"{path}/{name}", compression=None) as out:
            if dictionary:
                packed = zstandard.compress(dictionary.as_bytes(), 19)
                out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
            out.write(made.compress(_record("warcinfo", f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>", date, [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
            for part in (held, records):
                for record in part:
                    out.write(made.compress(record))
                    n += 1
                held = None
            written = out.tell()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([written], pa.int64()), pa.array([len(dictionary.as_bytes()) if dictionary else 0], pa.int64())], names=["archive", "n_records", "n_bytes", "dictionary_bytes"])

    return write


def write_warc(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z", level: int = 3, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Writes a record for each row of ``pages`` to new archives in ``folder``, and returns the list of them, one for each partition that has rows.

    ``folder`` must be new and shared by all executors, at a URI that pyarrow opens; the list is also there, as Parquet in
    ``manifest``. The payload is the html in UTF-8, a null one is empty. Of records with equal payloads of ``revisit_bytes`` or
    more, that with the largest page_id is the response and the others are revisits that refer to it; rows that repeat this
    page_id are responses too, and a null page_id is the smallest. A null page_id or url leaves its field out; control
    characters and spaces in a url are percent-encoded. An empty table gives an empty list; other columns are ignored. An
    archive whose records are too few to build a dictionary of has none.
    """
    bound_batches(pages.sparkSession)
    filesystem, path = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)
    made = _judged(pages, revisit_bytes, broadcast_groups).select("page_id", "url", "payload", "response_id", F.coalesce("grouped", F.lit(False)).alias("grouped"))
    made.mapInArrow(_archiver(folder, date, level), MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records_of(source) -> Iterator[bytes]:
    """The records of an archive that is open for reading, one at a time."""
    data, how = source.read(8), {}
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
        content, data = source.read(struct.unpack("<I", data[4:])[0]), b""
        if struct.unpack("<I", content[:4])[0] == FRAME:
            content = zstandard.decompress(content)
        how = {"dict_data": zstandard.ZstdCompressionDict(content)}
    reader = zstandard.ZstdDecompressor(**how)
    frame, parts = None, []
    while data or (data := source.read(CHUNK)):
        frame = frame or reader.decompressobj()
        parts.append(frame.decompress(data))
        data = b""
        if frame.eof:
            yield b"".join(parts)
            data, frame, parts = frame.unused_data, None, []
    if frame:
        raise ValueError("the archive ends within a record")


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parsed(record: bytes) -> tuple | None:
    """A page's record as page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload; None for records of other kinds."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: the block's length isn't the one that is stated")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(_fields(http)["Content-Length"])
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't the one that was archived")
    number = lambda name: int(fields[name]) if fields.get(name, "None") != "None" else None
    return number("Page-ID"), fields.get("WARC-Target-URI"), kind, n, digest, number("Refers-To-Page-ID"), payload if kind == "response" else None


def _reader(with_payload: bool):
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        page_id, url, kind, n, digest, refers, payload = zip(*rows, strict=True)
        columns = [pa.array(page_id, pa.int64()), *(pa.array(c, t) for c, t in zip((url, kind, n, digest), kinds, strict=True)), pa.array(refers, pa.int64())]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
        return pa.RecordBatch.from_arrays(columns + [pa.array(payload, pa.binary())] * with_payload, names=names + ["payload"] * with_payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive, n in ((a, n) for b in batches for a, n in zip(b.column("archive").to_pylist(), b.column("n_records").to_pylist(), strict=True)):
            filesystem, path = fs.FileSystem.from_uri(archive)
            rows, size, seen = [], 0, 0
            with filesystem.open_input_stream(path, compression=None) as source:
                for row in filter(None, map(parsed, records_of(source))):
                    seen += 1
                    rows.append(row if with_payload else (*row[:6], None))
                    size += len(row[6] or b"") * with_payload + 200
                    if size >= 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)
            if seen != n:
                raise ValueError(f"{archive} holds {seen} records, not {n}")

    return read


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives listed in ``folder``: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, ``with_payload``, payload.

    An archive is read by one task, a record at a time. Digests are lowercase hex; a response's payload is held against its
    digest, and an archive against its number of records. A revisit's payload is null, its size and digest are the full payload's.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    each = manifest.select("archive", "n_records").repartition(max(manifest.count(), 1))
    return each.mapInArrow(_reader(with_payload), RECORDS + ", payload binary" * with_payload)
