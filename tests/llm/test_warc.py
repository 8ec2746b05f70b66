"""Archives written and read again."""

import hashlib
import os
import random
import struct
from collections import Counter

import pytest
import zstandard

from ledgerline.llm import warc

PAGES = "page_id long, url string, html string, payload string, sha int, n int"
rng = random.Random(5)
PROSE = [f"<p class='entry'>{' '.join(rng.choice(['alpha', 'beta', 'gamma', 'delta']) for _ in range(60))}</p>" for _ in range(200)]
LONG = "é" * 499 + "xy"  # 1,000 bytes
ROWS = [
    (1, "https://a.example/ä b\r\nWARC-Type: metadata", LONG), (7, "https://b.example/", LONG), (3, None, LONG), (7, "again", LONG), (None, "https://c.example/", LONG), (None, None, None),
    (2, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (8, "u", LONG[1:] + "z"), (9, "u", "WARC/1.1\r\n\r\n\r\n" * 200_000), (10, "u", "\r\n\r\n" * 300), (11, "u", "\r\n\r\n" * 300),
]
ROWS += [(100 + k, "u", x) for k, x in enumerate(PROSE)]


def expected(rows):
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    out = Counter()
    for page, payload in payloads:
        group = [p for p, x in payloads if x == payload]
        top = max((p for p in group if p is not None), default=None)
        again = len(payload) >= 1000 and page != top
        out[page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", top if again else None, None if again else payload] += 1
    return out


@pytest.mark.parametrize("broadcast_groups", [1 << 18, 0])
def test_archives_hold_every_page_once(spark, tmp_path, broadcast_groups):
    pages = spark.createDataFrame([(*r, "x", 1, 2) for r in ROWS], PAGES).repartition(3)
    listed = warc.write_warc(pages, str(tmp_path / "archives"), broadcast_groups=broadcast_groups).collect()
    found = warc.read_warc(spark, str(tmp_path / "archives"), with_payload=True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in found) == expected(ROWS)
    assert sum(r.n_records for r in listed) == len(ROWS)
    assert {r.url for r in found} >= {None, "https://a.example/ä%20b%0D%0AWARC-Type:%20metadata"}


def test_each_record_is_a_frame_behind_the_dictionary(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", x) for k, x in enumerate(PROSE)], "page_id long, url string, html string").coalesce(1)
    (one,) = warc.write_warc(pages, str(tmp_path / "archives")).collect()
    data = open(one.archive, "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and one.dictionary_bytes > 0 and len(data) == one.n_bytes
    dictionary = zstandard.ZstdCompressionDict(zstandard.decompress(data[8 : 8 + size]))
    reader, rest, records = zstandard.ZstdDecompressor(dict_data=dictionary), data[8 + size :], []
    while rest:
        frame = reader.decompressobj()
        records.append(frame.decompress(rest))
        rest = frame.unused_data
    assert len(records) == 201 and b"WARC-Type: warcinfo" in records[0] and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    plain = sum(len(zstandard.compress(r)) for r in records)
    assert len(data) < 0.8 * plain


def test_torn_and_altered_archives_are_refused(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", x) for k, x in enumerate(PROSE)], "page_id long, url string, html string").coalesce(1)
    (one,) = warc.write_warc(pages, str(tmp_path / "archives")).collect()
    data = open(one.archive, "rb").read()
    os.truncate(one.archive, len(data) - 20)
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_warc(spark, str(tmp_path / "archives")).count()
    with pytest.raises(ValueError, match="isn't the one"):
        warc.parsed(warc._page(1, "u", b"payload", None, False, "d").replace(b"payload\r\n", b"pay1oad\r\n"))


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert warc.write_warc(none, str(tmp_path / "archives")).count() == 0
    assert warc.read_warc(spark, str(tmp_path / "archives")).count() == 0
