"""An exact round trip, and archives that another reader of frames can use."""

import base64
import hashlib
import re
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from claimloom.llm import warc_zstd as wz


def pages():
    out = [(i, f"http://x/{i}", f"<html>page {i} é" + "<p>body</p>" * (i % 50)) for i in range(120)]
    out += [(200 + i, "http://y/\r\n%", "<p>same</p>" * 3) for i in range(20)] + [(150, None, None), (151, "u", ""), (3, "again", out[3][2]), (400, "u", "x" * 500_000), (None, "n", out[5][2]), (500, "http://a/b%20c?d=%25&e=%0D", "z")]
    return out


def stored(where):
    """The bytes of an archive as they are on disk."""
    with open(where.removeprefix("file://"), "rb") as f:
        return f.read()


def want(rows, least):
    body = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        again = len(b) >= least and first.get(b) is not None and i != first[b]
        out.append((i, u, len(b), digest, "revisit" if again else "response", first[b] if again else None, None if again else b))
    assert body
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, tmp_path, least):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    index = wz.archive_pages(df, folder=f"file://{tmp_path}/warc", revisit_bytes=least)
    got = [(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in wz.read_archives(index).collect()]
    assert sorted(got, key=str) == want(rows, least)
    # any record can be read alone
    one = index.where("page_id = 7").first()
    data = stored(one["archive"])
    magic, size = struct.unpack("<II", data[:8])
    assert magic == wz.DICT_MAGIC
    frame = data[one["offset"] : one["offset"] + one["length"]]
    assert b"WARC-Page-ID: 7\r\n" in zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompress(frame)


def test_archive_as_a_stream(spark, tmp_path):
    """A reader that knows nothing of the index gets all records of an archive, each with an id and revisits with their response's."""
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    index = wz.archive_pages(df, folder=f"file://{tmp_path}/warc")
    ids, refers, addresses, n = set(), set(), set(), 0
    for (where,) in index.select("archive").distinct().collect():
        data = stored(where)
        size = struct.unpack("<II", data[:8])[1]
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        text = unpack.stream_reader(data, read_across_frames=True).read()
        n += text.count(b"WARC/1.1\r\n")
        ids |= set(re.findall(rb"WARC-Record-ID: (\S+)", text))
        refers |= set(re.findall(rb"WARC-Refers-To: (\S+)", text))
        addresses |= set(re.findall(rb"WARC-Target-URI: ([^\r]*)\r\n", text))
    assert n == len(pages()) and refers and refers < ids
    # addresses stand as they are; line ends alone, which no header can hold, are encoded
    assert {b"http://a/b%20c?d=%25&e=%0D", b"http://x/7", b"http://y/%0D%0A%"} < addresses
    # an archive is dealt in stretches
    assert wz.read_archives(index, stretch=2_000).select(F.spark_partition_id()).distinct().count() > 4


def test_repeated_id_bounds_the_sample(spark):
    df = spark.createDataFrame([(5, f"u{i}", "x" * i) for i in range(300)] + [(6, None, None)], "page_id long, url string, html string")
    assert len(wz.sample_records(df, 10, 100, "2024-03-01T00:00:00Z")) == 2


def test_empty(spark):
    assert wz.read_archives(wz.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
