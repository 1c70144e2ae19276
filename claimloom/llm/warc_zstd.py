"""WARC archives with a shared Zstandard dictionary.

A dictionary is trained on a bounded sample of records and embedded in a skippable
frame that leads every archive; each record is one frame of its own, so a reader can
start at any record. Archives are written to the session's shared folder, one for
each task's partition under a name of that attempt alone, and each task returns the
index of what it wrote; a task that runs again writes a new file and a new index, and
files that no index names are ignored. Records with equal payloads of at least
``revisit_bytes`` bytes have one response, of the smallest id; the others are revisits
that refer to it. Their digests are grouped before the shuffle. Reading deals the index
by stretches of an archive, so one archive keeps as many tasks busy as it has stretches.

Defined results: null html is an empty payload. A null id is archived like any other
but is a response only if all ids of its payload are null. Repeated rows of the
smallest id are responses all, and being one capture they share its record id. An empty
table writes no archive. Bodies of any length are kept whole. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.plans.staging import new_path, stage

#: Fixed by the format: the magic number of the leading skippable frame.
DICT_MAGIC = 0x184D2A5D
INDEX = "page_id long, archive string, offset long, length long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Spark's names for what Arrow calls s3.
_SCHEME = re.compile("^s3[an]:")
#: A field of ours: the address, as JSON, where it holds line ends.
RAW_URL = "WARC-Page-URL-JSON"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The id of the record of a page with a payload; whoever knows both can refer to it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _opened(where: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a place, by the name that Spark or Arrow has for its scheme."""
    return pyarrow.fs.FileSystem.from_uri(_SCHEME.sub("s3:", where))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head alone."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    digest = digest32(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # as it is; one that no header line can hold has its line ends encoded there and stands whole in a field of ours
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
        if "\r" in url or "\n" in url:
            lines.append(f"{RAW_URL}: {json.dumps(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_of(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """Records of an uncompressed WARC stream as rows of ``READ``; lengths and digests are verified."""
    while first := stream.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = {}
        while line := stream.readline().strip(b"\r\n"):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            fields[name.lower()] = value
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends early")
        head, _, payload = block.partition(b"\r\n\r\n")
        told = int(head.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response" and (len(payload) != told or digest32(payload) != digest):
            raise ValueError("a payload doesn't match its digest")
        page, refers, url = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id"), fields.get("warc-target-uri")
        if raw := fields.get(RAW_URL.lower()):
            url = json.loads(raw)
        yield (
            int(page) if page else None, url, told, digest, fields["warc-type"],
            int(refers) if refers else None, payload if fields["warc-type"] == "response" else None,
        )


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of sample records; their bytes themselves where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def with_revisits(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, refers_to)``: each page's payload and, for revisits, the response's id."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    firsts = (
        pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("first_sha"))
        .groupBy("first_sha")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    joined = rows.join(firsts, F.col("sha") == F.col("first_sha"), "left")
    again = (F.octet_length("payload") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, dictionary: bytes, date: str, level: int = 3) -> DataFrame:
    """Archives ``rows`` (see :func:`with_revisits`) under ``folder``; the index of what was written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        trained = _dictionary(dictionary)
        packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
        out, offset, where = None, 0, f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        try:
            for batch in batches:
                index: dict[str, list] = {"page_id": [], "archive": [], "offset": [], "length": []}
                for page_id, url, payload, refers_to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")]):
                    if out is None:
                        files, path = _opened(where)
                        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = files.open_output_stream(path, compression=None)
                        out.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
                        offset = 8 + len(dictionary)
                    frame = packer.compress(record(page_id, url, payload, refers_to, date))
                    out.write(frame)
                    for name, value in zip(index, (page_id, where, offset, len(frame))):
                        index[name].append(value)
                    offset += len(frame)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(index.values(), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], list(index))
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(write, INDEX)


def read_archives(index: DataFrame, payloads: bool = True, stretch: int = 4 << 20) -> DataFrame:
    """Every record that ``index`` names, as ``READ``; each ``stretch`` bytes of an archive are read by one task, in order."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in READ.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw, unpack, held, weight = None, None, None, [], 0
        try:
            for batch in batches:
                for where, offset, length in zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length")]):
                    if where != now:
                        if raw is not None:
                            raw.close()
                        files, path = _opened(where)
                        now, raw = where, files.open_input_file(path)
                        magic, size = struct.unpack("<II", raw.read(8))
                        if magic != DICT_MAGIC:
                            raise ValueError(f"{where} has no leading dictionary frame")
                        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw.read(size)))
                    raw.seek(offset)
                    for found in records_of(io.BytesIO(unpack.decompress(raw.read(length)))):
                        held.append(found if payloads else (*found[:6], None))
                        weight += found[2] if payloads else 100
                    if weight > 8 << 20:
                        yield rows(held)
                        held, weight = [], 0
            yield rows(held)
        finally:
            if raw is not None:
                raw.close()

    places = index.select("archive", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / stretch))
    dealt = places.repartition(n, "archive", "stretch").sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "length").mapInArrow(read, READ)


def sample_records(pages: DataFrame, most: int, most_bytes: int, date: str) -> list[bytes]:
    """Records of at most ``most`` ids, by a hash of them, and ``most_bytes`` of payload; the ids are chosen before any payload moves."""
    ids = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    cut = pages.select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, most_bytes // 4).alias("html"))
    # one row an id, so what is fetched is bounded however often an id is repeated
    chosen = cut.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min(F.struct("html", "url")).alias("r"))
    rows = sorted(chosen.select("page_id", "r.url", "r.html").collect())
    return [record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), None, date) for r in rows]


def archive_pages(pages: DataFrame, folder: str | None = None, revisit_bytes: int = 0, dictionary_bytes: int = 64 << 10, sampled: int = 256, sample_bytes: int = 32 << 10, date: str = "2024-03-01T00:00:00Z") -> DataFrame:
    """Writes all ``pages`` and returns the written index (``INDEX``).

    The dictionary is trained on at most ``sampled`` records of ``sample_bytes`` of
    payload each, which bounds what reaches the driver.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    dictionary = train_dictionary(sample_records(pages, sampled, sample_bytes, date), dictionary_bytes)
    return stage(write_archives(with_revisits(pages, revisit_bytes), folder, dictionary, date), "warc-index").df


def op8_warc_zstd(spark, sf_dir: str) -> DataFrame:
    index = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), revisit_bytes=0)
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as s from pages),
bits as (select *, array_to_string(list_transform(string_split(s, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][position(c in '0123456789abcdef')]), '') as b from p),
named as (select page_id, strlen(h) as n, min(page_id) over (partition by s) as head,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: cast(substr(b, 5 * i + j + 1, 1) as integer) * cast(pow(2, 4 - j) as integer)))::integer, 1)), '') as digest from bits)
select page_id, n as payload_bytes, digest as payload_digest, case when page_id = head then 'response' else 'revisit' end as record_type, case when page_id <> head then head end as refers_to from named
"""
