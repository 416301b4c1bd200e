"""WARC archives compressed record by record with a shared Zstandard dictionary.

A dictionary is trained on a bounded sample of records, headers and all. Every archive file begins with a skippable frame that holds it;
each record is a Zstandard frame of its own, so any record can be read by its offset with the file's first frame
alone. Files are written by Spark, of FILE_VALUES values of about VALUE_BYTES each at most (a larger page makes a larger value); the separator
that its text writer puts after each value is itself an empty skippable frame, so a file is a plain sequence of frames in any store.

Of records with equal payloads of MIN_REVISIT bytes or more, the one with the smallest id is the response and the
others revisit it, with no payload of their own. Null html is an empty payload; null urls are written as an empty
target. Very long pages are single records. Rows that share an id keep a record each. Empty tables
give no rows. Columns other than the three are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import Scratch

MIN_REVISIT = 100
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: Of a file.
FILE_VALUES, VALUE_BYTES = 64, 1 << 20
#: The dictionary is trained on records of this many different payloads at most, those whose digests are smallest, and as many characters of each.
SAMPLE_RECORDS, SAMPLE_BYTES = 400, 16 << 10
#: Fixed values of the formats: magic numbers of skippable frames (of the dictionary, of separators), WARC's line end.
DICTIONARY_MAGIC, SEPARATOR = 0x184D2A5D, "P*M\x18\0\0\0\0"
END = b"\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def train(pages: DataFrame) -> bytes:
    """A dictionary; empty if there is too little to train on. Records are chosen by digest and id, and only their payloads are
    fetched: a limit over rows with payloads would bring those of every task to the driver. Copies count once."""
    import zstandard

    firsts = pages.where("payload_bytes > 0").groupBy("payload_digest").agg(F.min("page_id").alias("page_id"))
    chosen = {r[0] for r in firsts.orderBy("payload_digest").limit(SAMPLE_RECORDS).select("page_id").collect()}
    own = pages.where(F.col("page_id").isin(chosen)).dropDuplicates(["payload_digest"]) if chosen else pages.limit(0)
    rows = own.select("payload_digest", "page_id", "url", F.substring("html", 1, SAMPLE_BYTES)).collect()
    samples = [record(page, url, html.encode(), digest, None) for digest, page, url, html in sorted(rows, key=lambda r: r[0])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    headers = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>", "WARC-Date: 1970-01-01T00:00:00Z", "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url or ""),
        f"WARC-Page-ID: {page_id}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{refers_to}')}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    body = payload if refers_to is None else b""
    return "\r\n".join([*headers, f"Content-Length: {len(body)}"]).encode() + END + END + body + END + END


def _compressed(batches: Iterator[pa.RecordBatch], dictionary: bytes, value_bytes: int, file_values: int) -> Iterator[pa.RecordBatch]:
    """Values of about value_bytes; each one that begins a file has the dictionary's frame in front."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
    held, size, number = [head], 0, 0

    def value() -> pa.RecordBatch:
        nonlocal held, size, number
        out = pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
        number += 1
        held, size = [head] if number % file_values == 0 else [], 0
        return out

    for batch in batches:
        for row in zip(*(c for c in batch.columns), strict=True):
            page_id, url, html, digest, refers_to = (x.as_py() for x in row)
            held.append(packer.compress(record(page_id, url, (html or "").encode(), digest, refers_to)))
            size += len(held[-1])
            if size > value_bytes:
                yield value()
    if size:
        yield value()


def write_archives(pages: DataFrame, where: str, *, min_revisit: int = MIN_REVISIT, value_bytes: int = VALUE_BYTES, file_values: int = FILE_VALUES) -> None:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha2(payload, 256).alias("payload_digest"), F.length(payload).cast("long").alias("payload_bytes"))
    # Which pages revisit which is settled without their html; only the pointers are then joined, by the page's own id, so all copies of one
    # page do not meet in one task with their bodies.
    short = own.where(F.col("payload_bytes") >= min_revisit).select("page_id", "payload_digest")
    first = short.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("held")).where("held > 1").drop("held")
    pointers = short.join(first, "payload_digest").where("refers_to <> page_id").distinct()
    linked = own.join(pointers, ["page_id", "payload_digest"], "left").select("page_id", "url", "html", "payload_digest", "refers_to")
    dictionary = train(own)
    values = linked.mapInArrow(lambda batches: _compressed(batches, dictionary, value_bytes, file_values), "value binary").select(F.col("value").cast("string"))
    values.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", file_values).text(where)


def _frame_size(data: memoryview, at: int) -> int:
    """How many bytes the frame at this place takes, found from its own headers."""
    magic, size = struct.unpack_from("<II", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return 8 + size
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        head = data[end] | data[end + 1] << 8 | data[end + 2] << 16
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        end += 3 + (1 if kind == 1 else size)
        if last:
            return end + 4 * checksum - at


def read_records(data: bytes | memoryview) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, content) of every record of an archive."""
    import zstandard

    view, at = memoryview(data).cast("B"), 0
    opener = zstandard.ZstdDecompressor()
    while at < len(view):
        size = _frame_size(view, at)
        magic = struct.unpack_from("<I", view, at)[0]
        if magic == DICTIONARY_MAGIC:
            words = bytes(view[at + 8 : at + size])
            opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
        elif magic & 0xFFFFFFF0 != 0x184D2A50:
            raw = opener.decompress(view[at : at + size])
            head, _, rest = raw.partition(END + END)
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield at, headers, rest[: int(headers["Content-Length"])]
        at += size


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, content_ok boolean, file string, offset long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            columns: list[list] = [[] for _ in names]
            for offset, headers, body in read_records(content.as_buffer()):
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                whole = headers["WARC-Type"] == "response"
                measured = hashlib.sha256(body).hexdigest() if whole else digest
                refers = headers.get("WARC-Refers-To-Page-ID")
                row = (int(headers["WARC-Page-ID"]), len(body) if whole else int(headers["WARC-Payload-Length"]), measured, headers["WARC-Type"], None if refers is None else int(refers), measured == digest, file, offset)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, where: str) -> DataFrame:
    """Per record, from the files: what its headers and content say, the file and the offset in it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(where).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(_read, _READ)


def archived(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    where = Scratch(pages.sparkSession, "warc").place("archives")
    write_archives(pages, where)
    return read_archives(pages.sparkSession, where)
