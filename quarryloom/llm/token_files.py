"""Token-id files of patched frame-of-reference blocks.

Documents in ascending order of their ids are encoded, each with an end id, and packed into frames. A frame
holds whole documents; its ids are cut into blocks of BLOCK. Of each block the minimum is subtracted, the width
is chosen so that PERCENTILE of its values fit, and the high bits of the others go to an exception list; the
starts of all blocks are indexed, so that any range of ids can be read without the rest. Files are written by
Spark, in order, so they can be in any store and are committed as a whole; a byte that ends the writer's record follows
each frame. A file holds FILE_FRAMES frames at most, each of about a megabyte (a longer document makes a longer
frame), so files stay small however large a partition is.

Null and empty texts have the end id alone. Duplicate ids keep every row, in the order of their texts; null ids come first.
Empty tables give no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import Scratch
from .tokens import default_path, encoder

BLOCK, LANES = 1024, 32
PERCENTILE = 0.95
FILE_FRAMES = 64
_HEAD = struct.Struct("<4sIIIQQ")
_MAGIC = b"QPF1"


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value takes."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def encode_frame(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    count = -(-len(ids) // BLOCK)
    padded = np.empty(count * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    blocks = padded.reshape(count, BLOCK)
    least = blocks.min(axis=1) if count else np.empty(0, np.uint32)
    values = blocks - least[:, None]
    at = min(BLOCK - 1, int(PERCENTILE * BLOCK))
    widths = _widths(np.partition(values, at, axis=1)[:, at]) if count else np.empty(0, np.uint8)
    high = values >> np.minimum(widths, 31)[:, None].astype(np.uint32)
    high[widths == 32] = 0
    where = np.flatnonzero(high)
    exceptions = np.bincount(where // BLOCK, minlength=count).astype(np.uint16)
    starts = np.concatenate([[0], np.cumsum(widths.astype(np.int64) * LANES)])
    packed = np.zeros(int(starts[-1]), np.uint32)
    for width in np.unique(widths):
        w = int(width)
        if not w:
            continue
        mine = np.flatnonzero(widths == width)
        low = (values[mine] & np.uint32((1 << w) - 1)).reshape(len(mine), 32, LANES)
        out = np.zeros((len(mine), w, LANES), np.uint32)
        for i in range(32):
            word, shift = divmod(i * w, 32)
            out[:, word] |= low[:, i] << np.uint32(shift)
            if shift + w > 32:
                out[:, word + 1] |= low[:, i] >> np.uint32(32 - shift)
        packed[(starts[mine][:, None] + np.arange(w * LANES)).ravel()] = out.ravel()
    body = b"".join(
        [
            doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), least.astype("<u4").tobytes(), widths.tobytes(), exceptions.astype("<u2").tobytes(), (starts[:-1] * 4).astype("<u8").tobytes(),
            packed.astype("<u4").tobytes(), (where % BLOCK).astype("<u2").tobytes(), high.ravel()[where].astype("<u4").tobytes(),
        ]
    )
    return _HEAD.pack(_MAGIC, len(doc_ids), count, len(where), len(ids), len(body)) + body


class Frame:
    """A frame at a place in a file."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        magic, docs, count, patched, self.n_ids, size = _HEAD.unpack_from(data, at)
        if magic != _MAGIC:
            raise ValueError("not a frame")
        self.count, self.end = count, at + _HEAD.size + size
        place = at + _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(data, kind, n, place)
            place += out.nbytes
            return out

        self.doc_ids, self.lengths = take("<i8", docs), take("<u8", docs).astype(np.int64)
        self.least, self.widths, exceptions, self.starts = take("<u4", count), take("<u1", count), take("<u2", count), take("<u8", count).astype(np.int64) // 4
        self.packed = take("<u4", int(self.widths.sum(dtype=np.int64)) * LANES)
        self.patch_at, self.patch = take("<u2", patched), take("<u4", patched)
        self.patch_starts = np.concatenate([[0], np.cumsum(exceptions.astype(np.int64))])

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Values of blocks [first, last), found by the index of their starts."""
        out = np.zeros((last - first, BLOCK), np.uint32)
        widths = self.widths[first:last]
        for width in np.unique(widths):
            w = int(width)
            if not w:
                continue
            mine = np.flatnonzero(widths == width)
            words = self.packed[(self.starts[first:last][mine][:, None] + np.arange(w * LANES)).ravel()].reshape(len(mine), w, LANES)
            values, mask = np.empty((len(mine), 32, LANES), np.uint32), np.uint32((1 << w) - 1)
            for i in range(32):
                word, shift = divmod(i * w, 32)
                part = words[:, word] >> np.uint32(shift)
                if shift + w > 32:
                    part |= words[:, word + 1] << np.uint32(32 - shift)
                values[:, i] = part & mask
            out[mine] = values.reshape(len(mine), BLOCK)
        low, high = self.patch_starts[first], self.patch_starts[last]
        rows = np.repeat(np.arange(last - first), np.diff(self.patch_starts[first : last + 1]))
        out[rows, self.patch_at[low:high]] |= self.patch[low:high] << np.minimum(widths[rows], 31).astype(np.uint32)
        return out + self.least[first:last, None]

    def ids(self, low: int, high: int) -> np.ndarray:
        first, last = low // BLOCK, -(-high // BLOCK)
        return self.blocks(first, last).ravel()[low - first * BLOCK : high - first * BLOCK]


def frames(data: bytes) -> Iterator[Frame]:
    at, view = 0, memoryview(data)
    while at < len(data):
        frame = Frame(view, at)
        yield frame
        at = frame.end + 1


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, all their token ids (with the end ids) and each one's number of them, for a chunk of rows at a time."""
    encode = encoder(path).encode
    for batch in batches:
        docs = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        for first, last, ids, counts in encode(batch.column(1)):
            yield docs[first:last], ids, counts


def _framed(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for docs, ids, counts in encoded(batches, path):
        yield pa.RecordBatch.from_arrays([pa.array([encode_frame(docs, counts, ids)], pa.binary())], names=["frame"])


def write_token_files(docs: DataFrame, where: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    path = tokenizer or default_path()
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda batches: _framed(batches, path), "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_FRAMES).text(where)


def _unframed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            before = 0
            for number, frame in enumerate(frames(content.as_buffer())):
                ids = frame.ids(0, frame.n_ids).astype("<u4", copy=False)
                ends = np.cumsum(frame.lengths)
                starts = ends - frame.lengths
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.array([number] * n, pa.int32()), pa.array(frame.doc_ids), pa.array(starts + before), pa.array(frame.lengths), pa.array(sums, pa.int64())],
                    names=["file", "frame", "doc_id", "within", "n_tokens", "ids_crc32"],
                )
                before += frame.n_ids


def read_token_files(spark: SparkSession, where: str, scratch: Scratch) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file, frame."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(where).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = scratch.table(files.mapInArrow(_unframed, "file string, frame int, doc_id long, within long, n_tokens long, ids_crc32 long"), "read")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    # Names are part-<partition>-<job>-c<file of the partition>: numbers, so that part-100000 comes after part-99999.
    partition, number = (F.regexp_extract("file", pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)"))
    base = F.coalesce(F.sum("total").over(Window.orderBy(partition, number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(totals.select("file", base.alias("base")), "file").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "file", "frame")


def token_files(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    scratch = Scratch(docs.sparkSession, "token-files")
    where = scratch.place("files")
    write_token_files(docs, where, tokenizer=tokenizer)
    return read_token_files(docs.sparkSession, where, scratch)
