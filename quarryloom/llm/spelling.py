"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by writing out every such neighbour.

The vocabulary is counted with partial sums, so a very frequent word is no hot task. Every word then gives its whole
neighbourhood over the alphabet that the vocabulary shows: each distinct deletion, replacement and insertion, about twice its length
times the alphabet, each once. Neighbours that are words meet the vocabulary in a hash join on the string itself; what joins is near by
construction, so no distance is ever computed. As nearness goes both ways, a neighbour carries the word (and its count) that gave it: grouped by
neighbour, with partial counts, the rows are already what each word needs of its near words.

Nearly all neighbours are no words. They are hashed in numpy and looked up in a Bloom filter of the vocabulary before any string is made
or shuffled. The filter passes every word, so the join decides and results do not hang on it. It takes 4 to 8 bytes a
word and at most FILTER_BYTES: a larger vocabulary is split by hash into several filters, one broadcast at a time, each
for its own share of the neighbours.

Null texts have no words; a null doc_id is written as nothing before the colon. Repeated rows count again. Empty tables give no
rows. A table may have any further columns. Words of any length are kept whole; a word's neighbours grow with its length times the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import Batches, Scratch
from .text import mix64

MIN_LENGTH, MIN_COUNT, FORM_TIMES = 7, 2, 10
LETTERS = "A-Za-zÀ-ÿ"
DAMAGED = 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The largest filter that is broadcast: a 64-bit cell for every one or two words.
FILTER_BYTES = 32 << 20
#: Cells in a segment of the filter, which is a row on its way to the driver.
SEGMENT = 1 << 13
#: Words whose neighbours are hashed at a time.
WORDS_AT_ONCE = 2048
#: Words of a task, which hashes about a thousand neighbours of each.
WORDS_A_TASK = 20_000
_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def damaged(doc_id: Column, word: Column) -> Column:
    """The word without one code point for one in 31 pairs of document and word, which the checksum of both picks."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    size = F.length(word)
    at = (h % size).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, size))
    return F.when(h % DAMAGED == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters of at least MIN_LENGTH code points, in small letters, that occur at least MIN_COUNT times."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))
    found = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    low = found.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    words = low.select(damaged(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def observed_alphabet(words: DataFrame) -> np.ndarray:
    """The code points of the vocabulary, sorted; as many as its alphabet has."""
    rows = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()
    return np.array(sorted(ord(r["c"]) for r in rows), np.uint32)


@dataclass(frozen=True)
class Hasher:
    """64-bit hashes of words and of their neighbours, these without writing them."""

    alphabet: np.ndarray

    def values(self) -> np.ndarray:
        return mix64((self.alphabet.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)

    def codes(self, words: list[str], length: int) -> np.ndarray:
        """Places in the alphabet, a row for each word of this length."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return np.searchsorted(self.alphabet, points).reshape(-1, length)

    @staticmethod
    def spread(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(32)
        x *= _SPREAD
        return x

    def of(self, codes: np.ndarray) -> np.ndarray:
        powers = _powers(codes.shape[1])
        return self.spread((self.values()[codes] * powers[: codes.shape[1]]).sum(axis=1, dtype=np.uint64))

    def neighbours(self, codes: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """(kind, place, hashes, valid): a hash for each word, and for replacements and insertions also for each letter, in columns.
        valid leaves each distinct neighbour once: of a run of equal letters the first is deleted, and a letter is inserted before no letter like it."""
        length, values = codes.shape[1], self.values()
        powers = _powers(length + 1)
        terms = values[codes] * powers[:length]
        before = np.zeros((len(codes), length + 1), np.uint64)
        np.cumsum(terms, axis=1, out=before[:, 1:], dtype=np.uint64)
        after = before[:, -1:] - before  # what stands from each place on
        back = np.uint64(pow(_BASE, -1, 1 << 64))
        for i in range(length):
            yield "delete", i, self.spread((before[:, i] + after[:, i + 1] * back)[:, None]), (np.ones(len(codes), bool) if i == 0 else codes[:, i] != codes[:, i - 1])[:, None]
        letters = np.arange(len(values))[None, :]
        for i in range(length):
            rest = before[:, i] + after[:, i + 1]
            yield "replace", i, self.spread(rest[:, None] + (values * powers[i])[None, :]), codes[:, i : i + 1] != letters
        for i in range(length + 1):
            rest = before[:, i] + after[:, i] * np.uint64(_BASE)
            valid = codes[:, i : i + 1] != letters if i < length else np.ones((len(codes), len(values)), bool)
            yield "insert", i, self.spread(rest[:, None] + (values * powers[i])[None, :]), valid


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def neighbour(word: str, kind: str, place: int, letter: str) -> str:
    return word[:place] + letter + word[place + (kind != "insert") :]


@dataclass(frozen=True)
class Filter:
    """A Bloom filter of four bits within one 64-bit cell. Of 2^parts filters this one takes the hashes of its own part."""

    cells_log2: int
    parts_log2: int

    @staticmethod
    def sized(n_words: int, most_bytes: int = FILTER_BYTES) -> Filter:
        cells = max(SEGMENT.bit_length() - 1, (max(n_words, 1) - 1).bit_length() - 1)
        most = max(SEGMENT.bit_length() - 1, (most_bytes // 8).bit_length() - 1)
        return Filter(min(cells, most), max(0, cells - most))

    def part(self, h: np.ndarray) -> np.ndarray:
        return h & np.uint64((1 << self.parts_log2) - 1)

    def cell(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.cells_log2)).astype(np.int64)

    @staticmethod
    def bit(h: np.ndarray, k: int) -> np.ndarray:
        """One of four bits, of hash bits that neither the part nor (below 2^28 cells) the cell is taken from."""
        return (h >> np.uint64(12 + 6 * k)) & np.uint64(63)

    def bits(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint64)
        for k in range(4):
            out |= np.uint64(1) << self.bit(h, k)
        return out

    def holds(self, cells: np.ndarray, part: int, h: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Flat places of the hashes that may be words. The first bit rules most out, so the others are looked up for few."""
        flat = h.ravel()
        maybe = ((cells[self.cell(flat)] >> self.bit(flat, 0)) & np.uint64(1)).astype(bool) & valid.ravel()
        if self.parts_log2:
            maybe &= self.part(flat) == part
        at = np.flatnonzero(maybe)
        few = flat[at]
        need = self.bits(few)
        return at[(cells[self.cell(few)] & need) == need]


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """Places of words of the same length, few at a time."""
    held: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        held.setdefault(len(w), []).append(i)
    for length, places in sorted(held.items()):
        for at in range(0, len(places), WORDS_AT_ONCE):
            yield length, places[at : at + WORDS_AT_ONCE]


def filter_cells(words: DataFrame, hasher: Hasher, shape: Filter, part: int) -> np.ndarray:
    """The filter of one part: made in segments by tasks, put together here."""

    def cells(batches: Batches) -> Batches:
        for batch in batches:
            listed = batch.column(0).to_pylist()
            for length, places in _by_length(listed):
                h = hasher.of(hasher.codes([listed[i] for i in places], length))
                h = h[shape.part(h) == part]
                cell = shape.cell(h)
                columns = [cell // SEGMENT, cell % SEGMENT, shape.bits(h).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["segment", "cell", "bits"])

    def segment(rows: pa.Table) -> pa.Table:
        out = np.zeros(SEGMENT, np.uint64)
        np.bitwise_or.at(out, rows["cell"].to_numpy(), rows["bits"].to_numpy().view(np.uint64))
        return pa.table({"segment": rows["segment"][:1], "cells": pa.array([out.tobytes()], pa.binary())})

    made = words.select("word").mapInArrow(cells, "segment long, cell long, bits long").groupBy("segment").applyInArrow(segment, "segment long, cells binary")
    out = np.zeros(1 << shape.cells_log2, np.uint64)
    for row in made.collect():  # at most FILTER_BYTES in all
        out[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(row["cells"], np.uint64)
    return out


def neighbours(words: DataFrame, hasher: Hasher, shape: Filter, part: int, cells) -> DataFrame:
    """word, near, near_n: every neighbour (word) of each word of the vocabulary (near) that this part's filter passes.

    words: word and n. cells: a broadcast of the filter."""

    def run(batches: Batches) -> Batches:
        held, letters = cells.value, [chr(c) for c in hasher.alphabet.tolist()]
        for batch in batches:
            listed, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for length, places in _by_length(listed):
                own = [listed[i] for i in places]
                found: list[str] = []
                sources: list[np.ndarray] = []
                for kind, place, h, valid in hasher.neighbours(hasher.codes(own, length)):
                    row, letter = np.divmod(shape.holds(held, part, h, valid), h.shape[1])
                    texts = [""] * len(row) if kind == "delete" else [letters[i] for i in letter.tolist()]
                    found += [neighbour(own[r], kind, place, x) for r, x in zip(row.tolist(), texts, strict=True)]
                    sources.append(row)
                source = np.array(places)[np.concatenate(sources)]
                columns = [pa.array(found, pa.string()), batch.column(0).take(pa.array(source)), pa.array(counts[source], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n"])

    return words.select("word", "n").mapInArrow(run, "word string, near string, near_n long")


def near_words(words: DataFrame, scratch: Scratch, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per word: word, n, n_near, and the near word of the largest n (best_n, best), the smallest by code points among equals."""
    spark = words.sparkSession
    hasher, n_words = Hasher(observed_alphabet(words)), words.count()
    shape = Filter.sized(n_words, most_bytes)
    dealt = words.repartition(max(spark.sparkContext.defaultParallelism, n_words // WORDS_A_TASK), "word")
    grouped = None
    for part in range(1 << shape.parts_log2):
        cells = spark.sparkContext.broadcast(filter_cells(words, hasher, shape, part))
        found = neighbours(dealt, hasher, shape, part, cells).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
        if shape.parts_log2:
            found = scratch.table(found, "near")
        grouped = found if grouped is None else grouped.unionByName(found)  # a word's neighbours all have its own hash: one part has them
    joined = words.join(grouped, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.least")).alias("best_n"), F.col("best.near").alias("best"))


def with_roots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows: word and form. Adds root, the end of the chain of forms. Each round doubles what a step of a chain spans; a form's count is several times
    its word's, so chains are short and a few rounds end them."""
    reach = scratch.table(rows.where("form is not null").select("word", F.col("form").alias("root")), "reach")
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = scratch.table(reach.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "reach")
        reach = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return rows.join(reach, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per word of the vocabulary: word, form, root, n, n_near, form_n."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.table(vocabulary(docs), "words")
    formed = F.col("best_n") >= FORM_TIMES * F.col("n")
    near = near_words(words, scratch, most_bytes).select("word", "n", "n_near", F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    return with_roots(scratch.table(near, "near_words"), scratch).select("word", "form", "root", "n", "n_near", "form_n")
