"""What each filter of a chain removes, in every order of the filters, from counts by the mask of failed filters.

A document's mask has a bit for each filter that it fails. Which documents an order keeps or removes depends on the mask alone, so
a part of the corpus is its histogram of at most 2^n masks, with further rows for histograms of labelled documents. Histograms are stacked and multiplied by
integer incidence matrices with a row for each mask and a column for each order and step: five filters give 32 by 600. The four
matrices say whether a mask is kept after the step, removed at it, redundant there (it fails the filter but has gone earlier) or
unique (it fails that filter only). Counting is one aggregation over the corpus with partial sums, so that a hot source is no hot
task; what follows is bounded by the number of parts.

Null texts are empty, null sources the part ''. Repeated texts fail filter E unless their doc_id is the smallest or null, also
rows that repeat a doc_id with the same text as one that is smaller elsewhere; rows of the smallest doc_id itself do not fail. Labels of a repeated
doc_id count if any row has them; rows with a null doc_id have none. Empty tables give no rows. Columns beyond doc_id, text and source are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import Batches, Scratch

LETTERS = "ABCDE"
WORDS = r"[^\x20\x09-\x0D]+"
OUTCOMES = ("kept", "removed", "redundant", "unique")
#: Parts whose outcomes are in memory at a time.
PARTS_AT_ONCE = 64


def orders(n: int) -> np.ndarray:
    """All orders of n filters, a row each, in lexical order."""
    return np.array(list(permutations(range(n))), np.int64).reshape(-1, n)


def incidence(n: int) -> dict[str, np.ndarray]:
    """By outcome, a 0/1 matrix with a row for each mask of n filters and a column for each order and step."""
    steps = np.left_shift(1, orders(n))  # the step's filter as a bit
    earlier = (np.cumsum(steps, axis=1) - steps).ravel()[None, :]
    own = steps.ravel()[None, :]
    mask = np.arange(1 << n)[:, None]
    fails, gone = (mask & own) > 0, (mask & earlier) > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": np.broadcast_to(mask, fails.shape) == own}
    return {name: matrix.astype(np.int64) for name, matrix in found.items()}


def histograms(rows: DataFrame, n: int) -> DataFrame:
    """rows: part, mask, and 0/1 columns good and toxic. Per part its masks and their counts, at most 2^n of them."""
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def outcomes(counted: DataFrame, letters: str) -> DataFrame:
    """Histograms times incidence matrices: a row for each part, order and step."""
    n = len(letters)
    names = ["part", "filter_order", "step", *OUTCOMES[:3], "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Batches) -> Batches:
        matrix, every = incidence(n), orders(n)
        filters = every.ravel()
        by_filter = np.zeros((len(filters), n), np.int64)  # sums a filter's steps over all orders
        by_filter[np.arange(len(filters)), filters] = 1
        order_names = np.repeat(["".join(letters[i] for i in order) for order in every], n)
        steps = np.tile(np.arange(1, n + 1), len(every))
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                parts = batch.column(0).slice(at, PARTS_AT_ONCE)
                cells = batch.column(1).slice(at, PARTS_AT_ONCE)
                row = np.repeat(np.arange(len(parts)), np.diff(cells.offsets.to_numpy()))
                flat = cells.flatten()
                mask, *counts = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                stacked = np.zeros((3, len(parts), 1 << n), np.int64)
                for held, count in zip(stacked, counts, strict=True):
                    np.add.at(held, (row, mask), count)
                every_doc, good, toxic = stacked
                removed = every_doc @ matrix["removed"]
                shapley = (removed @ by_filter)[:, filters]
                columns = [every_doc @ matrix["kept"], removed, every_doc @ matrix["redundant"], every_doc @ matrix["unique"], good @ matrix["removed"], toxic @ matrix["removed"], shapley]
                yield pa.RecordBatch.from_arrays(
                    [
                        parts.take(pa.array(np.repeat(np.arange(len(parts)), len(filters)))),
                        pa.array(np.tile(order_names, len(parts)), pa.string()),
                        pa.array(np.tile(steps, len(parts)), pa.int32()),
                        *(pa.array(c.ravel(), pa.int64()) for c in columns),
                    ],
                    names=names,
                )

    counts = ", ".join(f"{c} long" for c in names[3:])
    return counted.select("part", "cells").mapInArrow(run, f"part string, filter_order string, step int, {counts}")


def _bit(fails: Column, letter: str) -> Column:
    return F.when(fails, 1 << LETTERS.index(letter)).otherwise(0)


def text_masks(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, part, the bits of the filters that look at its own text, and the text's digest."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)).alias("words"))
    counted = own.select("doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("different"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    mask = (
        _bit(F.col("n") < 50, "A")
        + _bit(100 * F.col("different").cast("long") < 65 * F.col("n").cast("long"), "B")
        + _bit(100 * capitals.cast("long") > 5 * F.length("text").cast("long"), "C")
        + _bit(F.col("text").rlike(r"[#$%&*|]"), "D")
    )
    return counted.select("doc_id", "part", mask.alias("own_mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: part, mask of all five filters, and whether it is labelled good and toxic. Narrow rows of numbers and a digest are
    written once; joins are by a document's id, so copies of one text do not meet."""
    scratch = Scratch(docs.sparkSession, "filter-audit")
    rows = scratch.table(text_masks(docs), "masks")
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = rows.where("doc_id is not null").join(firsts.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    known = named.select("part", (F.col("own_mask") + _bit(F.col("first").isNull(), "E")).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    unnamed = rows.where("doc_id is null").select("part", F.col("own_mask").alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return known.unionByName(unnamed)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over all documents, in all 120 orders."""
    return outcomes(histograms(masks(docs, labels), len(LETTERS)), LETTERS)
