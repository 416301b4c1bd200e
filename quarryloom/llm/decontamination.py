"""Benchmark decontamination with suffix arrays over the training text.

Training documents are gathered, in a task, to shards of up to SHARD_SUFFIXES suffixes. Each shard gets a suffix array
of word suffixes, and every suffix of the benchmark is binary-searched in it: its neighbours there say how long its longest
verbatim match is, and where. Where that is a whole window (or a whole shorter item), all the window's occurrences stand
side by side in the array. Of matches that begin nowhere further to the left the whole length is measured, so each
document gets its longest one, with its place in the document and in the item.

The array is sparse without losing matches: a training suffix is kept only if it begins with a benchmark word and with as many
as can be a match (MIN_MATCH, or a shorter item). Suffixes are ordered by their first DEPTH words; a match that is longer
than that is extended word by word.

The benchmark goes to the tasks in blocks of at most ``block_words`` words; with several blocks the
documents are searched once for each, and hits are united per document afterwards.

Null or empty text: no words, no hits, an empty list of items. Repeated benchmark rows each count as items. Rows with null or
repeated ids keep a row each. Empty tables give no rows. Columns of the documents other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Scratch, beside, small_batches
from .text import ALPHANUMERIC, Words, WordScanner

WINDOW = 10
DEPTH = 32
BLOCK_WORDS = 1_000_000
#: Matches of fewer words are not looked for, unless a whole item is shorter.
MIN_MATCH = 5
#: A shard is closed at so many suffixes or words; their keys take 128 bytes each.
SHARD_SUFFIXES, SHARD_WORDS = 1 << 18, 1 << 22
#: Pairs of a test suffix and a place are made so many at a time.
PAIRS = 1 << 20

SCHEMA = "doc_id long, n_words long, hit_from array<long>, hit_to array<long>, items array<long>, longest_match long, match_at long, match_item long, match_item_at long"
LONGEST = "item_id long, longest_match long, item_at long, doc_id long, match_at long"


class TestSuffixes:
    """The benchmark's words as numbers, its windows, and its sorted suffixes."""

    __test__ = False

    def __init__(self, item_ids: list[int], texts: list[str | None], window: int = WINDOW):
        self.window, self.item_ids = window, np.array(item_ids, np.int64)
        hashes, lengths = [], []
        for words in WordScanner(ALPHANUMERIC).scan(pa.array(texts, pa.string())):
            hashes.append(words.hashes)
            lengths.extend(words.counts.tolist())
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        counts = np.array(lengths, np.int64)
        self.vocabulary = np.unique(flat)
        #: Words of all items one after another; of each word, its item, and where that begins and ends.
        self.flat = (np.searchsorted(self.vocabulary, flat) + 1).astype(np.uint32)
        n = len(self.flat)
        self.item = np.repeat(np.arange(len(counts)), counts)
        self.ends = np.cumsum(counts)[self.item] if n else np.empty(0, np.int64)
        self.starts = self.ends - counts[self.item] if n else np.empty(0, np.int64)
        #: Words of the window that begins at each suffix; 0 where too few are left for one.
        left = self.ends - np.arange(n)
        width = np.minimum(counts, window)[self.item] if n else left
        self.width = np.where(left >= width, width, 0)
        self.suffixes = np.zeros((n, DEPTH), ">u4")
        for i in range(DEPTH):
            more = np.flatnonzero(left > i)
            self.suffixes[more, i] = self.flat[more + i]
        # A training suffix can only match if as many benchmark words follow as the shortest match that its word begins.
        self.need = np.full(len(self.vocabulary) + 1, MIN_MATCH, np.int64)
        short = np.flatnonzero((self.width > 0) & (self.width < MIN_MATCH))
        np.minimum.at(self.need, self.flat[short], self.width[short])
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number in the benchmark's vocabulary, 0 for others."""
        out = np.zeros(len(hashes), np.uint32)
        if len(self.vocabulary):
            some = np.flatnonzero(self.filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.searchsorted(self.vocabulary, hashes[some])
            at[at == len(self.vocabulary)] = 0
            known = self.vocabulary[at] == hashes[some]
            out[some[known]] = at[known] + 1
        return out


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings that sort in the same order."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{rows.shape[1] * 4}").ravel() if len(rows) else np.empty(0, f"S{rows.shape[1] * 4}")


def _runs_right(numbers: np.ndarray, row_ends: np.ndarray) -> np.ndarray:
    """How many benchmark words in a row, within the document, begin at each word."""
    n = len(numbers)
    stop = np.where(numbers == 0, np.arange(n), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    return np.minimum(stop, row_ends) - np.arange(n)


class Shard:
    """Training words one after another, and their suffix array. tests.numbers() of the words; of each the end of its document."""

    def __init__(self, tests: TestSuffixes, numbers: np.ndarray, run: np.ndarray):
        self.tests, self.numbers, self.run = tests, numbers, run
        at = np.flatnonzero((numbers > 0) & (run >= tests.need[numbers]))
        suffixes = np.zeros((len(at), DEPTH), ">u4")
        for i in range(DEPTH):
            more = np.flatnonzero(run[at] > i)
            suffixes[more, i] = numbers[at[more] + i]
        keys = as_keys(suffixes)
        order = np.argsort(keys, kind="stable")
        self.array, self.keys, self.suffixes = at[order], keys[order], suffixes[order]

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every test suffix, by binary search: how many words of it are found (DEPTH at most), and a place in the array."""
        n = len(self.tests.flat)
        most, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not len(self.array):
            return most, place
        for low in range(0, n, 1 << 16):
            own = self.tests.suffixes[low : low + (1 << 16)]
            beside_ = np.searchsorted(self.keys, as_keys(own))
            for near in (beside_ - 1, beside_):
                near = np.clip(near, 0, len(self.array) - 1)
                same = np.cumprod((own == self.suffixes[near]) & (own > 0), axis=1).sum(axis=1)
                better = same > most[low : low + len(own)]
                most[low : low + len(own)][better] = same[better]
                place[low : low + len(own)][better] = near[better]
        return most, place

    def occurrences(self, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(test suffix, place among the words) of every occurrence of a whole window, PAIRS at a time (or those of one suffix)."""
        tests = self.tests
        found = np.flatnonzero((tests.width > 0) & (most >= tests.width))
        yield from self.places(found, tests.width[found])

    def places(self, found: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(test suffix, place among the words) of all places that share so many first words (DEPTH at most) with each, PAIRS at a time."""
        if not len(found):
            return
        low = np.zeros((len(found), DEPTH), ">u4")
        inside = np.arange(DEPTH)[None, :] < width[:, None]
        low[inside] = self.tests.suffixes[found][inside]
        high = np.where(inside, low, np.uint32(0xFFFFFFFF)).astype(">u4")
        first, last = np.searchsorted(self.keys, as_keys(low), "left"), np.searchsorted(self.keys, as_keys(high), "right")
        total = np.concatenate([[0], np.cumsum(last - first)])
        a = 0
        while a < len(found):
            b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
            counts = (last - first)[a:b]
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield np.repeat(found[a:b], counts), self.array[np.repeat(first[a:b], counts) + inner]
            a = b

    def extended(self, suffix: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """How many words the test suffixes and the places have in common, known being so already."""
        common, limit = known.copy(), np.minimum(self.tests.ends[suffix] - suffix, self.run[at])
        open_ = np.flatnonzero(common < limit)
        while len(open_):
            same = self.tests.flat[suffix[open_] + common[open_]] == self.numbers[at[open_] + common[open_]]
            open_ = open_[same]
            common[open_] += 1
            open_ = open_[common[open_] < limit[open_]]
        return common


def _shards(batches: Iterator[pa.RecordBatch], tests: TestSuffixes) -> Iterator[tuple[pa.Array, np.ndarray, Shard]]:
    """Document ids, where each one's words begin (one entry more), and the shard of their words; rows in their order."""
    ids: list[pa.Array] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    suffixes = words_held = 0

    def close() -> tuple[pa.Array, np.ndarray, Shard]:
        counts = np.concatenate([c for c, _, _ in held])
        shard = Shard(tests, np.concatenate([n for _, n, _ in held]), np.concatenate([r for _, _, r in held]))
        return pa.concat_arrays(ids), np.concatenate([[0], np.cumsum(counts)]), shard

    scanner = WordScanner(ALPHANUMERIC)
    for batch in batches:
        for words in scanner.scan(batch.column(1)):
            numbers = tests.numbers(words.hashes)
            run = _runs_right(numbers, words.ends())
            ids.append(batch.column(0).slice(words.first, words.last - words.first).cast(pa.int64()))
            held.append((words.counts, numbers, run))
            suffixes += int(((numbers > 0) & (run >= tests.need[numbers])).sum())
            words_held += len(numbers)
            if suffixes >= SHARD_SUFFIXES or words_held >= SHARD_WORDS:
                yield close()
                ids, held, suffixes, words_held = [], [], 0, 0
    if ids:
        yield close()


def _united(rows: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each row that do not overlap or touch, in order."""
    order = np.lexsort((begins, rows))
    rows, begins, ends = rows[order], begins[order], ends[order]
    if not len(rows):
        return rows, begins, ends
    step = int(ends.max()) + 1
    reach = np.maximum.accumulate(ends + rows * step)
    new = np.ones(len(rows), bool)
    new[1:] = begins[1:] + rows[1:] * step > reach[:-1]
    new[1:] |= rows[1:] != rows[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return rows[first], begins[first], reach[last] - rows[first] * step


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """values of ascending rows as n lists."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int64)))


def _search_batches(batches: Iterator[pa.RecordBatch], tests: TestSuffixes) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    none = np.empty(0, np.int64)
    for ids, bounds, shard in _shards(batches, tests):
        n = len(ids)
        stretches, items = [(none, none, none)], [np.empty((0, 2), np.int64)]
        best = np.zeros((n, 4), np.int64)
        best[:, 1:] = -1
        for suffix, at in shard.occurrences(shard.longest()[0]):
            row = np.searchsorted(bounds, at, side="right") - 1
            begin = at - bounds[row]
            stretches.append(_united(row, begin, begin + tests.width[suffix]))
            items.append(np.unique(np.stack([row, tests.item[suffix]], axis=1), axis=0))
            # Matches that could begin further to the left are parts of others.
            before = np.where((suffix > tests.starts[suffix]) & (begin > 0), tests.flat[suffix - 1], 0)
            leftmost = np.flatnonzero((before == 0) | (before != shard.numbers[at - 1]))
            suffix, at, row = suffix[leftmost], at[leftmost], row[leftmost]
            common = shard.extended(suffix, at, tests.width[suffix])
            order = np.lexsort((suffix, at, -common, row))
            order = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
            mine = np.stack([common, at - bounds[row], suffix - tests.starts[suffix], tests.item[suffix]], axis=1)[order]
            better = mine[:, 0] > best[row[order], 0]
            best[row[order][better]] = mine[better]
        rows, begins, ends = _united(*(np.concatenate(x) for x in zip(*stretches, strict=True)))
        pairs = np.concatenate(items)
        pairs[:, 1] = tests.item_ids[pairs[:, 1]] if len(pairs) else pairs[:, 1]
        pairs = np.unique(pairs, axis=0)
        item = pa.array(tests.item_ids[best[:, 3]] if len(tests.item_ids) else best[:, 3], mask=best[:, 0] == 0)
        columns = [ids, pa.array(np.diff(bounds)), _lists(rows, begins, n), _lists(rows, ends, n), _lists(pairs[:, 0], pairs[:, 1], n), pa.array(best[:, 0]), pa.array(best[:, 1]), item, pa.array(best[:, 2])]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _longest_batches(batches: Iterator[pa.RecordBatch], tests: TestSuffixes) -> Iterator[pa.RecordBatch]:
    """Of each item with a match in a shard, its longest one there."""
    for ids, bounds, shard in _shards(batches, tests):
        most, place = shard.longest()
        found = np.flatnonzero((most > 0) & (most >= np.minimum(tests.ends - tests.starts, MIN_MATCH)))
        at = np.zeros(len(most), np.int64)
        at[found] = shard.array[place[found]]
        deep = found[most[found] == DEPTH]  # further words decide between the places that share these
        for suffix, where in shard.places(deep, np.full(len(deep), DEPTH)):
            common = shard.extended(suffix, where, np.full(len(suffix), DEPTH))
            best = np.lexsort((where, -common, suffix))
            best = best[np.concatenate([[True], suffix[best][1:] != suffix[best][:-1]])] if len(best) else best
            longer = best[common[best] > most[suffix[best]]]  # the places of one suffix may come in several parts
            most[suffix[longer]], at[suffix[longer]] = common[longer], where[longer]
        order = found[np.lexsort((found, -most[found], tests.item[found]))]
        order = order[np.concatenate([[True], tests.item[order][1:] != tests.item[order][:-1]])] if len(order) else order
        at = at[order]
        row = np.searchsorted(bounds, at, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(tests.item_ids[tests.item[order]] if len(order) else order), pa.array(most[order]), pa.array(order - tests.starts[order]), ids.take(pa.array(row)), pa.array(at - bounds[row])],
            names=[x.split()[0] for x in LONGEST.split(", ")],
        )


def _blocks(benchmark: DataFrame, text_col: str, block_words: int) -> int:
    size = benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0
    return max(1, -(-int(size) // (2 * block_words)))  # a word and its gap take two characters at least


def test_blocks(benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[TestSuffixes]:
    """The benchmark in blocks of bounded size, fetched one after another. Who uses several writes what each finds before the next is fetched,
    so that one block at a time is on the driver."""
    tests = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    blocks = _blocks(tests, "text", block_words)
    for k in range(blocks):
        rows = (tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)).collect()
        yield TestSuffixes([r[0] for r in rows], [r[1] for r in rows], window)


test_blocks.__test__ = False  # no test of pytest's


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per benchmark item that shares MIN_MATCH words in a row (or all, if it has fewer) with any document: its longest verbatim match, where it is in the
    item (item_at), and in which document and where. Every test suffix is searched in every shard. Of equally long matches any may be named."""
    scratch = Scratch(docs.sparkSession, "longest-matches")
    own, out = docs.select(F.col(id_col).cast("long"), F.col(text_col)), None
    for block in test_blocks(benchmark, block_words=block_words):
        part = scratch.table(own.mapInArrow(lambda batches, block=block: _longest_batches(batches, block), LONGEST), "block")
        out = part if out is None else out.unionByName(part)
    best = F.max_by(F.struct("longest_match", "item_at", "doc_id", "match_at"), "longest_match")
    return out.groupBy("item_id").agg(best.alias("b")).select("item_id", "b.*")


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: n_words, the hit stretches of words [hit_from, hit_to), the items with occurring windows, and of the matches
    that hold a window the longest: its words, where it begins, in which item and where there (0, -1, null, -1 if none).
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_blocks = _blocks(benchmark, item_text_col, block_words)
    blocks = test_blocks(benchmark, item_col=item_col, item_text_col=item_text_col, window=window, block_words=block_words)
    if n_blocks == 1:
        only = next(blocks)
        return own.mapInArrow(lambda batches: _search_batches(batches, only), SCHEMA)
    scratch = Scratch(docs.sparkSession, "contamination")
    # Rows of the same id and text have the same hits in every block, so they can be united and told apart again by their number.
    keyed = own.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("doc"), "text")
    together = None
    for block in blocks:
        part = beside(keyed.select("doc.doc_id", "doc.key", "text"), lambda batches, block=block: _search_batches(batches, block), SCHEMA)
        part = scratch.table(part.select("doc_id", "row.key", *(x.split()[0] for x in SCHEMA.split(", ")[1:])), "block")
        together = part if together is None else together.unionByName(part)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_from", "hit_to"))))
    best = F.max(F.struct("longest_match", (-F.col("match_at")).alias("at"), "match_item", "match_item_at"))
    out = together.groupBy("doc_id", "key").agg(F.first("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), best.alias("best"), (F.count("*") / n_blocks).cast("int").alias("copies"))
    merge = """aggregate(spans, cast(array() as array<struct<hit_from:bigint,hit_to:bigint>>), (done, x) ->
        if(size(done) > 0 and x.hit_from <= element_at(done, -1).hit_to,
           concat(slice(done, 1, size(done) - 1), array(named_struct('hit_from', element_at(done, -1).hit_from, 'hit_to', greatest(element_at(done, -1).hit_to, x.hit_to)))),
           concat(done, array(named_struct('hit_from', x.hit_from, 'hit_to', x.hit_to)))))"""
    out = out.withColumn("spans", F.expr(merge)).withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("doc_id", "n_words", F.col("spans.hit_from").alias("hit_from"), F.col("spans.hit_to").alias("hit_to"), "items", "best.longest_match", (-F.col("best.at")).alias("match_at"), "best.match_item", "best.match_item_at")


def with_digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate(F.arrays_zip("hit_from", "hit_to"), F.lit(0).cast("long"), lambda n, x: n + x["hit_to"] - x["hit_from"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "longest_match", "match_at", "match_item", "match_item_at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any window of a benchmark item, with their own columns. Each row is judged where it is read, whatever its id.
    With several blocks, what each leaves is written before the next is fetched."""
    several = _blocks(benchmark, "text", block_words) > 1
    scratch = Scratch(docs.sparkSession, "decontaminate") if several else None
    for k, block in enumerate(test_blocks(benchmark, block_words=block_words)):
        docs = beside(docs, lambda batches, block=block: _search_batches(batches, block), SCHEMA).where(F.size("items") == 0).select("row.*")
        if scratch:
            docs = scratch.table(docs, f"block-{k}")
            if k:
                scratch.drop(f"block-{k - 1}")
    return docs
