"""Best-fit packing of documents into fixed-length sequences, improved by swap-based local search.

Documents longer than a sequence are cut: pieces of full length, the first one shorter. Pieces are dealt to groups
of about GROUP by a hash, and each group is packed by one task: best fit, longest first, then local search. The
emptiest bin gives to the others: it moves a piece, exchanges one piece for a shorter one, two for one or one
for two, always the exchange that raises the sum of squared fills most, until it is empty or nothing is left to
gain. It goes on with the next bin while the free room elsewhere could take it all. Bins that stay underfull are
opened again and their pieces regrouped once, so a group's last bins do not add up over many groups.

Null and empty texts are one piece, the end id. Equal lengths are taken in the order of ids and pieces, so the
result does not depend on the order of rows. Empty tables give no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Scratch
from .token_files import encoded
from .tokens import default_path

LENGTH = 2048
GROUP = 4096
#: Bins with less of their room taken are opened for the second round.
OPEN = 0.98

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for docs, ids, counts in encoded(batches, path):
        columns: list[list[int]] = [[] for _ in names]
        raw = memoryview(ids.astype("<u4", copy=False).tobytes())
        for doc, n, after in zip(docs.tolist(), counts.tolist(), np.cumsum(counts).tolist(), strict=True):
            first, base = n % length or length, after - n
            for piece, start in enumerate([0, *range(first, n, length)]):
                end = first if piece == 0 else start + length
                for column, value in zip(columns, (doc, piece, start, end - start, zlib.crc32(raw[4 * (base + start) : 4 * (base + end)])), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins of positions in lengths, filled longest first, each into the fullest bin that can take it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(room + 1)]
    open_gaps = np.zeros(room + 1, bool)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        gap = n + int(open_gaps[n:].argmax()) if n <= room else n
        if gap <= room and open_gaps[gap]:
            b = by_gap[gap].pop()
            open_gaps[gap] = bool(by_gap[gap])
            bins[b].append(i)
        else:
            b, gap = len(bins), room
            bins.append([i])
        left = gap - n
        by_gap[left].append(b)
        open_gaps[left] = True
    return bins


class LocalSearch:
    """Exchanges between bins, by lengths: pieces of equal length are alike. What a bin can give back (nothing, one of its lengths,
    two) is a row of arrays: the bin, the two lengths and their sum; rows of a bin that has changed are dropped and written anew.
    A bin's different lengths add up to its room at most, so they are few (63 at 2,048) however many pieces it holds."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], room: int):
        self.room = room
        self.held: list[dict[int, list[int]]] = []
        for members in bins:
            mine: dict[int, list[int]] = {}
            for i in members:
                mine.setdefault(int(lengths[i]), []).append(i)
            self.held.append(mine)
        self.fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
        self.rows = np.empty((0, 4), np.int64)
        self.live = np.empty(0, bool)
        self.n = 0
        self._add(range(len(bins)))

    def _choices(self, b: int) -> np.ndarray:
        mine = self.held[b]
        sizes = np.array(sorted(mine), np.int64)
        x, y = np.triu_indices(len(sizes))
        two = (x != y) | np.array([len(mine[n]) > 1 for n in sizes.tolist()], bool)[x]
        x, y = sizes[x[two]], sizes[y[two]]
        first, second = np.concatenate([[0], sizes, x]), np.concatenate([np.zeros(len(sizes) + 1, np.int64), y])
        return np.stack([np.full(len(first), b), first, second, first + second], axis=1)

    def _add(self, which) -> None:
        new = [self._choices(b) for b in which if 0 < self.fill[b] < self.room]
        if not new:
            return
        added = np.concatenate(new)
        if self.n + len(added) > len(self.rows):
            kept = self.rows[: self.n][self.live[: self.n]]
            size = 2 * (len(kept) + len(added)) + 64
            self.rows, self.live, self.n = np.empty((size, 4), np.int64), np.zeros(size, bool), len(kept)
            self.rows[: self.n], self.live[: self.n] = kept, True
        self.rows[self.n : self.n + len(added)] = added
        self.live[self.n : self.n + len(added)] = True
        self.n += len(added)

    def _drop(self, b: int) -> None:
        self.live[: self.n] &= self.rows[: self.n, 0] != b

    def run(self) -> list[list[int]]:
        least = -(-int(self.fill.sum()) // self.room)
        done = np.zeros(len(self.held), bool)
        while (self.fill > 0).sum() > least:
            candidates = np.flatnonzero(~done & (self.fill > 0) & (self.fill < self.room))
            if len(candidates) < 2:
                break
            donor = int(candidates[self.fill[candidates].argmin()])
            free = (self.room - self.fill[self.fill > 0]).sum() - (self.room - self.fill[donor])
            if free < self.fill[donor]:
                break  # what is left elsewhere can't take any bin
            self._drop(donor)
            while self.held[donor] and self._improve(donor):
                pass
            self._add([donor])
            done[donor] = True
        return [[i for n in sorted(b, reverse=True) for i in b[n]] for b in self.held if b]

    def _improve(self, donor: int) -> bool:
        """The exchange with a bin at least as full that raises the sum of squared fills most.

        A row that gives back m into a gap g takes from m + 1 to m + g; the more the better, so of all that the donor can give
        the largest up to m + g is looked up: of one piece, or of one or two where the row itself gives back one at most.
        """
        rows = self.rows[: self.n]
        own = int(self.fill[donor])
        rows = rows[np.flatnonzero(self.live[: self.n] & (self.fill[rows[:, 0]] >= own))]
        if not len(rows):
            return False
        mine = self._choices(donor)[1:]
        best = np.full((2, self.room + 1), -1, np.int64)  # for each sum: the donor's choice that has it
        single = np.flatnonzero(mine[:, 2] == 0)
        best[1, mine[::-1, 3]] = np.arange(len(mine))[::-1]  # of equal sums the first, one piece before two
        best[0, mine[single, 3]] = single
        upto = np.maximum.accumulate(np.where(best >= 0, np.arange(self.room + 1), 0), axis=1)
        fill, back = self.fill[rows[:, 0]], rows[:, 3]
        two = (rows[:, 2] > 0).astype(np.int64)
        given = upto[1 - two, np.minimum(back + self.room - fill, self.room)]
        moved = given - back
        # Raises the sum by (fill + moved)^2 + (own - moved)^2 - fill^2 - own^2.
        gain = np.where(moved > 0, moved * (fill - own + moved), 0)
        k = int(gain.argmax())
        if gain[k] <= 0:
            return False
        other, x, y, _ = rows[k].tolist()
        _, a, b, _ = mine[best[1 - two[k], given[k]]].tolist()
        taken, sent = ([self._take(where, n) for n in lengths if n] for where, lengths in ((other, (x, y)), (donor, (a, b))))
        for where, pieces in ((donor, taken), (other, sent)):
            for n, i in pieces:
                self.held[where].setdefault(n, []).append(i)
        self.fill[donor] -= moved[k]
        self.fill[other] += moved[k]
        self._drop(other)
        self._add([other])
        return True

    def _take(self, b: int, n: int) -> tuple[int, int]:
        """A piece of this length out of a bin."""
        pieces = self.held[b][n]
        i = pieces.pop()
        if not pieces:
            del self.held[b][n]
        return n, i


def pack(lengths: np.ndarray, room: int = LENGTH) -> list[list[int]]:
    return LocalSearch(lengths, best_fit(lengths, room), room).run()


def _packed(pieces: pd.DataFrame, room: int, number: int) -> pd.DataFrame:
    pieces = pieces.sort_values(["doc_id", "piece"], ignore_index=True)
    bins = pack(pieces["length"].to_numpy(), room)
    sequence, offset, fill = (np.empty(len(pieces), np.int64) for _ in range(3))
    base = (number << 60) | (int(pieces["part"].iloc[0]) << 24)
    for b, members in enumerate(bins):
        lengths = pieces["length"].to_numpy()[members]
        sequence[members], offset[members], fill[members] = base + b, np.cumsum(lengths) - lengths, lengths.sum()
    return pieces.drop(columns="part").assign(sequence_id=sequence, offset=offset, fill=fill)


def packed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", room: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and fill (tokens in its sequence)."""
    path = tokenizer or default_path()
    scratch = Scratch(docs.sparkSession, "packing")
    own = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    pieces = scratch.table(own.mapInArrow(lambda batches: _cut(batches, path, room), PIECES), "pieces")
    out = f"{PIECES}, sequence_id long, offset long, fill long"

    def grouped(df: DataFrame, number: int) -> DataFrame:
        parts = max(1, -(-df.count() // GROUP))
        dealt = df.select("*", F.pmod(F.xxhash64("doc_id", "piece", F.lit(number)), F.lit(parts)).alias("part"))
        return dealt.groupBy("part").applyInPandas(lambda pdf: _packed(pdf, room, number), out)

    first = scratch.table(grouped(pieces, 1), "packed")
    again = grouped(first.where(F.col("fill") < OPEN * room).select(*pieces.columns), 2)
    return first.where(F.col("fill") >= OPEN * room).unionByName(again)
