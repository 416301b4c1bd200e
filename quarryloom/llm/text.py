"""Word scanning over the UTF-8 bytes of Arrow string columns, with numpy and without Python strings.

Words are maximal runs of bytes of a class. Both classes used here keep every byte of a multi-byte
character inside words, so scanning bytes finds the same words as scanning code points. A word's hash is a
64-bit polynomial over its bytes; A-Z may be folded to a-z. Chunks of rows keep the working memory
bounded; a text longer than a chunk is scanned in segments that are cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Words between ASCII white space (space, \t to \r).
SPACED = ~_byte_set((0x20, 0x20), (0x09, 0x0D))
#: Runs of ASCII letters and digits and of everything that is not ASCII.
ALPHANUMERIC = _byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


class _Powers:
    """base**i and its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK_BYTES)
            step = np.full(self.n + 1, _BASE, dtype=np.uint64)
            back = np.full(self.n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Words:
    """Words of rows [first, last): their hashes, and where each row's words begin (one entry more than rows)."""

    first: int
    last: int
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def ends(self) -> np.ndarray:
        """For each word, the index just past its row's last word."""
        return np.repeat(self.bounds[1:], self.counts)


class WordScanner:
    def __init__(self, word_bytes: np.ndarray, fold_case: bool = True, chunk_bytes: int = CHUNK_BYTES):
        self.word_bytes, self.chunk_bytes = word_bytes, chunk_bytes
        values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        if fold_case:
            values[0x41:0x5B] = values[0x61:0x7B]
        self.values = values

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows that offsets cut data into: where each word starts and ends, and where each row's words begin."""
        n = len(data)
        if n == 0:
            none = np.empty(0, np.int64)
            return none, none, np.zeros(len(offsets), np.int64)
        inside = self.word_bytes[data]
        filled = offsets[1:] > offsets[:-1]
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        before[offsets[:-1][filled]] = False
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        after[offsets[1:][filled] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each start to its end."""
        n = len(data)
        up, down = _POWERS.upto(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.values[data] * up[:n], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts])

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows that offsets cut data into: where each word starts and ends, its hash, and where each row's words begin."""
        starts, ends, bounds = self.edges(data, offsets)
        return starts, ends, self.hashes(data, starts, ends), bounds

    def _scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(data, offsets)[2:]

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Hashes of one long text, scanned in segments that end between words."""
        parts, at, n = [], 0, len(data)
        while at < n:
            end = min(n, at + self.chunk_bytes)
            if end < n:
                gaps = np.flatnonzero(~self.word_bytes[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # a word longer than a segment
                    while end < n and self.word_bytes[data[end]]:
                        end += 1
            parts.append(self._scan(data[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def scan(self, texts: pa.Array) -> Iterator[Words]:
        """Null texts have no words."""
        data, offsets = string_bytes(texts)
        for first, last in row_chunks(offsets, self.chunk_bytes):
            low, high = int(offsets[first]), int(offsets[last])
            if last - first == 1 and high - low > self.chunk_bytes:
                hashes = self._long(data[low:high])
                yield Words(first, last, hashes, np.array([0, len(hashes)], np.int64))
            else:
                hashes, bounds = self._scan(data[low:high], offsets[first : last + 1] - low)
                yield Words(first, last, hashes, bounds)


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets in them; a null takes no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about chunk_bytes; a row longer than that comes alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += words[i : i + n] * factors[i]
    return mix64(total)
