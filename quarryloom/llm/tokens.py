"""Exact token ids of whole texts by a public byte-level BPE tokenizer of the tokenizers library.

Byte-level BPE never merges across a space or line break between two visible characters, so a text's ids are
those of its words one after another, each with the space or break before it. A full stop or comma after a letter or digit
is an id by itself, and so is a break. Words repeat, so each worker process remembers the ids of those it has met (without such a
mark, with a space before them or without), up to MEMORY of them, and puts texts together from them with numpy. Words of Latin
letters are not cut before the merges, so the library gets many new ones in one call. A text with other white space (runs of
it, tabs, at an end) is encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import SPACED, WordScanner, _byte_set, row_chunks, string_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMORY = 600_000
#: Ids that are remembered at most, however long the words are.
POOL = 16 << 20
CHUNK_BYTES = 2 << 20
END_ID = 0
#: New words of letters in one call of the library.
AT_ONCE = 512
_SPACE, _BREAK = 0x20, 0x0A
_LETTERS, _ALPHANUMERIC = _byte_set((0x41, 0x5A), (0x61, 0x7A)), _byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
#: First bytes of the letters from U+00C0 to U+023F; two characters among them, the signs of times and division, are none.
_LATIN, _NO_LETTER = _byte_set((0xC3, 0xC8)), _byte_set((0x97, 0x97), (0xB7, 0xB7))
_FOLLOWING = _byte_set((0x80, 0xBF))
#: First bytes of the characters that may be white space to the tokenizer but not to the scanner.
_SPACE_LIKE = _byte_set((0x00, 0x1F), (0xC2, 0xC2), (0xE1, 0xE3))


def _byte_alphabet() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones by themselves, the others by those from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size, one after another."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self._prepare(tokenizer)

    def _prepare(self, tokenizer) -> None:  # type: ignore[no-untyped-def]
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer
        alphabet = _byte_alphabet()
        self.characters = np.array([ord(alphabet[b]) for b in range(256)], "<u4")
        #: The same merges on words written in that alphabet; white space parts them.
        self.merges = Tokenizer(tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t[0] in (alphabet[_SPACE], alphabet[_BREAK])]] = True
        (self.break_id,) = self._whole(["\n"])[0]
        self.marks = np.zeros(256, np.uint32)
        for mark in ".,":
            (self.marks[ord(mark)],) = self._whole([mark])[0]
        self.scanner = WordScanner(SPACED, fold_case=False)
        self.variants = np.array([0, 0x9E3779B97F4A7C15], np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.places, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_letters(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each word holds Latin letters only."""
        sizes = ends - starts
        at = _gathered(starts, sizes)
        held = data[at]
        other = ~(_LETTERS | _LATIN | _FOLLOWING)[held]
        other[1:] |= _NO_LETTER[held[1:]] & (held[:-1] == 0xC3)
        return np.add.reduceat(other, np.cumsum(sizes) - sizes, dtype=np.int64) == 0 if len(sizes) else np.zeros(0, bool)

    def _letters(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of Latin letters, with a space before them or without, and how many each has: the merges alone decide."""
        sizes = ends - starts + 3
        before = np.cumsum(sizes) - sizes
        text = self.characters[data[np.maximum(_gathered(starts - 3, sizes), 0)]]
        # Before each word its space, or a break apart from it: no word holds either, so ids that begin with them open the words.
        text[before] = _SPACE
        text[before + 1] = np.where(spaced, _SPACE, self.characters[_BREAK])
        text[before + 2] = np.where(spaced, self.characters[_SPACE], _SPACE)
        cuts = [*before[::AT_ONCE].tolist(), len(text)]
        parts = [self.merges.encode_batch_fast([text[a:b].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids for a, b in zip(cuts, cuts[1:])]
        ids = np.concatenate([np.array(part, np.uint32) for part in parts])
        opens = np.flatnonzero(self.opens[ids])
        counts = np.diff(np.append(opens, len(ids))) - ~spaced
        kept = np.ones(len(ids), bool)
        kept[opens[~spaced]] = False
        return ids[kept], counts

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray) -> None:
        """A word with white space of another kind at an end gets the size -1."""
        sizes = np.full(len(keys), -1, np.int64)
        letters = self._of_letters(data, starts, ends)
        order, flat = [np.flatnonzero(letters)], []
        if letters.any():
            ids, sizes[letters] = self._letters(data, starts[letters], ends[letters], spaced[letters])
            flat.append(ids)
        others = np.flatnonzero(~letters)
        words = [data[a:b].tobytes().decode() for a, b in zip(starts[others].tolist(), ends[others].tolist(), strict=True)]
        edged = np.array([w[0].isspace() or w[-1].isspace() for w in words], bool)
        order.append(others[~edged])
        for i in range(0, len(words), AT_ONCE):
            these = [" " + w if s else w for w, s, e in zip(words[i : i + AT_ONCE], spaced[others[i : i + AT_ONCE]].tolist(), edged[i : i + AT_ONCE].tolist(), strict=True) if not e]
            got = self._whole(these)
            sizes[others[i : i + AT_ONCE][~edged[i : i + AT_ONCE]]] = [len(x) for x in got]
            flat.append(np.array([x for ids in got for x in ids], np.uint32))
        stored = np.concatenate(order)
        first, held = len(self.known), np.concatenate(flat)
        while self.used + len(held) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while first + len(sizes) > len(self.sizes):
            self.places, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.places, self.sizes))
        self.pool[self.used : self.used + len(held)] = held
        self.places[first : first + len(sizes)] = self.used
        self.places[first + stored] = self.used + np.cumsum(sizes[stored]) - sizes[stored]
        self.sizes[first : first + len(sizes)] = sizes
        self.used += len(held)
        self.known.update(zip(keys.tolist(), range(first, first + len(keys)), strict=True))

    def _marked(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a word ends in a full stop or comma after a letter or digit, which no pattern and no merge joins to it."""
        last, second, third = (data[np.maximum(ends - k, 0)] for k in (1, 2, 3))
        plain = (ends - starts > 1) & _ALPHANUMERIC[second]
        latin = (ends - starts > 2) & _LATIN[third] & _FOLLOWING[second] & ~((third == 0xC3) & _NO_LETTER[second])
        return ((last == ord(".")) | (last == ord(","))) & (plain | latin)

    def _rows(self, data: np.ndarray, offsets: np.ndarray, continued: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and how many each has. continued: the row goes on from another and begins with white space."""
        starts, ends, bounds = self.scanner.edges(data, offsets)
        rows, words = len(offsets) - 1, np.diff(bounds)
        filled = words > 0
        row = np.repeat(np.arange(rows), words)
        if not len(starts):
            whole, ids, counts = np.diff(offsets) > 0, np.empty(0, np.uint32), np.zeros(rows, np.int64)
        else:
            first = bounds[:-1][filled]
            lead = data[np.maximum(starts - 1, 0)]
            spaced, broken = lead == _SPACE, lead == _BREAK
            odd = ~(spaced | broken)
            odd[1:] |= starts[1:] - ends[:-1] != 1
            odd[first] = False if continued else starts[first] != offsets[:-1][filled]
            odd[bounds[1:][filled] - 1] |= ends[bounds[1:][filled] - 1] != offsets[1:][filled]
            if not continued:
                spaced[first] = broken[first] = False
            marked = self._marked(data, starts, ends)
            bare = ends - marked
            number = self._numbers(data, starts, bare, spaced)
            sizes = self.sizes[number]
            whole = (np.bincount(row[odd | (sizes < 0)], minlength=rows) > 0) | ((np.diff(offsets) > 0) & ~filled)
            # A break before a word and a mark after it take a place each, beside the word's own ids.
            sizes = np.where(whole[row], 0, sizes + broken + marked)
            total = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.pool.take(_gathered(self.places[number] - broken, sizes), mode="clip")
            shown = ~whole[row]
            ids[total[:-1][broken & shown]] = self.break_id
            marked &= shown
            ids[total[1:][marked] - 1] = self.marks[data[ends[marked] - 1]]
            counts = np.diff(total[bounds])
        if whole.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            these = np.flatnonzero(whole)
            for i, got in zip(these.tolist(), self._whole([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in these]), strict=True):
                parts[i] = np.array(got, np.uint32)
                counts[i] = len(got)
            ids = np.concatenate(parts)
        return ids, counts

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        """The number by which each word is remembered, with a space before it or without; new words are learnt."""
        keys, at, which = np.unique(self.scanner.hashes(data, starts, ends) + self.variants[(~spaced).astype(np.int64)], return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > MEMORY or self.used > POOL:
            self._forget()
        listed = keys.tolist()
        found = np.array([self.known.get(k, -1) for k in listed], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            place = at[new]
            found[new] = len(self.known) + np.arange(len(new))
            self._learn(keys[new], data, starts[place], ends[place], spaced[place])
        return found[which]

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long text, in parts that begin at a space between two visible ASCII characters."""
        visible = (data > 0x20) & (data < 0x7F)
        cuts = np.flatnonzero((data[1:-1] == 0x20) & visible[:-2] & visible[2:]) + 1
        parts, at = [], 0
        while at < len(data):
            k = int(np.searchsorted(cuts, at + CHUNK_BYTES))
            end = int(cuts[k]) if k < len(cuts) else len(data)
            parts.append(self._rows(data[at:end], np.array([0, end - at]), at > 0)[0])
            at = end
        return np.concatenate(parts)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For rows [first, last) at a time: their ids, each text's followed by the end id, and how many each has with it."""
        data, offsets = string_bytes(texts)
        for first, last in row_chunks(offsets, CHUNK_BYTES):
            low, high = int(offsets[first]), int(offsets[last])
            if last - first == 1 and high - low > 2 * CHUNK_BYTES:
                ids = self._long(data[low:high])
                counts = np.array([len(ids)])
            else:
                ids, counts = self._rows(data[low:high], offsets[first : last + 1] - low, False)
            out, inside = np.full(len(ids) + len(counts), END_ID, np.uint32), np.ones(len(ids) + len(counts), bool)
            inside[np.cumsum(counts + 1) - 1] = False
            out[inside] = ids
            yield first, last, out, counts + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
