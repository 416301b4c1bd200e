"""Byte-level BPE by a file of ranks: texts to ids with offsets, and ids back to bytes and text.

The tokenizers library encodes. Its vocabulary is written in characters that stand for bytes, one for each of the 256 (the byte
alphabet); ranks become its ids, and the pair that the ranks merge last within a token becomes that token's merge. Ids are so
those of the ranks' own algorithm, each match of the pattern by itself. Words repeat: a worker process remembers those it has
met (tokens.Encoder) and puts whole texts together with numpy over Arrow batches. A token covers bytes, so it may begin or end
within a character: its offsets are counted in bytes and mapped to characters by the bytes that begin one.

Decoding reverses the byte alphabet of every token and joins the bytes, so characters that are split over tokens are whole again.
Pieces of a text (`decoded_pieces`) hold back the bytes of an unfinished character for the token that ends it.

Null texts are empty and have no ids; null ids decode to an empty text. Rows with null or repeated ids of documents are encoded each
by itself. Empty tables give no rows. Columns beyond id and text are ignored. Texts of any length are encoded whole, in parts
that are cut where the pattern cuts them. Ids outside the vocabulary are refused.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Batches, small_batches
from .text import SPACED, WordScanner, string_bytes
from .tokens import Encoder, _byte_alphabet

ALPHABET = _byte_alphabet()
BYTES = {c: b for b, c in ALPHABET.items()}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def in_characters(token: bytes) -> str:
    return "".join(map(ALPHABET.__getitem__, token))


def in_bytes(token: str) -> bytes:
    return bytes(map(BYTES.__getitem__, token))


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that lower ranks leave of a token; None if they leave more, as then no text has it."""
    rank, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        pairs = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
        low = min(pairs)
        if low >= rank:
            return None
        at = pairs.index(low)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def tokenizer_of(ranks: dict[bytes, int], pattern: str):
    """The tokenizers library's tokenizer of these ranks, which are its ids."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    pairs = [last_pair(t, ranks) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1]
    merges = [(in_characters(a), in_characters(b)) for a, b in filter(None, pairs)]
    made = Tokenizer(models.BPE(written_vocabulary(ranks), merges))
    matches = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    made.pre_tokenizer = pre_tokenizers.Sequence([matches, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


def written_vocabulary(ranks: dict[bytes, int]) -> dict[str, int]:
    """Tokens as the tokenizers library writes them, with their ids."""
    return {in_characters(t): r for t, r in ranks.items()}


class Decoder:
    """The bytes of every token, one after another in the order of the ids."""

    def __init__(self, vocabulary: dict[str, int]):
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, rank in vocabulary.items():
            tokens[rank] = in_bytes(token)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (int(ids.max()) >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        return self.data[np.repeat(self.starts[ids] - before, sizes) + np.arange(int(sizes.sum()))]

    def offsets(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every token, counted from its text's start: the first byte, the character that holds it, and that of its last byte."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        began = np.cumsum((data & 0xC0) != 0x80)  # characters up to and with each byte
        row = np.repeat(np.arange(len(counts)), counts)
        first = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
        earlier = np.concatenate([[0], began])[first]
        return ends - sizes - first[row], began[ends - sizes] - 1 - earlier[row], began[ends - 1] - 1 - earlier[row]


class ByteEncoder(Encoder):
    """The encoder of one file of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._prepare(tokenizer_of(ranks, pattern))

    def ids(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For rows [first, last) at a time: their ids and how many each has."""
        for first, last, ids, counts in self.encode(texts):  # these end each text with an id of their own
            inside = np.ones(len(ids), bool)
            inside[np.cumsum(counts) - 1] = False
            yield first, last, ids[inside], counts - 1


Vocabulary = tuple[str, str]
_ENCODERS: dict[Vocabulary, ByteEncoder] = {}
_DECODERS: dict[Vocabulary, Decoder] = {}


def encoder(vocabulary: Vocabulary) -> ByteEncoder:
    """One for each worker process and vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ByteEncoder(read_ranks(vocabulary[0]), vocabulary[1])
    return _ENCODERS[vocabulary]


def decoder(vocabulary: Vocabulary) -> Decoder:
    if vocabulary not in _DECODERS:
        _DECODERS[vocabulary] = Decoder(written_vocabulary(read_ranks(vocabulary[0])))
    return _DECODERS[vocabulary]


def default_vocabulary() -> Vocabulary:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


ENCODED = ("ids", "byte_at", "char_at", "last_char_at")


def _encoded(batches: Batches, vocabulary: Vocabulary) -> Batches:
    """Of batches of (id, text)."""
    coder, table = encoder(vocabulary), decoder(vocabulary)
    for batch in batches:
        data, at = string_bytes(batch.column(1))
        for first, last, ids, counts in coder.ids(batch.column(1)):
            places = table.offsets(ids, counts, data[at[first] : at[last]])
            lists = [_lists(x, counts, pa.int32()) for x in (ids, *places)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *lists], names=["doc_id", *ENCODED])


def encoded(docs: DataFrame, vocabulary: Vocabulary | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ids, and of each token the first byte and the first and last character, all counted from 0 in the text.

    vocabulary: a file of ranks that every worker can read, and the pattern; by default the public one.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{k} array<int>" for k in ENCODED)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(lambda batches: _encoded(batches, vocabulary or default_vocabulary()), schema)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists one after another, and how many each row has."""
    lists = lists.fill_null([]) if lists.null_count else lists
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts


DECODED = "n_tokens long, ids_sha256 string, decoded_sha256 string, decoded string"


def _decoded(batches: Batches, vocabulary: Vocabulary) -> Batches:
    """Of batches whose last column has ids: the columns before it, and what these decode to."""
    table = decoder(vocabulary)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for batch in batches:
        ids, counts = _flat(batch.column(batch.num_columns - 1))
        data, little = table.bytes(ids), ids.astype("<u4")
        size, ends = np.concatenate([[0], np.cumsum(table.sizes[ids])]), np.cumsum(counts)
        found = [(little[a:b].tobytes(), data[size[a] : size[b]].tobytes()) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        columns = [counts, [digest(x) for x, _ in found], [digest(x) for _, x in found], [x.decode("utf-8", "replace") for _, x in found]]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [*batch.schema.names[:-1], *(x.split()[0] for x in DECODED.split(", "))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names=names)


def decoded(rows: DataFrame, vocabulary: Vocabulary | None = None, *, keep: Sequence[str] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """Per row the columns of keep, n_tokens, and from the ids alone their digest, that of the bytes, and the text. Bytes that are no UTF-8, which
    ids of no text can give, become the replacement character."""
    small_batches(rows.sparkSession)
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, ids_col).mapInArrow(lambda batches: _decoded(batches, vocabulary or default_vocabulary()), f"{kept}, {DECODED}")


def decoded_pieces(ids: Sequence[int], vocabulary: Vocabulary | None = None) -> list[str]:
    """The text that each id adds when ids come one by one: a split character is held back until the id that ends it."""
    table = decoder(vocabulary or default_vocabulary())
    held = codecs.getincrementaldecoder("utf-8")("replace")
    pieces = [held.decode(table.bytes(np.array([i])).tobytes()) for i in ids]
    if pieces:
        pieces[-1] += held.decode(b"", True)
    return pieces


def _split(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The id, how many tokens begin within a character, and ids of encoded rows."""
    (first, counts), (last, _) = (_flat(batch.column(1 + ENCODED.index(k))) for k in ("char_at", "last_char_at"))
    inside = np.zeros(len(first), np.int64)
    inside[1:] = first[1:] == last[:-1]
    ends = np.cumsum(counts)
    inside[(ends - counts)[counts > 0]] = 0
    upto = np.concatenate([[0], np.cumsum(inside)])
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(upto[ends] - upto[ends - counts]), batch.column(1)], names=["doc_id", "n_split", "ids"])


def round_trip(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Per document: ids and bytes after encoding and decoding, as digests, and n_split, the tokens that begin within a character.
    Both ways run in one pass of a task, batch by batch; the decoder sees the ids alone."""
    small_batches(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        own = vocabulary or default_vocabulary()
        for batch in _decoded(map(_split, _encoded(batches, own)), own):
            yield batch.select([0, 2, 3, 4, 1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")
