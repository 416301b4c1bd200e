"""Delta-maintained rollups of token counts by source, language and tokenizer version.

A batch of changes is a set of signed rows: an insert adds a document's count, a delete takes it away, a revision
does both. Only the batch is aggregated; its totals are added to the last version's, so the cost follows the batch and the
number of groups, never the corpus. Totals are written under a name of their own, then committed by a small numbered
file that names them and the batch. A writer that another has forestalled adds its totals to the other's version. The numbered
files are the record of all batches ever held: a batch that is sent again is found there and changes nothing.

Tokenizer versions are public vocabularies by name, counted exactly, without special tokens. Null sources and languages are
groups of their own. Null texts have no tokens but count as documents. Groups whose documents have all been deleted disappear. Repeated rows
within a batch add up. Empty batches make a version with the same totals. Extra columns of the documents are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.versions import Versions
from .shared import Scratch
from .text import row_chunks, string_bytes
from .tokens import CHUNK_BYTES, encoder

KEYS = ["source", "lang", "tokenizer"]
COUNTS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"

#: Tokenizer versions by name: vocabulary files of the public tokenizers.
TOKENIZERS = {"byte_bpe_50k": "byte_bpe_50k.json", "word_bpe_49k": "word_bpe_49k.json"}

_LOADED: dict[str, object] = {}


def _counted(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZERS[tokenizer])
    for batch in batches:
        texts, counts = batch.column(3), []
        if tokenizer == "byte_bpe_50k":
            for _, _, _, sizes in encoder(path).encode(texts):
                counts.extend((sizes - 1).tolist())  # without the end id
        else:
            if path not in _LOADED:
                _LOADED[path] = Tokenizer.from_file(path)
            _, offsets = string_bytes(texts)
            for a, b in row_chunks(offsets, CHUNK_BYTES):
                counts.extend(len(e.ids) for e in _LOADED[path].encode_batch_fast([t or "" for t in texts.slice(a, b - a).to_pylist()], add_special_tokens=False))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), batch.column(4)], names=["doc_id", "source", "lang", "n_tokens", "n_chars"])


def measured(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: its keys and counts by this tokenizer version."""
    own = docs.select(F.col("doc_id").cast("long"), "source", "lang", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    rows = own.mapInArrow(lambda batches: _counted(batches, tokenizer), "doc_id long, source string, lang string, n_tokens long, n_chars long")
    return rows.withColumn("tokenizer", F.lit(tokenizer))


def inserts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(1))


def deletes(rows: DataFrame) -> DataFrame:
    """rows: the counts as they were inserted."""
    return rows.withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    return deletes(before).unionByName(inserts(after))


def _totals(rows: DataFrame) -> DataFrame:
    """Totals of additive rows; groups without documents go. Partial sums are made before the shuffle, so a hot group is no hot task."""
    sums = rows.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS))
    return sums.where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")


class Rollup:
    """Versions in a folder of any store that Hadoop's file systems can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/versions")

    def version(self) -> int:
        """The last complete version, 0 if there is none."""
        return self.versions.last()

    def totals(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{self.versions.read(version)['totals']}")

    def holds(self, batch: str, version: int | None = None) -> int | None:
        """The version, up to this one (or the last), that brought a batch, or None. A scan of the numbered files; nothing but the answer reaches the driver."""
        version = self.version() if version is None else version
        if not version:
            return None
        found = self.spark.read.schema("batch string, version long").json(f"{self.path}/versions/*.json").where((F.col("batch") == batch) & (F.col("version") <= version)).first()
        return found["version"] if found else None

    def commit(self, batch: str, changes: DataFrame) -> int:
        """Add a batch of signed rows once; returns the version that brought it.

        Whether the batch is held is asked of each version that its totals are added to, after that version is known: a writer that sends the same batch
        meanwhile is either found there, or has made the version that this one tries to make."""
        delta = None
        while True:
            base = self.version()
            done = self.holds(batch, base)
            if done:
                break
            if delta is None:
                delta = self._delta(changes)
            name = f"totals/{uuid.uuid4().hex}"
            both = self.totals(base).unionByName(self.spark.read.schema(SCHEMA).parquet(delta))
            _totals(both).coalesce(1).write.parquet(f"{self.path}/{name}")  # a row for each group
            if self.versions.commit(base, {"batch": batch, "totals": name}):
                done = base + 1
                break
            self.versions.fs.delete(self.versions.hadoop_path(f"{self.path}/{name}"), True)
        if delta is not None:
            self.versions.fs.delete(self.versions.hadoop_path(delta), True)
        return done

    def _delta(self, changes: DataFrame) -> str:
        """Write the batch's totals; their place."""
        signed = changes.select(*KEYS, F.col("sign").cast("long").alias("n_docs"), *((F.col("sign") * F.col(k)).alias(k) for k in COUNTS[1:]))
        where = f"{self.path}/deltas/{uuid.uuid4().hex}"
        _totals(signed).write.parquet(where)
        return where


def maintained(docs: DataFrame) -> DataFrame:
    """Insert all documents by the first tokenizer version, revise every third to the second, delete every seventh and insert
    it again, send all batches a second time, and return the totals, which hold every document. The revised and deleted ids stand for a day's changes."""
    scratch = Scratch(docs.sparkSession, "token-counts")
    rollup = Rollup(docs.sparkSession, scratch.place("rollup"))
    first, second = TOKENIZERS
    third, seventh = (F.coalesce(F.pmod("doc_id", F.lit(n)) == 0, F.lit(False)) for n in (3, 7))
    old = scratch.table(measured(docs, first), "first")
    new = scratch.table(measured(docs.where(third), second), "second")
    current = old.where(seventh & ~third).unionByName(new.where(seventh))
    batches = {"insert": inserts(old), "revise": revisions(old.where(third), new), "delete": deletes(current), "restore": inserts(current)}
    for name, changes in [*batches.items(), *batches.items()]:
        rollup.commit(name, changes)
    return rollup.totals()
