"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards. Shards of similar size (the same tier, a power of FANOUT of the smallest
shard's size) are merged once FANOUT of them are there, into shards of the next tier, up to the target size, which
are never touched again. So a row is rewritten at most once for each tier. A merge joins whole shards without a
shuffle. What is current is said by a manifest: a numbered file with the schema and the live shards' sizes and rows, some 150
bytes a shard (a hundred terabytes ask for a target of a gigabyte). A commit that another writer has forestalled is made again
on that writer's manifest. Superseded shards stay for readers of the last KEPT manifests and are deleted by vacuum.

A merge is only worth its while if fewer shards come out than went in. Where the writer makes more files than asked for
(spark.sql.files.maxRecordsPerFile), those that come out are sealed, so every merge leaves fewer shards to merge and compaction ends.

Rows keep every column, whatever its name; columns that only later arrivals have are null in earlier rows. Null texts and repeated
rows are kept as they are. An empty arrival commits a manifest without new shards, and a set of empty arrivals reads as an empty
table with its columns. A row larger than the target size makes a shard by itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sources.versions import Versions
from .shared import Scratch

FANOUT = 4
SMALL_BYTES = 1 << 20
TARGET_BYTES = 64 << 20
#: Of a shard's row groups, as a writer holds a whole one in memory and a reader its columns.
ROW_GROUP_BYTES = 8 << 20
#: How many of the last manifests keep their shards through a vacuum.
KEPT = 1


def tier(size: int, small: int = SMALL_BYTES, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int | None:
    """0 for shards up to small, then one more for each factor of fanout; None for those of target size."""
    if size >= target:
        return None
    t, limit = 0, small
    while size > limit:
        t, limit = t + 1, limit * fanout
    return t


class ShardSet:
    """A folder of shards, and its manifests."""

    def __init__(self, spark: SparkSession, path: str, *, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path = spark, path.rstrip("/")
        self.small, self.target, self.fanout = small_bytes, target_bytes, fanout
        self.versions = Versions(spark, f"{self.path}/manifests")

    # Manifests

    def version(self) -> int:
        return self.versions.last()

    def manifest(self, version: int | None = None) -> dict:
        """schema, and shards: each with its path below the folder, bytes, rows, and whether it is sealed."""
        version = self.version() if version is None else version
        return self.versions.read(version) if version else {"schema": StructType().jsonValue(), "shards": []}

    def _commit(self, change: Callable[[dict], dict | None]) -> int | None:
        """Commit what change makes of the last manifest, however often another writer gets in first; None if it makes nothing."""
        while True:
            base = self.version()
            content = change(self.manifest(base))
            if content is None:
                return None
            if self.versions.commit(base, content):
                return base + 1

    # Shards

    def _write(self, rows: DataFrame) -> list[dict]:
        """One immutable shard for each file that Spark writes."""
        name = f"shards/{uuid.uuid4().hex}"
        rows.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{self.path}/{name}")
        files = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")
        held = files.groupBy(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows")).collect()  # a row for each file
        return [{"path": f"{name}/{r['name']}", "bytes": r["bytes"], "rows": r["rows"], "sealed": False} for r in held]

    def append(self, arrival: DataFrame) -> int:
        """Commit an arrival as small shards."""
        new = self._write(arrival)

        def change(held: dict) -> dict:
            old = StructType.fromJson(held["schema"])
            fields = [*old.fields, *(f for f in arrival.schema.fields if f.name not in old.names)]
            return {"schema": StructType(fields).jsonValue(), "shards": held["shards"] + new}

        return self._commit(change)

    def _open(self, shards: list[dict], schema: dict) -> DataFrame:
        kind = StructType.fromJson(schema)
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{s['path']}" for s in shards))

    def compact(self) -> int:
        """Merge tiers that are full until none is; each merge is a commit of its own."""
        while True:
            held = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in held["shards"]:
                if not s["sealed"] and (t := tier(s["bytes"], self.small, self.target, self.fanout)) is not None:
                    tiers.setdefault(t, []).append(s)
            full = [t for t, members in sorted(tiers.items()) if len(members) >= self.fanout]
            if not full:
                return self.version()
            merged = tiers[full[0]]
            size = sum(s["bytes"] for s in merged)
            files = min(-(-size // min(self.target, self.small * self.fanout ** (full[0] + 1))), len(merged) // 2)
            new = self._write(self._open(merged, held["schema"]).coalesce(max(1, files)))
            if len(new) >= len(merged):
                new = [{**s, "sealed": True} for s in new]
            gone = {s["path"] for s in merged}

            def change(last: dict, gone=gone, new=new) -> dict | None:
                """Nothing if another writer has merged some of these shards meanwhile."""
                if not gone <= {s["path"] for s in last["shards"]}:
                    return None
                return {**last, "shards": [s for s in last["shards"] if s["path"] not in gone] + new}

            self._commit(change)

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        return self._open(held["shards"], held["schema"])

    def vacuum(self, kept: int = KEPT) -> int:
        """Delete shards that none of the last kept manifests lists; returns how many. Not to be run while others write."""
        live = {s["path"] for v in self.versions.numbers()[-kept:] for s in self.manifest(v)["shards"]}
        fs, path = self.versions.fs, self.versions.hadoop_path
        gone = 0
        for folder in fs.listStatus(path(f"{self.path}/shards")):
            name = folder.getPath().getName()
            files = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            dead = [f for f in files if f"shards/{name}/{f.getName()}" not in live]
            if len(dead) == len(files):
                fs.delete(folder.getPath(), True)
            else:
                for f in dead:
                    fs.delete(f, False)
            gone += len(dead)
        return gone


#: How many arrivals the query makes of the documents.
ARRIVALS = 6


def arrivals(docs: DataFrame, id_col: str = "doc_id", n: int = ARRIVALS) -> list[DataFrame]:
    """All rows in n ranges of ids, a filter that reaches the scan; rows without an id are in the first."""
    at = F.col(id_col)
    low, high = docs.agg(F.min(at), F.max(at)).first()
    if low is None:
        return [docs]
    bounds = [low + (high - low + 1) * k // n for k in range(1, n)]
    parts = zip([None, *bounds], [*bounds, None], strict=True)
    return [docs.where(at.isNull() | (at < b) if a is None else at >= a if b is None else (at >= a) & (at < b)) for a, b in parts]


def sharded(docs: DataFrame) -> DataFrame:
    """Append all documents in ARRIVALS arrivals, compact and vacuum after each, and read the last manifest's shards
    back. Per document: doc_id, text_bytes, text_sha256, and the shard's file name."""
    spark = docs.sparkSession
    shards = ShardSet(spark, Scratch(spark, "sharding").place("set"))
    for arrival in arrivals(docs):
        shards.append(arrival)
        shards.compact()
        shards.vacuum()
    text, rows = F.col("text").cast("binary"), shards.read()
    shard = F.col("_metadata.file_name") if shards.manifest()["shards"] else F.lit(None).cast("string")
    return rows.select("doc_id", F.length(text).cast("long").alias("text_bytes"), F.sha2(text, 256).alias("text_sha256"), shard.alias("shard"))
