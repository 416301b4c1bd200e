"""Keyed tables of scans, outcomes, market conditions and trades: upserts, filtered reads, backfills, counts and exports.

Upserts rewrite only the partitions that the new rows touch, so their cost follows the batch and not the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .scratch import written
from .versions import Versions

c = F.col

#: Each table's key; the first column is the one that its folder is partitioned by.
KEYS = {
    "scans": ("scan_date", "symbol"),
    "outcomes": ("scan_date", "symbol", "outcome_date"),
    "market_conditions": ("scan_date",),
    "paper_trades": ("scan_date", "symbol"),
}


def sanitised(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns become null."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    return df.withColumns({n: F.when(~bad(c(n)), c(n)) for n, kind in df.dtypes if kind in ("double", "float")})


def latest(df: DataFrame, key: tuple[str, ...], version: str) -> DataFrame:
    """One row for each key: the one of the highest version."""
    order = Window.partitionBy(*key).orderBy(F.desc(version))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merged(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Old and new rows by key, the new ones winning; columns that only one side has are null on the other."""
    both = old.withColumn("_version", F.lit(0)).unionByName(new.withColumn("_version", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, "_version").drop("_version")


#: What a stored scan shows of a row by its name, and what only of a row that passes its filters.
SCAN_SCORES = {"score": "total_score", "raw_score": "raw_score", "grade": "grade", "signal": "signal", "base_quality": "base_score", "trend_strength": "trend_score", "relative_strength_score": "rs_score", "volume_score": "volume_score", "rr_score": "rr_score"}
SCAN_VALUES = {"price": "close"} | {k: k for k in (
    "breakout_level", "stop_level", "target_level", "stop_distance_pct", "stop_distance_20d_pct", "potential_r", "consol_days", "vcp_contracting", "vcp_contraction_ratio", "stage2",
    "pct_from_52wk_high", "ma_alignment", "prior_move_pct", "rs_comp_20", "rs_comp_60", "rs_comp_120", "rs_comp_252", "dollar_volume", "adr_pct", "volume_dryup_ratio",
)}


def scan_rows(scored: DataFrame, by: tuple[str, ...] = ("symbol",), conditions: DataFrame | None = None) -> DataFrame:
    """Rows of the scans table: of each group of by the last one. Scores are null where a filter fails, prices and features are kept; NaN and
    infinities are null; the range of the base is that of 60 bars, or of 15 where that is missing (and not where it is 0).

    conditions: bar_date, regime, score and multiplier, which join by date."""
    clean = sanitised(scored)
    have = [r for r in ("consol_range_60", "consol_range_15") if r in clean.columns]
    shown = {"passes_filters": c("passes_filters"), **{k: F.when(c("passes_filters"), c(v)) for k, v in SCAN_SCORES.items() if v in clean.columns}}
    shown |= {k: c(v) for k, v in SCAN_VALUES.items() if v in clean.columns} | {"consol_range_pct": F.coalesce(*(c(r) for r in have), F.lit(None).cast("double"))}
    rows = clean.select(*dict.fromkeys((*by, "symbol", "bar_date")), *(v.alias(k) for k, v in shown.items()))
    names = [n for n in rows.columns if n not in by]
    last = rows.groupBy(*by).agg(F.max_by(F.struct(*names), "bar_date").alias("x")).select(*by, "x.*").withColumnRenamed("bar_date", "scan_date")
    if conditions is None:
        return last
    market = conditions.select(c("bar_date").alias("scan_date"), c("regime").alias("market_regime"), c("score").alias("market_score"), c("multiplier").alias("regime_multiplier"))
    return last.join(market, "scan_date", "left")


#: Versions that vacuum keeps.
KEPT = 2


class Stored:
    """A keyed table in versions. Each version is a manifest that names the folder of each partition (a value of part, an expression of the key; by default
    the key's first column); what a folder holds never changes. An upsert writes the partitions that it touches anew and commits a manifest that names them, so a reader sees a version as a
    whole, a lost writer leaves nothing but folders that no manifest names, and of two writers the second starts again from the first's version.

    Null partition values are a partition of their own. Later rows win by key; within a batch, any one of equal keys. Columns that are new make
    older rows null there, columns that a batch lacks make its rows null. Empty batches make a version with the same rows."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...], part: str | None = None):
        self.spark, self.path, self.key, self.part = spark, path.rstrip("/"), key, part or f"`{key[0]}`"
        self.versions = Versions(spark, f"{self.path}/versions")

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions.last() if version is None else version
        return self.versions.read(version) if version else {"schema": StructType().jsonValue(), "parts": {}}

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one if none is named."""
        held = self.manifest(version)
        return self._open(held, held["parts"])

    def _open(self, held: dict, parts: Iterable[str]) -> DataFrame:
        kind = StructType.fromJson(held["schema"])
        folders = [f"{self.path}/{held['parts'][p]}" for p in sorted(parts)]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def upsert(self, new: DataFrame) -> int:
        """Commit new rows over those with the same key; returns the version that has them."""
        batch = written(latest(new.withColumn("_at", F.lit(0)), self.key, "_at").drop("_at"), "upsert")
        part = F.concat(F.lit("p"), F.hex(F.coalesce(F.expr(self.part).cast("string"), F.lit(""))))
        touched = [r[0] for r in batch.select(part).distinct().collect()]  # a row for each partition of the batch
        while True:
            base = self.versions.last()
            held = self.manifest(base)
            rows = merged(self._open(held, set(touched) & set(held["parts"])), batch, self.key) if base else batch
            folder = f"data/{uuid.uuid4().hex}"
            rows.withColumn("_part", part).repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")
            parts = {**held["parts"], **{p: f"{folder}/_part={p}" for p in touched}}
            if self.versions.commit(base, {"schema": rows.schema.jsonValue(), "parts": parts}):
                return base + 1
            self.versions.fs.delete(self.versions.hadoop_path(f"{self.path}/{folder}"), True)

    def vacuum(self, kept: int = KEPT) -> int:
        """Delete batches' folders that none of the last kept versions names; returns how many. Not to be run while others write."""
        live = {f.split("/")[1] for v in self.versions.numbers()[-kept:] for f in self.manifest(v)["parts"].values()}
        fs, path = self.versions.fs, self.versions.hadoop_path
        gone = [name for name in (s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/data"))) if name not in live]
        for name in gone:
            fs.delete(path(f"{self.path}/data/{name}"), True)
        return len(gone)


def load(df: DataFrame, *, since: str | None = None, until: str | None = None, passed_only: bool = False, min_score: float | None = None, min_raw_score: float | None = None) -> DataFrame:
    """Rows by any of these conditions, newest first and best first within a date. The date bounds prune partitions."""
    asked: list[Column] = []
    if since is not None:
        asked.append(c("scan_date") >= F.lit(since).cast("date"))
    if until is not None:
        asked.append(c("scan_date") <= F.lit(until).cast("date"))
    if passed_only:
        asked.append(c("passes_filters"))
    if min_score is not None:
        asked.append(c("score") >= min_score)
    if min_raw_score is not None:
        asked.append(c("raw_score") >= min_raw_score)
    found = df.where(reduce(Column.__and__, asked)) if asked else df
    order = [F.desc("scan_date"), *([F.desc_nulls_last("score")] if "score" in df.columns else []), *([c("symbol")] if "symbol" in df.columns else [])]
    return found.orderBy(*order)


def summary(scans: DataFrame) -> DataFrame:
    """Counts of rows, of passing rows, of dates and of symbols, with the first and last date: one row."""
    return scans.agg(
        F.count("*").alias("n_scans"), F.count(F.when(c("passes_filters"), 1)).alias("n_passed"), F.countDistinct("scan_date").alias("n_dates"), F.countDistinct("symbol").alias("n_symbols"),
        F.min("scan_date").alias("first_date"), F.max("scan_date").alias("last_date"),
    )


def backfilled(rows: DataFrame, staged: DataFrame, key: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """rows with these columns taken from staged where the key is there, even if the staged value is null; others keep theirs."""
    new = staged.select(*key, F.lit(True).alias("_staged"), *(c(n).alias(f"_{n}") for n in columns))
    df = rows.join(new, list(key), "left")
    return df.withColumns({n: F.when(c("_staged"), c(f"_{n}")).otherwise(c(n)) for n in columns}).drop("_staged", *(f"_{n}" for n in columns))


def missing(wanted: DataFrame, have: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """What is still to be fetched or computed: keys that have no row yet."""
    return wanted.join(have.select(*key).distinct(), list(key), "left_anti")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
