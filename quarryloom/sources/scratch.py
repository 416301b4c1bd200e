"""Tables that a query writes once and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; a cluster is refused, as its executors do not see the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def place(spark: SparkSession, name: str) -> str:
    """A new folder's path; what is written there goes when the driver ends."""
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path.getParent())
    store.deleteOnExit(path)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table of its own: its lineage is cut, and it is computed once however often it is read. The table goes when the driver ends."""
    where = place(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


#: Tables that the query at work shares between its parts: where they are, and their schemas.
_TABLES: ContextVar[dict | None] = ContextVar("tables", default=None)


def scoped(query: Query) -> Query:
    """The query with shared tables of its own: nothing is kept from one call to another."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _TABLES.set({})
        try:
            return query(spark, sf_dir)
        finally:
            _TABLES.reset(token)

    return run


def shared(make: Query) -> Query:
    """Within a scoped query, what make gives is written once and read wherever the query asks for it again; elsewhere it is a plan as any other."""

    @functools.wraps(make)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = _TABLES.get()
        if held is None:
            return make(spark, sf_dir)
        key = (make.__module__, make.__qualname__, sf_dir)
        if key not in held:
            df = make(spark, sf_dir)
            where = place(spark, make.__name__)
            df.write.parquet(where)
            held[key] = where, df.schema
        where, schema = held[key]
        return spark.read.schema(schema).parquet(where)

    return get
