"""What several operators need of the session: a shared folder, and tables written to it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets one of its own; a
    cluster is refused, as its executors do not see the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(root, exist_ok=True)
        found = f"file://{root}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Texts are long: batches of Spark's 10,000 rows would be tens of megabytes in the JVM and again in each Python worker.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in small batches, unless the session asks for a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


Batches = Iterator[pa.RecordBatch]


def beside(docs: DataFrame, make: Callable[[Batches], Batches], schema: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What make finds of (id, text), a row for each in their order, beside each document's own columns in the struct `row`.

    A verdict can so be taken in the task that holds the document: no join back, no shuffle of texts, and rows with null or
    repeated ids are judged each by itself.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    at_id, at_text = names.index(id_col), names.index(text_col)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows, done = batch.column(0), 0
            own = pa.RecordBatch.from_arrays([rows.field(at_id), rows.field(at_text)], names=["id", "text"])
            for found in make(iter([own])):
                yield pa.RecordBatch.from_arrays([*found.columns, rows.slice(done, found.num_rows)], names=[*found.schema.names, "row"])
                done += found.num_rows

    kind = StructType([*StructType.fromDDL(schema).fields]).add("row", docs.schema)
    return docs.select(F.struct("*").alias("row")).mapInArrow(run, kind)


class Scratch:
    """Tables of one run in the shared folder. Written tables cut lineage: a lost executor costs no recomputation of them.

    Results may still be read from them, so the folder goes when the driver ends; what is done with sooner is dropped by name.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))
        self._fs.deleteOnExit(self._path(self.path))

    def place(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        where = self.place(name)
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        """The tables of these names, or all."""
        if not names:
            self._fs.delete(self._path(self.path), True)
        elif self._fs.exists(self._path(self.path)):
            for held in self._fs.listStatus(self._path(self.path)):
                if held.getPath().getName().partition("-")[2] in names:
                    self._fs.delete(held.getPath(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
