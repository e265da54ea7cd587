"""Helpers shared by the operators: inputs, shared scratch tables, safe column names."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name`` below ``sf_dir``, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_value(module: str) -> None:
    """Pickle a module's functions by value, so that executors need no copy of the repository."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and the master is local (tests, a laptop) a
    temporary folder takes its place; on a cluster without it this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes an execution's shuffle files as soon as it ends, rather than when the driver collects garbage."""
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within, a setting of the session has this value."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Written tables in the shared folder: they cut lineage and outlive an executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, hashes: bool = False) -> DataFrame:
        """Write ``df`` as Parquet and read it again; ``drop`` deletes it by its path. Tables of ``hashes`` get no dictionaries."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        with shuffles_dropped(self.spark):
            self._writer(df, hashes).parquet(path)
        return self._read(df, path)

    def save_apart(self, df: DataFrame, column: str, parts: list[list[int]]) -> list[DataFrame]:
        """Write ``df`` in a folder for each value of an integer column, and read those of each of ``parts``; ``drop`` deletes a part of one value."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        # a file for each value is open at once, so rows need not be sorted by it
        with shuffles_dropped(self.spark), _set(self.spark, "spark.sql.maxConcurrentOutputFileWriters", "8"):
            self._writer(df, True).partitionBy(column).parquet(path)
        whole, out = self._read(df, path), []
        for values in parts:
            out.append(whole.where(F.col(column).isin(values)).select(*df.columns))
            out[-1]._scratch_path = f"{path}/{column}={values[0]}"  # type: ignore[attr-defined]
        return out

    def _writer(self, df: DataFrame, hashes: bool) -> DataFrameWriter:
        return df.write.option("parquet.enable.dictionary", str(not hashes).lower())

    def _read(self, df: DataFrame, path: str) -> DataFrame:
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        self._delete(df._scratch_path)  # type: ignore[attr-defined]

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of an Arrow batch at most; texts may be long, and a Python worker holds a batch at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches of bounded size, unless the session has smaller ones already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def held_out(doc_id: Column, mod: int) -> Column:
    """Whether crc32 of the id as text is divisible by ``mod``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == 0, F.lit(False))


by_value(__name__)
