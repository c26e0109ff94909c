"""Helpers shared by the training-data operators: shared scratch tables and input columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes up to which a list of keys is broadcast, with what a row of it takes in memory.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 128
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500
#: Characters of a plan's text; the driver keeps those of a thousand queries, and makes one anew whenever a stage ends.
_PLAN_TEXT, PLAN_TEXT = "spark.sql.maxPlanStringLength", 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset (tests on one machine) a local folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand Python workers at most BATCH_ROWS rows at a time, unless the session says how many: a batch of whole texts is held several times over. Texts of plans are cut for the driver's sake."""
    if spark.conf.get(_BATCH, "10000") == "10000":  # Spark's default
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if spark.conf.get(_PLAN_TEXT).rstrip("bB") == "2147483632":  # Spark's default
        spark.conf.set(_PLAN_TEXT, str(PLAN_TEXT))
    return spark


def give_back() -> None:
    """Hand freed memory back to the system: Python workers live on after a task, and what they have freed stays with the process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """work for mapInPandas that gives memory back when its task ends."""

    @functools.wraps(work)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


class Scratch:
    """Written tables in the shared folder; they cut lineage and survive lost executors.

    ``drop`` removes a table that no later plan reads; what is left goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = small_batches(spark)
        self.root = f"{shared_dir(spark)}/lattica-{what}-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _clear(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may have gone
            self._delete(self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")


def near(df: DataFrame) -> DataFrame:
    """A written list of keys, to be broadcast if it is small enough, else to be shuffled; ROW_BYTES is what a row of it takes in memory, at most."""
    return F.broadcast(df) if df.count() * ROW_BYTES <= BROADCAST_BYTES else df.hint("shuffle_merge")


#: Bits of a sieve for a key, and the bits that one row of it holds (as bitmap_construct_agg makes them).
SIEVE_BITS, _ROW_BITS = 16, 1 << 15


def sieved(df: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """df without most rows whose column is not among the wanted keys (written): what is left is small enough to be shuffled to an exact join.

    A bit for a key, in a broadcast table of BROADCAST_BYTES at most; no wanted row is dropped.
    """
    rows = max(1, min(BROADCAST_BYTES * 8, wanted.count() * SIEVE_BITS) // _ROW_BITS)
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(rows * _ROW_BITS))
    bits = wanted.select(bit(key).alias("b")).groupBy((F.col("b").bitwiseAND(F.lit(~(_ROW_BITS - 1)))).alias("_from")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(F.lit(_ROW_BITS - 1))).alias("_bits"))
    place = bit(column).bitwiseAND(F.lit(_ROW_BITS - 1))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.join(F.broadcast(bits), bit(column).bitwiseAND(F.lit(~(_ROW_BITS - 1))) == F.col("_from"))
    return found.where(F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1).select(*df.columns)


def drop_shuffles(spark: SparkSession) -> None:
    """Free the files of shuffles that no plan holds any more: Spark removes them when the driver's JVM collects, which it seldom does while data is large and plans are small. The driver's Python gives its own back, too."""
    give_back()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
