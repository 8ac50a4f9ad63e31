"""Tables in the folder that driver and executors share, and Arrow batches that Python workers get."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and everything runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="pagesieve-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives lost executors.

    Files are deleted when the application ends, since lazy results may still read them until then, or by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that stored() gave, once nothing will read them any more."""
    if path := getattr(df, "_stored_path", None):
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


Batches = Iterator[pa.RecordBatch]
#: Rows, and bytes of them, that go to a Python worker at once. Texts are long: the usual 10,000 would be tens of megabytes on both sides.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def small_batches(spark: SparkSession) -> None:
    """Python workers of this session get small Arrow batches, unless it says otherwise."""
    conf = spark.conf
    for key, usual, own in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, BATCH_BYTES)):
        if conf.get(key, usual) == usual:
            conf.set(key, own)


def mapped(df: DataFrame, run: Callable[[Batches], Batches], schema) -> DataFrame:
    """df.mapInArrow(run, schema) in small batches, unless the session says otherwise, by workers that give back what they have freed.

    Workers wait for their next task with all the memory that their last one had; of several kinds in a stage only
    some work at a time.
    """
    small_batches(df.sparkSession)

    def tidy(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim()

    return df.mapInArrow(tidy, schema)


def trim() -> None:
    """Give free memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
