"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Python slice of an Arrow batch: bounds what is held as Python objects at once.
SLICE_ROWS = 256
#: Output bytes after which a mapInArrow function hands a batch back.
FLUSH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and all runs on one machine, as in tests, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        else:
            found = tempfile.mkdtemp(prefix="quadrel-")
            spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there.

    A lost executor loses none of it, and nothing above is computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the table that materialise() wrote for df, which nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast of df only after counting that its rows fit limit_bytes.

    Beyond the bound df is returned as it is and Catalyst joins it by shuffle.
    """
    most = limit_bytes // row_bytes
    n = df.select(F.lit(1)).limit(most + 1).count()
    return F.broadcast(df) if n <= most else df


def once(value: Column) -> Column:
    """The same value, computed before what follows.

    Generated code puts off a column until it is used, so within the loop of an explode it would be
    computed for each element; one that isn't deterministic, as this looks, is computed at once.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 1000):
    """Fewer rows in an Arrow batch for what is run inside, as whole texts are sent by pairs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return what this worker has freed to the system: idle workers stay, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch, *columns: str):
    """Lists of the named columns' Python values, SLICE_ROWS at a time."""
    picked = [batch.column(batch.schema.get_field_index(c)) for c in columns]
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield tuple(c.slice(at, SLICE_ROWS).to_pylist() for c in picked)
