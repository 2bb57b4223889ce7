"""Helpers shared by the operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBRARY = ctypes.CDLL(None)
#: A null doc_id counts as larger than any other; outputs show it as null again.
NO_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs on this machine alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="vectide-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _forget(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended before the interpreter
        pass


#: Rows of a few numbers that are worth a file of their own.
A_FILE = 200_000


def table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and a lost executor costs nothing.

    rows: about how many there are; so many files are written as they are worth,
    not one for every partition of the last exchange.
    """
    spark = df.sparkSession
    if rows is not None and 1 + rows // A_FILE < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(1 + rows // A_FILE)
    path = f"{shared_dir(spark)}/vectide-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffles of what is done: it does so when the driver's JVM collects, which learns a little late what Python has let go."""
    gc.collect()
    time.sleep(1)
    spark._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Delete what table() wrote and nothing reads any more, and the shuffles that are done."""
    for df in tables:
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            _forget(df.sparkSession, path)
    if tables:
        settle(tables[0].sparkSession)


def ids(column: str = "doc_id") -> Column:
    """The id as a long, nulls as NO_ID."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def shown(column: str) -> Column:
    """NO_ID as null."""
    return F.nullif(F.col(column), F.lit(NO_ID))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def by_bytes(texts: pa.Array, most: int):
    """Yield (start, stop) runs of rows whose bytes add up to about `most`, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    start = 0
    while start < len(sizes):
        stop = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, "right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def packed(docs: DataFrame, text_col: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """Rows of docs as one struct column `row`, and what reads the texts from a batch of them; a text goes to Python once.

    A text column that is no string is cast, into a column beside the row.
    """
    at = [k for k, f in enumerate(docs.schema.fields) if f.name.lower() == text_col.lower() and f.dataType.simpleString() == "string"]
    if at:
        return docs.select(F.struct("*").alias("row")), lambda b: b["row"].field(at[0])
    return docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text")), lambda b: b["text"]


def release() -> None:
    """Give memory that a task has freed back to the system: its worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBRARY, "malloc_trim", None):  # the C library has it
        trim(0)
