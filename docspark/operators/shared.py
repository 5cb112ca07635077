"""Tables that an operator writes on its way, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that become Python objects at a time; a row is never cut.
SLICE = 1 << 20

_own: list[str] = []
_kept: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this process only where all runs on one machine (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="docspark-"))
    return f"file://{_own[0]}"


def folder(spark: SparkSession) -> str:
    """A new folder's name; what is there when the process ends is deleted."""
    path = f"{shared_dir(spark)}/docspark-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written and read again: worked out once, and not lost with an executor. Deleted when the process ends."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's rows of about ``most`` bytes each (``SLICE``), all rows in order; a longer row is a range of its own."""
    most, a = most or SLICE, 0
    while a < batch.num_rows:
        n = batch.num_rows - a
        while n > 1 and batch.slice(a, n).nbytes > most:
            n //= 2
        yield a, a + n
        a += n


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _tidy() -> None:
    while _kept:
        try:
            delete(*_kept.pop())
        except Exception:  # the session has ended
            return
