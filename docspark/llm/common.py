"""Helpers that every training-data operator shares: table access, shared working storage, Arrow batching."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The white space that separates words in every contract of this subpackage: U+0020 and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch on its way to Python while a table is written, where the session has such a limit.
BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "16777216"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where all run on one machine (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        global _own
        _own = _own or tempfile.mkdtemp(prefix="docspark-")
        found = f"file://{_own}"
    return found.rstrip("/")


_own = ""
_written: list[tuple[SparkSession, str]] = []


def materialise(df: DataFrame, *sort: str, batch: str = "") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: cuts lineage, survives lost executors.

    Where the session limits the bytes of an Arrow batch, they are ``BATCH`` at most meanwhile; ``batch`` sets such a limit in any case.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docspark-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_SETTING, None)
    if batch or before is not None:
        spark.conf.set(BATCH_SETTING, batch or BATCH)
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(BATCH_SETTING, before)
        elif batch:
            spark.conf.unset(BATCH_SETTING)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables ``materialise`` has written that are still there; a mark for ``drop_written``."""
    return len(_written)


def drop_written(start: int = 0, but_last: bool = False) -> None:
    """Delete the tables that ``materialise`` has written since the mark ``start``; results that still read them become unreadable."""
    last = _written[-1:] if but_last else []
    gone = _written[start : len(_written) - len(last)]
    _written[start:] = last
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended
            return


atexit.register(drop_written)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a piece hold about ``most`` bytes (one longer text stays whole)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
