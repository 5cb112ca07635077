"""Incremental ingestion: new files become chunks exactly once, with a row per stage of each batch, told as it ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS
from ..operators import profile, store
from ..plans.api import Engine

BINARY = "path string, modificationTime timestamp, length long, content binary"
JOBS = "job_id string, status string, rows long, error string, ts timestamp"
#: How long a file's content is remembered by the stream itself; the registry remembers it for good.
REMEMBERED = "1 hour"


def stream_files(engine: Engine, path: str, conversation_id: str, checkpoint: str, jobs: str, glob: str = "*") -> StreamingQuery:
    """Index what arrives below ``path`` until nothing is left; stages go to ``jobs``.

    Files of equal content that arrive close together are one by the stream's state. A batch's chunks, registry rows and its number in the
    ledger become visible as one change, so a batch that died anywhere leaves nothing and, run again, counts once.
    """
    spark = engine.spark

    def index(rows: DataFrame, batch: int) -> None:
        last = [0]

        def say(stage: str, n: int, error: str | None = None) -> None:
            last[0] = n
            row = spark.createDataFrame([(f"batch-{batch}", stage, n, error)], "job_id string, status string, rows long, error string")
            row.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(jobs)

        say("queued", 0)
        try:
            n = engine.ingest_files(rows.withColumn("filename", F.element_at(F.split("path", "/"), -1)), conversation_id, say, (checkpoint, batch))
        except Exception as e:
            say("error", last[0], str(e)[:500])
            raise
        say("done", n)

    source = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).load(path)
    source = source.where(F.col("length") <= engine.settings.max_upload_mb * 1024 * 1024)
    # the clock is that of arrival, so no file is late
    once = source.withColumns({"seen_hash": store.file_hash(F.col("content")), "seen_at": F.current_timestamp()}).withWatermark("seen_at", REMEMBERED).dropDuplicatesWithinWatermark(["seen_hash"])
    return once.drop("seen_hash", "seen_at").writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(spark: SparkSession, jobs: str, job_id: str | None = None, ttl_seconds: int = DEFAULTS.job_ttl_seconds) -> DataFrame:
    """``job_id, status, rows, error, ts``: the latest state of each job, or of one; jobs that were not heard of for the time to live are gone."""
    rows = spark.read.schema(JOBS).parquet(jobs)
    rows = rows if job_id is None else rows.where(F.col("job_id") == job_id)
    place = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(("queued", "parsing", "chunking", "embedding", "done", "error")) for x in (s, i)]), F.col("status"))
    latest = profile.latest_state(rows.withColumn("place", place), "job_id", "ts", "place").drop("place")
    return latest.where(F.col("ts") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(ttl_seconds)))
