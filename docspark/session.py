"""Session with the settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: The state store that streams with timers and time to live need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def create_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``master`` and the number of shuffle partitions are the cluster's unless given."""
    builder = SparkSession.builder.appName("docspark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    builder = builder.config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
