"""Files below one folder of any Hadoop file system: objects of uploads and reports, and fact files, one per conversation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


class ObjectStore:
    """Whole objects by name. Single objects pass through the driver, as uploads and reports do; many are read as a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _target(self, name: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def put(self, name: str, data: bytes) -> str:
        """Write an object, making the folder on first use; its path."""
        fs, target = self._target(name)
        out = fs.create(target, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return str(target.toString())

    def exists(self, name: str) -> bool:
        fs, target = self._target(name)
        return bool(fs.exists(target))

    def delete(self, name: str) -> bool:
        """Whether there was anything to delete."""
        fs, target = self._target(name)
        return bool(fs.delete(target, True))

    def get(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        return bytes(self.spark.read.format("binaryFile").load(f"{self.path}/{name}").select("content").first()[0])

    def table(self, glob: str = "*") -> DataFrame:
        """``path, modificationTime, length, content`` of all objects that match."""
        return self.spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(self.path)


def safe_id(conversation_id: str) -> str:
    return "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in conversation_id) or "default"


class FactFiles:
    """Long-term facts of conversations as JSON of version 2; ``sources.files.fact_files`` reads a folder of them."""

    def __init__(self, objects: ObjectStore):
        self.objects = objects

    def save(self, conversation_id: str, facts: list[dict]) -> str:
        return self.objects.put(f"{safe_id(conversation_id)}.json", json.dumps({"version": 2, "facts": facts}, ensure_ascii=False, default=str).encode())

    def exists(self, conversation_id: str) -> bool:
        return self.objects.exists(f"{safe_id(conversation_id)}.json")

    def delete(self, conversation_id: str) -> bool:
        return self.objects.delete(f"{safe_id(conversation_id)}.json")


def fact_documents(facts: DataFrame) -> DataFrame:
    """``conversation_id, name, body``: the fact files of many conversations as rows (conversation_id, pos, text, category, importance, updated_at)."""
    item = F.struct("text", "category", "importance", F.col("updated_at").cast("string").alias("updated_at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("f")))), lambda x: x["f"])
    made = facts.groupBy("conversation_id").agg(ordered.alias("facts"))
    return made.select("conversation_id", F.concat(T.safe_id(F.col("conversation_id")), F.lit(".json")).alias("name"), F.to_json(F.struct(F.lit(2).alias("version"), "facts")).alias("body"))
