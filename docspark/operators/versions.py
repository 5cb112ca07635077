"""Parquet tables that change together: new files first, one small pointer last.

Tables are dealt into buckets by a hash of a common key. A change writes the rows of the buckets that it touches into new folders and then
puts a manifest that names, for each table and bucket, the folders to read, under the next number. Putting it is one rename that
fails if the number is taken: a writer that dies in between changes nothing, of two writers one wins, and a reader sees one version.
A manifest also holds the last batch of each stream that wrote, so that a batch which runs again can be told.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of a bucket beyond which a change that touches it rewrites it as one.
MOST_FOLDERS = 16


class VersionedTables:
    """Tables below ``path`` by name and schema; ``key`` is a column of each, ``bucket`` is one that is added."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], key: str, buckets: int = 64):
        self.spark, self.path, self.schemas, self.key, self.buckets = spark, path.rstrip("/"), schemas, key, buckets

    # ---- files

    def _fs(self, name: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, folder: str) -> list[str]:
        fs, target = self._fs(folder)
        return [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []

    def _delete(self, name: str) -> None:
        fs, target = self._fs(name)
        fs.delete(target, True)

    def manifest(self) -> tuple[int, dict]:
        """The latest version's number and manifest; it is as long as there are buckets in use and folders in them."""
        found = [int(x) for x in self._names("manifests") if x.isdigit()]
        if not found:
            return 0, {"tables": {}, "batches": {}}
        fs, target = self._fs(f"manifests/{max(found)}")
        stream = fs.open(target)
        try:
            return max(found), json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, number: int, manifest: dict) -> None:
        fs, made = self._fs(f"manifests/_{uuid.uuid4().hex}")
        out = fs.create(made)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm, target = self.spark.sparkContext._jvm, self._fs(f"manifests/{number}")[1]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(made, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))  # raises if the number is taken

    # ---- reading

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def number(self, key: str) -> int:
        return self.spark.range(1).select(self.bucket(F.lit(key))).first()[0]

    def rows(self, name: str, held: dict[str, list[str]]) -> DataFrame:
        """The rows of some buckets' folders; a filter on ``bucket`` prunes them."""
        schema, by_folder, out = f"{self.schemas[name]}, bucket int", {}, None
        for bucket, folders in sorted(held.items()):
            for folder in folders:
                by_folder.setdefault(folder, []).append(f"{self.path}/{folder}/bucket={bucket}")
        for folder, paths in sorted(by_folder.items()):
            part = self.spark.read.schema(schema).option("basePath", f"{self.path}/{folder}").parquet(*paths)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        return self.rows(name, self.manifest()[1]["tables"].get(name, {}))

    def of(self, name: str, key: str) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        number = str(self.number(key))
        held = {b: f for b, f in self.manifest()[1]["tables"].get(name, {}).items() if b == number}
        return self.rows(name, held).where((F.col("bucket") == int(number)) & (F.col(self.key) == key))

    def has_batch(self, stream: str, number: int) -> bool:
        return self.manifest()[1]["batches"].get(stream, -1) >= number

    # ---- changing

    def change(self) -> Change:
        return Change(self)

    def replace(self, name: str, rows: DataFrame, keys: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Put ``rows`` in place of all rows of ``keys`` (a column named as the key); other keys stay. At most one number per bucket reaches the driver."""
        keys = keys.select(self.key).distinct()
        touched = [r[0] for r in keys.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()]
        change = self.change()
        if touched:
            stay = change.rows(name, touched).join(keys, self.key, "left_anti")
            columns = [f.name for f in T._parse_datatype_string(self.schemas[name]).fields]
            change.rewrite(name, touched, stay.select(*columns).unionByName(rows.select(*columns)))
        change.commit(batch)

    def vacuum(self) -> int:
        """Delete what the latest version does not name; the number of folders. Readers and writers must have ended."""
        latest, manifest = self.manifest()
        used = {f.split("/")[1] for t in manifest["tables"].values() for fs in t.values() for f in fs}
        gone = [f"data/{x}" for x in self._names("data") if x not in used]
        for x in gone + [f"manifests/{x}" for x in self._names("manifests") if x != str(latest)] + ["aside"]:
            self._delete(x)
        return len(gone)


class Change:
    """What becomes of a version; nothing of it is seen before ``commit``."""

    def __init__(self, tables: VersionedTables):
        self.tables = tables
        self.version, self.manifest = tables.manifest()

    def _held(self, name: str) -> dict[str, list[str]]:
        return self.manifest["tables"].setdefault(name, {})

    def rows(self, name: str, buckets: list[int]) -> DataFrame:
        return self.tables.rows(name, {b: f for b, f in self._held(name).items() if int(b) in buckets})

    def _written(self, name: str, rows: DataFrame) -> tuple[str, list[str]]:
        t, folder = self.tables, f"data/{uuid.uuid4().hex}"
        kinds = T._parse_datatype_string(t.schemas[name]).fields
        made = rows.select(*[F.col(f.name).cast(f.dataType) for f in kinds]).withColumn("bucket", t.bucket(F.col(t.key)))
        # a bucket is one task's only as long as it is small: what is beyond the session's advised size is dealt over several
        made.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{t.path}/{folder}")
        return folder, [x.removeprefix("bucket=") for x in t._names(folder) if x.startswith("bucket=")]

    def append(self, name: str, rows: DataFrame) -> None:
        folder, buckets = self._written(name, rows)
        held = self._held(name)
        for b in buckets:
            held.setdefault(b, []).append(folder)
        if full := [int(b) for b in buckets if len(held[b]) > MOST_FOLDERS]:
            self.rewrite(name, full, self.rows(name, full).drop("bucket"))

    def rewrite(self, name: str, buckets: list[int], rows: DataFrame) -> None:
        """``rows`` become all that ``buckets`` hold."""
        folder, written = self._written(name, rows)
        held = self._held(name)
        for b in map(str, buckets):
            held.pop(b, None)
        for b in written:
            held[b] = [folder]

    def commit(self, batch: tuple[str, int] | None = None) -> None:
        if batch:
            self.manifest["batches"][batch[0]] = batch[1]
        self.tables._put(self.version + 1, self.manifest)
