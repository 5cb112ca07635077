"""State that lasts: streams against their batch versions, versions of tables, and what is left when a writer dies in between."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from docspark.config import DEFAULTS, Settings
from docspark.operators import memory, profile, store, versions
from docspark.plans.api import Engine
from docspark.streaming.ingest import job_states, stream_files
from docspark.streaming.memory import compacted, remembered

SMALL = Settings(compact_messages=4, compact_chars=600, keep_messages=2)
START = 1_700_000_000


def fed(spark, rows, folder, parts):
    """A stream of ``rows`` in batches, one for each of ``parts``."""
    for i, part in enumerate(parts):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_short_memory_equals_batch(spark, sf_dir, tmp_path):
    """Conversations in three batches, with a pause of exactly the idle time before turn 3 of some: sessions and cuts are those of the batch functions."""
    pause = F.when(F.col("turn") >= 3, F.when(F.col("conv_id") % 3 == 0, 1790).when(F.col("conv_id") % 3 == 1, 1789).otherwise(5000)).otherwise(0)
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("ts", F.timestamp_seconds(START + F.col("turn") * 10 + pause))
    source = fed(spark, said, str(tmp_path / "in"), ["turn <= 1", "turn between 2 and 3", "turn > 3"]).withWatermark("ts", "0 seconds")
    out = str(tmp_path / "out")
    q = compacted(source, SMALL, "ts").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = spark.read.parquet(out)
    sessions = profile.idle_sessions(said, "conv_id", "ts", "turn").withColumn("key", F.concat_ws("/", "conv_id", "session_no"))
    want = memory.compaction_points(sessions, "key", most=4, chars=600, keep=2).join(sessions.select("key", "conv_id", "turn"), ["key", "turn"])
    rows = lambda df: {(r["conv_id"], r["turn"], r["compacted"]) for r in df.collect()}
    messages = got.where("not ended")
    assert messages.count() == said.count() and rows(messages) == rows(want.withColumnRenamed("compacts", "compacted"))
    assert all((r["snapshot"] is not None) == r["compacted"] for r in messages.collect())
    # a pause of 1,800 seconds ends a conversation, one of 1,799 does not
    paused = {r["conv_id"] for r in said.where("turn >= 3").select("conv_id").distinct().collect()}
    over = {r["conv_id"] for r in got.where("ended").collect()}
    assert {c for c in paused if c % 3 != 1} <= over and DEFAULTS.idle_seconds == 1800
    broken = {r["conv_id"] for r in sessions.where("session_no > 1").select("conv_id").distinct().collect()}
    assert broken == {c for c in paused if c % 3 != 1}


def test_idle_conversations_end_by_processing_time(spark, tmp_path):
    said = spark.createDataFrame([(c, t, "user", f"message {t} of {c}") for c in (1, 2) for t in range(3)], "conv_id long, turn long, role string, text string")
    source = fed(spark, said, str(tmp_path / "in"), ["true"])
    q = compacted(source, Settings(idle_seconds=3)).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    end = time.time() + 120
    while time.time() < end and spark.table("idle").where("ended").count() < 2:
        time.sleep(1)
    q.stop()
    assert {(r["conv_id"], r["snapshot"].count("\n")) for r in spark.table("idle").where("ended").collect()} == {(1, 2), (2, 2)}


def test_snapshots_become_stored_facts_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "likes tea"), (1, "likes teas"), (2, "works in Rome"), (3, None), (4, "bad")], "conv_id long, snapshot string")
    source = fed(spark, rows, str(tmp_path / "in"), ["conv_id = 1", "conv_id > 1"])

    def extract(text):
        if text == "bad":
            raise ValueError
        return f'Here: {{"facts": [{{"text": "{text}", "category": "Preference", "importance": 9}}]}}'

    facts, checkpoint = memory.fact_table(spark, str(tmp_path / "facts"), 4), str(tmp_path / "cp")
    q = remembered(source, facts, extract, checkpoint)
    end = time.time() + 180
    while time.time() < end and not facts.has_batch(checkpoint, 1):
        time.sleep(1)
    q.stop()
    held = {(r["conversation_id"], r["category"], r["importance"]) for r in facts.read("facts").collect()}
    assert held == {("1", "preference", 5), ("2", "preference", 5)} and facts.of("facts", "1").count() == 1
    version = facts.manifest()[0]
    assert facts.has_batch(checkpoint, 1) and not facts.has_batch(checkpoint, 2) and not facts.has_batch("other", 0)
    new = spark.createDataFrame([("1", 0, "has a cat", "fact", 2, dt.datetime(2024, 1, 1))], memory.FACTS)
    memory.remember(facts, new, spark.createDataFrame([("2", "works in rome")], "conversation_id string, text string"))
    assert facts.manifest()[0] == version + 1
    assert sorted((r["conversation_id"], r["pos"], r["text"]) for r in facts.read("facts").collect())[-1][1:] == (1, "has a cat") and facts.of("facts", "2").count() == 0


@pytest.fixture
def filled(spark, tmp_path):
    made = store.ChunkStore(spark, str(tmp_path / "store"), buckets=4, dim=1)
    add(spark, made, "c1", "d1", 3)
    add(spark, made, "c2", "d2", 2)
    return made


def rows_of(spark, conv, doc, n, tag="a"):
    chunks = spark.range(n).select(F.lit(conv).alias("conversation_id"), F.lit(doc).alias("document_id"), F.lit("f").alias("source"), F.lit(0).alias("page"), F.col("id").alias("chunk_index"), F.lit(n).alias("total_chunks"), F.concat(F.lit(tag), "id").alias("text"), F.array(F.lit(1.0)).alias("embedding"), *[F.lit(None).cast("string").alias(c) for c in ("file_type", "chunk_type", "sheet_name", "row_range")])
    registry = spark.createDataFrame([(conv, tag, "f", "f", "txt", n, dt.datetime(2024, 1, 1), doc)], store.REGISTRY)
    return chunks, registry


def add(spark, made, conv, doc, n):
    made.add(*rows_of(spark, conv, doc, n))


def counts(made):
    return {c: (made.chunks(c).count(), made.registered(c).count()) for c in ("c1", "c2")}


@pytest.mark.parametrize("dies", ["_written", "_put"])
def test_a_change_that_dies_leaves_the_old_version(spark, filled, monkeypatch, dies):
    target = versions.Change if dies == "_written" else versions.VersionedTables
    real, calls = getattr(target, dies), []

    def die(self, *args):
        calls.append(args)
        if dies == "_put" or args[0] == "registry":
            raise RuntimeError("gone")
        return real(self, *args)

    monkeypatch.setattr(target, dies, die)
    for change in (lambda: add(spark, filled, "c1", "d3", 4), lambda: filled.delete_conversation("c1"), lambda: filled.reindex("d1", "c1", *rows_of(spark, "c1", "d1", 7, "new"))):
        with pytest.raises(RuntimeError):
            change()
        assert counts(filled) == {"c1": (3, 1), "c2": (2, 1)}
    monkeypatch.setattr(target, dies, real)
    assert len(calls) >= 3 and filled.reindex("d1", "c1", *rows_of(spark, "c1", "d1", 7, "new")) == 7
    assert counts(filled) == {"c1": (7, 1), "c2": (2, 1)} and {r["text"][:3] for r in filled.chunks("c1").collect()} == {"new"}
    assert filled.tables.vacuum() > 0 and counts(filled) == {"c1": (7, 1), "c2": (2, 1)}


def test_of_two_writers_one_wins(spark, filled):
    first, second = filled.tables.change(), filled.tables.change()
    for change in (first, second):
        change.append("chunks", rows_of(spark, "c2", "d9", 1)[0])
    first.commit()
    with pytest.raises(Exception, match="(?i)exist"):
        second.commit()
    assert filled.chunks("c2").count() == 3


def test_many_small_additions_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MOST_FOLDERS", 3)
    made = store.ChunkStore(spark, str(tmp_path / "store"), buckets=1, dim=1)
    for i in range(6):
        add(spark, made, "c1", f"d{i}", 2)
    assert made.chunks("c1").count() == 12 and all(len(f) <= 3 for t in made.tables.manifest()[1]["tables"].values() for f in t.values())


def test_a_killed_batch_adds_nothing_twice(spark, tmp_path, monkeypatch):
    """The stream dies after the chunks are written and before the registry is; started anew, it adds each chunk once and tells right counts."""
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(f"File number {i} tells of cloves and tea. It is long enough to be kept.")
    (tmp_path / "in" / "copy.txt").write_text("File number 0 tells of cloves and tea. It is long enough to be kept.")
    engine, jobs = Engine(spark, str(tmp_path / "store")), str(tmp_path / "jobs")
    start = lambda: stream_files(engine, str(tmp_path / "in"), "c1", str(tmp_path / "cp"), jobs)
    real = versions.Change.append

    def die(self, name, rows):
        if name == "registry":
            raise RuntimeError("killed")
        real(self, name, rows)

    monkeypatch.setattr(versions.Change, "append", die)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination(180)
    assert engine.store.read("chunks").count() == 0
    state = job_states(spark, jobs).first()
    assert (state["status"], state["rows"]) == ("error", 3) and "killed" in state["error"]
    assert {(r["status"], r["rows"]) for r in spark.read.parquet(jobs).collect()} == {("queued", 0), ("parsing", 3), ("chunking", 3), ("embedding", 3), ("error", 3)}
    monkeypatch.setattr(versions.Change, "append", real)
    assert start().awaitTermination(180)
    assert engine.store.read("chunks").count() == 3 and engine.store.read("registry").count() == 3
    assert job_states(spark, jobs, "batch-0").first()["status"] == "done" and job_states(spark, jobs, ttl_seconds=-60).count() == 0
    assert engine.ingest_files(engine.spark.createDataFrame([], "path string, filename string, content binary"), "c1", batch=(str(tmp_path / "cp"), 0)) == 0
    assert start().awaitTermination(180) and engine.store.read("chunks").count() == 3
