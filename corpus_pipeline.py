"""The corpus pipeline: five stages over ``documents``, each reading what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it again for the next one.

What holds for all stages: only the columns of ``documents`` are read, so any other column may be there under any name; texts of any
length are worked on whole; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import near_dedup, packing, quality_rules, secrets, suffix_dedup
from docspark.llm.common import drop_written, materialise, read_table, written
from docspark.llm.queries import BYTE_TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep.

    A null or empty text has no words and is rejected; null and empty sources are one host; a host at the limit is kept; repeated rows
    are judged one by one and share their fate.
    """
    return quality_rules.apply_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least id; one without an id only where no other is there.

    Rows are told apart by a 64-bit hash of all columns, as ids may repeat or be missing. Equal rows count as copies of each other, so one
    stays; of rows that tie by id the one of least hash stays. Texts that are null or without words are no copies of each other.
    """
    docs = docs.select(*COLUMNS)
    docs = docs.withColumn("row", F.xxhash64(*[x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]))
    groups = near_dedup.near_duplicates(docs.select("row", "text"), doc_id="row").groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component"))
    rows = docs.groupBy("row").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    first = rows.join(groups, "row").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "n")).alias("first"))
    first = materialise(first.select("first.row", "first.n"))
    stays = docs.join(first, "row")
    return stays.where("n = 1").unionByName(stays.where("n > 1").dropDuplicates(["row"])).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without byte strings that repeat; the bytes left of a character that a cut breaks go too.

    A null text becomes empty; a text that is wholly made of repeats stays as an empty one; rows that repeat lose all long texts they
    share, as every occurrence goes.
    """
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), as_text=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind.

    Spans that overlap or touch the same stretch are one replacement, named by the first; a null text has none and stays null; rows are
    independent, so repeated rows repeat.
    """
    found = secrets.redact(secrets.find_secrets(docs.select(*COLUMNS))).drop("spans")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces that fill the training windows.

    A null or empty text is its end mark alone; equal fill levels go to the fullest; repeated rows each get their pieces; a null id is
    carried along.
    """
    return packing.pack(docs, BYTE_TOKENIZER)


STAGES = [("quality rules", rules), ("near dedup", near), ("suffix dedup", repeats), ("secret scans", redacted), ("packing", packed)]

#: No SQL says what hashing, suffix sorting, nested decoding and online packing do; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = read_table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        drop_written(mark, but_last=True)  # a stage's working tables, and what the one before it kept
    return STAGES[-1][1](spark, docs, sf_dir)
