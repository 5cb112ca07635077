"""Conversation memory: recent windows, compaction, facts and their merging, rendering and eviction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as T
from . import fuzzy
from .folds import fold
from .shared import kept
from .versions import VersionedTables

FACTS = "conversation_id string, pos int, text string, category string, importance int, updated_at timestamp"
CATEGORIES = ("preference", "decision", "task", "fact")


def recent(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", n: int = DEFAULTS.prompt_messages) -> DataFrame:
    last = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    return messages.withColumn("_r", last).where(F.col("_r") <= n).drop("_r")


def prompt_lines(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", n: int = DEFAULTS.prompt_messages) -> DataFrame:
    """One text per conversation: its last messages as ``Role: text``."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l")))), lambda x: x["l"])
    return recent(messages, conv, turn, n).groupBy(conv).agg(F.array_join(parts, "\n").alias("prompt"))


def compaction_points(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", most: int = DEFAULTS.compact_messages, chars: int = DEFAULTS.compact_chars, keep: int = DEFAULTS.keep_messages) -> DataFrame:
    """``conv, turn, compacts``: after which message short memory is cut back to its last ``keep`` messages.

    The counters start anew at each cut, so this is a fold over a conversation's ordered lengths, not a window; it holds the lengths
    of the messages in memory, ``most`` at most.
    """

    def step(held: list[int] | None, row: tuple) -> tuple[list[int], tuple]:
        held = [*(held or []), row[0]]
        cut = len(held) > most or sum(held) > chars
        return held[-keep:] if cut else held, (cut,)

    lengths = messages.select(conv, turn, F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return fold(lengths, conv, [turn], ["n"], step, "compacts boolean").select(conv, turn, "compacts")


def evicted(facts: DataFrame, conv: str, order: str, most: int = DEFAULTS.max_facts) -> DataFrame:
    """The facts a store keeps: the least important and oldest beyond ``most`` go, the earliest among equals first."""
    place = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc("importance"), F.desc("updated_at"), F.desc(order)))
    return facts.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")


def rendered(facts: DataFrame, conv: str, order: str, budget: int = DEFAULTS.fact_chars) -> DataFrame:
    """One text per conversation: its facts by importance and recency, as far as the budget goes; the first always stays."""
    by = Window.partitionBy(conv).orderBy(F.desc("importance"), F.desc("updated_at"), order)
    line = F.concat(F.lit("- ["), F.col("category"), F.lit("] "), F.col("text"))
    placed = facts.withColumn("line", line).withColumns({"_r": F.row_number().over(by), "_s": F.sum(F.length("line") + 1).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_r", "line"))), lambda x: x["line"])
    return placed.where((F.col("_s") <= budget) | (F.col("_r") == 1)).groupBy(conv).agg(F.array_join(parts, "\n").alias("facts"))


def facts_of(snapshots: DataFrame, extract: Callable[[str], str], conv: str = "conv_id", snapshot: str = "snapshot") -> DataFrame:
    """``conv, pos, text, category, importance``: what an extractor's JSON (``{"facts": [...]}``) says of snapshots, tidied.

    An extractor that fails, or whose answer holds no such object, gives no facts.
    """
    kind = dict(snapshots.dtypes)[conv]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = []
            for text in f[snapshot]:
                try:
                    said.append(extract(text))
                except Exception:
                    said.append("")
            yield pd.DataFrame({conv: f[conv], "said": said})

    told = snapshots.where(F.col(snapshot).isNotNull()).select(conv, snapshot).mapInPandas(run, f"{conv} {kind}, said string")
    read = F.try_variant_get(T.salvage_json(F.col("said")), "$.facts", "array<struct<text:string,category:string,importance:string>>")
    return told.select(conv, F.posexplode(cleaned(read)).alias("pos", "f")).select(conv, "pos", "f.*")


def cleaned(raw: Column) -> Column:
    """An extractor's facts (array of text, category, importance): unknown categories become ``fact``, importance 1 to 5, blanks go."""
    known = F.array(*map(F.lit, CATEGORIES))
    tidy = F.transform(
        raw,
        lambda x: F.struct(
            T.clean(x["text"]).alias("text"),
            F.when(F.array_contains(known, F.lower(x["category"])), F.lower(x["category"])).otherwise("fact").alias("category"),
            F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(x["importance"].try_cast("int"), F.lit(3)))).alias("importance"),
        ),
    )
    return F.filter(tidy, lambda x: x["text"] != "")


def alike(a: str, b: str, least: float = DEFAULTS.fact_similarity) -> bool:
    return fuzzy.alike(a, b, least)


def merge(stored: DataFrame, incoming: DataFrame, removed: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Facts after an update of each conversation: removals first, then each new fact in place of the first alike, else at the end.

    stored and incoming: conversation_id, pos, text, category, importance, updated_at; removed: conversation_id, text. Removals are a
    join. Which fact a new one replaces depends on those before it, hence one task per conversation for that: a store holds ``max_facts``.
    """
    columns = ["conversation_id", "pos", "text", "category", "importance", "updated_at"]
    named = stored.select(*columns).withColumn("row", F.to_json(F.struct("conversation_id", "pos")))
    stored = fuzzy.without_alike(named, removed.select("conversation_id", "text"), "row", "text", ["conversation_id"], settings.fact_similarity)
    rows = stored.select(F.lit(0).alias("step"), *columns).unionByName(incoming.select(F.lit(2).alias("step"), *columns))

    def run(facts: pa.Table) -> pa.Table:
        step, pos, texts, importance, updated = (facts.column(c).to_pylist() for c in ("step", "pos", "text", "importance", "updated_at"))
        order = sorted(range(len(step)), key=lambda i: (step[i], pos[i] is None, pos[i] or 0))
        store = [i for i in order if step[i] == 0]  # numbers of rows
        forms = [fuzzy.form(texts[i]) for i in store]
        for i in order[len(store) :]:
            new = fuzzy.Against(fuzzy.form(texts[i]))
            at = next((j for j, x in enumerate(forms) if new.reached_by(x, settings.fact_similarity)), None)
            if at is None:
                store.append(i)
                forms.append(new.form)
            else:
                store[at], forms[at] = i, new.form
        places = list(range(len(store)))
        if (over := len(store) - settings.max_facts) > 0:
            least = lambda x: (x is not None, x or 0)
            drop = set(sorted(places, key=lambda p: (least(importance[store[p]]), least(updated[store[p]])))[:over])
            places = [p for p in places if p not in drop]
        left = facts.select(columns).take(pa.array([store[p] for p in places], pa.int64()))
        return left.set_column(1, "pos", pa.array(places, pa.int32()))

    return rows.groupBy("conversation_id").applyInArrow(run, FACTS)


def fact_table(spark: SparkSession, path: str, buckets: int = 64) -> VersionedTables:
    """The stored facts of all conversations, one versioned table named ``facts``."""
    return VersionedTables(spark, path, {"facts": FACTS}, "conversation_id", buckets)


def remember(facts: VersionedTables, incoming: DataFrame, removed: DataFrame | None = None, settings: Settings = DEFAULTS, batch: tuple[str, int] | None = None) -> None:
    """Merge new facts into the stored ones and save the result; only the buckets of conversations that are named are read and written."""
    removed = facts.spark.createDataFrame([], "conversation_id string, text string") if removed is None else removed
    names = kept(incoming.select("conversation_id").unionByName(removed.select("conversation_id")).distinct())
    columns = [x.split()[0] for x in FACTS.split(", ")]
    stored = facts.read("facts").join(names, "conversation_id", "left_semi").select(*columns)
    facts.replace("facts", merge(stored, incoming.select(*columns), removed, settings), names, batch)
