"""Measures of requests and recognition: stage times, percentiles, marks, sessions, job states, error rates."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def stage_profile(stages: DataFrame, request: str, name: str, ms: str, total: Column | None = None) -> DataFrame:
    """``request, stage, ms, share``; what no stage accounts for is the stage ``(unaccounted)`` if a total is given."""
    by = stages.groupBy(request, F.col(name).alias("stage")).agg(F.sum(ms).alias("ms"))
    if total is not None:
        rest = stages.groupBy(request).agg((F.max(total) - F.sum(ms)).alias("ms")).select(request, F.lit("(unaccounted)").alias("stage"), "ms")
        by = by.unionByName(rest)
    return by.withColumn("share", F.col("ms") / F.sum("ms").over(Window.partitionBy(request)))


def latency_summary(rows: DataFrame, by: str, ms: str) -> DataFrame:
    """avg, p50, p95 by nearest rank.

    Equal values are counted before they are shuffled, and the running counts that locate a rank are taken range by range of the values,
    so a group that holds most of the rows is neither collected into an array nor sorted by one task.
    """
    found = rows.where(F.col(ms).isNotNull())
    sums = found.groupBy(by).agg(F.count("*").alias("n"), F.avg(ms).alias("avg"), F.percentile_approx(ms, [i / 64 for i in range(1, 64)], 10_000).alias("_cuts"))
    each = found.groupBy(by, ms).agg(F.count("*").alias("_c")).join(sums, by)
    each = each.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(ms)))).drop("_cuts", "avg")
    before = each.groupBy(by, "_part").agg(F.sum("_c").alias("_s"))  # 64 rows a group at most
    before = before.withColumn("_before", F.coalesce(F.sum("_s").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    running = F.sum("_c").over(Window.partitionBy(by, "_part").orderBy(ms).rowsBetween(Window.unboundedPreceding, 0))
    placed = each.join(before, [by, "_part"]).withColumn("_to", F.col("_before") + running)
    rank = lambda p: F.bround(F.lit(p) * (F.col("n") - 1)).cast("long") + 1
    at = lambda p: F.max(F.when((F.col("_to") >= rank(p)) & (F.col("_to") - F.col("_c") < rank(p)), F.col(ms)))
    picked = placed.groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    return sums.drop("_cuts").join(picked, by)


def marks(events: DataFrame, request: str, name: str, at: str, spans: dict[str, tuple[str, str]]) -> DataFrame:
    """Differences between named marks of a request in milliseconds; null where a mark is missing."""
    need = sorted({m for pair in spans.values() for m in pair})
    wide = events.groupBy(request).agg(*[F.min(F.when(F.col(name) == m, F.col(at))).alias(f"_{m}") for m in need])
    return wide.select(request, *[((F.col(f"_{b}") - F.col(f"_{a}")) * 1.0).alias(k) for k, (a, b) in spans.items()])


def idle_sessions(events: DataFrame, key: str, ts: str, order: str, idle_seconds: int = 1800) -> DataFrame:
    """Each event with its session number; a session ends where the gap reaches the timeout."""
    by = Window.partitionBy(key).orderBy(ts, order)
    gap = F.timestamp_diff("MICROSECOND", F.lag(ts).over(by), F.col(ts))
    new = F.when(gap.isNull() | (gap >= idle_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def latest_state(events: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(order)))
    return events.withColumn("_r", last).where("_r = 1").drop("_r")


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """How many insertions, deletions and substitutions make one sequence the other.

    What both begin and end with is taken off; of the rest, a whole column of the distance table is held as the bits of two integers,
    its rises and its falls, so that a symbol costs a few operations on integers of the other's length: texts of 20,000 words are compared in
    some tenths of a second, and memory is that of the longer text. The column's end is its top plus its rises less its falls, counted once,
    after the last symbol. Bits above the column never reach it and are cut off now and then.
    """
    start = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every, get = (1 << len(a)) - 1, where.get
    rises, falls = every, 0
    for i in range(0, len(b), 64):
        for y in b[i : i + 64]:
            same = get(y, 0)
            stays = ((same & rises) + rises ^ rises) | same
            up = (falls | (every ^ (stays | rises))) << 1 | 1
            diagonal = same | falls
            rises, falls = (rises & stays) << 1 | (every ^ (diagonal | up)), up & diagonal
        rises, falls = rises & every, falls & every
    return len(b) + rises.bit_count() - falls.bit_count()


def error_rate(reference: Sequence[Hashable], hypothesis: Sequence[Hashable]) -> float:
    """Edits per symbol of the reference; without one, 0 if the hypothesis is empty too and 1 if not."""
    return edit_distance(reference, hypothesis) / len(reference) if reference else float(bool(hypothesis))


@F.pandas_udf(DoubleType())
def char_error_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Over characters, without white space at either end; null counts as empty."""
    return pd.Series([error_rate((r or "").strip(), (h or "").strip()) for r, h in zip(reference, hypothesis, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def word_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([error_rate((r or "").split(), (h or "").split()) for r, h in zip(reference, hypothesis, strict=True)], dtype=float)


def word_error_rate(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Adds ``wer``, over words."""
    return pairs.withColumn("wer", word_rate(F.col(reference), F.col(hypothesis)))
