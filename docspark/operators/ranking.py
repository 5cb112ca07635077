"""Blending, gates, diversification, context budget and citations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings


def blend(lexical: Column, idx: Column, is_summary: Column, any_rows: Column, cross: Column | None = None, settings: Settings = DEFAULTS) -> Column:
    """Final score: the model's share if there is one, less a thousandth per position, less 0.05 for sheet summaries beside rows."""
    a = settings.cross_encoder_share
    base = lexical if cross is None else F.coalesce(a * cross + (1 - a) * lexical, lexical)
    return base - idx * 0.001 - F.when(is_summary & any_rows, 0.05).otherwise(0.0)


def confident(ranked: DataFrame, query: str, score: str, least: float = DEFAULTS.confidence) -> DataFrame:
    """All rows of queries whose best score reaches ``least``."""
    return ranked.withColumn("_best", F.max(score).over(Window.partitionBy(query))).where(F.col("_best") >= least).drop("_best")


def relatively_relevant(ranked: DataFrame, query: str, score: str, share: float = 0.5, least: float = DEFAULTS.confidence) -> DataFrame:
    best = F.max(score).over(Window.partitionBy(query))
    return ranked.withColumn("_best", best).where(F.col(score) >= F.greatest(F.col("_best") * share, F.lit(least))).drop("_best")


def within_budget(ranked: DataFrame, query: str, rank: str, text: str, budget: int = DEFAULTS.context_chars) -> DataFrame:
    """The ranked prefix whose texts fit; the first row always stays."""
    running = F.sum(F.length(text)).over(Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy(query).orderBy(rank))
    return ranked.withColumns({"_sum": running, "_first": first}).where((F.col("_sum") <= budget) | (F.col("_first") == 1)).drop("_sum", "_first")


def context(ranked: DataFrame, query: str, rank: str, label: str, text: str) -> DataFrame:
    """One context per query: labelled texts in rank order, ruled off from each other."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.concat(F.col(label), F.lit("\n"), F.col(text)).alias("t"))))
    return ranked.groupBy(query).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def citations(ranked: DataFrame, query: str, rank: str, source: str, page: str, prefix: str = "Sources: ") -> DataFrame:
    """The three most used sources of each query with their first three pages, counted from 1."""
    by = ranked.groupBy(query, source).agg(F.count("*").alias("n"), F.min(rank).alias("first"), F.slice(F.sort_array(F.collect_set(F.col(page) + 1)), 1, 3).alias("pages"))
    shown = F.concat(F.col(source), F.when(F.size("pages") > 0, F.concat(F.lit(" (p. "), F.array_join(F.col("pages").cast("array<string>"), ", "), F.lit(")"))).otherwise(""))
    top = by.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("n"), "first"))).where("place <= 3").withColumn("shown", shown)
    items = F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda x: x["shown"])
    return top.groupBy(query).agg(F.concat(F.lit(prefix), F.array_join(items, " | ")).alias("citation"))


def active_source(ranked: DataFrame, query: str, rank: str, source: str) -> DataFrame:
    """The source most rows of a query come from; the one seen first among equals."""
    by = ranked.groupBy(query, source).agg(F.count("*").alias("n"), F.min(rank).alias("first"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("n"), "first"))).where("place = 1").select(query, source, "n")


def select_diverse(scores: np.ndarray, vectors: np.ndarray, n: int, weight: float) -> list[int]:
    """Maximal marginal relevance; the lowest index wins ties."""
    if len(scores) <= n:
        return list(range(len(scores)))
    chosen = [int(np.argmax(scores))]
    closest = vectors @ vectors[chosen[0]]
    while len(chosen) < n:
        value = weight * scores - (1 - weight) * closest
        value[chosen] = -np.inf
        chosen.append(int(np.argmax(value)))
        closest = np.maximum(closest, vectors @ vectors[chosen[-1]])
    return chosen


def diversify(pool: DataFrame, query: str, n: int, settings: Settings = DEFAULTS) -> DataFrame:
    """``query, point_id, pick``: the diversified order of each query's pool (query, idx, point_id, score, vector).

    The pool is cut to max(4n, 12) rows first, so a group stays small; stored vectors are used, nothing is embedded again.
    """
    most = max(4 * n, 12)
    cut = pool.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "idx"))).where(F.col("_r") <= most)
    kind = dict(pool.dtypes)

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_r").reset_index(drop=True)
        chosen = select_diverse(frame["score"].to_numpy(float), np.array(frame["vector"].tolist(), float), n, settings.mmr_lambda)
        return pd.DataFrame({query: frame[query].iloc[0], "point_id": frame["point_id"].iloc[chosen].to_numpy(), "pick": np.arange(1, len(chosen) + 1)})

    return cut.select(query, "point_id", "score", "vector", "_r").groupBy(query).applyInPandas(pick, f"{query} {kind[query]}, point_id {kind['point_id']}, pick int")
