"""Duplicate removal that keeps the first row in an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .numbering import numbered


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def prefix_dedupe(df: DataFrame, text: str, order: str, prefix: int = 1000) -> DataFrame:
    """Rows whose stripped text has a prefix not seen before; blank texts go."""
    keyed = df.withColumn("_key", F.substring(T.clean(F.col(text)), 1, prefix)).where("_key <> ''")
    return keep_first(keyed, [F.col("_key")], [F.col(order)]).drop("_key")


def hit_dedupe(df: DataFrame, text: str, source: str, page: str, order: str, query: str | None = None, prefix: int = 700) -> DataFrame:
    """Hits with distinct (text prefix, source, page); ``idx`` numbers the survivors from 0 and serves as tie-break penalty.

    With ``query``, each query's hits are deduplicated and numbered by themselves.
    """
    per = [F.col(query)] if query else []
    first = keep_first(df.withColumn("_key", F.substring(T.clean(F.col(text)), 1, prefix)), [*per, F.col("_key"), F.col(source), F.coalesce(F.col(page), F.lit(-1))], [F.col(order)]).drop("_key")
    if query:
        return first.withColumn("idx", F.row_number().over(Window.partitionBy(query).orderBy(order)) - 1)
    return numbered(first, order, "idx")


def fold_case_dedupe(variants: Column) -> Column:
    """An array's items, each once whatever its case, the first spelling staying."""
    lowered = F.transform(variants, F.lower)
    return F.filter(variants, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
