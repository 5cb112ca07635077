"""The splitters as table functions for SQL: ``SELECT ... FROM documents, LATERAL recursive_chunks(text, 700, 150)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, IntegerType, IntegralType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..config import DEFAULTS
from ..functions import vectors as V
from ..operators import chunking

MADE = StructType().add("pos", IntegerType()).add("chunk", StringType())


def _checked(name: str, text: AnalyzeArgument, *sizes: AnalyzeArgument) -> AnalyzeResult:
    """The rows that a splitter makes, once its arguments are seen to be a text and whole numbers."""
    wrong: list[DataType] = [a.dataType for a in (text,) if not isinstance(a.dataType, (StringType, NullType))]
    wrong += [a.dataType for a in sizes if not isinstance(a.dataType, IntegralType)]
    if wrong:
        raise ValueError(f"{name} takes a text and whole numbers, not {', '.join(t.simpleString() for t in wrong)}")
    return AnalyzeResult(MADE)


@udtf(useArrow=True)
class RecursiveChunks:
    """``pos, chunk`` of ``recursive_chunks(text[, size[, overlap]])``; a null text has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _checked("recursive_chunks", text, *[a for a in (size, overlap) if a is not None])

    def eval(self, text: str, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunking.split_recursively(text or "", size, overlap))


@udtf(useArrow=True)
class HybridChunks:
    """``pos, chunk`` of ``hybrid_chunks(text)``."""

    def __init__(self):
        self.hasher = V.WordHasher()

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _checked("hybrid_chunks", text)

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunking.by_both(text or "", self.hasher, DEFAULTS))


def register(spark: SparkSession) -> None:
    spark.udtf.register("recursive_chunks", RecursiveChunks)
    spark.udtf.register("hybrid_chunks", HybridChunks)
