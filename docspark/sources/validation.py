"""Upload checks as columns: a status and a reason per row, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import CONTENT_TYPES, CONTENT_TYPES_BY_EXTENSION, FILE_TYPES


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.substring_index(F.lower(name), ".", -1)).otherwise("")


def file_type(name: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(FILE_TYPES), extension(name)), F.lit("unknown"))


def content_type(name: Column) -> Column:
    by_ext, by_type = F.try_element_at(_map(CONTENT_TYPES_BY_EXTENSION), extension(name)), F.try_element_at(_map(CONTENT_TYPES), file_type(name))
    return F.coalesce(by_ext, by_type, F.lit("application/octet-stream"))


def _starts(content: Column, hexed: str) -> Column:
    return F.hex(F.substring(content, 1, len(hexed) // 2)) == hexed


def is_image(content: Column) -> Column:
    """By signature; decoding is the recogniser's matter."""
    marks = ("FFD8FF", "89504E470D0A1A0A", "49492A00", "4D4D002A", "424D")
    webp = _starts(content, "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    out = webp
    for m in marks:
        out = out | _starts(content, m)
    return out


def validate(uploads: DataFrame, name: str = "filename", content: str = "content") -> DataFrame:
    """Adds ``status`` (ok, empty, unsupported, invalid) and ``file_type`` (null unless ok)."""
    ext, data = extension(F.col(name)), F.col(content)
    good = (
        F.when(ext == "pdf", _starts(data, "255044462D"))
        .when(ext.isin("docx", "xlsx"), _starts(data, "504B0304"))
        .when(ext.isin("doc", "xls"), _starts(data, "D0CF11E0A1B11AE1"))
        .when(file_type(F.col(name)) == "image", is_image(data))
        .otherwise(~F.contains(F.substring(data, 1, 4096), F.lit(b"\x00")))
    )
    status = F.when(data.isNull() | (F.octet_length(data) == 0), "empty").when(file_type(F.col(name)) == "unknown", "unsupported").when(good, "ok").otherwise("invalid")
    return uploads.withColumn("status", status).withColumn("file_type", F.when(F.col("status") == "ok", file_type(F.col(name))))
