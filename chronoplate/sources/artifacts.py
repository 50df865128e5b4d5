"""Sinks: benchmark artifacts as JSON and CSV, with a manifest of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_cell(value: Column) -> Column:
    """A value for CSV: quoted where it holds a comma, a quote or a line break; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame) -> DataFrame:
    """(line) of each row; writers add the header."""
    return df.select(F.concat_ws(",", *(csv_cell(F.col(c)) for c in df.columns)).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """Files with a header and RFC 4180 quoting."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def manifest(df: DataFrame, content: str = "content") -> DataFrame:
    """Rows of artifacts with the SHA-256 and size of their content."""
    return df.select(*[c for c in df.columns if c != content], F.sha2(F.encode(content, "UTF-8"), 256).alias("sha256"), F.octet_length(F.encode(content, "UTF-8")).alias("bytes"))
