"""Helpers shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoplate.operators import tables

#: Word separators of every word-based contract: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch: some megabytes of texts.
BATCH_ROWS = 1_000

#: Translation that leaves only plain spaces between words, so that str.split(" ") and bytes.split() agree with the contract.
_TO_SPACE = {ord(c): " " for c in BLANKS[1:]}


def words_of(text: str | None) -> list[str]:
    """The maximal runs of non-blank characters of a text (null: none)."""
    return [w for w in text.translate(_TO_SPACE).split(" ") if w] if text else []


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, all else untouched."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def words_lower(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z lower-cased; bytes.split() splits on exactly the six blanks."""
    return text.encode().lower().split() if text else []


def written(df: DataFrame, name: str) -> DataFrame:
    """tables.written(), with small Arrow batches from here on."""
    small_batches(df.sparkSession)
    return tables.written(df, name)


def dropped(*made: DataFrame) -> None:
    """Removes tables made by written() that nothing will read any more."""
    tables.dropped(*made)


def few(df: DataFrame, most: int) -> DataFrame:
    """A written table, broadcast if it has `most` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def looked_up(rows: DataFrame, names: DataFrame, on: list[str], spread: Column, most: int = 200_000, salts: int = 16) -> DataFrame:
    """Left join of rows with a written table of distinct keys, whose columns are those of `on` and others that rows lack.

    Up to `most` keys are broadcast. Beyond, keys are repeated for each of `salts` parts that a hash of the column `spread` deals
    rows to, so that the rows of a hot key don't meet in one task."""
    if names.count() <= most:
        return rows.join(F.broadcast(names), on, "left")
    part = fresh(rows, "part")[0]
    salted = names.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(part, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [*on, part], "left").drop(part)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Sets Arrow batches of `BATCH_ROWS` rows where the session has Spark's default of 10,000: the JVM and Python each hold whole batches of texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose strings in a column take about `most` bytes, at least a row each; null rows count nothing."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_map(df: DataFrame, column: str, schema: str | StructType, work: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = 4_000_000) -> DataFrame:
    """mapInArrow over parts of bounded text size; a worker gives back what Arrow holds once its partition ends."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in slices(batch, column, most):
                    yield work(part)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def ascii_lower_col(col):
    """A-Z lower-cased in a column."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that clash with none of df's, whatever extra columns it has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
