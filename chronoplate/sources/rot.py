"""Finite-rotation text: lines `plate age lat lon angle related [!comment]` to rotation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as a number: decimal notation only, so that "1d", "NaN" and hexadecimal are malformed.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: How far a record moves back when the next one has its age (a change of the related plate).
CROSSOVER_STEP = 0.01

RECORD = "plate_id STRING, age DOUBLE, pole_lat DOUBLE, pole_lon DOUBLE, angle DOUBLE, related_id STRING, line_no BIGINT"


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_lines(lines: DataFrame, value: str = "value", line_no: str = "line_no") -> DataFrame:
    """Valid records of text rows. What follows `!`, blank lines, lines of fewer than six fields and lines with a malformed
    number give no record. A field list may be longer; the rest is ignored."""
    data = F.trim(F.regexp_replace(F.split_part(F.col(value), F.lit("!"), F.lit(1)), r"[\s]+", " "))
    fields = lines.select(F.split(data, " ").alias("f"), F.col(line_no).cast("bigint").alias("line_no"))
    field = lambda i: F.get("f", F.lit(i))
    parsed = fields.select(
        field(0).alias("plate_id"),
        *(_number(field(i)).alias(name) for i, name in enumerate(("age", "pole_lat", "pole_lon", "angle"), 1)),
        field(5).alias("related_id"),
        "line_no",
    )
    return parsed.filter("plate_id <> '' and related_id <> ''").dropna(subset=["age", "pole_lat", "pole_lon", "angle"])


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of several files, as if the texts followed each other in the order of the paths. Lines are numbered inside their file, and files by their place."""
    texts = [spark.read.text(p, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "value"), F.lit(i).alias("file")) for i, p in enumerate(paths)]
    out = texts[0]
    for more in texts[1:]:
        out = out.unionByName(more)
    return parse_lines(out.withColumn("line_no", F.col("file").cast("bigint") * F.lit(1 << 40) + F.col("at")))


def parse_text(spark: SparkSession, text: str) -> DataFrame:
    """Records of a text held in memory."""
    return parse_lines(spark.createDataFrame([(text,)], "t STRING").select(F.posexplode(F.split("t", "\n")).alias("line_no", "value")))


def series(records: DataFrame) -> DataFrame:
    """Records as they are used: a record that repeats the age and related plate of the one before it is dropped, and a record whose successor has its age moves back by CROSSOVER_STEP. Order is that of line_no within a plate."""
    order = Window.partitionBy("plate_id").orderBy("line_no")
    repeated = (F.lag("age").over(order) == F.col("age")) & F.lag("related_id").over(order).eqNullSafe(F.col("related_id"))
    kept = records.withColumn("_repeated", F.coalesce(repeated, F.lit(False))).filter(~F.col("_repeated")).drop("_repeated")
    return kept.withColumn("age", F.when(F.lead("age").over(order) == F.col("age"), F.col("age") - CROSSOVER_STEP).otherwise(F.col("age")))


def replace_plates(loaded: DataFrame, more: DataFrame) -> DataFrame:
    """A later load: its plates replace the same plates of what was loaded."""
    return loaded.join(more.select("plate_id").distinct(), "plate_id", "left_anti").unionByName(more)


def url_list(text: Column) -> Column:
    """The non-blank trimmed lines of a text."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
