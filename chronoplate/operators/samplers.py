"""Files of runtime samples, and what is read from them by record, stage and process; requests of views and their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoplate.operators.measurements import in_windows


def parsed_lines(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON lines as typed rows: byte-order marks go, blank lines are skipped."""
    bare = F.regexp_replace(F.col(value), "^\\uFEFF|\\r$", "")
    return lines.select(bare.alias("v")).filter(F.trim("v") != "").select(F.from_json("v", schema).alias("s")).select("s.*")


def read_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Samples of a file of JSON lines; a missing file has none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return parsed_lines(spark.read.text(path), schema)


def latest(samples: DataFrame, order: str) -> DataFrame:
    """The rows of the last sample."""
    last = samples.agg(F.max(order).alias("_last"))
    return samples.join(F.broadcast(last), F.col(order) == F.col("_last")).drop("_last")  # one row


def counter_pid(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"pid_(\d+)", 1), F.lit("")).cast("bigint")


def merged_latest(processes: DataFrame, memory: DataFrame) -> DataFrame:
    """(pid, dedicated_bytes, shared_bytes): the last graphics sample's bytes of processes that the last process sample has.

    `processes` has (sample, pid), `memory` (sample, name, dedicated, shared), a row for each counter."""
    allowed = latest(processes, "sample").select("pid").distinct()
    rows = latest(memory, "sample").withColumn("pid", counter_pid(F.col("name"))).join(allowed, "pid", "left_semi")
    return rows.groupBy("pid").agg(F.sum("dedicated").alias("dedicated_bytes"), F.sum("shared").alias("shared_bytes"))


def range_summaries(ranges: DataFrame, samples: DataFrame, by: list[str], bucket: float) -> DataFrame:
    """A row for each range (keys, start_ms, end_ms): `status`, samples inside (both ends included), CPU seconds between samples of a process inside, and peak bytes of a sample.

    A range without two numbers as its ends is invalid. `samples` has (epoch_ms, pid, cpu_seconds, bytes)."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    both = F.coalesce(ok("start_ms") & ok("end_ms"), F.lit(False))
    inside = in_windows(samples, ranges.filter(both & (F.col("start_ms") <= F.col("end_ms"))), "epoch_ms", "start_ms", "end_ms", bucket)
    before = F.lag("cpu_seconds").over(Window.partitionBy(*by, "pid").orderBy("epoch_ms"))
    each = inside.withColumn("cpu", F.greatest(F.lit(0.0), F.col("cpu_seconds") - before))
    at = each.groupBy(*by, "epoch_ms").agg(F.sum("cpu").alias("cpu"), F.sum("bytes").alias("bytes"))
    found = at.groupBy(*by).agg(F.count("*").alias("samples"), F.sum("cpu").alias("cpu_seconds"), F.max("bytes").alias("peak_bytes"))
    full = ranges.select(*by, F.when(both, "measured").otherwise("invalid").alias("status")).join(found, by, "left")
    return full.withColumns({"samples": F.when(F.col("status") == "measured", F.coalesce("samples", F.lit(0))), "cpu_seconds": F.when(F.col("status") == "measured", F.coalesce("cpu_seconds", F.lit(0.0)))})


def smoke_rows(records: DataFrame) -> DataFrame:
    """Assertions (name, passed, observed, expected) that the first measured load of a split, extent-bound condition of level 2 drew something; a missing status is named so."""
    wanted = (F.col("kind") == "load") & ~F.col("warmup") & (F.col("block") == 0) & (F.col("replicate") == 0) & F.col("condition_id").endswith("split-l2-extent")
    seen = F.coalesce("visual_status", F.lit("missing"))
    return records.filter(wanted).select(F.concat("condition_id", F.lit("-visual-smoke")).alias("name"), (seen == "measured").alias("passed"), seen.alias("observed"), F.lit("measured").alias("expected"))


def check(name: Column, observed: Column, expected: Column) -> Column:
    """One check: passed if what was observed is what was expected."""
    return F.struct(name.alias("name"), observed.alias("observed"), expected.alias("expected"), observed.eqNullSafe(expected).alias("passed"))


def from_cache(disk: Column, prefetch: Column, worker: Column) -> Column:
    """Whether a browser answered a request itself."""
    return F.coalesce(disk, F.lit(False)) | F.coalesce(prefetch, F.lit(False)) | F.coalesce(worker, F.lit(False))


def skip_reason(has_view: Column, ready: Column, asked_age: Column, age_before: Column, age_after: Column) -> Column:
    """Why a view's request loads nothing, or null: no rectangle comes before not being ready, and that before an age that moved on while the request used the current one."""
    return F.when(~has_view, "no-view-rectangle").when(~ready, "not-ready").when(asked_age.isNull() & (age_before != age_after), "stale-age")


def retained(visits: DataFrame, key: list[str], order: str) -> DataFrame:
    """Visits of records with `reused`: true for all but a record's first, which is drawn; later ages take what is retained."""
    return visits.withColumn("reused", F.row_number().over(Window.partitionBy(*key).orderBy(order)) > 1)


def after_provider_change(state: DataFrame, kind: str = "kind") -> DataFrame:
    """What stays when the provider changes: features and rotations; tiles, tasks and images are gone."""
    return state.filter(F.col(kind).isin("feature", "rotation"))


def revealed(requested_age: Column, current_age: Column) -> Column:
    """Whether background work is shown once the foreground is done: only if the age is still the request's."""
    return requested_age.eqNullSafe(current_age)
