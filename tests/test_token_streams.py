"""Tokens of request streams: outcomes on a stream equal those on a table, and a timer clears what nothing ends."""

import random

from pyspark.sql import functions as F

from chronoplate.streaming import requests

SCHEMA = "session STRING, seq LONG, generation LONG, key STRING, kind STRING, ts TIMESTAMP"


def run(spark, tmp_path, batches, **options):
    """The rows of a stream of these batches, a file each."""
    place = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "session STRING, seq LONG, generation LONG, key STRING, kind STRING, ts STRING").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(place))
    stream = requests.token_outcomes(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(place)), **options)
    query = stream.writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(map(tuple, spark.table("outcomes").collect()))


def test_a_stream_gives_the_outcomes_of_a_table(spark, tmp_path):
    rng = random.Random(1)
    rows, seq = [], 0
    for s in ("a", "b"):
        for g in range(1, 6):
            for k in range(6):
                rows.append((s, seq := seq + 1, g - (rng.random() < 0.2), f"{g}-{k}", "start"))
                if rng.random() < 0.7:
                    rows.append((s, seq := seq + 1, rows[-1][2], f"{g}-{k}", "done"))
    rows = [(*r, f"2026-01-01 00:{r[1] // 60:02d}:{r[1] % 60:02d}") for r in rows]
    table = spark.createDataFrame(rows, "session STRING, seq LONG, generation LONG, key STRING, kind STRING, ts STRING")
    want = sorted(map(tuple, requests.token_outcomes(table).filter("outcome <> 'pending'").collect()))
    assert {r[4] for r in want} == {"completed", "cancelled"}
    assert run(spark, tmp_path, [rows], patience_seconds=10**6) == want


def test_a_timer_clears_what_is_pending(spark, tmp_path):
    first = [("a", 1, 1, "x", "start", "2026-01-01 00:00:00"), ("a", 2, 1, "y", "start", "2026-01-01 00:00:01"), ("a", 3, 1, "y", "done", "2026-01-01 00:00:02")]
    later = [("b", 4, 1, "z", "start", "2026-01-01 05:00:00")]
    last = [("b", 5, 2, "w", "start", "2026-01-01 05:00:01")]
    got = run(spark, tmp_path, [first, later, last], late="1 second", patience_seconds=60)
    assert ("a", 1, "x", 1, "expired") in got and ("a", 1, "y", 2, "completed") in got and ("b", 1, "z", 4, "cancelled") in got


def test_no_requests_have_no_outcomes(spark):
    assert requests.token_outcomes(spark.createDataFrame([], SCHEMA)).count() == 0
