"""Queries on benchmark records and runtime samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplate.operators import measurements as O
from chronoplate.plans.registry import query, rounded, table

RECORDS = """rec AS (SELECT l_returnflag AS condition_id, l_linenumber AS block, l_linestatus = 'F' AS warmup, l_orderkey, l_quantity::DOUBLE AS total_ms, l_extendedprice::DOUBLE AS bytes, l_discount::DOUBLE AS share FROM lineitem)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("condition_id"), F.col("l_linenumber").alias("block"), (F.col("l_linestatus") == "F").alias("warmup"), "l_orderkey",
        F.col("l_quantity").cast("double").alias("total_ms"), F.col("l_extendedprice").cast("double").alias("bytes"), F.col("l_discount").cast("double").alias("share"),
    )


_LONG = "lng AS (UNPIVOT (SELECT condition_id, total_ms, bytes, share FROM rec WHERE NOT warmup) ON total_ms, bytes, share INTO NAME metric VALUE value)"


@query("A10_A12_quartiles", f"WITH {RECORDS}, {_LONG} SELECT condition_id, metric, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.75), 4) AS q3 FROM lng GROUP BY ALL")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = O.long_metrics(records(spark, sf_dir).filter("not warmup"), ["condition_id"], ["total_ms", "bytes", "share"])
    return rounded(O.quartiles(long, ["condition_id", "metric"]), "median", "q1", "q3", digits=4)


@query("A11_cold_warm", f"WITH {RECORDS} SELECT block, count(*) AS n, round(quantile_cont(total_ms, 0.5), 4) AS median FROM rec WHERE share > 0.02 GROUP BY block")
def cold_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.quartiles(records(spark, sf_dir).filter("share > 0.02"), ["block"], "total_ms").select("block", "n", "median"), "median", digits=4)


EVENTS = """ev AS (SELECT event_type AS stage, user_id % 7 AS rec, event_id::DOUBLE AS start_ms, event_id + value AS end_ms, 8000.0::DOUBLE AS frozen_ms FROM events)"""


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 7).alias("rec"), F.col("event_id").cast("double").alias("start_ms"), (F.col("event_id") + F.col("value")).alias("end_ms"), F.lit(8000.0).alias("frozen_ms"))


@query("A13_A15_stage_totals", f"WITH {EVENTS} SELECT stage, rec, round(min(start_ms), 3) AS first_start, round(max(end_ms), 3) AS last_end, round(sum(end_ms - start_ms), 3) AS total_ms, count(*) AS n FROM ev WHERE start_ms <= frozen_ms GROUP BY ALL")
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.stage_totals(stage_events(spark, sf_dir), ["stage", "rec"], "frozen_ms"), "first_start", "last_end", "total_ms", digits=3)


@query(
    "A14_A25_A27_assertions",
    f"WITH {RECORDS}, c AS (SELECT condition_id, unnest(['positive', 'bounded', 'cheap']) AS name, unnest([total_ms > 0, total_ms <= 45, bytes < 90000]) AS passed FROM rec) SELECT condition_id, name, bool_and(passed) AS all_passed, count(*) FILTER (NOT passed) AS failures, count(*) AS checks FROM c GROUP BY ALL",
)
def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.assertions(records(spark, sf_dir), ["condition_id"], {"positive": F.col("total_ms") > 0, "bounded": F.col("total_ms") <= 45, "cheap": F.col("bytes") < 90000})
    return O.assertion_summary(rows, ["condition_id", "name"])


@query("J13_paired_blocks", f"WITH {RECORDS} SELECT l_orderkey, block, max(total_ms) FILTER (condition_id = 'A') AS \"A\", max(total_ms) FILTER (condition_id = 'N') AS \"N\" FROM (SELECT * REPLACE (block % 2 AS block) FROM rec) GROUP BY ALL HAVING count(*) FILTER (condition_id = 'A') > 0 AND count(*) FILTER (condition_id = 'N') > 0")
def paired_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.paired(records(spark, sf_dir).withColumn("block", F.col("block") % 2), "condition_id", "A", "N", ["l_orderkey", "block"], "total_ms")


@query("W5_replicate_index", f"WITH {RECORDS} SELECT l_orderkey, block, (row_number() OVER (PARTITION BY condition_id, l_orderkey ORDER BY block) - 1)::INT AS replicate FROM rec")
def replicate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.numbered(records(spark, sf_dir), ["condition_id", "l_orderkey"], ["block"]).select("l_orderkey", "block", F.col("replicate").cast("int").alias("replicate"))


@query("W7_age_visits", "SELECT event_id, age, lag(age) OVER (PARTITION BY user_id ORDER BY event_id) AS from_age, (row_number() OVER (PARTITION BY user_id, age ORDER BY event_id) - 1)::INT AS visit FROM (SELECT event_id, user_id, [50.0, 120.0, 200.0, 400.0][event_id % 4 + 1]::DOUBLE AS age FROM events)")
def age_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.get(F.array(*map(F.lit, (50.0, 120.0, 200.0, 400.0))), (F.col("event_id") % 4).cast("int"))
    rows = O.transitions(table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("age")), ["user_id"], "event_id")
    return rows.select("event_id", "age", "from_age", F.col("visit").cast("int").alias("visit"))


SAMPLES = """smp AS (SELECT (event_id // 4) * 250 AS epoch_ms, event_id % 4 + 100 AS pid, sum(value) OVER (PARTITION BY event_id % 4 ORDER BY event_id) / 1000 AS cpu_seconds, (event_id * 7919) % 100000 AS bytes FROM events WHERE event_id % 11 <> 3)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    running = F.sum("value").over(Window.partitionBy("pid").orderBy("event_id")) / 1000
    rows = table(spark, sf_dir, "events").filter("event_id % 11 <> 3").withColumn("pid", F.col("event_id") % 4 + 100)
    return rows.select((F.floor(F.col("event_id") / 4) * 250).alias("epoch_ms"), "pid", running.alias("cpu_seconds"), ((F.col("event_id") * 7919) % 100000).alias("bytes"))


@query("J14_W8_cpu_delta", f"WITH {SAMPLES} SELECT epoch_ms, pid, round(greatest(0, cpu_seconds - before), 6) AS cpu_delta FROM (SELECT *, lag(cpu_seconds) OVER (PARTITION BY pid ORDER BY epoch_ms) AS before FROM smp) WHERE before IS NOT NULL")
def cpu_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("pid").orderBy("epoch_ms"))
    return rounded(O.cpu_deltas(samples(spark, sf_dir)).withColumn("i", first).filter("i > 1").select("epoch_ms", "pid", "cpu_delta"), "cpu_delta")


@query(
    "A16_process_summary",
    f"""WITH {SAMPLES}, t AS (SELECT epoch_ms, lag(epoch_ms) OVER (ORDER BY epoch_ms) AS before_ms FROM (SELECT DISTINCT epoch_ms FROM smp)),
    d AS (SELECT s.epoch_ms, t.before_ms, s.bytes, CASE WHEN b.pid IS NULL THEN 0 ELSE greatest(0, s.cpu_seconds - b.cpu_seconds) END AS cpu FROM smp s JOIN t USING (epoch_ms) LEFT JOIN smp b ON b.pid = s.pid AND b.epoch_ms = t.before_ms),
    g AS (SELECT epoch_ms, (epoch_ms - before_ms) / 1000 AS wall, sum(cpu) AS cpu, sum(bytes)::BIGINT AS bytes FROM d GROUP BY ALL)
    SELECT count(*) AS samples, round(sum(cpu) FILTER (wall > 0), 4) AS cpu_seconds, round(100 * sum(cpu) FILTER (wall > 0) / (sum(wall) FILTER (wall > 0) * 8), 4) AS mean_percent, round(max(100 * cpu / (wall * 8)) FILTER (wall > 0), 4) AS peak_percent,
      arg_max(bytes, epoch_ms) AS end_bytes, max(bytes) AS peak_bytes FROM g""",
)
def process_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.process_summary(samples(spark, sf_dir), 8), "cpu_seconds", "mean_percent", "peak_percent", digits=4)


@query("A17_gpu_summary", "WITH a AS (SELECT event_id // 20 AS e, event_type AS engine, user_id % 3 AS adapter, max(value) AS u FROM events GROUP BY ALL), s AS (SELECT e, engine, max(u) AS u FROM a GROUP BY ALL) SELECT engine, round(avg(u), 6) AS mean_percent, max(u) AS peak_percent, count(*) AS samples FROM s GROUP BY engine")
def gpu_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("epoch_ms"), F.col("event_type").alias("engine"), (F.col("user_id") % 3).alias("adapter"), F.col("value").alias("used"))
    return rounded(O.gpu_summary(rows), "mean_percent")


@query("A18_upper_median_interval", "WITH d AS (SELECT user_id % 50 AS g, event_id - lag(event_id) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS step FROM events) SELECT g, list_sort(list(step))[len(list(step)) // 2 + 1] AS interval FROM d WHERE step IS NOT NULL GROUP BY g")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("g"), "event_id")
    return O.upper_median_interval(rows, ["g"], "event_id")


@query("A19_sampler_shift", f"WITH {RECORDS}, m AS (SELECT condition_id, avg(total_ms) FILTER (block % 2 = 0) AS off, avg(total_ms) FILTER (block % 2 = 1) AS onn FROM rec GROUP BY ALL) SELECT condition_id, round(100 * (onn - off) / off, 6) AS shift, abs(100 * (onn - off) / off) > 5 AS flagged FROM m")
def sampler_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = records(spark, sf_dir).groupBy("condition_id").agg(F.avg(F.when(F.col("block") % 2 == 0, F.col("total_ms"))).alias("off"), F.avg(F.when(F.col("block") % 2 == 1, F.col("total_ms"))).alias("onn"))
    rows = mean.select("condition_id", O.shift_percent(F.col("off"), F.col("onn")).alias("shift"))
    return rounded(rows.withColumn("flagged", F.abs("shift") > 5), "shift")


@query(
    "J11_nearest_sample",
    """WITH l AS (SELECT event_id, (event_id * 10)::DOUBLE AS t FROM events WHERE event_type = 'error'), r AS (SELECT event_id AS rid, (event_id * 10 + 3)::DOUBLE AS rt FROM events WHERE event_id % 6 = 0 AND event_id % 1000 < 700)
    SELECT event_id, arg_min(rid, (abs(t - rt), rt)) AS near_rid FROM l, r GROUP BY event_id""",
)
def nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    left = ev.filter("event_type = 'error'").select("event_id", (F.col("event_id") * 10).cast("double").alias("t"))
    right = ev.filter("event_id % 6 = 0 and event_id % 1000 < 700").select(F.col("event_id").alias("rid"), (F.col("event_id") * 10 + 3).cast("double").alias("rt"))
    return O.nearest(left, right, "t", "rt", 100.0).select("event_id", "near_rid")


@query("J12_stage_windows", "WITH w AS (SELECT unnest(range(0, 40)) AS win), v AS (SELECT win, (win * 210)::DOUBLE AS a, (win * 210 + 150 + win)::DOUBLE AS b FROM w) SELECT win, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM v JOIN events ON event_id BETWEEN a AND b GROUP BY win")
def stage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = spark.range(40).select(F.col("id").alias("win"), (F.col("id") * 210).cast("double").alias("a"), (F.col("id") * 211 + 150).cast("double").alias("b"))
    held = O.in_windows(table(spark, sf_dir, "events").select("event_id"), win, "event_id", "a", "b", 500.0)
    return held.groupBy("win").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query("A22_counter_baseline", "WITH c AS (SELECT user_id, event_id, sum(event_id % 5) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS jobs, event_type FROM events) SELECT event_id, greatest(0, jobs - coalesce(arg_min(jobs, event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id), 0)) AS jobs_delta FROM c")
def counter_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ev = table(spark, sf_dir, "events").withColumn("jobs", F.sum(F.col("event_id") % 5).over(Window.partitionBy("user_id").orderBy("event_id")))
    return O.since_baseline(ev.select("user_id", "event_id", "jobs", "event_type"), ["user_id"], ["jobs"], "event_id", F.col("event_type") == "error").select("event_id", "jobs_delta")


@query("J15_process_tree", "WITH RECURSIVE p AS (SELECT p_partkey AS pid FROM part), t AS (SELECT pid AS root, pid FROM p WHERE pid IN (3, 7, 50) UNION SELECT t.root, p.pid FROM t JOIN p ON p.pid // 2 = t.pid) SELECT root, pid FROM t")
def process_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), F.floor(F.col("p_partkey") / 2).alias("parent"))
    return O.process_tree(p, p.filter("pid in (3, 7, 50)").select("pid"))


@query("A24_metric_status", f"WITH {RECORDS}, g AS (SELECT condition_id, sum(bytes) AS v, count(*) > 20000 AS ok FROM rec GROUP BY ALL) SELECT condition_id, CASE WHEN ok THEN 'measured' ELSE 'invalid' END AS status, round(CASE WHEN ok THEN v END, 2) AS value, CASE WHEN ok THEN 'bytes' END AS unit FROM g")
def metric_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).groupBy("condition_id").agg(F.sum("bytes").alias("v"), (F.count("*") > 20000).alias("ok"))
    return rounded(rows.select("condition_id", O.metric(F.col("v"), "bytes", F.col("ok")).alias("m")).select("condition_id", "m.status", "m.value", "m.unit"), "value", digits=2)


@query(
    "O5_U6_shuffled_blocks",
    """WITH RECURSIVE given AS (SELECT ['init', 'L0', 'L1', 'L2', 'L3', 'L4'] AS items), s AS (
      SELECT 0 AS step, 42::BIGINT AS state, items AS r FROM given
      UNION ALL
      SELECT step + 1, g, list_transform(base, lambda x, k: CASE WHEN k = i + 1 THEN base[j + 1] WHEN k = j + 1 THEN base[i + 1] ELSE x END)
      FROM (SELECT step, g, i, base, (g * (i + 1)) >> 32 AS j FROM (SELECT step, (1664525 * state + 1013904223) % 4294967296 AS g, 5 - step % 5 AS i, CASE WHEN step % 5 = 0 THEN items ELSE r END AS base FROM s, given WHERE step < 5 * (SELECT count(*) FROM supplier)))
    ) SELECT block, position, items[position + 1] AS condition_id FROM (SELECT (step // 5 - 1)::BIGINT AS block, unnest(range(0, 6))::INT AS position, r AS items FROM s WHERE step > 0 AND step % 5 = 0)""",
)
def shuffled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of the distinct conditions for each supplier, each in its own seeded order."""
    return O.shuffled_blocks(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("block")), ["init", "L0", "L1", "L2", "L3", "L4"], 42).withColumnRenamed("item", "condition_id")


_LRU = """WITH r AS (SELECT user_id % 5 AS cache, event_id AS seq, (event_id * 7) % 60 AS key FROM events), p AS (SELECT *, max(seq) OVER (PARTITION BY cache, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
    c AS (SELECT p.cache, p.seq, count(DISTINCT q.key) AS others FROM p JOIN r q ON q.cache = p.cache AND q.seq > p.prev AND q.seq < p.seq GROUP BY ALL), h AS (SELECT p.cache, p.seq, p.prev IS NOT NULL AND coalesce(others, 0) < 8 AS hit FROM p LEFT JOIN c USING (cache, seq))"""


@query("W6_A21_lru_replay", _LRU + " SELECT cache, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM h GROUP BY cache")
def lru_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_hits(table(spark, sf_dir, "events"))


@query("W6_A21_lru_replay_all", _LRU + " SELECT cache, seq, hit FROM h")
def lru_replay_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request of all events."""
    return O.lru_replay(cache_requests(table(spark, sf_dir, "events")), 8).select("cache", "seq", "hit")


def cache_requests(events: DataFrame) -> DataFrame:
    return events.select((F.col("user_id") % 5).alias("cache"), F.col("event_id").alias("seq"), ((F.col("event_id") * 7) % 60).alias("key"))


def cache_hits(events: DataFrame) -> DataFrame:
    return O.lru_replay(cache_requests(events), 8).groupBy("cache").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("P23_record_id", f"WITH {RECORDS} SELECT DISTINCT 'paper:' || condition_id || ':' || CASE WHEN warmup THEN 'warmup' ELSE 'measured' END || ':replicate-' || block AS record_id FROM rec")
def record_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return rows.select(F.concat_ws(":", F.lit("paper"), "condition_id", F.when(F.col("warmup"), "warmup").otherwise("measured"), F.concat(F.lit("replicate-"), F.col("block").cast("string"))).alias("record_id")).distinct()
