"""Summaries of benchmark records and runtime samples.

Everything groups by (condition, stage, process) keys with partial aggregation; lags run inside one record's or process's series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplate.operators.tables import before_by_ranges, dropped, written

#: Requests of a cache that one task replays at most, about.
RANGE_ROWS = 1_000_000
#: How much wider buckets get for rows that have found nothing near.
WIDER = 64


def _at_ranks(counted: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """(_g, _all, one column for each rank): the value of each group at ranks from 0 in ascending order. counted: (_g, _v, _n), how often a group has a value; ranks may use `_all`, the group's number of values.

    No task holds a group: counts are dealt by ranges of (group, value), and each range takes over the number of values in the group's ranges before it."""
    cut = written(counted.repartitionByRange("_g", "_v").withColumn("_range", F.spark_partition_id()), "counts")
    group = Window.partitionBy("_g")  # a row for each range
    before = F.coalesce(F.sum("_in").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut.groupBy("_g", "_range").agg(F.sum("_n").alias("_in")).select("_g", "_range", before.alias("_before"), F.sum("_in").over(group).alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy("_g", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = cut.withColumn("_upto", upto).join(offsets, ["_g", "_range"]).withColumn("_upto", F.col("_before") + F.col("_upto"))
    here = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
    return ranked.groupBy("_g", "_all").agg(*(F.max(F.when(here(rank), F.col("_v"))).alias(name) for name, rank in ranks.items()))


def quartiles(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, median, q1 and q3 (linear interpolation) of finite values by group; a long table of (keys, value). Equal values are counted first."""
    ok = values.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    counted = ok.groupBy(F.struct(*by).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    shares = {"median": 0.5, "q1": 0.25, "q3": 0.75}
    place = lambda share, up: (F.ceil if up else F.floor)((F.col("_all") - 1) * share)
    found = _at_ranks(counted, {f"_{c}{int(up)}": place(s, up) for c, s in shares.items() for up in (False, True)})
    between = lambda c, s: (F.col(f"_{c}0") + (F.col(f"_{c}1") - F.col(f"_{c}0")) * ((F.col("_all") - 1) * s - place(s, False))).alias(c)
    return found.select(*(F.col("_g")[c].alias(c) for c in by), F.col("_all").alias("n"), *(between(c, s) for c, s in shares.items()))


def long_metrics(records: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Metric columns as rows (ids, metric, value)."""
    return records.unpivot(ids, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def stage_totals(events: DataFrame, by: list[str], freeze: str | None = None) -> DataFrame:
    """Earliest start, latest end, summed duration and number of a stage's events; events that start after `freeze` don't count."""
    kept = events.filter(F.col("start_ms") <= F.col(freeze)) if freeze else events
    return kept.groupBy(*by).agg(F.min("start_ms").alias("first_start"), F.max("end_ms").alias("last_end"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.count("*").alias("n"))


def assertions(records: DataFrame, ids: list[str], checks: dict[str, Column]) -> DataFrame:
    """Checks as rows (ids, name, passed); a null check fails."""
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()))
    return records.select(*ids, F.inline(rows))


def assertion_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.bool_and("passed").alias("all_passed"), F.count_if(~F.col("passed")).alias("failures"), F.count("*").alias("checks"))


def paired(records: DataFrame, kind: str, one: str, other: str, on: list[str], value: str) -> DataFrame:
    """Two kinds of a record side by side on their keys, by one aggregation instead of a self-join."""
    side = lambda k: F.max(F.when(F.col(kind) == k, F.col(value)))
    both = records.filter(F.col(kind).isin(one, other)).groupBy(*on).agg(side(one).alias(one), side(other).alias(other))
    return both.filter(F.col(one).isNotNull() & F.col(other).isNotNull())


def numbered(records: DataFrame, by: list[str], order: list[str], name: str = "replicate") -> DataFrame:
    """Numbers from 0 inside a group."""
    return records.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def transitions(visits: DataFrame, by: list[str], order: str, age: str = "age") -> DataFrame:
    """Visits with `from_age` and `visit`, the number of times that their age was visited before in the group."""
    w = Window.partitionBy(*by).orderBy(order)
    return visits.withColumns({"from_age": F.lag(age).over(w), "visit": F.row_number().over(Window.partitionBy(*by, age).orderBy(order)) - 1})


def cpu_deltas(samples: DataFrame, by: str = "pid") -> DataFrame:
    """Process samples (epoch_ms, pid, cpu_seconds) with `cpu_delta` since the process's sample before, not below 0; null for a first sample."""
    w = Window.partitionBy(by).orderBy("epoch_ms")
    return samples.withColumn("cpu_delta", F.greatest(F.lit(0.0), F.col("cpu_seconds") - F.lag("cpu_seconds").over(w)))


def process_summary(samples: DataFrame, processors: int) -> DataFrame:
    """One row: samples, CPU seconds, mean and peak utilisation in percent of all processors, bytes at the end and at the peak.

    Rows are processes at a sample; sums by sample come first, so that what the ordered step sees is a row for each sample."""
    w = Window.partitionBy("pid").orderBy("epoch_ms")
    times = before_by_ranges(samples, "epoch_ms", "before_ms")
    # A process counts against the sample right before; one that wasn't there has no baseline.
    deltas = samples.withColumns({"_p": F.lag("cpu_seconds").over(w), "_t": F.lag("epoch_ms").over(w)}).join(times, "epoch_ms")
    counted = F.when(F.col("_t") == F.col("before_ms"), F.greatest(F.lit(0.0), F.col("cpu_seconds") - F.col("_p"))).otherwise(F.lit(0.0))
    by = deltas.groupBy("epoch_ms", "before_ms").agg(F.sum(counted).alias("cpu"), F.sum("bytes").alias("bytes")).withColumn("wall", (F.col("epoch_ms") - F.col("before_ms")) / 1000)
    ok = F.col("wall") > 0
    return by.agg(
        F.count("*").alias("samples"),
        F.coalesce(F.sum(F.when(ok, F.col("cpu"))), F.lit(0.0)).alias("cpu_seconds"),
        (100 * F.sum(F.when(ok, F.col("cpu"))) / (F.sum(F.when(ok, F.col("wall"))) * processors)).alias("mean_percent"),
        F.max(F.when(ok, 100 * F.col("cpu") / (F.col("wall") * processors))).alias("peak_percent"),
        F.max_by("bytes", "epoch_ms").alias("end_bytes"),
        F.max("bytes").alias("peak_bytes"),
    )


def gpu_summary(rows: DataFrame) -> DataFrame:
    """Mean and peak use by engine: the maximum by adapter and sample, then by sample, then over samples. `rows`: epoch_ms, adapter, engine, used."""
    by_adapter = rows.groupBy("epoch_ms", "engine", "adapter").agg(F.max("used").alias("used"))
    by_sample = by_adapter.groupBy("epoch_ms", "engine").agg(F.max("used").alias("used"))
    return by_sample.groupBy("engine").agg(F.avg("used").alias("mean_percent"), F.max("used").alias("peak_percent"), F.count("*").alias("samples"))


def upper_median_interval(samples: DataFrame, by: list[str], at: str = "epoch_ms") -> DataFrame:
    """Upper median of the steps between a series' samples (no interpolation); series of fewer than two samples have none. Steps are taken by ranges of time, so that a long series is several tasks' work."""
    times = written(samples.filter(F.col(at).isNotNull()).groupBy(F.struct(*by).alias("_g"), F.col(at).alias("_t")).agg(F.count("*").alias("_n")), "times")
    apart = before_by_ranges(times, "_t", "_from", "_g").filter("_from is not null").select("_g", (F.col("_t") - F.col("_from")).alias("_v"), F.lit(1).cast("bigint").alias("_n"))
    together = times.filter("_n > 1").select("_g", (F.col("_t") - F.col("_t")).alias("_v"), (F.col("_n") - 1).alias("_n"))
    counted = apart.unionByName(together).groupBy("_g", "_v").agg(F.sum("_n").alias("_n"))
    return _at_ranks(counted, {"interval": F.floor(F.col("_all") / 2)}).select(*(F.col("_g")[c].alias(c) for c in by), "interval")


def nearest(left: DataFrame, right: DataFrame, left_at: str, right_at: str, bucket: float) -> DataFrame:
    """Each left row with the nearest right row in time, the earlier of equals, however far it is; null only if there is no right row, or the left row has no time.

    Times are cut into buckets and a left row meets its own and both adjacent ones by an equi-join, so that the as-of join shuffles by
    bucket and no side is broadcast or collected. Left rows that meet none within a bucket's width go on with buckets of WIDER
    times the width; for them only the first and last right row of each narrower bucket matter."""
    own = [f"_l{i}" for i in range(len(left.columns))]
    open_ = written(left.toDF(*own).withColumn("_id", F.monotonically_increasing_id()), "left")
    at = own[left.columns.index(left_at)]
    r = right.filter(F.col(right_at).isNotNull()).select(F.col(right_at).cast("double").alias("_at"), F.struct(*right.columns).alias("_r"))
    found, ends = [], r.agg(F.min("_at").alias("lo"), F.max("_at").alias("hi")).first()
    while ends["lo"] is not None:
        meets = open_.withColumn("_b", F.explode(F.array(*(F.floor(F.col(at) / bucket) + d for d in (-1, 0, 1)))))
        gap = F.abs(F.col(at) - F.col("_at"))
        close = meets.join(r.withColumn("_b", F.floor(F.col("_at") / bucket)), "_b").filter(gap <= bucket).groupBy("_id").agg(F.min(F.struct(gap.alias("gap"), "_at", "_r"))["_r"].alias("_r"))
        both = written(open_.join(close, "_id", "left"), "met")
        found.append(both.filter("_r is not null"))
        open_ = both.filter("_r is null").drop("_r")
        if open_.filter(F.col(at).isNotNull()).isEmpty():
            break
        edges = r.groupBy(F.floor(F.col("_at") / bucket).alias("_b")).agg(F.min(F.struct("_at", "_r")).alias("lo"), F.max(F.struct("_at", "_r")).alias("hi"))
        r = written(edges.select(F.explode(F.array("lo", "hi")).alias("e")).select("e._at", "e._r").distinct(), "edges")
        bucket *= WIDER
    out = open_.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType))
    for part in found:
        out = out.unionByName(part)
    return out.select(*(F.col(o).alias(c) for o, c in zip(own, left.columns, strict=True)), *(F.col(f"_r.{c}").alias(f"near_{c}") for c in right.columns))


def in_windows(samples: DataFrame, windows: DataFrame, at: str, start: str, end: str, bucket: float) -> DataFrame:
    """Samples with each window that holds them, both ends included. Windows are spread over the buckets they touch, and meet samples by an equi-join on the bucket."""
    spread = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return samples.withColumn("_b", F.floor(F.col(at) / bucket)).join(spread, "_b").filter(F.col(at).between(F.col(start), F.col(end))).drop("_b")


def since_baseline(samples: DataFrame, by: list[str], counters: list[str], order: str, is_base: Column) -> DataFrame:
    """Cumulative counters minus their value at the group's baseline row (0 if there is none), not below 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return samples.withColumns({f"{c}_delta": F.greatest(F.lit(0), F.col(c) - F.coalesce(F.first(F.when(is_base, F.col(c)), ignorenulls=True).over(w), F.lit(0))) for c in counters})


def process_tree(processes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, pid) of all descendants of root pids, themselves included; `processes` has (pid, parent).

    Steps up are doubled: a round knows the roots among 2^k ancestors of every process, and where 2^k steps lead, so that rounds grow with
    the logarithm of the depth. They end when no step leads on, or after as many as there are processes (cycles)."""
    up = written(processes.filter("parent is not null and parent <> pid").select("pid", F.col("parent").alias("up")).distinct(), "up")
    asked = roots.select(F.col("pid").alias("root")).distinct()
    found = written(up.join(asked, up["up"] == asked["root"]).select("root", "pid"), "found")
    steps, total = 1, up.count()
    while steps <= total and not up.isEmpty():
        above = found.select("root", F.col("pid").alias("up"))
        more = written(found.unionByName(up.join(above, "up").select("root", "pid")).distinct(), "found")
        further = written(up.join(up.select(F.col("pid").alias("up"), F.col("up").alias("top")), "up").select("pid", F.col("top").alias("up")).distinct(), "up")
        dropped(found, up)
        found, up, steps = more, further, 2 * steps
    return found.unionByName(asked.select("root", F.col("root").alias("pid"))).distinct()


def shift_percent(off: Column, on: Column) -> Column:
    """Relative change in percent of a measure by the samplers."""
    return F.when(off != 0, 100 * (on - off) / off)


def metric(value: Column, unit: str, valid: Column) -> Column:
    """struct<status, value, unit, reason>: measured if valid and finite."""
    ok = valid & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.struct(F.when(ok, "measured").otherwise("invalid").alias("status"), F.when(ok, value).alias("value"), F.when(ok, F.lit(unit)).alias("unit"), F.when(~ok, "insufficient-samples").alias("reason"))


def shuffled_blocks(blocks: DataFrame, items: list[str], seed: int, block: str = "block") -> DataFrame:
    """(block, position, item): a seeded order of the items for each block, numbered from 0: Fisher-Yates by a 32-bit linear congruential generator.

    The generator runs on from block to block; a block begins where those before it would have left it, so that blocks are computed apart.
    It gets there by steps of 1, 2, 4, ... numbers, 32 at most: after 2**32 numbers the generator starts anew."""
    # Multiplier and increment of the generator.
    one = (1664525, 1013904223)
    grown = lambda state: F.pmod(F.lit(one[0]) * state + F.lit(one[1]), F.lit(1 << 32))
    last = len(items) - 1
    numbers = lambda a, b, step: F.sequence(a.cast("bigint"), b.cast("bigint"), F.lit(step).cast("bigint"))
    if last < 1:
        return blocks.select(block, F.posexplode(F.array(*map(F.lit, items))).alias("position", "item"))
    leaps = [one]
    while len(leaps) < 32:
        a, c = leaps[-1]
        leaps.append((a * a % (1 << 32), (a + 1) * c % (1 << 32)))
    low = F.lit((1 << 16) - 1).cast("bigint")
    steps = F.array(*(F.struct(F.lit(1 << k).cast("bigint").alias("bit"), F.lit(a).cast("bigint").alias("a"), F.lit(c).cast("bigint").alias("c")) for k, (a, c) in enumerate(leaps)))
    # The multiplier goes in halves, since a product would need more than 63 bits.
    times = lambda a, state: a.bitwiseAND(low) * state + (F.shiftright(a, 16) * state).bitwiseAND(low) * (1 << 16)
    leapt = lambda state, by: F.pmod(times(by["a"], state) + by["c"], F.lit(1 << 32))
    n = F.pmod(F.greatest(F.col(block).cast("bigint"), F.lit(0)), F.lit(1 << 32)) * last
    start = F.aggregate(steps, F.lit(seed & 0xFFFFFFFF).cast("bigint"), lambda state, by: F.when(n.bitwiseAND(by["bit"]) != 0, leapt(state, by)).otherwise(state))

    def step(acc: Column, i: Column) -> Column:
        state = grown(acc["state"])
        j = F.shiftright(state * (i + 1), 32)
        swapped = F.transform(acc["row"], lambda x, k: F.when(k == i, F.get(acc["row"], j.cast("int"))).when(k == j, F.get(acc["row"], i.cast("int"))).otherwise(x))
        return F.struct(state.alias("state"), swapped.alias("row"))

    first = F.struct(start.alias("state"), F.array(*map(F.lit, items)).alias("row"))
    row = F.aggregate(numbers(F.lit(last), F.lit(1), -1), first, step, lambda acc: acc["row"])
    return blocks.select(block, F.posexplode(row).alias("position", "item"))


def _newest_keys(seen: DataFrame, capacity: int, by: str, order: str, key: str) -> DataFrame:
    """The `capacity` keys of each (cache, range) that were asked for last, with the place of that request and the cache's last range."""
    w = Window.partitionBy(by, "_range").orderBy(F.desc(order), F.desc(key))
    last = seen.groupBy(by, "_range", key).agg(F.max(order).alias(order), F.max("_last").alias("_last"))
    return last.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= capacity).drop("_rank")


def _states_before(rows: DataFrame, capacity: int, by: str, order: str, key: str) -> DataFrame:
    """(by, _range, order, key): what each cache holds where a range of its requests begins, unless it is the cache's first.

    States are combined over 1, 2, 4, ... ranges, so that no task sees all ranges of a cache."""
    # A range's ends cut one cache each at most, so there are no more of these caches than ranges.
    spans = written(rows.groupBy(by).agg(F.min("_range").alias("_from"), F.max("_range").alias("_last")).filter("_from < _last"), "spans")
    longest = spans.agg(F.max(F.col("_last") - F.col("_from"))).first()[0] or 0
    cut = rows.join(F.broadcast(spans.withColumnRenamed(by, "_by")), F.col(by).eqNullSafe(F.col("_by"))).drop("_by", "_from")
    state = written(_newest_keys(cut, capacity, by, order, key), "states")
    step = 1
    while step < longest:
        moved = state.withColumn("_range", F.col("_range") + step).filter("_range <= _last")
        state = written(_newest_keys(state.unionByName(moved), capacity, by, order, key), "states")
        step *= 2
    return state.withColumn("_range", F.col("_range") + 1).filter("_range <= _last").select(by, "_range", order, key)


def lru_replay(requests: DataFrame, capacity: int, by: str = "cache", order: str = "seq", key: str = "key", ranges: int | None = None) -> DataFrame:
    """Requests with `hit` under a least-recently-used cache: a request hits if fewer than `capacity` other keys came since its key's last request.

    Requests are dealt into `ranges` of (cache, order), by default of RANGE_ROWS rows at most, and no fewer than shuffle partitions.
    A range is replayed from what its cache held before it, with an ordered table of at most `capacity` keys. Requests of one
    place are taken in the order of their keys."""
    from collections import OrderedDict
    from collections.abc import Iterator

    import pyarrow as pa

    names = [by, order, key]
    spark = requests.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-requests.count() // RANGE_ROWS))
    rows = written(requests.select(*names).repartitionByRange(ranges, *names).withColumn("_range", F.spark_partition_id()), "ranges")
    both = rows.withColumn("_asked", F.lit(True)).unionByName(_states_before(rows, capacity, *names).withColumn("_asked", F.lit(False)))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()
        at = None
        for batch in batches:
            hits = []
            for c, k, r, asked in zip(*(batch.column(x).to_pylist() for x in (by, key, "_range", "_asked")), strict=True):
                if (r, c) != at:
                    held.clear()
                    at = (r, c)
                if asked:
                    hits.append(k in held)
                held[k] = True
                held.move_to_end(k)
                if len(held) > capacity:
                    held.popitem(last=False)
            out = batch.filter(batch.column("_asked"))
            yield pa.RecordBatch.from_arrays([*(out.column(x) for x in names), pa.array(hits, pa.bool_())], names=[*names, "hit"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.select(*names).schema) + ", hit boolean"
    return both.repartition(ranges, "_range").sortWithinPartitions("_range", by, "_asked", order, key).mapInArrow(replay, schema)
