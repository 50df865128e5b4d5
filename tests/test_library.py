"""Properties and small cases beyond the SQL checks."""

import gzip
import io
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoplate.functions import geometry as G
from chronoplate.functions import rotation as R
from chronoplate.operators import domains, measurements, rotations, tiles
from chronoplate.plans import rotation_queries
from chronoplate.sources import artifacts, features, rot
from chronoplate.streaming import requests


#: A chain 301 > 201 > 101 > 0, a crossover (202), a repeated record (101), a plate of one record (401), related plates that are undefined (501, 701), a root spelled 000 (601).
MODEL = """101 0 0 0 0 0
101 50 40 -30 12 0
101 50 40 -30 12 0
101 100 55 -20 31 0
101 200 60 -10 55 0
201 0 0 0 0 101
201 80 10 100 -15 101
201 150 20 110 -42 101
202 0 0 0 0 101
202 100 30 60 20 101
202 100 35 65 22 0
202 180 38 70 35 0
301 0 0 0 0 201
301 60 -25 15 8 201
301 200 -35 25 28 201
401 0 5 5 9 201
501 0 0 0 0 999
501 120 70 140 18 999
601 0 0 0 0 000
601 90 -60 33 14 000
701 30 12 34 5 998"""


def small_totals(spark):
    return rotations.plate_rotations(rot.series(rot.parse_text(spark, MODEL)), rotation_queries.ages(spark))


def test_rotations_are_unit_and_inverse_undoes_them(spark):
    q = small_totals(spark).filter("q is not null")
    m = R.matrix(F.col("q"))
    v = R.unit_vector(F.lit(33.0), F.lit(-12.0))
    back = R.apply(R.transpose(m), R.apply(m, v))
    for r in q.select((F.col("q.x") ** 2 + F.col("q.y") ** 2 + F.col("q.z") ** 2 + F.col("q.w") ** 2).alias("n"), R.distance(back, v).alias("d")).collect():
        assert abs(r.n - 1) < 1e-9 and r.d < 1e-9


def test_chains_pass_single_records_and_stop_at_unknown_plates(spark):
    got = {r.plate_id: r.q for r in small_totals(spark).filter("age = 120").collect()}
    assert got["401"] == got["201"]  # one record: its related plate's rotation
    assert got["501"] is not None  # the related plate is unknown: its own rotation
    assert got["701"] is None  # neither


def test_files_follow_each_other(spark, tmp_path):
    (tmp_path / "a.rot").write_text("1 0 0 0 0 0\n1 10 1 2 3 0\n")
    (tmp_path / "b.rot").write_text("1 10 1 2 3 0\n1 20 4 5 6 0\n")
    kept = rot.series(rot.read(spark, str(tmp_path / "a.rot"), str(tmp_path / "b.rot")))
    assert [r.age for r in kept.orderBy("line_no").collect()] == [0.0, 10.0, 20.0]


def test_archives_by_their_first_bytes(spark, tmp_path):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("read.me", "no")
        z.writestr("x/f.gpml", "<zip/>")
    (tmp_path / "a.gpmlz").write_bytes(gzip.compress(b"<gz/>"))
    (tmp_path / "b.gpmlz").write_bytes(packed.getvalue())
    (tmp_path / "c.gpml").write_text("<plain/>")
    got = features.read_files(spark, str(tmp_path)).orderBy("path").collect()
    assert [r.text for r in got] == ["<gz/>", "<zip/>", "<plain/>"]
    with pytest.raises(ValueError):
        empty = io.BytesIO()
        zipfile.ZipFile(empty, "w").close()
        features.decode_archive(empty.getvalue())


def test_levels_have_the_known_numbers_of_tiles(spark):
    assert [tiles.grid(spark, n, s).count() for n, s in ((4, "geographic"), (4, "web-mercator"), (3, "web-mercator"))] == [512, 256, 64]


def test_subdivision_needs_a_positive_span(spark):
    with pytest.raises(ValueError):
        tiles.subdivide(spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE"), 0)


def test_composites_cover_full_and_count_sources(spark):
    rows = spark.createDataFrame([("a", "1", 0.0, 0.0, 10.0, 10.0), ("b", "1", -180.0, -90.0, 180.0, 90.0)], "feature_id STRING, plate_id STRING, west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE").withColumns({"begin_age": F.lit(9.0), "end_age": F.lit(0.0)})
    parts = tiles.tiles_of_rectangles(rows, 1)
    merged = tiles.composites(parts)
    assert merged.agg(F.sum("sources")).first()[0] == parts.count() and merged.filter("not covers_full").count() == 0
    counts = {r.age: (r.visible, r.hidden) for r in tiles.visibility_counts(merged, [9.0, 9.5]).collect()}
    assert counts == {9.0: (8, 0), 9.5: (0, 8)}


def test_draw_order_puts_numbers_first(spark):
    ids = spark.createDataFrame([("b",), ("10",), ("9",), ("9",)], "plate_id STRING")
    assert [r.plate_id for r in domains.draw_order(ids).orderBy("draw_order").collect()] == ["9", "9", "10", "b"]


def test_holes_count_against_an_area(spark):
    square = lambda a, b: F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in ((a, a), (b, a), (b, b), (a, b))))
    assert spark.range(1).select(G.polygon_area(square(0.0, 4.0), F.array(square(1.0, 2.0)))).first()[0] == 15.0


def test_shuffled_blocks_are_seeded_permutations(spark):
    def plain(items, blocks, seed):
        out = []
        for _ in range(blocks):
            row = list(items)
            for i in range(len(row) - 1, 0, -1):
                seed = (1664525 * seed + 1013904223) % 2**32
                j = seed * (i + 1) // 2**32
                row[i], row[j] = row[j], row[i]
            out.append(row)
        return out

    for items, seed in (("abcdef", 7), ("ab", 8), ("x", 9), ("abcde", 2**32 - 1)):
        rows = measurements.shuffled_blocks(spark.range(9).withColumnRenamed("id", "block"), list(items), seed).orderBy("block", "position").collect()
        assert [r.item for r in rows] == [x for row in plain(items, 9, seed) for x in row]


def test_process_tree_with_cycles_and_deep_chains(spark):
    chain = [(i + 1, i) for i in range(100, 400)]
    p = spark.createDataFrame([(2, 1), (3, 2), (2, 3), (9, 9), (7, None), (None, 1), *chain], "pid LONG, parent LONG")
    roots = spark.createDataFrame([(1,), (100,), (150,), (77,)], "pid LONG")
    got = {(r.root, r.pid) for r in measurements.process_tree(p, roots).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (77, 77), *((100, i) for i in range(100, 401)), *((150, i) for i in range(150, 401))}
    assert measurements.process_tree(p.limit(0), roots).count() == 4


def test_nearest_has_no_bound(spark):
    rng = random.Random(3)
    left = [(i, rng.choice([rng.uniform(0, 100), rng.uniform(5_000, 900_000)])) for i in range(200)] + [(900, None), (901, 50.0), (901, 50.0)]
    right = [(i, rng.choice([rng.uniform(0, 100), rng.uniform(2_000_000, 2_000_100)])) for i in range(60)] + [(99, None)]
    l, r = spark.createDataFrame(left, "id INT, t DOUBLE"), spark.createDataFrame(right, "rid INT, rt DOUBLE")
    want = Counter((i, None if t is None else min((abs(t - u), u, j) for j, u in right if u is not None)[2]) for i, t in left)
    assert Counter((x.id, x.near_rid) for x in measurements.nearest(l, r, "t", "rt", 10.0).collect()) == want
    assert {x.near_rid for x in measurements.nearest(l, r.limit(0), "t", "rt", 10.0).collect()} == {None}


def test_rotations_of_pairs_and_many_plates(spark):
    """Chains of a large model by pairs equal those by ages; a cycle is an error."""
    rows = [(str(i), float(a), 10.0 + i % 7, 20.0, a / (3 + i % 5), str(i // 3), i * 3 + k) for i in range(1, 400) for k, a in enumerate((0, 50, 120))]
    model = spark.createDataFrame(rows, "plate_id STRING, age DOUBLE, pole_lat DOUBLE, pole_lon DOUBLE, angle DOUBLE, related_id STRING, line_no LONG")
    ages = spark.createDataFrame([(float(a),) for a in range(0, 120, 10)], "age DOUBLE")
    every = {(r.plate_id, r.age): r.q for r in rotations.plate_rotations(rot.series(model), ages).collect()}
    assert len(every) == 399 * 12 and all(abs(sum(x * x for x in q) - 1) < 1e-9 for q in every.values())
    some = spark.createDataFrame([("333", 30.0), ("5", 110.0), ("nowhere", 10.0), ("5", 110.0)], "plate_id STRING, age DOUBLE")
    got = {(r.plate_id, r.age): r.q for r in rotations.plate_rotations(rot.series(model), some).collect()}
    assert got == {k: every[k] for k in (("333", 30.0), ("5", 110.0))}
    cycle = model.filter("plate_id in ('4', '5')").withColumn("related_id", F.when(F.col("plate_id") == "4", "5").otherwise("4"))
    with pytest.raises(ValueError):
        rotations.plate_rotations(cycle, ages).collect()


def test_long_chains_at_many_ages_equal_a_walk(spark, monkeypatch):
    """A chain of 300 plates, with single records and series whose ages don't ascend, by doubled steps."""
    rng = random.Random(8)
    rows, line = [], 0
    for i in range(1, 301):
        ages = [0.0] if i % 9 == 0 else [rng.uniform(5, 60) * k for k in range(rng.randint(2, 6))]
        for a in sorted(ages) if i % 10 or i < 50 else ages[::-1]:
            rows.append((str(i), a, rng.uniform(-80, 80), rng.uniform(-180, 180), rng.uniform(-40, 40), str(i - 1), line))
            line += 1
    model = rot.series(spark.createDataFrame(rows, "plate_id STRING, age DOUBLE, pole_lat DOUBLE, pole_lon DOUBLE, angle DOUBLE, related_id STRING, line_no LONG"))
    asked = spark.createDataFrame([(float(a),) for a in range(0, 200, 25)], "age DOUBLE")
    own = {(r.plate_id, r.age): r for r in rotations.own_rotations(model, asked).collect()}
    got = {(r.plate_id, r.age): r.q for r in rotations.plate_rotations(model, asked).collect()}
    assert len(got) == 300 * 8
    times = lambda a, b: (a.w * b[0] + a.x * b[3] + a.y * b[2] - a.z * b[1], a.w * b[1] - a.x * b[2] + a.y * b[3] + a.z * b[0], a.w * b[2] + a.x * b[1] - a.y * b[0] + a.z * b[3], a.w * b[3] - a.x * b[0] - a.y * b[1] - a.z * b[2])
    for plate, age in rng.sample(sorted(got), 60):
        q, at, met = (0.0, 0.0, 0.0, 1.0), plate, False
        while (at, age) in own:
            o = own[at, age]
            met = met or o.q is not None
            q = times(o.q, q) if o.q else q
            at = o.related_id
        assert (got[plate, age] is None) == (not met and at != "0")
        assert got[plate, age] is None or max(abs(a - b) for a, b in zip(q, got[plate, age], strict=True)) < 1e-9
    some = spark.createDataFrame([("299", 50.0), ("7", 175.0), ("x", 0.0)], "plate_id STRING, age DOUBLE")
    monkeypatch.setattr(rotations, "ALL_PLATES_ROWS", 0)
    monkeypatch.setattr(rotations, "ALL_PLATES_SHARE", 0)
    assert {(r.plate_id, r.age): r.q for r in rotations.plate_rotations(model.filter("plate_id > '280' or length(plate_id) < 2"), some).collect()}.keys() == {("299", 50.0), ("7", 175.0)}
    plain = {p: [r for r in model.orderBy("line_no").collect() if r.plate_id == p] for p in ("60", "70", "7")}
    for plate, records in plain.items():
        for age in (25.0, 100.0):
            at = max(records[0].age, min(records[-1].age, age))
            fits = [i for i in range(len(records) - 1) if at <= records[i + 1].age and (at > records[i].age or i == 0)]
            assert ((plate, age) in own) == bool(fits)


@pytest.mark.parametrize("capacity", [1, 3, 8])
def test_cache_replay_by_ranges_equals_a_replay_in_order(spark, capacity):
    rng = random.Random(capacity)
    # One hot cache over many ranges, with a long stretch of one key, small caches and a null one.
    rows = [("hot", i, 5 if 400 < i < 900 else rng.randrange(12)) for i in range(1500)] + [(c, i, rng.choice([None, 1, 2, 3, 4])) for c in ("a", "b", None) for i in range(40)]
    want = Counter()
    for cache in ("hot", "a", "b", None):
        held = []
        for c, i, k in rows:
            if c == cache:
                want[c, i, k, k in held] += 1
                held = ([k] + [x for x in held if x != k])[:capacity]
    rng.shuffle(rows)
    requests = spark.createDataFrame(rows, "cache STRING, seq LONG, key LONG")
    for ranges in (1, 23):
        done = measurements.lru_replay(requests, capacity, ranges=ranges)
        assert Counter(tuple(r) for r in done.collect()) == want
        sizes = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
        assert ranges == 1 or max(sizes) < len(rows) / 2


def test_registered_replay_takes_all_events(spark):
    from collections import OrderedDict

    from chronoplate.plans import catalog

    got = {(r.cache, r.seq): r.hit for r in catalog.QUERIES["W6_A21_lru_replay_all"](spark, "/root/testdata/sf0.01").collect()}
    held, want = {}, {}
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id", "user_id").orderBy("event_id").collect()
    for r in events:
        cache, key = held.setdefault(r.user_id % 5, OrderedDict()), (r.event_id * 7) % 60
        want[r.user_id % 5, r.event_id] = key in cache
        cache[key] = True
        cache.move_to_end(key)
        if len(cache) > 8:
            cache.popitem(last=False)
    assert len(events) > 1500 and got == want


def test_csv_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q", b'), (2, None), (3, "x\ny")], "id INT, t STRING")
    artifacts.write_csv(rows.filter("id < 3"), str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert {(r.id, r.t) for r in back.collect()} == {("1", 'a "q", b'), ("2", None)}
    assert {r.line for r in artifacts.csv_lines(rows).collect()} == {'1,"a ""q"", b"', "2,", '3,"x\ny"'}


def test_latest_age_of_a_stream_equals_that_of_a_table(spark, tmp_path):
    rows = spark.createDataFrame([("s", f"2026-01-01 00:00:{i:02d}", i, float(i % 7)) for i in range(30)], "session STRING, ts STRING, token LONG, age DOUBLE").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = requests.latest_ages(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), window="10 seconds")
    run = stream.writeStream.format("memory").queryName("ages").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(spark.table("ages").collect()) == sorted(requests.latest_ages(rows, window="10 seconds").collect())
