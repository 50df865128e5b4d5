"""Queries on finite rotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplate.functions import rotation as R
from chronoplate.operators import rotations as O
from chronoplate.operators.tables import spread, written
from chronoplate.plans.registry import q_columns, query, rounded, table
from chronoplate.sources import rot

#: A model of as many plates as customers, with three to five records each; plate k + 100 moves with plate k / 3 + 100, the first ones
#: with the anchor. One in seven repeats a record, one in 13 changes its related plate at an age (a crossover), one in 11 has a single
#: record, one in 17 a related plate that the model lacks, one in 19 an anchor spelled 000, and one in 29 begins later.
_PLATE = "CASE WHEN k <= 3 THEN '0' WHEN k % 19 = 0 THEN '000' WHEN k % 17 = 0 THEN 'u' || k ELSE CAST(CAST(floor(k / 3) AS INT) + 100 AS {text}) END"
_FIELDS = {
    "plate_id": "CAST(k + 100 AS {text})",
    "age": "CAST(j * (30 + k % 25) + CASE WHEN k % 29 = 0 THEN 30 ELSE 0 END AS DOUBLE)",
    "pole_lat": "CAST((k * 7 + j * 13) % 170 - 85 AS DOUBLE)",
    "pole_lon": "CAST((k * 11 + j * 29 + r * 5) % 360 - 180 AS DOUBLE)",
    "angle": "CAST(j * (k % 23 - 10.5) AS DOUBLE)",
    "related_id": "CASE WHEN k % 13 = 0 AND (j > 2 OR j = 2 AND r = 1) THEN '0' ELSE " + _PLATE + " END",
    "line_no": "CAST(k * 100 + j * 10 + r AS BIGINT)",
}
_TWICE = "r = 0 OR (k % 7 = 0 AND k % 13 <> 0 AND j = 1) OR (k % 13 = 0 AND j = 2)"


AGES = (0.0, 25.0, 75.0, 120.0, 250.0)


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    lines = keys.withColumn("j", F.explode(F.expr("sequence(0, CASE WHEN k % 11 = 0 THEN 0 ELSE 2 + CAST(k % 3 AS INT) END)"))).withColumn("r", F.explode(F.array(F.lit(0), F.lit(1)))).filter(_TWICE)
    return lines.select(*(F.expr(x.format(text="STRING")).alias(c) for c, x in _FIELDS.items()))


def ages(spark: SparkSession) -> DataFrame:
    """The ages that queries ask for, a parameter of theirs."""
    return spark.createDataFrame([(a,) for a in AGES], "age DOUBLE")


#: The same steps in SQL, each a common table expression.
WITH_MODEL = f"""WITH RECURSIVE rec AS (
  SELECT {", ".join(f"{x.format(text='VARCHAR')} AS {c}" for c, x in _FIELDS.items())}
  FROM (SELECT c_custkey AS k, unnest(range(0, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 3 + c_custkey % 3 END)) AS j FROM customer), (VALUES (0), (1)) t(r) WHERE {_TWICE}
), kept AS (
  SELECT * FROM (SELECT *, lag(age) OVER w AS la, lag(related_id) OVER w AS lr FROM rec WINDOW w AS (PARTITION BY plate_id ORDER BY line_no)) WHERE la IS NULL OR NOT (la = age AND lr = related_id)
), ser AS (
  SELECT plate_id, CASE WHEN lead(age) OVER w = age THEN age - 0.01::DOUBLE ELSE age END AS age, pole_lat, pole_lon, angle, related_id, line_no FROM kept WINDOW w AS (PARTITION BY plate_id ORDER BY line_no)
), quat AS (
  SELECT *, cos(radians(pole_lat)) * cos(radians(pole_lon)) * sin(radians(angle) / 2) AS qx, cos(radians(pole_lat)) * sin(radians(pole_lon)) * sin(radians(angle) / 2) AS qy,
    sin(radians(pole_lat)) * sin(radians(angle) / 2) AS qz, cos(radians(angle) / 2) AS qw FROM ser
), span AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY plate_id) AS n, lead(age) OVER w AS na, lead(related_id) OVER w AS nr,
    lead(qx) OVER w AS nx, lead(qy) OVER w AS ny, lead(qz) OVER w AS nz, lead(qw) OVER w AS nw,
    min(age) OVER (PARTITION BY plate_id) AS fa, max(age) OVER (PARTITION BY plate_id) AS ea
  FROM quat WINDOW w AS (PARTITION BY plate_id ORDER BY line_no)
), asked AS (SELECT unnest([{", ".join(map(str, AGES))}])::DOUBLE AS t),
hit AS (
  SELECT *, greatest(fa, least(ea, t)) AS c FROM span, asked
  WHERE n = 1 OR (na IS NOT NULL AND greatest(fa, least(ea, t)) <= na AND (greatest(fa, least(ea, t)) > age OR i = 1))
), arc AS (
  SELECT *, CASE WHEN na <> age THEN (c - age) / (na - age) ELSE 0 END AS f, qx * nx + qy * ny + qz * nz + qw * nw AS d FROM hit
), wts AS (
  SELECT *, CASE WHEN abs(d) > 1 - 1e-12 THEN 1 - f ELSE sin((1 - f) * acos(least(1, abs(d)))) / sin(acos(least(1, abs(d)))) END AS wa,
    CASE WHEN abs(d) > 1 - 1e-12 THEN f ELSE sin(f * acos(least(1, abs(d)))) / sin(acos(least(1, abs(d)))) END * CASE WHEN d < 0 THEN -1 ELSE 1 END AS wb FROM arc
), own AS (
  SELECT plate_id, t AS age, CASE WHEN n > 1 THEN wa * qx + wb * nx END AS qx, CASE WHEN n > 1 THEN wa * qy + wb * ny END AS qy, CASE WHEN n > 1 THEN wa * qz + wb * nz END AS qz,
    CASE WHEN n > 1 THEN wa * qw + wb * nw END AS qw, CASE WHEN n = 1 OR c <= wts.age THEN related_id ELSE nr END AS related_id
  FROM wts QUALIFY row_number() OVER (PARTITION BY plate_id, t ORDER BY i) = 1
), walk AS (
  SELECT plate_id, age, plate_id AS here, 0::DOUBLE AS x, 0::DOUBLE AS y, 0::DOUBLE AS z, 1::DOUBLE AS w, FALSE AS met, 0 AS depth FROM own
  UNION ALL
  SELECT k.plate_id, k.age, o.related_id,
    CASE WHEN o.qw IS NULL THEN k.x ELSE o.qw * k.x + o.qx * k.w + o.qy * k.z - o.qz * k.y END, CASE WHEN o.qw IS NULL THEN k.y ELSE o.qw * k.y - o.qx * k.z + o.qy * k.w + o.qz * k.x END,
    CASE WHEN o.qw IS NULL THEN k.z ELSE o.qw * k.z + o.qx * k.y - o.qy * k.x + o.qz * k.w END, CASE WHEN o.qw IS NULL THEN k.w ELSE o.qw * k.w - o.qx * k.x - o.qy * k.y - o.qz * k.z END,
    k.met OR o.qw IS NOT NULL, k.depth + 1
  FROM walk k JOIN own o ON o.plate_id = k.here AND o.age = k.age AND k.here NOT IN ('0', '000')
), total AS (
  SELECT plate_id, age, CASE WHEN met OR here IN ('0', '000') THEN x END AS x, CASE WHEN met OR here IN ('0', '000') THEN y END AS y, CASE WHEN met OR here IN ('0', '000') THEN z END AS z, CASE WHEN met OR here IN ('0', '000') THEN w END AS w
  FROM walk QUALIFY row_number() OVER (PARTITION BY plate_id, age ORDER BY depth DESC) = 1
), mat AS (
  SELECT plate_id, age, x IS NOT NULL AS known, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(z, 0) AS z, coalesce(w, 1) AS w FROM total
), m AS (
  SELECT plate_id, age, known, x*x - y*y - z*z + w*w AS m0, 2*(x*y - z*w) AS m1, 2*(x*z + y*w) AS m2, 2*(x*y + z*w) AS m3, -x*x + y*y - z*z + w*w AS m4, 2*(y*z - x*w) AS m5,
    2*(x*z - y*w) AS m6, 2*(y*z + x*w) AS m7, -x*x - y*y + z*z + w*w AS m8 FROM mat
)
"""

TEXT = [
    "! a model", "", "  101 0.0 0.0 0.0 0.0 0 ! present day", "101 50 40.5 -30 12 0", "101 fifty 40 -30 12 0", "101 60 1e1 -3.5E+1 .5 000 extra", "102\t10.0\t5\t6\t7\t101!x",
    "103 10 5 6 7", "104 1d 5 6 7 0", "105 NaN 5 6 7 0", "106 0x10 5 6 7 0", "107 -250 5. +6 -7 0", "!108 1 2 3 4 5",
]


@query(
    "S1_rot_parse",
    "WITH l AS (SELECT [" + ", ".join("'" + t.replace("\t", "'||chr(9)||'") + "'" for t in TEXT) + f"][p_partkey % {len(TEXT)} + 1] AS v, p_partkey AS line_no FROM part), "
    r"""f AS (SELECT string_split(trim(regexp_replace(split_part(v, '!', 1), '\s+', ' ', 'g')), ' ') AS f, line_no FROM l),
    ok AS (SELECT * FROM f WHERE len(f) >= 6 AND len(list_filter(f[2:5], lambda x: regexp_full_match(x, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?'))) = 4)
    SELECT f[1] AS plate_id, f[2]::DOUBLE AS age, f[3]::DOUBLE AS pole_lat, f[4]::DOUBLE AS pole_lon, f[5]::DOUBLE AS angle, f[6] AS related_id, line_no::BIGINT AS line_no FROM ok""",
)
def rot_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each part."""
    line = F.get(F.array(*map(F.lit, TEXT)), (F.col("p_partkey") % len(TEXT)).cast("int"))
    return rot.parse_lines(table(spark, sf_dir, "part").select(line.alias("value"), F.col("p_partkey").alias("line_no")))


@query("S3_rot_replace", WITH_MODEL + "SELECT * FROM rec WHERE line_no % 300 >= 100 UNION ALL SELECT DISTINCT plate_id, 0.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE, '0', line_no // 100 FROM rec WHERE line_no % 300 < 100")
def rot_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later text brings one record for every third plate."""
    first = model(spark, sf_dir)
    later = first.filter("line_no % 300 < 100").select(F.concat_ws(" ", "plate_id", F.lit("0 1 2 3 0")).alias("value"), F.floor(F.col("line_no") / 100).alias("line_no")).distinct()
    return rot.replace_plates(first, rot.parse_lines(later))


@query("S16_rot_url_list", "SELECT p_partkey, ['a' || p_partkey || '.rot', 'b c.rot', 'd.rot'] AS urls, 3 AS n FROM part")
def rot_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("  a"), F.col("p_partkey").cast("string"), F.lit(".rot \r\n\n b c.rot\n\t\nd.rot"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("t")).select("p_partkey", rot.url_list("t").alias("urls")).withColumn("n", F.size("urls"))


@query("W1_W2_series", WITH_MODEL + "SELECT * FROM ser")
def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rot.series(model(spark, sf_dir))


@query("W3_intervals", WITH_MODEL + "SELECT plate_id, age, i, n, na AS next_age, nr AS next_related, fa AS first_age, ea AS last_age FROM span")
def interval_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.intervals(rot.series(model(spark, sf_dir))).select("plate_id", "age", F.col("i").cast("bigint").alias("i"), "n", "next_age", "next_related", "first_age", "last_age")


_ROUND_Q = ", ".join(f"round(q{c}, 6) + 0.0::DOUBLE AS q{c}" for c in "xyzw")


@query("M1_pole_quaternion", WITH_MODEL + f"SELECT plate_id, line_no, {_ROUND_Q} FROM quat")
def pole_quaternion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.from_pole(F.col("pole_lon"), F.col("pole_lat"), F.col("angle"))
    return rounded(rot.series(model(spark, sf_dir)).select("plate_id", "line_no", *q_columns(q)), "qx", "qy", "qz", "qw")


@query("J2_M2_own_rotation", WITH_MODEL + f"SELECT plate_id, age, related_id, {_ROUND_Q} FROM own")
def own_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = O.own_rotations(rot.series(model(spark, sf_dir)), ages(spark))
    return rounded(own.select("plate_id", "age", "related_id", *q_columns(F.col("q"))), "qx", "qy", "qz", "qw")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.plate_rotations(rot.series(model(spark, sf_dir)), ages(spark))


@query("J3_M3_plate_rotation", WITH_MODEL + "SELECT plate_id, age, round(x, 6) + 0.0::DOUBLE AS qx, round(y, 6) + 0.0::DOUBLE AS qy, round(z, 6) + 0.0::DOUBLE AS qz, round(w, 6) + 0.0::DOUBLE AS qw FROM total")
def plate_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(totals(spark, sf_dir).select("plate_id", "age", *q_columns(F.col("q"))), "qx", "qy", "qz", "qw")


@query("M4_M11_matrix", WITH_MODEL + "SELECT plate_id, age, " + ", ".join(f"round(m{i}, 6) + 0.0::DOUBLE AS m{i}" for i in range(9)) + " FROM m")
def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"m{i}" for i in range(9)]
    return rounded(O.plate_matrices(totals(spark, sf_dir)).select("plate_id", "age", *(F.get("m", F.lit(i)).alias(n) for i, n in enumerate(names))), *names)


@query("M5_inverse_matrix", WITH_MODEL + "SELECT plate_id, age, " + ", ".join(f"round(m{3 * (i % 3) + i // 3}, 6) + 0.0::DOUBLE AS m{i}" for i in range(9)) + " FROM m")
def inverse_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"m{i}" for i in range(9)]
    return rounded(O.plate_matrices(totals(spark, sf_dir)).withColumn("t", R.transpose(F.col("m"))).select("plate_id", "age", *(F.get("t", F.lit(i)).alias(n) for i, n in enumerate(names))), *names)


_POINTS = f"""pts AS (SELECT event_id, ((event_id * 37) % 36000)::DOUBLE / 100 - 180 AS lon, ((event_id * 53) % 17000)::DOUBLE / 100 - 85 AS lat,
  (100 + event_id % 160)::VARCHAR AS plate_id, [{", ".join(map(str, AGES))}][user_id % {len(AGES)} + 1]::DOUBLE AS age FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda values, i: F.get(F.array(*map(F.lit, values)), i)
    return table(spark, sf_dir, "events").select(
        "event_id",
        ((F.col("event_id") * 37) % 36000 / 100 - 180).alias("lon"),
        ((F.col("event_id") * 53) % 17000 / 100 - 85).alias("lat"),
        (100 + F.col("event_id") % 160).cast("string").alias("plate_id"),
        at(AGES, (F.col("user_id") % len(AGES)).cast("int")).alias("age"),
    )


def _moved_sql(order: str) -> str:
    a = order.split()
    row = lambda i: f"({a[3 * i]} * cos(radians(lat)) * cos(radians(lon)) + {a[3 * i + 1]} * cos(radians(lat)) * sin(radians(lon)) + {a[3 * i + 2]} * sin(radians(lat)))"
    return (
        WITH_MODEL
        + f", {_POINTS} SELECT event_id, plate_id, p.age, round(CASE WHEN known THEN degrees(atan2({row(1)}, {row(0)})) END, 5) + 0.0::DOUBLE AS new_lon, "
        + f"round(CASE WHEN known THEN degrees(atan2({row(2)}, sqrt({row(0)} * {row(0)} + {row(1)} * {row(1)}))) END, 5) + 0.0::DOUBLE AS new_lat FROM pts p LEFT JOIN m USING (plate_id, age)"
    )


@query("M6_points_at_age", _moved_sql("m0 m1 m2 m3 m4 m5 m6 m7 m8"))
def points_at_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: where each point is at its age."""
    asked = points(spark, sf_dir)
    moved = O.rotate_points(asked, O.plate_rotations(rot.series(model(spark, sf_dir)), asked))
    return rounded(moved.select("event_id", "plate_id", "age", "new_lon", "new_lat"), "new_lon", "new_lat", digits=5)


@query("M7_points_to_present", _moved_sql("m0 m3 m6 m1 m4 m7 m2 m5 m8"))
def points_to_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = O.rotate_points(points(spark, sf_dir), totals(spark, sf_dir), inverse=True)
    return rounded(moved.select("event_id", "plate_id", "age", "new_lon", "new_lat"), "new_lon", "new_lat", digits=5)


@query("M10_there_and_back", WITH_MODEL + f", {_POINTS} SELECT event_id, CASE WHEN known THEN CASE WHEN abs(lon) > 179.9999 THEN -180 ELSE round(lon, 4) END END::DOUBLE AS lon, CASE WHEN known THEN round(lat, 4) END::DOUBLE AS lat FROM pts LEFT JOIN m USING (plate_id, age)")
def there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to their age and back to the present, by pairs of plate and age, whose rotations are found once."""
    own, given = O.RotationModel(model(spark, sf_dir)), points(spark, sf_dir)
    turns = written(own.rotations(given.select("plate_id", "age")), "turns")
    there = own.at_age(spread(given), rotations=turns).select("event_id", "plate_id", "age", F.col("new_lon").alias("lon"), F.col("new_lat").alias("lat"))
    back = rounded(own.at_present(there, rotations=turns).select("event_id", F.col("new_lon").alias("lon"), F.col("new_lat").alias("lat")), "lon", "lat", digits=4)
    return back.withColumn("lon", F.when(F.abs("lon") > 179.9999, F.lit(-180.0)).otherwise(F.col("lon")))


@query(
    "M8_rotate_about_axis",
    f"""WITH {_POINTS}, v AS (SELECT event_id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z,
      cos(radians(35::DOUBLE)) * cos(radians(65::DOUBLE)) AS kx, cos(radians(35::DOUBLE)) * sin(radians(65::DOUBLE)) AS ky, sin(radians(35::DOUBLE)) AS kz, radians(22::DOUBLE) AS a FROM pts)
    SELECT event_id, round(x * cos(a) + (ky * z - kz * y) * sin(a) + kx * (kx * x + ky * y + kz * z) * (1 - cos(a)), 6) + 0.0::DOUBLE AS x,
      round(y * cos(a) + (kz * x - kx * z) * sin(a) + ky * (kx * x + ky * y + kz * z) * (1 - cos(a)), 6) + 0.0::DOUBLE AS y,
      round(z * cos(a) + (kx * y - ky * x) * sin(a) + kz * (kx * x + ky * y + kz * z) * (1 - cos(a)), 6) + 0.0::DOUBLE AS z FROM v""",
)
def rotate_about_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.rotate_about(R.unit_vector(F.col("lon"), F.col("lat")), F.lit(65.0), F.lit(35.0), F.lit(22.0))
    return rounded(points(spark, sf_dir).select("event_id", *(v[c].alias(c) for c in "xyz")), "x", "y", "z")


@query(
    "J4_M9_interval_rotation",
    WITH_MODEL
    + """, r AS (SELECT *, lag(age, 1, 0) OVER w AS b, row_number() OVER w AS i FROM ser WINDOW w AS (PARTITION BY plate_id ORDER BY line_no))
    SELECT plate_id, t AS age, pole_lat, pole_lon, angle FROM r, asked QUALIFY row_number() OVER (PARTITION BY plate_id, t ORDER BY CASE WHEN age >= t AND b <= t THEN 0 ELSE 1 END, i) = 1""",
)
def interval_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.interval_rotation(rot.series(model(spark, sf_dir)), ages(spark))


@query(
    "P17_anchor_test",
    "SELECT p_partkey, v AS plate_id, v IN ('0', '000', ' 00 ', '+0', '-0') AS is_anchor FROM (SELECT p_partkey, ['0', '000', ' 00 ', '+0', '-0', p_partkey::VARCHAR, 'a', '0x', '0' || p_partkey, ''][p_partkey % 10 + 1] AS v FROM part)",
)
def anchor_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    ids = F.array(*map(F.lit, ("0", "000", " 00 ", "+0", "-0")), k, F.lit("a"), F.lit("0x"), F.concat(F.lit("0"), k), F.lit(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(ids, (F.col("p_partkey") % 10).cast("int")).alias("plate_id"))
    return rows.withColumn("is_anchor", R.is_anchor(F.col("plate_id"), "0"))


@query("J1_domain_plates", WITH_MODEL + f", {_POINTS} SELECT plate_id, count(*) AS n, count(DISTINCT rec.plate_id) > 0 AS known FROM pts LEFT JOIN (SELECT DISTINCT plate_id FROM rec) rec USING (plate_id) GROUP BY plate_id")
def domain_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which plates of the points the model knows: the points are counted by plate before the join."""
    known = model(spark, sf_dir).select("plate_id").distinct().withColumn("known", F.lit(True))
    counted = points(spark, sf_dir).groupBy("plate_id").agg(F.count("*").alias("n"))
    return counted.join(known, "plate_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query(
    "M24_plate_entries",
    WITH_MODEL + f", {_POINTS}, asked_plate AS (SELECT DISTINCT plate_id FROM pts) SELECT plate_id, coalesce(known, false) AS known, " + ", ".join(f"round(coalesce(m{i}, {int(i % 4 == 0)}), 6) + 0.0::DOUBLE AS m{i}" for i in range(9)) + " FROM asked_plate LEFT JOIN (SELECT * FROM m WHERE age = 75) m USING (plate_id)",
)
def plate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix for every plate of the points at an age: the identity for plates without a rotation, unknown ones included."""
    plates = points(spark, sf_dir).select("plate_id", F.lit(75.0).alias("age")).distinct()
    every = plates.join(O.plate_rotations(rot.series(model(spark, sf_dir)), plates), ["plate_id", "age"], "left")
    names = [f"m{i}" for i in range(9)]
    rows = O.plate_matrices(every).select("plate_id", F.col("q").isNotNull().alias("known"), *(F.get("m", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return rounded(rows, *names)
