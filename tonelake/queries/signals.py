"""Generated signals, session documents and the rest of localization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import acoustics, arrays
from tonelake.operators import catalogue, generators, takes as whole_takes
from tonelake.plans import localization
from tonelake.sources import documents

from .plans import _cells, _KEYS
from .stand_ins import read, rounded, takes


def tone_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A faded two-tone for each nation, at its own pitch."""
    n = read(spark, sf_dir, "nation").select("n_nationkey")
    rows = generators.frames(spark, 0.02, 48000).join(F.broadcast(n))
    x = generators.tone((F.col("n_nationkey") + 1) * 100.0, 0.5, 48000) + generators.tone(3000.0, 0.25, 48000)
    return rounded(rows.select("n_nationkey", "idx", generators.faded(x, 960, 96).alias("x")), "x")


def _sounds(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The samples to be of a sound of each supplier, and where it starts in pitch."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50 + 20.0).alias("lo"))
    return s.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sweep_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short sweep for each supplier, from its own pitch on."""
    x = generators.log_sweep(F.col("lo"), 6000.0, 0.5, 0.02, 16000)
    return rounded(_sounds(spark, sf_dir, 320).select("s_suppkey", "idx", x.alias("x")), "x", digits=5)


def chirp_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = generators.linear_chirp(F.col("lo") * 100, 8000.0, 0.005, 48000)
    return rounded(_sounds(spark, sf_dir, 240).select("s_suppkey", "idx", x.alias("x")), "x", digits=5)


def compensated_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps of suppliers by the inverse of a response that is known at a few frequencies, for most of them."""
    rows = _sounds(spark, sf_dir, 320).select("s_suppkey", "idx", generators.log_sweep(20.0, 6000.0, 0.5, 0.02, 16000).alias("x"))
    k = F.col("s_suppkey")
    points = read(spark, sf_dir, "supplier").where("s_suppkey % 6 <> 5").select(k, F.explode(F.sequence(F.lit(0), k.cast("int") % 4)).alias("i"))
    points = points.select("s_suppkey", (F.lit(30.0) * F.pow(F.lit(4.0), "i")).alias("hz"), ((k + F.col("i") * 7) % 11 - 5.0).alias("db"))
    return rounded(generators.pre_compensated(rows, points, ["s_suppkey"], 20.0, 6000.0, 0.02, 16000), "x", digits=5)


def multitone_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a probe of many tones is in each take."""
    probe = generators.multitone(spark, 512, 8000, 0.5, 500.0, 2500.0).withColumnRenamed("x", "p")
    rows = takes(spark, sf_dir).select("take_id", F.posexplode("samples").alias("idx", "x"))
    return rounded(rows.join(probe, "idx").groupBy("take_id").agg(F.sum(F.col("x").cast("double") * F.col("p")).alias("match")), "match", digits=5)


def trusted_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each part size are near the median price."""
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") + F.when(F.col("p_partkey") % 10 == 0, 500)).alias("v"), "p_retailprice")
    p = p.withColumn("v", F.coalesce("v", "p_retailprice"))
    found = whole_takes.trusted(p, ["p_brand"], "v", most=1.5)
    return found.groupBy("p_brand").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def session_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumns({"loopback_stable": F.col("microphone_id") % 7 != 0, "fixed_reference": F.col("clock_ratio").isNotNull()})
    return localization.mode(cells, ["session"])


def emitter_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumns({"clock_offset": F.when(F.col("microphone_id") % 5 != 0, F.col("microphone_id") * 1.0), "clock_bound": F.when(F.col("order") != 0, 0.25)})
    found = localization.emitter_ranges(cells, F.lit(200.0), localization.Medium(*[F.lit(x) for x in (343.0, 48000.0, 30.0, 0.0, 0.5, 0.0)]))
    return rounded(found.select(*_KEYS, "distance_m", "sigma_samples", "sigma_m", "reason"), "distance_m", "sigma_samples", "sigma_m")


def arrival_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of plane waves told from delays in an array."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.cos("s_suppkey").alias("ux"), (F.sin("s_suppkey") * 0.6).alias("uy"), (F.sin("s_suppkey") * 0.8).alias("uz"))
    at = {"dx": (F.col("k") % 2) * 0.1, "dy": (F.floor(F.col("k") / 2) % 2) * 0.1, "dz": F.floor(F.col("k") / 4) * 0.1}
    rows = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumns(at)
    rows = rows.withColumn("tdoa", -(F.col("ux") * F.col("dx") + F.col("uy") * F.col("dy") + F.col("uz") * F.col("dz")) * 48000 / 343)
    return rounded(localization.directions(rows, ["s_suppkey"], 343.0, 48000.0).drop("residual"), "x", "y", "z")


def channel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of three interleaved channels of each take, and its end after a short filter."""
    one = arrays.channel_of(F.col("samples"), F.lit(1), F.lit(3))
    rows = takes(spark, sf_dir).select("take_id", F.transform(one, lambda e: e.cast("double")).alias("x"))
    y = arrays.convolved(F.col("x"), F.array(F.lit(0.5), F.lit(0.25), F.lit(-0.125)))
    return rounded(rows.select("take_id", F.size("x").alias("n"), F.posexplode(y).alias("idx", "y")), "y")


def drift_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes as a clock that is two percent fast records them."""
    x = F.transform("samples", lambda e: e.cast("double"))
    return rounded(takes(spark, sf_dir).select("take_id", F.posexplode(arrays.warped(x, 20000.0)).alias("idx", "y")), "y")


def room_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    room = arrays.room_metres((k % 9) * 1.5, F.when(k % 7 != 0, (k % 5) + 1.0), F.lit(2.5), F.when(k % 2 == 0, "ft").otherwise("m"))
    return rounded(p.select("p_partkey", room.alias("r")).select("p_partkey", "r.length", "r.width", "r.height", acoustics.longest_range(F.col("r.length"), F.col("r.width"), F.col("r.height")).alias("longest")), "length", "width", "height", "longest")


def capture_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", arrays.frames_fit(F.col("p_retailprice") / 3, F.lit(48000), F.col("p_size")).alias("issue"))


def quality_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", arrays.quality_cell(F.when(F.col("o_orderstatus") == "P", "review").otherwise("done"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") % 101) / 100), F.col("o_orderkey") % 3 != 0).alias("cell"))


def metadata_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's attributes after edits, one of which removes what it names."""
    c = read(spark, sf_dir, "customer")
    old = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    new = F.create_map(F.lit("segment"), F.when(F.col("c_nationkey") % 2 == 0, "").otherwise("moved"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    m = arrays.metadata(old, new)
    return c.select("c_custkey", F.try_element_at(m, F.lit("name")).alias("name"), F.try_element_at(m, F.lit("segment")).alias("segment"), F.try_element_at(m, F.lit("nation")).alias("nation"))


def newest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4).alias("generation"))
    return documents.latest_generation(o, "o_custkey", "generation")


def rate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    wanted = F.when(F.col("p_partkey") % 3 == 0, 44100).when(F.col("p_partkey") % 3 == 1, 88200)
    return p.select("p_partkey", F.array_join(catalogue.rate_candidates(wanted, F.when(F.col("p_size") > 25, 32000)), ",").alias("rates"))


_S = "WITH s AS (SELECT vec_id AS take_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_L = """WITH m AS (SELECT l_orderkey AS session, l_partkey AS source_id, l_linenumber AS repeat_index, l_suppkey AS microphone_id, CASE WHEN l_quantity > 2 THEN l_quantity * 100 END AS a,
  CASE WHEN l_tax > 0 THEN 1 + l_tax / 1000 END AS r, l_discount * 10 AS s, CASE WHEN l_returnflag <> 'A' THEN l_discount * 5000 END AS l, CASE WHEN l_partkey % 3 = 0 THEN 72.0 ELSE 0 END AS own FROM lineitem)"""

SQL = {
    "tone_signal": """SELECT n_nationkey, i AS idx, round((0.5 * sin(2 * pi() * (n_nationkey + 1) * 100 * i / 48000) + 0.25 * sin(2 * pi() * 3000 * i / 48000))
  * CASE WHEN least(i, 959 - i) < 96 THEN 0.5 - 0.5 * cos(pi() * least(i, 959 - i) / 96) ELSE 1 END, 6) + 0.0::DOUBLE AS x FROM nation, range(960) r(i)""",
    "sweep_signal": """SELECT s_suppkey, CAST(i AS INTEGER) AS idx, round(0.5 * sin(2 * pi() * lo * (0.02 / ln(6000 / lo)) * (exp(i / (16000 * (0.02 / ln(6000 / lo)))) - 1)), 5) + 0.0::DOUBLE AS x
FROM (SELECT s_suppkey, s_suppkey % 50 + 20.0::DOUBLE AS lo FROM supplier), range(320) r(i)""",
    "chirp_signal": """SELECT s_suppkey, CAST(i AS INTEGER) AS idx, round(sin(2 * pi() * (lo * (i / 48000) + (8000 - lo) / 0.01 * (i / 48000) * (i / 48000))), 5) + 0.0::DOUBLE AS x
FROM (SELECT s_suppkey, (s_suppkey % 50 + 20.0::DOUBLE) * 100 AS lo FROM supplier), range(240) r(i)""",
    "compensated_sweep": """WITH c AS (SELECT 0.02::DOUBLE / ln(6000.0::DOUBLE / 20) AS k), w AS (SELECT s_suppkey, i, 20 * exp(i / (16000 * k)) AS f, 0.5 * sin(2 * pi() * 20 * k * (exp(i / (16000 * k)) - 1)) AS x FROM supplier, range(320) r(i), c),
p AS (SELECT s_suppkey, j, 30.0::DOUBLE * 4 ** j AS f, (s_suppkey + j * 7) % 11 - 5.0::DOUBLE AS g FROM supplier, range(4) r(j) WHERE s_suppkey % 6 <> 5 AND j <= s_suppkey % 4),
b AS (SELECT w.s_suppkey, w.i, max(w.f) AS wf, max(w.x) AS x, max({'f': p.f, 'g': p.g}) FILTER (p.f <= w.f) AS a, min({'f': p.f, 'g': p.g}) FILTER (p.f > w.f) AS z FROM w LEFT JOIN p USING (s_suppkey) GROUP BY w.s_suppkey, w.i)
SELECT s_suppkey, CAST(i AS INTEGER) AS idx, round(x * 10 ** (-coalesce(CASE WHEN a IS NULL THEN z.g WHEN z IS NULL THEN a.g ELSE a.g + (z.g - a.g) * ln(wf / a.f) / ln(z.f / a.f) END, 0) / 20), 5) + 0.0::DOUBLE AS x FROM b""",
    "multitone_signal": """WITH x AS (SELECT i, sum(cos(2 * pi() * k * i / 512 - pi() * (k - 32) * (k - 31) / 129)) AS x FROM range(512) a(i), range(32, 161) b(k) GROUP BY i), m AS (SELECT i, 0.5 * x / (SELECT max(abs(x)) FROM x) AS p FROM x),
t AS (SELECT vec_id AS take_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT take_id, round(sum(x * p), 5) AS match FROM t JOIN m USING (i) GROUP BY take_id""",
    "trusted_takes": """WITH p AS (SELECT p_brand, p_retailprice + CASE WHEN p_partkey % 10 = 0 THEN 500 ELSE 0 END AS v FROM part), m AS (SELECT p_brand, median(v) AS m FROM p GROUP BY p_brand),
d AS (SELECT p_brand, abs(v - m) AS d FROM p JOIN m USING (p_brand)), s AS (SELECT p_brand, median(d) * 1.4826 * 1.5 AS s FROM d GROUP BY p_brand)
SELECT p_brand, count(*) FILTER (d <= s) AS accepted, count(*) FILTER (d > s) AS rejected FROM d JOIN s USING (p_brand) GROUP BY p_brand""",
    "session_mode": _L + "SELECT session, CASE WHEN bool_and(l IS NOT NULL AND microphone_id % 7 <> 0) THEN 'loopback' WHEN bool_and(r IS NOT NULL) THEN 'emitter' ELSE 'relative' END AS mode FROM m GROUP BY session",
    "emitter_matrix": _L + """, t AS (SELECT *, CASE WHEN microphone_id % 5 <> 0 THEN microphone_id END AS o, ((a - microphone_id) / r - 200 - own) * 343 / 48000 AS x FROM m), f AS (SELECT *, CASE WHEN r IS NULL THEN 'clock_uncorrected'
  WHEN a IS NULL THEN 'arrival_low_confidence' WHEN o IS NULL THEN 'clock_uncorrected' WHEN x < 0 OR x > 30 THEN 'range_implausible' END AS reason FROM t)
SELECT session, source_id, repeat_index, microphone_id, round(CASE WHEN reason IS NULL THEN x END, 6) AS distance_m, round(CASE WHEN reason IS NULL AND microphone_id % 4 <> 0 THEN sqrt(s * s + 0.0625) END, 6) AS sigma_samples,
  round(CASE WHEN reason IS NULL AND microphone_id % 4 <> 0 THEN 343 * sqrt(s * s + 0.0625) / 48000 + x * 0.5 / 343 END, 6) AS sigma_m, reason FROM f""",
    "arrival_directions": "SELECT s_suppkey, round(cos(s_suppkey), 6) AS x, round(sin(s_suppkey) * 0.6, 6) AS y, round(sin(s_suppkey) * 0.8, 6) AS z, CAST(NULL AS VARCHAR) AS reason FROM supplier",
    "channel_split": _S + """, c AS (SELECT take_id, i // 3 AS j, x FROM s WHERE i % 3 = 1 AND i < 63), h AS (SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, 0.25), (2, -0.125)) v(k, h))
SELECT take_id, CAST(21 AS INTEGER) AS n, CAST(j + k AS INTEGER) AS idx, round(sum(x * h), 6) AS y FROM c, h GROUP BY take_id, j + k""",
    "drift_warp": _S + """, k AS (SELECT take_id, k, k / 1.02 AS a, CAST(floor(k / 1.02) AS BIGINT) AS lo FROM (SELECT DISTINCT take_id FROM s), range(65) r(k))
SELECT k.take_id, CAST(k AS INTEGER) AS idx, round(coalesce(p.x, 0) + (coalesce(q.x, 0) - coalesce(p.x, 0)) * (a - lo), 6) AS y
FROM k LEFT JOIN s p ON p.take_id = k.take_id AND p.i = lo LEFT JOIN s q ON q.take_id = k.take_id AND q.i = lo + 1""",
    "room_sizes": """WITH r AS (SELECT p_partkey, p_partkey % 9 * 1.5::DOUBLE AS l, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 5 + 1.0::DOUBLE END AS w, CASE WHEN p_partkey % 2 = 0 THEN 0.3048::DOUBLE ELSE 1 END AS f FROM part), o AS (SELECT *, l > 0 AND w IS NOT NULL AS ok FROM r)
SELECT p_partkey, round(CASE WHEN ok THEN l * f END, 6) AS length, round(CASE WHEN ok THEN w * f END, 6) AS width, round(CASE WHEN ok THEN 2.5 * f END, 6) AS height,
  round(CASE WHEN ok THEN sqrt(l * f * l * f + w * f * w * f + 6.25 * f * f) + 5 ELSE 50 END, 6) AS longest FROM o""",
    "capture_budget": "SELECT p_partkey, CASE WHEN p_retailprice / 3 * 48000 > 16000000 THEN 'frames' WHEN p_retailprice / 3 * 48000 * p_size * 4 > 536870912 THEN 'bytes' END AS issue FROM part",
    "quality_cells": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'no data' ELSE (CASE WHEN o_orderstatus = 'P' THEN 'REVIEW ' WHEN o_orderkey % 3 = 0 THEN 'OK* ' ELSE 'OK ' END) || printf('%.2f', o_custkey % 101 / 100) END AS cell FROM orders""",
    "metadata_changes": "SELECT c_custkey, c_name AS name, CASE WHEN c_nationkey % 2 <> 0 THEN 'moved' END AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer",
    "newest_results": "SELECT o_custkey, o_orderkey, o_orderkey % 4 AS generation FROM orders QUALIFY o_orderkey % 4 = max(o_orderkey % 4) OVER (PARTITION BY o_custkey)",
    "rate_lists": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '44100,48000,96000,192000' WHEN 1 THEN '88200,48000,44100,96000,192000' ELSE '48000,44100,96000,192000' END || CASE WHEN p_size > 25 THEN ',32000' ELSE '' END AS rates FROM part""",
}

QUERIES = [
    tone_signal, sweep_signal, chirp_signal, compensated_sweep, multitone_signal, trusted_takes, session_mode, emitter_matrix, arrival_directions, channel_split,
    drift_warp, room_sizes, capture_budget, quality_cells, metadata_changes, newest_results, rate_lists,
]
