"""Column functions and joins of a session's tables over orders, lines and takes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import acoustics, arrays, levels
from tonelake.operators import measured
from tonelake.operators import takes as whole_takes
from tonelake.plans import localization, session
from tonelake.queries.plans import _plans, stream_folder
from tonelake.queries.stand_ins import read, rounded, takes
from tonelake.sources import bundles, documents


def sound_and_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as takes: the speed of sound that holds, where the sweep should be, and whether a correction may stay."""
    k = F.col("o_orderkey")
    when = lambda n, v: F.when(k % n != 0, v)
    speed = acoustics.sound_speed(when(3, 340.0 + k % 7), when(3, 0.5 + k % 2), when(5, 343.0 + k % 3), when(5, 0.25))
    raw, fixed = when(11, (k % 10) / 10.0), when(13, (k % 8) / 8.0)
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", speed.alias("v"), acoustics.predicted_sweep((k % 1000) * 1.0, F.lit(24000), F.lit(52800), (k % 61 - 30) * 1.0).alias("sweep_at"), acoustics.lag_locked(raw, 0.2).alias("locked"),
        acoustics.correction_keeps_lock(raw, fixed, F.lit(100.0), (k % 3) * 700.0 + 100, F.lit(48000), 0.2).alias("keeps"), levels.from_db((k % 50 - 40) * 1.0).alias("gain"),
        arrays.all_reliable(k % 4 != 0, F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.when((k + i) % 17 != 0, (k + i * 5) % 23 * 1.0))).alias("reliable"),
        F.to_json(arrays.resized(F.array(k % 5, k % 7), (k % 4).cast("int")), {"ignoreNullFields": "false"}).alias("resized"),
    )
    return rounded(o.select("o_orderkey", "v.m_s", "v.sigma", "v.source", "sweep_at", "locked", "keeps", "gain", "reliable", "resized"), "sweep_at", "gain")


def series_for_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes with holes, as JSON keeps them and as they are read back."""
    t = takes(spark, sf_dir).select("take_id", F.transform("samples", lambda x, i: F.when((i + F.col("take_id")) % 9 == 0, float("nan")).when((i + F.col("take_id")) % 31 == 0, float("inf")).otherwise(x).cast("float")).alias("x"))
    sparse = t.select("take_id", documents.sparse_series(F.col("x")).alias("s")).select("take_id", "s", documents.dense_series(F.col("s")).alias("d"))
    total = lambda c: F.aggregate(F.filter(c, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rounded(sparse.select("take_id", F.size(F.filter("s", lambda x: x.isNull())).alias("nulls"), F.size(F.filter("d", lambda x: F.isnan(x))).alias("nans"), total("s").alias("kept"), total("d").alias("back")), "kept", "back")


def plan_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microphones of all plans, in their order, after a way through JSON."""
    found = session.children(_plans(spark, sf_dir), "c_custkey", "plan", "microphones")
    return rounded(found.select("c_custkey", "ordinal", "id", "input_channel", F.get("position_m", F.lit(0)).alias("x"), "position_uncertainty_mm"), "x")


def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell that a supplier's session asks for, five sources by four microphones, with the take there is: its line of that kind."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session"))
    side = lambda name, n: s.select("session", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
    t = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("session"), (F.col("l_partkey") % 7).cast("int").alias("source_id"), (F.col("l_orderkey") % 6).cast("int").alias("microphone_id"), (F.col("l_linenumber") % 2).cast("int").alias("repeat_index")).agg(F.max("l_quantity").alias("arrival"))
    cells = localization.full_matrix(side("source_id", 5), side("microphone_id", 4), side("repeat_index", 2), t, ["session"])
    return cells.groupBy("session", "source_id").agg(F.count("*").alias("cells"), F.count("taken").alias("taken"), F.sum("arrival").alias("arrivals"))


def curves_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of brands written as a folder of lines each, and calibration texts of suppliers read from theirs."""
    folder = stream_folder(spark)
    p = read(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("frequency_hz")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("double")
    p = p.select("p_brand", "frequency_hz", (F.col("n") * 1.0).alias("spl_db"), *[none.alias(c) for c in ("phase_deg", "thd_percent", "rt60_ms", "c50_db", "c80_db", "group_delay_ms")])
    bundles.write_curves(p, ["p_brand"], f"{folder}/curves")
    lines = documents.calibration_curves(spark, f"{folder}/curves")
    return rounded(lines.groupBy("frequency_hz").agg(F.count("*").alias("brands"), F.sum("spl_db").alias("parts")), "parts", digits=3)


def take_pair_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much later the second of each two takes has what the first has, up to eight samples."""
    t = takes(spark, sf_dir).select(F.floor(F.col("take_id") / 2).alias("event"), (F.col("take_id") % 2).alias("ordinal"), F.transform("samples", lambda x: x.cast("double")).alias("x"))
    return rounded(measured.pair_delays(t, ["event"], "ordinal", "x", 8), "tdoa", digits=4)


def take_spectrograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of three overlapping segments of each two takes put together."""
    t = takes(spark, sf_dir).select(F.floor(F.col("take_id") / 2).alias("event"), (F.col("take_id") % 2).cast("int").alias("block"), "samples")
    rows = measured.spectrogram(t, ["event"], 6400, segment=64, step=32)
    return rounded(rows.select("event", F.round("time_ms").cast("int").alias("ms"), F.posexplode("levels").alias("bin", "db")), "db", digits=3)


def take_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a short chirp is in both halves of each take, and the clock that this would be."""
    chirp = np.sin(0.4 * np.arange(1, 9) + 0.05 * np.arange(1, 9) ** 2)
    t = takes(spark, sf_dir).select("take_id", F.lit(0).alias("block"), "samples")
    lags = whole_takes.marker_lags(t, ["take_id"], chirp, [(0, 32), (32, 64)], least=0.5)
    fits = whole_takes.clock_fits(lags, ["take_id"], 32)
    wide = lags.groupBy("take_id").agg(*[F.max(F.when(F.col("marker") == m, F.col(c))).alias(f"{c}_{m}") for m in (0, 1) for c in ("lag", "confidence", "reason")])
    found = wide.join(fits.select("take_id", "offset", "skew_ppm", F.col("reason").alias("clock")), "take_id")
    return rounded(found, "lag_0", "lag_1", "confidence_0", "confidence_1", "offset", "skew_ppm", digits=4)


SQL = {
    "take_markers": """WITH c AS (SELECT j, sin(0.4 * (j + 1) + 0.05 * (j + 1) ** 2) AS r FROM range(8) t(j)), t AS (SELECT vec_id AS k, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
s AS (SELECT k, m, l, sum(x * r) AS raw, sum(x * x) AS p FROM t, range(2) a(m), range(25) b(l), c WHERE i = m * 32 + l + j GROUP BY ALL), q AS (SELECT k, m, max(p) AS top FROM s GROUP BY ALL),
n AS (SELECT s.k, s.m, l, abs(raw / sqrt(greatest(p, 1e-3 * top) * (SELECT sum(r * r) FROM c))) AS v FROM s JOIN q USING (k, m)), b AS (SELECT k, m, first(l ORDER BY v DESC, l) AS l, max(v) AS y FROM n GROUP BY ALL),
f AS (SELECT b.*, x.v AS x, z.v AS z FROM b LEFT JOIN n x ON x.k = b.k AND x.m = b.m AND x.l = b.l - 1 LEFT JOIN n z ON z.k = b.k AND z.m = b.m AND z.l = b.l + 1),
g AS (SELECT k, m, y AS sure, CASE WHEN y >= 0.5 THEN m * 32 + l + CASE WHEN x IS NULL OR z IS NULL OR x - 2 * y + z = 0 THEN 0 ELSE 0.5 * (x - z) / (x - 2 * y + z) END END AS lag, CASE WHEN y < 0.5 THEN 'low_confidence' END AS why FROM f),
w AS (SELECT k, max(lag) FILTER (m = 0) AS a, max(lag) FILTER (m = 1) AS b, max(sure) FILTER (m = 0) AS sa, max(sure) FILTER (m = 1) AS sb, max(why) FILTER (m = 0) AS wa, max(why) FILTER (m = 1) AS wb FROM g GROUP BY k),
d AS (SELECT *, ((b - a) - 32) / 32 * 1e6 AS ppm FROM w), e AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN coalesce(wa, wb, 'marker_missing') WHEN abs(ppm) > 5000 THEN 'clock_outlier' END AS clock FROM d)
SELECT k AS take_id, round(a, 4) AS lag_0, round(sa, 4) AS confidence_0, wa AS reason_0, round(b, 4) AS lag_1, round(sb, 4) AS confidence_1, wb AS reason_1, round(CASE WHEN clock IS NULL THEN a END, 4) AS offset, round(CASE WHEN clock IS NULL THEN ppm END, 4) AS skew_ppm, clock FROM e""",
    "sound_and_lock": """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 10 / 10 END AS raw, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 8 / 8 END AS fix FROM orders),
r AS (SELECT k, i, CASE WHEN (k + i) % 17 <> 0 THEN (k + i * 5) % 23 END AS s FROM o, range(3) t(i) WHERE i <= k % 3), a AS (SELECT k, bool_and(coalesce(s < 20, false)) AS steady FROM r GROUP BY k)
SELECT k AS o_orderkey, CASE WHEN k % 3 <> 0 THEN 340.0 + k % 7 WHEN k % 5 <> 0 THEN 343.0 + k % 3 ELSE 343.0 END::DOUBLE AS m_s, CASE WHEN k % 3 <> 0 THEN 0.5 + k % 2 WHEN k % 5 <> 0 THEN 0.25 ELSE 3.0 END::DOUBLE AS sigma,
  CASE WHEN k % 3 <> 0 THEN 'timing_reference' WHEN k % 5 <> 0 THEN 'plan' ELSE 'default' END AS source, round(k % 1000 + 24000 + 28800 * (1 + (k % 61 - 30) / 1e6), 6)::DOUBLE AS sweep_at, coalesce(raw >= 0.2, false) AS locked,
  CASE WHEN NOT coalesce(raw >= 0.2, false) THEN true WHEN NOT coalesce(fix >= 0.2, false) THEN false WHEN fix < raw / 2 THEN false WHEN k % 3 * 700.0 > 960 THEN false ELSE true END AS keeps,
  round(10 ** (least(k % 50 - 40, 0) / 20), 6) AS gain, k % 4 <> 0 AND steady AS reliable, CASE k % 4 WHEN 0 THEN '[]' WHEN 1 THEN printf('[%d]', k % 5) WHEN 2 THEN printf('[%d,%d]', k % 5, k % 7) ELSE printf('[%d,%d,null]', k % 5, k % 7) END AS resized
FROM o JOIN a USING (k)""",
    "series_for_json": """WITH t AS (SELECT vec_id AS take_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), h AS (SELECT take_id, x, (i + take_id) % 9 = 0 OR (i + take_id) % 31 = 0 AS hole FROM t)
SELECT take_id, CAST(count(*) FILTER (hole) AS INTEGER) AS nulls, CAST(count(*) FILTER (hole) AS INTEGER) AS nans, round(sum(x) FILTER (NOT hole), 6) AS kept, round(sum(x) FILTER (NOT hole), 6) AS back FROM h GROUP BY take_id""",
    "plan_children": """SELECT c_custkey, CAST(i AS INTEGER) AS ordinal, CASE WHEN c_custkey % 12 = 1 AND i = 1 THEN 'm0' ELSE 'm' || i END AS id, CAST(CASE WHEN c_custkey % 12 = 2 AND i = 1 THEN 0 ELSE i END AS INTEGER) AS input_channel, round(0.06 * i, 6)::DOUBLE AS x,
  CASE c_custkey % 12 WHEN 3 THEN NULL WHEN 4 THEN 2.5 ELSE 1.0 END::DOUBLE AS position_uncertainty_mm FROM customer, range(3) r(i)""",
    "matrix_cells": """WITH t AS (SELECT l_suppkey AS s, l_partkey % 7 AS p, l_orderkey % 6 AS m, l_linenumber % 2 AS r, max(l_quantity) AS q FROM lineitem GROUP BY ALL), g AS (SELECT s, p, count(*) AS n, sum(q) AS q FROM t WHERE p < 5 AND m < 4 GROUP BY ALL)
SELECT s_suppkey AS session, CAST(i AS INTEGER) AS source_id, 8::BIGINT AS cells, coalesce(n, 0) AS taken, q AS arrivals FROM (SELECT s_suppkey, i FROM supplier, range(5) r(i)) LEFT JOIN g ON s = s_suppkey AND p = i""",
    "curves_round_trip": "SELECT p_size::DOUBLE AS frequency_hz, count(*) AS brands, sum(n)::DOUBLE AS parts FROM (SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_size > 0 GROUP BY ALL) GROUP BY p_size",
    "take_pair_delays": """WITH t AS (SELECT vec_id // 2 AS event, vec_id % 2 AS o, embedding AS v FROM embeddings), p AS (SELECT event, a.v AS a, b.v AS b FROM t a JOIN t b USING (event) WHERE a.o = 0 AND b.o = 1),
r AS (SELECT event, s, (SELECT sum(CAST(a[i] AS DOUBLE) * b[i + s]) FROM range(1, 65) u(i) WHERE i + s BETWEEN 1 AND 64) AS r FROM p, range(-8, 9) q(s)),
m AS (SELECT event, first(s ORDER BY r DESC, s) AS s, max(r) AS y FROM r GROUP BY event), n AS (SELECT m.*, x.r AS x, z.r AS z FROM m LEFT JOIN r x ON x.event = m.event AND x.s = m.s - 1 LEFT JOIN r z ON z.event = m.event AND z.s = m.s + 1)
SELECT event, 1::BIGINT AS ordinal, round(CASE WHEN x IS NULL OR z IS NULL OR x - 2 * y + z = 0 THEN s ELSE s + 0.5 * (x - z) / (x - 2 * y + z) END, 4)::DOUBLE AS tdoa FROM n""",
    "take_spectrograms": """WITH t AS (SELECT vec_id // 2 AS event, vec_id % 2 * 64 + generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
w AS (SELECT event, s, i - s * 32 AS j, x * (0.5 - 0.5 * cos(2 * pi() * (i - s * 32) / 63)) AS x FROM t, range(3) r(s) WHERE i - s * 32 BETWEEN 0 AND 63), n AS (SELECT sum(0.5 - 0.5 * cos(2 * pi() * j / 63)) AS n FROM range(64) r(j)),
f AS (SELECT event, s, b, sqrt(sum(x * cos(2 * pi() * j * b / 64)) ** 2 + sum(x * sin(2 * pi() * j * b / 64)) ** 2) AS m, count(*) AS c FROM w, range(33) q(b) GROUP BY ALL)
SELECT event, CAST(s * 5 AS INTEGER) AS ms, CAST(b AS INTEGER) AS bin, round(20 * log10(greatest(m * 2 / n, 1e-15)), 3) AS db FROM f, n WHERE c = 64""",
}

QUERIES = [take_markers, sound_and_lock, series_for_json, plan_children, matrix_cells, curves_round_trip, take_pair_delays, take_spectrograms]
