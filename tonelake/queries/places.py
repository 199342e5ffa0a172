"""Ranges to places over the given tables: single points, microphones from sources, and whole sessions at once."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import acoustics
from tonelake.plans import localization, positions
from tonelake.queries.plans import SESSIONS, air, session_cells
from tonelake.queries.stand_ins import nearest, read, rounded

SAMPLE_M = 343.0 / 48000
_AT = ["x", "y", "z"]


def _told_x(found: DataFrame) -> DataFrame:
    """``found`` with x to four digits.

    Suppliers stand at their balance over 4000, so many of them are at ties of
    the fourth digit, and which way a tie goes is decided by less than the
    solver's error. So a place is first told to the grid of whole cents, 2.5
    micrometres, and then rounded as SQL does.
    """
    return found.withColumn("x", nearest(F.round(F.col("x") * 4000, 2) / 4000, 4))


def session_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sessions to the places of their sources, with what shows how good they are."""
    _, found = localization.localized(session_cells(spark, sf_dir), ["session"], "order", F.lit(52800.0), air(), SAMPLE_M)
    noisy = F.col("session") % 5 == 3
    shown = found.select(
        "session", "source_id", *[F.when(~noisy, F.col(c)).alias(c) for c in (*_AT, "rms_m", "gdop", "loo_m", "loo_residual_m")], "gate_m", "links", F.array_join("excluded", ",").alias("excluded"),
        "mirror_ambiguous", F.when(noisy, (F.col("rms_m") > 0) & (F.col("rms_m") < 0.002)).alias("noise_shows"), "verdict",
    )
    return rounded(_told_x(shown), "y", "z", "rms_m", "loo_m", "loo_residual_m", "gate_m", "gdop", digits=4)


def refined_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of suppliers found from nine ranges, one of which is 0.4 m too long for every third of them."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("session"), F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") / 4000).alias("src_x"), (F.col("s_suppkey") % 7 * 0.5).alias("src_y"), (F.col("s_nationkey") * 0.1 + 0.25).alias("src_z"))
    k = F.col("microphone_id")
    rows = s.withColumn("microphone_id", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumns({"mic_x": k % 3 * 1.0, "mic_y": F.floor(k / 3) % 3 * 0.9, "mic_z": (k * k % 5) * 0.3, "sigma_m": F.lit(0.01)})
    far = acoustics.distance([F.col(f"src_{a}") for a in _AT], [F.col(f"mic_{a}") for a in _AT])
    wild = (F.col("source_id") % 3 == 1) & (k == F.col("source_id") % 9)
    found = positions.solved_positions(rows.withColumn("distance_m", far + F.when(wild, 0.4).otherwise(0.0)), ["session"], SAMPLE_M)
    return rounded(_told_x(found.select("session", "source_id", *_AT, "links", F.array_join("excluded", ",").alias("excluded"), "verdict")), "y", "z", digits=4)


def _rooms(spark: SparkSession, sf_dir: str, off: float = 0.0) -> DataFrame:
    """Ranges between eight customers, as sources, and nine microphones of each session; of one kind of room one range is ``off``."""
    c, k = F.col("c_custkey"), F.col("microphone_id")
    kind = F.floor(c / 8) % 8
    # remainders are taken first, so that the powers of large keys fit
    power = lambda n, modulus: reduce(mul, [c % modulus] * n)
    s = read(spark, sf_dir, "customer").select(F.floor(c / 8).alias("session"), kind.alias("kind"), c.alias("source_id"), (power(2, 1009) * 7919 % 1009 / 250).alias("true_x"), (power(3, 997) * 31 % 997 / 250).alias("true_y"), (power(2, 991) * 101 % 991 / 400).alias("true_z"))
    mics = {"at_x": k % 3 * 1.7, "at_y": F.floor(k / 3) % 3 * 1.9, "at_z": 0.4 + (k * k % 5) * 0.45}
    rows = s.withColumn("microphone_id", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumns(mics)
    far = acoustics.distance([F.col(f"true_{a}") for a in _AT], [F.col(f"at_{a}") for a in _AT])
    wild = (F.col("kind") == 3) & (F.col("source_id") % 8 == 7) & (k == 5)
    return rows.withColumns({"distance_m": far + F.when(wild, off).otherwise(0.0), "sigma_m": F.lit(0.002)})


def _surveyed(rows: DataFrame, source, microphone) -> DataFrame:  # noqa: ANN001
    return rows.withColumns({f"src_{a}": F.when(source, F.col(f"true_{a}")) for a in _AT} | {f"mic_{a}": F.when(microphone, F.col(f"at_{a}")) for a in _AT})


def microphone_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other microphone found again from its ranges to a session's surveyed sources."""
    cells = _surveyed(_rooms(spark, sf_dir), F.col("source_id") % 8 >= F.col("kind"), F.col("microphone_id") % 2 == 0)
    found = positions.solved_microphones(cells, ["session"], SAMPLE_M)
    return rounded(found.select("session", "microphone_id", *_AT, "links", "verdict"), *_AT, digits=4)


def _joint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in which half of the sources and microphones are surveyed, or fewer, or all of one side."""
    kind, k, c = F.col("kind"), F.col("microphone_id"), F.col("source_id")
    source = F.when(kind == 0, True).when(kind.isin(1, 2), False).otherwise(c % 2 == 0)
    microphone = F.when(kind == 1, k < 2).when(kind == 2, k.isin(1, 6)).otherwise(k % 2 == 0)
    rows = _surveyed(_rooms(spark, sf_dir, 0.3), source, microphone)
    # of kind 4, one source reaches three microphones
    lost = (kind == 4) & (c % 8 == 3) & (k > 2)
    return rows.withColumn("distance_m", F.when(~lost, F.col("distance_m")))


def joint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.joint_eligibility(_joint_cells(spark, sf_dir), ["session"])


def joint_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of every session by the joint solve, where its session allows that, and by direct solves elsewhere."""
    found = positions.session_places(_joint_cells(spark, sf_dir), ["session"], SAMPLE_M)
    return rounded(found, *_AT, digits=4)


_ROOMS = """WITH c AS (SELECT c_custkey // 8 AS session, c_custkey // 8 % 8 AS kind, c_custkey AS c, c_custkey * c_custkey * 7919 % 1009 / 250 AS x, c_custkey * c_custkey * c_custkey * 31 % 997 / 250 AS y, c_custkey * c_custkey * 101 % 991 / 400 AS z FROM customer),
m AS (SELECT k, k % 3 * 1.7::DOUBLE AS x, k // 3 % 3 * 1.9::DOUBLE AS y, 0.4 + k * k % 5 * 0.45::DOUBLE AS z FROM range(9) r(k)),
n AS (SELECT session, kind, count(*) AS sources, CAST(count(*) FILTER (c % 8 >= kind) AS BIGINT) AS known, CAST(count(*) FILTER (c % 2 = 0) AS BIGINT) AS even, CAST(count(*) FILTER (c % 8 = 3) AS BIGINT) AS three FROM c GROUP BY ALL)"""
_CHECKS = """, j AS (SELECT session, kind, sources, even, three, CASE WHEN kind = 0 THEN 0 WHEN kind IN (1, 2) THEN sources ELSE sources - even END AS unknown_sources, CASE WHEN kind IN (1, 2) THEN 7 ELSE 4 END AS unknown_microphones,
  CASE WHEN kind = 0 THEN sources + 5 WHEN kind IN (1, 2) THEN 2 ELSE even + 5 END AS anchors, sources * 9 - CASE WHEN kind = 4 THEN 6 * three ELSE 0 END AS ranges FROM n),
i AS (SELECT *, CASE WHEN kind = 4 THEN least(CASE WHEN three > 0 THEN 3 ELSE 9 END, sources - three) WHEN unknown_sources > 0 THEN least(9, sources) ELSE sources END AS least_links FROM j),
f AS (SELECT *, CASE WHEN unknown_sources = 0 OR unknown_microphones = 0 THEN 'one_sided' WHEN anchors < 3 THEN 'few_anchors' WHEN ranges < 3 * (unknown_sources + unknown_microphones) THEN 'few_ranges' WHEN least_links < 4 THEN 'few_links' END AS issue FROM i)"""

SQL = {
    "session_positions": SESSIONS + """, h AS (SELECT *, d + off AS dist, 343 * sqrt(0.02) / CASE kind WHEN 0 THEN 1.000003 ELSE 1 END / 48000 + (d + off) * 0.5 / 343 + 0.001 AS sigma FROM k WHERE k < 8),
u AS (SELECT *, (x - mx) / d AS ux, (y - my) / d AS uy, (z - mz) / d AS uz, 1 / (sigma * sigma) AS w FROM h WHERE NOT (odd = 2 AND k = 3)),
n AS (SELECT session, source_id, sum(w * ux * ux) AS a, sum(w * uy * uy) AS b, sum(w * uz * uz) AS c, sum(w * ux * uy) AS p, sum(w * ux * uz) AS q, sum(w * uy * uz) AS r, median(sigma) AS typical FROM u GROUP BY ALL),
g AS (SELECT session, source_id, typical, sqrt((a * b + a * c + b * c - p * p - q * q - r * r) / (a * b * c + 2 * p * q * r - a * r * r - b * q * q - c * p * p)) / typical AS gdop FROM n),
o AS (SELECT DISTINCT session, source_id, kind, shape, odd, x, y, z FROM k)
SELECT session, source_id, round(CASE WHEN ok AND odd <> 3 THEN x END, 4) AS x, round(CASE WHEN ok AND odd <> 3 THEN y END, 4) AS y, round(CASE WHEN ok AND odd <> 3 THEN z END, 4) AS z, CASE WHEN ok AND odd <> 3 THEN 0.0 END::DOUBLE AS rms_m,
  round(CASE WHEN ok AND odd <> 3 THEN gdop END, 4) AS gdop, CASE WHEN ok AND odd <> 3 THEN 0.0 END::DOUBLE AS loo_m, CASE WHEN ok AND odd <> 3 THEN 0.0 END::DOUBLE AS loo_residual_m, round(CASE WHEN ok THEN greatest(343.0 / 48000, 3 * typical) END, 4) AS gate_m,
  CAST(CASE WHEN kind < 2 THEN 8 ELSE 0 END AS BIGINT) AS links, CASE WHEN ok AND odd = 2 THEN '3' ELSE '' END AS excluded, ok AND shape = 1 AS mirror_ambiguous, CASE WHEN ok AND odd = 3 THEN true END AS noise_shows,
  CASE WHEN kind = 2 THEN 'insufficient_ranges' WHEN shape = 0 THEN 'degenerate_geometry' ELSE 'solved' END AS verdict
FROM (SELECT *, kind < 2 AND shape <> 0 AS ok FROM o) JOIN g USING (session, source_id)""",
    "refined_positions": """SELECT s_nationkey AS session, s_suppkey AS source_id, round(s_acctbal / 4000, 4) AS x, round(s_suppkey % 7 * 0.5, 4)::DOUBLE AS y, round(s_nationkey * 0.1 + 0.25, 4)::DOUBLE AS z, CAST(9 AS BIGINT) AS links,
  CASE WHEN s_suppkey % 3 = 1 THEN CAST(s_suppkey % 9 AS VARCHAR) ELSE '' END AS excluded, 'solved' AS verdict FROM supplier""",
    "microphone_positions": _ROOMS + """, v AS (SELECT session, k, x, y, z, known, CASE WHEN k % 2 = 0 THEN 'surveyed_anchor' WHEN known < 3 THEN 'insufficient_ranges' WHEN known = 3 THEN 'mirror_ambiguous' ELSE 'solved' END AS verdict FROM n, m)
SELECT session, CAST(k AS INTEGER) AS microphone_id, CASE WHEN ok THEN round(x, 4) END AS x, CASE WHEN ok THEN round(y, 4) END AS y, CASE WHEN ok THEN round(z, 4) END AS z, known AS links, verdict
FROM (SELECT *, verdict IN ('solved', 'surveyed_anchor') AS ok FROM v)""",
    "joint_checks": _ROOMS + _CHECKS + """ SELECT session, CAST(unknown_sources AS BIGINT) AS unknown_sources, CAST(unknown_microphones AS BIGINT) AS unknown_microphones, CAST(anchors AS BIGINT) AS anchors, CAST(ranges AS BIGINT) AS ranges,
  CAST(least_links AS BIGINT) AS least_links, issue FROM f""",
    "joint_places": _ROOMS + _CHECKS + """, s AS (SELECT session, 'source' AS side, CAST(c AS VARCHAR) AS id, x, y, z, issue IS NULL AND c % 2 = 1 AS joint, false AS survey,
  CASE WHEN f.kind IN (1, 2) THEN 2 WHEN f.kind = 4 AND c % 8 = 3 THEN 2 ELSE 5 END AS links FROM c JOIN f USING (session)),
t AS (SELECT session, 'microphone' AS side, CAST(k AS VARCHAR) AS id, x, y, z, issue IS NULL AND k % 2 = 1 AS joint, CASE kind WHEN 1 THEN k < 2 WHEN 2 THEN k IN (1, 6) ELSE k % 2 = 0 END AS survey,
  CASE WHEN kind = 0 THEN sources WHEN kind IN (1, 2) THEN 0 ELSE even END AS links FROM m, f),
v AS (SELECT *, CASE WHEN joint THEN 'solved' WHEN survey THEN 'surveyed_anchor' WHEN links < 3 THEN 'insufficient_ranges' WHEN links = 3 THEN 'mirror_ambiguous' ELSE 'solved' END AS verdict FROM (SELECT * FROM s UNION ALL SELECT * FROM t))
SELECT session, side, id, CASE WHEN joint THEN 'joint' WHEN survey THEN 'survey' ELSE 'direct' END AS method, CASE WHEN ok THEN round(x, 4) END AS x, CASE WHEN ok THEN round(y, 4) END AS y, CASE WHEN ok THEN round(z, 4) END AS z, verdict
FROM (SELECT *, verdict IN ('solved', 'surveyed_anchor') AS ok FROM v)""",
}

QUERIES = [session_positions, refined_positions, microphone_positions, joint_checks, joint_places]
