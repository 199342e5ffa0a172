"""Layouts, ears and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import layouts

from .stand_ins import read


def speaker_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts with how many parts, as devices of so many outputs, can play them."""
    all_of = layouts.layout_table(spark).groupBy("layout").agg(F.max("channels").alias("channels"), F.count_if(F.col("channel") == "LFE").alias("lfe"), F.count_if(F.col("channel").startswith("T")).alias("heights"))
    outputs = read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("outputs")).agg(F.count("*").alias("parts"))
    fits = all_of.join(outputs, F.col("outputs") >= F.col("channels"), "left")
    return fits.groupBy("layout", "channels", "lfe", "heights").agg(F.coalesce(F.sum("parts"), F.lit(0)).alias("devices"))


def ear_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as takes of heads: every fourth is of the loopback, the others in thirds of the left ear, the right one and the loopback."""
    o = read(spark, sf_dir, "orders")
    t = o.select(F.floor(F.col("o_orderkey") / 6).alias("head"), F.col("o_orderkey").alias("take_id"), F.col("o_orderstatus").alias("device"), (F.col("o_custkey") % 2).alias("frames"))
    role = F.when(F.col("take_id") % 4 == 0, "loopback").when(F.col("take_id") % 3 == 0, "left").when(F.col("take_id") % 3 == 1, "right").otherwise("loopback")
    return layouts.ear_pairs(t, ["head"], role, ["device", "frames"]).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("left_take", "right_take")})


def phase_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey"), (F.col("c_custkey") % 300).alias("source"), F.when(F.col("c_acctbal") > -500, F.col("c_acctbal") > 0).alias("complete"))
    found = layouts.complete_everywhere(c, ["source"], "complete")
    return found.groupBy("source").agg(F.count_if("usable").alias("usable"), F.count("*").alias("links"))


def device_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("format"), F.col("p_size").alias("channels"), (F.col("p_partkey") % 60 * 1000).alias("min_rate"), (F.col("p_partkey") % 120 * 1000).alias("max_rate"))
    return layouts.ranked_config(p, ["p_brand"], 8, 48000, ["SMALL", "MEDIUM", "LARGE", "ECONOMY", "STANDARD", "PROMO"])


SQL = {
    "speaker_layouts": """SELECT v.*, (SELECT count(*) FROM part WHERE p_size >= v.channels) AS devices FROM (VALUES ('2.0', 2, 0::BIGINT, 0::BIGINT), ('2.1', 3, 1, 0), ('2.2', 4, 0, 0), ('5.0', 5, 0, 0), ('5.1', 6, 1, 0), ('7.1', 8, 1, 0), ('9.1', 10, 1, 0), ('5.1.2', 8, 1, 2), ('5.1.4', 10, 1, 4),
  ('7.1.2', 10, 1, 2), ('7.1.4', 12, 1, 4), ('9.1.2', 12, 1, 2), ('9.1.4', 14, 1, 4), ('9.1.6', 16, 1, 6), ('custom', 2, 0, 0)) v(layout, channels, lfe, heights)""",
    "ear_pairs": """WITH t AS (SELECT o_orderkey // 6 AS head, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE o_orderkey % 3 END AS r, o_orderstatus AS d, o_custkey % 2 AS f FROM orders),
g AS (SELECT head, count(*) FILTER (r = 0) AS l, count(*) FILTER (r = 1) AS n, max(k) FILTER (r = 0) AS left_take, max(k) FILTER (r = 1) AS right_take, count(DISTINCT d) FILTER (r < 2) AS ds, count(DISTINCT f) FILTER (r < 2) AS fs FROM t GROUP BY head)
SELECT head, coalesce(left_take, -1) AS left_take, coalesce(right_take, -1) AS right_take, CASE WHEN l = 0 OR n = 0 THEN 'missing_ear' WHEN l > 1 OR n > 1 THEN 'several_takes' WHEN ds > 1 THEN 'different_device' WHEN fs > 1 THEN 'different_frames' END AS issue FROM g""",
    "phase_usable": """WITH c AS (SELECT c_custkey % 300 AS source, coalesce(CASE WHEN c_acctbal > -500 THEN c_acctbal > 0 END, false) AS ok FROM customer)
SELECT source, CASE WHEN bool_and(ok) THEN count(*) ELSE 0 END AS usable, count(*) AS links FROM c GROUP BY source""",
    "device_config": """WITH r AS (SELECT p_brand, p_type AS format, p_size AS channels, list_position(['SMALL', 'MEDIUM', 'LARGE', 'ECONOMY', 'STANDARD', 'PROMO'], p_type) AS k FROM part
  WHERE p_size >= 8 AND p_partkey % 60 * 1000 <= 48000 AND p_partkey % 120 * 1000 >= 48000)
SELECT p_brand, format, channels FROM r WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY k, channels) = 1""",
}

QUERIES = [speaker_layouts, ear_pairs, phase_usable, device_config]
