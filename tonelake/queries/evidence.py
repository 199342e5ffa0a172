"""Findings of every kind over orders in the role of takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import evidence
from tonelake.plans import reports
from tonelake.queries.stand_ins import read, rounded


def sweep_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as takes whose lines are the points of their curves."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, k % 50).otherwise(0).alias("clipped"), F.when(k % 11 != 3, 20.0 + k % 100).alias("sweep_lo"), F.when(k % 11 != 3, 20000.0 - k % 9000).alias("sweep_hi"), (k % 13 != 5).alias("harmonics_available"),
        F.when(k % 17 != 0, F.col("o_totalprice")).alias("active_power"), F.when(k % 19 != 0, (k % 100) * 500.0).alias("quiet_power"), (k % 3 == 0).alias("single_take"),
    )
    point = F.struct((F.col("l_partkey") * 7 % 20000 + 10.0).alias("frequency_hz"), (F.col("l_extendedprice") / 1000).alias("spl_db"), F.when(F.col("l_linenumber") != 2, F.col("l_discount") * 150 + F.col("l_linenumber") * 0.0133).alias("thd_percent"))
    curves = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(point).alias("curve"))
    found = evidence.sweep_findings(o.join(curves, "o_orderkey", "left"), ["o_orderkey"])
    line = reports.finding_line(F.col("metric"), F.col("unit"), F.col("comparison"), F.col("measured"), F.col("threshold"))
    return rounded(found.select("o_orderkey", "ordinal", "policy", "metric", "status", "measured", "low_hz", "high_hz", "threshold", "unknown_reason", "recommendation", "message", line.alias("line")), "measured", digits=4)


def coherent_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as takes on a common clock, or not; what is said of each, in order, and whether it passes."""
    k = F.col("o_orderkey")
    band = lambda i: F.struct(F.lit(100.0 * 2**i).alias("low_hz"), F.lit(200.0 * 2**i).alias("high_hz"), F.when((k + i) % 10 != 0, (k * (i + 3) % 97) + 8.0).alias("snr_db"))
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, k % 50).otherwise(0).alias("clipped"), (k % 5 != 1).alias("corrected"), F.array(*[band(i) for i in range(3)]).alias("bands"), F.when(k % 23 == 4, "no quiet window").alias("bands_issue"),
        F.when(k % 8 != 0, F.col("o_totalprice") / 5000).alias("snr_db"),
    )
    found = evidence.coherent_findings(o, ["o_orderkey"])
    said = evidence.issues(found, ["o_orderkey"])
    counts = found.groupBy("o_orderkey").agg(F.count("*").alias("findings"), F.max("ordinal").alias("last"))
    return said.join(counts, "o_orderkey").select("o_orderkey", "findings", "last", F.array_join("issues", " / ").alias("said"), "passed")


SQL = {
    "sweep_evidence": """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 50 ELSE 0 END AS clipped, CASE WHEN o_orderkey % 11 <> 3 THEN 20.0::DOUBLE + o_orderkey % 100 END AS lo, CASE WHEN o_orderkey % 11 <> 3 THEN 20000.0::DOUBLE - o_orderkey % 9000 END AS hi,
  o_orderkey % 13 <> 5 AS harmonics, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderkey % 100 * 500.0::DOUBLE END AS q, o_orderkey % 3 = 0 AS single FROM orders),
b AS (SELECT *, CASE WHEN lo IS NOT NULL THEN greatest(lo, 80) END AS bl, CASE WHEN lo IS NOT NULL THEN least(hi, 16000) END AS bh, CASE WHEN a > 0 AND q > 0 THEN 10 * log10(a / q) END AS snr FROM o),
c AS (SELECT l_orderkey AS k, l_partkey * 7 % 20000 + 10.0::DOUBLE AS f, l_extendedprice / 1000 AS s, CASE WHEN l_linenumber <> 2 THEN l_discount * 150 + l_linenumber * 0.0133::DOUBLE END AS t FROM lineitem),
i AS (SELECT c.* FROM c JOIN b USING (k) WHERE f BETWEEN bl AND bh), m AS (SELECT k, max(s) AS top FROM i GROUP BY k),
w AS (SELECT k, max({'t': t, 'f': f}) AS w FROM i JOIN m USING (k) WHERE t IS NOT NULL AND s >= top - 20 GROUP BY k),
r AS (SELECT b.*, w.t AS thd, w.f AS hz FROM (SELECT b.*, w.w FROM b LEFT JOIN w USING (k)) b),
f AS (SELECT k, 1 AS nth, 'sweep_analysis' AS policy, 'clipping' AS metric, 'warning' AS status, clipped::DOUBLE AS measured, NULL::DOUBLE AS low_hz, NULL::DOUBLE AS high_hz, 0.0::DOUBLE AS threshold, NULL AS unknown_reason, 'reduce playback or input gain' AS recommendation,
    printf('%d captured samples reached full scale', clipped) AS message, printf('clipping %.2f count (= %.2f count)', clipped::DOUBLE, 0.0::DOUBLE) AS line FROM r WHERE clipped > 0
  UNION ALL SELECT k, 2, 'sweep_analysis', 'thd', CASE WHEN lo IS NULL OR NOT harmonics OR thd IS NULL THEN 'unknown' WHEN thd <= 10 THEN 'pass' ELSE 'warning' END, CASE WHEN lo IS NOT NULL AND harmonics THEN thd END, bl, bh, 10.0,
    CASE WHEN lo IS NULL OR NOT harmonics THEN 'valid log-sweep harmonic impulse responses were not available' WHEN thd IS NULL THEN 'no usable fundamental bins were available above the response gate' END,
    CASE WHEN lo IS NULL OR NOT harmonics THEN 'use a valid swept-sine capture for harmonic distortion analysis' WHEN thd IS NULL THEN 'check sweep level and response coverage, then repeat' WHEN thd > 10 THEN 'lower playback level and re-run' END,
    CASE WHEN lo IS NULL OR NOT harmonics THEN 'harmonic distortion is unavailable; no THD value was measured' WHEN thd IS NULL THEN 'harmonic distortion is unavailable in the usable response band'
      ELSE printf('peak harmonic distortion %.1f%% at %.0f Hz %s the 10%% advisory threshold', thd, hz, CASE WHEN thd <= 10 THEN 'meets' ELSE 'exceeds' END) END,
    CASE WHEN lo IS NULL OR NOT harmonics OR thd IS NULL THEN 'THD unknown' ELSE printf('THD %.2f %% (≤ %.2f %%)', thd, 10.0::DOUBLE) END FROM r
  UNION ALL SELECT k, 3, 'single_take', 'broadband_snr', CASE WHEN snr IS NULL THEN 'unknown' WHEN snr >= 10 THEN 'pass' ELSE 'warning' END, snr, NULL, NULL, 10.0, CASE WHEN snr IS NULL THEN 'quiet or active signal window is unavailable, silent, or non-finite' END,
    CASE WHEN snr IS NULL THEN 'capture a quiet pre-sweep interval and a valid sweep' WHEN snr < 10 THEN 'raise playback level or reduce background noise' END,
    CASE WHEN snr IS NULL THEN 'single-take broadband SNR is unavailable' ELSE printf('single-take broadband SNR %.1f dB %s the 10 dB advisory threshold', snr, CASE WHEN snr >= 10 THEN 'meets' ELSE 'is below' END) END,
    CASE WHEN snr IS NULL THEN 'broadband SNR unknown' ELSE printf('broadband SNR %.2f dB (≥ %.2f dB)', snr, 10.0::DOUBLE) END FROM r WHERE single)
SELECT k AS o_orderkey, CAST(row_number() OVER (PARTITION BY k ORDER BY nth) - 1 AS INTEGER) AS ordinal, policy, metric, status, round(measured, 4) AS measured, low_hz, high_hz, threshold, unknown_reason, recommendation, message, line FROM f""",
    "coherent_evidence": """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 50 ELSE 0 END AS clipped, o_orderkey % 5 <> 1 AS corrected, o_orderkey % 23 = 4 AS failed, CASE WHEN o_orderkey % 8 <> 0 AND o_orderkey % 5 <> 1 THEN o_totalprice / 5000 END AS snr FROM orders),
f AS (SELECT k, 0 AS nth, 'input reached full scale; reduce input or playback gain and repeat' AS said FROM o WHERE clipped > 0
  UNION ALL SELECT k, 1, 'timing markers unavailable: magnitude uses the uncorrected device clock; drift may smear the response and coherent use is forbidden' FROM o WHERE NOT corrected
  UNION ALL SELECT k, 2, 'frequency-dependent SNR unavailable: no quiet window' FROM o WHERE corrected AND failed
  UNION ALL SELECT k, 3 + i, CASE WHEN (k + i) % 10 = 0 THEN printf('SNR in %.1f–%.1f Hz is unavailable; no quality acceptance for this band', 100.0 * 2 ** i, 200.0 * 2 ** i) WHEN k * (i + 3) % 97 + 8 < 30 THEN printf('SNR in %.1f–%.1f Hz is below 30 dB; reduce room noise and repeat', 100.0 * 2 ** i, 200.0 * 2 ** i) END
    FROM o, range(3) r(i) WHERE corrected AND NOT failed
  UNION ALL SELECT k, 9, CASE WHEN snr IS NULL THEN 'broadband SNR unavailable: missing quiet interval, digital silence, or signal below noise' WHEN snr < 30 THEN 'broadband SNR below 30 dB; reduce room noise and repeat' END FROM o)
SELECT k AS o_orderkey, count(*) AS findings, CAST(count(*) - 1 AS INTEGER) AS last, coalesce(string_agg(said, ' / ' ORDER BY nth), '') AS said, count(said) = 0 AS passed FROM f GROUP BY k""",
}

QUERIES = [sweep_evidence, coherent_evidence]
