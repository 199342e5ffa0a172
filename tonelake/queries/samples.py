"""Levels, sequences and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import levels, ranks, sequences, spectra

from .stand_ins import long_takes, read, rounded, stream, takes

LEVELS = """
WITH s AS (SELECT vec_id AS take_id, label AS source_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
a AS (
  SELECT take_id, any_value(source_id) AS source_id, avg(CAST(x AS DOUBLE) * x) AS power, max(abs(CAST(x AS DOUBLE))) AS peak,
    avg(CAST(x AS DOUBLE) * x) FILTER (i >= 4 AND i < 8) AS noise, avg(CAST(x AS DOUBLE) * x) FILTER (i >= 16) AS signal,
    count(*) FILTER (abs(x) >= 1.0) AS full_scale, count(*) FILTER (abs(CAST(x AS DOUBLE)) >= 0.999) AS meter_clipped
  FROM s GROUP BY take_id
), l AS (
  SELECT *, CASE WHEN noise > 0 AND signal > noise THEN 10 * log10((signal - noise) / noise) END AS snr_db,
    CASE WHEN peak > 0 THEN 20 * log10(peak) END AS peak_dbfs, CASE WHEN power > 0 THEN 10 * log10(power) END AS rms_dbfs FROM a
)
"""


def take_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, clipping, noise and gain advice of every take."""
    found = levels.take_levels(takes(spark, sf_dir), "samples", chirp=16)
    kept = ["take_id", "source_id", "peak_dbfs", "rms_dbfs", "snr_db", "full_scale", "meter_clipped", "zone", "advice"]
    return rounded(found.select(kept).withColumns({c: F.col(c).cast("long") for c in ("full_scale", "meter_clipped")}), "peak_dbfs", "rms_dbfs", "snr_db")


def take_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(levels.findings(levels.take_levels(takes(spark, sf_dir), "samples", chirp=16), "take_id"), "value")


def clip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipping of the whole stream: overall and in its worst block."""
    s = stream(spark, sf_dir).withColumn("stream", F.lit("all"))
    found = levels.clip_statistics(s, ["stream"], "idx", "x", threshold=0.2)
    return rounded(found.withColumn("verdict", levels.clip_verdict(F.col("percent"), F.col("worst_block_percent"))), "percent", "worst_block_percent")


def channel_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = levels.long_levels(stream(spark, sf_dir), ["channel"], "x")
    peak = F.when(F.col("peak") > 0, 20 * F.log10("peak"))
    return rounded(found.withColumns({"zone": levels.level_zone(peak), "advice": levels.gain_advice(peak)}), "peak", "rms")


def snr_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(levels.ratio_snr(stream(spark, sf_dir), ["channel"], "x", F.col("idx") % 4 != 0, F.col("idx") % 4 == 0), "snr_db")


def spl_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each take's middle, and the offset that makes it 94 dB."""
    found = levels.stable_window(long_takes(spark, sf_dir), ["take_id"], "idx", "x", guard=8)
    return rounded(found.withColumn("offset_db", levels.spl_offset(F.lit(94.0), F.col("rms"))).select("take_id", "rms", "peak", "clipped", "offset_db"), "rms", "peak", "offset_db")


def verdict_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all takes of a source pass: no clipping, and 30 dB in every one."""
    found = levels.take_levels(takes(spark, sf_dir), "samples", chirp=16)
    ok = levels.quality_passed(F.lit(True), F.col("full_scale"), F.col("snr_db"), F.array("snr_db"))
    return found.groupBy("source_id").agg(F.count("*").alias("takes"), F.count_if(ok).alias("passed"), F.bool_and(ok).alias("all_passed"))


def running_peak_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequences.running_peaks(stream(spark, sf_dir), ["channel"], "idx", "x", clip=0.9), "peak_hold")


def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir).withColumn("stream", F.lit("all")).where(F.col("idx") % 97 != 0)
    return sequences.missing_intervals(s, ["stream"], "idx")


def continuity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each channel has seen, missed, and left out of its list of gaps."""
    found = sequences.continuity(stream(spark, sf_dir), ["channel"], "idx", most=16)
    return found.select("channel", "observed", "missing", F.size("intervals").alias("listed"), F.get("intervals", F.lit(15)).getField("end_frame").alias("last_listed"), "omitted")


def tumbling_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir).withColumn("stream", F.lit("all"))
    return rounded(sequences.tumbling_frames(s, ["stream"], "idx", "x", 256), "peak", "rms")


def active_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = F.transform("samples", lambda e, i: F.when((i < 3) | (i > 60), F.lit(0.0)).otherwise(e.cast("double")))
    return takes(spark, sf_dir).select("take_id", sequences.active_span(gated).alias("s")).select("take_id", "s.first", "s.last")


def lag_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 16 samples moved by each take's lag, and its power where the take holds it."""
    lag = (F.col("take_id") % 101 - 50).cast("int")
    rows = takes(spark, sf_dir).withColumn("w", sequences.shifted_window(F.lit(16), F.lit(32), lag, F.size("samples")))
    found = rows.select("take_id", "w.start", "w.end", levels.array_power(levels.part(F.col("samples"), F.col("w.start"), F.col("w.end"))).alias("power"))
    return rounded(found, "power")


def detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.detrended(long_takes(spark, sf_dir), ["take_id"], "idx", "x")
    return rounded(found.groupBy("take_id").agg(F.max(F.abs("residual")).alias("largest"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms")), "largest", "rms")


def increasing_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole takes on a slope, which outweighs them or not."""
    grid = F.transform("samples", lambda x, i: i + x.cast("double") * (F.col("take_id") % 3))
    return takes(spark, sf_dir).select("take_id", sequences.strictly_increasing(grid).alias("increasing"))


def increasing_grids_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole takes as grids: sorted, sorted but for the last sample, and as they are."""
    t = takes(spark, sf_dir)
    up, k, n = F.array_sort("samples"), F.col("take_id") % 3, F.greatest(F.size("samples") - 1, F.lit(0))
    grid = F.when(k == 0, up).when(k == 1, F.concat(F.slice(up, F.lit(1), n), F.slice(up, 1, 1))).otherwise(F.col("samples"))
    return t.select("take_id", sequences.strictly_increasing(grid).alias("increasing"))


def first_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onset and peak of the first arrival, of takes turned into decaying responses."""
    s = long_takes(spark, sf_dir).withColumn("x", F.pow(F.abs("x"), F.lit(4.0)) * F.when((F.col("idx") % 13) == (F.col("take_id") % 13), 500.0).otherwise(0.01))
    return rounded(sequences.first_peak(s, ["take_id"], "idx", "x", ahead=14), "refined", digits=4)


def stream_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, quartile and ninth tenth of each channel's samples, and of prices by line status, at exact ranks."""
    at = {"quarter": lambda n: F.floor(n / 4), "upper_median": lambda n: F.floor(n / 2), "ninth_tenth": lambda n: F.least(F.floor(n * 0.9), n - 1)}
    events = stream(spark, sf_dir).select("channel", "x")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("channel"), (F.col("l_extendedprice") - 30000).alias("x"))
    return ranks.order_statistics(events.unionByName(lines), ["channel"], "x", at)


def longest_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("microphone"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.lit(0).alias("start"), F.col("l_quantity").cast("int").alias("end"), F.col("l_partkey").alias("part"))
    best = sequences.longest_silence(rows.groupBy("microphone", "ord", "start", "end").agg(F.min("part").alias("part")), ["microphone"], "start", "end", "ord")
    return best.select("microphone", "ord", "end")


def take_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes of each source, moved by their lags and averaged over those accepted."""
    s = long_takes(spark, sf_dir).join(takes(spark, sf_dir).select("take_id", "source_id"), "take_id")
    s = s.withColumns({"lag": (F.col("take_id") % 5 - 1).cast("int"), "ok": F.col("take_id") % 4 != 0})
    return rounded(sequences.averaged_takes(s, ["source_id"], "take_id", "idx", "x", "lag", "ok"), "average")


def grid_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each take first leaves the first take's signs; two of three takes have one more at the end."""
    signs = F.transform("samples", lambda e: F.signum(e))
    grid = F.when(F.col("take_id") % 3 == 0, signs).otherwise(F.concat(signs, F.array(F.lit(1.0))))
    found = sequences.first_mismatch(takes(spark, sf_dir).select("take_id", grid.alias("grid")), "take_id", "grid")
    return found.withColumn("first_bin", F.coalesce("first_bin", F.lit(-1)))


def hf_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.high_fraction(takes(spark, sf_dir), "take_id", "samples", 8000.0, 48000.0, 64), "hf_fraction")


def band_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal to noise in octaves: the second half of each take against its first."""
    t = takes(spark, sf_dir).select("take_id", F.slice("samples", 33, 32).alias("signal"), F.slice("samples", 1, 32).alias("quiet"))
    return rounded(spectra.band_snr(t, "take_id", "signal", "quiet", 48000.0, 32, spectra.octave_bands(1500.0, 20000.0)), "snr_db", digits=4)


def welch_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of each take with the take after it."""
    t = takes(spark, sf_dir)
    other = t.select((F.col("take_id") - 1).alias("take_id"), F.col("samples").alias("other"))
    pairs = t.join(other, "take_id").select("take_id", "samples", "other")
    return rounded(spectra.coherence(pairs, "take_id", "samples", "other", segment=16, step=8, segments=7), "coherence", digits=5)


def fir_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    taps = spectra.bandpass_taps(48000.0, 2000.0, 8000.0, 15)
    out = takes(spark, sf_dir).select("take_id", F.posexplode(spectra.filtered(F.col("samples"), taps)).alias("idx", "y"))
    return rounded(out, "y")


def tone_phasor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = takes(spark, sf_dir).select("take_id", spectra.phasor(F.col("samples"), 3000.0, 48000.0).alias("p"), spectra.phasor(F.reverse("samples"), 3000.0, 48000.0).alias("q"))
    found = found.select("take_id", "p.amplitude", spectra.phase_difference(F.col("p.phase_deg"), F.col("q.phase_deg")).alias("difference_deg"))
    return rounded(found, "amplitude", "difference_deg", digits=4)


def correlation_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = takes(spark, sf_dir)
    other = t.select((F.col("take_id") - 1).alias("take_id"), F.col("samples").alias("other"))
    return rounded(spectra.correlation_lag(t.join(other, "take_id").select("take_id", "samples", "other"), "take_id", "samples", "other", 8), "confidence")


_S = "WITH s AS (SELECT vec_id AS take_id, label AS source_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_E = "WITH e AS (SELECT event_type AS channel, event_id AS idx, value / 500 AS x FROM events)"

SQL = {
    "take_quality": LEVELS + """
SELECT take_id, source_id, round(peak_dbfs, 6) AS peak_dbfs, round(rms_dbfs, 6) AS rms_dbfs, round(snr_db, 6) AS snr_db, full_scale, meter_clipped,
  CASE WHEN peak_dbfs IS NULL THEN 'silent' WHEN peak_dbfs >= -1 THEN 'red' WHEN peak_dbfs >= -6 THEN 'hot' WHEN peak_dbfs >= -24 THEN 'good'
    WHEN peak_dbfs >= -50 THEN 'low' ELSE 'silent' END AS zone,
  CASE WHEN peak_dbfs >= -1 THEN 'lower' WHEN peak_dbfs IS NULL OR peak_dbfs < -30 THEN 'raise' ELSE 'keep' END AS advice FROM l""",
    "take_findings": LEVELS + """
, f AS (
  SELECT take_id, 1 AS k, 'clipping' AS kind, 'warning' AS outcome, CAST(full_scale AS DOUBLE) AS value, CAST(1 AS DOUBLE) AS threshold, CAST(NULL AS VARCHAR) AS reason
  FROM l WHERE full_scale > 0
  UNION ALL SELECT take_id, 2, 'broadband_snr', CASE WHEN snr_db IS NULL THEN 'unknown' WHEN snr_db >= 30 THEN 'pass' ELSE 'warning' END, snr_db, 30.0,
    CASE WHEN snr_db IS NULL THEN CASE WHEN coalesce(noise, 0) <= 0 THEN 'silent' ELSE 'below_noise' END END FROM l
)
SELECT take_id, CAST(row_number() OVER (PARTITION BY take_id ORDER BY k) - 1 AS INTEGER) AS ordinal, kind, outcome, round(value, 6) AS value, threshold, reason FROM f""",
    "clip_stats": _E + """, b AS (SELECT idx // 2048 AS b, count(*) AS n, count(*) FILTER (abs(x) >= 0.2) AS hits FROM e GROUP BY 1),
t AS (SELECT CAST(sum(n) AS BIGINT) AS samples, CAST(sum(hits) AS BIGINT) AS clipped, 100.0::DOUBLE * sum(hits) / sum(n) AS percent,
  coalesce(max(100.0::DOUBLE * hits / n) FILTER (n >= 512), 0) AS worst FROM b)
SELECT 'all' AS stream, samples, clipped, round(percent, 6) AS percent, round(worst, 6) AS worst_block_percent,
  CASE WHEN worst > 30 THEN 'fail' WHEN percent > 0.1 THEN 'warning' ELSE 'pass' END AS verdict FROM t""",
    "channel_levels": _E + """, t AS (SELECT channel, count(*) AS samples, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms, count(*) FILTER (abs(x) >= 0.999) AS clipped,
  bool_and(isfinite(x)) AS all_finite FROM e GROUP BY channel), d AS (SELECT *, CASE WHEN peak > 0 THEN 20 * log10(peak) END AS db FROM t)
SELECT channel, samples, round(peak, 6) AS peak, round(rms, 6) AS rms, clipped, all_finite,
  CASE WHEN db IS NULL THEN 'silent' WHEN db >= -1 THEN 'red' WHEN db >= -6 THEN 'hot' WHEN db >= -24 THEN 'good' WHEN db >= -50 THEN 'low' ELSE 'silent' END AS zone,
  CASE WHEN db >= -1 THEN 'lower' WHEN db IS NULL OR db < -30 THEN 'raise' ELSE 'keep' END AS advice FROM d""",
    "snr_ratio": _E + """SELECT channel, round(20 * log10(sqrt(avg(x * x) FILTER (idx % 4 <> 0)) / sqrt(avg(x * x) FILTER (idx % 4 = 0))), 6) AS snr_db FROM e GROUP BY channel""",
    "spl_calibration": _S + """SELECT take_id, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS peak, CAST(max(CAST(abs(x) >= 1 AS INT)) AS INTEGER) AS clipped,
  round(94 - 20 * log10(sqrt(avg(x * x))), 6) AS offset_db FROM s WHERE i >= 8 AND i <= 55 GROUP BY take_id""",
    "verdict_per_source": LEVELS + """SELECT source_id, count(*) AS takes, count(*) FILTER (coalesce(full_scale = 0 AND snr_db >= 30, false)) AS passed,
  bool_and(coalesce(full_scale = 0 AND snr_db >= 30, false)) AS all_passed FROM l GROUP BY source_id""",
    "running_peak_hold": _E + """SELECT channel, idx, round(max(abs(x)) OVER w, 6) AS peak_hold, count(*) FILTER (abs(x) >= 0.9) OVER w AS clip_count FROM e
WINDOW w AS (PARTITION BY channel ORDER BY idx ROWS UNBOUNDED PRECEDING)""",
    "gap_islands": _E + """, g AS (SELECT idx, lag(idx) OVER (ORDER BY idx) AS p FROM e WHERE idx % 97 <> 0)
SELECT 'all' AS stream, p + 1 AS start_frame, idx AS end_frame, idx - p - 1 AS missing FROM g WHERE idx > p + 1""",
    "continuity_report": _E + """, g AS (SELECT channel, idx, lag(idx) OVER (PARTITION BY channel ORDER BY idx) AS p FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY p) AS nth FROM g WHERE idx > p + 1),
l AS (SELECT channel, CAST(sum(idx - p - 1) AS BIGINT) AS missing, CAST(count(*) FILTER (nth <= 16) AS INTEGER) AS listed, max(idx) FILTER (nth = 16) AS last_listed,
  count(*) FILTER (nth > 16) AS omitted FROM n GROUP BY channel)
SELECT channel, count(DISTINCT idx) AS observed, coalesce(any_value(missing), 0) AS missing, coalesce(any_value(listed), 0) AS listed, any_value(last_listed) AS last_listed,
  coalesce(any_value(omitted), 0) AS omitted FROM e LEFT JOIN l USING (channel) GROUP BY channel""",
    "tumbling_frames": _E + """SELECT 'all' AS stream, idx // 256 AS frame, count(*) AS samples, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms,
  count(*) FILTER (abs(x) >= 1) AS clipped FROM e GROUP BY idx // 256 HAVING count(*) = 256""",
    "active_span": _S + """, g AS (SELECT take_id, i, CASE WHEN i < 3 OR i > 60 THEN 0 ELSE x END AS x FROM s), p AS (SELECT take_id, max(abs(x)) * 1e-6 AS f FROM g GROUP BY take_id)
SELECT take_id, CAST(coalesce(min(i) FILTER (abs(x) > f), 0) AS INTEGER) AS first, CAST(coalesce(max(i) FILTER (abs(x) > f), 63) AS INTEGER) AS last FROM g JOIN p USING (take_id) GROUP BY take_id""",
    "lag_windows": _S + """, w AS (SELECT DISTINCT take_id, least(greatest(16 + take_id % 101 - 50, 0), 64) AS a, greatest(least(greatest(16 + take_id % 101 - 50, 0), 64),
  least(greatest(32 + take_id % 101 - 50, 0), 64)) AS b FROM s)
SELECT take_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", round(avg(x * x) FILTER (i >= a AND i < b), 6) AS power FROM s JOIN w USING (take_id) GROUP BY take_id, a, b""",
    "detrend": _S + """, c AS (SELECT take_id, regr_slope(x, i) AS a, regr_intercept(x, i) AS b FROM s GROUP BY take_id)
SELECT take_id, round(max(abs(x - a * i - b)), 6) AS largest, round(sqrt(avg((x - a * i - b) * (x - a * i - b))), 6) AS rms FROM s JOIN c USING (take_id) GROUP BY take_id""",
    "increasing_grids": _S + """, g AS (SELECT take_id, i + x * (take_id % 3) > lag(i + x * (take_id % 3)) OVER (PARTITION BY take_id ORDER BY i) AS up FROM s)
SELECT take_id, bool_and(coalesce(up, true)) AS increasing FROM g GROUP BY take_id""",
    "increasing_grids_all": """WITH u AS (SELECT vec_id, embedding, list_sort(embedding) AS l FROM embeddings),
w AS (SELECT vec_id AS take_id, CASE vec_id % 3 WHEN 0 THEN l WHEN 1 THEN list_concat(l[1:len(l) - 1], l[1:1]) ELSE embedding END AS g FROM u),
s AS (SELECT take_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM w), d AS (SELECT take_id, x > lag(x) OVER (PARTITION BY take_id ORDER BY i) AS up FROM s)
SELECT take_id, bool_and(coalesce(up, true)) AS increasing FROM d GROUP BY take_id""",
    "first_peaks": _S + """, r AS (SELECT take_id, i, pow(abs(x), 4) * CASE WHEN i % 13 = take_id % 13 THEN 500 ELSE 0.01 END AS e FROM s WHERE i < 32),
q AS (SELECT take_id, e, row_number() OVER (PARTITION BY take_id ORDER BY e) - 1 AS k FROM r),
t AS (SELECT take_id, greatest(12 * max(e) FILTER (k = 16), 2 * max(e) FILTER (k = 28), 0.08 * max(e)) AS f FROM q GROUP BY take_id HAVING max(e) > 1e-10),
o AS (SELECT take_id, min(i) AS onset FROM r JOIN t USING (take_id) WHERE i BETWEEN 1 AND 30 AND e >= f GROUP BY take_id),
p AS (SELECT take_id, onset, first(i ORDER BY e DESC, i) AS peak FROM r JOIN o USING (take_id) WHERE i >= onset AND i <= onset + 14 GROUP BY take_id, onset),
y AS (SELECT p.*, a.e AS a, m.e AS m, b.e AS b FROM p JOIN r m ON m.take_id = p.take_id AND m.i = peak LEFT JOIN r a ON a.take_id = p.take_id AND a.i = peak - 1 LEFT JOIN r b ON b.take_id = p.take_id AND b.i = peak + 1)
SELECT take_id, CAST(onset AS BIGINT) AS onset, CAST(peak AS BIGINT) AS peak, round(peak + coalesce(CASE WHEN abs(2 * (a - 2 * m + b)) > 1e-12 THEN (a - b) / (2 * (a - 2 * m + b)) END, 0), 4) AS refined FROM y""",
    "stream_ranks": """WITH r AS (SELECT event_type AS channel, value / 500 AS x FROM events UNION ALL SELECT l_linestatus, l_extendedprice - 30000 FROM lineitem),
k AS (SELECT channel, x, row_number() OVER (PARTITION BY channel ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY channel) AS n FROM r)
SELECT channel, n, max(x) FILTER (k = n // 4) AS quarter, max(x) FILTER (k = n // 2) AS upper_median, max(x) FILTER (k = least(floor(n * 0.9), n - 1)) AS ninth_tenth FROM k GROUP BY channel, n""",
    "longest_silence": """SELECT microphone, ord, "end" FROM (SELECT *, row_number() OVER (PARTITION BY microphone ORDER BY "end" DESC, ord) AS n FROM
  (SELECT DISTINCT l_suppkey AS microphone, l_orderkey * 10 + l_linenumber AS ord, CAST(l_quantity AS INTEGER) AS "end" FROM lineitem)) WHERE n = 1""",
    "take_average": _S + """, u AS (SELECT *, i - greatest(take_id % 5 - 1, 0) AS spot FROM s WHERE take_id % 4 <> 0), n AS (SELECT source_id, count(DISTINCT take_id) AS n FROM u GROUP BY source_id)
SELECT source_id, CAST(spot AS INTEGER) AS idx, round(sum(x) / any_value(n), 6) AS average FROM u JOIN n USING (source_id) WHERE spot >= 0 GROUP BY source_id, spot""",
    "grid_mismatch": """WITH g AS (SELECT vec_id AS take_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(embedding, lambda e: sign(e)) ELSE list_append(list_transform(embedding, lambda e: sign(e)), 1) END AS g FROM embeddings),
f AS (SELECT g AS h FROM g ORDER BY take_id LIMIT 1), d AS (SELECT take_id, g, h, unnest(range(1, greatest(len(g), len(h)) + 1)) AS i FROM g, f)
SELECT take_id, any_value(len(g) <> len(h)) AS lengths_differ, CAST(coalesce(min(i) FILTER (g[i] IS DISTINCT FROM h[i]) - 1, -1) AS INTEGER) AS first_bin FROM d GROUP BY take_id""",
    "hf_fraction": _S + """, w AS (SELECT take_id, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS x FROM s),
b AS (SELECT take_id, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, sum(x * sin(2 * pi() * k * i / 64)) AS im FROM w, range(33) r(k) GROUP BY take_id, k),
p AS (SELECT take_id, k, CASE WHEN k > 0 AND k < 32 THEN 2 ELSE 1 END * (re * re + im * im) AS p FROM b)
SELECT take_id, round(sum(p) FILTER (k >= 11) / sum(p), 6) AS hf_fraction FROM p GROUP BY take_id""",
    "band_snr": _S + """, b AS (SELECT take_id, k, i // 32 AS h, sum(x * cos(2 * pi() * k * (i % 32) / 32)) AS re, sum(x * sin(2 * pi() * k * (i % 32) / 32)) AS im
  FROM s, range(17) r(k) GROUP BY take_id, k, h),
bands AS (SELECT * FROM (VALUES (0, 1500.0::DOUBLE, 3000.0::DOUBLE), (1, 3000, 6000), (2, 6000, 12000), (3, 12000, 20000)) v(band, lo_hz, hi_hz)),
p AS (SELECT take_id, band, lo_hz, hi_hz, sum(re * re + im * im) FILTER (h = 1) AS s, sum(re * re + im * im) FILTER (h = 0) AS q
  FROM b JOIN bands ON k * 1500.0 >= lo_hz AND k * 1500.0 < hi_hz GROUP BY ALL)
SELECT take_id, band, lo_hz, hi_hz, round(CASE WHEN q > 0 AND s > q THEN 10 * log10((s - q) / q) END, 4) AS snr_db FROM p""",
    "welch_coherence": _S + """, g AS (SELECT take_id, m, i - 8 * m AS i, x * (0.5 - 0.5 * cos(2 * pi() * (i - 8 * m) / 15)) AS x FROM s, range(7) r(m) WHERE i >= 8 * m AND i < 8 * m + 16),
b AS (SELECT take_id, m, k, sum(x * cos(2 * pi() * k * i / 16)) AS re, -sum(x * sin(2 * pi() * k * i / 16)) AS im FROM g, range(9) r(k) GROUP BY take_id, m, k),
c AS (SELECT a.take_id, a.k, sum(a.re * b.re + a.im * b.im) AS re, sum(a.im * b.re - a.re * b.im) AS im, sum(a.re * a.re + a.im * a.im) AS xx, sum(b.re * b.re + b.im * b.im) AS yy
  FROM b a JOIN b ON b.take_id = a.take_id + 1 AND a.m = b.m AND a.k = b.k GROUP BY a.take_id, a.k)
SELECT take_id, CAST(k AS INTEGER) AS bin, round(coalesce(least(greatest((re * re + im * im) / nullif(xx * yy, 0), 0), 1), 0), 5) AS coherence FROM c""",
    "fir_bandpass": _S + """, h AS (SELECT k, ((CASE WHEN k = 7 THEN 2 * 8000.0 / 48000 ELSE sin(2 * pi() * 8000 / 48000 * (k - 7)) / (pi() * (k - 7)) END)
  - (CASE WHEN k = 7 THEN 2 * 2000.0 / 48000 ELSE sin(2 * pi() * 2000 / 48000 * (k - 7)) / (pi() * (k - 7)) END)) * (0.5 - 0.5 * cos(2 * pi() * k / 14)) AS h FROM range(15) r(k))
SELECT take_id, CAST(i - k + 7 AS INTEGER) AS idx, round(sum(x * h), 6) AS y FROM s, h WHERE i - k + 7 >= 0 AND i - k + 7 < 64 GROUP BY take_id, i - k + 7""",
    "tone_phasor": _S + """, p AS (SELECT take_id, sum(x * cos(2 * pi() * 3000 * i / 48000)) / 32 AS a, -sum(x * sin(2 * pi() * 3000 * i / 48000)) / 32 AS b,
  sum(x * cos(2 * pi() * 3000 * (63 - i) / 48000)) / 32 AS c, -sum(x * sin(2 * pi() * 3000 * (63 - i) / 48000)) / 32 AS d FROM s GROUP BY take_id),
q AS (SELECT take_id, sqrt(a * a + b * b) AS amplitude, 180 - (degrees(atan2(b, a)) - degrees(atan2(d, c))) AS t FROM p)
SELECT take_id, round(amplitude, 4) AS amplitude, round(180 - (t - 360 * floor(t / 360)), 4) AS difference_deg FROM q""",
    "correlation_lag": _S + """, e AS (SELECT take_id, sum(x * x) AS e FROM s GROUP BY take_id),
c AS (SELECT a.take_id, b.i - a.i AS lag, sum(a.x * b.x) AS r FROM s a JOIN s b ON b.take_id = a.take_id + 1 AND abs(b.i - a.i) <= 8 GROUP BY a.take_id, b.i - a.i),
n AS (SELECT c.take_id, lag, r / sqrt(e.e * f.e) AS r FROM c JOIN e USING (take_id) JOIN e f ON f.take_id = c.take_id + 1)
SELECT take_id, CAST(first(lag ORDER BY r DESC, lag) AS INTEGER) AS lag, round(max(r), 6) AS confidence FROM n GROUP BY take_id""",
}

QUERIES = [
    take_quality, take_findings, clip_stats, channel_levels, snr_ratio, spl_calibration, verdict_per_source, running_peak_hold, gap_islands,
    continuity_report, tumbling_frames, active_span, lag_windows, detrend, increasing_grids, increasing_grids_all, first_peaks, stream_ranks, longest_silence, take_average,
    grid_mismatch, hf_fraction, band_snr, welch_coherence, fir_bandpass, tone_phasor, correlation_lag,
]
