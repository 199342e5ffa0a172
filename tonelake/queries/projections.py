"""Settings, configurations and rows of a journal, made of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.plans import projections

from .stand_ins import read, rounded


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(k) for k in ("sweep", "white_noise", "mls", "dirac", "tone", "pink_noise")])
    made = projections.signal_parameters(
        F.get(kinds, (F.col("p_partkey") % 6).cast("int")), F.col("p_size") * 1.0, F.col("p_size") * 400.0, F.when(F.col("p_partkey") % 5 == 0, 0.0).otherwise(0.5), F.col("p_size") / 4.0,
        F.col("p_size") / 10.0 - 1, F.lit(0.25),
    )
    return p.select("p_partkey", "p_size", made.alias("p"))


def signal_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part, read as a signal, is made with."""
    return _parameters(spark, sf_dir).select("p_partkey", "p.shape", "p.amp", "p.order", "p.start_hz", "p.end_hz", "p.bass_octave_s", "p.pre_silence_s", "p.post_silence_s")


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.when(F.col("p_partkey") % 11 == 0, 0).when(F.col("p_partkey") % 7 == 0, 16000).otherwise(48000)
    seconds = F.when(F.col("p_partkey") % 13 == 0, 0.0).otherwise(F.col("p_size") / 8.0)
    found = _parameters(spark, sf_dir).select("p_partkey", projections.acquisition(F.col("p"), seconds, rate).alias("a")).select("p_partkey", "a.*")
    return rounded(found, "generated_s", "playback_s", "level_dbfs")


def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wizards made of customers; half of the texts are blank and half of the signals no sweep."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    side = lambda n: F.struct(F.col("c_name").alias("device"), k.cast("string").alias("id"), F.lit(48000).alias("rate"), F.lit(n).alias("channels"))
    w = c.select(
        k, side(8).alias("playback"), side(2).alias("recording"), F.array("c_mktsegment").alias("group_names"), F.when(k % 2 == 0, " ").otherwise("a.csv").alias("calibration"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("b.csv"))).alias("calibrations"), F.lit("out").alias("directory"), F.when(k % 2 == 0, "sweep").otherwise("mls").alias("kind"),
        F.lit(5.0).alias("duration_s"), F.lit(-6.0).alias("level_db"), F.lit(20.0).alias("start_hz"), F.lit(20000.0).alias("end_hz"), (k % 14).cast("double").alias("bass_octave_s"),
        (k % 3 - 1).cast("double").alias("pre_silence_s"), F.when(k % 4 == 0, -1.0).alias("post_silence_s"), F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")).alias("description"),
        F.concat(F.lit("/takes/"), k, F.lit(".wav")).alias("probe_path"), F.lit(None).cast("string").alias("anchor_path"), (k % 5).cast("int").alias("sweeps"), (k % 3).cast("int").alias("positions"),
    )
    d = projections.configuration(w, ["c_custkey"])
    return d.select(
        "c_custkey", "document.playback_device", "document.recording_channels", F.array_join("document.channel_names", ",").alias("names"), "document.calibration",
        F.size(F.coalesce("document.calibrations", F.array().cast("array<string>"))).alias("calibrations"), "document.description", "document.probe_file", "document.anchor_file",
        "document.bass_octave_s", "document.pre_silence_s", "document.post_silence_s", "document.num_positions",
    )


def response_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions, order lines as sources, parts of the supplier key as microphones."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), "o_custkey")
    sources = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("source_id")).distinct()
    microphones = o.where("o_custkey % 11 <> 0").select("session", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal")).withColumn("microphone_id", F.concat(F.lit("m"), F.col("ordinal")))
    chosen = o.where("o_custkey % 3 = 0").select("session", F.when(F.col("o_custkey") % 2 == 0, "m1").otherwise("m9").alias("microphone_id"))
    file = F.when(F.col("source_id") % 5 == 0, "../a.csv").when(F.col("source_id") % 4 != 0, F.concat(F.lit("ir-"), "source_id", F.lit(".csv")))
    takes = sources.where("(session + source_id) % 7 <> 0").select("session", "source_id", F.explode(F.array(F.lit("m0"), F.lit("m1"))).alias("microphone_id")).select(
        "*", file.alias("impulse_file"), F.lit(48000.0).alias("rate"), F.concat(F.lit("ref-"), "session").alias("reference_id")
    )
    return projections.measured_responses(sources, microphones, takes, chosen)


def legacy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the probes of each order, with the fields that older readers know."""
    line = F.struct(F.col("l_linenumber").alias("channel"), F.col("l_discount").alias("arrival_ms"), F.col("l_tax").alias("gain_db"), F.col("l_returnflag").alias("internal"))
    found = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("rows"))  # an order's few lines
    return found.select("l_orderkey", F.to_json(projections.projected(F.col("rows"), ["channel"])).alias("channels"))


def joint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    point = F.when(F.col("c_custkey") % 3 != 0, F.struct(F.array("c_acctbal").alias("position_m"), F.array(F.lit(0.5)).alias("sigma_m"), F.lit(0.25).alias("rms_residual_m")))
    found = c.select("c_custkey", projections.joint_row(point, F.col("c_custkey") % 2 == 0).alias("r"))
    return found.select("c_custkey", F.get("r.position_m", F.lit(0)).alias("x"), "r.rms_residual_m", "r.gdop", "r.mirror_ambiguous", "r.loo_worst", "r.reason")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").withColumns({"quality": F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")), "stimulus": F.when(F.col("s_suppkey") % 5 == 0, F.lit("sweep"))})
    return projections.source_entries(s, "s_nationkey", ["s_suppkey"], F.concat("s_name", F.lit(" (Mic 1)")), "quality", "stimulus")


def evidence_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)


def evidence_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the first and of the ninth source of every nation."""
    wanted = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.explode(F.array(F.lit(0), F.lit(8))).alias("measurement_index"))
    return projections.entry_for(_entries(spark, sf_dir), wanted, ["s_nationkey", "measurement_index"], "quality")


def channel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey").cast("int")
    mapping = lambda n: F.struct(F.sequence(F.lit(0), n).alias("outputs"))
    mappings = F.when(k % 7 != 0, F.array(mapping(k % 3), mapping(k % 5)))
    return c.select("c_custkey", projections.interface_channels(mappings).alias("channels"))


def workflows_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 9 == 0, "running").when(F.col("o_orderkey") % 4 == 0, None).otherwise("idle").alias("state"))
    return projections.busy(o, ["o_custkey"])


def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files beside recordings: takes of theirs, of others, and names that only begin like one."""
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("folder"), F.col("o_orderkey").alias("k"))
    stem = F.concat(F.lit("L"), F.col("k") % 50)
    name = F.when(F.col("k") % 3 == 0, F.concat(stem, F.lit(".takeaway.wav"))).otherwise(projections.raw_take_file(F.concat(stem, F.lit(".wav")), F.col("k") % 4))
    recordings = o.where("k % 5 = 0").select("folder", F.concat(F.lit("L"), F.col("k") % 50, F.lit(".wav")).alias("name"))
    return projections.stale_takes(o.select("folder", name.alias("name")).distinct(), recordings)


def session_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of sessions with some more that have an error and no input."""
    s = read(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("session"), F.col("s_suppkey").alias("channel"), F.col("s_name").alias("input"))
    return projections.with_channel(old, s.where("s_suppkey % 2 = 1").select(F.col("s_nationkey").alias("session"), F.col("s_suppkey").alias("channel"), F.lit("failed").alias("error")))


def session_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, k = read(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    wav = F.concat(F.when((k % 13 == 0) & (F.col("l_linenumber") == 1), "../").otherwise(""), F.lit("c"), "l_linenumber", F.lit(".wav"))
    csv = F.concat(F.lit("c"), F.when(k % 7 == 0, 1).otherwise(F.col("l_linenumber")), F.when(k % 11 == 0, ".txt").otherwise(".csv"))
    rows = line.select("l_orderkey", F.when(k % 17 == 0, csv).otherwise(wav).alias("wav_path"), csv.alias("csv_path"), (k % 19 != 0).alias("success"))
    return projections.session_issue(rows, ["l_orderkey"])


def callback_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case of a callback, with how many parts have as many channels as it wants."""
    cases = projections.callback_cases(spark)
    parts = read(spark, sf_dir, "part").groupBy((F.col("p_size") * 2).alias("_n")).agg(F.count("*").alias("_parts"))
    fits = cases.join(parts, F.col("_n") >= F.col("channels"), "left")
    return fits.groupBy("format", "channels", "frames", "finite").agg(F.coalesce(F.sum("_parts"), F.lit(0)).alias("devices"))


def route_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    route: Column = F.when(k % 2 == 0, "builtin_input").otherwise("hdmi_output")
    wanted = F.when(k % 3 == 0, 44100).when(k % 3 == 1, 96000)
    return p.select("p_partkey", projections.native_rate(wanted).alias("rate"), projections.route_issue(route, F.col("p_size") % 11).alias("issue"))


def order_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", projections.instant_text(F.col("o_orderdate")).alias("at"))


_P = """WITH k AS (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN 'sweep' WHEN 1 THEN 'noise' WHEN 2 THEN 'mls' WHEN 3 THEN 'dirac' WHEN 4 THEN 'sweep' ELSE 'noise' END AS shape FROM part),
p AS (SELECT p_partkey, p_size, shape, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 0.5 END::DOUBLE AS amp, CASE WHEN shape = 'mls' THEN 16 END::INTEGER AS "order", CASE WHEN shape = 'sweep' THEN p_size END::DOUBLE AS start_hz,
  CASE WHEN shape = 'sweep' THEN p_size * 400 END::DOUBLE AS end_hz, CASE WHEN shape = 'sweep' THEN least(greatest(p_size / 4, 1), 10) END::DOUBLE AS bass_octave_s,
  CASE WHEN shape = 'sweep' THEN greatest(p_size / 10.0::DOUBLE - 1, 0) END::DOUBLE AS pre_silence_s, CASE WHEN shape = 'sweep' THEN 0.25 END::DOUBLE AS post_silence_s FROM k)"""
_E = """WITH s AS (SELECT s_nationkey, s_name AS speaker, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS measurement_index, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS quality,
  CASE WHEN s_suppkey % 5 = 0 THEN 'sweep' END AS stimulus FROM supplier), e AS (SELECT * FROM s WHERE quality IS NOT NULL OR stimulus IS NOT NULL)"""

SQL = {
    "signal_settings": _P + " SELECT p_partkey, shape, amp, \"order\", start_hz, end_hz, bass_octave_s, pre_silence_s, post_silence_s FROM p",
    "acquisitions": _P + """, a AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 0 WHEN p_partkey % 7 = 0 THEN 16000 ELSE 48000 END AS rate, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE p_size / 8 END AS seconds FROM p),
b AS (SELECT *, CASE WHEN rate = 0 THEN 'rate' WHEN seconds <= 0 AND shape <> 'mls' THEN 'duration' WHEN shape = 'sweep' AND end_hz > rate / 2 THEN 'band' END AS issue,
  greatest(log2(least(100, end_hz) / start_hz), 0) + 0.5 * greatest(log2(least(1000, end_hz) / 100), 0) + 0.25 * greatest(log2(end_hz / 1000), 0) AS zones FROM a),
f AS (SELECT *, CAST(CASE shape WHEN 'sweep' THEN round(greatest(zones * bass_octave_s, 1) * rate) + round(pre_silence_s * rate) + round(0.25 * rate) WHEN 'mls' THEN 65535 ELSE round(seconds * rate) END AS BIGINT) AS n FROM b)
SELECT p_partkey, CASE WHEN issue IS NULL THEN shape NOT IN ('sweep', 'mls') END AS duration_applies, CASE WHEN issue IS NULL THEN n END AS generated_frames, CASE WHEN issue IS NULL THEN round(n / rate, 6) END AS generated_s,
  CASE WHEN issue IS NULL THEN CAST(rate // 4 * 2 AS BIGINT) END AS padding_frames, CASE WHEN issue IS NULL THEN n + rate // 4 * 2 END AS playback_frames, CASE WHEN issue IS NULL THEN round((n + rate // 4 * 2) / rate, 6) END AS playback_s,
  CASE WHEN issue IS NULL AND amp > 0 THEN round(20 * log10(amp), 6) END AS level_dbfs, issue FROM f""",
    "configurations": """SELECT c_custkey, c_name AS playback_device, 2 AS recording_channels, c_mktsegment AS names, CASE WHEN c_custkey % 2 <> 0 THEN 'a.csv' END AS calibration, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS calibrations,
  c_mktsegment AS description, c_custkey || '.wav' AS probe_file, CAST(NULL AS VARCHAR) AS anchor_file, CASE WHEN c_custkey % 2 = 0 THEN least(greatest(c_custkey % 14, 1), 10) END::DOUBLE AS bass_octave_s,
  CASE WHEN c_custkey % 2 = 0 THEN greatest(c_custkey % 3 - 1, 0) END::DOUBLE AS pre_silence_s, CASE WHEN c_custkey % 4 = 0 THEN 0 END::DOUBLE AS post_silence_s, CASE WHEN c_custkey % 3 = 2 THEN 2 END AS num_positions FROM customer""",
    "response_declarations": """WITH l AS (SELECT DISTINCT l_orderkey AS session, l_linenumber AS source_id FROM lineitem),
m AS (SELECT session, source_id, o_custkey, CASE WHEN o_custkey % 11 <> 0 AND (o_custkey % 3 <> 0) THEN 'm0' WHEN o_custkey % 11 <> 0 AND o_custkey % 2 = 0 THEN 'm1' WHEN o_custkey % 11 <> 0 THEN 'm9' END AS mic,
  (session + source_id) % 7 <> 0 AS taken, CASE WHEN source_id % 5 = 0 THEN '../a.csv' WHEN source_id % 4 <> 0 THEN 'ir-' || source_id || '.csv' END AS file FROM l LEFT JOIN orders ON o_orderkey = session),
i AS (SELECT *, CASE WHEN mic IS NULL THEN 'no_microphones' WHEN mic = 'm9' THEN 'unknown_microphone' WHEN NOT taken THEN 'take_missing' WHEN file = '../a.csv' THEN 'file_name' END AS issue FROM m)
SELECT session, source_id, CASE WHEN issue IS NULL THEN file END AS path, CASE WHEN issue IS NULL THEN 48000.0::DOUBLE END AS rate, CASE WHEN issue IS NULL THEN 'ref-' || session END AS reference_id, issue FROM i WHERE issue IS NOT NULL OR file IS NOT NULL""",
    "legacy_results": """SELECT l_orderkey, '[' || string_agg('{"channel":' || l_linenumber || '}', ',' ORDER BY l_linenumber) || ']' AS channels FROM lineitem GROUP BY l_orderkey""",
    "joint_rows": """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS x, CASE WHEN c_custkey % 3 <> 0 THEN 0.25::DOUBLE END AS rms_residual_m, CAST(NULL AS DOUBLE) AS gdop, c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AS mirror_ambiguous,
  CAST(NULL AS VARCHAR) AS loo_worst, CASE WHEN c_custkey % 3 = 0 THEN 'solve_failed' END AS reason FROM customer""",
    "evidence_entries": _E + " SELECT * FROM e",
    "evidence_lookups": _E + " SELECT n_nationkey AS s_nationkey, i AS measurement_index, quality FROM nation CROSS JOIN (VALUES (0), (8)) v(i) LEFT JOIN e ON e.s_nationkey = n_nationkey AND measurement_index = i",
    "channel_totals": "SELECT c_custkey, CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey % 3 + c_custkey % 5 + 2 END AS INTEGER) AS channels FROM customer",
    "workflows_busy": "SELECT o_custkey, bool_or(o_orderkey % 9 = 0) AS busy FROM orders GROUP BY o_custkey",
    "stale_files": """WITH f AS (SELECT DISTINCT o_custkey % 20 AS folder, 'L' || (o_orderkey % 50) AS stem, o_orderkey % 4 + 1 AS n FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT DISTINCT o_custkey % 20 AS folder, 'L' || (o_orderkey % 50) AS stem FROM orders WHERE o_orderkey % 5 = 0)
SELECT folder, stem || '.take' || n || '.wav' AS name FROM f JOIN r USING (folder, stem)""",
    "session_channels": "SELECT s_nationkey AS session, s_suppkey AS channel, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS input, CASE WHEN s_suppkey % 2 = 1 THEN 'failed' END AS error FROM supplier",
    "session_checks": """WITH r AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 13 = 0 AND l_linenumber = 1 AND l_orderkey % 17 <> 0 THEN 1 ELSE 0 END AS out, 'c' || CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE l_linenumber END AS csv FROM lineitem)
SELECT k AS l_orderkey, CASE WHEN k % 19 = 0 THEN NULL WHEN max(out) = 1 THEN 'path' WHEN k % 11 = 0 OR count(*) > count(DISTINCT csv) THEN 'output' WHEN k % 17 = 0 THEN 'output_is_input' END AS issue FROM r GROUP BY k""",
    "callback_grid": """WITH f AS (SELECT unnest(['f32','f64','i8','i16','i24','i32','i64','u8','u16','u24','u32','u64','f32','f64']) AS format, generate_subscripts(range(14), 1) <= 12 AS finite)
SELECT format, channels, frames, finite, (SELECT count(*) FROM part WHERE p_size * 2 >= channels) AS devices FROM f, (VALUES (2), (8), (33), (94)) c(channels), (VALUES (32), (128), (512), (1024)) b(frames)""",
    "route_checks": """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'builtin_input' ELSE 'hdmi_output' END AS route, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 8 END AS most, p_size % 11 AS n FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 44100 ELSE 48000 END AS rate, CASE WHEN n < 1 OR n > most THEN route || ' supports ' || most || ' channels, got ' || n END AS issue FROM r""",
    "order_instants": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS at FROM orders",
}

QUERIES = [
    signal_settings, acquisitions, configurations, response_declarations, legacy_results, joint_rows, evidence_entries, evidence_lookups, channel_totals, workflows_busy,
    stale_files, session_channels, session_checks, callback_grid, route_checks, order_instants,
]
