"""Lines, verdicts and roll-ups of sessions, made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import spectra
from tonelake.plans import reports, session
from tonelake.sources import documents

from .stand_ins import read, rounded, stream, takes


def spl_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level calibrations made of parts: rates, references and levels, some of which cannot be."""
    p = read(spark, sf_dir, "part")
    rate, hz = F.when(F.col("p_partkey") % 7 == 0, 7000).otherwise(48000), F.col("p_size") * 500.0
    peak = F.when(F.col("p_partkey") % 5 == 0, 1.0).otherwise(0.5)
    rms = F.when(F.col("p_partkey") % 6 == 0, 0.0).when(F.col("p_partkey") % 11 == 0, 0.75).otherwise(0.25)
    return p.select("p_partkey", reports.spl_issue(rate, hz, rms, peak).alias("issue"))


def impulse_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra and impulse responses made of takes, with grids that stall or values that are not finite."""
    t, k = takes(spark, sf_dir), F.col("take_id")
    grid = F.transform("samples", lambda x, i: F.when((k % 5 == 0) & (i == 30), 1.0).otherwise(i * 10.0 + 10))
    spoilt = F.transform("samples", lambda x, i: F.when((k % 7 == 0) & (i == 63), float("nan")).otherwise(x.cast("double")))
    cut = F.slice("samples", 1, F.when(k % 3 == 0, 60).otherwise(64))
    name = F.when(k % 11 == 0, "../ir.json").when(k % 13 == 0, "..").otherwise(F.concat(F.lit("ir-"), k, F.lit(".json")))
    return t.select(
        "take_id", reports.can_reconstruct(F.lit(48000), grid, spoilt, cut).alias("reconstructs"), reports.impulse_measured(grid, spoilt).alias("measured"),
        reports.impulse_issue(name, F.when(k % 4 == 0, 44100).otherwise(48000), F.lit("shared_stimulus_sweep_start"), spoilt, F.lit(48000)).alias("issue"),
    )


def response_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response files of brands, whose first columns are their grids."""
    p = read(spark, sf_dir, "part")
    cell = F.when(F.col("p_partkey") % 1999 == 3, "n/a").when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.format_string(" %d.5", "p_partkey"))
    rows = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(cell, F.lit(",1.0")).alias("line"))))["line"].alias("lines"))
    found = reports.grid_of(F.concat(F.array(F.lit("frequency_hz,spl_db")), F.col("lines")))
    return rows.select("p_brand", F.size(found).alias("bins"), F.aggregate(found, F.lit(0.0), lambda s, x: s + x).alias("total"))


def quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of a session as its summary lists them: those finished or waiting for review."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    k = F.col("o_orderkey")
    score = F.when(k % 5 != 0, F.round((k % 100) / 100, 2))
    line = reports.quality_line(F.col("o_orderpriority"), F.col("o_orderstatus") == "F", (k % 4 + 1).cast("int"), (k % 3).cast("int"), score, F.when(k % 2 == 0, "clean").otherwise("noisy"), (k % 6 - 3).cast("int"))
    return o.select("o_orderkey", line.alias("l")).select("o_orderkey", "l.line", "l.kind")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks, modes, findings and guidance as text, from suppliers."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    skew = F.when(k % 4 != 0, (k % 40 - 20) * 0.5)
    metrics, kinds = F.array(*[F.lit(x) for x in ("thd", "broadband_snr", "clipping")]), F.array(*[F.lit(x) for x in ("percent", "decibels", "count")])
    sign = F.array(*[F.lit(x) for x in ("at_most", "at_least", "equal_to")])
    pick = lambda a: F.element_at(a, (k % 3 + 1).cast("int"))
    mode = F.element_at(F.array(F.lit("loopback"), F.lit("emitter"), F.lit("relative")), (k % 3 + 1).cast("int"))
    return s.select(
        "s_suppkey", reports.clock_line(F.col("s_name"), F.concat(F.lit("m"), k % 3), skew, F.when(k % 2 == 0, "resampled").otherwise("none"), F.lit("arrival-aligned"), F.when(k % 5 == 0, "no bound")).alias("clock"),
        reports.mode_line(mode, F.lit(7), (k % 8).cast("int"), F.lit("plan")).alias("mode"), reports.position_guidance((k % 4).cast("int"), F.lit(4)).alias("guidance"), reports.low_level_warning(F.col("s_name")).alias("warning"),
        reports.drift_discarded((k % 40) * 12.5).alias("drift"), reports.finding_line(pick(metrics), pick(kinds), pick(sign), F.when(k % 6 != 0, k % 10 * 0.5), F.lit(10.0)).alias("finding"),
    )


def readiness_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What plans of customers allow, by how many microphones are surveyed and where they are."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey") % 9
    high = lambda i: F.when(k % 3 == 0, F.lit(0.0)).when(k % 3 == 1, F.lit(float(i * i))).otherwise(F.lit(float(i * i)))
    third = lambda i: F.when(k % 3 == 2, F.lit(float(i * i * i))).otherwise(F.lit(1.0))
    mic = lambda i: F.struct(F.lit(f"m{i}").alias("id"), F.when((k < 6) | (F.lit(i) < 3), F.array(F.lit(float(i)), high(i), third(i))).alias("position_m"))
    plan = F.struct(F.array(*[mic(i) for i in range(5)]).alias("microphones"), F.when(k < 3, F.struct(F.lit("card").alias("device"), F.lit(9).alias("input_channel"))).alias("loopback"), F.when(k < 6, F.struct(F.lit(9).alias("output_channel"))).alias("timing_reference"))
    plans = documents.strict_json(c.select("c_custkey", F.to_json(plan).alias("text")), "text", session.plan_schema(), "plan")
    return reports.readiness(plans, "c_custkey", "plan")


def sweeps_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "done").otherwise("empty")
    return reports.accepted_sweeps(o.select(F.col("o_custkey").alias("session"), state.alias("state"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 600 + 1).alias("accepted")), ["session"])


def next_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel to record next at each position of a customer's session, and what to do."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    state = F.when(k % 97 == 0, "recording").when(k % 3 == 0, "empty").otherwise("done")
    return reports.next_empty(o.select((F.col("o_custkey") % 200).alias("session"), (k % 5).alias("position"), k.alias("channel"), state.alias("state")), ["session"], "channel")


def reflection_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as segments of their orders' responses."""
    l = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("response"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("sample"), F.when(F.col("l_quantity") > 3, F.col("l_extendedprice")).otherwise(0.0).alias("energy"))  # noqa: E741
    l = l.groupBy("response", "sample").agg(F.max("energy").alias("energy"))  # noqa: E741
    return rounded(reports.direct_segments(l, ["response"], "sample", "energy", 48000.0), "relative_ms", "level_db", digits=4)


def fragment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that fragments of a session agree on."""
    return reports.merged_fragments(*_fragments(spark, sf_dir), "session")[0]


def fragment_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.merged_fragments(*_fragments(spark, sf_dir), "session")[1]


def _fragments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.concat(F.lit("file-"), k % 40)
    content = F.when((k % 40 == 7) & (k % 80 > 40), "other").otherwise(name)
    files = o.select((F.col("o_custkey") % 20).alias("session"), (k % 6).alias("fragment"), name.alias("name"), F.sha2(content, 256).alias("sha256"))
    c, n = read(spark, sf_dir, "customer"), F.col("c_custkey")
    heads = c.select((n % 20).alias("session"), n.alias("fragment"), F.concat(F.lit("head-"), F.when(n % 7 == 0, 0).otherwise(n)).alias("head"), F.when(n % 31 == 30, 44100).otherwise(48000).alias("settings"))
    return files, heads


def stream_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.received(stream(spark, sf_dir), 48000.0), "per_second", digits=3)


def sources_with_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the best of their nation's estimated places."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("session"))
    p = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session"), (F.col("c_custkey") * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.5).alias("z"), (F.col("c_custkey") % 1009 / 1000 + F.col("c_custkey") / 1e9).alias("rms_m"))
    return reports.with_positions(s, p, ["session"]).select("source", F.col("estimated.x").alias("x"), F.col("estimated.z").alias("z"))


def ranges_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels set up anew, of which some had a range of their own."""
    c = read(spark, sf_dir, "customer")
    fresh = c.select(F.col("c_custkey").alias("channel"), F.lit(20.0).alias("start_hz"), F.lit(20000.0).alias("end_hz"))
    old = c.where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("channel"), (F.col("c_custkey") % 100 + 10.0).alias("start_hz"), F.lit(8000.0).alias("end_hz"))
    return reports.preserving_ranges(fresh, old, ["channel"])


def input_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    shot = reports.snapshot(F.col("c_name").alias("device"), k.alias("rate"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("note"))
    mics, files = F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a.csv"), F.lit("b.csv"))
    response = reports.projected_response(mics, files, F.element_at(F.array(*[F.lit(x) for x in "abcd"]), (k % 4 + 1).cast("int")))
    return c.select("c_custkey", shot.alias("s"), response.alias("r")).select("c_custkey", "s.json", "s.sha256", "r.file", "r.error")


def welch_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean spectra of all takes over segments of 32 samples."""
    return rounded(spectra.welch(takes(spark, sf_dir), "take_id", "samples", 48000.0, 32, 16), "level_db", digits=4)


SQL = {
    "spl_checks": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 OR p_size * 500.0 >= 24000 OR p_size <= 0 THEN 'rate_or_reference'
  WHEN p_partkey % 5 = 0 OR p_partkey % 6 = 0 OR p_partkey % 11 = 0 THEN 'levels' END AS issue FROM part""",
    "impulse_checks": """SELECT vec_id AS take_id, vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND vec_id % 3 <> 0 AS reconstructs, vec_id % 5 <> 0 AND vec_id % 7 <> 0 AS measured,
  CASE WHEN vec_id % 11 = 0 OR vec_id % 13 = 0 THEN 'filename' WHEN vec_id % 4 = 0 OR vec_id % 7 = 0 THEN 'samples_rate_or_origin' END AS issue FROM embeddings""",
    "response_grids": """SELECT p_brand, CAST(CASE WHEN NOT bool_or(p_partkey % 1999 = 3) THEN nullif(count(*) FILTER (p_partkey % 9 <> 0), 0) END AS INTEGER) AS bins,
  CASE WHEN NOT bool_or(p_partkey % 1999 = 3) THEN sum(p_partkey + 0.5::DOUBLE) FILTER (p_partkey % 9 <> 0) END AS total FROM part GROUP BY p_brand""",
    "quality_lines": """WITH o AS (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 / 100 END AS score, CASE WHEN o_orderkey % 2 = 0 THEN 'clean' ELSE 'noisy' END AS verdict,
  CASE WHEN o_orderkey % 6 > 3 THEN '; ' || (o_orderkey % 6 - 3) || ' dropped samples' ELSE '' END AS lost FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT o_orderkey, o_orderpriority || CASE WHEN score IS NULL THEN ': recorded (no quality data)' WHEN o_orderstatus = 'F' THEN ': OK (' || (o_orderkey % 4 + 1) || '/' || (o_orderkey % 4 + 1 + o_orderkey % 3) || ' sweeps) — ' || verdict || lost
  ELSE printf(': REVIEW (score %.2f) — ', score) || verdict || lost END AS line, CASE WHEN score IS NULL THEN 'no_data' WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'review' END AS kind FROM o""",
    "report_lines": """SELECT s_suppkey, 'take ' || s_name || ' (m' || (s_suppkey % 3) || '): ' || CASE WHEN s_suppkey % 4 <> 0 THEN printf('skew %+.1f ppm', (s_suppkey % 40 - 20) * 0.5::DOUBLE) ELSE 'skew unknown' END || ', '
    || CASE WHEN s_suppkey % 2 = 0 THEN 'resampled' ELSE 'none' END || ', arrival-aligned' || CASE WHEN s_suppkey % 5 = 0 THEN '; magnitude-only: no bound' ELSE '' END AS clock,
  'localization mode ' || CASE s_suppkey % 3 WHEN 0 THEN 'loopback-referenced: ' || (s_suppkey % 8) || '/7 selected groups with loopback takes' WHEN 1 THEN 'emitter-referenced: fixed-acoustic-reference takes' ELSE 'relative-only: no session-wide absolute origin' END || ', sound speed from plan' AS mode,
  CASE WHEN s_suppkey % 4 = 0 THEN 'Position 1 of 4: place the mic(s) at the main listening position first' ELSE 'Move the mic(s) to position ' || (s_suppkey % 4 + 1) || ' of 4 — stay within ~60 cm of the main listening position' END AS guidance,
  'Very low measured level on ' || s_name || ' — check mic connection and input gain' AS warning,
  printf('clock drift correction at %.1f ppm was discarded after lag-lock verification failed; the raw capture was kept and needs review', s_suppkey % 40 * 12.5::DOUBLE) AS drift,
  ['THD', 'broadband SNR', 'clipping'][s_suppkey % 3 + 1] || CASE WHEN s_suppkey % 6 = 0 THEN ' unknown' ELSE printf(' %.2f ', s_suppkey % 10 * 0.5::DOUBLE) || ['%', 'dB', 'count'][s_suppkey % 3 + 1] || ' (' || ['≤', '≥', '='][s_suppkey % 3 + 1] || ' 10.00 '
    || ['%', 'dB', 'count'][s_suppkey % 3 + 1] || ')' END AS finding FROM supplier""",
    "readiness_lines": """WITH c AS (SELECT c_custkey, c_custkey % 9 AS k FROM customer), l AS (
  SELECT c_custkey, 0 AS n, '5 microphones, expecting ' || CASE WHEN k < 3 THEN 'loopback-referenced (electrical loopback wired)' WHEN k < 6 THEN 'emitter-referenced (surveyed timing emitter)' ELSE 'relative-only (no absolute time origin; wire the loopback or survey the timing emitter)' END AS line FROM c
  UNION ALL SELECT c_custkey, 1, '2/5 microphones unsurveyed; forward solves use surveyed anchors only, the rest wait for inverse/joint solves' FROM c WHERE k >= 6
  UNION ALL SELECT c_custkey, 2, '3/4 surveyed microphones, forward positions need at least 4' FROM c WHERE k >= 6
  UNION ALL SELECT c_custkey, 3, CASE k % 3 WHEN 0 THEN 'microphone geometry is collinear, 3D positions impossible' ELSE 'microphones are coplanar, positions stay mirror-ambiguous without height diversity' END FROM c WHERE k < 6 AND k % 3 < 2)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY n) - 1 AS INTEGER) AS ordinal, 'localization readiness: ' || line AS line FROM l""",
    "sweeps_accepted": """SELECT o_custkey AS session, CAST(least(min(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 <> 0 THEN o_orderkey % 600 + 1 END), 255) AS INTEGER) AS num_sweeps FROM orders GROUP BY o_custkey""",
    "next_channels": """WITH o AS (SELECT o_custkey % 200 AS session, o_orderkey % 5 AS position, o_orderkey AS channel, CASE WHEN o_orderkey % 97 = 0 THEN 'recording' WHEN o_orderkey % 3 = 0 THEN 'empty' ELSE 'done' END AS state FROM orders),
p AS (SELECT session, position, min(channel) FILTER (state = 'empty') AS next FROM o GROUP BY ALL), w AS (SELECT session, bool_or(state = 'recording') AS held, max(position) AS last FROM o GROUP BY session)
SELECT session, position, next, CASE WHEN held THEN 'hold' WHEN next IS NOT NULL THEN 'start' WHEN position < last THEN 'move' ELSE 'save' END AS action FROM p JOIN w USING (session)""",
    "reflection_segments": """WITH l AS (SELECT l_orderkey % 500 AS response, l_partkey * 8 + l_linenumber AS sample, max(CASE WHEN l_quantity > 3 THEN l_extendedprice ELSE 0 END) AS energy FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY response ORDER BY sample) AS n FROM l), d AS (SELECT response, max(energy) AS e, first(sample ORDER BY energy DESC, sample) AS t FROM l GROUP BY response)
SELECT response, sample, round(greatest(sample - t, 0) / 48, 4)::DOUBLE AS relative_ms, round(10 * log10(energy / e), 4) AS level_db FROM r JOIN d USING (response) WHERE n <= 65 AND greatest(sample - t, 0) / 48 <= 80 AND energy > 0 AND e > 0""",
    "fragment_files": """WITH f AS (SELECT o_custkey % 20 AS session, 'file-' || (o_orderkey % 40) AS name, sha256(CASE WHEN o_orderkey % 40 = 7 AND o_orderkey % 80 > 40 THEN 'other' ELSE 'file-' || (o_orderkey % 40) END) AS sha256 FROM orders)
SELECT session, name, min(sha256) AS sha256, count(*) AS fragments FROM f GROUP BY session, name HAVING min(sha256) = max(sha256)""",
    "fragment_issues": """WITH f AS (SELECT o_custkey % 20 AS session, 'file-' || (o_orderkey % 40) AS name, CASE WHEN o_orderkey % 40 = 7 AND o_orderkey % 80 > 40 THEN 1 ELSE 0 END AS c FROM orders),
h AS (SELECT c_custkey % 20 AS session, c_custkey AS fragment, 'head-' || CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey END AS head, CASE WHEN c_custkey % 31 = 30 THEN 44100 ELSE 48000 END AS s FROM customer)
SELECT session, 'file_collision' AS issue, name AS what FROM f GROUP BY session, name HAVING min(c) <> max(c)
UNION ALL SELECT session, 'repeated_head', head FROM h GROUP BY session, head HAVING count(*) > 1
UNION ALL SELECT session, 'other_settings', CAST(fragment AS VARCHAR) FROM h JOIN (SELECT session, first(s ORDER BY fragment) AS s0 FROM h GROUP BY session) USING (session) WHERE s <> s0""",
    "stream_storage": """SELECT event_type AS channel, count(*) AS received, max(event_id) - min(event_id) + 1 - count(*) AS dropped, max(event_id) - min(event_id) + 1 > count(*) AS incomplete,
  round(count(*) / ((max(event_id) - min(event_id) + 1) / 48000), 3) AS per_second FROM events GROUP BY event_type""",
    "sources_with_positions": """WITH p AS (SELECT c_nationkey AS session, c_custkey * 1.0::DOUBLE AS x, c_custkey % 1009 / 1000 + c_custkey / 1e9 AS rms FROM customer), b AS (SELECT session, first(x ORDER BY rms) AS x FROM p GROUP BY session)
SELECT s_suppkey AS source, x, CASE WHEN x IS NOT NULL THEN 1.5::DOUBLE END AS z FROM supplier LEFT JOIN b ON s_nationkey = session""",
    "ranges_preserved": """SELECT c_custkey AS channel, CASE WHEN c_custkey % 4 = 1 THEN c_custkey % 100 + 10.0 ELSE 20 END::DOUBLE AS start_hz, CASE WHEN c_custkey % 4 = 1 THEN 8000 ELSE 20000 END::DOUBLE AS end_hz FROM customer""",
    "input_snapshots": """WITH c AS (SELECT c_custkey, c_custkey % 4 AS m, '{"device":"' || c_name || '","rate":' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ',"note":"' || c_mktsegment || '"' ELSE '' END || '}' AS json FROM customer)
SELECT c_custkey, json, sha256(json) AS sha256, CASE m WHEN 0 THEN 'a.csv' WHEN 1 THEN 'b.csv' END AS file, CASE m WHEN 2 THEN 'canonical response filename is unavailable' WHEN 3 THEN 'canonical microphone is unavailable' END AS error FROM c""",
    "welch_levels": """WITH s AS (SELECT vec_id AS take_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
g AS (SELECT take_id, m, i - 16 * m AS i, x * (0.5 - 0.5 * cos(2 * pi() * (i - 16 * m) / 31)) AS x FROM s, range(3) r(m) WHERE i >= 16 * m AND i < 16 * m + 32),
b AS (SELECT take_id, m, k, sum(x * cos(2 * pi() * k * i / 32)) AS re, sum(x * sin(2 * pi() * k * i / 32)) AS im FROM g, range(17) r(k) GROUP BY take_id, m, k),
w AS (SELECT sum(0.5 - 0.5 * cos(2 * pi() * i / 31)) AS t FROM range(32) r(i)), p AS (SELECT take_id, k, avg(re * re + im * im) * (2 / any_value(t)) ** 2 AS p FROM b, w GROUP BY take_id, k)
SELECT take_id, k * 1500.0::DOUBLE AS frequency_hz, round(10 * log10(p), 4) AS level_db FROM p""",
}

QUERIES = [
    spl_checks, impulse_checks, response_grids, quality_lines, report_lines, readiness_lines, sweeps_accepted, next_channels, reflection_segments, fragment_files, fragment_issues,
    stream_storage, sources_with_positions, ranges_preserved, input_snapshots, welch_levels,
]
