"""Repeats, catalogues, curves and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import acoustics, identity, levels
from tonelake.operators import catalogue, combine, curves

from .stand_ins import measurements, read, rounded

_M = """WITH m AS (SELECT l_orderkey % 50 AS session, l_partkey % 7 AS source, l_suppkey % 10 AS microphone, l_linenumber AS repeat, l_quantity AS distance_m,
  l_discount AS sigma_m, l_extendedprice AS confidence_db, l_linestatus AS band, l_returnflag AS reason FROM lineitem)"""


def combine_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One range cell for each source and microphone from all repeats; those over 45 m are refused."""
    found = combine.combined(
        measurements(spark, sf_dir), ["session", "source", "microphone"], ["distance_m"], "sigma_m", "distance_m", "confidence_db", ["band"], F.col("distance_m") <= 45
    )
    return rounded(found, "distance_m", "sigma_m", "confidence_db")


def pooled_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    return rounded(m.groupBy("microphone").agg(combine.upper_median(F.col("distance_m")).alias("upper"), combine.half_spread("distance_m").alias("half_spread"), combine.scatter(F.col("sigma_m")).alias("scatter")), "scatter")


def top_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    return combine.fullest_group(m.select(F.struct("session", "source").alias("k"), "repeat"), "k", "repeat").select("k.session", "k.source", "repeat", "takes")


def two_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).groupBy("session", "source", "microphone").agg(F.max("confidence_db").alias("bound"))
    two = m.groupBy("session", "source").agg(combine.two_largest(F.col("bound")).alias("b"))
    return two.select("session", "source", F.round(F.aggregate("b", F.lit(0.0), lambda s, x: s + x), 4).alias("timing_bound"))


def loopback_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).select("session", "repeat", "microphone", "distance_m")
    return rounded(combine.stability(m, "session", "repeat", "microphone", "distance_m", most=40.0), "scatter")


def reference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("reference"))
    return combine.reference_summary(o, ["session"], "reference")


def emitter_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("surveyed", F.col("microphone") * 5.0)
    return combine.worst_anchor(m, ["session"], "microphone", "distance_m", "surveyed", 44.5)


def range_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    m = m.withColumn("reason", F.when(F.col("distance_m") > 45, F.col("reason"))).withColumn("distance_m", F.when(F.col("reason").isNull(), F.col("distance_m")))
    return combine.summary_line(m, ["session"], "distance_m", "reason")


def skew_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("session"), F.col("s_suppkey").alias("take"), (F.col("s_acctbal") / 50 - 90).alias("ppm"))
    return rounded(combine.skew_warnings(s, ["session"], "take", "ppm"), "value")


def probe_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("arrival"), F.max("value").alias("peak"), F.percentile("value", F.lit(0.5)).alias("noise"))
    c = c.withColumn("all", F.lit(0))
    return rounded(combine.aligned_arrivals(c, ["all"], "arrival", "peak", "noise").drop("all", "peak", "noise"), "gain_db", "snr_db")


def drift_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First known drift, whether any take was corrected, and the worst advice of each microphone."""
    ppm = (F.col("l_extendedprice") / 40 - 100).alias("ppm")
    t = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("microphone"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).alias("take"), ppm, F.col("l_discount").alias("confidence"))
    t = t.withColumn("action", acoustics.drift_action(F.col("ppm"), F.col("confidence") * 10))
    rank = F.when(F.col("action") == "none", 0).when(F.col("action") == "correct", 1).when(F.col("action") == "correct_and_advise", 2).otherwise(3)
    t = t.groupBy("microphone", "take").agg(F.min("ppm").alias("ppm"), F.max(rank).alias("severity")).withColumn("corrected", F.col("severity").between(1, 2))
    return rounded(combine.drift_roll_up(t.withColumn("ppm", F.when(F.col("severity") > 0, F.col("ppm"))), ["microphone"], "take", "ppm", "corrected", "severity"), "drift_ppm")


def range_sigmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival and range uncertainties of measurements at 48 kHz."""
    m = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_extendedprice") / 4000).alias("confidence"), (F.col("l_quantity") * 200).alias("lo"))
    s = acoustics.arrival_sigma(F.col("confidence"), F.col("lo"), F.lit(8000.0), F.lit(48000.0))
    d = acoustics.propagation_metres(F.col("l_quantity") * 100, F.lit(48000.0), F.lit(343.0), F.lit(1.5), F.lit(0.002))
    m = m.withColumns({"sigma_samples": s, "distance_m": d})
    m = m.withColumn("sigma_m", acoustics.range_sigma(F.col("sigma_samples"), F.col("distance_m"), F.lit(48000.0), F.lit(343.0), F.lit(3.0), F.lit(0.002)))
    kept = m.withColumn("sigma_samples", levels.finite(F.col("sigma_samples"))).select("l_orderkey", "l_linenumber", "l_partkey", "sigma_samples", "distance_m", "sigma_m")
    return rounded(kept, "sigma_samples", "distance_m", "sigma_m")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region and nation pairs that no nation row holds."""
    n = read(spark, sf_dir, "nation")
    want = catalogue.grid(read(spark, sf_dir, "region").select("r_regionkey"), n.select("n_nationkey"))
    return catalogue.missing_cells(want, n.select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey"), ["r_regionkey", "n_nationkey"])


def orphan_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part the catalogue has under another key, which is so for every third one, by part."""
    parts = read(spark, sf_dir, "part").withColumn("p_partkey", F.when(F.col("p_partkey") % 3 == 0, -1 - F.col("p_partkey")).otherwise(F.col("p_partkey")))
    return catalogue.orphans(read(spark, sf_dir, "lineitem"), parts, "l_partkey", "p_partkey").groupBy("l_partkey").agg(F.count("*").alias("lines"))


def repeated_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.repeated_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def calibration_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for each order: its own, else its customer's, else the default; some customers are there twice."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("channel"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).when(F.col("o_orderstatus") == "P", "").alias("own"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("").alias("given"))
    c = c.unionByName(c.where("channel % 9 = 4").withColumn("given", F.lit("other")))
    return catalogue.with_fallback(o, "own", c, "channel", "given", F.lit("flat"), "calibration").select("o_orderkey", "calibration")


def take_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as takes of their supplier's microphone, whose calibration is missing for some and there twice for others."""
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("microphone_id"))
    k = F.col("s_suppkey")
    c = read(spark, sf_dir, "supplier").select(F.when(k % 7 == 3, -k).otherwise(k).alias("microphone_id"), F.col("s_acctbal").alias("gain"))
    found = catalogue.calibrated(t, c.unionByName(c.where("microphone_id % 11 = 4")), "microphone_id")
    return found.select("l_orderkey", "l_linenumber", "microphone_id", F.col("calibration.gain").alias("gain"), "issue")


def interval_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.createDataFrame([(0, 500, "left"), (1000, 2500, "right"), (4000, 4001, "sub")], "start_frame long, end_frame long, channel string")
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    return catalogue.routed(e, "event_id", regions, F.col("event_type")).groupBy("channel").agg(F.count("*").alias("frames"))


def region_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as output regions: which of an order's begin too early."""
    r = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") * 10).alias("start_frame"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") - 3).alias("end_frame"))
    return catalogue.overlapping_regions(r, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("bad"))


def rate_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = spark.createDataFrame([(900.0, 950.0), (940.0, 960.5), (1040.0, 1041.0)], "lo double, hi double")
    return catalogue.within_bounds(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", bounds)


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    old = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_acctbal").alias("value"))
    new = c.where("c_acctbal > 5000").groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_acctbal").alias("value"))
    return catalogue.upserted(old, new, ["c_nationkey", "c_mktsegment"])


def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").withColumn("label", F.concat("s_name", F.lit(" (Mic "), F.col("s_suppkey") % 3, F.lit(")")))
    found = catalogue.identities(s, "s_nationkey", ["s_acctbal", "s_suppkey"], F.col("label"))
    return found.select("s_suppkey", "s_nationkey", "speaker", "measurement_index")


def role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One role for each document source: of primary, supporting and other rows the first."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("n_chars") > 4000, 0).when(F.col("lang") == "en", 1).otherwise(2).alias("priority"))
    return catalogue.first_by_priority(d, ["source"], "priority", ["doc_id"])


def hash_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files named by their language and length: copies, sizes, and names in conflict."""
    d = read(spark, sf_dir, "documents").withColumn("name", F.concat("lang", F.lit("-"), "n_chars"))
    return catalogue.inventory(d, "name", "text")


def device_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(
        "p_brand", F.col("p_name").alias("name"), F.col("p_size").alias("channels"), F.array(F.col("p_size") * 100, F.col("p_size") % 7 * 100).alias("rates"), (F.col("p_partkey") % 11 == 0).alias("is_default")
    )
    found = catalogue.merged_devices(p, "p_brand")
    return found.withColumn("rates", F.array_join("rates", ","))


def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit(" ("), "p_name", F.lit(")")).alias("label"))
    return catalogue.without_shared_prefix(p, "label").select("p_partkey", "short_name")


def name_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.name_listing(read(spark, sf_dir, "supplier"), ["s_nationkey"], "s_name", most=3)


def device_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and ids as selectors of devices."""
    p = read(spark, sf_dir, "part")
    wanted = p.select(F.col("p_partkey").cast("string").alias("selector")).union(p.select(F.upper("p_name")).distinct()).union(spark.createDataFrame([("none",)], "selector string"))
    return catalogue.unique_or_named(wanted, p.select(F.col("p_partkey").cast("string").alias("device_id"), F.concat("p_name", F.when(F.col("p_partkey") < 5, "").otherwise(" x")).alias("name")))


def device_lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``device_lookup`` with all parts as devices; names that clash are asked for too."""
    p = read(spark, sf_dir, "part")
    name = F.concat("p_name", F.when(F.col("p_partkey") < 5, "").otherwise(" x"))
    wanted = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("string").alias("selector")).union(p.select(F.upper("p_name")).union(p.select(F.upper(name))).distinct())
    return catalogue.unique_or_named(wanted.union(spark.createDataFrame([("none",)], "selector string")), p.select(F.col("p_partkey").cast("string").alias("device_id"), name.alias("name")))


def recording_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    speakers = n.select(F.col("n_nationkey").alias("speaker_index"), F.when(F.col("n_nationkey") == 3, "LFE").otherwise(F.col("n_name")).alias("speaker"))
    regions = read(spark, sf_dir, "region")
    return catalogue.recording_grid(regions.select(F.col("r_regionkey").alias("position")), speakers, regions.select(F.col("r_regionkey").alias("microphone")))


def log_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price over size of each brand as a curve, read at fixed frequencies."""
    p = read(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("hz")).agg(F.avg("p_retailprice").alias("db"))
    grid = spark.createDataFrame([(float(x),) for x in (0.5, 1.0, 2.5, 10.0, 17.3, 33.3, 49.0, 80.0)], "hz double")
    targets = p.select("p_brand").distinct().crossJoin(F.broadcast(grid))
    return rounded(curves.interpolated(p, targets, ["p_brand"], "hz", "db"), "db", digits=4)


def gated_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * 300.0).alias("hz"), (F.col("p_partkey") % 97).cast("double").alias("thd"), (F.col("p_retailprice") / 40).alias("level"))
    return curves.gated_peak(p, ["p_brand"], "hz", "thd", "level", 80.0, 12000.0, below=2.0)


def low_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * 300.0).alias("hz"), (F.col("p_retailprice") / -18.0).alias("db"))
    return rounded(curves.low_level(p, ["p_brand"], "hz", "db", F.lit(10.0), F.lit(9000.0)), "average_db")


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of brands with missing columns, restored from an archive on the same or another grid."""
    p = read(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("bin")).agg(F.sum("p_retailprice").alias("v"))
    n = F.substring("p_brand", 7, 3).cast("int")
    now = p.select("p_brand", "bin", (F.col("bin") * 1.0).alias("hz"), F.when(n % 2 == 0, F.col("v")).alias("thd"))
    old = p.select("p_brand", "bin", (F.col("bin") + F.when(n % 3 == 0, 0.5).otherwise(0.001)).alias("hz"), (F.col("v") * 2).alias("thd"))
    return rounded(curves.backfilled(now, old, ["p_brand"], "hz", ["thd"]), "thd", digits=2)


def octave_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("hz")).agg(F.avg("p_retailprice").alias("db"))
    return rounded(curves.octave_smoothed(p, ["p_brand"], "hz", "db", 0.9), "db", "smoothed", digits=4)


def take_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes and ids that stay with a take wherever it goes."""
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment", "c_nationkey"), 256).alias("identity"), F.length(identity.take_id(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey"))).alias("id_length"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" "), "source", F.lit("/"), "lang", F.lit(" #1. ")).alias("n"))
    return d.select("doc_id", identity.safe_name(F.col("n")).alias("safe"), identity.safe_ascii_name(F.col("n")).alias("ascii"), identity.portable_name(F.col("n")).alias("portable"))


def nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as one nested document, read back."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderstatus", "o_totalprice").alias("o"))
    doc = o.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list("o"))).alias("doc"))
    back = doc.select("o_custkey", F.explode(F.from_json("doc", "array<struct<o_orderkey: bigint, o_orderstatus: string, o_totalprice: double>>")).alias("o"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return back.join(c, "o_custkey").select("c_name", "o.*")


def progress_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do next in each customer's batch of orders: the first that is open, a move, or saving."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3).alias("position"), F.col("o_orderstatus").alias("s"))
    g = o.groupBy("o_custkey").agg(
        F.count("*").alias("rows"), F.min(F.when(F.col("s") != "F", F.col("position"))).alias("position"), F.min(F.when(F.col("s") == "O", F.struct("position", "o_orderkey"))).alias("next"), F.bool_or(F.col("s") == "P").alias("review")
    )
    action = F.when(F.col("review"), "hold").when(F.col("next").isNotNull(), "start_channel").when(F.col("position").isNull(), "save").otherwise("prompt_move")
    return g.select("o_custkey", "rows", F.coalesce("position", F.lit(3)).alias("position"), F.coalesce(F.col("next.o_orderkey"), F.lit(-1)).alias("next_order"), action.alias("action"))


SQL = {
    "combine_repeats": _M + """, u AS (SELECT *, distance_m <= 45 AS ok FROM m), c AS (SELECT session, source, microphone, count(*) AS repeats, count(*) FILTER (ok) AS usable,
  median(distance_m) FILTER (ok) AS d, median(sigma_m) FILTER (ok) AS s, (max(distance_m) FILTER (ok) - min(distance_m) FILTER (ok)) / 2 AS h, min(confidence_db) FILTER (ok) AS k FROM u GROUP BY ALL),
b AS (SELECT session, source, microphone, first(band ORDER BY n DESC, band) AS band FROM (SELECT session, source, microphone, band, count(*) AS n FROM u WHERE ok GROUP BY ALL) GROUP BY ALL),
r AS (SELECT session, source, microphone, first(reason ORDER BY n DESC, reason) AS reason FROM (SELECT session, source, microphone, reason, count(*) AS n FROM u WHERE NOT ok GROUP BY ALL) GROUP BY ALL)
SELECT session, source, microphone, repeats, usable, round(d, 6) AS distance_m, round(CASE WHEN usable = 1 THEN s WHEN s IS NOT NULL THEN sqrt(s * s + h * h) WHEN h > 0 THEN h END, 6) AS sigma_m,
  round(k, 6) AS confidence_db, band, CASE WHEN usable = 0 THEN reason END AS reason FROM c LEFT JOIN b USING (session, source, microphone) LEFT JOIN r USING (session, source, microphone)""",
    "pooled_upper_median": _M + "SELECT microphone, list_sort(list(distance_m))[count(*) // 2 + 1] AS upper, (max(distance_m) - min(distance_m)) / 2 AS half_spread, round(max(sigma_m) - min(sigma_m), 6) AS scatter FROM m GROUP BY microphone",
    "top_group": _M + ", g AS (SELECT session, source, repeat, count(*) AS takes FROM m GROUP BY ALL) SELECT session, source, repeat, takes FROM g QUALIFY row_number() OVER (PARTITION BY session, source ORDER BY takes DESC, repeat) = 1",
    "two_largest": _M + ", g AS (SELECT session, source, microphone, max(confidence_db) AS b FROM m GROUP BY ALL) SELECT session, source, round(list_sum(list_sort(list(b), 'DESC')[1:2]), 4) AS timing_bound FROM g GROUP BY session, source",
    "loopback_stability": _M + """, w AS (SELECT session, count(DISTINCT repeat) AS n FROM m GROUP BY session), e AS (SELECT session, microphone, count(DISTINCT repeat) AS repeats, max(distance_m) - min(distance_m) AS scatter FROM m GROUP BY ALL)
SELECT session, microphone, repeats, round(scatter, 6) AS scatter, repeats < 2 OR scatter <= 40 AS stable FROM e JOIN w USING (session) WHERE repeats = n QUALIFY row_number() OVER (PARTITION BY session ORDER BY microphone) = 1""",
    "reference_summary": """WITH o AS (SELECT o_custkey AS session, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS r FROM orders)
SELECT session, count(*) AS takes, count(r) AS identified, count(DISTINCT r) AS "references", count(DISTINCT r) = 1 AND count(r) = count(*) AS shared FROM o GROUP BY session""",
    "emitter_anchor": _M + ", e AS (SELECT session, microphone, abs(distance_m - microphone * 5.0) AS error FROM m) SELECT session, microphone, error, error > 44.5 AS warn FROM e QUALIFY row_number() OVER (PARTITION BY session ORDER BY error DESC, microphone DESC) = 1",
    "range_summary": _M + """SELECT session, count(*) FILTER (distance_m <= 45) AS ranged, count(*) AS total, min(distance_m) FILTER (distance_m <= 45) AS nearest, max(distance_m) FILTER (distance_m <= 45) AS furthest,
  coalesce(string_agg(DISTINCT reason, ', ' ORDER BY reason) FILTER (distance_m > 45), '') AS reasons FROM m GROUP BY session""",
    "skew_warnings": """WITH s AS (SELECT s_nationkey AS session, s_suppkey AS take, s_acctbal / 50 - 90 AS ppm FROM supplier)
SELECT session, CAST(take AS VARCHAR) AS take, 'severe_skew' AS kind, round(ppm, 6) AS value FROM s WHERE abs(ppm) > 100
UNION ALL SELECT session, NULL, 'skew_spread', round(max(ppm) - min(ppm), 6) FROM s GROUP BY session HAVING count(*) >= 2 AND max(ppm) - min(ppm) > 100""",
    "probe_align": """WITH c AS (SELECT event_type, min(event_id) AS arrival, max(value) AS peak, median(value) AS noise FROM events GROUP BY event_type)
SELECT event_type, arrival, arrival - min(arrival) OVER () AS relative, max(arrival) OVER () - arrival AS delay, round(20 * log10(peak), 6) AS gain_db, round(20 * log10(peak / noise), 6) AS snr_db FROM c""",
    "drift_roll_up": """WITH t AS (SELECT l_suppkey AS microphone, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS take, l_extendedprice / 40 - 100 AS ppm, l_discount * 10 AS c FROM lineitem),
a AS (SELECT *, CASE WHEN c < 0.2 THEN 0 WHEN abs(ppm) > 2000 THEN 3 WHEN abs(ppm) > 100 THEN 2 WHEN abs(ppm) > 20 THEN 1 ELSE 0 END AS s FROM t),
g AS (SELECT microphone, take, min(ppm) AS ppm, max(s) AS s FROM a GROUP BY ALL)
SELECT microphone, round(first(ppm ORDER BY take) FILTER (s > 0), 6) AS drift_ppm, bool_or(s BETWEEN 1 AND 2) AS corrected, CAST(max(s) AS INTEGER) AS worst FROM g GROUP BY microphone""",
    "range_sigmas": """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, (8000 - l_quantity * 200) / sqrt(12) AS w, l_extendedprice / 4000 AS c, (l_quantity * 100 - 72) * 343 / 48000 - 0.002 AS d FROM lineitem),
s AS (SELECT *, CASE WHEN w > 0 THEN greatest(48000 / (2 * pi() * w * sqrt(2 * pow(10, c / 10))), 0.1) END AS s FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, round(s, 6) AS sigma_samples, round(d, 6) AS distance_m, round(343 * s / 48000 + d * 3 / 343 + 0.002, 6) AS sigma_m FROM s""",
    "completeness": "SELECT r_regionkey, n_nationkey FROM region, (SELECT n_nationkey FROM nation) EXCEPT SELECT n_regionkey, n_nationkey FROM nation",
    "orphan_takes": "SELECT l_partkey, count(*) AS lines FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0) GROUP BY l_partkey",
    "repeated_takes": 'SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem GROUP BY ALL HAVING count(*) > 1',
    "calibration_fallback": """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN nullif(o_orderpriority, '') END, CASE WHEN c_custkey % 9 = 4 THEN CASE WHEN c_acctbal > 0 THEN NULL ELSE 'other' END
  WHEN c_acctbal > 0 THEN nullif(c_mktsegment, '') END, 'flat') AS calibration FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "take_calibrations": """SELECT l_orderkey, l_linenumber, l_suppkey AS microphone_id, CASE WHEN l_suppkey % 7 <> 3 AND l_suppkey % 11 <> 4 THEN s_acctbal END AS gain,
  CASE WHEN s_suppkey IS NULL OR l_suppkey % 7 = 3 THEN 'calibration_missing' WHEN l_suppkey % 11 = 4 THEN 'calibration_repeated' END AS issue FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey""",
    "interval_route": """SELECT CASE WHEN event_id < 500 THEN 'left' WHEN event_id >= 1000 AND event_id < 2500 THEN 'right' WHEN event_id = 4000 THEN 'sub' ELSE event_type END AS channel, count(*) AS frames FROM events GROUP BY 1""",
    "region_check": """WITH r AS (SELECT l_orderkey, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INTEGER) - 3 AS b FROM lineitem),
w AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM r) SELECT l_orderkey, count(*) AS bad FROM w WHERE a >= b OR a < e GROUP BY l_orderkey""",
    "rate_semi_join": "SELECT p_partkey, p_retailprice FROM part WHERE EXISTS (SELECT 1 FROM (VALUES (900.0, 950.0), (940.0, 960.5), (1040.0, 1041.0)) b(lo, hi) WHERE p_retailprice BETWEEN lo AND hi)",
    "upsert": """WITH n AS (SELECT c_nationkey, c_mktsegment, max(c_acctbal) AS value FROM customer WHERE c_acctbal > 5000 GROUP BY ALL), o AS (SELECT c_nationkey, c_mktsegment, min(c_acctbal) AS value FROM customer GROUP BY ALL)
SELECT * FROM n UNION ALL SELECT * FROM o ANTI JOIN n USING (c_nationkey, c_mktsegment)""",
    "source_identity": "SELECT s_suppkey, s_nationkey, s_name AS speaker, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS INTEGER) AS measurement_index FROM supplier",
    "role_map": """SELECT source, doc_id, CAST(CASE WHEN n_chars > 4000 THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END AS INTEGER) AS priority FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN n_chars > 4000 THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END, doc_id) = 1""",
    "hash_inventory": """WITH d AS (SELECT lower(lang || '-' || n_chars) AS name, CAST(strlen(text) AS INTEGER) AS b, sha256(text) AS h FROM documents)
SELECT name, count(*) AS copies, count(DISTINCT h) AS contents, min(b) AS bytes, min(h) AS sha256, count(DISTINCT h) > 1 AS conflict FROM d GROUP BY name""",
    "device_merge": """WITH r AS (SELECT p_brand, unnest([p_size * 100, p_size % 7 * 100]) AS r FROM part), l AS (SELECT p_brand, string_agg(DISTINCT CAST(r AS VARCHAR), ',' ORDER BY r) AS rates FROM (SELECT DISTINCT * FROM r) GROUP BY p_brand),
l2 AS (SELECT p_brand, array_to_string(list_sort(list(DISTINCT r)), ',') AS rates FROM r GROUP BY p_brand)
SELECT p_brand, first(p_name ORDER BY CASE WHEN p_partkey % 11 = 0 THEN 1000 ELSE 0 END + p_size DESC, p_name DESC) AS name, max(p_size) AS channels, any_value(l2.rates) AS rates, bool_or(p_partkey % 11 = 0) AS is_default
FROM part JOIN l2 USING (p_brand) GROUP BY p_brand""",
    "short_names": "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY upper(p_type)) > 1 THEN p_name ELSE p_type || ' (' || p_name || ')' END AS short_name FROM part",
    "name_listing": """WITH n AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS i FROM (SELECT DISTINCT s_nationkey, s_name FROM supplier))
SELECT s_nationkey, string_agg(s_name, ', ' ORDER BY s_name) FILTER (i <= 3) || CASE WHEN max(i) > 3 THEN ' ... and ' || (max(i) - 3) || ' more' ELSE '' END AS listing FROM n GROUP BY s_nationkey""",
    "device_lookup": """WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || CASE WHEN p_partkey < 5 THEN '' ELSE ' x' END AS name FROM part),
w AS (SELECT CAST(p_partkey AS VARCHAR) AS selector FROM part UNION ALL SELECT DISTINCT upper(p_name) FROM part UNION ALL SELECT 'none'),
n AS (SELECT selector, (SELECT count(*) FROM d WHERE id = selector) AS ids, (SELECT count(*) FROM d WHERE lower(name) = lower(selector)) AS names, (SELECT min(id) FROM d WHERE lower(name) = lower(selector)) AS by_name FROM w)
SELECT selector, CASE WHEN ids = 1 THEN selector WHEN names = 1 THEN by_name END AS device_id, CASE WHEN ids = 1 OR names = 1 THEN NULL WHEN names > 1 THEN 'ambiguous' ELSE 'not_found' END AS error FROM n""",
    "device_lookup_all": """WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || CASE WHEN p_partkey < 5 THEN '' ELSE ' x' END AS name FROM part),
w AS (SELECT CAST(p_partkey AS VARCHAR) AS selector FROM part WHERE p_partkey % 50 = 0 UNION ALL (SELECT upper(p_name) FROM part UNION SELECT upper(name) FROM d) UNION ALL SELECT 'none'),
n AS (SELECT selector, (SELECT count(*) FROM d WHERE id = selector) AS ids, (SELECT count(*) FROM d WHERE lower(name) = lower(selector)) AS names, (SELECT min(id) FROM d WHERE lower(name) = lower(selector)) AS by_name FROM w)
SELECT selector, CASE WHEN ids = 1 THEN selector WHEN names = 1 THEN by_name END AS device_id, CASE WHEN ids = 1 OR names = 1 THEN NULL WHEN names > 1 THEN 'ambiguous' ELSE 'not_found' END AS error FROM n""",
    "recording_grid": """WITH s AS (SELECT n_nationkey AS speaker_index, CASE WHEN n_nationkey = 3 THEN 'LFE' ELSE n_name END AS speaker FROM nation), t AS (SELECT r_regionkey AS k FROM region)
SELECT p.k AS position, speaker_index, m.k AS microphone, speaker || ' (Pos ' || (p.k + 1) || ' / Mic ' || (m.k + 1) || ')' AS name, CASE WHEN lower(speaker) IN ('lfe', 'sub') THEN 10.0::DOUBLE ELSE 20 END AS start_hz,
  CASE WHEN lower(speaker) IN ('lfe', 'sub') THEN 500.0::DOUBLE ELSE 20000 END AS end_hz FROM t p, s, t m""",
    "log_interpolation": """WITH p AS (SELECT p_brand, p_size::DOUBLE AS f, avg(p_retailprice) AS v FROM part GROUP BY ALL), t AS (SELECT DISTINCT p_brand, hz FROM p, (VALUES (0.5::DOUBLE), (1), (2.5), (10), (17.3), (33.3), (49), (80)) g(hz)),
b AS (SELECT t.p_brand, hz, (SELECT max(f) FROM p WHERE p.p_brand = t.p_brand AND f <= hz) AS lo, (SELECT min(f) FROM p WHERE p.p_brand = t.p_brand AND f >= hz) AS hi FROM t)
SELECT b.p_brand, hz, round(CASE WHEN lo IS NULL THEN h.v WHEN hi IS NULL OR lo = hz THEN l.v ELSE l.v + (h.v - l.v) * ln(hz / lo) / ln(hi / lo) END, 4) AS db
FROM b LEFT JOIN p l ON l.p_brand = b.p_brand AND l.f = lo LEFT JOIN p h ON h.p_brand = b.p_brand AND h.f = hi""",
    "gated_argmax": """WITH c AS (SELECT p_brand, p_size * 300.0::DOUBLE AS hz, CAST(p_partkey % 97 AS DOUBLE) AS thd, p_retailprice / 40 AS level FROM part), b AS (SELECT *, max(level) OVER (PARTITION BY p_brand) AS top FROM c WHERE hz BETWEEN 80 AND 12000)
SELECT p_brand, hz, thd FROM b WHERE level >= top - 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY thd DESC, hz DESC) = 1""",
    "low_level": "SELECT p_brand, round(avg(p_retailprice / -18.0), 6) AS average_db FROM part WHERE p_size * 300 BETWEEN 20 AND 9000 AND p_retailprice / -18.0 > -150 GROUP BY p_brand HAVING avg(p_retailprice / -18.0) < -50",
    "backfill": """WITH p AS (SELECT p_brand, p_size AS bin, sum(p_retailprice) AS v, CAST(substr(p_brand, 7, 3) AS INTEGER) AS n FROM part GROUP BY ALL)
SELECT p_brand, bin, bin * 1.0::DOUBLE AS hz, round(CASE WHEN n % 2 = 0 THEN v WHEN n % 3 <> 0 THEN v * 2 END, 2) AS thd FROM p""",
    "octave_smoothing": """WITH p AS (SELECT p_brand, p_size::DOUBLE AS hz, avg(p_retailprice) AS db FROM part GROUP BY ALL)
SELECT p_brand, hz, round(db, 4) AS db, round((SELECT avg(q.db) FROM p q WHERE q.p_brand = p.p_brand AND log2(q.hz) BETWEEN log2(p.hz) - 0.45 AND log2(p.hz) + 0.45), 4) AS smoothed FROM p""",
    "take_ids": "SELECT c_custkey, sha256(c_name || '|' || c_mktsegment || '|' || c_nationkey) AS identity, CAST(74 AS INTEGER) AS id_length FROM customer",
    "safe_names": """SELECT doc_id, regexp_replace(trim(' ' || source || '/' || lang || ' #1. '), '[^A-Za-z0-9_-]', '_', 'g') AS safe,
  regexp_replace(' ' || source || '/' || lang || ' #1. ', '[^A-Za-z0-9_.-]', '_', 'g') AS ascii, false AS portable FROM documents""",
    "nested_report": "SELECT c_name, o_orderkey, o_orderstatus, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey",
    "progress_state": """WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS p, o_orderstatus AS s FROM orders), g AS (SELECT o_custkey, count(*) AS "rows", min(p) FILTER (s <> 'F') AS p, first(o_orderkey ORDER BY p, o_orderkey) FILTER (s = 'O') AS n, bool_or(s = 'P') AS r FROM o GROUP BY o_custkey)
SELECT o_custkey, "rows", coalesce(p, 3) AS position, coalesce(n, -1) AS next_order, CASE WHEN r THEN 'hold' WHEN n IS NOT NULL THEN 'start_channel' WHEN p IS NULL THEN 'save' ELSE 'prompt_move' END AS action FROM g""",
}

QUERIES = [
    combine_repeats, pooled_upper_median, top_group, two_largest, loopback_stability, reference_summary, emitter_anchor, range_summary, skew_warnings,
    probe_align, drift_roll_up, range_sigmas, completeness, orphan_takes, repeated_takes, calibration_fallback, take_calibrations, interval_route, region_check,
    rate_semi_join, upsert, source_identity, role_map, hash_inventory, device_merge, short_names, name_listing, device_lookup, device_lookup_all, recording_grid,
    log_interpolation, gated_argmax, low_level, backfill, octave_smoothing, take_ids, safe_names, nested_report, progress_state,
]
