"""Files written by tasks and read back: recordings, journals, reports of losses, events, spooled frames, sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.queries.plans import live_events, stream_folder
from tonelake.queries.stand_ins import read, rounded
from tonelake.sources import recordings, sinks


def recordings_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, fifty to a recording, written as recordings, checked, and read back as blocks."""
    folder, i = f"{stream_folder(spark)}/recordings", F.col("vec_id")
    takes = read(spark, sf_dir, "embeddings").select(F.format_string("take-%05d.wav", F.floor(i / 50)).alias("name"), F.lit(0).alias("channel"), (i % 50).cast("int").alias("block"), F.col("embedding").alias("samples"))
    sinks.save_recordings(takes, "name", 48000, folder)
    back = recordings.recordings(spark, folder, rate=48000, channels=1)
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double"))
    found = back.groupBy(F.element_at(F.split("path", "/"), -1).alias("file")).agg(
        F.max("rate").alias("rate"), F.max("frames").alias("frames"), F.count("*").alias("blocks"), F.sum(total).alias("total"), F.count("error").alias("errors")
    )
    return rounded(found, "total", digits=4)


def journals_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal for each supplier, with the reports of losses that its lines give, written and read back."""
    folder = f"{stream_folder(spark)}/journals"
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session"), F.col("s_name").alias("rig"), F.col("s_nationkey").alias("takes"))
    lost = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), F.concat(F.lit("capture-loss-"), "l_linenumber", F.lit(".json")).alias("file")).distinct().withColumn("sha256", F.sha2("file", 256))
    sinks.save_files(sinks.journal_files(s, "session", lost), folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    parsed = files.select(F.from_json(F.decode("content", "UTF-8"), "session long, rig string, takes int, capture_loss array<struct<file: string, sha256: string>>").alias("j"))
    last = F.try_element_at("j.capture_loss", F.lit(-1))
    return parsed.select("j.session", "j.rig", "j.takes", F.size("j.capture_loss").alias("losses"), last["file"].alias("last_file"), last["sha256"].alias("last_sha256"))


def losses_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of losses of suppliers found again in their folder: those that are new, by what is wrong with them."""
    folder, k = f"{stream_folder(spark)}/losses", F.col("s_suppkey")
    gap = F.struct(F.lit(10).cast("long").alias("start_frame"), (k + 11).cast("long").alias("end_frame"))
    missing = (k + 1 + F.when(k % 5 == 0, 1).otherwise(0)).cast("long")
    continuity = F.struct(F.lit(1 << 40).alias("observed_frames"), missing.alias("missing_frames_per_channel"), F.lit(0).cast("long").alias("omitted_intervals"), F.array(gap).alias("intervals"))
    route = F.struct(F.lit(0).cast("long").alias("input_index"), F.lit(0).alias("hardware_channel"))
    one = F.struct(F.when(k % 7 == 0, "").otherwise(F.col("s_name")).alias("device_id"), F.array(route).alias("routes"), continuity.alias("continuity"))
    reports = read(spark, sf_dir, "supplier").select(k, F.struct(F.when(k % 17 == 3, 2).otherwise(1).alias("version"), F.concat(F.lit("lost "), k).alias("error"), F.array(one).alias("inputs")).alias("report"))
    sinks.save_files(sinks.loss_files(reports, "report"), folder)
    named = lambda rows: sinks.loss_files(rows, "report").select(F.col("name").alias("file"))
    known = named(reports.where("s_suppkey % 3 = 0")).unionByName(named(reports.where("s_suppkey % 3 = 1 and s_suppkey % 11 = 2")).select(F.upper("file").alias("file")))
    found = sinks.discovered_losses(spark, folder, known)
    return found.groupBy(F.coalesce("issue", F.lit("sound")).alias("issue")).agg(F.count("*").alias("reports"))


def events_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSON, written and read back."""
    folder = f"{stream_folder(spark)}/events"
    e = read(spark, sf_dir, "events").withColumn("level", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    sinks.event_lines(e, "event_type", "level", "user_id").write.text(folder)
    back = spark.read.schema("event string, level double, user_id long").json(folder)
    return rounded(back.groupBy("event").agg(F.count("*").alias("lines"), F.count("level").alias("levels"), F.sum("level").alias("level")), "level", digits=3)


def events_spooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, spooled to files until none are left."""
    folder = stream_folder(spark)
    sinks.spool(live_events(spark, sf_dir).select("event_type", "event_id"), f"{folder}/spool", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/spool").groupBy("event_type").agg(F.count("*").alias("frames"), F.max("event_id").alias("last"))


def evidence_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of lines stored beside their suppliers' sessions, some of which have changed since or have two entries for a source."""
    k = F.col("s_suppkey")
    sessions = read(spark, sf_dir, "supplier").select(k.alias("session"), F.sha2("s_name", 256).alias("sha256"), F.when(k % 9 == 4, "other").otherwise(F.sha2("s_name", 256)).alias("seen_sha256"), (k * 1000).alias("modified"))
    l = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_linenumber").alias("speaker"), F.col("l_returnflag").alias("flag"))  # noqa: E741
    entries = l.groupBy("session", "speaker").agg(F.min("flag").alias("flag"))
    entries = entries.unionByName(entries.where("session % 13 = 5 and speaker = 1"))
    stimuli = entries.where("speaker = 2").select("session", "speaker", F.lit("sweep").alias("kind"))
    found = sinks.sidecars(sessions, entries, stimuli.unionByName(stimuli.where("session % 19 = 6")), "session", ["speaker"])
    parsed = F.from_json("content", "version int, session_sha256 string, session_modified_ns long, entries array<struct<speaker: int, flag: string>>, stimuli array<struct<speaker: int, kind: string>>")
    rows = found.select("session", "issue", parsed.alias("c"))
    return rows.select("session", "issue", "c.session_sha256", "c.session_modified_ns", F.array_join(F.transform("c.entries", lambda e: F.concat(e["speaker"].cast("string"), e["flag"])), "").alias("entries"), F.size("c.stimuli").alias("stimuli"))


SQL = {
    "recordings_round_trip": """WITH e AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s FROM embeddings)
SELECT printf('take-%05d.wav', vec_id // 50) AS file, CAST(48000 AS INTEGER) AS rate, count(*) * 64 AS frames, CAST(ceil(count(*) * 64 / 2048) AS BIGINT) AS blocks, round(sum(s), 4) AS total, 0::BIGINT AS errors FROM e GROUP BY vec_id // 50""",
    "journals_round_trip": """WITH l AS (SELECT l_suppkey AS k, count(DISTINCT l_linenumber) AS n, max('capture-loss-' || l_linenumber || '.json') AS f FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey AS session, s_name AS rig, s_nationkey AS takes, CAST(coalesce(n, 0) AS INTEGER) AS losses, f AS last_file, sha256(f) AS last_sha256 FROM supplier LEFT JOIN l ON k = s_suppkey""",
    "losses_round_trip": """WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT CASE WHEN k % 3 = 1 AND k % 11 = 2 THEN 'case_collision' WHEN k % 17 = 3 THEN 'header' WHEN k % 7 = 0 THEN 'device_or_count' WHEN k % 5 = 0 THEN 'interval_sum' ELSE 'sound' END AS issue, count(*) AS reports FROM s GROUP BY 1""",
    "events_round_trip": "SELECT event_type AS event, count(*) AS lines, count(*) FILTER (event_id % 3 <> 0) AS levels, round(sum(value) FILTER (event_id % 3 <> 0), 3) AS level FROM events GROUP BY event_type",
    "events_spooled": "SELECT event_type, count(*) AS frames, max(event_id) AS last FROM events GROUP BY event_type",
    "evidence_sidecars": """WITH e AS (SELECT l_suppkey AS k, l_linenumber AS n, min(l_returnflag) AS f FROM lineitem GROUP BY ALL), g AS (SELECT k, string_agg(n || f, '' ORDER BY n) AS e, count(*) FILTER (n = 2) AS t, count(*) FILTER (n = 1) AS one FROM e GROUP BY k),
s AS (SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 9 = 4 THEN 'changed' WHEN s_suppkey % 13 = 5 AND one > 0 THEN 'repeated_quality' WHEN s_suppkey % 19 = 6 AND t > 0 THEN 'repeated_stimulus' END AS issue, e, t FROM supplier LEFT JOIN g ON g.k = s_suppkey)
SELECT k AS session, issue, CASE WHEN issue IS NULL THEN sha256(s_name) END AS session_sha256, CASE WHEN issue IS NULL THEN k * 1000 END AS session_modified_ns, CASE WHEN issue IS NULL THEN e END AS entries,
  CAST(CASE WHEN issue IS NULL AND t > 0 THEN t END AS INTEGER) AS stimuli FROM s""",
}

QUERIES = [recordings_round_trip, journals_round_trip, losses_round_trip, events_round_trip, events_spooled, evidence_sidecars]
