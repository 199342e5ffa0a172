"""What a session's state is written as: settings of an acquisition, configurations, declared responses, rows of a journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.acoustics import is_finite
from tonelake.functions.identity import portable_name
from tonelake.operators.catalogue import identities

#: Rates that a phone's or a TV's routes have, and the one to take otherwise.
NATIVE_RATES = (44100, 48000)
DEFAULT_RATE = 48000
#: The order of a sequence nobody chose, and signals of a length of their own or without parameters.
MLS_ORDER = 16
NOISES = ("white_noise", "pink_noise", "m_noise")
#: What callbacks are tried with.
FORMATS = ("f32", "f64", "i8", "i16", "i24", "i32", "i64", "u8", "u16", "u24", "u32", "u64")
WIDTHS = (2, 8, 33, 94)
BLOCKS = (32, 128, 512, 1024)


def signal_parameters(kind: Column, lo: Column, hi: Column, amp: Column, bass: Column, before: Column, after: Column) -> Column:
    """What a signal of a kind is made with; a kind without parameters of its own is a sweep, its times put into their bounds."""
    sweep = ~kind.isin(*NOISES, "mls", "dirac")
    clamped = F.least(F.greatest(bass, F.lit(1.0)), F.lit(10.0))
    return F.struct(
        F.when(kind.isin(*NOISES), "noise").when(kind == "mls", "mls").when(kind == "dirac", "dirac").otherwise("sweep").alias("shape"), amp.alias("amp"),
        F.when(kind == "mls", MLS_ORDER).alias("order"), F.when(sweep, lo).alias("start_hz"), F.when(sweep, hi).alias("end_hz"), F.when(sweep, clamped).alias("bass_octave_s"),
        F.when(sweep, F.greatest(before, F.lit(0.0))).alias("pre_silence_s"), F.when(sweep, F.greatest(after, F.lit(0.0))).alias("post_silence_s"),
    )


def _octaves(lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, F.log2(hi / lo)).otherwise(0.0)


def acquisition(p: Column, seconds: Column, rate: Column) -> Column:
    """Frames, seconds and level of what is played for parameters ``p`` of `signal_parameters`, or what is wrong with them.

    A sweep that gives the bass more time, and a sequence, have a length of
    their own; a quarter second is played on either side.
    """
    own = p["shape"].isin("sweep", "mls")
    lo = F.greatest(p["start_hz"], F.lit(1.0))
    hi = F.greatest(p["end_hz"], lo * 1.001)
    zones = _octaves(lo, F.least(F.lit(100.0), hi)) + 0.5 * _octaves(F.greatest(F.lit(100.0), lo), F.least(F.lit(1000.0), hi)) + 0.25 * _octaves(F.greatest(F.lit(1000.0), lo), hi)
    sweep = F.round(F.greatest(zones * p["bass_octave_s"], F.lit(1.0)) * rate) + F.round(p["pre_silence_s"] * rate) + F.round(p["post_silence_s"] * rate)
    frames = F.when(p["shape"] == "sweep", sweep).when(p["shape"] == "mls", F.pow(F.lit(2.0), p["order"]) - 1).otherwise(F.round(seconds * rate)).cast("long")
    padding = 2 * F.floor(rate / 4)
    sound = F.when(p["shape"] == "sweep", is_finite(p["start_hz"]) & is_finite(p["end_hz"]) & is_finite(p["amp"])).otherwise(is_finite(p["amp"]))
    issue = (
        F.when(rate.isNull() | (rate <= 0), "rate")
        .when(~is_finite(seconds) | ((seconds <= 0) & (p["shape"] != "mls")), "duration")
        .when(~sound, "parameters")
        .when((p["shape"] == "mls") & ~p["order"].between(2, 24), "order")
        .when((p["shape"] == "sweep") & ((p["start_hz"] <= 0) | (p["end_hz"] <= p["start_hz"]) | (p["end_hz"] > rate / 2)), "band")
    )
    good = issue.isNull()
    return F.struct(
        F.when(good, ~own).alias("duration_applies"), F.when(good, frames).alias("generated_frames"), F.when(good, frames / rate).alias("generated_s"),
        F.when(good, padding).alias("padding_frames"), F.when(good, frames + padding).alias("playback_frames"), F.when(good, (frames + padding) / rate).alias("playback_s"),
        F.when(good & (p["amp"] > 0), 20 * F.log10(p["amp"])).alias("level_dbfs"), issue.alias("issue"),
    )


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def configuration(w: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): a wizard's state as the configuration that is saved.

    ``w`` has playback and recording (struct of device, id, rate, channels), group_names, calibration, calibrations,
    directory, kind, duration_s, level_db, start_hz, end_hz, bass_octave_s, pre_silence_s, post_silence_s, description,
    probe_path, anchor_path, sweeps, positions. What is empty is left out, and so are times of a sweep for other signals.
    """
    sweep = F.col("kind") == "sweep"
    last = lambda path: F.element_at(F.split(path, r"[/\\]"), -1)
    side = lambda s: [F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in ("device", "id", "rate", "channels")]
    return w.select(
        *keys,
        F.struct(
            *side("playback"), F.col("group_names").alias("channel_names"), *side("recording"), _filled(F.col("calibration")).alias("calibration"),
            F.when(F.size("calibrations") > 0, F.col("calibrations")).alias("calibrations"), _filled(F.col("directory")).alias("directory"), F.col("kind").alias("signal_type"),
            "duration_s", "level_db", "start_hz", "end_hz", _filled(F.col("description")).alias("description"), last(F.col("probe_path")).alias("probe_file"),
            last(F.col("anchor_path")).alias("anchor_file"), F.when(sweep, F.least(F.greatest("bass_octave_s", F.lit(1.0)), F.lit(10.0))).alias("bass_octave_s"),
            F.when(sweep, F.greatest("pre_silence_s", F.lit(0.0))).alias("pre_silence_s"), F.when(sweep & F.col("post_silence_s").isNotNull(), F.greatest("post_silence_s", F.lit(0.0))).alias("post_silence_s"),
            F.col("sweeps").alias("num_sweeps"), F.when(F.col("positions") > 1, F.col("positions")).alias("num_positions"),
        ).alias("document"),
    )


def measured_responses(sources: DataFrame, microphones: DataFrame, takes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(session, source_id, path, rate, reference_id, issue): the response that stands for each source.

    ``chosen`` (session, microphone_id) names the microphone, else it is the
    first of the plan by ``ordinal``. A source whose take has no response is
    left out; a microphone that the plan has not, a source without its take and
    a name that is no plain file name are issues. ``takes`` has one row for
    each selected take.
    """
    first = microphones.groupBy("session").agg(F.min_by("microphone_id", "ordinal").alias("_f"), F.collect_set("microphone_id").alias("_all"))  # 16 at most
    named = chosen.groupBy("session").agg(F.min("microphone_id").alias("_c"))
    of = first.join(named, "session", "left").withColumn("microphone_id", F.coalesce("_c", "_f"))
    rows = sources.join(of, "session", "left").join(takes.withColumn("_take", F.lit(True)), ["session", "source_id", "microphone_id"], "left")
    issue = (
        F.when(F.col("microphone_id").isNull(), "no_microphones")
        .when(~F.array_contains("_all", F.col("microphone_id")), "unknown_microphone")
        .when(F.col("_take").isNull(), "take_missing")
        .when(~portable_name(F.col("impulse_file")), "file_name")
    )
    found = rows.withColumn("issue", issue).where("issue is not null or impulse_file is not null")
    return found.select("session", "source_id", *[F.when(F.col("issue").isNull(), F.col(c)).alias(n) for c, n in (("impulse_file", "path"), ("rate", "rate"), ("reference_id", "reference_id"))], "issue")


def projected(rows: Column, fields: list[str]) -> Column:
    """An array of structs with these of their fields only, as older readers of results have them."""
    return F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in fields]))


def joint_row(point: Column, mirrored: Column) -> Column:
    """A point of a joint solution as a row of the report; without one it is refused. What a joint solution has not is null."""
    null = lambda kind: F.lit(None).cast(kind)
    there = point.isNotNull()
    return F.struct(
        point["position_m"].alias("position_m"), point["sigma_m"].alias("sigma_m"), point["rms_residual_m"].alias("rms_residual_m"), null("double").alias("gdop"),
        F.when(there, mirrored).otherwise(False).alias("mirror_ambiguous"), null("double").alias("declared_error_m"), null("double").alias("loo_max_residual_m"),
        null("string").alias("loo_worst"), null("double").alias("loo_max_shift_m"), F.when(~there, "solve_failed").alias("reason"),
    )


def source_entries(recordings: DataFrame, channel: str, order: list[str], name: Column, *evidence: str) -> DataFrame:
    """(channel, speaker, measurement_index, evidence): a row for each source whose evidence is there; its number counts all recordings."""
    rows = identities(recordings, channel, order, name)
    return rows.where(F.coalesce(*[F.when(F.col(e).isNotNull(), True) for e in evidence])).select(channel, "speaker", "measurement_index", *evidence)


def entry_for(entries: DataFrame, wanted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) for each wanted identity, null where there is no entry; of repeated entries the least counts."""
    return wanted.select(*keys).join(entries.groupBy(*keys).agg(F.min(value).alias(value)), keys, "left")


def interface_channels(mappings: Column) -> Column:
    """How many channels of an interface mappings (structs with an array ``outputs``) take."""
    return F.coalesce(F.aggregate(mappings, F.lit(0), lambda s, m: s + F.coalesce(F.array_size(m["outputs"]), F.lit(0))), F.lit(0))


def busy(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, busy): whether a capture, probe, anchor or level calibration is running."""
    running = F.col("state").isin("running", "recording")
    return states.groupBy(*keys).agg(F.coalesce(F.bool_or(running), F.lit(False)).alias("busy"))


def raw_take_file(file: Column, take: Column) -> Column:
    """Name of a repeat's own recording: ``L.wav`` of take 1 (from 0) is ``L.take2.wav``."""
    return F.concat(F.regexp_replace(file, r"\.[^.]*$", ""), F.lit(".take"), (take + 1).cast("string"), F.lit(".wav"))


def stale_takes(files: DataFrame, recordings: DataFrame) -> DataFrame:
    """(folder, name) of files that earlier repeats of these recordings left: their name, ``.take``, a number, ``.wav`` and nothing else."""
    stem = F.regexp_extract("name", r"^(.*)\.take[0-9]+\.wav$", 1)
    own = recordings.select("folder", F.regexp_replace("name", r"\.[^.]*$", "").alias("_stem")).distinct()
    return files.withColumn("_stem", stem).where(F.col("name").rlike(r"\.take[0-9]+\.wav$")).join(own, ["folder", "_stem"], "left_semi").select("folder", "name")


def with_channel(channels: DataFrame, more: DataFrame) -> DataFrame:
    """A session's channel rows and more of them, columns by name; what one side has not is null."""
    return channels.unionByName(more, allowMissingColumns=True)


def session_issue(channels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, issue) of loaded sessions whose files are not to be touched, the first of: too many channels, a path that
    leaves the folder, an output that is no .csv or is there twice, an output that is an input."""
    inside = lambda c: ~F.col(c).rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|^\s*$")
    good = F.coalesce(F.col("success"), F.lit(False))
    each = channels.groupBy(*keys).agg(
        F.count("*").alias("n"), F.bool_and(F.when(good, F.coalesce(inside("wav_path") & inside("csv_path"), F.lit(False)))).alias("inside"),
        F.bool_and(F.when(good, F.coalesce(F.col("csv_path").endswith(".csv"), F.lit(False)))).alias("csv"),
    )
    done = channels.where(good)
    use = done.select(*keys, F.col("csv_path").alias("_p"), F.lit(1).alias("_o"), F.lit(0).alias("_i")).unionByName(done.select(*keys, F.col("wav_path").alias("_p"), F.lit(0).alias("_o"), F.lit(1).alias("_i")))
    used = use.groupBy(*keys, "_p").agg(F.sum("_o").alias("_o"), F.sum("_i").alias("_i")).groupBy(*keys).agg(F.max("_o").alias("_most"), F.bool_or((F.col("_o") > 0) & (F.col("_i") > 0)).alias("_both"))
    issue = F.when(F.col("n") > 64, "channels").when(~F.col("inside"), "path").when(~F.col("csv") | (F.col("_most") > 1), "output").when(F.col("_both"), "output_is_input")
    return each.join(used, keys, "left").select(*keys, issue.alias("issue"))


def callback_cases(spark: SparkSession) -> DataFrame:
    """(format, channels, frames, finite): every case that a device's callback is tried with, 224 in all."""
    kinds = [(f, True) for f in FORMATS] + [(f, False) for f in FORMATS[:2]]
    rows = spark.createDataFrame(kinds, "format string, finite boolean")
    widths, blocks = F.array(*[F.lit(w) for w in WIDTHS]), F.array(*[F.lit(b) for b in BLOCKS])
    return rows.select("format", "finite", F.explode(widths).alias("channels")).select("format", "channels", F.explode(blocks).alias("frames"), "finite")


def native_rate(requested: Column) -> Column:
    """The rate to record at on a route that has few: the wanted one, or else the default."""
    return F.when(requested.isin(*NATIVE_RATES), requested).otherwise(DEFAULT_RATE)


def route_issue(route: Column, channels: Column) -> Column:
    """What is wrong with a number of channels on a route: one input of a built-in microphone, eight outputs over HDMI."""
    most = F.when(route == "builtin_input", 1).when(route == "hdmi_output", 8)
    return F.when(channels.isNull() | (channels < 1) | (channels > most), F.concat(route, F.lit(" supports "), most.cast("string"), F.lit(" channels, got "), F.coalesce(channels.cast("string"), F.lit("none"))))


def instant_text(at: Column) -> Column:
    """A time as RFC 3339 has it, in UTC; the session's zone is to be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
