"""Plans, localization, documents and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import acoustics, identity, levels
from tonelake.operators import catalogue
from tonelake.plans import localization, session
from tonelake.plans.positions import solvable
from tonelake.sources import bundles, documents
from tonelake.streaming import live

from .stand_ins import measurements, nearest, read, rounded


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt over tasks: a plan costs much more than its row shows, and by their size alone hundreds of thousands of rows fall to one task."""
    return read(spark, sf_dir, "customer").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session plan for each customer, some of them broken in one way or another."""
    c = _spread(spark, sf_dir)
    k = F.col("c_custkey") % 12
    none = F.lit(None)

    def mic(i: int):  # noqa: ANN202
        return F.struct(
            F.when((k == 1) & (F.lit(i) == 1), "m0").otherwise(F.lit(f"m{i}")).alias("id"), F.lit("card").alias("device"),
            F.when((k == 2) & (F.lit(i) == 1), 0).otherwise(F.lit(i)).alias("input_channel"), F.lit("cal.txt").alias("calibration_file"), F.lit("on_axis").alias("calibration_orientation"),
            F.lit(0.0).alias("gain_db"), F.array(F.lit(0.06 * i), F.lit(0.0), F.lit(1.1)).alias("position_m"),
            F.when(k == 3, none.cast("double")).when(k == 4, 2.5).otherwise(1.0).alias("position_uncertainty_mm"),
            F.when((F.col("c_custkey") % 25 == 1) & (F.lit(i) == 2), 0.5).alias("gain"),
        )

    source = F.struct(F.col("c_name").alias("id"), (F.col("c_nationkey") * F.when(k == 5, 9).otherwise(1)).cast("int").alias("output_channel"), none.cast("array<double>").alias("position_m"), none.cast("double").alias("position_uncertainty_mm"), F.when(k == 6, 200.0).alias("source_delay_calibration_ms"))
    plan = F.struct(
        F.when(k == 7, 2).otherwise(1).alias("version"), F.when(k == 4, "compact").otherwise("spread").alias("geometry"), F.lit(48000).alias("sample_rate_hz"),
        F.when(k == 8, " ").otherwise("main").alias("output_device"), F.array(mic(0), mic(1), mic(2)).alias("microphones"), F.array(source).alias("sources"),
        F.when(k == 9, 17).otherwise((F.col("c_custkey") % 3 + 1).cast("int")).alias("repeat_count"),
        F.struct((F.col("c_custkey") % 4 + 1.0).alias("duration_secs"), F.lit(20.0).alias("start_hz"), F.when(k == 10, 24000.0).otherwise(20000.0).alias("end_hz"), F.lit(0.1).alias("amplitude"), F.when(k == 11, F.lit(2.0).cast("float")).alias("bass_octave_duration_s"), F.when(F.col("c_custkey") % 25 == 2, 1).alias("fade")).alias("sweep"),
        F.when(F.col("c_custkey") % 49 == 3, "x").alias("extra"),
    )
    # through JSON and back, as a plan comes from a file
    return documents.strict_json(c.select("c_custkey", F.to_json(plan).alias("text")), "text", session.plan_schema(), "plan")


def plan_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plans(spark, sf_dir)
    return p.select("c_custkey", F.size("unknown_keys").alias("unknown"), session.first_issue(F.col("plan"), F.col("unknown_keys")).alias("issue"))


def plan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans with every optional part, most of them broken in one of these."""
    c = _spread(spark, sf_dir).withColumn("k", F.col("c_custkey") % 17)
    k, none = F.col("k"), F.lit(None)
    at = lambda n, bad, good: F.when(k == n, F.lit(bad)).otherwise(F.lit(good))
    mic = lambda i: F.struct(F.lit(f"m{i}").alias("id"), (at(10, "usb", "card") if i == 1 else F.lit("card")).alias("device"), F.lit(i).alias("input_channel"), F.lit("cal.txt").alias("calibration_file"), F.lit("on_axis").alias("calibration_orientation"), F.lit(0.0).alias("gain_db"))
    head = F.struct(F.lit("h").alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.2).alias("z"), F.lit(0.0).alias("yaw_deg"))
    place = F.array(F.lit(0.0), F.lit(-3.0), F.lit(1.1))
    plan = F.struct(
        F.lit(1).alias("version"), F.lit("spread").alias("geometry"), F.lit(48000).alias("sample_rate_hz"), F.lit("main").alias("output_device"), F.array(mic(0), mic(1), mic(2)).alias("microphones"),
        F.array(F.struct(F.col("c_name").alias("id"), F.lit(0).alias("output_channel"))).alias("sources"), F.lit(1).alias("repeat_count"),
        F.struct(at(12, 330.0, 2.0).alias("duration_secs"), F.lit(20.0).alias("start_hz"), F.lit(20000.0).alias("end_hz"), at(13, 1e-50, 0.1).alias("amplitude")).alias("sweep"),
        F.struct(at(1, 0.0, 500.0).alias("probe_duration_ms"), F.lit(500.0).alias("silence_duration_ms"), at(2, 3.0, -20.0).alias("signal_level_db")).alias("probe"),
        F.struct(at(4, 24000.0, 40.0).alias("bass_freq_hz"), at(3, 400.0, 2.0).alias("bass_duration_s"), at(5, 1100.0, 100.0).alias("fade_ms"), at(16, 0, 3).alias("num_windows"), F.lit(500.0).alias("silence_duration_ms"), F.lit(-20.0).alias("signal_level_db")).alias("bass_anchor"),
        F.when(k != 9, F.struct(at(7, "usb", "card").alias("device"), at(6, 1, 5).alias("input_channel"))).alias("loopback"),
        F.struct(at(8, "m1", "m0").alias("left_ear"), F.lit("m1").alias("right_ear"), head.alias("head_position")).alias("ctc"),
        F.struct(F.lit(9).alias("output_channel"), place.alias("position_m"), F.lit(2.0).alias("position_uncertainty_mm"), at(15, 200.0, 343.0).alias("sound_speed_m_s"), F.lit(0.5).alias("sound_speed_uncertainty_m_s")).alias("timing_reference"),
        F.struct(F.lit(343.0).alias("m_s"), at(14, 343.0, 0.5).alias("uncertainty_m_s")).alias("sound_speed"), at(11, "", "bench.json").alias("localization_calibration_file"),
    )
    read_back = documents.strict_json(c.select("c_custkey", F.to_json(plan).alias("text")), "text", session.plan_schema(), "plan")
    return read_back.select("c_custkey", F.size("unknown_keys").alias("unknown"), session.first_issue(F.col("plan"), F.col("unknown_keys")).alias("issue"))


def signal_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of signals as users write them, their types, what is wrong with their parameters, and advice about errors."""
    c = read(spark, sf_dir, "customer")
    names = ["Sweep", "TWO-TONE", "whitenoise", "pink_noise", "M-Noise", "maximum-length-sequence", "impulse", "sti-pa", "chirp", " tone", "tone", "mls"]
    errors = ["Permission denied", "stream not authorized", "device is in use", "exclusive mode", "No default input device", "no such device", "sample rate 7", "timed out"]
    pick = lambda x: F.element_at(F.array(*map(F.lit, x)), (F.col("c_custkey") % len(x) + 1).cast("int"))
    kind = identity.signal_type(pick(names))
    lo, hi, order = (F.col("c_custkey") % 5 * 6000).cast("double"), F.lit(20000.0), (F.col("c_custkey") % 30).cast("int")
    return c.select(
        "c_custkey", kind.alias("kind"), identity.capture_type(pick(names)).alias("plays"), session.signal_issue(kind, F.lit(48000.0), lo, hi, F.col("c_custkey") % 4 / 2, order).alias("issue"),
        identity.capture_advice(F.lit("capture"), pick(errors)).alias("advice"), session.live_issue(F.lit(48000), F.pow(F.lit(2), F.col("c_custkey") % 16).cast("int"), (F.col("c_custkey") % 7).cast("double") * 1000).alias("live"),
        identity.filename(F.lit("take"), F.coalesce(kind, F.lit("none")), F.col("c_nationkey"), F.col("c_custkey"), F.lit(48000)).alias("name"),
    )


def stimulus_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plans(spark, sf_dir)
    layout = session.stimulus_layout(F.col("plan.sample_rate_hz"), F.col("plan.sweep"))
    return p.select("c_custkey", layout.alias("l")).select("c_custkey", "l.chirp_frame", "l.sweep_frame", "l.end_chirp_frame", "l.frames")


def take_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes that plans ask for and orders do not hold, counted by session."""
    want = session.expected_takes(_plans(spark, sf_dir), "c_custkey", "plan")
    have = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("m"), F.col("o_orderkey") % 3).alias("microphone_id"), (F.col("o_orderkey") % 2).cast("int").alias("repeat_index"))
    return catalogue.missing_cells(want, have, ["c_custkey", "microphone_id", "repeat_index"]).groupBy("c_custkey").agg(F.count("*").alias("missing"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of order lines in groups of (session, source, repeat), each with a loopback."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("source_id"), F.col("l_linenumber").alias("repeat_index"), F.col("l_suppkey").alias("microphone_id"),
        (F.col("l_suppkey") % 4).alias("order"), F.lit(True).alias("taken"), F.when(F.col("l_quantity") > 2, F.col("l_quantity") * 100).alias("arrival"), F.lit(None).cast("string").alias("arrival_reason"),
        F.when(F.col("l_tax") > 0, 1 + F.col("l_tax") / 1000).alias("clock_ratio"), (F.col("l_discount") * 10).alias("sigma"), F.when(F.col("l_returnflag") != "A", F.col("l_discount") * 5000).alias("loopback_arrival"),
        F.lit(0.5).alias("loopback_sigma"), F.col("l_linestatus").alias("device"), F.lit("O").alias("loopback_device"), F.when(F.col("l_partkey") % 3 == 0, 1.5).alias("source_delay_ms"),
    )
    return rows


def air() -> localization.Medium:
    """343 m/s known to 0.5 m/s, a room of 30 m, a bias of 2 mm known to 1 mm."""
    return localization.Medium(*[F.lit(x) for x in (343.0, 48000.0, 30.0, 0.002, 0.5, 0.001)])


_KEYS = ["session", "source_id", "repeat_index", "microphone_id"]


def loopback_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = localization.loopback_ranges(_cells(spark, sf_dir), air())
    return rounded(found.select(*_KEYS, "distance_m", "sigma_samples", "sigma_m", "reason"), "distance_m", "sigma_samples", "sigma_m")


def relative_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays of an order's lines against the first of them, in microphone order, that has an arrival."""
    cells = _cells(spark, sf_dir).withColumn("order", F.col("microphone_id") * 100000000 + F.col("source_id") * 10 + F.col("repeat_index"))
    cells = cells.withColumns({"part": F.col("source_id"), "line": F.col("repeat_index")}).withColumns({"source_id": F.lit(0), "repeat_index": F.lit(0)})
    found = localization.relative_delays(cells, ["session"], "order")
    return rounded(found.select("session", "part", "line", "microphone_id", "tdoa_samples", "tdoa_sigma_samples", "reason"), "tdoa_samples", "tdoa_sigma_samples")


def session_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of a session for each nation, its suppliers being sources: with a loopback, a fixed emitter or neither.

    Some arrays are flat or straight within a third of a millimetre; some
    sessions have a range that is half a metre off, some have ranges with noise.
    """
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("session"), F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") / 4000).alias("src_x"), (F.col("s_suppkey") % 7 * 0.5).alias("src_y"), (F.col("s_nationkey") * 0.1 + 1.75).alias("src_z"))
    rows = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumns({"kind": F.col("session") % 3, "shape": F.col("session") % 7})
    k, bend = F.col("k"), F.col("k") % 2
    pick = lambda straight, flat, full: F.when(F.col("shape") == 0, straight).when(F.col("shape") == 1, flat).otherwise(full)
    rows = rows.withColumns({
        "mic_x": pick(k * 0.5, k % 3 * 1.0, k % 3 * 1.0), "mic_y": pick(bend * 0.0002, F.floor(k / 3) % 3 * 0.9, F.floor(k / 3) % 3 * 0.9), "mic_z": pick(F.lit(1.1), 1.1 + bend * 0.0003, 0.5 + (k * k % 5) * 0.3),
        "microphone_id": k, "order": k, "repeat_index": F.lit(0), "taken": F.when(k != 8, True), "arrival_reason": F.lit(None).cast("string"),
        "source_delay_ms": F.when(F.col("source_id") % 2 == 0, 1.5), "clock_ratio": F.lit(1.000003), "sigma": F.lit(0.1), "loopback_sigma": F.lit(0.1), "loopback_stable": F.lit(True),
        "device": F.lit("card"), "loopback_device": F.lit("card"), "fixed_reference": F.col("kind") == 1, "clock_offset": F.lit(1024.0), "clock_bound": F.lit(0.1),
    })
    off = F.when((F.col("session") % 5 == 2) & (k == 3), 0.5).when(F.col("session") % 5 == 3, (k * 5 % 3 - 1) * 0.001).otherwise(0.0)
    far = acoustics.distance([F.col(f"src_{a}") for a in "xyz"], [F.col(f"mic_{a}") for a in "xyz"]) + 0.002 + off
    samples = far / 343.0 * 48000 + F.coalesce("source_delay_ms", F.lit(0.0)) * 48
    return rows.withColumns({"loopback_arrival": F.when(F.col("kind") == 0, 213.0), "arrival": F.when(F.col("kind") == 1, (samples + 52800) * F.col("clock_ratio") + 1024).otherwise(213.0 + samples * F.col("clock_ratio"))})


def session_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sessions to ranges, each in its own mode."""
    found, _ = localization.localized(session_cells(spark, sf_dir), ["session"], "order", F.lit(52800.0), air(), 343.0 / 48000)
    return rounded(found.select("session", "source_id", "microphone_id", "mode", "distance_m", "sigma_m", "reason"), "distance_m", "sigma_m")


def position_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of suppliers as lines of a report."""
    s = read(spark, sf_dir, "supplier").withColumn("x", F.when(F.col("s_suppkey") % 4 != 0, nearest(F.col("s_acctbal") / 1000, 1)))
    line = localization.position_line(F.col("s_name"), F.col("x"), F.col("s_nationkey") * 0.5, F.lit(1.25), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey") / 2000), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey") * 0.5), F.col("s_suppkey") % 2 == 0, F.when(F.col("s_suppkey") % 8 == 0, "solve_failed"))
    return s.select("s_suppkey", line.alias("line"), localization.bench_bias(F.col("s_suppkey") % 2 == 0, F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey") / 100)).alias("b")).select("s_suppkey", "line", "b.*")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of known places found again from exact ranges to eight microphones."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session"), F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") / 1000).alias("sx"), (F.col("c_custkey") % 7 * 0.5).alias("sy"), (F.col("c_nationkey") * 0.1).alias("sz"))
    rows = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    rows = rows.withColumns({"mic_x": (F.col("k") % 2) * 1.0, "mic_y": (F.floor(F.col("k") / 2) % 2) * 0.7, "mic_z": F.floor(F.col("k") / 4) * 0.4})
    rows = rows.withColumn("distance_m", acoustics.distance([F.col("sx"), F.col("sy"), F.col("sz")], [F.col("mic_x"), F.col("mic_y"), F.col("mic_z")]))
    return rounded(localization.linear_positions(rows, ["session"]), "x", "y", "z", digits=5)


def solvability(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("source_id", F.col("source"))
    m = m.withColumns({"sigma_m": F.lit(0.01), "mic_x": F.col("microphone") * 1.0, "mic_y": F.when(F.col("session") % 3 == 0, F.col("microphone") * 2.0).otherwise((F.col("microphone") * F.col("microphone")) * 1.0), "mic_z": F.lit(1.0)})
    return solvable(m, ["session"])


def solvability_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measurements; sources reach one to five microphones."""
    m = measurements(spark, sf_dir).withColumns({"source_id": F.col("source"), "k": F.col("microphone") % (F.col("source") % 5 + 1)})
    m = m.withColumns({"sigma_m": F.lit(0.01), "mic_x": F.col("k") * 1.0, "mic_y": F.when(F.col("session") % 3 == 0, F.col("k") * 2.0).otherwise((F.col("k") * F.col("k")) * 1.0), "mic_z": F.lit(1.0)})
    return solvable(m, ["session"])


def calibration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier rows as lines of loose calibration text, read back."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 6
    line = F.when(k == 0, F.concat(F.lit("# "), "s_name")).when(k == 1, F.lit("Frequency SPL")).when(k == 2, F.concat_ws("\t", "s_suppkey", "s_acctbal")).when(k == 3, F.concat_ws(" , ", "s_suppkey", "s_acctbal")).when(k == 4, F.concat(F.lit(" "), "s_acctbal")).otherwise(F.concat_ws(" ", "s_acctbal", "s_suppkey", "s_name"))
    return documents.curve_rows(s.select("s_nationkey", line.alias("line")), ["s_nationkey"], "line")


def curve_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an analysis file for each brand."""
    p = read(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("frequency_hz")).agg(F.sum("p_retailprice").alias("s"), F.count("*").alias("n"))
    p = p.select("p_brand", "frequency_hz", (F.round("s", 1) / 10).alias("spl_db"), (F.col("n") * 1.5).alias("phase_deg"), F.when(F.col("n") > 2, F.col("n") * 0.25).alias("thd_percent"), F.when(F.col("n") > 3, F.col("n") * 10.0).alias("rt60_ms"), F.lit(None).cast("double").alias("c50_db"), F.lit(1.5).alias("c80_db"), (F.col("n") * -1.0).alias("group_delay_ms"))
    return bundles.curve_lines(p, ["p_brand"])


def loss_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of lost frames made from orders, and what is wrong with each."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 60).cast("long").alias("start_frame"), (F.col("l_linenumber") * 60 + F.col("l_quantity")).cast("long").alias("end_frame"))  # noqa: E741
    g = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("start_frame", "end_frame"))).alias("gaps"), F.sum(F.col("end_frame") - F.col("start_frame")).alias("missing"))
    k = F.col("l_orderkey") % 5
    clock = F.struct(F.lit(1000).cast("long").alias("observed_frames"), (F.col("missing") + F.when(k == 1, 1).otherwise(0)).alias("missing_frames_per_channel"), F.lit(0).cast("long").alias("omitted_intervals"), F.col("gaps").alias("intervals"))
    route = F.array(F.struct(F.lit(0).cast("long").alias("input_index"), F.lit(0).alias("hardware_channel")))
    one = F.struct(F.when(k == 2, "").otherwise("card").alias("device_id"), route.alias("routes"), clock.alias("continuity"))
    report = F.struct(F.when(k == 3, 2).otherwise(1).alias("version"), F.lit("overrun").alias("error"), F.array(one).alias("inputs"))
    text = g.select("l_orderkey", F.to_json(report).alias("text"))
    return documents.strict_json(text, "text", documents.loss_report_schema(), "r").select("l_orderkey", documents.loss_report_issue(F.col("r")).alias("issue"))


def labels_and_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on orders: bands, names, zones, waits."""
    o = read(spark, sf_dir, "orders")
    lo, hi = F.col("o_totalprice") / 100, F.col("o_totalprice") / 20
    return o.select(
        "o_orderkey", identity.band_label(F.floor(lo) + 0.5, F.floor(hi)).alias("band"), acoustics.arrival_band(lo, hi).getField("lo_hz").isNotNull().alias("has_arrival_band"),
        acoustics.sub_band(lo / 10, hi / 10).getField("hi_hz").isNotNull().alias("has_sub_band"), identity.capture_type(F.lower("o_orderstatus")).alias("kind"),
        F.round(levels.wrap_degrees(F.col("o_totalprice") - 250000), 4).alias("wrapped"), levels.sweep_count((F.col("o_orderkey") % 11).cast("int")).alias("sweeps"),
        levels.rescaled_frame(F.col("o_orderkey"), F.lit(44100), F.lit(48000)).alias("frame"), F.round(levels.progress(F.col("o_orderstatus") == "O", F.lit(310007.0), F.col("o_totalprice")), 6).alias("progress"),
        F.coalesce(F.size(identity.channel_list(F.concat_ws(",", F.col("o_orderkey") % 70, F.col("o_custkey") % 3))), F.lit(-1)).alias("channels"),
    )


def stream_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a live stream, its meters after the last batch."""
    return streamed(spark, sf_dir, live.meters, "update", ["channel"], "samples")


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 4096 sample numbers of each channel, as far as they are past; about a fifth of the numbers are a channel's."""
    return rounded(streamed(spark, sf_dir, lambda s: live.frames(s, 4096, least=1), "append", ["channel", "frame"], "samples"), "peak", "rms")


def stream_folder(spark: SparkSession) -> str:
    """A new folder for the state and the output of a stream, where all executors reach it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; by a pattern, as the table may be one file."""
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


def streamed(spark: SparkSession, sf_dir: str, operator, mode: str, keys: list[str], newest: str) -> DataFrame:  # noqa: ANN001
    """Runs an operator over the events until none are left, and reads the last row of each key."""
    folder = stream_folder(spark)
    samples = live_events(spark, sf_dir).select(F.col("event_type").alias("channel"), F.col("event_id").alias("idx"), (F.col("value") / 500).alias("x"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = operator(samples).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").drop("batch")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), newest).alias("r"))
    return last.select(*keys, "r.*")


_L = """WITH m AS (SELECT l_orderkey AS session, l_partkey AS source_id, l_linenumber AS repeat_index, l_suppkey AS microphone_id, CASE WHEN l_quantity > 2 THEN l_quantity * 100 END AS a,
  CASE WHEN l_tax > 0 THEN 1 + l_tax / 1000 END AS r, l_discount * 10 AS s, CASE WHEN l_returnflag <> 'A' THEN l_discount * 5000 END AS l, l_linestatus AS d,
  CASE WHEN l_partkey % 3 = 0 THEN 72.0 ELSE 0 END AS own FROM lineitem)"""
#: Sessions as ``session_cells`` makes them: true distance d, and off as it is measured.
SESSIONS = """WITH s AS (SELECT s_nationkey AS session, s_suppkey AS source_id, k, s_nationkey % 3 AS kind, s_nationkey % 7 AS shape, s_nationkey % 5 AS odd, s_acctbal / 4000 AS x, s_suppkey % 7 * 0.5::DOUBLE AS y, s_nationkey * 0.1::DOUBLE + 1.75 AS z,
  CASE s_nationkey % 7 WHEN 0 THEN k * 0.5::DOUBLE ELSE k % 3 * 1.0::DOUBLE END AS mx, CASE s_nationkey % 7 WHEN 0 THEN k % 2 * 0.0002::DOUBLE ELSE k // 3 % 3 * 0.9::DOUBLE END AS my,
  CASE s_nationkey % 7 WHEN 0 THEN 1.1::DOUBLE WHEN 1 THEN 1.1 + k % 2 * 0.0003::DOUBLE ELSE 0.5 + k * k % 5 * 0.3::DOUBLE END AS mz FROM supplier, range(9) r(k)),
k AS (SELECT *, sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) AS d, CASE WHEN odd = 2 AND k = 3 THEN 0.5 WHEN odd = 3 THEN (k * 5 % 3 - 1) * 0.001::DOUBLE ELSE 0 END AS off FROM s)"""

SQL = {
    "plan_validation": """WITH u AS (SELECT *, CAST((c_custkey % 25 IN (1, 2)) AS INTEGER) + CAST((c_custkey % 49 = 3) AS INTEGER) AS unknown FROM customer)
SELECT c_custkey, unknown, CASE WHEN unknown > 0 THEN 'unknown_key' ELSE CASE c_custkey % 12 WHEN 7 THEN 'version' WHEN 8 THEN 'output_device' WHEN 9 THEN 'repeat_count' WHEN 1 THEN 'microphone_id' WHEN 2 THEN 'microphone_route'
  WHEN 3 THEN 'microphone_position' WHEN 4 THEN 'compact_uncertainty' WHEN 6 THEN 'source_delay' WHEN 10 THEN 'sweep' WHEN 5 THEN CASE WHEN c_nationkey * 9 >= 64 THEN 'source_route' END END END AS issue FROM u""",
    "plan_parts": """SELECT c_custkey, CAST(0 AS INTEGER) AS unknown, CASE c_custkey % 17 WHEN 1 THEN 'probe_storage' WHEN 2 THEN 'probe' WHEN 3 THEN 'bass_anchor_storage' WHEN 4 THEN 'bass_anchor' WHEN 5 THEN 'bass_anchor' WHEN 6 THEN 'loopback'
  WHEN 7 THEN 'bass_anchor_loopback' WHEN 8 THEN 'ear_pair' WHEN 9 THEN 'ear_pair_loopback' WHEN 10 THEN 'ear_pair_device' WHEN 11 THEN 'localization_calibration' WHEN 12 THEN 'sweep_storage' WHEN 13 THEN 'sweep_samples'
  WHEN 14 THEN 'sound_speed' WHEN 15 THEN 'timing_reference' WHEN 16 THEN 'bass_anchor' END AS issue FROM customer""",
    "signal_kinds": """WITH c AS (SELECT *, ['sweep', 'two_tone', 'white_noise', 'pink_noise', 'm_noise', 'mls', 'dirac', 'stipa', NULL, NULL, 'tone', 'mls'][c_custkey % 12 + 1] AS kind, c_custkey % 5 * 6000 AS lo FROM customer)
SELECT c_custkey, kind, coalesce(kind, 'sweep') AS plays, CASE WHEN c_custkey % 4 IN (0, 3) THEN 'amplitude' WHEN kind IN ('tone', 'two_tone') AND NOT (lo > 0 AND lo * 2 < 48000) THEN 'frequency'
  WHEN kind = 'sweep' AND NOT (lo > 0 AND lo < 20000) THEN 'sweep_range' WHEN kind = 'mls' AND c_custkey % 30 NOT BETWEEN 2 AND 24 THEN 'mls_order' END AS issue,
  'capture: ' || ['Check the OS microphone privacy settings, then restart the app. (original error: Permission denied)', 'Check the OS microphone privacy settings, then restart the app. (original error: stream not authorized)',
    'The device is busy — close other apps using it and try again. (original error: device is in use)', 'The device is busy — close other apps using it and try again. (original error: exclusive mode)',
    'Run with --list-devices (or the UI device picker) to see available devices. (original error: No default input device)', 'Run with --list-devices (or the UI device picker) to see available devices. (original error: no such device)',
    'sample rate 7', 'timed out'][c_custkey % 8 + 1] AS advice,
  CASE WHEN c_custkey % 16 < 8 OR c_custkey % 16 = 15 THEN 'fft_size' WHEN c_custkey % 7 NOT IN (1, 2, 3) THEN 'duration' END AS live,
  'take_' || coalesce(kind, 'none') || '_send' || c_nationkey || '_rec' || c_custkey || '_48000' AS name FROM c""",
    "stimulus_layouts": """WITH p AS (SELECT c_custkey, c_custkey % 4 + 1.0::DOUBLE AS d, CASE WHEN c_custkey % 12 = 11 THEN 2.0::DOUBLE END AS b, CASE WHEN c_custkey % 12 = 10 THEN 24000.0::DOUBLE ELSE 20000 END AS hi FROM customer),
n AS (SELECT c_custkey, CAST(round(CASE WHEN b IS NULL THEN d ELSE greatest(d, b * (log2(100 / 20.0) + 0.5 * log2(10) + 0.25 * log2(hi / 1000))) END * 48000) AS BIGINT) AS n FROM p)
SELECT c_custkey, CAST(24000 AS BIGINT) AS chirp_frame, CAST(52800 AS BIGINT) AS sweep_frame, 52800 + n + 96000 AS end_chirp_frame, 52800 + n + 96000 + 4800 + 24000 AS frames FROM n""",
    "take_completeness": """WITH w AS (SELECT c_custkey, m, r FROM customer, range(3) a(m), range(17) b(r) WHERE r < CASE WHEN c_custkey % 12 = 9 THEN 17 ELSE c_custkey % 3 + 1 END),
want AS (SELECT c_custkey, CASE WHEN c_custkey % 12 = 1 AND m = 1 THEN 'm0' ELSE 'm' || m END AS m, r FROM w), have AS (SELECT DISTINCT o_custkey AS c_custkey, 'm' || (o_orderkey % 3) AS m, o_orderkey % 2 AS r FROM orders)
SELECT c_custkey, count(*) AS missing FROM want ANTI JOIN have USING (c_custkey, m, r) GROUP BY c_custkey""",
    "loopback_matrix": _L + """, t AS (SELECT *, ((a - l) / r - own) * 343 / 48000 - 0.002 AS x FROM m), f AS (SELECT *, CASE WHEN l IS NULL OR d <> 'O' THEN 'loopback_unavailable' WHEN r IS NULL THEN 'clock_uncorrected'
  WHEN a IS NULL THEN 'arrival_low_confidence' WHEN x < 0 OR x > 30 THEN 'range_implausible' END AS reason FROM t)
SELECT session, source_id, repeat_index, microphone_id, round(CASE WHEN reason IS NULL THEN x END, 6) AS distance_m, round(CASE WHEN reason IS NULL THEN sqrt(s * s + 0.25) / r END, 6) AS sigma_samples,
  round(CASE WHEN reason IS NULL THEN 343 * sqrt(s * s + 0.25) / r / 48000 + x * 0.5 / 343 + 0.001 END, 6) AS sigma_m, reason FROM f""",
    "relative_matrix": _L + """, o AS (SELECT *, CASE WHEN r IS NULL THEN 'clock_uncorrected' WHEN a IS NULL THEN 'arrival_low_confidence' END AS why FROM m),
g AS (SELECT session, min({'o': microphone_id * 100000000 + source_id * 10 + repeat_index, 'a': a, 's': s}) AS m FROM o WHERE why IS NULL GROUP BY session), f AS (SELECT session, m.a AS fa, m.s AS fs FROM g)
SELECT session, source_id AS part, repeat_index AS line, microphone_id, round(CASE WHEN why IS NULL THEN (a - fa) / r END, 6) AS tdoa_samples,
  round(CASE WHEN why IS NULL THEN sqrt(s * s + fs * fs) / r END, 6) AS tdoa_sigma_samples, coalesce(why, 'no_absolute_time_origin') AS reason FROM o LEFT JOIN f USING (session)""",
    "session_ranges": SESSIONS + """ SELECT session, source_id, CAST(k AS INTEGER) AS microphone_id, CASE kind WHEN 0 THEN 'loopback' WHEN 1 THEN 'emitter' ELSE 'relative' END AS mode, round(CASE WHEN k <> 8 AND kind < 2 THEN d + off END, 6) AS distance_m,
  round(CASE WHEN k <> 8 AND kind < 2 THEN 343 * sqrt(0.02) / CASE kind WHEN 0 THEN 1.000003 ELSE 1 END / 48000 + (d + off) * 0.5 / 343 + 0.001 END, 6) AS sigma_m,
  CASE WHEN k = 8 THEN 'take_missing' WHEN kind = 2 THEN 'no_absolute_time_origin' END AS reason FROM k""",
    "position_lines": """WITH s AS (SELECT *, CASE WHEN s_suppkey % 4 <> 0 THEN round(s_acctbal / 1000, 1) END AS x, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN s_nationkey / 100 END AS b FROM supplier)
SELECT s_suppkey, 'localization ' || s_name || ' ' || CASE WHEN x IS NOT NULL THEN printf('position: [%.3f, %.3f, %.3f] m', x, s_nationkey * 0.5::DOUBLE, 1.25::DOUBLE) WHEN s_suppkey % 8 = 0 THEN 'position: refused (solve_failed)' ELSE 'position: refused (unknown)' END
  || CASE WHEN s_suppkey % 3 <> 0 THEN printf(' rms %.1f mm', s_nationkey / 2::DOUBLE) ELSE '' END || CASE WHEN s_suppkey % 5 <> 0 THEN printf(' gdop %.1f', s_nationkey * 0.5::DOUBLE) ELSE '' END
  || CASE WHEN s_suppkey % 2 = 0 THEN ' [mirror-ambiguous]' ELSE '' END AS line, coalesce(b, 0)::DOUBLE AS bias_m, CASE WHEN b IS NOT NULL THEN 0.002 ELSE 0 END::DOUBLE AS sigma_m FROM s""",
    "positions": """SELECT c_nationkey AS session, c_custkey AS source_id, round(c_acctbal / 1000, 5) AS x, round(c_custkey % 7 * 0.5, 5)::DOUBLE AS y, round(c_nationkey * 0.1, 5)::DOUBLE AS z, CAST(8 AS BIGINT) AS links FROM customer""",
    "solvability": """WITH m AS (SELECT l_orderkey % 50 AS session, l_partkey % 7 AS source_id, l_suppkey % 10 AS k FROM lineitem),
g AS (SELECT session, source_id, count(DISTINCT k) AS links FROM m GROUP BY ALL)
SELECT session, source_id, links, CASE WHEN links < 3 THEN 'insufficient_ranges' WHEN session % 3 = 0 THEN 'degenerate_geometry' WHEN links = 3 THEN 'mirror_ambiguous' ELSE 'solvable' END AS verdict FROM g""",
    "solvability_all": """WITH m AS (SELECT l_orderkey % 50 AS session, l_partkey % 7 AS source_id, l_suppkey % 10 % (l_partkey % 7 % 5 + 1) AS k FROM lineitem),
g AS (SELECT session, source_id, count(DISTINCT k) AS links FROM m GROUP BY ALL)
SELECT session, source_id, links, CASE WHEN links < 3 THEN 'insufficient_ranges' WHEN session % 3 = 0 THEN 'degenerate_geometry' WHEN links = 3 THEN 'mirror_ambiguous' ELSE 'solvable' END AS verdict FROM g""",
    "calibration_text": """SELECT s_nationkey, CASE WHEN s_suppkey % 6 = 5 THEN s_acctbal ELSE s_suppkey::DOUBLE END AS frequency_hz, CASE WHEN s_suppkey % 6 = 5 THEN s_suppkey::DOUBLE ELSE s_acctbal END AS spl_db FROM supplier
WHERE s_suppkey % 6 IN (2, 3, 5) AND CASE WHEN s_suppkey % 6 = 5 THEN s_acctbal ELSE s_suppkey END > 0""",
    "curve_file": """WITH p AS (SELECT p_brand, p_size::DOUBLE AS f, round(sum(p_retailprice), 1) / 10 AS s, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, f AS frequency_hz, printf('%.6f,%.3f,%.6f,', f, s, n * 1.5) || CASE WHEN n > 2 THEN printf('%.6f', n * 0.25) ELSE 'NaN' END || printf(',%.3f,%.3f,%.3f,%.6f', CASE WHEN n > 3 THEN n * 10.0 ELSE 0.0 END, 0.0, 1.5, n * -1.0) AS line FROM p""",
    "loss_reports": """WITH l AS (SELECT l_orderkey, l_linenumber * 60 AS a, l_linenumber * 60 + CAST(l_quantity AS BIGINT) AS b FROM lineitem), w AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY l_orderkey ORDER BY a, b), 0) AS e FROM l),
g AS (SELECT l_orderkey, bool_and(a >= e AND b > a AND b <= 1000) AS ok, sum(b - a) AS missing FROM w GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 3 THEN 'header' WHEN l_orderkey % 5 = 2 THEN 'device_or_count' WHEN NOT ok THEN 'interval_order' WHEN l_orderkey % 5 = 1 OR missing > 1000 THEN 'interval_sum' END AS issue FROM g""",
    "labels_and_advice": """WITH o AS (SELECT *, o_totalprice / 100 AS lo, o_totalprice / 20 AS hi, 180 - (o_totalprice - 250000) AS t FROM orders)
SELECT o_orderkey, 'sweep_' || (CASE WHEN CAST(floor(lo) AS BIGINT) % 2 = 0 THEN CAST(floor(lo) AS BIGINT) ELSE CAST(floor(lo) AS BIGINT) + 1 END) || '_' || CAST(floor(hi) AS BIGINT) AS band,
  least(hi, 8000) - greatest(lo, 2000) >= 2000 AS has_arrival_band, least(hi / 10, 300) - greatest(lo / 10, 20) >= 100 AS has_sub_band, 'sweep' AS kind, round(180 - (t - 360 * floor(t / 360)), 4) AS wrapped,
  CAST(CASE WHEN least(greatest(o_orderkey % 11, 1), 8) = 2 THEN 3 ELSE least(greatest(o_orderkey % 11, 1), 8) END AS INTEGER) AS sweeps, (o_orderkey * 48000 + 22050) // 44100 AS frame,
  round(CASE WHEN o_orderstatus = 'O' THEN least(1, o_totalprice / 310007) END, 6) AS progress,
  CAST(CASE WHEN o_orderkey % 70 < 64 AND o_orderkey % 70 <> o_custkey % 3 THEN 2 ELSE -1 END AS INTEGER) AS channels FROM o""",
    "stream_meters": """SELECT event_type AS channel, count(*) AS samples, max(abs(value / 500)) AS peak_hold, sqrt(avg(value / 500 * value / 500)) AS rms, count(*) FILTER (value / 500 >= 0.999) AS clipped, max(event_id) AS last_idx FROM events GROUP BY event_type""",
    "stream_frames": """WITH f AS (SELECT 0::BIGINT AS late, event_type AS channel, event_id // 4096 AS frame, count(*) AS samples, round(max(value / 500), 6) AS peak, round(sqrt(avg(value / 500 * value / 500)), 6) AS rms,
  CAST(count(*) FILTER (value / 500 >= 1) AS BIGINT) AS clipped FROM events GROUP BY ALL) SELECT * FROM f WHERE frame < (SELECT max(g.frame) FROM f g WHERE g.channel = f.channel)""",
}

QUERIES = [
    plan_validation, plan_parts, signal_kinds, stimulus_layouts, take_completeness, loopback_matrix, relative_matrix, session_ranges, position_lines, positions, solvability, solvability_all, calibration_text, curve_file, loss_reports,
    labels_and_advice, stream_meters, stream_frames,
]
