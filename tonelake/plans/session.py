"""Validation of session plans, and what follows from a valid one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tonelake.functions.acoustics import octave_weighted_seconds
from tonelake.functions.levels import is_finite

#: Limits of a plan.
RATES, REPEATS, MICROPHONES, CHANNELS, TAKES = (16_001, 384_000), (1, 16), (2, 32), 64, 1024
COMPACT_MM, DELAY_MS, SOUND, BASS_SECONDS, LEVEL_DB = 1.0, (0.0, 100.0), (250.0, 400.0), (1.0, 10.0), (-60.0, 0.0)
FRAMES, BYTES, CHUNK, QUEUE, WRITER = 16_000_000, 512 << 20, 1024, 64, 8192

PLAN = (
    "version int, geometry string, sample_rate_hz int, output_device string, "
    "microphones array<struct<id: string, device: string, input_channel: int, calibration_file: string, calibration_orientation: string, gain_db: double, position_m: array<double>, position_uncertainty_mm: double>>, "
    "sources array<struct<id: string, output_channel: int, position_m: array<double>, position_uncertainty_mm: double, source_delay_calibration_ms: double>>, "
    "repeat_count int, sweep struct<duration_secs: double, start_hz: double, end_hz: double, amplitude: double, bass_octave_duration_s: float>, "
    "timing_reference struct<output_channel: int, position_m: array<double>, position_uncertainty_mm: double, sound_speed_m_s: double, sound_speed_uncertainty_m_s: double>, "
    "sound_speed struct<m_s: double, uncertainty_m_s: double, air_temperature_c: double>, localization_calibration_file string, "
    "room_dimensions struct<length: double, width: double, height: double>, setup_description string, "
    "loopback struct<device: string, input_channel: int>, "
    "probe struct<probe_duration_ms: float, silence_duration_ms: float, signal_level_db: float>, "
    "bass_anchor struct<bass_freq_hz: float, bass_duration_s: float, fade_ms: float, num_windows: int, silence_duration_ms: float, signal_level_db: float>, "
    "ctc struct<left_ear: string, right_ear: string, head_position: struct<id: string, x: double, y: double, z: double, yaw_deg: double>>"
)


def plan_schema() -> StructType:
    """The schema, which a running session reads from its text."""
    return StructType.fromDDL(PLAN)


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x) == "", F.lit(True))


def _paired(x: Column) -> Column:
    """Position and uncertainty both absent, or both there and sound."""
    p, u = x["position_m"], x["position_uncertainty_mm"]
    sound = (F.size(p) == 3) & F.forall(p, is_finite) & is_finite(u) & (u >= 0)
    return (p.isNull() & u.isNull()) | F.coalesce(p.isNotNull() & u.isNotNull() & sound, F.lit(False))


def _unique(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def _bad(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def _first(of: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(broken, F.lit(token)) for broken, token in of])


def _earlier(values: Column, i: Column) -> Column:
    """Whether element i stands before as well."""
    return F.array_contains(F.slice(values, F.lit(1), i), F.get(values, i))


def _first_of_each(items: Column, issue) -> Column:  # noqa: ANN001
    """The first issue of the first item that has one."""
    return F.get(F.filter(F.transform(items, issue), lambda t: t.isNotNull()), F.lit(0))


def _microphone_issue(p: Column) -> Column:
    """Microphones are judged one after another, each by all of these."""
    mics, compact = p["microphones"], p["geometry"] == "compact"
    ids, routes = F.transform(mics, lambda m: m["id"]), F.transform(mics, lambda m: F.concat_ws("\x00", m["device"], m["input_channel"].cast("string")))
    return _first_of_each(mics, lambda m, i: _first([
        (_blank(m["id"]) | _earlier(ids, i), "microphone_id"),
        (_blank(m["device"]) | _bad(m["input_channel"].between(0, CHANNELS - 1)) | _earlier(routes, i), "microphone_route"),
        (F.coalesce(m["calibration_file"] == "", F.lit(True)), "microphone_calibration"),
        (_bad(is_finite(m["gain_db"])), "microphone_gain"),
        (~_paired(m), "microphone_position"),
        (F.coalesce(compact & (m["position_uncertainty_mm"] > COMPACT_MM), F.lit(False)), "compact_uncertainty"),
    ]))


def _source_issue(p: Column) -> Column:
    sources = p["sources"]
    ids, outputs = F.transform(sources, lambda x: x["id"]), F.transform(sources, lambda x: x["output_channel"])
    return _first_of_each(sources, lambda x, i: _first([
        (_blank(x["id"]) | _bad(x["output_channel"].between(0, CHANNELS - 1)) | _earlier(ids, i) | _earlier(outputs, i), "source_route"),
        (~_paired(x), "source_position"),
        (_bad(F.coalesce(x["source_delay_calibration_ms"].between(*DELAY_MS), F.lit(True))), "source_delay"),
    ]))


def _pass_fits(p: Column, seconds: Column, silence: Column) -> Column:
    """Whether a pass over all sources, with six seconds around it, is within the frames of a capture."""
    rate, n = p["sample_rate_hz"].cast("double"), F.size(p["sources"])
    whole = silence * rate + n * (seconds + silence) * rate + 6 * rate
    return n.between(1, 64) & is_finite(seconds) & (seconds * rate >= 2) & is_finite(silence) & (silence >= 0) & (whole <= FRAMES)


def queue_chunks(inputs: Column, rate: Column) -> Column:
    """Chunks that a writer's queue holds: a second of all inputs, and ``QUEUE`` at least."""
    return F.greatest(F.lit(QUEUE), inputs * F.ceil(rate / CHUNK))


def issue(p: Column) -> Column:
    """The token of the first rule that a plan breaks, in the order in which a plan is judged; null if it breaks none."""
    mics, sources, sweep, room = p["microphones"], p["sources"], p["sweep"], p["room_dimensions"]
    placed = F.filter(F.transform(mics, lambda m: m["position_m"]), lambda x: x.isNotNull())
    ref, sound, loop, probe, bass, ctc = (p[c] for c in ("timing_reference", "sound_speed", "loopback", "probe", "bass_anchor", "ctc"))
    repeats = F.coalesce(p["repeat_count"], F.lit(1))
    rate = p["sample_rate_hz"].cast("double")
    double = lambda x: x.cast("double")
    level = lambda x: double(x["signal_level_db"]).between(*LEVEL_DB)
    ears = F.array(ctc["left_ear"], ctc["right_ear"])
    head = ctc["head_position"]
    known = lambda ear: F.exists(mics, lambda m: m["id"] == ear)
    own_ears = F.filter(mics, lambda m: F.array_contains(ears, m["id"]))
    seconds = octave_weighted_seconds(sweep["start_hz"], sweep["end_hz"], double(sweep["bass_octave_duration_s"]), sweep["duration_secs"])
    inputs = F.size(mics) + F.when(loop.isNotNull(), 1).otherwise(0)
    samples = inputs * rate + 2 * F.ceil((seconds + 4) * rate) + CHUNK * (inputs + queue_chunks(inputs, rate) + 2)
    volume = room["length"] * room["width"] * room["height"]
    return F.coalesce(
        _first([
            (_bad(p["version"] == 1), "version"), (_bad(p["sample_rate_hz"].between(*RATES)), "sample_rate"), (_blank(p["output_device"]), "output_device"),
            (_bad(repeats.between(*REPEATS)), "repeat_count"), (_bad(F.size(mics).between(*MICROPHONES)), "microphone_count"),
        ]),
        _microphone_issue(p),
        _first([((p["geometry"] == "compact") & ~_unique(placed), "compact_distinct"), (_bad(F.size(sources) > 0), "source_count")]),
        _source_issue(p),
        _first([
            (_bad(F.size(mics) * F.size(sources) * repeats <= TAKES), "take_count"),
            (room.isNotNull() & _bad(is_finite(volume) & (F.least(room["length"], room["width"], room["height"]) > 0)), "room_dimensions"),
            (p["setup_description"].isNotNull() & _blank(p["setup_description"]), "setup_description"),
            (probe.isNotNull() & _bad(_pass_fits(p, double(probe["probe_duration_ms"]) / 1000, double(probe["silence_duration_ms"]) / 1000)), "probe_storage"),
            (probe.isNotNull() & _bad(level(probe)), "probe"),
            (bass.isNotNull() & _bad(_pass_fits(p, double(bass["bass_duration_s"]), double(bass["silence_duration_ms"]) / 1000)), "bass_anchor_storage"),
            (bass.isNotNull() & _bad((bass["bass_freq_hz"] > 0) & (double(bass["bass_freq_hz"]) < rate / 2) & (bass["fade_ms"] >= 0) & (double(bass["fade_ms"]) * 2 / 1000 <= double(bass["bass_duration_s"])) & (bass["num_windows"] > 0) & level(bass)), "bass_anchor"),
            (loop.isNotNull() & (_blank(loop["device"]) | _bad(loop["input_channel"].between(0, CHANNELS - 1)) | F.exists(mics, lambda m: (m["device"] == loop["device"]) & (m["input_channel"] == loop["input_channel"]))), "loopback"),
            (loop.isNotNull() & bass.isNotNull() & _bad(loop["device"] == F.get(mics, F.lit(0))["device"]), "bass_anchor_loopback"),
            (ctc.isNotNull() & _bad((ctc["left_ear"] != ctc["right_ear"]) & known(ctc["left_ear"]) & known(ctc["right_ear"]) & ~_blank(head["id"]) & is_finite(head["x"]) & is_finite(head["y"]) & is_finite(head["z"]) & is_finite(head["yaw_deg"])), "ear_pair"),
            (ctc.isNotNull() & loop.isNull(), "ear_pair_loopback"),
            (ctc.isNotNull() & _bad(F.forall(own_ears, lambda m: m["device"] == loop["device"])), "ear_pair_device"),
            (ref.isNotNull() & _bad(_paired(ref) & ref["position_m"].isNotNull() & ref["output_channel"].between(0, CHANNELS - 1) & ref["sound_speed_m_s"].between(*SOUND) & (ref["sound_speed_uncertainty_m_s"] >= 0) & (ref["sound_speed_uncertainty_m_s"] < ref["sound_speed_m_s"])), "timing_reference"),
            (sound.isNotNull() & _bad(sound["m_s"].between(*SOUND) & (sound["uncertainty_m_s"] >= 0) & (sound["uncertainty_m_s"] < sound["m_s"]) & (sound["air_temperature_c"].isNull() | is_finite(sound["air_temperature_c"]))), "sound_speed"),
            (F.coalesce(p["localization_calibration_file"] == "", F.lit(False)), "localization_calibration"),
            (_bad(is_finite(sweep["end_hz"]) & (sweep["start_hz"] > 0) & (sweep["end_hz"] > sweep["start_hz"]) & (sweep["end_hz"] < rate / 2) & (sweep["amplitude"] > 0) & (sweep["amplitude"] <= 1) & (sweep["duration_secs"] > 0) & is_finite(sweep["duration_secs"])), "sweep"),
            (sweep["bass_octave_duration_s"].isNotNull() & _bad(double(sweep["bass_octave_duration_s"]).between(*BASS_SECONDS)), "bass_duration"),
            (_bad((seconds + 14) * rate <= FRAMES), "sweep_storage"),
            (_bad(samples * 4 + inputs * WRITER + (1 << 20) <= BYTES), "live_storage"),
            (_bad((double(sweep["amplitude"].cast("float")) > 0) & (sweep["duration_secs"] * rate >= 2)), "sweep_samples"),
        ]),
    )


def first_issue(plan: Column, unknown_keys: Column) -> Column:
    """What a plan that was read from a file is refused for first: a key that plans do not have, then the rules in their order; null for a sound plan."""
    return F.when(F.size(unknown_keys) > 0, "unknown_key").otherwise(issue(plan))


def children(plans: DataFrame, key: str, plan: str, part: str) -> DataFrame:
    """(key, ordinal, fields) of a plan's microphones or sources in the plan's order."""
    return plans.select(key, F.posexplode(F.col(f"{plan}.{part}")).alias("ordinal", "_x")).select(key, "ordinal", "_x.*")


def expected_takes(plans: DataFrame, key: str, plan: str) -> DataFrame:
    """(key, source_id, microphone_id, repeat_index): every take a plan asks for.

    Outer explosions, whose empty rows are dropped, since Spark filters before
    plain ones by what is exploded: it would parse plans where rows are read.
    """
    p = F.col(plan)
    rows = plans.select(key, F.posexplode_outer(p["sources"]["id"]).alias("_i", "source_id"), p["microphones"]["id"].alias("_m"), F.coalesce(p["repeat_count"], F.lit(1)).alias("_n")).where("_i is not null")
    rows = rows.select(key, "source_id", F.posexplode_outer("_m").alias("_i", "microphone_id"), "_n").where("_i is not null")
    return rows.select(key, "source_id", "microphone_id", F.explode_outer(F.sequence(F.lit(0), F.col("_n") - 1)).alias("repeat_index"))


def stimulus_layout(rate: Column, sweep: Column) -> Column:
    """Where the parts of a stimulus are, in frames: a chirp, the sweep, a second chirp, with silence around."""
    quiet, chirp = F.floor(rate / 2), F.floor(rate / 10)
    seconds = octave_weighted_seconds(sweep["start_hz"], sweep["end_hz"], sweep["bass_octave_duration_s"].cast("double"), sweep["duration_secs"])
    n = F.round(seconds * rate).cast("long")
    sweep_at = quiet + chirp + quiet
    end_at = sweep_at + n + 2 * rate
    return F.struct(quiet.alias("chirp_frame"), chirp.alias("chirp_frames"), sweep_at.alias("sweep_frame"), n.alias("sweep_frames"), end_at.alias("end_chirp_frame"), (end_at + chirp + quiet).alias("frames"))


def signal_issue(kind: Column, rate: Column, lo: Column, hi: Column, amplitude: Column, order: Column) -> Column:
    """What is wrong with a signal's parameters, or null."""
    return (
        F.when(amplitude.isNotNull() & ~((amplitude > 0) & (amplitude <= 1)), "amplitude")
        .when(kind.isin("tone", "two_tone") & ~F.coalesce((lo > 0) & (lo * 2 < rate), F.lit(False)), "frequency")
        .when((kind == "two_tone") & ~F.coalesce((hi > 0) & (hi * 2 < rate), F.lit(False)), "frequency")
        .when(kind.isin("sweep", "octave_sweep") & ~F.coalesce((lo > 0) & (lo < hi) & (hi * 2 <= rate), F.lit(False)), "sweep_range")
        .when((kind == "mls") & ~F.coalesce(order.between(2, 24), F.lit(False)), "mls_order")
    )


def live_issue(rate: Column, size: Column, seconds: Column) -> Column:
    """What is wrong with the settings of a live monitor, or null."""
    return (
        F.when(~rate.between(8000, 384_000), "rate")
        .when(~(size.between(256, 16_384) & (size.bitwiseAND(size - 1) == 0)), "fft_size")
        .when(~((seconds > 0) & (seconds <= 3600)), "duration")
    )
