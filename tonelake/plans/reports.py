"""What a session tells its users: lines, verdicts and roll-ups over its channels, takes and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.levels import is_finite
from tonelake.plans.positions import geometry_rank

#: Labels of quality evidence.
METRICS = {"thd": "THD", "broadband_snr": "broadband SNR", "band_snr": "band SNR", "clipping": "clipping", "timing_markers": "timing markers"}
UNITS = {"percent": "%", "decibels": "dB", "samples": "samples", "count": "count"}
COMPARISONS = {"at_most": "≤", "at_least": "≥", "equal_to": "="}
#: A report of reflections ends after so many segments, or so many milliseconds after the direct sound.
SEGMENTS, SEGMENT_MS = 65, 80.0


def _labelled(of: dict[str, str], value: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), value)


def finding_line(metric: Column, unit: Column, comparison: Column, value: Column, limit: Column) -> Column:
    """A finding as ``THD 1.20 % (≤ 10.00 %)``; unknown evidence says so."""
    name, sign, at = _labelled(METRICS, metric), _labelled(UNITS, unit), _labelled(COMPARISONS, comparison)
    told = F.when(is_finite(value), F.format_string("%s %.2f %s (%s %.2f %s)", name, value, sign, at, limit, sign))
    return F.coalesce(told, F.concat(name, F.lit(" unknown")))


# ------------------------------------------------------------------ predicates


def spl_issue(rate: Column, reference_hz: Column, rms: Column, peak: Column) -> Column:
    """What keeps a level calibration from being used, or null."""
    tuned = rate.between(8000, 384_000) & is_finite(reference_hz) & (reference_hz > 0) & (reference_hz < rate / 2)
    loud = is_finite(peak) & is_finite(rms) & (rms > 0) & (peak < 1) & (rms <= peak)
    return F.when(~F.coalesce(tuned, F.lit(False)), "rate_or_reference").when(~F.coalesce(loud, F.lit(False)), "levels")


def _rising(x: Column) -> Column:
    return F.forall(F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda b, a: b > a), lambda ok: ok)


def can_reconstruct(rate: Column, frequencies: Column, magnitude: Column, phase: Column) -> Column:
    """Whether an impulse response can be made of a spectrum: a rising grid above zero and as many finite values."""
    n = F.size(frequencies)
    ok = (rate > 0) & (n >= 2) & (F.size(magnitude) == n) & (F.size(phase) == n)
    ok = ok & F.forall(frequencies, lambda f: is_finite(f) & (f > 0)) & F.forall(magnitude, is_finite) & F.forall(phase, is_finite)
    return F.coalesce(ok & _rising(frequencies), F.lit(False))


def impulse_measured(times: Column, impulse: Column) -> Column:
    """Whether a measured impulse response is whole: a rising time axis and as many finite samples."""
    ok = (F.size(times) > 0) & (F.size(times) == F.size(impulse)) & F.forall(times, is_finite) & F.forall(impulse, is_finite)
    return F.coalesce(ok & _rising(times), F.lit(False))


def impulse_issue(name: Column, rate: Column, origin: Column, samples: Column, wanted: Column) -> Column:
    """Why the file of an impulse response is not taken: it must be a local name of the session's rate and origin, with finite samples."""
    local = name.rlike(r"^[^/\\]+$") & ~name.isin(".", "..")
    whole = (rate == wanted) & (origin == "shared_stimulus_sweep_start") & (F.size(samples) > 0) & F.forall(samples, lambda x: is_finite(x) & (F.abs(x) <= 3.4028234663852886e38))
    return F.when(~F.coalesce(local, F.lit(False)), "filename").when(~F.coalesce(whole, F.lit(False)), "samples_rate_or_origin")


def grid_of(lines: Column) -> Column:
    """The first column of a response file's lines after its head; null if it is empty or has anything but finite numbers."""
    cells = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(F.get(F.split(x, ","), F.lit(0)))), lambda c: c != "")
    found = F.transform(cells, lambda c: c.try_cast("double"))
    return F.when((F.size(found) > 0) & F.forall(found, is_finite), found)


# ------------------------------------------------------------------ lines


def quality_line(channel: Column, trustworthy: Column, accepted: Column, rejected: Column, score: Column, verdict: Column, dropped: Column) -> Column:
    """(line, kind) of a recorded channel; without a score there is no quality data."""
    ok = F.concat(channel, F.format_string(": OK (%d/%d sweeps) — ", accepted, accepted + rejected), verdict)
    review = F.concat(channel, F.format_string(": REVIEW (score %.2f) — ", score), verdict)
    lost = F.when(dropped > 0, F.format_string("; %d dropped samples", dropped)).otherwise("")
    kind = F.when(score.isNull(), "no_data").when(trustworthy, "ok").otherwise("review")
    line = F.when(kind == "no_data", F.concat(channel, F.lit(": recorded (no quality data)"))).when(kind == "ok", F.concat(ok, lost)).otherwise(F.concat(review, lost))
    return F.struct(line.alias("line"), kind.alias("kind"))


def clock_line(take: Column, microphone: Column, skew_ppm: Column, correction: Column, basis: Column, reason: Column) -> Column:
    """A take's clock as one line."""
    skew = F.when(is_finite(skew_ppm), F.format_string("skew %+.1f ppm", skew_ppm)).otherwise("skew unknown")
    return F.concat(F.lit("take "), take, F.lit(" ("), microphone, F.lit("): "), skew, F.lit(", "), correction, F.lit(", "), basis, F.coalesce(F.concat(F.lit("; magnitude-only: "), reason), F.lit("")))


def mode_line(mode: Column, groups: Column, with_loopback: Column, sound: Column) -> Column:
    text = (
        F.when(mode == "loopback", F.format_string("loopback-referenced: %d/%d selected groups with loopback takes", with_loopback, groups))
        .when(mode == "emitter", "emitter-referenced: fixed-acoustic-reference takes").otherwise("relative-only: no session-wide absolute origin")
    )
    return F.concat(F.lit("localization mode "), text, F.lit(", sound speed from "), sound)


def position_guidance(position: Column, total: Column) -> Column:
    """What to tell the user before a position (from 0) of so many."""
    first = F.format_string("Position 1 of %d: place the mic(s) at the main listening position first", total)
    return F.when(position == 0, first).otherwise(F.format_string("Move the mic(s) to position %d of %d — stay within ~60 cm of the main listening position", position + 1, total))


def low_level_warning(subjects: Column) -> Column:
    return F.concat(F.lit("Very low measured level on "), subjects, F.lit(" — check mic connection and input gain"))


def drift_discarded(ppm: Column) -> Column:
    return F.format_string("clock drift correction at %.1f ppm was discarded after lag-lock verification failed; the raw capture was kept and needs review", ppm)


def readiness(plans: DataFrame, key: str, plan: str) -> DataFrame:
    """(key, ordinal, line): what a plan's microphones allow, told before anything is recorded."""
    p = F.col(plan)
    mics = p["microphones"]
    placed = F.filter(F.transform(mics, lambda m: m["position_m"]), lambda x: x.isNotNull())
    n, k = F.size(mics), F.size(placed)
    rank = geometry_rank(placed)
    collinear, coplanar = rank < 2, rank == 2
    mode = (
        F.when(p["loopback"].isNotNull(), "loopback-referenced (electrical loopback wired)").when(p["timing_reference"].isNotNull(), "emitter-referenced (surveyed timing emitter)")
        .otherwise("relative-only (no absolute time origin; wire the loopback or survey the timing emitter)")
    )
    lines = F.array(
        F.concat(F.format_string("%d microphones, expecting ", n), mode),
        F.when(k < n, F.format_string("%d/%d microphones unsurveyed; forward solves use surveyed anchors only, the rest wait for inverse/joint solves", n - k, n)),
        F.when(k < 4, F.format_string("%d/4 surveyed microphones, forward positions need at least 4", k)),
        F.when(k >= 4, F.when(collinear, "microphone geometry is collinear, 3D positions impossible").when(coplanar, "microphones are coplanar, positions stay mirror-ambiguous without height diversity")),
    )
    told = F.filter(lines, lambda x: x.isNotNull())
    return plans.select(key, F.posexplode(told).alias("ordinal", "_l")).select(key, "ordinal", F.concat(F.lit("localization readiness: "), "_l").alias("line"))


# ------------------------------------------------------------------ roll-ups


def accepted_sweeps(channels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, num_sweeps): the least number of accepted sweeps of finished channels with quality, 255 at most; null if there is none."""
    own = F.when(F.col("state") == "done", F.col("accepted"))
    return channels.groupBy(*keys).agg(F.least(F.min(own), F.lit(255)).cast("int").alias("num_sweeps"))


def next_empty(channels: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, next, action) of each position: its first empty channel, and what comes after it.

    Nothing while a channel is captured or waits for review; a position without
    empty channels is left for the next one, and the last one is saved.
    """
    found = channels.groupBy(*keys, "position").agg(F.min(F.when(F.col("state") == "empty", F.col(order))).alias("next"))
    whole = channels.groupBy(*keys).agg(F.bool_or(F.col("state").isin("recording", "review")).alias("held"), F.max("position").alias("last"))
    action = F.when(F.col("held"), "hold").when(F.col("next").isNotNull(), "start").when(F.col("position") < F.col("last"), "move").otherwise("save")
    return found.join(whole, keys).select(*keys, "position", "next", action.alias("action"))


def direct_segments(segments: DataFrame, keys: list[str], at: str, energy: str, rate: float) -> DataFrame:
    """Segments of a response from its direct sound on, each against it: the first 65, up to 80 ms, of those with energy.

    The direct sound is the segment of most energy, the first of equal ones. A
    response is a few hundred segments, sorted in its own group.
    """
    by = Window.partitionBy(*keys)
    direct = F.min(F.struct((-F.col(energy)).alias("e"), F.col(at).alias("t"))).over(by)
    rows = segments.withColumn("_d", direct).withColumn("_n", F.row_number().over(by.orderBy(at)))
    ms = F.greatest(F.col(at) - F.col("_d.t"), F.lit(0)) / rate * 1000
    rows = rows.withColumn("relative_ms", ms).where((F.col("_n") <= SEGMENTS) & (F.col("relative_ms") <= SEGMENT_MS) & (F.col(energy) > 0) & (F.col("_d.e") < 0))
    return rows.select(*keys, at, "relative_ms", (10 * F.log10(F.col(energy) / -F.col("_d.e"))).alias("level_db"))


def merged_fragments(files: DataFrame, heads: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Fragments of one session put together: (files, issues).

    ``files`` (key, fragment, name, sha256): one row for each name stays, unless
    fragments disagree on its content. ``heads`` (key, fragment, head, settings):
    a head that two fragments have, or settings other than the first fragment's,
    are issues. Issues are (key, issue, what).
    """
    each = files.groupBy(key, "name").agg(F.min("sha256").alias("sha256"), F.max("sha256").alias("_m"), F.count("*").alias("fragments"))
    kept = each.where(F.col("sha256") == F.col("_m")).select(key, "name", "sha256", "fragments")
    clash = each.where(F.col("sha256") != F.col("_m")).select(key, F.lit("file_collision").alias("issue"), F.col("name").alias("what"))
    twice = heads.groupBy(key, "head").agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated_head").alias("issue"), F.col("head").alias("what"))
    first = heads.groupBy(key).agg(F.min(F.struct("fragment", "settings"))["settings"].alias("_s"))
    other = heads.join(first, key).where(~F.col("settings").eqNullSafe(F.col("_s"))).select(key, F.lit("other_settings").alias("issue"), F.col("fragment").cast("string").alias("what"))
    return kept, clash.unionByName(twice).unionByName(other)


def received(samples: DataFrame, rate: float) -> DataFrame:
    """(channel, received, dropped, incomplete, per_second) of a live source, whose drops are gaps in its sample numbers."""
    sums = samples.groupBy("channel").agg(F.count("*").alias("received"), F.min("idx").alias("_a"), F.max("idx").alias("_b"))
    span = F.col("_b") - F.col("_a") + 1
    return sums.select("channel", "received", (span - F.col("received")).alias("dropped"), (span > F.col("received")).alias("incomplete"), (F.col("received") / (span / F.lit(rate))).alias("per_second"))


def with_positions(rows: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Sources with their estimated place as a struct, null where there is none; of several the least residual counts."""
    best = positions.groupBy(*keys).agg(F.min_by(F.struct("x", "y", "z"), "rms_m").alias("estimated"))
    return rows.join(best, keys, "left")


def preserving_ranges(fresh: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Channel rows set up anew that keep the sweep range the user gave them, where the same row was there before."""
    kept = old.groupBy(*keys).agg(F.first(F.struct("start_hz", "end_hz"), ignorenulls=True).alias("_o"))
    both = fresh.join(kept, keys, "left")
    return both.select(*keys, *[F.coalesce(F.col(f"_o.{c}"), F.col(c)).alias(c) for c in ("start_hz", "end_hz")])


def snapshot(*inputs: Column) -> Column:
    """(json, sha256) of a form's inputs, by which a later change is seen."""
    text = F.to_json(F.struct(*inputs))
    return F.struct(text.alias("json"), F.sha2(text, 256).alias("sha256"))


def projected_response(microphones: Column, files: Column, microphone: Column) -> Column:
    """(file, error): the response of a microphone, which stands where the microphone does in the list of takes."""
    at = F.array_position(microphones, microphone)
    found = F.get(files, (at - 1).cast("int"))
    error = F.when(at.isNull() | (at == 0), "canonical microphone is unavailable").when(found.isNull(), "canonical response filename is unavailable")
    return F.struct(F.when(error.isNull(), found).alias("file"), error.alias("error"))
