"""What speaks for or against a take: one row type for findings of every kind, in the order in which they are told.

A finding has a policy, a metric with its unit and method, what was measured
against which limit, a status, and what to do next. Missing evidence is a
finding of its own with the status ``unknown`` and its reason, never a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.acoustics import control_band
from tonelake.functions.levels import is_finite

# Limits of the policies, and the dB below a band's peak beyond which distortion is not judged.
MOST_THD, LEAST_SINGLE_SNR, LEAST_COHERENT_SNR, GATE_DB, LEAST_HARMONIC_DB = 10.0, 10.0, 30.0, 20.0, -120.0

# Texts that users see.
CLIPPED = "%d captured samples reached full scale"
CLIPPED_COHERENT = "input reached full scale; reduce input or playback gain and repeat"
REDUCE = "reduce playback or input gain"
REDUCE_COHERENT = "reduce input or playback gain and repeat"
THD_NO_SWEEP = ("valid log-sweep harmonic impulse responses were not available", "use a valid swept-sine capture for harmonic distortion analysis", "harmonic distortion is unavailable; no THD value was measured")
THD_NO_BINS = ("no usable fundamental bins were available above the response gate", "check sweep level and response coverage, then repeat", "harmonic distortion is unavailable in the usable response band")
THD_TOLD = "peak harmonic distortion %.1f%% at %.0f Hz %s the 10%% advisory threshold"
THD_NEXT = "lower playback level and re-run"
SINGLE_TOLD = "single-take broadband SNR %.1f dB %s the 10 dB advisory threshold"
SINGLE_NEXT = "raise playback level or reduce background noise"
SINGLE_UNKNOWN = ("quiet or active signal window is unavailable, silent, or non-finite", "capture a quiet pre-sweep interval and a valid sweep", "single-take broadband SNR is unavailable")
MARKERS_UNKNOWN = (
    "timing markers were unavailable or could not be fitted", "record start and end timing markers, then repeat",
    "timing markers unavailable: magnitude uses the uncorrected device clock; drift may smear the response and coherent use is forbidden",
)
BAND_PASS = "SNR in %.1f–%.1f Hz meets the 30 dB coherent-use threshold"
BAND_WARNING = "SNR in %.1f–%.1f Hz is below 30 dB; reduce room noise and repeat"
BAND_UNKNOWN = "SNR in %.1f–%.1f Hz is unavailable; no quality acceptance for this band"
BAND_REASON = "quiet or sweep window was silent, missing, or below the noise power"
BAND_NEXT = "reduce room noise and capture a valid quiet interval"
BANDS_NEXT = "capture complete quiet and sweep windows, then repeat"
BANDS_FAILED = "frequency-dependent SNR unavailable: "
QUIETER = "reduce room noise and repeat"
BROAD_PASS = "broadband SNR meets the 30 dB coherent-use threshold"
BROAD_WARNING = "broadband SNR below 30 dB; reduce room noise and repeat"
BROAD_UNKNOWN = (
    "missing quiet interval, digital silence, or signal below the noise power", "capture a quiet interval and a valid sweep, then repeat",
    "broadband SNR unavailable: missing quiet interval, digital silence, or signal below noise",
)

_METHODS = {"clipping": ("count", "full_scale_sample_count", "equal_to"), "thd": ("percent", "farina_harmonic_impulse_response", "at_most"), "broadband_snr": ("decibels", "broadband_power_ratio", "at_least"), "band_snr": ("decibels", "noise_subtracted_band_power_ratio", "at_least"), "timing_markers": ("samples", "timing_marker_fit", None)}


def finding(policy: str, metric: str, status: Column, message: Column, measured: Column | None = None, limit: float | None = None, reason: Column | None = None, advice: Column | None = None, band: tuple[Column, Column] | None = None) -> Column:
    """One finding as a struct; fields that it has not are null."""
    unit, method, comparison = _METHODS[metric]
    text = lambda v: (F.lit(None) if v is None else v if isinstance(v, Column) else F.lit(v)).cast("string")
    number = lambda v: (F.lit(None) if v is None else v if isinstance(v, Column) else F.lit(v)).cast("double")
    low, high = band or (None, None)
    fields = {
        "policy": text(policy), "metric": text(metric), "status": status.cast("string"), "measured": number(measured), "unit": text(unit), "low_hz": number(low), "high_hz": number(high), "method": text(method),
        "comparison": text(comparison if limit is not None else None), "threshold": number(limit), "unknown_reason": text(reason), "recommendation": text(advice), "message": message.cast("string"),
    }
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def distortion_peak(curve: Column, band: Column) -> Column:
    """(thd_percent, frequency_hz) of the most distorted point of a curve in a band, where the level is within 20 dB of the band's highest; the highest of equal ones."""
    inside = F.filter(curve, lambda p: (p["frequency_hz"] >= band["lo_hz"]) & (p["frequency_hz"] <= band["hi_hz"]))

    def worst(points: Column) -> Column:
        top = F.array_max(F.transform(F.filter(points, lambda p: is_finite(p["spl_db"])), lambda p: p["spl_db"]))
        loud = lambda gate: F.filter(points, lambda p: is_finite(p["thd_percent"]) & (p["spl_db"] >= gate))
        told = lambda gate: F.array_max(F.transform(loud(gate), lambda p: F.struct(p["thd_percent"].alias("thd_percent"), p["frequency_hz"].alias("frequency_hz"))))
        return F.get(F.transform(F.array(top - GATE_DB), told), F.lit(0))

    # arrays of one, so that the points and the gate are worked out once and not for each point
    return F.get(F.transform(F.array(inside), worst), F.lit(0))


def harmonics_told(harmonics: Column, points: Column) -> Column:
    """Whether there are four harmonic curves as long as the response, finite, and not all next to nothing."""
    first = F.slice(harmonics, 1, 4)
    whole = F.forall(first, lambda h: (F.size(h) == points) & F.forall(h, is_finite))
    return F.coalesce((F.size(harmonics) >= 4) & whole & F.exists(first, lambda h: F.exists(h, lambda v: v > LEAST_HARMONIC_DB)), F.lit(False))


def _rows(takes: DataFrame, keys: list[str], found: Column) -> DataFrame:
    return takes.select(*keys, F.posexplode(F.filter(found, lambda f: f.isNotNull())).alias("ordinal", "_f")).select(*keys, "ordinal", "_f.*")


def sweep_findings(takes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ordinal, finding) of takes as they are recorded: clipping if there is any, distortion, and noise of single takes.

    ``takes`` has clipped, sweep_lo and sweep_hi (null without a sweep), curve
    (frequency_hz, spl_db, thd_percent), harmonics_available, active_power,
    quiet_power and single_take.
    """
    c, policy = F.col, "sweep_analysis"
    # what is used more than once is a column of its own, worked out once a row
    ratio = F.try_divide(c("active_power"), c("quiet_power"))
    takes = takes.withColumns({
        "_band": control_band(c("sweep_lo"), c("sweep_hi")),
        "_snr": F.when((c("active_power") > 0) & (c("quiet_power") > 0) & is_finite(ratio) & (ratio > 0), 10 * F.log10(ratio)),
    })
    takes = takes.withColumn("_worst", distortion_peak(c("curve"), c("_band")))
    band, worst, snr = c("_band"), c("_worst"), c("_snr")
    swept = c("sweep_lo").isNotNull() & c("sweep_hi").isNotNull() & F.coalesce("harmonics_available", F.lit(False))
    edges = (band["lo_hz"], band["hi_hz"])
    thd, hz = worst["thd_percent"], worst["frequency_hz"]
    good = thd <= MOST_THD
    unknown = lambda kind, limit, texts, **more: finding(more.pop("policy", policy), kind, F.lit("unknown"), F.lit(texts[2]), None, limit, F.lit(texts[0]), F.lit(texts[1]), **more)
    told = finding(policy, "thd", F.when(good, "pass").otherwise("warning"), F.format_string(THD_TOLD, thd, hz, F.when(good, "meets").otherwise("exceeds")), thd, MOST_THD, None, F.when(~good, THD_NEXT), edges)
    distorted = F.when(~swept, unknown("thd", MOST_THD, THD_NO_SWEEP, band=edges)).when(thd.isNull(), unknown("thd", MOST_THD, THD_NO_BINS, band=edges)).otherwise(told)
    quiet = snr >= LEAST_SINGLE_SNR
    heard = finding("single_take", "broadband_snr", F.when(quiet, "pass").otherwise("warning"), F.format_string(SINGLE_TOLD, snr, F.when(quiet, "meets").otherwise("is below")), snr, LEAST_SINGLE_SNR, None, F.when(~quiet, SINGLE_NEXT))
    single = F.when(snr.isNull(), unknown("broadband_snr", LEAST_SINGLE_SNR, SINGLE_UNKNOWN, policy="single_take")).otherwise(heard)
    clipped = finding(policy, "clipping", F.lit("warning"), F.format_string(CLIPPED, c("clipped")), c("clipped"), 0.0, None, F.lit(REDUCE))
    return _rows(takes, keys, F.array(F.when(c("clipped") > 0, clipped), distorted, F.when(F.coalesce("single_take", F.lit(False)), single)))


def coherent_findings(takes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ordinal, finding) of takes on a common clock: clipping, then markers or each band's noise, then broadband noise.

    ``takes`` has clipped, corrected (whether it is on the common clock), bands
    (low_hz, high_hz, snr_db), bands_issue (why there are none) and snr_db,
    which counts for corrected takes only.
    """
    c, policy = F.col, "coherent_capture"
    corrected = F.coalesce("corrected", F.lit(False))
    clipped = finding(policy, "clipping", F.lit("warning"), F.lit(CLIPPED_COHERENT), c("clipped"), 0.0, None, F.lit(REDUCE_COHERENT))
    markers = finding(policy, "timing_markers", F.lit("unknown"), F.lit(MARKERS_UNKNOWN[2]), None, None, F.lit(MARKERS_UNKNOWN[0]), F.lit(MARKERS_UNKNOWN[1]))

    def band(b: Column) -> Column:
        snr, edges = b["snr_db"], (b["low_hz"], b["high_hz"])
        good = snr >= LEAST_COHERENT_SNR
        message = F.when(snr.isNull(), F.format_string(BAND_UNKNOWN, *edges)).when(good, F.format_string(BAND_PASS, *edges)).otherwise(F.format_string(BAND_WARNING, *edges))
        status = F.when(snr.isNull(), "unknown").when(good, "pass").otherwise("warning")
        return finding(policy, "band_snr", status, message, snr, LEAST_COHERENT_SNR, F.when(snr.isNull(), BAND_REASON), F.when(snr.isNull(), BAND_NEXT).when(~good, QUIETER), edges)

    failed = finding(policy, "band_snr", F.lit("unknown"), F.concat(F.lit(BANDS_FAILED), "bands_issue"), None, LEAST_COHERENT_SNR, c("bands_issue"), F.lit(BANDS_NEXT))
    snr = F.when(corrected, c("snr_db"))
    good = snr >= LEAST_COHERENT_SNR
    heard = finding(policy, "broadband_snr", F.when(good, "pass").otherwise("warning"), F.when(good, BROAD_PASS).otherwise(BROAD_WARNING), snr, LEAST_COHERENT_SNR, None, F.when(~good, QUIETER))
    unheard = finding(policy, "broadband_snr", F.lit("unknown"), F.lit(BROAD_UNKNOWN[2]), None, LEAST_COHERENT_SNR, F.lit(BROAD_UNKNOWN[0]), F.lit(BROAD_UNKNOWN[1]))
    bands = F.when(~corrected, F.array(markers)).when(c("bands_issue").isNotNull(), F.array(failed)).otherwise(F.transform(c("bands"), band))
    return _rows(takes, keys, F.concat(F.array(F.when(c("clipped") > 0, clipped)), bands, F.array(F.when(snr.isNull(), unheard).otherwise(heard))))


def issues(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, issues, passed): the messages of all findings that are no pass, in their order; a take without any has passed."""
    told = F.array_sort(F.collect_list(F.when(F.col("status") != "pass", F.struct("ordinal", "message"))))
    rows = findings.groupBy(*keys).agg(F.transform(told, lambda t: t["message"]).alias("issues"))
    return rows.withColumn("passed", F.size("issues") == 0)
