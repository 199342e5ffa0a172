"""Times of arrival, ranges and their uncertainties."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .levels import INF, finite, is_finite

#: Sound speed and its uncertainty (m/s) where a plan gives none.
SOUND_SPEED, SOUND_SPEED_SIGMA = 343.0, 3.0
#: Bands (Hz) in which arrivals are looked for, and how wide a sweep must cover them.
ARRIVAL_BAND, ARRIVAL_WIDTH = (2000.0, 8000.0), 2000.0
SUB_BAND, SUB_WIDTH = (20.0, 300.0), 100.0


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def arrival_sigma(confidence_db: Column, lo: Column, hi: Column, rate: Column) -> Column:
    """Cramer-Rao bound of an arrival in samples, 0.1 at least; infinite for what is no band or no confidence."""
    width = (hi - lo) / math.sqrt(12)
    db = F.when(confidence_db == INF, F.lit(100.0)).otherwise(confidence_db)
    snr = F.sqrt(2 * F.pow(F.lit(10.0), db / 10))
    sigma = rate / (2 * math.pi * F.when(width > 0, width) * snr)
    ok = is_finite(db) & is_finite(width) & (width > 0) & (rate > 0)
    return F.when(ok, F.greatest(sigma, F.lit(0.1))).otherwise(F.lit(INF))


def propagation_metres(samples: Column, rate: Column, speed: Column, delay_ms: Column, bias: Column) -> Column:
    """Metres travelled in so many samples, less the source's own delay and the microphone's bias."""
    own = F.coalesce(delay_ms, F.lit(0.0)) * rate / 1000
    return finite((samples - own) * speed / rate - bias)


def range_sigma(sigma_samples: Column, metres: Column, rate: Column, speed: Column, speed_sigma: Column, bias_sigma: Column) -> Column:
    """Uncertainty of a range: its parts add up, as none is known to be independent of the others."""
    whole = speed * sigma_samples / rate + metres * speed_sigma / speed + bias_sigma
    return F.when(is_finite(sigma_samples) & (sigma_samples >= 0), whole)


def longest_range(length: Column, width: Column, height: Column) -> Column:
    """The room's diagonal and 5 m; 50 m for an unknown room."""
    return F.coalesce(F.sqrt(length * length + width * width + height * height) + 5, F.lit(50.0))


def predicted_sweep(first: Column, chirp: Column, sweep: Column, ppm: Column) -> Column:
    """Where the sweep starts in a take whose first chirp is at ``first`` and whose clock is off by ``ppm``."""
    return first + chirp + (sweep - chirp) * (1 + ppm / 1e6)


def overlap(lo: Column, hi: Column, band: tuple[float, float], least: float) -> Column:
    """The part of [lo, hi] inside a band, or null if it is narrower than ``least``."""
    a, b = F.greatest(lo, F.lit(band[0])), F.least(hi, F.lit(band[1]))
    return F.when(b - a >= least, F.struct(a.alias("lo_hz"), b.alias("hi_hz")))


def arrival_band(lo: Column, hi: Column) -> Column:
    return overlap(lo, hi, ARRIVAL_BAND, ARRIVAL_WIDTH)


def sub_band(lo: Column, hi: Column) -> Column:
    return overlap(lo, hi, SUB_BAND, SUB_WIDTH)


def sound_speed(emitter: Column, emitter_sigma: Column, plan: Column, plan_sigma: Column) -> Column:
    """(m_s, sigma, source): the timing emitter's, else the plan's, else the standard one."""

    def known(v: Column, s: Column, label: str) -> Column:
        return F.when(v.isNotNull(), F.struct(v.alias("m_s"), s.alias("sigma"), F.lit(label).alias("source")))

    return F.coalesce(
        known(emitter, emitter_sigma, "timing_reference"), known(plan, plan_sigma, "plan"), known(F.lit(SOUND_SPEED), F.lit(SOUND_SPEED_SIGMA), "default")
    )


def octave_weighted_seconds(lo: Column, hi: Column, bass: Column, nominal: Column) -> Column:
    """Seconds of a sweep that spends ``bass`` on each octave below 100 Hz, half to 1 kHz and a quarter above."""
    octaves = lambda a, b: F.greatest(F.lit(0.0), F.log2(F.least(hi, b) / F.greatest(lo, a)))
    whole = bass * (octaves(F.lit(1e-3), F.lit(100.0)) + 0.5 * octaves(F.lit(100.0), F.lit(1000.0)) + 0.25 * octaves(F.lit(1000.0), F.lit(1e9)))
    return F.when(bass.isNull(), nominal).otherwise(F.greatest(nominal, whole))


def clock_skew_ppm(lag_start: Column, lag_end: Column, spacing: Column, most: float = 5000.0) -> Column:
    """Drift between two markers, or null where it is beyond what a clock does."""
    ppm = (lag_end - lag_start) / F.when(spacing > 0, spacing) * 1e6
    return F.when(F.abs(ppm) <= most, ppm)


def drift_action(ppm: Column, confidence: Column) -> Column:
    size = F.abs(ppm)
    return (
        F.when(ppm.isNull() | confidence.isNull() | (confidence < 0.2), "none")
        .when(size > 2000, "implausible")
        .when(size > 100, "correct_and_advise")
        .when(size > 20, "correct")
        .otherwise("none")
    )


def lag_locked(confidence: Column, least: float) -> Column:
    return is_finite(confidence) & (confidence >= least)


def correction_keeps_lock(raw: Column, fixed: Column, raw_lag: Column, fixed_lag: Column, rate: Column, least: float) -> Column:
    """Whether a drift correction may stay: it must not cost the lock, half the confidence or 20 ms."""
    return (
        F.when(~lag_locked(raw, least), True)
        .when(~lag_locked(fixed, least), False)
        .when(fixed < raw / 2, False)
        .when(F.abs(fixed_lag - raw_lag) > rate * 0.02, False)
        .otherwise(True)
    )


def control_band(lo: Column, hi: Column) -> Column:
    """The part of a sweep in which distortion is judged, 80 Hz to 16 kHz; null without a sweep or such a part."""
    a, b = F.greatest(lo, F.lit(80.0)), F.least(hi, F.lit(16000.0))
    return F.when(lo.isNotNull() & hi.isNotNull() & (a <= b), F.struct(a.alias("lo_hz"), b.alias("hi_hz")))
