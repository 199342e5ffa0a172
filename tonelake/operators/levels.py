"""Levels, clipping and signal-to-noise evidence.

Takes come as rows with an array of samples, or as long rows (key, idx, x).
Arrays are reduced in place by higher-order functions, so a take's levels cost
no shuffle; long rows are aggregated, which combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.levels import amplitude_db, gain_advice, is_finite, level_zone, power_db

#: Samples in a clipping block, and in the shortest one that counts.
CLIP_BLOCK, CLIP_TAIL = 2048, 512
#: Highest share (percent) of clipped samples in a block, and overall, before a take fails or warns.
CLIP_FAIL, CLIP_WARN = 30.0, 0.1
#: Signal-to-noise (dB) below which a take is not to be trusted.
LEAST_SNR = 30.0


def array_power(x: Column) -> Column:
    """Mean square of an array; null if it is empty or holds a null or non-finite sample."""
    total = F.aggregate(x, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return F.when((F.size(x) > 0) & F.forall(x, is_finite), total / F.size(x))


def array_peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda e: F.abs(e.cast("double"))))


def array_count(x: Column, least: float) -> Column:
    """Samples whose magnitude is ``least`` or more."""
    return F.size(F.filter(x, lambda e: F.abs(e.cast("double")) >= least))


def part(x: Column, start: Column, end: Column) -> Column:
    """x[start:end], or null where x does not reach that far; nothing is cut short."""
    return F.when((start >= 0) & (end >= start) & (F.size(x) >= end), F.slice(x, start + 1, end - start))


def subtracted_snr(signal: Column, noise: Column) -> Column:
    """dB of the power above the noise's, against it; null without noise or without anything above it."""
    return F.when((noise > 0) & (signal > noise), 10 * F.log10((signal - noise) / noise))


def take_levels(takes: DataFrame, samples: str, chirp: int) -> DataFrame:
    """Levels and broadband evidence of each take whose first marker is at sample ``chirp``.

    The second quarter of what comes before the marker is the noise.
    """
    x = F.col(samples)
    noise = array_power(part(x, F.lit(chirp // 4), F.lit(chirp // 2)))
    signal = array_power(part(x, F.lit(chirp), F.size(x)))
    return (
        takes.withColumns({"power": array_power(x), "peak": array_peak(x), "noise": noise, "signal": signal})
        .withColumns(
            {
                "peak_dbfs": amplitude_db(F.col("peak")), "rms_dbfs": power_db(F.col("power")),
                "full_scale": array_count(x, 1.0), "meter_clipped": array_count(x, 0.999),
                "snr_db": subtracted_snr(F.col("signal"), F.col("noise")),
            }
        )
        .withColumns({"zone": level_zone(F.col("peak_dbfs")), "advice": gain_advice(F.col("peak_dbfs"))})
    )


def clip_statistics(samples: DataFrame, keys: list[str], idx: str, x: str, threshold: float = 0.999, block: int = CLIP_BLOCK, tail: int = CLIP_TAIL) -> DataFrame:
    """(keys, samples, clipped, percent, worst_block_percent) of long rows.

    A last block of fewer than ``tail`` samples does not count for the worst.
    """
    hit = (F.abs(F.col(x)) >= threshold).cast("long")
    blocks = samples.groupBy(*keys, F.floor(F.col(idx) / block).alias("block")).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"))
    return blocks.groupBy(*keys).agg(
        F.sum("n").alias("samples"),
        F.sum("hits").alias("clipped"),
        (100.0 * F.sum("hits") / F.sum("n")).alias("percent"),
        F.coalesce(F.max(F.when(F.col("n") >= tail, 100.0 * F.col("hits") / F.col("n"))), F.lit(0.0)).alias("worst_block_percent"),
    )


def clip_verdict(percent: Column, worst: Column) -> Column:
    return F.when(worst > CLIP_FAIL, "fail").when(percent > CLIP_WARN, "warning").otherwise("pass")


def long_levels(samples: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, samples, peak, rms, clipped, all_finite) of long rows; a non-finite sample counts as clipped."""
    v, ok = F.col(x).cast("double"), is_finite(F.col(x))
    return samples.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.max(F.when(ok, F.abs(v))).alias("peak"),
        F.sqrt(F.avg(F.when(ok, v * v))).alias("rms"),
        F.sum((~ok | (F.abs(v) >= 0.999)).cast("long")).alias("clipped"),
        F.every(ok).alias("all_finite"),
    )


def ratio_snr(samples: DataFrame, keys: list[str], x: str, active: Column, silent: Column) -> DataFrame:
    """(keys, snr_db): dB of the active part's RMS against the silent part's; null if either is none or zero."""
    v = F.col(x).cast("double")
    rms = samples.groupBy(*keys).agg(F.sqrt(F.avg(F.when(active, v * v))).alias("a"), F.sqrt(F.avg(F.when(silent, v * v))).alias("s"))
    ratio = F.when((F.col("a") > 0) & (F.col("s") > 0), 20 * F.log10(F.col("a") / F.when(F.col("s") > 0, F.col("s"))))
    return rms.select(*keys, ratio.alias("snr_db"))


def stable_window(samples: DataFrame, keys: list[str], idx: str, x: str, guard: int) -> DataFrame:
    """(keys, rms, peak, clipped) without the first and last ``guard`` samples: what a level calibration reads."""
    ends = samples.groupBy(*keys).agg(F.max(idx).alias("last"))
    v = F.col(x).cast("double")
    inner = samples.join(ends, keys).where((F.col(idx) >= guard) & (F.col(idx) <= F.col("last") - guard))
    return inner.groupBy(*keys).agg(F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"), F.max((F.abs(v) >= 1).cast("int")).alias("clipped"))


def spl_offset(meter_db: Column, rms: Column) -> Column:
    """What to add to dBFS for dB SPL; null for a silent or missing reading."""
    return F.when(is_finite(meter_db) & (rms > 0), meter_db - 20 * F.log10(rms))


def findings(takes: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, kind, outcome, value, threshold, reason): what a take's levels say, in order.

    Missing evidence is an outcome of its own, never a pass.
    """

    def finding(kind: str, outcome: Column, value: Column, threshold: float, reason: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), outcome.alias("outcome"), value.cast("double").alias("value"),
            F.lit(threshold).alias("threshold"), reason.cast("string").alias("reason"),
        )

    none = F.lit(None)
    snr = F.col("snr_db")
    rows = F.array(
        F.when(F.col("full_scale") > 0, finding("clipping", F.lit("warning"), F.col("full_scale"), 1.0, none)),
        finding(
            "broadband_snr",
            F.when(snr.isNull(), "unknown").when(snr >= LEAST_SNR, "pass").otherwise("warning"),
            snr, LEAST_SNR,
            F.when(snr.isNull(), F.when(F.coalesce(F.col("noise"), F.lit(0.0)) <= 0, "silent").otherwise("below_noise")),
        ),
    )
    return takes.select(key, F.posexplode(F.filter(rows, lambda r: r.isNotNull())).alias("ordinal", "f")).select(key, "ordinal", "f.*")


def quality_passed(magnitude: Column, clipped: Column, broadband: Column, bands: Column) -> Column:
    """Whether every piece of evidence is there and good; without bands nothing passes."""
    every = (F.size(bands) > 0) & F.forall(bands, lambda b: F.coalesce(b >= LEAST_SNR, F.lit(False)))
    return F.coalesce(magnitude & (clipped == 0) & (broadband >= LEAST_SNR) & every, F.lit(False))
