"""Whole-take estimates: lags, clocks, responses and decay.

A take is one group of block rows, at most 16 million samples (64 MB), and
every group is worked on by itself. What is left to numpy is one transform or
one fit per take; selecting, pairing and judging takes is done in columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.functions.acoustics import clock_skew_ppm


def _joined(rows: pd.DataFrame, column: str) -> np.ndarray:
    return np.concatenate([np.asarray(x, np.float64) for x in rows.sort_values("block")[column]])


def correlation(reference: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Normalised correlation of a take with a reference for every lag at which the reference fits."""
    n = 1 << int(np.ceil(np.log2(len(reference) + len(take))))
    raw = np.fft.irfft(np.fft.rfft(take, n) * np.conj(np.fft.rfft(reference, n)), n)[: len(take) - len(reference) + 1]
    power = np.concatenate([[0.0], np.cumsum(take * take)])
    local = power[len(reference) :] - power[: len(raw)]
    # a stretch of next to nothing is like nothing
    return raw / np.sqrt(np.maximum(local, 1e-3 * max(local.max(), 1e-30)) * max(reference @ reference, 1e-30))


def refined(x: np.ndarray, k: int) -> float:
    """Place of a maximum between samples, from the parabola through it and its neighbours."""
    if not 0 < k < len(x) - 1:
        return float(k)
    a, b, c = x[k - 1], x[k], x[k + 1]
    return k + (0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0)


def resampled(x: np.ndarray, at: np.ndarray, taps: int = 32) -> np.ndarray:
    """x at places between its samples: a sinc under a Hann window of ``taps`` samples, zeros beyond the ends."""
    padded = np.pad(x, taps)
    out = np.empty(len(at), np.float32)
    for i in range(0, len(at), 1 << 14):
        whole = np.floor(at[i : i + (1 << 14)]).astype(np.int64)
        d = at[i : i + (1 << 14), None] - whole[:, None] - np.arange(1 - taps // 2, taps // 2 + 1)
        weight = np.sinc(d) * (0.5 + 0.5 * np.cos(2 * np.pi * d / taps)) * (np.abs(d) <= taps / 2)
        out[i : i + (1 << 14)] = (padded[whole[:, None] + np.arange(1 - taps // 2, taps // 2 + 1) + taps] * weight).sum(axis=1)
    return out


def marker_lags(takes: DataFrame, keys: list[str], reference: np.ndarray, windows: list[tuple[int, int]], least: float = 0.25) -> DataFrame:
    """(keys, marker, lag, confidence, reason): where a reference is in each window [start, end) of each take.

    ``takes`` has block and samples. Without a clear enough maximum, or with a
    window that the take does not fill, the lag is null and the reason is not.
    """
    kinds = {f.name: f.dataType.simpleString() for f in takes.select(*keys).schema.fields}
    schema = ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", marker int, lag double, confidence double, reason string"

    def found(group: pd.DataFrame) -> pd.DataFrame:
        x, out = _joined(group, "samples"), []
        for marker, (start, end) in enumerate(windows):
            part = x[start:end]
            if len(part) < end - start or len(part) < len(reference) or not np.isfinite(part).all():
                out.append((marker, None, None, "window_missing"))
                continue
            r = correlation(reference, part)
            k = int(np.argmax(np.abs(r)))
            sure = float(abs(r[k]))
            out.append((marker, start + refined(np.abs(r), k), sure, None) if sure >= least else (marker, None, sure, "low_confidence"))
        return pd.DataFrame([(*[group[k].iloc[0] for k in keys], *row) for row in out], columns=[*keys, "marker", "lag", "confidence", "reason"])

    return takes.select(*keys, "block", "samples").groupBy(*keys).applyInPandas(found, schema)


def clock_fits(lags: DataFrame, keys: list[str], spacing: int) -> DataFrame:
    """(keys, offset, skew_ppm, reason) from the lags of two markers that are ``spacing`` samples apart when sent."""
    both = lags.groupBy(*keys).agg(
        F.max(F.when(F.col("marker") == 0, F.col("lag"))).alias("first"), F.max(F.when(F.col("marker") == 1, F.col("lag"))).alias("second"), F.min("reason").alias("why")
    )
    ppm = clock_skew_ppm(F.lit(float(spacing)), F.col("second") - F.col("first"), F.lit(float(spacing)))
    reason = F.when(F.col("first").isNull() | F.col("second").isNull(), F.coalesce("why", F.lit("marker_missing"))).when(ppm.isNull(), "clock_outlier")
    return both.select(*keys, F.when(reason.isNull(), F.col("first")).alias("offset"), F.when(reason.isNull(), ppm).alias("skew_ppm"), reason.alias("reason"))


def on_common_clock(takes: DataFrame, keys: list[str], fits: DataFrame, frames: int) -> DataFrame:
    """Takes resampled to the stimulus' clock: sample k is what the take has at offset + k (1 + ppm / 10**6).

    Takes that were refused or do not reach far enough are left out.
    """
    fitted = takes.join(fits.where("reason is null").select(*keys, "offset", "skew_ppm"), keys)
    kinds = {f.name: f.dataType.simpleString() for f in takes.select(*keys).schema.fields}
    schema = ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", block int, samples array<float>"

    def moved(group: pd.DataFrame) -> pd.DataFrame:
        x = _joined(group, "samples")
        at = group["offset"].iloc[0] + np.arange(frames) * (1 + group["skew_ppm"].iloc[0] / 1e6)
        if at[0] < 0 or at[-1] > len(x) - 1:
            return pd.DataFrame(columns=[*keys, "block", "samples"])
        y = resampled(x, at)
        return pd.DataFrame([(*[group[k].iloc[0] for k in keys], b, y[i : i + 2048]) for b, i in enumerate(range(0, frames, 2048))], columns=[*keys, "block", "samples"])

    return fitted.select(*keys, "block", "samples", "offset", "skew_ppm").groupBy(*keys).applyInPandas(moved, schema)


def responses(takes: DataFrame, keys: list[str], stimulus: np.ndarray, rate: int, length: int, floor: float = 1e-3) -> DataFrame:
    """(keys, direct_ms, rt60_ms, c50_db, c80_db): decay of the impulse response that each take shows.

    The take is divided by the stimulus where that has power (Wiener's way), and
    the energy that is still to come is followed from 5 to 25 dB below the whole.
    """
    kinds = {f.name: f.dataType.simpleString() for f in takes.select(*keys).schema.fields}
    schema = ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", direct_ms double, rt60_ms double, c50_db double, c80_db double"

    def measured(group: pd.DataFrame) -> pd.DataFrame:
        x = _joined(group, "samples")
        n = 1 << int(np.ceil(np.log2(len(x) + len(stimulus))))
        s = np.fft.rfft(stimulus, n)
        h = np.fft.irfft(np.fft.rfft(x, n) * np.conj(s) / (np.abs(s) ** 2 + floor * np.max(np.abs(s)) ** 2), n)[:length]
        direct = int(np.argmax(np.abs(h)))
        energy = h[direct:] ** 2
        left = np.cumsum(energy[::-1])[::-1]
        db = 10 * np.log10(np.maximum(left / max(left[0], 1e-300), 1e-30))
        span = np.flatnonzero((db <= -5) & (db >= -25))
        slope = np.polyfit(span / rate, db[span], 1)[0] if len(span) > 8 else 0.0
        early = lambda ms: (lambda a, b: 10 * np.log10(a / b) if a > 0 and b > 0 else None)(energy[: int(rate * ms / 1000)].sum(), energy[int(rate * ms / 1000) :].sum())
        row = (*[group[k].iloc[0] for k in keys], 1000 * direct / rate, -60000 / slope if slope < 0 else None, early(50), early(80))
        return pd.DataFrame([row], columns=[*keys, "direct_ms", "rt60_ms", "c50_db", "c80_db"])

    return takes.select(*keys, "block", "samples").groupBy(*keys).applyInPandas(measured, schema)


def trusted(takes: DataFrame, group: list[str], value: str, most: float = 3.0) -> DataFrame:
    """Takes with ``accepted``: those within ``most`` scaled median deviations of their group's median."""
    mid = takes.groupBy(*group).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    with_mid = takes.join(mid, group)
    spread = with_mid.groupBy(*group).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("_s"))
    limit = F.greatest(F.col("_s") * 1.4826 * most, F.lit(1e-9))
    return with_mid.join(spread, group).withColumn("accepted", F.coalesce(F.abs(F.col(value) - F.col("_m")) <= limit, F.lit(False))).drop("_m", "_s")
