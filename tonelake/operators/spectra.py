"""Spectra, filters and phasors of frames.

Frames are rows with arrays. Transforms are taken of whole Arrow batches at a
time, frames of one length together, and come back as arrays of bins, so no
frame is copied for its bins or shifts and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tonelake.functions.levels import wrap_degrees
from tonelake.operators.levels import subtracted_snr

#: Numbers of frames transformed at once, about.
AT_ONCE = 1 << 20


def _alike(columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows of frames of one length, as matrices of bounded size; rows with a null frame, or frames of two lengths, are left out."""
    lengths = [c.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for c in columns]
    same = np.logical_and.reduce([n == lengths[0] for n in lengths]) & (lengths[0] > 0)
    for n in np.unique(lengths[0][same]):
        rows = np.flatnonzero(same & (lengths[0] == n))
        for some in np.array_split(rows, -(-len(rows) * int(n) // AT_ONCE)):
            yield some, [c.take(pa.array(some)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(some), n) for c in columns]


def _per_frame(kind: pa.DataType, sql: str, work: Callable[..., list], *columns: Column) -> Column:
    """A column of what ``work`` makes of matrices of frames, row by row; null for rows without a frame."""

    @arrow_udf(sql)
    def made(batch: pa.Array) -> pa.Array:
        out: list = [None] * len(batch)
        for rows, matrices in _alike(batch.flatten()):
            for k, value in zip(rows, work(*matrices), strict=True):
                out[k] = value
        return pa.array(out, kind)

    return made(F.struct(*columns))


def power(x: Column, n: int) -> Column:
    """Squared size of bins 0..n/2 of the n-point transform of each frame, which has n numbers at most."""
    return _per_frame(pa.list_(pa.float64()), "array<double>", lambda m: list(np.abs(np.fft.rfft(m, n, axis=1)) ** 2), x)


def hann(n: Column | int, i: Column, periodic: bool = False) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / (n if periodic else n - 1))


def windowed(x: Column, periodic: bool = False) -> Column:
    return F.transform(x, lambda e, i: e.cast("double") * hann(F.size(x), i, periodic))


def _sum(x: Column, term) -> Column:  # noqa: ANN001
    return F.aggregate(F.transform(x, term), F.lit(0.0), lambda s, e: s + e)


def bin_parts(x: Column, k: Column, n: Column) -> tuple[Column, Column]:
    """Real and imaginary part of bin k of an n-point transform of x."""
    turn = lambda i: 2 * math.pi * k * i / n
    return _sum(x, lambda e, i: e * F.cos(turn(i))), _sum(x, lambda e, i: -e * F.sin(turn(i)))


def bins(frames: DataFrame, x: str, last: int, n: int) -> DataFrame:
    """``frames`` without x, once for each bin 0..last of its n-point transform: bin, re, im."""
    keys = [c for c in frames.columns if c != x]
    whole = _per_frame(
        pa.list_(pa.struct([("re", pa.float64()), ("im", pa.float64())])), "array<struct<re: double, im: double>>",
        lambda m: [[{"re": v.real, "im": v.imag} for v in row[: last + 1]] for row in np.fft.rfft(m, n, axis=1)], F.col(x),
    )
    return frames.select(*keys, F.posexplode(whole).alias("bin", "_v")).select(*keys, "bin", "_v.re", "_v.im")


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, e: s + e)


def high_fraction(frames: DataFrame, key: str, x: str, cut_hz: float, rate: float, n: int) -> DataFrame:
    """(key, hf_fraction): share of a frame's power at and above a frequency; mirrored bins count twice."""
    cut = math.ceil(cut_hz * n / rate)
    spectrum = frames.select(key, power(windowed(F.col(x), periodic=True), n).alias("p"))
    twice = F.transform("p", lambda p, k: F.when((k > 0) & (k < n // 2), 2.0).otherwise(1.0) * p)
    sums = spectrum.select(key, twice.alias("p")).select(key, _total(F.slice("p", cut + 1, n)).alias("h"), _total(F.col("p")).alias("t"))
    return sums.select(key, F.when(F.col("t") > 0, F.col("h") / F.col("t")).alias("hf_fraction"))


def octave_bands(lo: float, hi: float) -> list[tuple[float, float]]:
    """Bands that double from ``lo`` on, the last one cut at ``hi``."""
    out = []
    while lo < hi:
        out.append((lo, min(2 * lo, hi)))
        lo *= 2
    return out


def band_snr(frames: DataFrame, key: str, signal: str, noise: str, rate: float, n: int, bands: list[tuple[float, float]]) -> DataFrame:
    """(key, band, lo_hz, hi_hz, snr_db): power in each band of a frame above that of its quiet part; bands without a bin are left out."""
    both = frames.select(key, power(F.col(signal), n).alias("s"), power(F.col(noise), n).alias("q"))
    found = []
    for i, (lo, hi) in enumerate(bands):
        a, b = math.ceil(lo * n / rate), min(math.ceil(hi * n / rate), n // 2 + 1)
        if a < b:
            s, q = (_total(F.slice(c, a + 1, b - a)) for c in ("s", "q"))
            found.append(F.struct(F.lit(i).alias("band"), F.lit(lo).alias("lo_hz"), F.lit(hi).alias("hi_hz"), subtracted_snr(s, q).alias("snr_db")))
    return both.select(key, F.explode(F.array(*found)).alias("b")).select(key, "b.*")


def coherence(pairs: DataFrame, key: str, x: str, y: str, segment: int, step: int, segments: int) -> DataFrame:
    """(key, bin, coherence): magnitude-squared coherence of two arrays over overlapping Hann segments."""
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / (segment - 1))

    def squared(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        parts = [np.lib.stride_tricks.sliding_window_view(m, segment, axis=1)[:, : step * segments : step] * taper for m in (a, b)]
        fa, fb = (np.fft.rfft(p, axis=2) for p in parts)
        cross, whole = (fa * fb.conj()).sum(axis=1), (np.abs(fa) ** 2).sum(axis=1) * (np.abs(fb) ** 2).sum(axis=1)
        return list(np.clip(np.divide(np.abs(cross) ** 2, whole, out=np.zeros(whole.shape), where=whole > 0), 0, 1))

    found = _per_frame(pa.list_(pa.float64()), "array<double>", squared, F.col(x), F.col(y))
    return pairs.select(key, F.posexplode(found).alias("bin", "coherence"))


def welch(frames: DataFrame, key: str, x: str, rate: float, segment: int, step: int) -> DataFrame:
    """(key, frequency_hz, level_db): mean one-sided spectrum of Hann segments, where a full-scale sine on a bin is 0 dB."""
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / (segment - 1))

    def mean(m: np.ndarray) -> list[np.ndarray]:
        if m.shape[1] < segment:
            return [np.zeros(0)] * len(m)
        parts = np.lib.stride_tricks.sliding_window_view(m, segment, axis=1)[:, ::step] * taper
        return list((np.abs(np.fft.rfft(parts, axis=2)) ** 2).mean(axis=1) * (2 / taper.sum()) ** 2)

    found = frames.select(key, F.posexplode(_per_frame(pa.list_(pa.float64()), "array<double>", mean, F.col(x))).alias("bin", "p"))
    return found.select(key, (F.col("bin") * rate / segment).alias("frequency_hz"), F.when(F.col("p") > 0, 10 * F.log10("p")).alias("level_db"))


def bandpass_taps(rate: float, lo: float, hi: float, taps: int) -> list[float]:
    """Linear-phase taps: the difference of two low passes under a symmetric Hann window."""
    n = max(3, taps) | 1
    mid = n // 2
    low = lambda f, k: 2 * f / rate if k == 0 else math.sin(2 * math.pi * f / rate * k) / (math.pi * k)
    return [(low(hi, i - mid) - low(lo, i - mid)) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))) for i in range(n)]


def filtered(x: Column, taps: list[float]) -> Column:
    """x through a filter of odd length, centred, with zeros beyond its edges."""
    mid, h = len(taps) // 2, F.array(*[F.lit(t) for t in taps])
    padded = F.concat(F.array_repeat(F.lit(0.0), mid), F.transform(x, lambda e: e.cast("double")), F.array_repeat(F.lit(0.0), mid))
    return F.transform(
        F.sequence(F.lit(1), F.size(x)),
        lambda i: F.aggregate(F.zip_with(F.slice(padded, i, len(taps)), h, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e),
    )


def phasor(x: Column, hz: float, rate: float) -> Column:
    """(amplitude, phase_deg) of a steady tone in x."""
    turn = lambda i: 2 * math.pi * hz * i / rate
    re = _sum(x, lambda e, i: e.cast("double") * F.cos(turn(i))) * 2 / F.size(x)
    im = _sum(x, lambda e, i: -e.cast("double") * F.sin(turn(i))) * 2 / F.size(x)
    return F.struct(F.sqrt(re * re + im * im).alias("amplitude"), F.degrees(F.atan2(im, re)).alias("phase_deg"))


def phase_difference(a: Column, b: Column) -> Column:
    return wrap_degrees(a - b)


def correlation_lag(pairs: DataFrame, key: str, x: str, y: str, most: int) -> DataFrame:
    """(key, lag, confidence): the shift of y against x, up to ``most`` samples, with the largest normalised correlation.

    Of equal shifts the least counts; silence has no confidence.
    """

    def shifted(a: np.ndarray, b: np.ndarray) -> list[dict]:
        n = a.shape[1]
        size = 1 << (2 * n - 1).bit_length()
        whole = np.fft.irfft(np.fft.rfft(a, size, axis=1).conj() * np.fft.rfft(b, size, axis=1), size, axis=1)
        lags = np.arange(-min(most, n - 1), min(most, n - 1) + 1)
        norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        r = whole[:, lags] / np.where(norm > 0, norm, 1)[:, None]
        best = (r >= r.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)  # the transform rounds equal ones apart
        return [{"lag": int(lags[k]), "confidence": float(row[k]) if e > 0 else None} for row, k, e in zip(r, best, norm, strict=True)]

    found = _per_frame(pa.struct([("lag", pa.int32()), ("confidence", pa.float64())]), "struct<lag: int, confidence: double>", shifted, F.col(x), F.col(y))
    return pairs.select(key, found.alias("m")).select(key, "m.lag", "m.confidence")
