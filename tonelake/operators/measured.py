"""What a whole recording shows: its response and distortion, drift put right, sets of takes, reflections, intelligibility.

A take is one group of block rows, at most 16 million samples; impulse
responses are arrays. numpy transforms one take at a time, and takes are
joined, compared and judged in columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.acoustics import correction_keeps_lock, drift_action
from tonelake.operators.takes import _joined, correlation, marker_lags, refined, resampled, trusted
from tonelake.sources.staging import checkpointed

#: A quiet stretch shorter than this tells nothing of a noise floor; confidence at which a lag is one.
QUIET = 2048
LOCK = 0.2
#: Fixed values of IEC 60268-16: octave bands, modulations, and weights and redundancies of male speech.
STI_BANDS = (125, 250, 500, 1000, 2000, 4000, 8000)
STI_MODULATIONS = (0.63, 0.8, 1.0, 1.25, 1.6, 2.0, 2.5, 3.15, 4.0, 5.0, 6.3, 8.0, 10.0, 12.5)
STI_WEIGHTS = (0.085, 0.127, 0.230, 0.233, 0.309, 0.224, 0.173)
STI_REDUNDANCIES = (0.085, 0.078, 0.065, 0.011, 0.047, 0.095)


def _per_take(takes: DataFrame, keys: list[str], schema: str, work: Callable[[np.ndarray, pd.DataFrame], list[tuple]], *extra: str) -> DataFrame:
    """Rows that ``work`` makes of each take's samples and of its rows, which have ``extra`` columns too."""
    kinds = {f.name: f.dataType.simpleString() for f in takes.select(*keys).schema.fields}
    whole = ", ".join([*(f"{k} {t}" for k, t in kinds.items()), schema])
    names = [*keys, *(c.strip().split(" ")[0] for c in _fields(schema))]

    def made(group: pd.DataFrame) -> pd.DataFrame:
        rows = work(_joined(group, "samples"), group)
        return pd.DataFrame([(*[group[k].iloc[0] for k in keys], *r) for r in rows], columns=names)

    return takes.select(*keys, "block", "samples", *extra).groupBy(*keys).applyInPandas(made, whole)


def _fields(schema: str) -> list[str]:
    """Fields of a schema's text: commas inside angle brackets part nothing."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def at_rate(takes: DataFrame, keys: list[str], source: int, target: int, cutoff: float = 0.9, taps: int = 128) -> DataFrame:
    """(keys, block, samples): takes at another rate, ceil(n target / source) samples from the same instant on.

    A sinc under a squared Blackman-Harris window; ``cutoff`` is its share of
    the lower of both Nyquist frequencies.
    """
    share = cutoff * min(1.0, target / source)
    half = math.ceil(taps / 2 / min(1.0, target / source))
    offsets = np.arange(1 - half, half + 1)

    def converted(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if source == target:
            y = x
        else:
            padded, n = np.pad(x, half), math.ceil(len(x) * target / source)
            y = np.empty(n)
            for i in range(0, n, 1 << 12):
                at = np.arange(i, min(i + (1 << 12), n)) * source / target
                whole = np.floor(at).astype(np.int64)
                d = at[:, None] - whole[:, None] - offsets
                t = np.clip(d / half, -1, 1) * np.pi
                window = (0.35875 + 0.48829 * np.cos(t) + 0.14128 * np.cos(2 * t) + 0.01168 * np.cos(3 * t)) ** 2
                weight = np.sinc(share * d) * window
                y[i : i + len(at)] = (padded[whole[:, None] + offsets + half] * weight).sum(axis=1) / weight.sum(axis=1)
        return [(b, y[i : i + 2048].astype(np.float32)) for b, i in enumerate(range(0, len(y), 2048))]

    return _per_take(takes, keys, "block int, samples array<float>", converted)


def drift_corrected(takes: DataFrame, keys: list[str], chirp: np.ndarray | None, starts: tuple[int, int], search: int, reference: np.ndarray, rate: int) -> tuple[DataFrame, DataFrame]:
    """(takes, report): takes whose clock's drift is taken out, where it is one and taking it out costs nothing.

    The chirp is looked for within ``search`` samples of its two places. The
    report has (keys, ppm, confidence, action, corrected, advisory_ppm,
    discarded). Without a chirp nothing is estimated or changed. A correction
    that loses the reference's lag is discarded.
    """
    every = takes.select(*keys).distinct()
    if chirp is None:
        none = lambda kind: F.lit(None).cast(kind)
        report = every.select(*keys, none("double").alias("ppm"), none("double").alias("confidence"), F.lit("none").alias("action"), F.lit(False).alias("corrected"), none("double").alias("advisory_ppm"), F.lit(False).alias("discarded"))
        return takes.select(*keys, "block", "samples"), report
    windows = [(max(s - search, 0), s + search + len(chirp)) for s in starts]
    lags = marker_lags(takes, keys, chirp, windows, least=0.0).groupBy(*keys).agg(
        *[F.max(F.when(F.col("marker") == m, F.col("lag"))).alias(f"_{m}") for m in (0, 1)], F.min("confidence").alias("confidence"), F.min("reason").alias("_why")
    )
    spacing = starts[1] - starts[0]
    ppm = F.when(F.col("_why").isNull(), ((F.col("_1") - F.col("_0")) / spacing - 1) * 1e6)
    fits = lags.select(*keys, ppm.alias("ppm"), "confidence", drift_action(ppm, F.col("confidence")).alias("action"), F.col("_0").alias("origin"))
    wanted = takes.join(fits.where("action in ('correct', 'correct_and_advise')").select(*keys, "ppm", "origin"), keys)

    def moved(x: np.ndarray, group: pd.DataFrame) -> list[tuple]:
        at = group["origin"].iloc[0] + (np.arange(len(x)) - group["origin"].iloc[0]) * (1 + group["ppm"].iloc[0] / 1e6)
        y = resampled(x, np.clip(at, 0, len(x) - 1))
        return [(b, y[i : i + 2048]) for b, i in enumerate(range(0, len(y), 2048))]

    fixed = _per_take(wanted, keys, "block int, samples array<float>", moved, "ppm", "origin")

    def lock(rows: DataFrame, to: str) -> DataFrame:
        def found(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
            if len(x) < len(reference):
                return [(None, None)]
            r = np.abs(correlation(reference, x))
            k = int(np.argmax(r))
            return [(refined(r, k), float(r[k]))]

        return _per_take(rows, keys, f"{to}_lag double, {to} double", found)

    both = lock(wanted, "raw").join(lock(fixed, "fixed"), keys)
    keeps = correction_keeps_lock(F.col("raw"), F.col("fixed"), F.col("raw_lag"), F.col("fixed_lag"), F.lit(rate), LOCK)
    judged = both.select(*keys, F.coalesce(keeps, F.lit(False)).alias("_keeps"))
    report = every.join(fits, keys, "left").join(judged, keys, "left")
    loud = F.col("action").isin("implausible", "correct_and_advise") | ~F.coalesce(F.col("_keeps"), F.lit(True))
    report = report.select(
        *keys, "ppm", "confidence", F.coalesce("action", F.lit("none")).alias("action"), F.coalesce("_keeps", F.lit(False)).alias("corrected"),
        F.when(loud, F.abs("ppm")).alias("advisory_ppm"), F.coalesce(~F.col("_keeps"), F.lit(False)).alias("discarded"),
    )
    good = judged.where("_keeps").select(*keys)
    kept = takes.select(*keys, "block", F.col("samples").cast("array<float>").alias("samples")).join(good, keys, "left_anti")
    return kept.unionByName(fixed.join(good, keys, "left_semi")), report


def _deconvolved(x: np.ndarray, stimulus: np.ndarray, floor: float) -> tuple[np.ndarray, int]:
    n = 1 << int(np.ceil(np.log2(max(len(x), len(stimulus)))))
    s = np.fft.rfft(stimulus, n)
    return np.fft.rfft(x, n) * np.conj(s) / (np.abs(s) ** 2 + floor * np.max(np.abs(s)) ** 2), n


def calibrated_phase(takes: DataFrame, keys: list[str], stimulus: np.ndarray, rate: int, calibration: DataFrame, microphone: str, band: tuple[float, float], residual_us: str, floor: float = 1e-6) -> DataFrame:
    """(keys, response, impulse, low_hz, high_hz, timing_limit_hz, issue): what a take on the stimulus' clock shows.

    ``calibration`` (microphone, frequency_hz, spl_db) is taken off, between its
    points by the logarithm of frequency, and nothing is left beyond it or the
    sweep's band. Refused, with an issue: a clock without a bound, no common
    band, a take too short, a bin without energy, fewer than two bins. Without
    a calibration the issue says so.
    """
    curves = calibration.groupBy(microphone).agg(F.array_sort(F.collect_list(F.struct("frequency_hz", "spl_db"))).alias("_c"))  # a microphone's few hundred points
    rows = takes.join(curves, microphone, "left").select("*", F.col("_c.frequency_hz").alias("_hz"), F.col("_c.spl_db").alias("_db"))
    schema = "response array<struct<hz: double, db: double, deg: double>>, impulse array<double>, low_hz double, high_hz double, timing_limit_hz double, issue string"
    refused = lambda why: [(None, None, None, None, None, why)]

    def measured(x: np.ndarray, group: pd.DataFrame) -> list[tuple]:
        bound, hz, db = group[residual_us].iloc[0], group["_hz"].iloc[0], group["_db"].iloc[0]
        if bound is None or not np.isfinite(bound) or bound <= 0:
            return refused("timing_bound")
        if hz is None or len(hz) == 0:
            return refused("calibration_missing")
        if len(x) < len(stimulus):
            return refused("sweep_decay_missing")
        low, high = max(band[0], hz[0]), min(band[1], hz[-1])
        if low >= high:
            return refused("calibration_band")
        h, n = _deconvolved(x[: len(stimulus)], stimulus, floor)
        f = np.arange(len(h)) * rate / n
        inside = (f >= low) & (f <= high)
        if inside.sum() < 2:
            return refused("too_few_bins")
        gain = np.where(inside, 10 ** (-np.interp(np.log(np.maximum(f, 1e-9)), np.log(np.maximum(hz, 1e-9)), db) / 20), 0)
        h = h * gain
        with np.errstate(divide="ignore"):
            level = 20 * np.log10(np.abs(h[inside]))
        if not np.isfinite(level).all():
            return refused("unexcited_bin")
        response = [{"hz": a, "db": b, "deg": c} for a, b, c in zip(f[inside], level, np.degrees(np.angle(h[inside])), strict=True)]
        return [(response, np.fft.irfft(h, n), low, high, min(25000.0 / bound, high), None)]

    return _per_take(rows, keys, schema, measured, "_hz", "_db", residual_us)


def distortion(takes: DataFrame, keys: list[str], sweep: tuple[float, float, float], rate: int, orders: int = 5) -> DataFrame:
    """(keys, frequency_hz, spl_db, thd_percent, group_delay_ms) on twelfths of octaves of an exponential sweep's band.

    ``sweep`` is (lo, hi, seconds) of the sweep with which the take begins.
    Divided by its sweep, the take shows the response and before it those of
    the harmonics, n-th of them seconds ln n / ln(hi / lo) earlier; each is cut
    out and compared at n times the frequency. Harmonics beyond the band or
    the Nyquist frequency are not counted, and without any distortion is null.
    """
    lo, hi, seconds = sweep
    k = seconds / math.log(hi / lo)
    t = np.arange(round(seconds * rate)) / rate
    sent = np.sin(2 * np.pi * lo * k * (np.exp(t / k) - 1))
    grid = lo * 2 ** (np.arange(1, math.floor(12 * math.log2(hi / lo))) / 12)

    def measured(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        n = 1 << int(np.ceil(np.log2(len(x) + len(sent))))
        s = np.fft.rfft(sent, n)
        h = np.fft.irfft(np.fft.rfft(x, n) * np.conj(s) / (np.abs(s) ** 2 + 1e-6 * np.max(np.abs(s)) ** 2), n)
        direct = int(np.argmax(np.abs(h)))
        gap = k * math.log((orders + 1) / orders) * rate  # between the two harmonics that are nearest
        half = int(gap / 2)
        size = 1 << int(np.ceil(np.log2(4 * half + 4)))

        def part(order: int) -> np.ndarray:
            at = direct - round(k * math.log(order) * rate)
            return np.fft.rfft(h[(at - half + np.arange(2 * half)) % n] * np.hanning(2 * half), size)

        spectra = [part(i) for i in range(1, orders + 1)]
        f = np.fft.rfftfreq(size, 1 / rate)
        level = [np.interp(grid * i, f, np.abs(h)) for i, h in enumerate(spectra, 1)]
        above = [np.where((grid * i < min(hi, rate / 2)), level[i - 1], np.nan) for i in range(2, orders + 1)]
        power = np.nansum(np.square(above), axis=0)
        there = ~np.isnan(above).all(axis=0)
        delay = -np.gradient(np.unwrap(np.angle(spectra[0])), f) / (2 * np.pi) + (direct - half) / rate
        with np.errstate(divide="ignore", invalid="ignore"):
            thd, spl = 100 * np.sqrt(power) / level[0], 20 * np.log10(level[0])
        return [(float(a), float(b), float(c) if ok and np.isfinite(c) else None, float(d)) for a, b, c, ok, d in zip(grid, spl, thd, there, 1000 * np.interp(grid, f, delay), strict=True)]

    return _per_take(takes, keys, "frequency_hz double, spl_db double, thd_percent double, group_delay_ms double", measured)


def take_sets(takes: DataFrame, keys: list[str], take: str, stimulus: np.ndarray, rate: int, bins: int = 256, least: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(curves, verdicts): the repeats of each set of takes put together.

    A take without a clear lag is out; of three or more so are those whose
    level curve lies further from the set's median curve than the others do
    (three scaled median deviations). Curves are (keys, bin, frequency_hz,
    spl_db, coherence): mean level of the accepted, and how far their complex
    responses agree, null for fewer than two. Verdicts are (keys, take, lag,
    confidence, accepted, reason). Takes are worked on as this is called, and
    what they show is kept in the checkpoint folder for both results.
    """
    by = [*keys, take]
    size = 2 * bins

    def shown(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if len(x) < len(stimulus) or not np.isfinite(x).all():
            return [(None, None, None, None)]
        r = correlation(stimulus, x)
        at = int(np.argmax(np.abs(r)))
        if abs(r[at]) < least:
            return [(refined(np.abs(r), at), float(abs(r[at])), None, None)]
        h, n = _deconvolved(x[at:], stimulus, 1e-6)
        short = np.fft.rfft(np.fft.irfft(h, n)[:size], size)[1:]
        return [(refined(np.abs(r), at), float(abs(r[at])), short.real.tolist(), short.imag.tolist())]

    # each take goes through numpy once: its response is used three times
    each = checkpointed(_per_take(takes, by, "lag double, confidence double, re array<double>, im array<double>", shown))
    locked = each.where("re is not null")
    long = locked.select(*by, F.posexplode(F.arrays_zip("re", "im")).alias("bin", "v")).select(*by, "bin", "v.re", "v.im")
    long = long.withColumn("db", 10 * F.log10(F.greatest(F.expr("re * re + im * im"), F.lit(1e-30))))
    mid = long.groupBy(*keys, "bin").agg(F.percentile("db", F.lit(0.5)).alias("_m"))
    off = long.join(mid, [*keys, "bin"]).groupBy(*by).agg(F.sqrt(F.avg((F.col("db") - F.col("_m")) ** 2)).alias("_off"))
    many = off.groupBy(*keys).agg(F.count("*").alias("_n"))
    judged = trusted(off, keys, "_off").join(many, keys).select(*by, (F.col("accepted") | (F.col("_n") < 3)).alias("_ok"))
    verdicts = each.join(judged, by, "left").select(
        *by, "lag", "confidence", F.coalesce("_ok", F.lit(False)).alias("accepted"),
        F.when(F.col("lag").isNull(), "take_unusable").when(F.col("re").isNull(), "low_confidence").when(~F.col("_ok"), "outlier").alias("reason"),
    )
    kept = long.join(judged.where("_ok").select(*by), by, "left_semi")
    agreement = (F.avg("re") ** 2 + F.avg("im") ** 2) / F.avg(F.expr("re * re + im * im"))
    curves = kept.groupBy(*keys, "bin").agg((10 * F.log10(F.avg(F.expr("re * re + im * im")))).alias("spl_db"), F.when(F.count("*") > 1, agreement).alias("coherence"))
    return curves.select(*keys, "bin", ((F.col("bin") + 1) * rate / size).alias("frequency_hz"), "spl_db", "coherence"), verdicts


def noise_floor(takes: DataFrame, keys: list[str], before: Column, rate: int, segment: int = QUIET) -> DataFrame:
    """(keys, levels, reason): dB of each bin of the quiet part, the samples before ``before``; its mean over Hann segments.

    A part that is too short, or nothing but zeros, has a reason and no levels.
    """
    taper = np.hanning(segment)

    def heard(x: np.ndarray, group: pd.DataFrame) -> list[tuple]:
        end = group["_before"].iloc[0]
        quiet = x[: int(end)] if end is not None and np.isfinite(end) and end > 0 else x[:0]
        if len(quiet) < QUIET:
            return [(None, "no_quiet_window")]
        if not quiet.any():
            return [(None, "digital_zeros")]
        parts = np.lib.stride_tricks.sliding_window_view(quiet, segment)[:: segment // 2] * taper
        p = (np.abs(np.fft.rfft(parts, axis=1)) ** 2).mean(axis=0) * (2 / taper.sum()) ** 2
        return [((10 * np.log10(np.maximum(p, 1e-30))).tolist(), None)]

    return _per_take(takes.withColumn("_before", before.cast("double")), keys, "levels array<double>, reason string", heard, "_before")


def envelope_peak(takes: DataFrame, keys: list[str], reference: np.ndarray, guard: int) -> DataFrame:
    """(keys, peak, refined, sidelobe_db): the largest value of the envelope of a take's correlation with a reference.

    ``sidelobe_db`` is how far it stands above all further than ``guard``
    samples away, null where there is nothing; a take that is shorter than the
    reference has nulls.
    """

    def found(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if len(x) < len(reference):
            return [(None, None, None)]
        n = 1 << int(np.ceil(np.log2(len(x) + len(reference))))
        spectrum = np.fft.fft(x, n) * np.conj(np.fft.fft(reference, n))
        spectrum[1 : n // 2] *= 2
        spectrum[n // 2 + 1 :] = 0
        envelope = np.abs(np.fft.ifft(spectrum))[: len(x) - len(reference) + 1]
        k = int(np.argmax(envelope))
        rest = np.concatenate([envelope[: max(k - guard, 0)], envelope[k + guard + 1 :]])
        side = rest.max() if len(rest) else 0.0
        return [(k, refined(envelope, k), float(20 * np.log10(envelope[k] / side)) if side > 0 else None)]

    return _per_take(takes, keys, "peak long, refined double, sidelobe_db double", found)


def spectrogram(takes: DataFrame, keys: list[str], rate: int, segment: int = 1024, step: int = 512) -> DataFrame:
    """(keys, time_ms, levels): dB of the bins of Hann segments of each take, one row a segment."""
    taper = np.hanning(segment)

    def shown(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if len(x) < segment:
            return []
        parts = np.lib.stride_tricks.sliding_window_view(x, segment)[::step]
        rows = []
        for i in range(0, len(parts), 512):
            p = np.abs(np.fft.rfft(parts[i : i + 512] * taper, axis=1)) * 2 / taper.sum()
            rows += [((i + j) * step * 1000 / rate, row.tolist()) for j, row in enumerate(20 * np.log10(np.maximum(p, 1e-15)))]
        return rows

    return _per_take(takes, keys, "time_ms double, levels array<double>", shown)


def _moving(x: np.ndarray, width: int) -> np.ndarray:
    """Means over ``width`` samples around each, of those that there are."""
    total, i = np.concatenate([[0.0], np.cumsum(x)]), np.arange(len(x))
    lo, hi = np.maximum(i - width // 2, 0), np.minimum(i + width // 2 + 1, len(x))
    return (total[hi] - total[lo]) / (hi - lo)


def reflections(impulses: DataFrame, keys: list[str], impulse: str, rate: int, above_db: float = 12.0, apart_ms: float = 1.0) -> DataFrame:
    """(keys, onset, peak, end, energy, direct): stretches of an impulse response that stand out of the decay around them.

    The energy over half a millisecond is held against its mean level in the
    20 ms around it; a stretch ``above_db`` over it, parted by more than ``apart_ms``, is a
    segment. The direct sound is the one of most energy, the first of equal
    ones. Responses that are null, empty or zero have none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in impulses.select(*keys).schema.fields}
    schema = ", ".join([*(f"{k} {t}" for k, t in kinds.items()), "onset int, peak int, end int, energy double, direct boolean"])
    short, wide, apart = max(round(rate / 2000), 1), max(round(rate / 50), 2), max(round(apart_ms * rate / 1000), 1)

    def found(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                h = row[-1]
                if h is None or len(h) == 0 or not np.any(h):
                    continue
                e = np.asarray(h, np.float64) ** 2
                local = _moving(e, short)
                # the mean of levels, which one loud sample hardly moves
                around = np.exp(_moving(np.log(np.maximum(local, local.max() * 1e-8)), wide))
                loud = np.flatnonzero((local > around * 10 ** (above_db / 10)) & (local > local.max() * 1e-6))
                if not len(loud):
                    continue
                cuts = np.flatnonzero(np.diff(loud) > apart)
                spans = [(int(a), int(b) + 1) for a, b in zip(loud[np.r_[0, cuts + 1]], loud[np.r_[cuts, len(loud) - 1]], strict=True)]
                peaks = [a + int(np.argmax(e[a:b])) for a, b in spans]
                most = max(range(len(spans)), key=lambda i: (e[peaks[i]], -i))  # noqa: B023
                out += [(*row[:-1], a, p, b, float(e[p]), i == most) for i, ((a, b), p) in enumerate(zip(spans, peaks, strict=True))]
            yield pd.DataFrame(out, columns=[*keys, "onset", "peak", "end", "energy", "direct"])

    return impulses.select(*keys, impulse).mapInPandas(found, schema)


def speech_transmission(impulses: DataFrame, keys: list[str], impulse: str, rate: int) -> DataFrame:
    """(keys, sti, mti): speech transmission index of impulse responses, without noise, for male speech.

    ``mti`` has the seven octaves' modulation transfer indices. A response that
    is null, shorter than a period of the slowest modulation, without energy in
    a band, or sampled too slowly for the highest band has nulls.
    """
    kinds = {f.name: f.dataType.simpleString() for f in impulses.select(*keys).schema.fields}
    schema = ", ".join([*(f"{k} {t}" for k, t in kinds.items()), "sti double, mti array<double>"])

    def index(h: np.ndarray | None) -> tuple[float | None, list[float] | None]:
        if h is None or len(h) < rate / STI_MODULATIONS[0] or STI_BANDS[-1] * math.sqrt(2) > rate / 2 or not np.isfinite(h).all():
            return None, None
        n = 1 << int(np.ceil(np.log2(2 * len(h))))
        spectrum, f = np.fft.rfft(h, n), np.fft.rfftfreq(n, 1 / rate)
        t = np.arange(len(h)) / rate
        mti = []
        for band in STI_BANDS:
            e = np.fft.irfft(spectrum * ((f >= band / math.sqrt(2)) & (f < band * math.sqrt(2))), n)[: len(h)] ** 2
            if e.sum() <= 0:
                return None, None
            m = np.array([abs((e * np.exp(-2j * np.pi * hz * t)).sum()) / e.sum() for hz in STI_MODULATIONS])
            m = np.clip(m, 1e-9, 1 - 1e-9)
            mti.append(float(((np.clip(10 * np.log10(m / (1 - m)), -15, 15) + 15) / 30).mean()))
        sti = sum(a * m for a, m in zip(STI_WEIGHTS, mti, strict=True)) - sum(b * math.sqrt(x * y) for b, x, y in zip(STI_REDUNDANCIES, mti, mti[1:], strict=False))
        return min(max(sti, 0.0), 1.0), mti

    def found(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            yield pd.DataFrame([(*row[:-1], *index(None if row[-1] is None else np.asarray(row[-1], np.float64))) for row in batch.itertuples(index=False)], columns=[*keys, "sti", "mti"])

    return impulses.select(*keys, impulse).mapInPandas(found, schema)


def ear_pairs_aligned(takes: DataFrame, keys: list[str], channel: str, loopback: str, reference: np.ndarray, frames: int, least: float = 0.25, silent: float = 1e-4, clipped: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """(takes, issues): both ears of each take cut out on the clock of its electrical loopback.

    ``channel`` names left, right and the loopback, in which the reference is
    looked for; all three get the same window. A take without a clear lag, one
    that ends too early, and an ear that is silent or clipped has an issue and
    no rows. Takes are cut as this is called, into the checkpoint folder.
    """
    electrical = takes.where(F.col(channel) == loopback)

    def found(x: np.ndarray, _: pd.DataFrame) -> list[tuple]:
        if len(x) < len(reference):
            return [(None, None)]
        r = np.abs(correlation(reference, x))
        k = int(np.argmax(r))
        return [(k, float(r[k]))]

    lags = _per_take(electrical, keys, "lag long, confidence double", found)
    long = takes.join(lags, keys)

    def cut(x: np.ndarray, group: pd.DataFrame) -> list[tuple]:
        lag, sure = group["lag"].iloc[0], group["confidence"].iloc[0]
        if lag is None or not np.isfinite(lag) or sure < least:
            return [(None, None, "lag_not_locked")]
        y = x[int(lag) : int(lag) + frames]
        top = np.abs(y).max() if len(y) else 0.0
        why = "window_incomplete" if len(y) < frames else "silent" if top < silent else "clipped" if top >= clipped else None
        return [(None, None, why)] if why else [(b, y[i : i + 2048].astype(np.float32), None) for b, i in enumerate(range(0, frames, 2048))]

    parts = checkpointed(_per_take(long, [*keys, channel], "block int, samples array<float>, issue string", cut, "lag", "confidence"))
    bad = parts.where("issue is not null").groupBy(*keys).agg(F.min("issue").alias("issue"))
    there = takes.groupBy(*keys).agg(F.count_distinct(channel).alias("_n"), F.max(F.col(channel) == loopback).alias("_l"))
    missing = there.where("_n <> 3 or not _l").select(*keys, F.lit("channel_missing").alias("issue")).join(bad, keys, "left_anti")
    issues = bad.unionByName(missing)
    return parts.where("issue is null").drop("issue").join(issues.select(*keys), keys, "left_anti"), issues


def pair_delays(events: DataFrame, keys: list[str], ordinal: str, samples: str, most: int) -> DataFrame:
    """(keys, other, tdoa): how many samples later each channel of an event hears it than the first channel does.

    ``events`` has one row a channel with the event's samples, of one length;
    correlation is over shifts up to ``most`` and refined between samples.
    Silent channels have a null delay. `localization.directions` takes these.
    """
    first = events.withColumn("_0", F.first(samples).over(Window.partitionBy(*keys).orderBy(ordinal))).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal)))
    kinds = {f.name: f.dataType.simpleString() for f in events.select(*keys, ordinal).schema.fields}
    schema = ", ".join([*(f"{k} {t}" for k, t in kinds.items()), "tdoa double"])

    def shift(a: np.ndarray, b: np.ndarray) -> float | None:
        if len(a) != len(b) or not len(a) or not a.any() or not b.any():
            return None
        n = 1 << (2 * len(a) - 1).bit_length()
        lags = np.arange(-min(most, len(a) - 1), min(most, len(a) - 1) + 1)
        r = np.fft.irfft(np.conj(np.fft.rfft(a, n)) * np.fft.rfft(b, n), n)[lags]
        k = int(np.argmax(r))
        return float(refined(r, k) + lags[0])

    def found(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = [(*row[:-2], shift(np.asarray(row[-2], np.float64), np.asarray(row[-1], np.float64))) for row in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[*keys, ordinal, "tdoa"])

    return first.where("_n > 1").select(*keys, ordinal, "_0", samples).mapInPandas(found, schema)
