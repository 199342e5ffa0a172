"""Arrays, maps and sentences of session documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .levels import is_finite


def channel_of(interleaved: Column, channel: Column, channels: Column) -> Column:
    """One channel of interleaved frames; a frame that is cut short is none."""
    whole = F.floor(F.size(interleaved) / channels) * channels
    return F.transform(F.filter(F.transform(interleaved, lambda e, i: F.when((i < whole) & (F.pmod(i, channels) == channel), F.struct(e.alias("e")))), lambda s: s.isNotNull()), lambda s: s["e"])


def convolved(x: Column, h: Column) -> Column:
    """All of the convolution of two short arrays."""
    n, m = F.size(x), F.size(h)
    at = lambda k: F.sequence(F.greatest(F.lit(0), k - m + 1), F.least(k, n - 1))
    term = lambda k: F.aggregate(F.transform(at(k), lambda i: F.get(x, i).cast("double") * F.get(h, k - i)), F.lit(0.0), lambda s, e: s + e)
    return F.when((n > 0) & (m > 0), F.transform(F.sequence(F.lit(0), n + m - 2), term)).otherwise(F.array().cast("array<double>"))


def warped(x: Column, ppm: float) -> Column:
    """x as a clock that is off by ``ppm`` records it: lines between samples, zero beyond."""
    f = 1 + ppm / 1e6
    n = F.round(F.size(x) * F.lit(f)).cast("int")

    def value(k: Column) -> Column:
        at = k / F.lit(f)
        low = F.floor(at).cast("int")
        a, b = F.coalesce(F.get(x, low), F.lit(0.0)), F.coalesce(F.get(x, low + 1), F.lit(0.0))
        return F.when(low < F.size(x), a + (b - a) * (at - low)).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), n - 1), value)


def resized(x: Column, n: Column) -> Column:
    """x cut or filled with nulls to n elements."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(None), F.greatest(n - F.size(x), F.lit(0)))), F.lit(1), n)


def all_reliable(complete: Column, stability: Column, most: float = 20.0) -> Column:
    """A finished run in which every phase is steady; a run without channels is."""
    return complete & F.forall(stability, lambda s: F.coalesce(s < most, F.lit(False)))


def metadata(old: Column, changes: Column) -> Column:
    """A map after changes; a change to nothing removes its key."""
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(changes), k), F.lit(False)))
    return F.map_concat(kept, F.map_filter(changes, lambda k, v: v.isNotNull() & (F.trim(v) != "")))


def room_metres(length: Column, width: Column, height: Column, unit: Column) -> Column:
    """A room in metres, or null unless all three sides are finite and above zero."""
    to = F.when(unit == "ft", 0.3048).otherwise(1.0)
    ok = is_finite(length) & is_finite(width) & is_finite(height) & (F.least(length, width, height) > 0)
    return F.when(ok, F.struct((length * to).alias("length"), (width * to).alias("width"), (height * to).alias("height")))


def quality_cell(state: Column, score: Column, trusted: Column) -> Column:
    """A take's quality as a table shows it."""
    text = F.format_string("%.2f", score)
    return F.when(score.isNull(), "no data").when(state == "review", F.concat(F.lit("REVIEW "), text)).when(~trusted, F.concat(F.lit("OK* "), text)).otherwise(F.concat(F.lit("OK "), text))


def frames_fit(seconds: Column, rate: Column, channels: Column, most: int = 16_000_000, most_bytes: int = 512 << 20) -> Column:
    """Why a capture would not fit, or null; products that overflow do not fit."""
    frames = F.try_multiply(seconds, rate.cast("double"))
    size = F.try_multiply(F.try_multiply(frames, channels.cast("double")), F.lit(4.0))
    return F.when(~is_finite(frames) | (frames > most), "frames").when(size > most_bytes, "bytes")
