"""Levels, finite values and clipped ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def finite(x: Column) -> Column:
    """x, or null where it is null, NaN or infinite."""
    return F.when(is_finite(x), x)


def amplitude_db(a: Column) -> Column:
    """20 log10 of an amplitude; null for silence."""
    return F.when(a > 0, 20 * F.log10(a))


def power_db(p: Column) -> Column:
    return F.when(p > 0, 10 * F.log10(p))


def from_db(db: Column) -> Column:
    """The amplitude of a level, which is at most full scale."""
    return F.pow(F.lit(10.0), F.least(db, F.lit(0.0)) / 20)


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def wrap_degrees(x: Column) -> Column:
    """An angle in (-180, 180]."""
    return 180 - F.pmod(180 - x, F.lit(360.0))


def level_zone(peak_db: Column) -> Column:
    """Meter zone of a peak in dBFS; null peaks are silent."""
    return (
        F.when(peak_db.isNull(), "silent").when(peak_db >= -1, "red").when(peak_db >= -6, "hot").when(peak_db >= -24, "good").when(peak_db >= -50, "low").otherwise("silent")
    )


def gain_advice(peak_db: Column) -> Column:
    return F.when(peak_db >= -1, "lower").when(peak_db.isNull() | (peak_db < -30), "raise").otherwise("keep")


def progress(running: Column, total: Column, elapsed: Column) -> Column:
    """Share of a running job that is done; null unless it runs and has a length."""
    return F.when(running & (total > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), elapsed / total)))


def sweep_count(n: Column) -> Column:
    """1 to 8 sweeps; two cannot outvote each other, so two become three."""
    held = F.greatest(F.lit(1), F.least(F.lit(8), n))
    return F.when(held == 2, 3).otherwise(held)


def metres(x: Column, unit: Column) -> Column:
    return F.when(unit == "ft", x * 0.3048).otherwise(x)


def rescaled_frame(frame: Column, rate_from: Column, rate_to: Column) -> Column:
    """A frame offset at another rate, rounded once."""
    return F.floor((frame * rate_to + F.floor(rate_from / 2)) / rate_from)
