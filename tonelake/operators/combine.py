"""Robust combination of repeats, and what sessions say as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.levels import hypot, is_finite


def median(x: Column | str) -> Column:
    """The middle value, or the mean of the two middle ones."""
    return F.percentile(x, F.lit(0.5))


def upper_median(x: Column) -> Column:
    """The upper middle value; null as soon as one value is null or not finite."""
    return F.when(F.every(is_finite(x)), F.get(F.sort_array(F.collect_list(x)), F.floor(F.count(F.lit(1)) / 2).cast("int")))


def half_spread(x: Column | str) -> Column:
    return (F.max(x) - F.min(x)) / 2


def scatter(x: Column) -> Column:
    """Largest less smallest; null as soon as one value is null or not finite."""
    return F.when(F.every(is_finite(x)), F.max(x) - F.min(x))


def widened(sigma: Column, spread: Column) -> Column:
    """A median uncertainty widened by how far the repeats are apart."""
    return F.when(sigma.isNotNull(), hypot(sigma, spread)).when(spread > 0, spread)


def combined(cells: DataFrame, keys: list[str], medians: list[str], sigma: str, value: str, least: str, modes: list[str], usable: Column) -> DataFrame:
    """One row for each cell of a matrix from its repeats.

    One usable repeat is taken as it is. Of several, ``medians`` and ``sigma``
    become medians (``sigma`` widened by half the spread of ``value``),
    ``least`` the least, ``modes`` the commonest value, the least of equals.
    A cell without a usable repeat has nulls and the commonest ``reason``.
    """
    ok = lambda c: F.when(usable, F.col(c))
    n = F.sum(usable.cast("long"))
    spread = (F.max(ok(value)) - F.min(ok(value))) / 2
    return cells.groupBy(*keys).agg(
        F.count("*").alias("repeats"),
        n.alias("usable"),
        *[median(ok(c)).alias(c) for c in medians],
        F.when(n == 1, F.max(ok(sigma))).otherwise(widened(median(ok(sigma)), spread)).alias(sigma),
        F.min(ok(least)).alias(least),
        *[F.mode(ok(c), True).alias(c) for c in modes],
        F.when(n == 0, F.mode(F.when(~usable, F.col("reason")), True)).alias("reason"),
    )


def fullest_group(takes: DataFrame, source: str, repeat: str) -> DataFrame:
    """(source, repeat, takes): the repeat of each source with most takes, the least of equals."""
    sizes = takes.groupBy(source, repeat).agg(F.count("*").alias("takes"))
    best = sizes.groupBy(source).agg(F.max(F.struct("takes", -F.col(repeat))).alias("m"))
    return best.select(source, (-F.col("m.col2")).alias(repeat), F.col("m.takes").alias("takes"))


def two_largest(x: Column) -> Column:
    """The largest and the second largest, as an array, of a group as small as a session's 32 microphones."""
    return F.slice(F.sort_array(F.collect_list(x), asc=False), 1, 2)


def stability(residuals: DataFrame, source: str, repeat: str, microphone: str, residual: str, most: float = 1.0) -> DataFrame:
    """(source, microphone, repeats, scatter, stable): the first microphone that all repeats of a source have.

    A source of one repeat shows nothing and is stable.
    """
    whole = residuals.groupBy(source).agg(F.countDistinct(repeat).alias("all"))
    each = residuals.groupBy(source, microphone).agg(F.countDistinct(repeat).alias("repeats"), scatter(F.col(residual)).alias("scatter"))
    shared = each.join(whole, source).where(F.col("repeats") == F.col("all"))
    first = shared.groupBy(source).agg(F.min(F.struct(microphone, "repeats", "scatter")).alias("f"))
    ok = (F.col("f.repeats") < 2) | F.coalesce(F.col("f.scatter") <= most, F.lit(False))
    return first.select(source, F.col(f"f.{microphone}").alias(microphone), F.col("f.repeats").alias("repeats"), F.col("f.scatter").alias("scatter"), ok.alias("stable"))


def reference_summary(takes: DataFrame, keys: list[str], reference: str) -> DataFrame:
    """(keys, takes, identified, references, shared): whether all takes name one timing reference."""
    return takes.groupBy(*keys).agg(
        F.count("*").alias("takes"), F.count(reference).alias("identified"), F.countDistinct(reference).alias("references"),
        ((F.countDistinct(reference) == 1) & (F.count(reference) == F.count("*"))).alias("shared"),
    )


def worst_anchor(errors: DataFrame, keys: list[str], microphone: str, measured: str, surveyed: str, most: float) -> DataFrame:
    """(keys, microphone, error, warn): where measured and surveyed values are furthest apart, the last of equals."""
    gap = F.abs(F.col(measured) - F.col(surveyed))
    best = errors.where(is_finite(gap)).groupBy(*keys).agg(F.max(F.struct(gap.alias("e"), F.col(microphone).alias("m"))).alias("w"))
    return best.select(*keys, F.col("w.m").alias(microphone), F.col("w.e").alias("error"), (F.col("w.e") > most).alias("warn"))


def summary_line(cells: DataFrame, keys: list[str], distance: str, reason: str) -> DataFrame:
    """(keys, ranged, total, nearest, furthest, reasons): a matrix in a few numbers, its refusals sorted."""
    d = F.when(is_finite(F.col(distance)), F.col(distance))
    return cells.groupBy(*keys).agg(
        F.count(d).alias("ranged"), F.count("*").alias("total"), F.min(d).alias("nearest"), F.max(d).alias("furthest"),
        F.array_join(F.array_sort(F.collect_set(reason)), ", ").alias("reasons"),
    )


def skew_warnings(takes: DataFrame, keys: list[str], take: str, ppm: str, most: float = 100.0) -> DataFrame:
    """(keys, take, kind, value): takes whose clock is far off, and keys whose takes' clocks are far apart."""
    ok = takes.where(is_finite(F.col(ppm)))
    far = ok.where(F.abs(F.col(ppm)) > most).select(*keys, F.col(take).cast("string").alias("take"), F.lit("severe_skew").alias("kind"), F.col(ppm).alias("value"))
    apart = ok.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(ppm) - F.min(ppm)).alias("value")).where((F.col("n") >= 2) & (F.col("value") > most))
    return far.unionByName(apart.select(*keys, F.lit(None).cast("string").alias("take"), F.lit("skew_spread").alias("kind"), "value"))


def aligned_arrivals(channels: DataFrame, keys: list[str], arrival: str, gain: str, noise: str) -> DataFrame:
    """Each channel's arrival after the first, its delay to the last, and its gain and signal-to-noise in dB."""
    w = Window.partitionBy(*keys)
    first, last = F.min(arrival).over(w), F.max(arrival).over(w)
    return channels.select(
        "*", (F.col(arrival) - first).alias("relative"), (last - F.col(arrival)).alias("delay"),
        F.greatest(F.lit(-120.0), F.coalesce(F.when(F.col(gain) > 0, 20 * F.log10(gain)), F.lit(-120.0))).alias("gain_db"),
        F.when((F.col(gain) > 0) & (F.col(noise) > 0), 20 * F.log10(F.col(gain) / F.when(F.col(noise) > 0, F.col(noise)))).alias("snr_db"),
    )


def drift_roll_up(takes: DataFrame, keys: list[str], order: str, ppm: str, corrected: str, severity: str) -> DataFrame:
    """(keys, drift_ppm, corrected, worst): the first drift known, whether any take was corrected, the worst advice."""
    known = F.when(F.col(ppm).isNotNull(), F.struct(order, ppm))
    return takes.groupBy(*keys).agg(F.min(known).alias("d"), F.bool_or(corrected).alias("corrected"), F.max(severity).alias("worst")).select(
        *keys, F.col(f"d.{ppm}").alias("drift_ppm"), "corrected", "worst"
    )
