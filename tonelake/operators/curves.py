"""Curves over frequency: interpolation, gated maxima, back-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.levels import is_finite


def interpolated(points: DataFrame, targets: DataFrame, keys: list[str], hz: str, value: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, hz, carried, value): each target on the curve through its key's points, linear in log frequency.

    Each point first learns the one after it. Then points and targets are
    sorted together once, and each target takes the last bracket that begins
    below it; beyond the ends the end point holds, and a bracket that starts at
    0 Hz gives its upper value. Targets bring their ``carried`` columns along.
    """
    point, order = F.struct("f", "v"), Window.partitionBy(*keys).orderBy("f")
    p = points.select(*keys, F.col(hz).alias("f"), F.col(value).cast("double").alias("v"))
    p = p.withColumns({"_p": point, "_hi": F.lead(point).over(order), "_first": F.row_number().over(order) == 1})
    # what is below the first point is a bracket with an upper end alone
    ends = lambda t, f, lo, hi: F.struct(F.lit(t).alias("t"), f.alias("f"), F.struct(lo.alias("lo"), hi.alias("hi")).alias("b"))
    none = lambda c: F.when(F.lit(False), F.col(c))
    brackets = F.array_compact(F.array(F.when(F.col("_first"), ends(-1, none("f"), none("_p"), F.col("_p"))), ends(0, F.col("f"), F.col("_p"), F.col("_hi"))))
    with_ends = p.select(*keys, F.explode(brackets).alias("e")).select(*keys, "e.f", "e.t", "e.b")
    both = with_ends.unionByName(targets.select(*keys, F.col(hz).alias("f"), F.lit(1).alias("t"), *carried), allowMissingColumns=True)
    below = Window.partitionBy(*keys).orderBy("f", "t").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("b", F.last("b", ignorenulls=True).over(below)).where("t = 1").select(*keys, "f", *carried, "b.lo", "b.hi")
    share = F.ln(F.col("f") / F.when(F.col("lo.f") > 0, F.col("lo.f"))) / F.ln(F.col("hi.f") / F.when(F.col("lo.f") > 0, F.col("lo.f")))
    between = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * share
    found = (
        F.when(F.col("lo").isNull(), F.col("hi.v")).when(F.col("hi").isNull(), F.col("lo.v"))
        .when(F.col("lo.f") == F.col("f"), F.col("lo.v")).when(F.col("lo.f") <= 0, F.col("hi.v")).otherwise(between)
    )
    return rows.select(*keys, F.col("f").alias(hz), *carried, F.coalesce(found, F.lit(0.0)).alias(value))


def gated_peak(curves: DataFrame, keys: list[str], hz: str, value: str, level: str, lo: float, hi: float, below: float = 20.0) -> DataFrame:
    """(keys, hz, value): the largest value in a band where the level is within ``below`` dB of the band's largest.

    Of equal values the highest frequency counts.
    """
    band = curves.where((F.col(hz) >= lo) & (F.col(hz) <= hi))
    top = band.where(is_finite(F.col(level))).groupBy(*keys).agg(F.max(level).alias("_top"))
    loud = band.where(is_finite(F.col(value))).join(top, keys).where(F.col(level) >= F.col("_top") - below)
    best = loud.groupBy(*keys).agg(F.max(F.struct(value, hz)).alias("m"))
    return best.select(*keys, F.col(f"m.{hz}").alias(hz), F.col(f"m.{value}").alias(value))


def low_level(curves: DataFrame, keys: list[str], hz: str, db: str, lo: Column, hi: Column, floor: float = -150.0, most: float = -50.0) -> DataFrame:
    """(keys, average_db) of curves whose mean level in the audible part of a band is below ``most``."""
    inside = (F.col(hz) >= F.greatest(lo, F.lit(20.0))) & (F.col(hz) <= F.least(hi, F.lit(20000.0))) & (F.col(db) > floor)
    return curves.where(inside).groupBy(*keys).agg(F.avg(db).alias("average_db")).where(F.col("average_db") < most)


def backfilled(results: DataFrame, archive: DataFrame, keys: list[str], hz: str, columns: list[str], close: float = 0.01) -> DataFrame:
    """Missing columns of results from an archive whose grid is the same within ``close``.

    A key's archive counts only if all its bins are there and near, and a
    column only if a key has none of it and the archive has a finite value.
    """
    old = archive.select(*keys, "bin", F.col(hz).alias("_f"), *[F.when(is_finite(F.col(c)), F.col(c)).alias(f"_{c}") for c in columns])
    both = results.join(old, [*keys, "bin"], "left")
    w = Window.partitionBy(*keys)
    fits = F.every(F.coalesce(F.abs(F.col(hz) - F.col("_f")) <= close, F.lit(False))).over(w)
    both = both.withColumn("_fits", fits)
    for c in columns:
        lacks = F.count(c).over(w) == 0
        both = both.withColumn(c, F.when(F.col("_fits") & lacks, F.col(f"_{c}")).otherwise(F.col(c)))
    return both.drop("_f", "_fits", *[f"_{c}" for c in columns])


def octave_smoothed(curves: DataFrame, keys: list[str], hz: str, value: str, fraction: float) -> DataFrame:
    """Each point with the mean of the points within half of ``fraction`` octaves on either side."""
    by = ", ".join(f"`{k}`" for k in keys)
    half = f"{fraction / 2!r}D"
    mean = f"avg(`{value}`) OVER (PARTITION BY {by} ORDER BY log2(`{hz}`) RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return curves.where(F.col(hz) > 0).withColumn("smoothed", F.expr(mean))
