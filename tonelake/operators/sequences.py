"""Operators over ordered samples.

Windows are partitioned by a stream's key and, where the stream may be long, by
a block of it: block totals are carried over by a second, short window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.operators.ranks import order_statistics

#: Samples in a block of a running operator.
BLOCK = 4096


def running_peaks(samples: DataFrame, keys: list[str], idx: str, x: str, clip: float = 0.999) -> DataFrame:
    """Each sample with the highest magnitude and the number of clipped samples up to it.

    Runs within blocks, on top of what the blocks before have reached.
    """
    size, hit = F.abs(F.col(x)), (F.abs(F.col(x)) >= clip).cast("long")
    rows = samples.withColumn("_b", F.floor(F.col(idx) / BLOCK))
    done = rows.groupBy(*keys, "_b").agg(F.max(size).alias("m"), F.sum(hit).alias("c"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = done.select(*keys, "_b", F.max("m").over(ahead).alias("_m"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("_c"))
    here = Window.partitionBy(*keys, "_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({"_p": F.max(size).over(here), "_n": F.sum(hit).over(here)})
    return own.join(before, [*keys, "_b"]).select(
        *keys, idx, F.greatest("_p", "_m").alias("peak_hold"), (F.col("_n") + F.col("_c")).alias("clip_count")
    )


def missing_intervals(samples: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """(keys, start_frame, end_frame, missing) of every gap, half open, between neighbouring frames."""
    rows = samples.select(*keys, F.col(idx).cast("long").alias("i"), F.floor(F.col(idx) / BLOCK).alias("b")).distinct()
    # a gap inside a block is seen there, one between blocks from the blocks' ends
    here = Window.partitionBy(*keys, "b").orderBy("i")
    inner = rows.select(*keys, F.lag("i").over(here).alias("p"), "i")
    ends = rows.groupBy(*keys, "b").agg(F.min("i").alias("i"), F.max("i").alias("last"))
    outer = ends.select(*keys, F.lag("last").over(Window.partitionBy(*keys).orderBy("b")).alias("p"), "i")
    gaps = inner.unionByName(outer).where("i > p + 1")
    return gaps.select(*keys, (F.col("p") + 1).alias("start_frame"), F.col("i").alias("end_frame"), (F.col("i") - F.col("p") - 1).alias("missing"))


def continuity(samples: DataFrame, keys: list[str], idx: str, most: int = 128) -> DataFrame:
    """(keys, observed, missing, intervals, omitted): the first ``most`` gaps of each stream, and how many more there are."""
    gaps = missing_intervals(samples, keys, idx)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("start_frame"))
    interval = F.when(F.col("nth") <= most, F.struct("start_frame", "end_frame"))
    lists = gaps.withColumn("nth", nth).groupBy(*keys).agg(
        F.sum("missing").alias("missing"),
        F.array_sort(F.collect_list(interval)).alias("intervals"),
        F.sum((F.col("nth") > most).cast("long")).alias("omitted"),
    )
    seen = samples.groupBy(*keys).agg(F.countDistinct(idx).alias("observed"))
    none = F.array().cast("array<struct<start_frame: bigint, end_frame: bigint>>")
    return seen.join(lists, keys, "left").select(
        *keys, "observed", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("intervals", none).alias("intervals"), F.coalesce("omitted", F.lit(0)).alias("omitted")
    )


def tumbling_frames(samples: DataFrame, keys: list[str], idx: str, x: str, size: int) -> DataFrame:
    """Peak, RMS and full-scale count of every whole frame of ``size`` samples; a frame with a gap or a cut tail is none."""
    v = F.col(x).cast("double")
    frames = samples.groupBy(*keys, F.floor(F.col(idx) / size).alias("frame")).agg(
        F.count("*").alias("samples"), F.max(F.abs(v)).alias("peak"), F.sqrt(F.avg(v * v)).alias("rms"), F.sum((F.abs(v) >= 1).cast("long")).alias("clipped")
    )
    return frames.where(F.col("samples") == size)


def active_span(x: Column) -> Column:
    """(first, last) sample above a millionth of the array's peak; all of a silent array."""
    size = F.transform(x, lambda e: F.abs(e.cast("double")))
    floor = F.array_max(size) * 1e-6
    at = F.filter(F.transform(size, lambda e, i: F.when(e > floor, i)), lambda i: i.isNotNull())
    whole = F.struct(F.lit(0).alias("first"), (F.size(x) - 1).alias("last"))
    return F.when(F.size(at) > 0, F.struct(F.array_min(at).alias("first"), F.array_max(at).alias("last"))).otherwise(F.when(F.size(x) > 0, whole))


def shifted_window(start: Column, end: Column, lag: Column, n: Column) -> Column:
    """[start + lag, end + lag) held inside [0, n); empty where it turns around."""
    a, b = F.least(F.greatest(start + lag, F.lit(0)), n), F.least(F.greatest(end + lag, F.lit(0)), n)
    return F.struct(a.alias("start"), F.greatest(a, b).alias("end"))


def detrended(samples: DataFrame, keys: list[str], idx: str, x: str) -> DataFrame:
    """Samples less the straight line through them, (keys, idx, x, residual)."""
    i, v = F.col(idx).cast("double"), F.col(x).cast("double")
    line = samples.groupBy(*keys).agg(F.regr_slope(v, i).alias("a"), F.regr_intercept(v, i).alias("b"), F.avg(v).alias("m"))
    rest = v - F.coalesce(F.col("a") * i + F.col("b"), F.col("m"))
    return samples.join(line, keys).select(*keys, idx, x, rest.alias("residual"))


def strictly_increasing(x: Column) -> Column:
    """Whether every element is above the one before it; an array of nulls is not."""
    before, after = F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))
    return F.forall(F.zip_with(before, after, lambda a, b: F.coalesce(b > a, F.lit(False))), lambda ok: ok)


def first_peak(samples: DataFrame, keys: list[str], idx: str, x: str, ahead: int, most: int | None = None) -> DataFrame:
    """(keys, onset, peak, refined): the first sample that stands out in the first half of a stream, and the highest soon after.

    Samples are numbered from 0; ``most`` bounds the half. It is the half that
    sets the threshold: the largest of 12 times its middle value, twice the one
    nine tenths up, and 8 % of its peak. The first and the last sample of it
    begin nothing. ``refined`` is the peak between samples, by the parabola
    through it and its neighbours. A half of zeros has no row.
    """
    size = F.abs(F.col(x).cast("double"))
    rows = samples.select(*keys, F.col(idx).cast("long").alias("i"), size.alias("e"))
    half = F.greatest(F.lit(3), F.floor(F.count("*") / 2) if most is None else F.least(F.floor(F.count("*") / 2), F.lit(most)))
    near = rows.join(rows.groupBy(*keys).agg(half.alias("half")), keys).where("i < half")
    middle = order_statistics(near, keys, "e", {"mid": lambda n: F.floor(n / 2), "high": lambda n: F.least(F.floor(n * 0.9), n - 1)})
    top = near.groupBy(*keys).agg(F.max("e").alias("top"))
    level = F.greatest(12 * F.greatest("mid", F.lit(1e-10)), 2 * F.col("high"), 0.08 * F.col("top"))
    floors = middle.join(top, keys).where("top > 1e-10").select(*keys, level.alias("floor"))
    onset = near.join(floors, keys).where("e >= floor and i >= 1 and i + 1 < half").groupBy(*keys).agg(F.min("i").alias("onset"))
    soon = near.join(onset, keys).where((F.col("i") >= F.col("onset")) & (F.col("i") <= F.col("onset") + ahead))
    best = soon.groupBy(*keys, "onset", "half").agg(F.max(F.struct("e", -F.col("i"))).alias("m")).select(*keys, "onset", "half", (-F.col("m.col2")).alias("peak"), F.col("m.e").alias("y"))
    beside = lambda k: F.max(F.when(F.col("i") == F.col("peak") + k, F.col("e")))
    sides = near.drop("half").join(best, keys).where(F.abs(F.col("i") - F.col("peak")) == 1).groupBy(*keys).agg(beside(-1).alias("a"), beside(1).alias("b"))
    bend = 2 * (F.col("a") - 2 * F.col("y") + F.col("b"))
    exact = F.col("peak") + F.coalesce(F.when(F.abs(bend) > 1e-12, (F.col("a") - F.col("b")) / bend), F.lit(0.0))
    return best.join(sides, keys, "left").select(*keys, "onset", "peak", exact.alias("refined"))


def longest_silence(windows: DataFrame, keys: list[str], start: str, end: str, order: str) -> DataFrame:
    """The longest window of each key, the earliest of equals."""
    rank = Window.partitionBy(*keys).orderBy((F.col(end) - F.col(start)).desc(), order)
    return windows.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def averaged_takes(samples: DataFrame, keys: list[str], take: str, idx: str, x: str, lag: str, accepted: str) -> DataFrame:
    """Accepted takes moved by their lags (back only) and added up, over the number accepted."""
    used = samples.where(F.col(accepted))
    many = used.groupBy(*keys).agg(F.countDistinct(take).alias("n"))
    at = F.col(idx) - F.greatest(F.col(lag), F.lit(0))
    moved = used.withColumn("at", at).where("at >= 0").groupBy(*keys, "at").agg(F.sum(F.col(x).cast("double")).alias("s"))
    return moved.join(many, keys).select(*keys, F.col("at").alias(idx), (F.col("s") / F.col("n")).alias("average"))


def first_mismatch(curves: DataFrame, curve: str, values: str) -> DataFrame:
    """(curve, lengths_differ, first_bin): where each array first differs from that of the least curve id."""
    lead = curves.agg(F.min(F.struct(curve, values)).alias("f")).select(F.col(f"f.{values}").alias("_first"))
    both = curves.join(F.broadcast(lead))  # one row
    differ = F.filter(F.transform(F.arrays_zip(F.col(values).alias("a"), F.col("_first").alias("b")), lambda z, i: F.when(~z["a"].eqNullSafe(z["b"]), i)), lambda i: i.isNotNull())
    return both.select(curve, (F.size(values) != F.size("_first")).alias("lengths_differ"), F.array_min(differ).alias("first_bin"))
