"""From arrivals to ranges: the mode of a session, its matrix, and its refusals.

All of it is joins and column expressions over (session, source, microphone,
repeat) rows, so sessions of any number run in one job.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.acoustics import propagation_metres, range_sigma
from tonelake.functions.levels import is_finite
from tonelake.plans.positions import solved_positions


class Medium(NamedTuple):
    """What turns samples into metres: speed of sound, rate, the longest range there is, the microphone's bias, and uncertainties."""

    speed: Column
    rate: Column
    longest: Column
    bias: Column
    speed_sigma: Column
    bias_sigma: Column


def _refused(reason: Column, *values: tuple[str, Column]) -> list[Column]:
    """Values that are null wherever there is a reason, and the reason."""
    return [*[F.when(reason.isNull(), v).alias(n) for n, v in values], reason.alias("reason")]


def full_matrix(sources: DataFrame, microphones: DataFrame, repeats: DataFrame, takes: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every cell that a plan asks for, with its take's columns where there is one."""
    every = repeats.join(sources, keys).join(microphones, keys)
    return every.join(takes.withColumn("taken", F.lit(True)), [*keys, "source_id", "microphone_id", "repeat_index"], "left")


def mode(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mode): loopback if every group has a stable one, else emitter if every take has a fixed reference, else relative."""
    with_loop = F.every(F.col("loopback_arrival").isNotNull() & F.coalesce("loopback_stable", F.lit(False)))
    fixed = F.every(F.coalesce("fixed_reference", F.lit(False)))
    return cells.where("taken").groupBy(*keys).agg(F.when(with_loop, "loopback").when(fixed, "emitter").otherwise("relative").alias("mode"))


def _measured(cells: DataFrame, propagation: Column, sigma: Column, reason: Column, medium: Medium) -> DataFrame:
    """Ranges of so many samples of sound, less the source's own delay and the microphone's bias, with their uncertainties."""
    d = propagation_metres(propagation, medium.rate, medium.speed, F.col("source_delay_ms"), medium.bias)
    why = F.coalesce(reason, F.when(d.isNull() | (d < 0) | (d > medium.longest), "range_implausible"))
    sigma_m = range_sigma(sigma, d, medium.rate, medium.speed, medium.speed_sigma, medium.bias_sigma)
    return cells.select("*", *_refused(why, ("distance_m", d), ("sigma_samples", sigma), ("sigma_m", sigma_m)))


def _heard(reason: Column) -> Column:
    """What keeps a take from having an arrival, after ``reason``."""
    clock = F.when(F.col("clock_ratio").isNull(), "clock_uncorrected")
    return F.coalesce(reason, clock, F.when(~is_finite(F.col("arrival")), F.coalesce("arrival_reason", F.lit("arrival_low_confidence"))))


def loopback_ranges(cells: DataFrame, medium: Medium) -> DataFrame:
    """Ranges against the group's loopback, on the microphone's clock; the loopback counts only for takes of its own device."""
    propagation = (F.col("arrival") - F.col("loopback_arrival")) / F.col("clock_ratio")
    absent = F.when(F.col("taken").isNull(), "take_missing").when(~is_finite(F.col("loopback_arrival")) | ~F.col("device").eqNullSafe(F.col("loopback_device")), "loopback_unavailable")
    sigma = F.sqrt(F.col("sigma") * F.col("sigma") + F.col("loopback_sigma") * F.col("loopback_sigma")) / F.col("clock_ratio")
    return _measured(cells, propagation, sigma, _heard(absent), medium)


def emitter_ranges(cells: DataFrame, sweep_frame: Column, medium: Medium) -> DataFrame:
    """Ranges against the stimulus clock that the surveyed emitter fixed; without a bound on the clock they have no uncertainty."""
    propagation = (F.col("arrival") - F.col("clock_offset")) / F.col("clock_ratio") - sweep_frame
    absent = _heard(F.when(F.col("taken").isNull(), "take_missing"))
    reason = F.coalesce(absent, F.when(F.col("clock_offset").isNull(), "clock_uncorrected"))
    sigma = F.sqrt(F.col("sigma") * F.col("sigma") + F.col("clock_bound") * F.col("clock_bound"))
    return _measured(cells, propagation, sigma, reason, medium)


def relative_delays(cells: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Delays against the first microphone of each group, in the plan's order, that has an arrival; no ranges."""
    missing = _heard(F.when(F.col("taken").isNull(), "take_missing"))
    group = Window.partitionBy(*keys, "source_id", "repeat_index")
    lead = F.min(F.when(missing.isNull(), F.struct(F.col(order).alias("o"), F.col("arrival").alias("a"), F.col("sigma").alias("s")))).over(group)
    rows = cells.withColumn("_lead", lead)
    delay = F.when(missing.isNull(), (F.col("arrival") - F.col("_lead.a")) / F.col("clock_ratio"))
    sigma = F.when(missing.isNull(), F.sqrt(F.col("sigma") * F.col("sigma") + F.col("_lead.s") * F.col("_lead.s")) / F.col("clock_ratio"))
    none = F.lit(None).cast("double")
    return rows.select(
        "*", delay.alias("tdoa_samples"), sigma.alias("tdoa_sigma_samples"), none.alias("distance_m"), none.alias("sigma_samples"), none.alias("sigma_m"),
        F.coalesce(missing, F.lit("no_absolute_time_origin")).alias("reason"),
    ).drop("_lead")


def ranges(cells: DataFrame, keys: list[str], order: str, sweep_frame: Column, medium: Medium) -> DataFrame:
    """All cells with their range, each session's by its own mode, which is a column too."""
    timed = cells.join(mode(cells, keys), keys)
    none = F.lit(None).cast("double")
    parts = [
        loopback_ranges(timed.where("mode = 'loopback'"), medium).withColumns({"tdoa_samples": none, "tdoa_sigma_samples": none}),
        emitter_ranges(timed.where("mode = 'emitter'"), sweep_frame, medium).withColumns({"tdoa_samples": none, "tdoa_sigma_samples": none}),
        relative_delays(timed.where("mode = 'relative'"), keys, order),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def localized(cells: DataFrame, keys: list[str], order: str, sweep_frame: Column, medium: Medium, sample_m: float) -> tuple[DataFrame, DataFrame]:
    """A session from arrivals to places: all range cells of its mode, and the sources' positions with their verdicts."""
    found = ranges(cells, keys, order, sweep_frame, medium)
    return found, solved_positions(found, keys, sample_m)


def position_line(name: Column, x: Column, y: Column, z: Column, rms_m: Column, gdop: Column, mirrored: Column, reason: Column) -> Column:
    """A position as one line of a report."""
    empty = F.lit("")
    detail = F.concat(
        F.when(rms_m.isNotNull(), F.format_string(" rms %.1f mm", rms_m * 1000)).otherwise(empty), F.when(gdop.isNotNull(), F.format_string(" gdop %.1f", gdop)).otherwise(empty),
        F.when(mirrored, " [mirror-ambiguous]").otherwise(empty),
    )
    at = F.when(x.isNotNull(), F.format_string("position: [%.3f, %.3f, %.3f] m", x, y, z)).otherwise(F.concat(F.lit("position: refused ("), F.coalesce(reason, F.lit("unknown")), F.lit(")")))
    return F.concat(F.lit("localization "), name, F.lit(" "), at, detail)


def bench_bias(measured: Column, bias_m: Column) -> Column:
    """(bias_m, sigma_m) of a microphone: a measured bias is known to 2 mm, without one both are 0."""
    known = F.coalesce(measured, F.lit(False)) & bias_m.isNotNull()
    return F.struct(F.when(known, bias_m).otherwise(0.0).alias("bias_m"), F.when(known, 0.002).otherwise(0.0).alias("sigma_m"))


def _cramer(a: list[list[Column]], b: list[Column]) -> list[Column]:
    """The solution of a symmetric 3 by 3 system by determinants; nulls where it has next to none."""

    def det(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    whole, scale = det(a), a[0][0] + a[1][1] + a[2][2]
    safe = F.when(F.abs(whole) > 1e-9 * scale * scale * scale, whole)
    return [det([[b[r] if c == k else a[r][c] for c in range(3)] for r in range(3)]) / safe for k in range(3)]


def linear_positions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source_id, x, y, z, links): where spheres around surveyed microphones meet, by linear least squares.

    Every usable range less the mean of its source's ranges is one equation in
    x, y and z, so a source is ten sums, which Spark adds up, and one 3 by 3
    system, solved in closed form. Microphones in one plane give nulls.
    """
    usable = cells.where(is_finite(F.col("distance_m")) & F.col("mic_x").isNotNull())
    q = F.col("mic_x") * F.col("mic_x") + F.col("mic_y") * F.col("mic_y") + F.col("mic_z") * F.col("mic_z") - F.col("distance_m") * F.col("distance_m")
    rows = usable.select(*keys, "source_id", *[F.col(f"mic_{a}").alias(a) for a in "xyz"], (q / 2).alias("q"))
    cov = lambda a, b: F.covar_pop(a, b)
    sums = rows.groupBy(*keys, "source_id").agg(
        F.count("*").alias("links"), *[cov(a, b).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")], *[cov(a, "q").alias("q" + a) for a in "xyz"]
    )
    m = {k: F.col(k) for k in ("xx", "yy", "zz", "xy", "xz", "yz", "qx", "qy", "qz")}
    rows3 = [[m["xx"], m["xy"], m["xz"]], [m["xy"], m["yy"], m["yz"]], [m["xz"], m["yz"], m["zz"]]]
    solved = _cramer(rows3, [m["qx"], m["qy"], m["qz"]])
    return sums.select(*keys, "source_id", *[s.alias(a) for s, a in zip(solved, "xyz", strict=True)], "links")


def directions(pairs: DataFrame, keys: list[str], speed: float, rate: float, most: float = 0.5) -> DataFrame:
    """(keys, x, y, z, residual, reason): where a plane wave comes from, told by delays between pairs of microphones.

    ``pairs`` has dx, dy, dz (metres from the first microphone to the other) and
    tdoa (samples the other hears it later). Arrays in a plane or on a line
    leave a direction open, and delays that no plane wave has are refused.
    """
    d = F.col("tdoa") * speed / rate
    ok = pairs.where(is_finite(F.col("tdoa")) & (F.abs(F.col("tdoa")) <= F.sqrt(F.expr("dx*dx+dy*dy+dz*dz")) * rate / speed + 0.5))
    sums = ok.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.sum(F.col(f"d{a}") * F.col(f"d{b}")).alias(f"m{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")], *[F.sum(-d * F.col(f"d{a}")).alias(f"v{a}") for a in "xyz"]
    )
    m = {k: F.col(f"m{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    solved = _cramer([[m["xx"], m["xy"], m["xz"]], [m["xy"], m["yy"], m["yz"]], [m["xz"], m["yz"], m["zz"]]], [F.col(f"v{a}") for a in "xyz"])
    at = sums.select(*keys, "n", *[s.alias(a) for s, a in zip(solved, "xyz", strict=True)])
    at = at.withColumn("len", F.sqrt(F.expr("x*x + y*y + z*z")))
    both = ok.join(at, keys)
    miss = F.abs(d + (F.col("x") * F.col("dx") + F.col("y") * F.col("dy") + F.col("z") * F.col("dz"))) * rate / speed
    worst = both.groupBy(*keys, "n", "x", "y", "z", "len").agg(F.max(miss).alias("residual"))
    reason = F.when(F.col("x").isNull() | (F.col("n") < 3), "degenerate_geometry").when(F.col("residual") > most, "residual_high")
    return worst.select(*keys, *[F.when(reason.isNull(), F.col(a) / F.col("len")).alias(a) for a in "xyz"], "residual", reason.alias("reason"))
