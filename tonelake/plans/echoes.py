"""From impulse responses of an array to the directions that the direct sound and its reflections come from.

Events are found on the array's first microphone, each takes its window from
all microphones' responses, and a task tells an event's direction from the
windows: delays against the first one within what the array's size allows, and
the plane wave that fits them best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tonelake.operators.measured import reflections
from tonelake.operators.takes import refined
from tonelake.plans.positions import ranks
from tonelake.plans.reports import direct_segments

# Residual and slack in samples, and periods of the lowest frequency that a window has at least.
MOST_RESIDUAL, SLACK, PERIODS = 0.5, 0.5, 2

_FOUND = "x double, y double, z double, mirror_ambiguous boolean, residual double, reason string"


def plane_wave(windows: np.ndarray, at: np.ndarray, rate: float, speed: float, lo: float, hi: float) -> dict:
    """Where a plane wave comes from that microphones (microphone x sample) at places ``at`` hear in a window, by the band from ``lo`` to ``hi``."""
    none = dict.fromkeys(("x", "y", "z", "residual")) | {"mirror_ambiguous": False}
    m, n = windows.shape
    rank = int(ranks(at[None], np.ones((1, m), bool))[0]) if m >= 3 else 0
    if rank < 2:
        return none | {"reason": "few_microphones"}
    if not lo < hi:
        return none | {"reason": "no_band"}
    size = 1 << math.ceil(math.log2(4 * n))
    f = np.fft.rfftfreq(size, 1 / rate)
    s = np.fft.rfft(windows * np.hanning(n), size) * ((f >= lo) & (f <= hi))
    gaps = at[1:] - at[0]
    most = np.sqrt((gaps**2).sum(1)) / speed * rate + SLACK
    delays = np.empty(m - 1)
    for k in range(1, m):
        # sixteen times as dense, as the band is far below the rate
        r = np.fft.irfft(np.conj(s[0]) * s[k], 16 * size)
        reach = math.ceil(most[k - 1] * 16) + 16
        near = np.r_[r[-reach:], r[: reach + 1]]
        top = int(np.argmax(near))
        if not near[top] > 0 or top in (0, len(near) - 1):
            return none | {"reason": "unreliable_delay"}
        delays[k - 1] = (refined(near, top) - reach) / 16
    if (np.abs(delays) > most).any():
        return none | {"reason": "beyond_aperture"}
    far = -delays * speed / rate
    way, *_ = np.linalg.lstsq(gaps, far, rcond=None)
    if rank == 2:  # in a plane the part across it is what is left to one, on either side
        _, _, axes = np.linalg.svd(at - at.mean(0), full_matrices=False)
        normal = axes[2] * np.sign(axes[2][np.abs(axes[2]).argmax()])
        way = way - (way @ normal) * normal
        way = way + math.sqrt(max(0.0, 1 - way @ way)) * normal
    length = float(np.sqrt(way @ way))
    if not length > 0:
        return none | {"reason": "no_direction"}
    residual = float(np.sqrt(((delays + gaps @ (way / length) * rate / speed) ** 2).mean()))
    if residual > MOST_RESIDUAL:
        return none | {"residual": residual, "mirror_ambiguous": rank == 2, "reason": "residual_high"}
    return {**dict(zip("xyz", map(float, way / length), strict=True)), "residual": residual, "mirror_ambiguous": rank == 2, "reason": None}


def arrivals(responses: DataFrame, keys: list[str], rate: int, speed: float, lo: float = 300.0, hi: float = 3000.0) -> DataFrame:
    """(keys, peak, direct, relative_ms, level_db, x, y, z, mirror_ambiguous, residual, reason) of the direct sound and up to 64 reflections within 80 ms.

    ``responses`` has, for each microphone of a source, its ordinal, its place
    (x, y, z, metres) and its impulse (array), all of one length. The direction
    is a unit vector towards where the sound comes from. An event near an end
    of the responses is ``window_missing``; responses of several lengths make
    every event of their source ``lengths_differ``.
    """
    parts = responses.groupBy(*keys).agg(
        F.min_by("impulse", "ordinal").alias("impulse"), F.min(F.size("impulse")).alias("_least"), F.max(F.size("impulse")).alias("_most"),
        F.array_sort(F.collect_list(F.struct("ordinal", "x", "y", "z", "impulse"))).alias("_all"),  # 32 microphones at most
    )
    segments = reflections(parts.select(*keys, "impulse"), keys, "impulse", rate)
    told = direct_segments(segments, keys, "peak", "energy", rate)
    wide = F.greatest(F.col("end") - F.col("onset"), F.lit(math.ceil(PERIODS * rate / lo)))
    events = told.join(segments.select(*keys, "peak", "direct", "onset", "end"), [*keys, "peak"]).withColumns({"_n": wide, "_from": F.floor(F.col("peak") - wide / 2).cast("int")})
    rows = events.join(parts.drop("impulse"), keys)
    missing = (F.col("_from") < 0) | (F.col("_from") + F.col("_n") > F.col("_least"))
    windows = F.transform("_all", lambda m: F.slice(m["impulse"], F.col("_from") + 1, F.col("_n")))
    places = F.transform("_all", lambda m: F.array(m["x"], m["y"], m["z"]))
    why = F.when(F.col("_least") != F.col("_most"), "lengths_differ").when(missing, "window_missing")
    ready = rows.select(*keys, "peak", "direct", "relative_ms", "level_db", F.when(why.isNull(), windows).alias("windows"), places.alias("places"), why.alias("why"))
    kept = [*keys, "peak", "direct", "relative_ms", "level_db"]
    schema = StructType([*[f for f in ready.schema if f.name in kept], *StructType.fromDDL(_FOUND)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row["why"] is None:
                    w, p = (np.stack([np.asarray(v, np.float64) for v in row[c]]) for c in ("windows", "places"))
                    found = plane_wave(w, p, rate, speed, lo, hi)
                else:
                    found = {"mirror_ambiguous": False, "reason": row["why"]}
                out.append({k: row[k] for k in kept} | found)
            yield pd.DataFrame(out, columns=schema.names)

    return ready.mapInPandas(solve, schema)
