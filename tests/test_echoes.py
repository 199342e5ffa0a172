"""Directions of the direct sound and of reflections in rooms whose images are known."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tonelake.plans import echoes

RATE, SPEED = 48000, 343.0
CUBE = np.array([(x, y, z) for x in (0, 0.12) for y in (0, 0.12) for z in (0, 0.12)]) + [2.0, 1.7, 1.2]
ROOM, SOURCE = (10.94, 7.63, 4.86), np.array([3.49, 2.25, 1.2])


def images():
    """The source and its six images of the first order, with what a wall leaves of them."""
    found = [(SOURCE, 1.0)]
    for axis in range(3):
        for wall in (0.0, ROOM[axis]):
            p = SOURCE.copy()
            p[axis] = 2 * wall - p[axis]
            found.append((p, 0.8))
    return found


def response(mic, sources, n=4800):
    t, h = np.arange(n), np.zeros(n)
    for place, gain in sources:
        d = np.linalg.norm(place - mic)
        k = t - d / SPEED * RATE - 200
        h += gain / d * np.sinc(k * 0.5) * 0.5 * np.exp(-((k / 40) ** 2))
    return h + np.random.default_rng(0).normal(0, 1e-6, n)


def rows_of(spark, mics, sources, key="s"):
    rows = [(key, i, *map(float, m), response(m, sources).tolist()) for i, m in enumerate(mics)]
    return spark.createDataFrame(rows, "source string, ordinal int, x double, y double, z double, impulse array<double>")


def test_images_of_a_room_are_found_where_they_are(spark):
    found = echoes.arrivals(rows_of(spark, CUBE, images()), ["source"], RATE, SPEED, 1000.0, 8000.0).orderBy("peak").collect()
    mid = CUBE.mean(0)
    told = [r for r in found if r.reason is None]
    assert told[0].direct and told[0].relative_ms == 0 and told[0].level_db == 0 and sum(r.direct for r in found) == 1
    met = set()
    for r in told:
        ways = [(p - mid) / np.linalg.norm(p - mid) for p, _ in images()]
        off = [np.degrees(np.arccos(np.clip(w @ np.array([r.x, r.y, r.z]), -1, 1))) for w in ways]
        k = int(np.argmin(off))
        late = (np.linalg.norm(images()[k][0] - CUBE[0]) - np.linalg.norm(SOURCE - CUBE[0])) / SPEED * 1000
        assert off[k] < 2 and abs(r.relative_ms - late) < 0.2 and r.residual < 0.5 and not r.mirror_ambiguous
        met.add(k)
    assert len(met) >= 5


def test_flat_arrays_and_arrays_too_small(spark):
    flat = CUBE[CUBE[:, 2] < 1.25]
    alone = [(SOURCE, 1.0)]
    df = rows_of(spark, flat, alone, "flat").unionByName(rows_of(spark, CUBE[:2], alone, "two")).unionByName(rows_of(spark, CUBE[:3] * [0, 0, 1] + [2, 1.7, 0], alone, "line"))
    odd = rows_of(spark, CUBE, alone, "odd").withColumn("impulse", F.expr("if(ordinal = 3, slice(impulse, 1, 4000), impulse)"))
    got = {r.source: r for r in echoes.arrivals(df.unionByName(odd), ["source"], RATE, SPEED, 300.0, 6000.0).where("direct").collect()}
    way = (SOURCE - flat.mean(0)) / np.linalg.norm(SOURCE - flat.mean(0))
    assert got["flat"].mirror_ambiguous and np.degrees(np.arccos(np.clip(way @ [got["flat"].x, got["flat"].y, abs(got["flat"].z)], -1, 1))) < 8  # it lies in the plane, where the part across is told worst
    assert got["two"].reason == got["line"].reason == "few_microphones" and got["odd"].reason == "lengths_differ"
    late = rows_of(spark, CUBE, [(SOURCE * 1, 1.0)]).withColumn("impulse", F.expr("slice(impulse, 400, 40)"))
    assert {r.reason for r in echoes.arrivals(late, ["source"], RATE, SPEED, 300.0, 6000.0).collect()} <= {"window_missing"}
    assert echoes.arrivals(df.limit(0), ["source"], RATE, SPEED).count() == 0


def test_waves_that_fit_no_direction():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=(8, 400))
    assert echoes.plane_wave(noise, CUBE, RATE, SPEED, 300, 6000)["reason"] in ("residual_high", "unreliable_delay", "beyond_aperture")
    assert echoes.plane_wave(noise, CUBE, RATE, SPEED, 3000, 300)["reason"] == "no_band"
    assert echoes.plane_wave(np.zeros((8, 400)), CUBE, RATE, SPEED, 300, 6000)["reason"] == "unreliable_delay"
