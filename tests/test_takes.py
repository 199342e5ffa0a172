"""Whole-take estimates find what was put into synthetic takes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.operators import generators, takes

RATE = 8000


def blocks(spark, signals):
    rows = [(name, b, x[i : i + 2048].astype(float).tolist()) for name, x in signals.items() for b, i in enumerate(range(0, len(x), 2048))]
    return spark.createDataFrame(rows, "take string, block int, samples array<double>").repartition(3)


def chirp(n=800):
    t = np.arange(n) / RATE
    return np.sin(2 * np.pi * (500 * t + (3000 - 500) / (2 * n / RATE) * t * t)) * np.hanning(n)


def test_clock_is_found_and_undone(spark):
    n, ppm, offset = 24000, 150.0, 300.25
    sent = np.zeros(n)
    sent[1000:1800] = chirp()
    sent[21000:21800] = chirp()
    at = (np.arange(n + 2000) - offset) / (1 + ppm / 1e6)
    x = takes.resampled(sent, np.clip(at, 0, n - 1)) * ((at >= 0) & (at < n))
    rows = blocks(spark, {"a": x, "silent": np.zeros(len(x)), "short": x[:5000]})
    lags = takes.marker_lags(rows, ["take"], chirp(), [(500, 3000), (20500, 23500)])
    fits = {r.take: r for r in takes.clock_fits(lags, ["take"], 20000).collect()}
    assert fits["a"].skew_ppm == pytest.approx(ppm, abs=8) and fits["a"].offset == pytest.approx(1000 * (1 + ppm / 1e6) + offset, abs=0.2)
    assert (fits["silent"].reason, fits["short"].reason) == ("low_confidence", "window_missing")
    moved = takes.on_common_clock(rows, ["take"], takes.clock_fits(lags, ["take"], 20000), 20800).collect()
    y = np.concatenate([r.samples for r in sorted(moved, key=lambda r: r.block)])
    assert {r.take for r in moved} == {"a"} and np.corrcoef(y[:800], chirp())[0, 1] > 0.99 and np.corrcoef(y[20000:], chirp())[0, 1] > 0.98


def test_decay_of_a_known_response(spark):
    rng = np.random.default_rng(3)
    h = rng.normal(size=4000) * 10 ** (-3 * np.arange(4000) / (0.4 * RATE))
    h[0] = 8
    s = rng.normal(size=RATE)
    x = np.convolve(s, np.concatenate([np.zeros(40), h]))
    r = takes.responses(blocks(spark, {"a": x}), ["take"], s, RATE, 6000, floor=1e-5).first()
    assert r.direct_ms == pytest.approx(5.0) and r.rt60_ms == pytest.approx(400, rel=0.15) and r.c80_db > r.c50_db


def test_outliers_are_not_accepted(spark):
    rows = spark.createDataFrame([("g", i, 1.0 + 0.01 * i) for i in range(6)] + [("g", 9, 5.0)], "k string, i int, v double")
    assert sorted(r.i for r in takes.trusted(rows, ["k"], "v").where("accepted").collect()) == list(range(6))


def test_generators(spark):
    n = 512
    rows = generators.multitone(spark, n, RATE, 0.5, 500.0, 3500.0).orderBy("idx").toPandas()
    spectrum = np.abs(np.fft.rfft(rows.x))
    assert rows.x.abs().max() == pytest.approx(0.5) and np.flatnonzero(spectrum > 1e-6 * spectrum.max()).tolist() == list(range(32, 225))
    with pytest.raises(ValueError, match="16 tones"):
        generators.multitone(spark, 64, RATE, 0.5, 500.0, 900.0)
    sweep = generators.octave_sweep(spark, 20.0, 3000.0, 0.5, 0.1, RATE, silence=0.01).orderBy("idx").toPandas()
    zones = generators.octave_zones(20.0, 3000.0, 0.1)
    assert len(sweep) == 160 + sum(round(z[2] * RATE) for z in zones) and np.abs(np.diff(sweep.x)).max() < 2 * math.pi * 3000 / RATE * 0.5 + 0.1
    burst = generators.wake_burst(spark, RATE, 0.9).toPandas()
    assert len(burst) == 2000 and burst.x.abs().max() <= 0.5 and generators.wake_burst(spark, RATE, 0.0).count() == 0
    quiet = generators.frames(spark, 0.1, RATE).select(generators.faded(generators.tone(100.0, 1.0, RATE), 800, 80).alias("x"), "idx").orderBy("idx").first()
    assert quiet.x == 0.0
    assert generators.frames(spark, 1.0, RATE).select(F.sum(generators.dirac(2.0)).alias("s")).first().s == 2.0
