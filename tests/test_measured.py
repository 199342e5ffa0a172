"""Whole recordings with known responses, distortion, drift and echoes show them."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.operators import generators, measured, takes
from tonelake.plans import localization

RATE = 8000


def blocks(spark, signals, names=("take",)):
    rows = [(*(key if isinstance(key, tuple) else (key,)), b, x[i : i + 2048].astype(float).tolist()) for key, x in signals.items() for b, i in enumerate(range(0, len(x), 2048))]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", block int, samples array<double>").repartition(3)


def whole(rows):
    return np.concatenate([r.samples for r in sorted(rows, key=lambda r: r.block)])


def sweep(lo=100.0, hi=3000.0, seconds=1.0):
    k, t = seconds / math.log(hi / lo), np.arange(round(seconds * RATE)) / RATE
    return np.sin(2 * np.pi * lo * k * (np.exp(t / k) - 1))


def chirp(n=800):
    t = np.arange(n) / RATE
    return np.sin(2 * np.pi * (500 * t + (3000 - 500) / (2 * n / RATE) * t * t)) * np.hanning(n)


def test_rate_conversion(spark):
    t = np.arange(3001) / RATE
    y = whole(measured.at_rate(blocks(spark, {"a": np.sin(2 * np.pi * 440 * t)}), ["take"], RATE, 6000).collect())
    assert len(y) == math.ceil(3001 * 6000 / 8000) and np.abs(y[100:-100] - np.sin(2 * np.pi * 440 * np.arange(len(y)) / 6000)[100:-100]).max() < 2e-3
    high = whole(measured.at_rate(blocks(spark, {"a": np.sin(2 * np.pi * 3600 * t)}), ["take"], RATE, 4000).collect())
    assert np.abs(high[100:-100]).max() < 1e-2  # what the lower rate cannot hold is gone
    same = measured.at_rate(blocks(spark, {"a": t}), ["take"], RATE, RATE).collect()
    assert np.allclose(whole(same), t.astype(np.float32))


def test_drift_is_taken_out_or_left(spark):
    n = 24000
    sent = np.zeros(n)
    sent[1000:1800], sent[21000:21800], sent[6000:14000] = chirp(), chirp(), sweep() * 0.5

    def drifted(ppm):
        return takes.resampled(sent, np.clip(1000 + (np.arange(n) - 1000) / (1 + ppm / 1e6), 0, n - 1))

    rows = blocks(spark, {"none": drifted(5), "some": drifted(60), "much": drifted(400), "silent": np.zeros(n)})
    fixed, report = measured.drift_corrected(rows, ["take"], chirp(), (1000, 21000), 400, sweep() * 0.5, RATE)
    got = {r.take: r for r in report.collect()}
    assert {k: r.action for k, r in got.items()} == {"none": "none", "some": "correct", "much": "correct_and_advise", "silent": "none"}
    assert [got[k].corrected for k in ("none", "some", "much", "silent")] == [False, True, True, False] and not any(r.discarded for r in got.values())
    assert got["much"].ppm == pytest.approx(400, abs=8) and got["much"].advisory_ppm == pytest.approx(400, abs=8) and got["some"].advisory_ppm is None
    much = whole([r for r in fixed.collect() if r.take == "much"])
    assert len(much) == n and np.corrcoef(much[21000:21800], chirp())[0, 1] > 0.98 > np.corrcoef(drifted(400)[21000:21800], chirp())[0, 1]
    same, report = measured.drift_corrected(rows, ["take"], None, (1000, 21000), 400, sweep(), RATE)
    assert same.count() == rows.count() and {(r.action, r.ppm, r.corrected) for r in report.collect()} == {("none", None, False)}


def test_phase_is_calibrated(spark):
    s = np.concatenate([sweep(), np.zeros(192)])
    x = np.roll(s, 8) * 0.5
    rows = blocks(spark, {"a": x, "short": x[:100], "unbound": x, "alone": x}).withColumns({"mic": F.when(F.col("take") == "alone", "none").otherwise("m"), "us": F.when(F.col("take") != "unbound", F.lit(20.0))})
    curve = spark.createDataFrame([("m", 200.0, 6.0), ("m", 2000.0, 6.0), ("m", 2500.0, 6.0)], "mic string, frequency_hz double, spl_db double")
    got = {r.take: r for r in measured.calibrated_phase(rows, ["take"], s, RATE, curve, "mic", (100.0, 3000.0), "us").collect()}
    assert {k: r.issue for k, r in got.items()} == {"a": None, "short": "sweep_decay_missing", "unbound": "timing_bound", "alone": "calibration_missing"}
    a = got["a"]
    assert (a.low_hz, a.high_hz, a.timing_limit_hz) == (200.0, 2500.0, 1250.0)
    assert np.allclose([p.db for p in a.response], 20 * math.log10(0.5) - 6, atol=0.05)
    turn = np.angle(np.exp(1j * (np.radians([p.deg for p in a.response]) + 2 * np.pi * np.array([p.hz for p in a.response]) * 8 / RATE)))
    assert np.abs(turn).max() < 0.02 and int(np.argmax(a.impulse)) == 8


def test_distortion_of_a_square_law(spark):
    s = np.concatenate([sweep(), np.zeros(2000)])
    got = measured.distortion(blocks(spark, {"a": np.roll(s, 80) + 0.1 * np.roll(s, 80) ** 2}), ["take"], (100.0, 3000.0, 1.0), RATE, 4).where("frequency_hz between 250 and 1200").collect()
    assert len(got) > 20 and all(abs(r.spl_db) < 0.5 and abs(r.group_delay_ms - 10) < 0.5 for r in got)
    assert np.median([r.thd_percent for r in got]) == pytest.approx(5.0, rel=0.15)


def test_sets_of_takes(spark):
    rng, s = np.random.default_rng(5), sweep()
    quiet = lambda x: np.concatenate([np.zeros(300), x, np.zeros(500)]) + rng.normal(size=len(x) + 800) * 1e-3
    signals = {("g", str(i)): quiet(0.5 * s) for i in range(4)}
    signals[("g", "odd")] = quiet(0.5 * s - 0.3 * np.roll(s, 1))
    signals[("g", "noise")], signals[("g", "short")] = rng.normal(size=9000), s[:50]
    curves, verdicts = measured.take_sets(blocks(spark, signals, ("unit", "take")), ["unit"], "take", s, RATE)
    got = {r.take: (r.accepted, r.reason) for r in verdicts.collect()}
    assert got == {**{str(i): (True, None) for i in range(4)}, "odd": (False, "outlier"), "noise": (False, "low_confidence"), "short": (False, "take_unusable")}
    inner = [r for r in curves.collect() if 300 < r.frequency_hz < 2500]
    assert all(abs(r.spl_db - 20 * math.log10(0.5)) < 0.7 and r.coherence > 0.99 for r in inner) and len(inner) > 100
    alone, _ = measured.take_sets(blocks(spark, {("h", "0"): quiet(s)}, ("unit", "take")), ["unit"], "take", s, RATE)
    assert {r.coherence for r in alone.collect()} == {None}


def test_noise_floors_and_spectrograms(spark):
    t = np.arange(6000)
    tone = np.sin(2 * np.pi * 256 * t / 2048)
    rows = blocks(spark, {"tone": tone, "zeros": np.zeros(6000), "short": tone[:1000]})
    got = {r.take: r for r in measured.noise_floor(rows, ["take"], F.lit(5000), RATE).collect()}
    assert {k: r.reason for k, r in got.items()} == {"tone": None, "zeros": "digital_zeros", "short": "no_quiet_window"}
    assert int(np.argmax(got["tone"].levels)) == 256 and max(got["tone"].levels) == pytest.approx(0.0, abs=0.05)
    rows = measured.spectrogram(rows, ["take"], RATE).collect()
    assert {r.take for r in rows} == {"tone", "zeros"} and {int(np.argmax(r.levels)) for r in rows if r.take == "tone"} == {128} and len([r for r in rows if r.take == "tone"]) == (6000 - 1024) // 512 + 1


def test_envelope_against_brute_force(spark):
    c = chirp()
    x = np.zeros(6000)
    x[1234:2034] += c
    x[4000:4800] += 0.1 * c
    got = {r.take: r for r in measured.envelope_peak(blocks(spark, {"a": x, "b": c[:100]}), ["take"], c, 300).collect()}
    assert got["a"].peak == 1234 and abs(got["a"].refined - 1234) < 0.5 and got["a"].sidelobe_db == pytest.approx(20, abs=0.5) and got["b"].peak is None
    r = np.correlate(x, c, "valid")
    other = np.correlate(x, np.imag(np.fft.ifft(np.fft.fft(c, 8192) * np.r_[0, np.full(4095, 2), 0, np.zeros(4095)]))[:800], "valid")
    assert int(np.argmax(np.hypot(r, other))) == pytest.approx(1234, abs=1)


def test_reflections_and_their_directions(spark):
    rng = np.random.default_rng(2)
    h = rng.normal(size=2000) * 1e-4
    for at, level in ((100, 1.0), (180, 0.5), (420, 0.25)):
        h[at] += level
    none = spark.createDataFrame([("a", h.tolist()), ("b", None), ("c", []), ("d", [0.0] * 50)], "source string, h array<double>")
    got = sorted(measured.reflections(none, ["source"], "h", RATE).collect(), key=lambda r: r.peak)
    assert [(r.source, r.peak, r.direct) for r in got] == [("a", 100, True), ("a", 180, False), ("a", 420, False)] and got[1].energy == pytest.approx(0.25, rel=0.01)
    places, way = [(0, 0, 0), (0.3, 0, 0), (0, 0.3, 0), (0, 0, 0.3)], np.array([0.6, 0.0, 0.8])
    heard = [(0, i, np.sinc(np.arange(200) - 100 + (np.array(p) @ way) / 343 * RATE).tolist()) for i, p in enumerate(places)]
    events = spark.createDataFrame(heard, "event int, mic int, x array<double>")
    pairs = measured.pair_delays(events, ["event"], "mic", "x", 20)
    other = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "mic int, dx double, dy double, dz double")
    (r,) = localization.directions(pairs.join(other, "mic"), ["event"], 343.0, RATE).collect()
    assert np.array([r.x, r.y, r.z]) == pytest.approx(way, abs=0.03) and r.reason is None


def test_intelligibility(spark):
    rate, rng = 48000, np.random.default_rng(4)
    dry = np.zeros(2 * rate)
    dry[10] = 1.0
    wet = rng.normal(size=2 * rate) * 10 ** (-3 * np.arange(2 * rate) / (2.0 * rate))
    rows = spark.createDataFrame([("dry", dry.tolist()), ("wet", wet.tolist()), ("short", [1.0]), ("none", None)], "room string, h array<double>")
    got = {r.room: r for r in measured.speech_transmission(rows, ["room"], "h", rate).collect()}
    assert got["dry"].sti == pytest.approx(1.0, abs=0.02) and got["short"].sti is None and got["none"].mti is None
    # exponential decay of 2 s has m = 1 / sqrt(1 + (2 pi F T / 13.8)^2)
    m = 1 / np.sqrt(1 + (2 * np.pi * np.array(measured.STI_MODULATIONS) * 2.0 / 13.8) ** 2)
    theory = ((np.clip(10 * np.log10(m / (1 - m)), -15, 15) + 15) / 30).mean()
    assert got["wet"].mti == pytest.approx([theory] * 7, abs=0.06)


def test_ears_on_one_clock(spark):
    x, c = np.zeros(6000), chirp()
    x[700:1500] = c * 0.5
    ear = lambda by: np.roll(x, by)
    signals = {("h", "loop"): x, ("h", "left"): ear(30), ("h", "right"): ear(45), ("late", "loop"): x, ("late", "left"): x[:2000], ("late", "right"): x}
    signals |= {("mute", "loop"): x, ("mute", "left"): x, ("mute", "right"): x * 0, ("two", "loop"): x, ("two", "left"): x}
    out, issues = measured.ear_pairs_aligned(blocks(spark, signals, ("head", "ch")), ["head"], "ch", "loop", c, 2400)
    assert {r.head: r.issue for r in issues.collect()} == {"late": "window_incomplete", "mute": "silent", "two": "channel_missing"}
    rows = out.collect()
    assert {r.head for r in rows} == {"h"}
    assert [int(np.argmax(np.correlate(whole([r for r in rows if r.ch == ch]), c, "valid"))) for ch in ("loop", "left", "right")] == [0, 30, 45]


def test_noise_and_sequences(spark):
    n = 1 << 15
    x = generators.frames(spark, n / RATE, RATE).select("idx", generators.pink_noise(3, 0.5).alias("x")).orderBy("idx").toPandas().x.to_numpy()
    p = np.abs(np.fft.rfft(x)) ** 2
    bands = [10 * np.log10(p[1 << k : 2 << k].mean()) for k in range(5, 14)]
    assert np.polyfit(range(len(bands)), bands, 1)[0] == pytest.approx(-3.0, abs=0.6) and np.abs(x).max() <= 0.5
    for order in (2, 5, 8, 12, 14):
        s = generators.mls(spark, order, 1.0, block=1000).orderBy("idx").toPandas().x.to_numpy()
        around = np.fft.irfft(np.abs(np.fft.rfft(s)) ** 2, len(s))
        assert len(s) == (1 << order) - 1 and around[0] == pytest.approx(len(s)) and np.allclose(around[1:], -1, atol=1e-6)
    with pytest.raises(ValueError, match="2 to 24"):
        generators.mls(spark, 1, 1.0)
    x = generators.frames(spark, 4.0, 48000).select("idx", generators.stipa(48000, 0.5).alias("x")).orderBy("idx").toPandas().x.to_numpy()
    f = np.fft.rfftfreq(len(x), 1 / 48000)
    band = lambda hz: np.fft.irfft(np.fft.rfft(x) * ((f > hz / 1.3) & (f < hz * 1.3)), len(x)) ** 2
    e, t = band(1000), np.arange(len(x)) / 48000
    assert 2 * abs((e * np.exp(-2j * np.pi * 2.0 * t)).sum()) / e.sum() == pytest.approx(0.55, abs=0.08)
    assert 10 * np.log10(band(250).sum() / band(2000).sum()) == pytest.approx(15.7, abs=1.0) and np.abs(x).max() < 1
