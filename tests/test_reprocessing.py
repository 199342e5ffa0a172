"""Recordings analysed in one pass, and saved sessions analysed anew only where something changed."""

from __future__ import annotations

import numpy as np

from tonelake.operators import analysis
from tonelake.plans import reprocessing
from tonelake.sources.recordings import encode

RATE = 24000
s, k = np.arange(24000) / RATE, 1.0 / np.log(10000 / 40)
SWEEP = 0.5 * np.sin(2 * np.pi * 40 * k * (np.exp(s / k) - 1)) * np.minimum(1, np.minimum(np.arange(24000), np.arange(24000)[::-1]) / 120)


def recording(gain=0.5, lag=1200, square=0.0, rt60=None, tail=6000, noise=1e-5, seed=1):
    x = np.zeros(lag + len(SWEEP) + tail)
    y = gain * SWEEP + square * (SWEEP / 0.5) ** 2
    if rt60:
        t = np.arange(4000) / RATE
        h = np.random.default_rng(3).normal(0, 0.05, 4000) * 10 ** (-3 * t / rt60)
        h[0] = 1
        y = np.convolve(y, h)
    x[lag : lag + len(y)] += y[: len(x) - lag]
    return x + np.random.default_rng(seed).normal(0, noise, len(x))


def test_a_recording_in_one_pass():
    a = analysis.analysed(recording(), SWEEP, RATE, 40, 10000)
    c = a["curve"]
    inside = (c["frequency_hz"] > 100) & (c["frequency_hz"] < 8000)
    assert abs(a["lag"] - 1200) < 0.1 and a["clipped"] == 0 and a["quiet_power"] < 1e-9 < a["active_power"]
    assert np.abs(c["spl_db"][inside] - 20 * np.log10(0.5)).max() < 0.3 and np.abs(c["phase_deg"][inside]).max() < 5 and np.abs(c["group_delay_ms"][inside]).max() < 0.2
    assert np.nanmax(c["thd_percent"][inside]) < 0.5
    # x * x of a sine is half a sine of twice the frequency: a tenth of the sine is 5 percent of half of it, or so
    b = analysis.analysed(recording(square=0.05), SWEEP, RATE, 40, 10000)
    low = (c["frequency_hz"] > 150) & (c["frequency_hz"] < 3000)
    assert np.abs(b["curve"]["thd_percent"][low] - 100 * 0.025 / 0.25).max() < 1.5 and b["harmonics"]
    assert np.isnan(c["thd_percent"][c["frequency_hz"] > 5100]).all()
    d = analysis.analysed(recording(rt60=0.2), SWEEP, RATE, 40, 10000)["curve"]
    assert np.abs(d["rt60_ms"][(d["frequency_hz"] > 700) & (d["frequency_hz"] < 6000)] - 200).max() < 40
    late = recording(lag=1200)
    assert abs(analysis.analysed(np.r_[late, np.zeros(10)], SWEEP, RATE, 40, 10000)["lag"] - 1200) < 0.1


def test_recordings_that_tell_nothing(spark):
    good = recording().astype(np.float32)
    takes = {"good": good, "short": good[:1000], "noise": np.random.default_rng(0).normal(0, 0.1, 40000), "nan": np.where(np.arange(len(good)) == 5, np.nan, good)}
    rows = [(name, b, [float(v) for v in x[i : i + 4096]]) for name, x in takes.items() for b, i in enumerate(range(0, len(x), 4096))]
    got = {r.take: r for r in analysis.take_analyses(spark.createDataFrame(rows, "take string, block int, samples array<float>"), ["take"], SWEEP, RATE, 40, 10000).collect()}
    assert {n: r.issue for n, r in got.items()} == {"good": None, "short": "shorter than the reference", "noise": "the reference is not found in it", "nan": "samples that are not finite"}
    assert len(got["good"].curve) > 80 and got["good"].curve[-1].thd_percent is None and got["nan"].curve is None


def test_csv_has_all_columns_and_the_microphone_taken_off():
    a = analysis.analysed(recording(), SWEEP, RATE, 40, 10000)["curve"]
    lines = analysis.csv_of(a).splitlines()
    assert lines[0] == "frequency_hz,spl_db,phase_deg,thd_percent,rt60_ms,c50_db,c80_db,group_delay_ms" and len(lines) == 1 + len(a["spl_db"])
    assert lines[-1].split(",")[3] == "NaN" and "nan" not in "".join(lines[1:])
    off = analysis.csv_of(a, (np.array([10.0, 20000.0]), np.array([3.0, 3.0]))).splitlines()
    assert abs(float(lines[20].split(",")[1]) - float(off[20].split(",")[1]) - 3) < 1e-3


COLUMNS = "session string, ordinal int, channel_name string, wav_path string, csv_path string, success boolean, error string, mic_calibration_path string, session_calibrations array<string>, session_calibration string, sample_rate_hz int, lo_hz double, hi_hz double"
KNOWN = "session string, ordinal int, success boolean, input_sha256 string, output_sha256 string"


def test_only_what_changed_is_computed_anew(spark, tmp_path):
    rows = []
    for name in ("a", "b"):
        folder = tmp_path / name
        (folder / "sub").mkdir(parents=True)
        (folder / "reference.wav").write_bytes(encode(SWEEP[:, None].astype(np.float32), RATE))
        (folder / "own.txt").write_text("20 6\n20000 6\n")
        (folder / "common.txt").write_text("20 -6\n20000 -6\n")
        for i in range(5):
            if i != 3:
                (folder / f"{i}.wav").write_bytes(encode(recording(seed=i)[:, None].astype(np.float32), RATE))
        own = [None, "own.txt", "gone.txt", None, ""]
        for i in range(5):
            rows.append((name, i, f"ch{i}", f"{i}.wav", f"sub/{i}.csv" if i == 1 else f"{i}.csv", not (name == "b" and i == 4), "hum" if name == "b" and i == 4 else None, own[i], [None, None, None, None, "own.txt"], "common.txt", RATE, 40.0, 10000.0))
    (tmp_path / "b" / "2.wav").write_bytes(b"RIFF")
    channels = spark.createDataFrame(rows, COLUMNS)
    run = lambda known: reprocessing.reprocess(spark, str(tmp_path), channels, known).cache()
    told = lambda df: {(r.session, r.ordinal): (r.state, r.error) for r in df.collect()}
    first = run(spark.createDataFrame([], KNOWN))
    got = told(first)
    assert {v[0] for q, v in got.items() if q[1] in (0, 1)} == {"recomputed"} and got["a", 2][0] == got["a", 4][0] == "recomputed"
    assert got["b", 4] == ("passed_on", "hum") and got["a", 3] == ("failed", "WAV file not found: 3.wav") and got["b", 2][1].startswith("Analysis failed: ")
    level = lambda p: np.mean([float(x.split(",")[1]) for x in (tmp_path / p).read_text().splitlines()[30:60]])
    base = 20 * np.log10(0.5)
    # its own calibration, the common one without one or for one that is gone; the empty name is none
    for path, shift in (("a/0.csv", 6), ("a/sub/1.csv", -6), ("a/2.csv", 6), ("a/4.csv", 6)):
        assert abs(level(path) - base - shift) < 0.3, path
    assert not (tmp_path / "b" / "4.csv").exists() and not list(tmp_path.rglob("*.part"))

    def counts(df):
        return {r.state: r.channels for r in reprocessing.recomputed(df).collect()}

    assert counts(first) == {"recomputed": 6, "failed": 3, "passed_on": 1}
    again = run(first)
    assert counts(again).get("recomputed") is None and {q for q, v in told(again).items() if v[0] == "unchanged"} == {q for q, v in got.items() if v[0] == "recomputed"}
    (tmp_path / "a" / "0.wav").write_bytes(encode(recording(gain=0.25)[:, None].astype(np.float32), RATE))  # a recording
    (tmp_path / "a" / "2.csv").write_text("spoilt")  # a result
    (tmp_path / "b" / "own.txt").write_text("20 3\n20000 3\n")  # a calibration
    third = run(again)
    assert {q for q, v in told(third).items() if v[0] == "recomputed"} == {("a", 0), ("a", 2), ("b", 1)} and abs(level("a/0.csv") - base + 6.02 - 6) < 0.3 and abs(level("b/sub/1.csv") - base + 3) < 0.3
    (tmp_path / "a" / "reference.wav").write_bytes(encode(0.5 * SWEEP[:, None].astype(np.float32), RATE))
    fourth = told(run(third))
    assert {q for q, v in fourth.items() if v[0] == "recomputed"} == {("a", i) for i in (0, 1, 2, 4)}
    twice = channels.unionByName(channels.where("session = 'a' and ordinal = 0"))
    odd = told(reprocessing.reprocess(spark, str(tmp_path), twice, third))
    assert odd["a", 0][0] == odd["a", 1][0] == "failed" and "output" in odd["a", 1][1] and odd["b", 0][0] == "unchanged"
    assert reprocessing.reprocess(spark, str(tmp_path), channels.limit(0), third).count() == 0
