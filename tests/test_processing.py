"""Folders of raw acquisitions, made with known places, through the whole job and into bundles."""

from __future__ import annotations

import hashlib
import json
import os
import shutil

import numpy as np

from tonelake.operators.takes import resampled
from tonelake.plans import processing
from tonelake.sources.recordings import decode, encode

RATE = 24000
# Places of a known geometry.
MICS = [(0.0, 0.0, 1.1), (0.6, 0.0, 1.1), (0.3, 0.5, 1.4), (0.3, -0.4, 0.9), (1.0, 1.2, 0.7)]
SOURCES = {"left": (-1.2, -2.5, 1.3), "right": (1.5, -2.3, 1.2)}
LAYOUT = {"chirp_frame": 12000, "chirp_frames": 2400, "sweep_frame": 26400, "sweep_frames": 12000, "end_chirp_frame": 86400, "frames": 100800}


def signals():
    t = np.arange(2400) / RATE
    chirp = np.sin(2 * np.pi * (2000 * t + 6000 / 0.2 * t * t)) * np.hanning(2400)
    s, k = np.arange(12000) / RATE, 0.5 / np.log(9000 / 50)
    sweep = 0.4 * np.sin(2 * np.pi * 50 * k * (np.exp(s / k) - 1)) * np.minimum(1, np.minimum(np.arange(12000), np.arange(12000)[::-1]) / 240)
    x = np.zeros(LAYOUT["frames"])
    x[12000:14400], x[26400:38400], x[86400:88800] = chirp, sweep, chirp
    return chirp, x


CHIRP, STIMULUS = signals()


def heard(delay, ratio=1 + 3e-6):
    j = np.arange(LAYOUT["frames"] + 3000)
    return resampled(np.pad(STIMULUS, 80), np.clip((j - delay) / ratio, -40, LAYOUT["frames"] + 40) + 80)


def write(folder, name, data):
    (folder / name).write_bytes(data)


def wav(x):
    return encode(np.asarray(x, np.float32)[:, None], RATE)


def acquisition(folder, loopback=True, **changes):
    folder.mkdir()
    write(folder, "timing-chirp.wav", wav(CHIRP))
    write(folder, "stimulus.wav", wav(STIMULUS))
    curve = b"# a microphone\n20 0.0\n1000\t1.0\n20000, 2.0\n"
    takes, loops, cals = [], [], []
    for m in range(len(MICS)):
        write(folder, f"cal-{m}.txt", curve)
        cals.append({"microphone_id": f"m{m}", "file": f"cal-{m}.txt", "sha256": hashlib.sha256(curve).hexdigest()})
    for s, (name, place) in enumerate(SOURCES.items()):
        if loopback:
            x = heard(300.0)
            write(folder, f"loop-{s}.wav", wav(x))
            loops.append({"source_id": name, "repeat_index": 0, "device_id": "card", "wav_file": f"loop-{s}.wav", "samples": len(x)})
        for m, at in enumerate(MICS):
            x = 0.5 * heard(300.0 + np.linalg.norm(np.subtract(place, at)) / 343.0 * RATE) + np.random.default_rng(m).normal(0, 1e-4, LAYOUT["frames"] + 3000)
            write(folder, f"raw-{s}-{m}.wav", wav(x))
            takes.append({"take_id": f"t{s}{m}", "source_id": name, "microphone_id": f"m{m}", "repeat_index": 0, "device_id": "card", "output_device_id": "main", "wav_file": f"raw-{s}-{m}.wav", "samples": len(x)})
    plan = {
        "version": 1, "geometry": "spread", "sample_rate_hz": RATE, "output_device": "main", "repeat_count": 1, "sweep": {"duration_secs": 0.5, "start_hz": 50.0, "end_hz": 9000.0, "amplitude": 0.4},
        "microphones": [{"id": f"m{m}", "device": "card", "input_channel": m, "calibration_file": f"cal-{m}.txt", "calibration_orientation": "on_axis", "gain_db": 0.0, "position_m": list(at), "position_uncertainty_mm": 1.0} for m, at in enumerate(MICS)],
        "sources": [{"id": n, "output_channel": k} for k, n in enumerate(SOURCES)],
    }
    if loopback:
        plan["loopback"] = {"device": "card", "input_channel": 60}
    journal = {"version": 1, "status": "raw_complete", "plan": plan, "stimulus": LAYOUT, "takes": takes, "loopback_files": loops, "calibrations": cals} | changes
    write(folder, "capture-raw.json", json.dumps(journal).encode())
    return journal


def told(df):
    return {r.session: (r.status, r.issue) for r in df.collect()}


def snapshot(folder):
    return {p: (os.stat(p).st_mtime_ns, p.read_bytes()) for p in folder.rglob("*") if p.is_file()}


def test_sessions_stand_alone_and_runs_take_up_where_they_ended(spark, tmp_path):
    root, out = tmp_path / "raw", tmp_path / "done"
    root.mkdir()
    acquisition(root / "good")
    acquisition(root / "alone", loopback=False)
    acquisition(root / "torn")
    acquisition(root / "early", status="capturing")
    acquisition(root / "changed")
    acquisition(root / "lost")
    acquisition(root / "odd", more=1)
    write(root / "torn", "raw-1-2.wav", (root / "torn" / "raw-1-2.wav").read_bytes()[:-1001])
    write(root / "changed", "cal-3.txt", b"20 0\n")
    (root / "lost" / "raw-0-0.wav").unlink()
    (root / "none").mkdir()
    write(root / "none", "capture-raw.json", b"{")
    found = told(processing.process_journals(spark, str(root), str(out)))
    assert {k: v[0] for k, v in found.items()} == {"good": "published", "alone": "published"} | dict.fromkeys(["torn", "early", "changed", "lost", "odd", "none"], "refused")
    assert {k: v[1] for k, v in found.items() if k not in ("good", "alone", "torn")} == {
        "early": "journal_status", "changed": "cal-3.txt changed", "lost": "raw-0-0.wav missing", "odd": "journal_unknown_key", "none": "journal_not_json",
    }
    assert found["torn"][1].startswith("raw-1-2.wav: ")
    assert {p.name for p in out.iterdir()} == {"good", "alone"}
    names = {p.name for p in (out / "good").iterdir()}
    assert names == {"capture-raw.json", "capture-clock.json", "timing-chirp.wav", "stimulus.wav", "loop-0.wav", "loop-1.wav", *[f"cal-{m}.txt" for m in range(5)], *[f"raw-{s}-{m}.wav" for s in range(2) for m in range(5)], *[f"take-{k:03d}{e}" for k in range(10) for e in (".wav", "-magnitude.csv")]}
    for name in names - {"capture-clock.json"}:
        if (root / "good" / name).exists():
            assert (root / "good" / name).read_bytes() == (out / "good" / name).read_bytes()
    report = json.loads((out / "good" / "capture-clock.json").read_text())
    assert report["selected_take_ids"] == [f"t{s}{m}" for s in range(2) for m in range(5)] and len(report["takes"]) == 10
    assert all(abs(t["skew_ppm"] - 3) < 1 and t["corrected"] and t["magnitude_file"] for t in report["takes"])
    assert report["localization_report"]["mode"] == "loopback" and "joint_optimization: response grids differ" not in report["pending_processing"]
    for r in report["localization_report"]["ranges"]:
        assert abs(r["distance_m"] - np.linalg.norm(np.subtract(SOURCES[r["source_id"]], MICS[int(r["microphone_id"][1])]))) < 0.002
    places = {p["id"]: p for p in report["localization_report"]["positions"] if p["side"] == "source"}
    for name, at in SOURCES.items():
        assert places[name]["verdict"] == "solved" and np.linalg.norm(np.subtract([places[name][a] for a in "xyz"], at)) < 0.02
    y = decode((out / "good" / "take-003.wav").read_bytes())[1][:, 0]
    assert len(y) == LAYOUT["frames"] and abs(int(np.abs(y[:20000]).argmax()) - 12000 - 1200) < 700
    lines = (out / "good" / "take-000-magnitude.csv").read_text().splitlines()
    hz, db = np.array([[float(v) for v in x.split(",")] for x in lines[1:]]).T
    level = db + np.interp(np.log(hz), np.log([20, 1000, 20000]), [0, 1, 2])
    inside = (hz > 200) & (hz < 7000)
    assert lines[0] == "frequency_hz,spl_db" and np.abs(level[inside] - 20 * np.log10(0.5)).max() < 0.7
    relative = json.loads((out / "alone" / "capture-clock.json").read_text())["localization_report"]
    assert relative["mode"] == "relative" and {r["reason"] for r in relative["ranges"]} == {"no_absolute_time_origin"}

    before = snapshot(out)
    again = told(processing.process_journals(spark, str(root), str(out)))
    assert {k for k, v in again.items() if v == ("unchanged", None)} == {"good", "alone"} and snapshot(out) == before
    # what was mended is published, what has other inputs now is not written over
    acquisition(root / "mended")
    shutil.rmtree(root / "lost")
    write(root / "alone", "cal-0.txt", (root / "alone" / "cal-0.txt").read_bytes() + b"\n")
    third = told(processing.process_journals(spark, str(root), str(out)))
    assert third["mended"] == ("published", None) and third["good"][0] == "unchanged" and third["alone"] == ("refused", "published_from_other_input") and "lost" not in third
    assert {k: v for k, v in snapshot(out).items() if "mended" not in str(k)} == before


def test_a_bundle_that_is_there_first_stays(spark, tmp_path):
    out, staged = tmp_path / "out", tmp_path / "out" / ".staging-x"
    for folder, sha in ((out / "a", "other"), (out / "b", "same"), (staged / "a", "mine"), (staged / "b", "same"), (staged / "c", "mine")):
        folder.mkdir(parents=True)
        write(folder, "capture-clock.json", json.dumps({"input_sha256": sha}).encode())
    rows = spark.createDataFrame([("a", "mine"), ("b", "same"), ("c", "mine"), ("d", "mine")], "session string, input_sha256 string")
    got = {r.session: r.status for r in processing._named(rows, str(staged), str(out)).collect()}
    assert got == {"a": "published_from_other_input", "b": "published", "c": "published", "d": "not_published"}
    assert json.loads((out / "a" / "capture-clock.json").read_text()) == {"input_sha256": "other"}


CASES = [
    (lambda j: j["takes"].append(j["takes"][0] | {"take_id": "x", "wav_file": "x.wav"}), "duplicate_take"),
    (lambda j: j["takes"][0].update(take_id=" "), "unidentified_take"),
    (lambda j: j["takes"][0].update(source_id="nobody"), "unknown_take"),
    (lambda j: j["takes"][0].update(repeat_index=1), "unknown_take"),
    (lambda j: j["takes"].pop(), "missing_takes"),
    (lambda j: j["takes"].clear(), "no_takes"),
    (lambda j: j["loopback_files"].pop(), "missing_loopbacks"),
    (lambda j: j["loopback_files"][0].update(source_id="right"), "loopback_passes"),
    (lambda j: j["takes"][0].update(wav_file="RAW-0-1.WAV"), "file_names"),
    (lambda j: j["takes"][0].update(wav_file="take-000.wav"), "file_names"),
    (lambda j: j["takes"][0].update(wav_file="../raw.wav"), "file_names"),
    (lambda j: j["calibrations"].pop(), "calibrations"),
    (lambda j: j["calibrations"][0].update(microphone_id="m1"), "calibrations"),
    (lambda j: j["stimulus"].update(frames=1), "stimulus_layout"),
    (lambda j: j["plan"].update(output_device=""), "plan"),
    (lambda j: j.update(version=2), "journal_version"),
    (lambda j: j["plan"]["microphones"][4].update(evil=1), "journal_unknown_key"),
]


def test_journals_are_judged(spark, tmp_path):
    sound = json.dumps(acquisition(tmp_path / "base"))
    root = tmp_path / "all"
    for k, (change, _) in enumerate(CASES):
        journal = json.loads(sound)
        change(journal)
        (root / f"s{k}").mkdir(parents=True)
        write(root / f"s{k}", "capture-raw.json", json.dumps(journal).encode())
    got = {r.session: r.issue for r in processing.journals(spark, str(root)).collect()}
    assert got == {f"s{k}": issue for k, (_, issue) in enumerate(CASES)}
