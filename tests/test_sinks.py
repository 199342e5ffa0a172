"""Files that are written are those that are read back."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.sources import recordings, sinks

RATE = 8000


def blocks(spark, signals):
    rows = [(name, c, b, x[i : i + 2048].astype(float).tolist()) for name, channels in signals.items() for c, x in enumerate(channels) for b, i in enumerate(range(0, len(x), 2048))]
    return spark.createDataFrame(rows, "name string, channel int, block int, samples array<float>").repartition(5)


def test_recordings_are_written_and_read_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=5000).astype(np.float32), rng.normal(size=3).astype(np.float32)
    path = str(tmp_path / "takes")
    sinks.save_recordings(blocks(spark, {"a.wav": [a], "b.wav": [b]}), "name", RATE, path)
    assert sorted(p.name for p in Path(path).iterdir() if not p.name.startswith(".")) == ["a.wav", "b.wav"]
    assert np.array_equal(recordings.decode(Path(path, "a.wav").read_bytes())[1][:, 0], a)
    with pytest.raises(FileExistsError):
        sinks.save_recordings(blocks(spark, {"a.wav": [b]}), "name", RATE, path)
    assert np.array_equal(recordings.decode(Path(path, "a.wav").read_bytes())[1][:, 0], a)
    with pytest.raises(ValueError, match="channels 2, not 1"):
        sinks.save_recordings(blocks(spark, {"a.wav": [a, a]}), "name", RATE, str(tmp_path / "stereo"))
    assert sinks.misread(spark, str(tmp_path / "stereo"), channels=2).count() == 0


def test_odd_files_are_refused_before_anything_is_written(spark, tmp_path):
    for rows in ([("../a", b"x")], [("a", b"x"), ("a", b"y")], [("a", None)], [(None, b"x")]):
        with pytest.raises(ValueError, match="odd, repeated"):
            sinks.save_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    for text in (b"one", b"two"):
        sinks.save_files(spark.createDataFrame([("a.json", text)], "name string, content binary"), str(tmp_path / "out"), replace=True)
        assert (tmp_path / "out" / "a.json").read_bytes() == text
    assert [p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".part"] == []
    with pytest.raises(Exception, match="missing or repeated"):
        sinks.take_files(blocks(spark, {"a.wav": [np.zeros(5000)]}).where("block <> 1"), "name", RATE).collect()


def test_responses_are_files(spark):
    rows = spark.createDataFrame([("t1", [(100.0, -3.0, 45.0)], [1.0, 0.5], 50.0, 900.0, 800.0, None), ("t2", None, None, None, None, None, "calibration")], "take string, response array<struct<hz: double, db: double, deg: double>>, impulse array<double>, low_hz double, high_hz double, timing_limit_hz double, issue string")
    found = {r.name: r.content for r in sinks.response_files(rows, F.col("take"), RATE).collect()}
    assert sorted(found) == ["t1-ir.csv", "t1-ir.json", "t1-phase.csv"]
    assert found["t1-phase.csv"] == "frequency_hz,spl_db,phase_deg\n100.0,-3.0,45.0\n" and found["t1-ir.csv"] == "time_ms,amplitude\n0.0,1.0\n0.125,0.5\n"
    assert json.loads(found["t1-ir.json"])["samples"] == [1.0, 0.5]
    with_coherence = rows.withColumn("coherence", F.array(F.struct(F.lit(100.0).alias("hz"), F.lit(0.5).alias("gamma"))))
    assert {r.name: r.content for r in sinks.response_files(with_coherence, F.col("take"), RATE).collect()}["t1-coherence.csv"] == "frequency_hz,coherence\n100.0,0.5\n"


def test_journals_and_sidecars(spark):
    journals = spark.createDataFrame([("s1", 3), ("s2", 4)], "session string, takes int")
    losses = spark.createDataFrame([("s1", "capture-loss-b.json", "bb"), ("s1", "capture-loss-a.json", "aa")], "session string, file string, sha256 string")
    found = {r.name: json.loads(r.content) for r in sinks.journal_files(journals, "session", losses).collect()}
    assert [x["file"] for x in found["s1.json"]["capture_loss"]] == ["capture-loss-a.json", "capture-loss-b.json"] and found["s2.json"] == {"session": "s2", "takes": 4, "capture_loss": []}
    sessions = spark.createDataFrame([("a", "h", "h", 5), ("b", "h", "i", 5), ("c", "h", "h", 5), ("d", "h", "h", 5)], "session string, sha256 string, seen_sha256 string, modified long")
    entries = spark.createDataFrame([("a", "L", 0, 0.5), ("a", "R", 0, 0.25), ("c", "L", 0, 1.0), ("c", "L", 0, 1.0)], "session string, speaker string, idx int, quality double")
    stimuli = spark.createDataFrame([("a", "L", 0, "sweep")], "session string, speaker string, idx int, kind string")
    got = {r.session: r for r in sinks.sidecars(sessions, entries, stimuli, "session", ["speaker", "idx"]).collect()}
    assert [got[k].issue for k in "abcd"] == [None, "changed", "repeated_quality", None]
    document = json.loads(got["a"].content)
    assert [e["speaker"] for e in document["entries"]] == ["L", "R"] and document["stimuli"][0]["kind"] == "sweep" and document["session_sha256"] == "h"
    assert "entries" not in json.loads(got["d"].content) and got["b"].content is None


def test_reports_of_losses_are_found_again(spark, tmp_path):
    from tonelake.sources.documents import loss_report_schema

    gap = {"observed_frames": 10, "missing_frames_per_channel": 2, "omitted_intervals": 0, "intervals": [{"start_frame": 3, "end_frame": 5}]}
    report = {"version": 1, "error": "lost", "inputs": [{"device_id": "d", "routes": [{"input_index": 0, "hardware_channel": 1}], "continuity": gap}]}
    rows = spark.createDataFrame([(json.dumps(report),)] * 2, "t string").select(F.from_json("t", loss_report_schema()).alias("report"))
    sinks.save_files(sinks.loss_files(rows, "report"), str(tmp_path / "out"))
    (written,) = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("capture")]
    (tmp_path / "out" / "capture-loss-zz.json").write_text("no json")
    (tmp_path / "out" / "notes.json").write_text("{}")
    (tmp_path / "out" / "capture-loss-long.json").write_bytes(b" " * (sinks.REPORT_BYTES + 1))
    none = spark.createDataFrame([], "file string")
    got = [(r.file, r.issue) for r in sinks.discovered_losses(spark, str(tmp_path / "out"), none).collect()]
    assert got == sorted([(written, None), ("capture-loss-long.json", "too_large"), ("capture-loss-zz.json", "not_json")])
    known = spark.createDataFrame([(written.upper().replace("CAPTURE-LOSS", "capture-loss"),), ("capture-loss-zz.json",)], "file string")
    again = {r.file: r.issue for r in sinks.discovered_losses(spark, str(tmp_path / "out"), known).collect()}
    assert "capture-loss-zz.json" not in again and again[written] == "case_collision"


def test_ears_events_and_fragments(spark, tmp_path):
    x = [float(i) for i in range(4)]
    pairs = spark.createDataFrame([("h1", "left", 0, x, "L"), ("h1", "right", 0, x[::-1], "L")], "stem string, ear string, block int, samples array<float>, speaker string")
    for part in ("p", "q"):
        sinks.save_files(sinks.ear_files(pairs, RATE, ["speaker"]), str(tmp_path / part))
    rate, y = recordings.decode((tmp_path / "p" / "h1.wav").read_bytes())
    assert rate == RATE and y.tolist() == [list(z) for z in zip(x, x[::-1], strict=True)]
    found = sinks.ear_fragments(spark, [str(tmp_path / "p"), str(tmp_path / "q")], "file string, ears int").collect()
    assert [(r.fragment, r.document.file, r.document.ears, r.issue) for r in sorted(found)] == [(0, "h1.wav", 2, None), (1, "h1.wav", 2, None)]
    with pytest.raises(ValueError, match="128"):
        sinks.ear_fragments(spark, [], "file string")
    events = spark.createDataFrame([("meter", 1.0, None), ("done", None, "ok")], "k string, level double, text string")
    assert sorted(r.value for r in sinks.event_lines(events, "k", "level", "text").collect()) == ['{"event":"done","text":"ok"}', '{"event":"meter","level":1.0}']
    (tmp_path / "in").mkdir()
    events.write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        sinks.spool(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "spooled"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "spooled")).count() == 2


def test_one_writer_claims_a_name(spark, tmp_path):
    from tonelake.sources.bundles import publish

    target, wrote = tmp_path / "out", []

    def second(staged):
        wrote.append(staged)
        with pytest.raises(FileExistsError, match="being written"):
            publish(spark, str(target), lambda _: wrote.append("never"))
        spark.range(3).write.parquet(staged)

    publish(spark, str(target), second)
    assert len(wrote) == 1 and spark.read.parquet(str(target)).count() == 3
    with pytest.raises(FileExistsError):
        publish(spark, str(target), lambda _: wrote.append("never"))
    with pytest.raises(ZeroDivisionError):
        publish(spark, str(tmp_path / "other"), lambda _: 1 / 0)
    assert len(wrote) == 1 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out"]
