"""Cases that the given tables do not hold: nulls, silence, ties, empty tables, files."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonelake.functions import acoustics, identity
from tonelake.functions import levels as lv
from tonelake.operators import catalogue, combine, curves, levels, sequences, spectra
from tonelake.plans import localization, session
from tonelake.sources import bundles, documents, recordings
from tonelake.streaming import live


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_silence_and_non_finite_levels_are_null(spark):
    nan = F.lit(float("nan"))
    r = one(
        spark, silent=levels.array_power(F.array(F.lit(0.0))), none=levels.array_power(F.array().cast("array<double>")), bad=levels.array_power(F.array(F.lit(1.0), nan)),
        db=lv.amplitude_db(F.lit(0.0)), fin=lv.finite(nan), inf=lv.finite(F.lit(float("inf"))), zone=lv.level_zone(F.lit(None).cast("double")), snr=levels.subtracted_snr(F.lit(1.0), F.lit(1.0)),
    )
    assert (r.silent, r.none, r.bad, r.db, r.fin, r.inf, r.zone, r.snr) == (0.0, None, None, None, None, None, "silent", None)


def test_slices_are_never_cut_short(spark):
    x = F.array(*[F.lit(float(i)) for i in range(4)])
    r = one(spark, ok=levels.part(x, F.lit(1), F.lit(3)), past=levels.part(x, F.lit(2), F.lit(5)), empty=levels.part(x, F.lit(4), F.lit(4)))
    assert (r.ok, r.past, r.empty) == ([1.0, 2.0], None, [])


def test_phase_wraps_into_half_open_turn(spark):
    r = one(spark, **{f"a{i}": lv.wrap_degrees(F.lit(float(d))) for i, d in enumerate((180, -180, 181, 540, 0, -359))})
    assert list(r) == [180.0, 180.0, -179.0, 180.0, 0.0, 1.0]


def test_arrival_sigma(spark):
    s = lambda c, lo, hi: acoustics.arrival_sigma(F.lit(c), F.lit(lo), F.lit(hi), F.lit(48000.0))
    r = one(spark, a=s(10.0, 2000.0, 8000.0), floor=s(float("inf"), 2000.0, 8000.0), none=s(10.0, 8000.0, 8000.0), nan=s(float("nan"), 1.0, 2.0))
    assert r.a == pytest.approx(48000 / (2 * math.pi * 6000 / math.sqrt(12) * math.sqrt(20)))
    assert (r.floor, r.none, r.nan) == (0.1, math.inf, math.inf)


def test_take_id_tells_labels_apart(spark):
    r = one(spark, a=identity.take_id(F.lit("ab"), F.lit("c"), F.lit(1)), b=identity.take_id(F.lit("a"), F.lit("bc"), F.lit(1)), c=identity.take_id(F.lit("ä"), F.lit("é"), F.lit(2)))
    assert len({r.a, r.b, r.c}) == 3 and r.c.startswith("take-r002-")


def test_names(spark):
    r = one(spark, a=identity.safe_name(F.lit(" é b/c ")), b=identity.safe_name(F.lit("  ")), c=identity.safe_ascii_name(F.lit("..")), d=identity.safe_ascii_name(F.lit("é.w")), e=identity.channel_list(F.lit("1, 2")), f=identity.channel_list(F.lit("1,1")), g=identity.channel_list(F.lit("64")))
    assert list(r) == ["é_b_c", "recording", None, "_.w", [1, 2], None, None]


def test_gaps_over_block_edges(spark):
    idx = [0, 1, 4095, 4096, 5000, 20000]
    rows = spark.createDataFrame([("a", i) for i in idx] + [("a", 1)], "k string, i long")
    got = sorted((r.start_frame, r.end_frame) for r in sequences.missing_intervals(rows, ["k"], "i").collect())
    assert got == [(2, 4095), (4097, 5000), (5001, 20000)]
    c = sequences.continuity(rows, ["k"], "i", most=2).first()
    assert (c.observed, c.missing, len(c.intervals), c.omitted) == (6, 4093 + 903 + 14999, 2, 1)


def test_running_peak_crosses_blocks(spark):
    rows = spark.createDataFrame([("a", i, 1.0 if i == 3 else 0.1) for i in range(0, 9000, 3)], "k string, i long, x double")
    got = {r.i: (r.peak_hold, r.clip_count) for r in sequences.running_peaks(rows, ["k"], "i", "x").collect()}
    assert got[0] == (0.1, 0) and got[8997] == (1.0, 1)


def test_empty_tables_give_empty_results(spark):
    rows = spark.createDataFrame([], "k string, i long, x double")
    for found in (
        sequences.running_peaks(rows, ["k"], "i", "x"), sequences.continuity(rows, ["k"], "i"), levels.clip_statistics(rows, ["k"], "i", "x"), sequences.detrended(rows, ["k"], "i", "x"), sequences.tumbling_frames(rows, ["k"], "i", "x", 4),
    ):
        assert found.count() == 0


def test_medians_and_modes(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0), (2, float("nan"))], "k int, x double")
    got = {r.k: (r.m, r.u) for r in rows.groupBy("k").agg(combine.median("x").alias("m"), combine.upper_median(F.col("x")).alias("u")).collect()}
    assert got[1] == (3.0, 4.0) and got[2][1] is None


def test_combined_cells(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.1, 9.0, "x", None), ("a", 3.0, 0.3, 7.0, "y", None), ("b", 5.0, 0.2, 1.0, "x", None), ("c", None, None, None, None, "late"), ("c", None, None, None, None, "late"), ("c", None, None, None, None, "early")], "k string, d double, s double, c double, band string, reason string")
    got = {r.k: r for r in combine.combined(rows, ["k"], ["d"], "s", "d", "c", ["band"], F.col("d").isNotNull()).collect()}
    assert got["a"].d == 2.0 and got["a"].s == pytest.approx(math.hypot(0.2, 1.0)) and (got["a"].c, got["a"].band) == (7.0, "x")
    assert (got["b"].d, got["b"].s, got["b"].reason) == (5.0, 0.2, None)
    assert (got["c"].d, got["c"].reason) == (None, "late")


def test_upsert_treats_null_as_a_key(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "s string, d string, v int")
    new = spark.createDataFrame([("a", None, 9)], "s string, d string, v int")
    assert sorted((r.s, r.v) for r in catalogue.upserted(old, new, ["s", "d"]).collect()) == [("a", 9), ("b", 2)]


def test_interpolation_holds_its_ends(spark):
    points = spark.createDataFrame([("k", 0.0, 5.0), ("k", 10.0, 1.0), ("k", 1000.0, 3.0)], "k string, hz double, db double")
    targets = spark.createDataFrame([("k", f) for f in (5.0, 10.0, 100.0, 5000.0)] + [("none", 1.0)], "k string, hz double")
    got = {(r.k, r.hz): r.db for r in curves.interpolated(points, targets, ["k"], "hz", "db").collect()}
    assert got == {("k", 5.0): 1.0, ("k", 10.0): 1.0, ("k", 100.0): pytest.approx(2.0), ("k", 5000.0): 3.0, ("none", 1.0): 0.0}


def test_spectra_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=64), rng.normal(size=64)
    df = spark.createDataFrame([(1, x.tolist(), y.tolist())], "k int, x array<double>, y array<double>")
    w = np.abs(np.fft.rfft(x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)))) ** 2
    w[1:-1] *= 2
    assert spectra.high_fraction(df, "k", "x", 8000.0, 48000.0, 64).first().hf_fraction == pytest.approx(w[11:].sum() / w.sum())
    taps = spectra.bandpass_taps(48000.0, 2000.0, 8000.0, 9)
    got = df.select(spectra.filtered(F.col("x"), taps).alias("y")).first().y
    assert np.allclose(got, np.convolve(x, taps, "same"))
    shifted = spark.createDataFrame([(1, x[:40].tolist(), np.concatenate([np.zeros(3), x[:37]]).tolist())], "k int, x array<double>, y array<double>")
    assert spectra.correlation_lag(shifted, "k", "x", "y", 8).first().lag == 3


def test_plan_rules_come_in_order(spark):
    plan = '{"version": 1, "sample_rate_hz": 8000, "output_device": "", "extra": 1, "sweep": {"start_hz": 1, "odd": 2}}'
    df = documents.strict_json(spark.createDataFrame([(plan,), ("nonsense",)], "t string"), "t", session.plan_schema(), "p")
    first, second = df.select("unknown_keys", session.issue(F.col("p")).alias("issue"), session.first_issue(F.col("p"), F.col("unknown_keys")).alias("refused")).collect()
    assert sorted(first.unknown_keys) == [".extra", ".sweep.odd"] and first.issue == "sample_rate" and first.refused == "unknown_key"
    assert second.issue == second.refused == "version" and second.unknown_keys == []


def test_keys_of_every_element_are_looked_at(spark):
    texts = {
        '{"microphones":[{"id":"a"},{"id":"b","evil":1}],"sources":[{},{"position_m":[0,{"no":1}]},{"x":{"y":1},"z":null}]}': [".microphones[1].evil", ".sources[2].x", ".sources[2].z"],
        '{"microphones":{"evil":1},"sources":[[{"evil":1}],7,null],"ctc":{"head_position":{"id":"h","roll":0}}}': [".ctc.head_position.roll"],
        '{"version":1,"version":1}': [], "[1]": [], "null": [], "": [], "{": [], '{"microphones":[]}': [], '{"a b.c":1}': [".a b.c"],
    }
    df = documents.strict_json(spark.createDataFrame([(t, "x") for t in texts], "t string, parsed string"), "t", session.plan_schema(), "p")
    assert df.columns == ["t", "parsed", "p", "unknown_keys"]
    got = {r.t: (sorted(r.unknown_keys), r.p is None) for r in df.collect()}
    assert {t: k for t, (k, _) in got.items()} == texts
    assert got['{"version":1,"version":1}'][1] and got["{"][1] and not got['{"microphones":[]}'][1]
    gaps = '{"version":1,"error":"e","inputs":[{"device_id":"d","routes":[{"input_index":0},{"hardware_channel":1,"more":2}],"continuity":{"intervals":[{},{"begin":1}]}}]}'
    lost = documents.strict_json(spark.createDataFrame([(gaps,)], "t string"), "t", documents.loss_report_schema()).first()
    assert sorted(lost.unknown_keys) == [".inputs[0].continuity.intervals[1].begin", ".inputs[0].routes[1].more"]


def test_positions_of_flat_arrays_are_refused(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, float(i % 2), float(i // 2), 0.0) for i in range(4)], "session int, source_id int, distance_m double, mic_x double, mic_y double, mic_z double")
    r = localization.linear_positions(rows, ["session"]).first()
    assert (r.x, r.y, r.z, r.links) == (None, None, None, 4)


def test_recordings_over_the_limit_are_errors(spark, tmp_path):
    x = np.zeros((5000, 2), np.float32)
    (tmp_path / "a.wav").write_bytes(recordings.encode(x[:100], 48000))
    (tmp_path / "b.wav").write_bytes(recordings.encode(x, 48000))
    rows = recordings.recordings(spark, str(tmp_path), largest=2000).collect()
    assert {(r.path[-5:], r.error) for r in rows} == {("a.wav", None), ("b.wav", "larger than 2000 bytes")} and len(rows) == 3
    with open(tmp_path / "c.wav", "wb") as f:  # three channels of the most frames were over the limit
        f.truncate(recordings.MOST_FRAMES * 3 * 4)
    assert "c.wav" in {r.path[-5:] for r in recordings.recordings(spark, str(tmp_path), largest=128 << 20).collect()}
    assert recordings.LARGEST >= recordings.MOST_FRAMES * recordings.MOST_CHANNELS * 4 and recordings.LARGEST < 1 << 31


def test_recordings_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).uniform(-1, 1, (5000, 2)).astype(np.float32)
    (tmp_path / "a.wav").write_bytes(recordings.encode(x, 48000))
    (tmp_path / "b.wav").write_bytes(b"RIFFxxxxWAVE")
    rows = recordings.recordings(spark, str(tmp_path)).collect()
    bad = [r for r in rows if r.error]
    assert len(bad) == 1 and bad[0].path.endswith("b.wav")
    good = sorted((r for r in rows if not r.error and r.channel == 1), key=lambda r: r.block)
    assert [len(r.samples) for r in good] == [2048, 2048, 904] and good[0].frames == 5000
    assert np.array_equal(np.concatenate([r.samples for r in good]).astype(np.float32), x[:, 1])
    hashes = recordings.file_hashes(spark, str(tmp_path), "*.wav")
    declared = hashes.where("name = 'a.wav'").select("name", "sha256").union(spark.createDataFrame([("c.wav", "0")], "name string, sha256 string"))
    assert sorted((r.name, r.issue) for r in documents.verified_files(hashes, declared).collect()) == [("b.wav", "undeclared"), ("c.wav", "missing")]


def test_publication_is_whole_and_first_wins(spark, tmp_path):
    at = str(tmp_path / "bundle")
    bundles.publish(spark, at, lambda p: spark.range(3).write.parquet(p))
    with pytest.raises(FileExistsError):
        bundles.publish(spark, at, lambda p: spark.range(9).write.parquet(p))
    assert spark.read.parquet(at).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["bundle"]


def test_live_state_spans_batches(spark, tmp_path):
    schema = "channel string, idx long, x double"
    for k, idx in enumerate(([0, 1, 2], [5, 6], [10])):
        spark.createDataFrame([("a", i, 0.1 * k) for i in idx], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    samples = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    q = live.gaps(samples).writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.start_frame, r.end_frame) for r in out) == [(3, 5), (7, 10)]


def test_quarantine_keeps_every_row(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, float("nan")), (None, 3, 0.1), ("b", -1, 0.2)], "channel string, idx long, x double")
    good, bad = live.sound(rows)
    assert (good.count(), bad.count()) == (1, 3)


GOLDEN = {"mics": [(0, 0, 1.1), (0.6, 0, 1.1), (0.3, 0.5, 1.4), (0.3, -0.4, 0.9)], "sources": {"left": (-1.2, -2.5, 1.3), "right": (1.5, -2.3, 1.2)}}


def golden_cells(spark, mics, kind, delay_ms, jitter=0.0):
    """Arrivals of a session of 48 kHz, offset 1024 and 3 ppm, 213 samples of latency."""
    rng, rows = np.random.default_rng(1), []
    for name, place in GOLDEN["sources"].items():
        for k, mic in enumerate(mics):
            samples = float(np.linalg.norm(np.subtract(place, mic))) / 343 * 48000 + delay_ms * 48 + rng.normal(0, jitter)
            ratio = 1 + 3e-6
            arrival = (samples + 52800) * ratio + 1024 if kind == "emitter" else 213 + samples * ratio
            rows.append(("s", name, k, 0, float(mic[0]), float(mic[1]), float(mic[2]), True, arrival, None, ratio, 0.1, 213.0 if kind == "loopback" else None, 0.1, True, "card", "card", kind == "emitter", 1024.0, 0.1, delay_ms or None, k))
    return spark.createDataFrame(
        rows,
        "session string, source_id string, microphone_id int, repeat_index int, mic_x double, mic_y double, mic_z double, taken boolean, arrival double, arrival_reason string, clock_ratio double, sigma double, "
        "loopback_arrival double, loopback_sigma double, loopback_stable boolean, device string, loopback_device string, fixed_reference boolean, clock_offset double, clock_bound double, source_delay_ms double, ord int",
    )


@pytest.mark.parametrize(("kind", "delay"), [("loopback", 0.0), ("loopback", 1.5), ("emitter", 1.5), ("relative", 0.0)])
def test_sessions_of_known_places(spark, kind, delay):
    air = localization.Medium(*[F.lit(x) for x in (343.0, 48000.0, 30.0, 0.0, 0.5, 0.0)])
    cells = golden_cells(spark, GOLDEN["mics"], kind, delay)
    found, places = localization.localized(cells, ["session"], "ord", F.lit(52800.0), air, 343 / 48000)
    found = found.collect()
    assert {r.mode for r in found} == {kind}
    for r in found:
        true = np.linalg.norm(np.subtract(GOLDEN["sources"][r.source_id], GOLDEN["mics"][r.microphone_id]))
        if kind == "relative":
            first = np.linalg.norm(np.subtract(GOLDEN["sources"][r.source_id], GOLDEN["mics"][0]))
            assert r.distance_m is None and r.reason == "no_absolute_time_origin" and abs(r.tdoa_samples - (true - first) / 343 * 48000) < 0.2
        else:
            assert abs(r.distance_m - true) < 0.002 and 0 < r.sigma_m < 0.02
    for r in places.collect():
        assert r.verdict == ("insufficient_ranges" if kind == "relative" else "solved")
        if kind != "relative":
            assert np.linalg.norm(np.subtract((r.x, r.y, r.z), GOLDEN["sources"][r.source_id])) < 0.02


def test_places_from_flat_straight_and_noisy_arrays(spark):
    air = localization.Medium(*[F.lit(x) for x in (343.0, 48000.0, 30.0, 0.0, 0.5, 0.0)])

    def solved(mics, jitter=0.0, spoil=0.0):
        cells = golden_cells(spark, mics, "loopback", 0.0, jitter)
        cells = cells.withColumn("arrival", F.when(F.col("microphone_id") == 1, F.col("arrival") + spoil).otherwise(F.col("arrival")))
        return {r.source_id: r for r in localization.localized(cells, ["session"], "ord", F.lit(0.0), air, 343 / 48000)[1].collect()}

    flat = solved([(x, y, 1.1) for x, y, _ in GOLDEN["mics"]])
    for name, r in flat.items():
        x, y, z = GOLDEN["sources"][name]
        assert r.mirror_ambiguous and r.verdict == "solved" and abs(abs(r.z - 1.1) - abs(z - 1.1)) < 0.02 and np.hypot(r.x - x, r.y - y) < 0.02
    assert {r.verdict for r in solved([(0.1 * k, 0, 1) for k in range(5)]).values()} == {"degenerate_geometry"}
    assert {r.verdict for r in solved(GOLDEN["mics"][:3]).values()} == {"mirror_ambiguous"} and {r.verdict for r in solved(GOLDEN["mics"][:2]).values()} == {"insufficient_ranges"}
    wide = [(x, y, z) for x in (0, 1.0) for y in (0, 1.2) for z in (0.4, 1.6)]
    for name, r in solved(wide, jitter=0.3).items():
        assert r.verdict == "solved" and np.linalg.norm(np.subtract((r.x, r.y, r.z), GOLDEN["sources"][name])) < 0.05 and 0 < r.loo_m < 0.1 and 1 < r.gdop < 10
    for name, r in solved(wide, spoil=60.0).items():
        assert (r.verdict, r.excluded) == ("solved", ["1"]) and np.linalg.norm(np.subtract((r.x, r.y, r.z), GOLDEN["sources"][name])) < 1e-3


def test_refusals_come_in_order(spark):
    air = localization.Medium(*[F.lit(x) for x in (343.0, 48000.0, 30.0, 0.0, 0.5, 0.0)])
    rows = [(None, "a", 1.0, 500.0, 213.0), (True, "b", None, None, 213.0), (True, "a", None, None, 213.0), (True, "a", 1.0, None, 213.0), (True, "a", 1.0, 100.0, 213.0), (True, "a", 1.0, 500.0, None)]
    df = spark.createDataFrame(rows, "taken boolean, device string, clock_ratio double, arrival double, loopback_arrival double")
    df = df.withColumns({"loopback_device": F.lit("a"), "arrival_reason": F.lit("snr_low"), "sigma": F.lit(0.1), "loopback_sigma": F.lit(0.1), "source_delay_ms": F.lit(None).cast("double")})
    assert [r.reason for r in localization.loopback_ranges(df, air).collect()] == ["take_missing", "loopback_unavailable", "clock_uncorrected", "snr_low", "range_implausible", "loopback_unavailable"]


def test_cut_torn_and_odd_recordings_are_errors(spark, tmp_path):
    whole = recordings.encode(np.zeros((1000, 1), np.float32), 48000)
    head = bytearray(whole[:44])
    odd = {
        "short": whole[:84], "torn": whole[:40] + struct.pack("<I", 3998) + whole[44:4042], "bits0": bytes(head[:34] + struct.pack("<H", 0) + head[36:]) + whole[44:],
        "bits4": bytes(head[:34] + struct.pack("<H", 4) + head[36:]) + whole[44:], "good": whole,
    }
    for name, data in odd.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    rows = recordings.recordings(spark, str(tmp_path)).select("path", "frames", "error").distinct().collect()
    assert {r.path.rsplit("/", 1)[1][:-4]: r.error is None for r in rows} == {"short": False, "torn": False, "bits0": False, "bits4": False, "good": True}
    for expected in ({"rate": 44100}, {"channels": 2}, {"frames": 999}):
        assert recordings.recordings(spark, str(tmp_path), glob="good.wav", **expected).first().error
    assert recordings.recordings(spark, str(tmp_path), glob="good.wav", rate=48000, channels=1, frames=1000).first().frames == 1000


def test_runs_of_a_stream_meet_in_any_order(spark):
    rng = np.random.default_rng(5)

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    for _ in range(60):
        state, seen, got, last = State(), [], [], None
        for _ in range(3):
            idx = rng.choice(40, int(rng.integers(1, 30))) + (len(seen) and max(seen) - 10)
            parts = [pd.DataFrame({"idx": p}) for p in np.array_split(idx, 3)]
            fresh = sorted({int(i) for i in idx if last is None or i > last})
            line = ([last] if last is not None else []) + fresh
            want = [(a + 1, b) for a, b in zip(line, line[1:], strict=False) if b > a + 1]
            out = pd.concat(list(live._gaps(("c",), iter(parts), state)))
            assert list(zip(out["start_frame"], out["end_frame"], strict=True)) == want
            last = max([*fresh, *([last] if last is not None else [])])
            seen += list(idx)
            assert state.get[0] == last


def test_late_samples_are_counted(spark, tmp_path):
    schema = "channel string, idx long, x double"
    for idx in ([0, 1, 2, 3, 4], [1, 2, 5, 6, 7, 8], [3, 9]):
        spark.createDataFrame([("a", i, 0.1 * i) for i in idx], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    samples = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    q = live.frames(samples, 4).writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.frame, r.samples, r.late) for r in out] == [(0, 4, 0), (1, 4, 2)]


def test_microphones_are_judged_one_after_another(spark):
    mic = '{"id": "%s", "device": "d", "input_channel": %d, "calibration_file": "%s", "gain_db": 0}'
    plan = '{"version": 1, "sample_rate_hz": 48000, "output_device": "o", "geometry": "spread", "microphones": [%s, %s]}'
    texts = [plan % (mic % ("a", 0, ""), mic % ("a", 1, "c")), plan % (mic % ("a", 0, "c"), mic % ("a", 0, "c")), plan % (mic % ("a", 0, "c"), mic % ("b", 0, ""))]
    df = documents.strict_json(spark.createDataFrame([(t,) for t in texts], "t string"), "t", session.plan_schema(), "p")
    assert [r.i for r in df.select(session.issue(F.col("p")).alias("i")).collect()] == ["microphone_calibration", "microphone_id", "microphone_route"]


def test_frames_come_once_they_are_past(spark, tmp_path):
    schema = "channel string, idx long, x double"
    for idx in ([0, 1, 2, 3, 4], [5, 6, 7, 8, 10], [11, 12, 13]):
        spark.createDataFrame([("a", i, -0.1 * i) for i in idx], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    samples = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    q = live.frames(samples, 4).writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.frame, r.samples, round(r.peak, 6)) for r in out] == [(0, 4, 0.3), (1, 4, 0.7)]  # the third lacks a sample, the fourth is open
