"""Folders of raw acquisitions to processed bundles, a folder and a bundle for each session, all in one job.

A session stands alone: what is wrong with its journal, its files or one of its
recordings refuses that session and no other. Recordings are read, worked on and
written by the tasks they fall to, and only facts about them travel. Files are
staged beside the output and a bundle gets its name when it is whole; the hash
of all its inputs is in it, so that another run leaves it alone.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tonelake.functions.acoustics import ARRIVAL_BAND, distance, longest_range, sound_speed
from tonelake.functions.identity import portable_name
from tonelake.operators import arrivals
from tonelake.plans import localization, positions, session
from tonelake.sources.bundles import _file_system
from tonelake.sources.documents import curve_rows, strict_json
from tonelake.sources.recordings import LARGEST, decode, encode
from tonelake.sources.sinks import FileRows, put
from tonelake.sources.staging import checkpointed

# Names of a session's files, and the largest journal and calibration.
JOURNAL, CHIRP, STIMULUS, RESULT = "capture-raw.json", "timing-chirp.wav", "stimulus.wav", "capture-clock.json"
JOURNAL_BYTES, CALIBRATION_BYTES = 2_097_152, 1 << 20
COHERENT_US = 50.0

SCHEMA = (
    f"version int, status string, plan struct<{session.PLAN}>, "
    "stimulus struct<chirp_frame: bigint, chirp_frames: bigint, sweep_frame: bigint, sweep_frames: bigint, end_chirp_frame: bigint, frames: bigint>, "
    "takes array<struct<take_id: string, source_id: string, microphone_id: string, repeat_index: int, device_id: string, output_device_id: string, wav_file: string, samples: bigint>>, "
    "loopback_files array<struct<source_id: string, repeat_index: int, device_id: string, wav_file: string, samples: bigint>>, "
    "calibrations array<struct<microphone_id: string, file: string, sha256: string>>, timing_reference_output_channel int"
)


def journals(spark: SparkSession, root: str) -> DataFrame:
    """(session, journal, issue): the journal of each folder under ``root``, named after the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", JOURNAL).option("recursiveFileLookup", "true").load(root)
    named = files.withColumn("session", F.element_at(F.split("path", "/"), -2))
    read = named.where(F.col("length") <= JOURNAL_BYTES).select("session", F.decode("content", "UTF-8").alias("text"))
    parsed = strict_json(read, "text", StructType.fromDDL(SCHEMA), "journal")
    issue = F.when(F.col("journal").isNull(), "journal_not_json").when(F.size("unknown_keys") > 0, "journal_unknown_key").otherwise(journal_issue(F.col("journal")))
    over = named.where(F.col("length") > JOURNAL_BYTES).select("session", F.lit(None).cast(parsed.schema["journal"].dataType).alias("journal"), F.lit("journal_too_large").alias("issue"))
    return parsed.select("session", "journal", issue.alias("issue")).unionByName(over)


def journal_issue(j: Column) -> Column:
    """What is wrong with a journal by itself, in the order in which it is judged, or null."""
    p, takes, loops, cals = j["plan"], j["takes"], j["loopback_files"], j["calibrations"]
    mics, sources = F.transform(p["microphones"], lambda m: m["id"]), F.transform(p["sources"], lambda s: s["id"])
    repeats = F.coalesce(p["repeat_count"], F.lit(1))
    whole = j["status"] == "raw_complete"
    unique = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    none = lambda x: F.coalesce(F.size(x), F.lit(0))
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    known = F.forall(takes, lambda t: F.array_contains(mics, t["microphone_id"]) & F.array_contains(sources, t["source_id"]) & t["repeat_index"].between(0, repeats - 1))
    named = F.forall(takes, lambda t: (F.trim(t["take_id"]) != "") & (t["device_id"] != "") & (t["output_device_id"] != ""))
    single = unique(F.transform(takes, lambda t: t["take_id"])) & unique(F.transform(takes, lambda t: F.struct(t["source_id"], t["microphone_id"], t["repeat_index"])))
    names = F.transform(F.concat(F.transform(takes, lambda t: t["wav_file"]), F.coalesce(F.transform(loops, lambda t: t["wav_file"]), F.array().cast("array<string>")), F.coalesce(F.transform(cals, lambda c: c["file"]), F.array().cast("array<string>"))), lambda n: F.lower(n))
    own = F.array(*[F.lit(n) for n in (JOURNAL, CHIRP, STIMULUS, RESULT)])
    free = unique(names) & ~F.arrays_overlap(names, own) & F.forall(names, portable_name) & ~F.exists(names, lambda n: n.rlike(r"^take-[0-9]{3,}(-magnitude\.csv|\.wav)$"))
    passes = F.forall(loops, lambda t: F.array_contains(sources, t["source_id"]) & t["repeat_index"].between(0, repeats - 1)) & unique(F.transform(loops, lambda t: F.struct(t["source_id"], t["repeat_index"])))
    calibrated = F.forall(cals, lambda c: F.array_contains(mics, c["microphone_id"])) & unique(F.transform(cals, lambda c: c["microphone_id"])) & (none(cals) == F.size(mics))
    rules = [
        (bad(j["version"] == 1), "journal_version"), (bad(j["status"] != "capturing"), "journal_status"), (bad(none(takes) > 0), "no_takes"),
        (F.coalesce(session.issue(p).isNotNull(), F.lit(False)), "plan"), (bad(j["stimulus"] == session.stimulus_layout(p["sample_rate_hz"].cast("bigint"), p["sweep"])), "stimulus_layout"),
        (bad(known), "unknown_take"), (bad(named), "unidentified_take"), (bad(single), "duplicate_take"), (bad(free), "file_names"),
        (whole & bad(none(takes) == F.size(mics) * F.size(sources) * repeats), "missing_takes"), (whole & p["loopback"].isNotNull() & bad(none(loops) == F.size(sources) * repeats), "missing_loopbacks"),
        (bad(calibrated), "calibrations"), ((none(loops) > 0) & bad(passes), "loopback_passes"),
    ]
    return F.coalesce(*[F.when(broken, F.lit(token)) for broken, token in rules])


def input_files(spark: SparkSession, root: str) -> DataFrame:
    """(session, name, path, bytes, sha256) of all files of all folders; files too large to be read have no hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    columns = [F.element_at(parts, -2).alias("session"), F.element_at(parts, -1).alias("name"), "path", F.col("length").alias("bytes")]
    return files.where(F.col("length") <= LARGEST).select(*columns, F.sha2("content", 256).alias("sha256")).unionByName(
        files.where(F.col("length") > LARGEST).select(*columns, F.lit(None).cast("string").alias("sha256"))
    )


def referenced(found: DataFrame) -> DataFrame:
    """(session, name, sha256, most): the files that sound journals name, with the hash that is wanted and the most bytes there may be."""
    j = F.col("journal")
    entry = lambda name, sha, most: F.struct(name.alias("name"), sha.alias("wanted"), F.lit(most).alias("most"))
    none = F.lit(None).cast("string")
    parts = [
        F.transform(j["takes"], lambda t: entry(t["wav_file"], none, LARGEST)), F.transform(j["loopback_files"], lambda t: entry(t["wav_file"], none, LARGEST)),
        F.transform(j["calibrations"], lambda c: entry(c["file"], c["sha256"], CALIBRATION_BYTES)), F.array(*[entry(F.lit(n), none, LARGEST) for n in (CHIRP, STIMULUS)]),
    ]
    every = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<name:string,wanted:string,most:int>>")) for p in parts]))
    return found.where("issue is null").select("session", F.inline(every))


# ------------------------------------------------------------------ recordings, in tasks


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _bytes(path: str) -> bytes:
    store, at = _store(path)
    with store.open_input_stream(at) as f:
        return f.read()


@lru_cache(maxsize=2)
def _signal(path: str, rate: int) -> np.ndarray:
    """A signal of a session, kept while its takes are worked on."""
    return decode(_bytes(path), rate, 1)[1][:, 0].astype(np.float64)


def _put(folder: str, name: str, content: bytes) -> None:
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    put(store, posixpath.join(at, name), content)


_FACTS = (
    "session string, role string, idx int, take_id string, source_id string, microphone_id string, repeat_index int, device_id string, error string, "
    "clock_offset double, skew_ppm double, marker_bound_us double, bound_us double, start_db double, end_db double, basis string, clock_reason string, "
    "arrival double, arrival_db double, arrival_sigma double, arrival_reason string, corrected boolean, magnitude_file string, grid_sha256 string"
)
_FIELDS = [f.split()[0] for f in _FACTS.split(", ")]


def _worked(row: dict, staging: str) -> dict:
    """One recording: read, its clock and arrival found, put on the stimulus' clock, its level curve made, all written."""
    fact = dict.fromkeys(_FIELDS) | {k: row[k] for k in ("session", "role", "idx", "take_id", "source_id", "microphone_id", "repeat_index", "device_id")} | {"basis": "uncorrected", "corrected": False}
    layout, rate, folder = arrivals.Layout(*row["layout"]), row["rate"], f"{staging}/{row['session']}"
    try:
        raw = _bytes(row["path"])
        x = decode(raw, rate, 1, row["samples"])[1][:, 0].astype(np.float64)
        chirp, whole = _signal(row["chirp"], rate), _signal(row["stimulus"], rate)
    except (ValueError, OSError) as e:
        return fact | {"error": f"{row['name']}: {e}"}
    if len(chirp) != layout.chirp_frames or len(whole) != layout.frames:
        return fact | {"error": "signals that are not as long as the layout says"}
    sweep = whole[layout.sweep : layout.sweep + layout.sweep_frames]
    _put(folder, row["name"], raw)
    clock = arrivals.clock_of(x, chirp, layout, rate, ARRIVAL_BAND)
    fact |= {"start_db": clock.start_db, "end_db": clock.end_db, "clock_reason": clock.reason, "arrival_reason": "clock_uncorrected"}
    y = None
    if clock.reason is None:
        ratio = 1 + clock.ppm / 1e6
        found = arrivals.sweep_arrival(sweep, x, clock.offset + layout.sweep * ratio, rate, row["lo"], row["hi"])
        fact |= {"skew_ppm": clock.ppm, "marker_bound_us": clock.bound_us, "basis": "arrival_aligned", "arrival": found.at, "arrival_db": found.db, "arrival_sigma": found.sigma, "arrival_reason": found.reason}
        offset = clock.offset
        if row["emitter_m"] is not None:  # what the sound took from the emitter is no part of the clock
            offset -= row["emitter_m"] / row["emitter_speed"] * rate * ratio
            fact |= {"basis": "fixed_acoustic_reference", "bound_us": clock.bound_us + row["emitter_bound_us"]}
        fact["clock_offset"] = offset
        y = arrivals.on_stimulus_clock(x, clock._replace(offset=offset), layout.frames)
    if row["role"] == "loopback":
        return fact
    fact["corrected"] = y is not None
    _put(folder, f"take-{row['idx']:03d}.wav", encode((x if y is None else y)[:, None].astype(np.float32), rate))
    points = row["curve"] or []
    if y is not None and points:
        hz, db = arrivals.level_curve(y[layout.sweep : layout.end_chirp].astype(np.float64), sweep, rate, row["lo"], min(row["hi"], rate / 2))
        f, g = np.array(sorted((p["frequency_hz"], p["spl_db"]) for p in points)).T
        db = db - np.interp(np.log(hz), np.log(f), g)
        lines = "frequency_hz,spl_db\n" + "".join(f"{a:.6f},{b:.3f}\n" for a, b in zip(hz, db, strict=True))
        name = f"take-{row['idx']:03d}-magnitude.csv"
        _put(folder, name, lines.encode())
        fact |= {"magnitude_file": name, "grid_sha256": f"{len(hz)}:{hz[0]:.6f}:{hz[-1]:.6f}"}
    return fact


def worked(rows: DataFrame, staging: str) -> DataFrame:
    """Facts about each recording of ``rows``, whose files are in the staging folder after it; a task holds one recording at a time."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fact = _worked({**row, "layout": list(row["layout"].values())}, staging)
                yield pa.RecordBatch.from_pylist([{k: float(v) if isinstance(v, np.floating) else v for k, v in fact.items()}], _fact_types())

    # a row is little and its recording much, so rows are dealt out by number, a session's next to each other
    return rows.repartitionByRange(spread, "session", "role", "idx").mapInArrow(work, _FACTS)


def _fact_types() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _FACTS.split(", ")])


def take_rows(found: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each recording of sound sessions, with all that working on it takes."""
    j = F.col("journal")
    p = j["plan"]
    none = lambda kind: F.lit(None).cast(kind)
    take = F.transform(j["takes"], lambda t, i: F.struct(F.lit("take").alias("role"), i.alias("idx"), t["take_id"].alias("take_id"), t["source_id"].alias("source_id"), t["microphone_id"].alias("microphone_id"), t["repeat_index"].alias("repeat_index"), t["device_id"].alias("device_id"), t["wav_file"].alias("name"), t["samples"].alias("samples")))
    loop = F.transform(j["loopback_files"], lambda t, i: F.struct(F.lit("loopback").alias("role"), i.alias("idx"), none("string").alias("take_id"), t["source_id"].alias("source_id"), none("string").alias("microphone_id"), t["repeat_index"].alias("repeat_index"), t["device_id"].alias("device_id"), t["wav_file"].alias("name"), t["samples"].alias("samples")))
    rows = found.where("issue is null").select("session", "journal", F.inline(F.concat(take, F.coalesce(loop, F.array().cast("array<struct<role:string,idx:int,take_id:string,source_id:string,microphone_id:string,repeat_index:int,device_id:string,name:string,samples:bigint>>")))))
    own = F.get(F.filter(p["microphones"], lambda m: m["id"] == F.col("microphone_id")), F.lit(0))
    emitter = p["timing_reference"]
    fixed = (j["timing_reference_output_channel"] == emitter["output_channel"]) & own["position_m"].isNotNull()
    metres = distance([F.get(own["position_m"], F.lit(k)) for k in range(3)], [F.get(emitter["position_m"], F.lit(k)) for k in range(3)])
    slow, speed = emitter["sound_speed_m_s"] - emitter["sound_speed_uncertainty_m_s"], emitter["sound_speed_m_s"]
    geometry = ((own["position_uncertainty_mm"] + emitter["position_uncertainty_mm"]) / 1000 / slow + metres * emitter["sound_speed_uncertainty_m_s"] / (speed * slow)) * 1e6
    files = files.select("session", "name", "path")
    named = lambda name, to: files.where(F.col("name") == name).select("session", F.col("path").alias(to))
    out = rows.select(
        "session", "role", "idx", "take_id", "source_id", "microphone_id", "repeat_index", "device_id", "name", "samples", j["stimulus"].alias("layout"), p["sample_rate_hz"].alias("rate"),
        p["sweep"]["start_hz"].alias("lo"), p["sweep"]["end_hz"].alias("hi"), F.when(fixed, metres).alias("emitter_m"), F.when(fixed, speed).alias("emitter_speed"), F.when(fixed, geometry).alias("emitter_bound_us"),
    )
    return out.join(files, ["session", "name"]).join(named(CHIRP, "chirp"), "session").join(named(STIMULUS, "stimulus"), "session")


# ------------------------------------------------------------------ sessions


def session_cells(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Every cell that plans ask for, with what localization needs of its take, its loopback, its microphone and its source."""
    p = F.col("journal.plan")
    at = lambda x, a: F.get(x["position_m"], F.lit("xyz".index(a)))
    place = lambda x, to: [at(x, a).alias(f"{to}_{a}") for a in "xyz"]
    plans = found.select("session", "journal")
    m = plans.select("session", F.posexplode(p["microphones"]).alias("order", "_m")).select("session", "order", F.col("_m.id").alias("microphone_id"), *place(F.col("_m"), "mic"))
    s = plans.select("session", F.explode(p["sources"]).alias("_s")).select("session", F.col("_s.id").alias("source_id"), F.col("_s.source_delay_calibration_ms").alias("source_delay_ms"), *place(F.col("_s"), "src"))
    repeats = plans.select("session", F.explode(F.sequence(F.lit(0), F.coalesce(p["repeat_count"], F.lit(1)) - 1)).alias("repeat_index"))
    takes = facts.where("role = 'take'")
    # takes whose clock is far from the others' of the session are none
    pooled = takes.groupBy("session").agg(F.percentile("skew_ppm", F.lit(0.5)).alias("_pooled"))
    near = F.abs(F.col("skew_ppm") - F.col("_pooled")) <= 5.0
    takes = takes.join(pooled, "session", "left").select(
        "session", "source_id", "microphone_id", "repeat_index", F.col("device_id").alias("device"), F.when(near, 1 + F.col("skew_ppm") / 1e6).alias("clock_ratio"), "arrival", F.coalesce("arrival_sigma", F.lit(float("nan"))).alias("sigma"),
        "arrival_reason", (F.coalesce(F.col("basis") == "fixed_acoustic_reference", F.lit(False)) & F.coalesce(F.col("bound_us") < COHERENT_US, F.lit(False))).alias("fixed_reference"), "clock_offset", "bound_us",
    )
    loops = facts.where("role = 'loopback'").select("session", "source_id", "repeat_index", F.col("arrival").alias("loopback_arrival"), F.col("arrival_sigma").alias("loopback_sigma"), F.col("device_id").alias("loopback_device"))
    cells = localization.full_matrix(s, m, repeats, takes, ["session"]).join(loops, ["session", "source_id", "repeat_index"], "left")
    room, air, ref = p["room_dimensions"], p["sound_speed"], p["timing_reference"]
    speed = sound_speed(ref["sound_speed_m_s"], ref["sound_speed_uncertainty_m_s"], air["m_s"], air["uncertainty_m_s"])
    rest = plans.select(
        "session", p["sample_rate_hz"].cast("double").alias("rate"), speed["m_s"].alias("speed"), speed["sigma"].alias("speed_sigma"), F.col("journal.stimulus.sweep_frame").cast("double").alias("sweep_frame"),
        longest_range(room["length"], room["width"], room["height"]).alias("longest"),
    )
    return cells.join(rest, "session").withColumns({"loopback_stable": F.col("loopback_arrival").isNotNull(), "clock_bound": F.col("bound_us") * F.col("rate") / 1e6})


def _gathered(rows: DataFrame, to: str, *order: str) -> DataFrame:
    """(session, to): a session's rows as one array, by contract of a few thousand at most."""
    rest = [c for c in rows.columns if c != "session"]
    return rows.groupBy("session").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias(to))


def reports(found: DataFrame, facts: DataFrame, sample_m: float) -> DataFrame:
    """(session, report): what was found of each session, as the text of its result."""
    cells = session_cells(found, facts)
    c = F.col
    medium = localization.Medium(c("speed"), c("rate"), c("longest"), F.lit(0.0), c("speed_sigma"), F.lit(0.0))
    ranges = checkpointed(localization.ranges(cells, ["session"], "order", c("sweep_frame"), medium))
    places = positions.session_places(ranges, ["session"], sample_m)
    j, takes = c("journal"), facts.where("role = 'take'").drop("role", "error")
    state = takes.groupBy("session").agg(F.every(c("magnitude_file").isNotNull()).alias("_curves"), F.count_distinct("grid_sha256").alias("_grids"))
    modes = ranges.groupBy("session").agg(F.min("mode").alias("mode"))
    range_rows = ranges.select("session", "source_id", "microphone_id", "repeat_index", "distance_m", "sigma_m", "tdoa_samples", "reason")
    rows = (
        found.join(_gathered(takes, "takes", "idx"), "session").join(_gathered(range_rows, "ranges", "source_id", "microphone_id", "repeat_index"), "session", "left")
        .join(_gathered(places, "positions", "side", "id"), "session", "left").join(state, "session").join(modes, "session", "left")
    )
    chosen = F.when((j["status"] == "raw_complete") & (F.coalesce(j["plan"]["repeat_count"], F.lit(1)) == 1), F.transform(j["takes"], lambda t: t["take_id"]))
    pending = F.filter(
        F.array(F.when(~c("_curves"), "calibrated_analysis"), F.lit("take_quality"), F.lit("reflection_directions"), F.when(c("_grids") > 1, "joint_optimization: response grids differ")), lambda x: x.isNotNull()
    )
    document = F.struct(
        F.lit(1).alias("version"), "session", "input_sha256", j["status"].alias("raw_status"), chosen.alias("selected_take_ids"), F.lit(JOURNAL).alias("parent_inventory_file"), "takes",
        F.struct("mode", "ranges", "positions").alias("localization_report"), pending.alias("pending_processing"),
    )
    return rows.select("session", F.to_json(document, {"pretty": "true"}).alias("report"))


def _published(spark: SparkSession, out: str) -> DataFrame:
    """(session, published_sha256) of the bundles that are there."""
    folder, at, path = _file_system(spark, out)
    if not folder.exists(at) or not folder.globStatus(path(f"{out}/*/{RESULT}")):
        return spark.createDataFrame([], "session string, published_sha256 string")
    rows = spark.read.format("binaryFile").load(f"{out}/*/{RESULT}")
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("session"), F.get_json_object(F.decode("content", "UTF-8"), "$.input_sha256").alias("published_sha256"))


def copied(sessions: DataFrame, files: DataFrame, staging: str) -> DataFrame:
    """(session, input_sha256) of sessions whose other files are in the staging folder as well, copied by the tasks they fall to."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("session").to_pylist()
            for folder, name, path in zip(names, batch.column("name").to_pylist(), batch.column("path").to_pylist(), strict=True):
                _put(f"{staging}/{folder}", name, _bytes(path))
            yield pa.record_batch([pa.array(names, pa.string())], ["session"])

    done = files.select("session", "name", "path").mapInArrow(copy, "session string").groupBy("session").agg(F.count("*").alias("_n"))
    return checkpointed(sessions.select("session", "input_sha256").join(done, "session"))


def _named(rows: DataFrame, staging: str, out: str) -> DataFrame:
    """(session, status): each staged bundle given its name, by the task it falls to; one that is there already stays."""

    def one(name: str, sha: str) -> str:
        store, base = _store(out)
        target, staged = posixpath.join(base, name), posixpath.join(_store(staging)[1], name)
        if store.get_file_info(target).type == fs.FileType.NotFound:
            try:
                store.move(staged, target)
            except OSError:
                pass  # another run was first: what is there now tells
        try:
            with store.open_input_stream(posixpath.join(target, RESULT)) as f:
                return "published" if json.loads(f.read())["input_sha256"] == sha else "published_from_other_input"
        except (OSError, ValueError, KeyError):
            return "not_published"

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, shas = batch.column("session").to_pylist(), batch.column("input_sha256").to_pylist()
            yield pa.record_batch([pa.array(names, pa.string()), pa.array([one(n, s) for n, s in zip(names, shas, strict=True)], pa.string())], ["session", "status"])

    return rows.select("session", "input_sha256").mapInArrow(publish, "session string, status string")


def process_journals(spark: SparkSession, root: str, out: str, sample_m: float = 343.0 / 48000) -> DataFrame:
    """(session, status, issue, input_sha256) of every folder under ``root`` that has a journal, after working on all of them.

    ``published``: its bundle is now in ``out``, whole. ``unchanged``: it was
    there from the same inputs, and nothing was read but to tell that.
    ``refused``, with what is wrong: nothing of it appears. A bundle from other
    inputs is never replaced. Both folders must be reached by all tasks. Jobs
    run as this is called; what an interrupted run has published is skipped by
    the next one, and what it has staged is left under a hidden name.
    """
    files = checkpointed(input_files(spark, root))
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "name", "bytes", "sha256")))
    hashes = files.groupBy("session").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("input_sha256"))
    found = journals(spark, root)
    wanted = referenced(found).join(files, ["session", "name"], "left")
    wrong = F.when(F.col("bytes").isNull(), "missing").when((F.col("bytes") > F.col("most")) | F.col("sha256").isNull(), "too_large").when(F.col("wanted") != F.col("sha256"), "changed")
    broken = wanted.withColumn("wrong", wrong).where("wrong is not null").groupBy("session").agg(F.min(F.concat_ws(" ", "name", "wrong")).alias("file_issue"))
    judged = found.join(hashes, "session").join(broken, "session", "left").join(_published(spark, out), "session", "left")
    status = F.when(F.col("published_sha256") == F.col("input_sha256"), "unchanged").when(F.col("published_sha256").isNotNull(), "refused").when(F.coalesce("issue", "file_issue").isNotNull(), "refused").otherwise("sound")
    reason = F.when(status == "unchanged", None).otherwise(F.coalesce(F.when(F.col("published_sha256").isNotNull(), "published_from_other_input"), "issue", "file_issue"))
    judged = checkpointed(judged.select("session", "journal", "input_sha256", status.alias("status"), reason.alias("issue")))
    sound = judged.where("status = 'sound'")
    done = judged.where("status <> 'sound'").select("session", "status", "issue", "input_sha256")
    if sound.isEmpty():
        return done
    staging = f"{out.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    try:
        facts = checkpointed(worked(_with_curves(spark, root, sound, take_rows(sound, files)), staging))
        torn = facts.where("error is not null").groupBy("session").agg(F.min("error").alias("issue"))
        whole = sound.join(torn.select("session"), "session", "left_anti")
        about = reports(whole, facts, sample_m)
        spark.dataSource.register(FileRows)
        made = about.select(F.concat("session", F.lit(f"/{RESULT}")).alias("name"), F.encode("report", "UTF-8").alias("content"))
        made.write.format("file_rows").mode("append").save(staging)
        kept = referenced(whole).where((F.col("wanted").isNotNull()) | F.col("name").isin(CHIRP, STIMULUS)).select("session", "name").unionByName(whole.select("session", F.lit(JOURNAL).alias("name")))
        result = checkpointed(_named(copied(whole, kept.join(files, ["session", "name"]), staging), staging, out))
    finally:
        folder, _, path = _file_system(spark, out)
        folder.delete(path(staging), True)
    named = result.join(whole.select("session", "input_sha256"), "session")
    good = F.col("status") == "published"
    return done.unionByName(
        named.select("session", F.when(good, "published").otherwise("refused").alias("status"), F.when(~good, F.col("status")).alias("issue"), "input_sha256")
    ).unionByName(sound.drop("issue").join(torn, "session").select("session", F.lit("refused").alias("status"), "issue", "input_sha256"))


def _contents(spark: SparkSession, root: str) -> DataFrame:
    """(session, name, content) of the files of all folders that are small enough for a calibration."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("session"), F.element_at(parts, -1).alias("name"), "length", "content")
    return named.where(F.col("length") <= CALIBRATION_BYTES).drop("length")


def _with_curves(spark: SparkSession, root: str, found: DataFrame, takes: DataFrame) -> DataFrame:
    """``takes`` with the points of their microphones' calibrations."""
    own = found.select("session", F.inline("journal.calibrations")).select("session", "microphone_id", F.col("file").alias("name"))
    texts = _contents(spark, root).join(own, ["session", "name"]).select("session", "microphone_id", F.explode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("line"))
    points = curve_rows(texts, ["session", "microphone_id"], "line").groupBy("session", "microphone_id").agg(F.collect_list(F.struct("frequency_hz", "spl_db")).alias("curve"))
    return takes.join(points, ["session", "microphone_id"], "left")
