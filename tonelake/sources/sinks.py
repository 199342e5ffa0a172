"""Files written by the tasks that have their content: recordings, responses, journals, sidecars, reports, events.

A row (name, content) is a file. Tasks write it under a name of their own and
rename it, so a lost task leaves no half a file and another may do its work
again; a folder of them appears as a whole. Nothing passes through the driver.
"""

from __future__ import annotations

import contextlib
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from tonelake.functions.identity import portable_name
from tonelake.sources.bundles import publish
from tonelake.sources.documents import loss_report_issue, loss_report_schema, strict_json
from tonelake.sources.recordings import encode, recordings

#: Most bytes of one report of lost frames, of all of a session, and of a fragment's description.
REPORT_BYTES = 1 << 20
FRAGMENT_BYTES = 32 << 20


def put(store: fs.FileSystem, target: str, content: bytes) -> None:
    """Writes a file under a name of its own and then gives it its name; a write that fails leaves nothing."""
    staged = posixpath.join(posixpath.dirname(target), f".{uuid.uuid4().hex}.part")
    try:
        with store.open_output_stream(staged) as out:
            out.write(content)
        store.move(staged, target)
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(staged)
        raise


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, folder = fs.FileSystem.from_uri(self.path)
        for row in iterator:
            target = posixpath.join(folder, row.name)
            store.create_dir(posixpath.dirname(target), recursive=True)
            put(store, target, bytes(row.content))
        return WriterCommitMessage()


class FileRows(DataSource):
    """Each row (name, content) as a file of a folder that all tasks reach."""

    @classmethod
    def name(cls) -> str:
        return "file_rows"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options["path"])


def save_files(files: DataFrame, path: str, replace: bool = False) -> None:
    """Writes rows (name, content) into a folder.

    The folder is new and appears as a whole, or with ``replace`` each file
    takes its place at once. A name that is no plain file name, or is there
    twice, and content that is null are refused before anything is written.
    """
    spark = files.sparkSession
    bad = files.groupBy("name").agg(F.count("*").alias("n"), F.count("content").alias("filled")).where((F.col("n") > 1) | (F.col("filled") < 1) | ~F.coalesce(portable_name(F.col("name")), F.lit(False)))
    found = bad.select("name").head()
    if found:
        raise ValueError(f"a file name that is odd, repeated or without content: {found.name}")
    spark.dataSource.register(FileRows)
    rows = files.select("name", F.col("content").cast("binary").alias("content"))
    write = lambda to: rows.write.format("file_rows").mode("append").save(to)
    write(path) if replace else publish(spark, path, write)


def take_files(takes: DataFrame, name: str, rate: int) -> DataFrame:
    """(name, content): the recording of all channels of each name, whose rows are channel, block, samples.

    Channels of unequal length, missing blocks and repeated ones are errors. A task holds one recording.
    """

    def made(group: pd.DataFrame) -> pd.DataFrame:
        parts = group.sort_values(["channel", "block"])
        if parts.duplicated(["channel", "block"]).any() or any(sorted(g) != list(range(len(g))) for _, g in parts.groupby("channel")["block"]):
            raise ValueError(f"{group['name'].iloc[0]}: blocks that are missing or repeated")
        channels = [np.concatenate([np.asarray(x, np.float32) for x in g]) for _, g in parts.groupby("channel")["samples"]]
        if len({len(c) for c in channels}) > 1:
            raise ValueError(f"{group['name'].iloc[0]}: channels of unequal length")
        return pd.DataFrame({"name": [group["name"].iloc[0]], "content": [encode(np.stack(channels, axis=1), rate)]})

    return takes.select(F.col(name).alias("name"), "channel", "block", "samples").groupBy("name").applyInPandas(made, "name string, content binary")


def misread(spark: SparkSession, path: str, rate: int | None = None, channels: int | None = 1, frames: int | None = None) -> DataFrame:
    """(path, error) of recordings that, read back, are not what they were to be."""
    return recordings(spark, path, rate=rate, channels=channels, frames=frames).where("error is not null").select("path", "error")


def save_recordings(takes: DataFrame, name: str, rate: int, path: str, channels: int = 1) -> None:
    """Writes recordings and reads them back; one that is not as wanted is an error."""
    save_files(take_files(takes, name, rate), path)
    wrong = misread(takes.sparkSession, path, rate, channels).head()
    if wrong:
        raise ValueError(f"{wrong.path}: {wrong.error}")


def _lines(head: str, rows: Column, *fields: str) -> Column:
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(",", *[r[f].cast("string") for f in fields])), "\n")
    return F.concat(F.lit(head + "\n"), text, F.when(F.size(rows) > 0, "\n").otherwise(""))


def response_files(phases: DataFrame, stem: Column, rate: int) -> DataFrame:
    """(name, content): for each take its response, its impulse response twice, and its coherence where there is one.

    ``phases`` is what `measured.calibrated_phase` gives, with coherence
    (array of hz, gamma) or null. Refused takes have no files.
    """
    times = F.transform("impulse", lambda x, i: F.struct((i * 1000.0 / rate).alias("ms"), x.alias("x")))
    document = F.to_json(
        F.struct(
            F.lit(rate).alias("sample_rate_hz"), F.lit("shared_stimulus_sweep_start").alias("time_origin"), "low_hz", "high_hz", "timing_limit_hz",
            F.lit(False).alias("microphone_phase_calibrated"), F.lit(True).alias("periodic_band_limited"), F.col("impulse").alias("samples"),
        )
    )
    coherence = F.col("coherence") if "coherence" in phases.columns else F.lit(None).cast("array<struct<hz: double, gamma: double>>")
    each = {
        "-phase.csv": _lines("frequency_hz,spl_db,phase_deg", F.col("response"), "hz", "db", "deg"), "-ir.json": document,
        "-ir.csv": _lines("time_ms,amplitude", times, "ms", "x"), "-coherence.csv": _lines("frequency_hz,coherence", coherence, "hz", "gamma"),
    }
    files = F.array(*[F.struct(F.concat(stem, F.lit(end)).alias("name"), text.alias("content")) for end, text in each.items()])
    return phases.where("issue is null").select(F.inline(files)).where("content is not null")


def journal_files(journals: DataFrame, key: str, reports: DataFrame) -> DataFrame:
    """(name, content): each session's journal with its reports of lost frames, in order of their names.

    ``reports`` is (key, file, sha256), 512 of a session at most by contract.
    """
    own = reports.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("file", "sha256"))).alias("capture_loss"))
    none = F.array().cast("array<struct<file: string, sha256: string>>")
    rows = journals.join(own, key, "left").withColumn("capture_loss", F.coalesce("capture_loss", none))
    document = F.to_json(F.struct(*journals.columns, "capture_loss"), {"pretty": "true"})
    return rows.select(F.concat(F.col(key).cast("string"), F.lit(".json")).alias("name"), document.alias("content"))


def sidecars(sessions: DataFrame, entries: DataFrame, stimuli: DataFrame, key: str, source: list[str]) -> DataFrame:
    """(key, content, issue): evidence stored beside a session's recordings, bound to their hash and time of change.

    ``sessions`` is (key, sha256, seen_sha256, modified). A session that has
    changed since it was seen, or a source with two entries of a kind, has an
    issue and no content. A session without evidence gets an empty sidecar.
    """
    many = lambda rows, to: (
        rows.groupBy(key, *source).agg(F.count("*").alias("_n"), F.min(F.struct(*[c for c in rows.columns if c != key])).alias("_e")).groupBy(key)
        .agg(F.max("_n").alias(f"_{to}"), F.array_sort(F.collect_list("_e")).alias(to))
    )
    rows = sessions.join(many(entries, "entries"), key, "left").join(many(stimuli, "stimuli"), key, "left")
    issue = F.when(~F.col("sha256").eqNullSafe(F.col("seen_sha256")), "changed").when(F.col("_entries") > 1, "repeated_quality").when(F.col("_stimuli") > 1, "repeated_stimulus")
    # without evidence there is no array to write, and the reader takes that for an empty one
    document = F.to_json(F.struct(F.lit(1).alias("version"), F.col("sha256").alias("session_sha256"), F.col("modified").alias("session_modified_ns"), "entries", "stimuli"))
    return rows.select(key, F.when(issue.isNull(), document).alias("content"), issue.alias("issue"))


def loss_files(reports: DataFrame, report: str) -> DataFrame:
    """(name, content): a report of lost frames under a name that its content determines, so that it is never written over."""
    text = F.to_json(F.col(report), {"pretty": "true"})
    return reports.select(F.concat(F.lit("capture-loss-"), F.substring(F.sha2(text, 256), 1, 16), F.lit(".json")).alias("name"), text.alias("content")).distinct()


def discovered_losses(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(file, sha256, issue): reports of a folder that are not known yet, in order of their names.

    ``known`` is (file). Names that differ from a known one in case only, long
    files and reports that do not hold are issues; long files are not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "capture-loss-*").load(path)
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).where(F.lower("file").endswith(".json"))
    old = known.groupBy(F.lower("file").alias("_l")).agg(F.min("file").alias("_k"))
    fresh = named.withColumn("_l", F.lower("file")).join(old, "_l", "left").where("_k is null or _k <> file")
    read = fresh.where(F.col("length") <= REPORT_BYTES).select("file", "_k", "content", F.decode("content", "UTF-8").alias("_text"))
    parsed = strict_json(read, "_text", loss_report_schema(), "_d")
    why = (
        F.when(F.col("_k").isNotNull(), "case_collision").when(F.get_json_object("_text", "$").isNull(), "not_json").when(F.size("unknown_keys") > 0, "unknown_keys").otherwise(loss_report_issue(F.col("_d")))
    )
    good = parsed.select("file", F.sha2("content", 256).alias("sha256"), why.alias("issue"))
    over = fresh.where(F.col("length") > REPORT_BYTES).select("file", F.lit(None).cast("string").alias("sha256"), F.lit("too_large").alias("issue"))
    return good.unionByName(over).orderBy("file")


def session_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, document, issue) of saved sessions, JSON of a schema; checks of their paths are `projections.session_issue`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    text = F.decode("content", "UTF-8")
    rows = files.where(F.col("length") <= FRAGMENT_BYTES).select(name, F.from_json(text, schema).alias("document"), F.when(F.get_json_object(text, "$").isNull(), "not_json").alias("issue"))
    over = files.where(F.col("length") > FRAGMENT_BYTES).select(name, F.lit("too_large").alias("issue"))
    return rows.unionByName(over, allowMissingColumns=True)


def ear_fragments(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    """(fragment, file, document, issue): descriptions of parts of a session in up to 128 folders, a part each."""
    if not 0 < len(folders) <= 128:
        raise ValueError("1 to 128 folders of fragments")
    parts = [session_files(spark, f, schema).withColumn("fragment", F.lit(i)) for i, f in enumerate(folders)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select("fragment", "file", "document", "issue")


def ear_files(pairs: DataFrame, rate: int, settings: list[str]) -> DataFrame:
    """(name, content): each pair of ears as one recording of two channels, left and right, and its description.

    ``pairs`` has stem, ear (left, right), block, samples and the settings.
    """
    channel = F.when(F.col("ear") == "left", 0).when(F.col("ear") == "right", 1)
    sound = take_files(pairs.select(F.concat("stem", F.lit(".wav")).alias("name"), channel.alias("channel"), "block", "samples"), "name", rate)
    about = pairs.groupBy("stem").agg(F.count_distinct("ear").alias("ears"), *[F.min(s).alias(s) for s in settings])
    text = F.to_json(F.struct(F.concat("stem", F.lit(".wav")).alias("file"), F.lit(rate).alias("sample_rate_hz"), "ears", *settings))
    return sound.unionByName(about.select(F.concat("stem", F.lit(".json")).alias("name"), F.encode(text, "UTF-8").alias("content")))


def event_lines(events: DataFrame, kind: str, *payload: str) -> DataFrame:
    """(value): a line of JSON for each event, its kind first; what is null is left out. For batches and streams alike."""
    return events.select(F.to_json(F.struct(F.col(kind).alias("event"), *payload)).alias("value"))


def spool(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of frames to files as it comes, all that is there and then stops; taken up again where it ended."""
    return frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
