"""Saved sessions analysed anew, and only what has changed: a channel's result is kept for as long as its inputs are the same.

The inputs of a channel are the bytes of its recording, of the reference and of
the calibration that applies to it, and what the session says of both. Their
hash stands beside the result, so a run over any number of sessions works on
the channels whose hash is new and passes all others on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.operators.analysis import Unusable, analysed, csv_of
from tonelake.plans.processing import _bytes, _put, _signal
from tonelake.plans.projections import session_issue
from tonelake.sources.documents import curve_rows
from tonelake.sources.recordings import LARGEST, decode
from tonelake.sources.staging import checkpointed

#: Changes when the analysis does, so that results of the one before count as old.
ANALYSIS = "1"


def session_content(spark: SparkSession, root: str) -> DataFrame:
    """(session, name, path, sha256, content) of every file under ``root``; name is its path in the session's folder. Files too large to be read have no hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + "/" + root.split(":", 1)[-1].strip("/") + "/", "")
    named = files.select(F.substring_index(inside, "/", 1).alias("session"), F.regexp_replace(inside, "^[^/]*/", "").alias("name"), "path", "length", "content")
    return named.select("session", "name", "path", F.when(F.col("length") <= LARGEST, F.sha2("content", 256)).alias("sha256"), F.when(F.col("length") <= 1 << 20, F.col("content")).alias("content"))


def planned(channels: DataFrame, files: DataFrame, known: DataFrame, reference: str = "reference.wav") -> DataFrame:
    """``channels`` with what is to be done with each: the state, the files it takes, and the hash of its inputs.

    ``channels`` has session, ordinal, channel_name, wav_path, csv_path,
    success, error, mic_calibration_path (its own), session_calibrations (one a
    channel, by ordinal), session_calibration (of the session), sample_rate_hz,
    lo_hz and hi_hz. A calibration is the channel's own, else the session's for
    it; the session's only one where neither is named, or the one that is named
    is not there. Repeated channels and files that are not there are failures.
    """
    files = files.select("session", "name", "path", "sha256").dropDuplicates(["session", "name"])

    def of(column: Column, to: str) -> tuple[DataFrame, list]:
        return files.select(F.col("session").alias("_s"), F.col("name").alias("_n"), F.col("path").alias(f"{to}_path"), F.col("sha256").alias(f"{to}_sha256")), [F.col("session") == F.col("_s"), column == F.col("_n")]

    named = F.coalesce("mic_calibration_path", F.get("session_calibrations", F.col("ordinal")))
    rows = channels.withColumns({"_own": F.when(named != "", named), "_n_same": F.count("*").over(Window.partitionBy("session", "ordinal"))})
    for column, to in ((F.col("wav_path"), "recording"), (F.col("_own"), "own"), (F.col("session_calibration"), "common"), (F.lit(reference), "reference")):
        right, on = of(column, to)
        rows = rows.join(right, on, "left").drop("_s", "_n")
    rows = rows.withColumns({"calibration_path": F.coalesce("own_path", "common_path"), "calibration_sha256": F.coalesce("own_sha256", "common_sha256")})
    key = F.sha2(F.concat_ws("|", F.lit(ANALYSIS), "recording_sha256", "reference_sha256", F.coalesce("calibration_sha256", F.lit("none")), "sample_rate_hz", "lo_hz", "hi_hz"), 256)
    last = known.where("success").select("session", "ordinal", F.col("input_sha256").alias("_then"), F.col("output_sha256").alias("_made")).dropDuplicates(["session", "ordinal"])
    right, on = of(F.col("csv_path"), "result")
    rows = rows.withColumn("input_sha256", key).join(last, ["session", "ordinal"], "left").join(right, on, "left").drop("_s", "_n")
    same = (F.col("_then") == F.col("input_sha256")) & (F.col("_made") == F.col("result_sha256"))
    issues = session_issue(channels, ["session"]).select("session", F.col("issue").alias("_issue"))
    state = (
        F.when(~F.coalesce("success", F.lit(False)), "passed_on").when(F.col("_issue").isNotNull(), F.concat(F.lit("session refused: "), "_issue")).when(F.col("_n_same") > 1, "channel is there twice")
        .when(F.col("wav_path").isNull() | F.col("recording_sha256").isNull(), F.concat(F.lit("WAV file not found: "), F.coalesce("wav_path", F.lit("")))).when(F.col("reference_sha256").isNull(), "reference not found").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("due")
    )
    return rows.join(issues, "session", "left").withColumn("state", state)


def _analysed(rows: DataFrame) -> DataFrame:
    """(session, ordinal, failure, output_sha256) of channels, whose curves are written over the old ones when they are whole."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def one(r: dict) -> tuple[str | None, str | None]:
        try:
            x = decode(_bytes(r["recording_path"]), r["sample_rate_hz"])[1][:, 0].astype(np.float64)
            sweep = _signal(r["reference_path"], r["sample_rate_hz"])
            found = analysed(x, sweep, r["sample_rate_hz"], r["lo_hz"], r["hi_hz"])
        except (ValueError, OSError, Unusable) as e:
            return f"Analysis failed: {e}", None
        points = sorted((p["frequency_hz"], p["spl_db"]) for p in r["points"] or [])
        text = csv_of(found["curve"], tuple(np.array(points).T) if points else None).encode()
        try:
            folder, _, name = r["target"].rpartition("/")
            _put(folder, name, text)
        except OSError as e:
            return f"Failed to write CSV: {e}", None
        return None, hashlib.sha256(text).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(r) for r in batch.to_pylist()]
            yield pa.record_batch([batch.column("session"), batch.column("ordinal"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["session", "ordinal", "failure", "output_sha256"])

    kind = rows.schema["session"].dataType.simpleString()
    return rows.repartitionByRange(spread, "session", "ordinal").mapInArrow(work, f"session {kind}, ordinal int, failure string, output_sha256 string")


def reprocess(spark: SparkSession, root: str, channels: DataFrame, known: DataFrame, reference: str = "reference.wav") -> DataFrame:
    """(session, ordinal, channel_name, wav_path, csv_path, success, error, state, input_sha256, output_sha256) of all channels, after analysing those that are due.

    ``known`` is what the run before returned, or empty. ``state`` is
    recomputed, unchanged, passed_on (it had failed when it was recorded) or
    failed. Curves are written into the sessions' folders under ``root``, which
    all tasks must reach; they are made as this is called, so that a result that
    is kept is one that was written.
    """
    files = checkpointed(session_content(spark, root))
    rows = checkpointed(planned(channels, files, known, reference))
    due = rows.where("state = 'due'")
    texts = files.select("session", F.col("path").alias("calibration_path"), F.explode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("line"))
    wanted = due.select("session", "calibration_path").distinct()
    points = curve_rows(texts.join(wanted, ["session", "calibration_path"], "left_semi"), ["session", "calibration_path"], "line")
    points = points.groupBy("session", "calibration_path").agg(F.collect_list(F.struct("frequency_hz", "spl_db")).alias("points"))
    base = root.rstrip("/")
    work = due.join(points, ["session", "calibration_path"], "left").select("session", "ordinal", "recording_path", "reference_path", "sample_rate_hz", "lo_hz", "hi_hz", "points", F.concat(F.lit(f"{base}/"), "session", F.lit("/"), "csv_path").alias("target"))
    made = checkpointed(_analysed(work))
    both = rows.join(made, ["session", "ordinal"], "left")
    refused = ~F.col("state").isin("passed_on", "unchanged", "due")
    failed = refused | F.col("failure").isNotNull()
    state = F.when(F.col("state").isin("passed_on", "unchanged"), F.col("state")).when(failed, "failed").otherwise("recomputed")
    return both.select(
        "session", "ordinal", "channel_name", "wav_path", "csv_path", (F.coalesce("success", F.lit(False)) & ~failed).alias("success"), F.when(failed, F.coalesce("failure", "state")).otherwise(F.col("error")).alias("error"),
        state.alias("state"), F.when(~failed & (state != "passed_on"), F.col("input_sha256")).alias("input_sha256"), F.when(F.col("state") == "unchanged", F.col("result_sha256")).otherwise(F.col("output_sha256")).alias("output_sha256"),
    )


def recomputed(result: DataFrame) -> DataFrame:
    """(state, channels): how many channels of a run were recomputed, kept, passed on and failed."""
    return result.groupBy("state").agg(F.count("*").alias("channels"))
