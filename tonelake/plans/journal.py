"""Integrity of acquisition journals: takes against their plan, selections, snapshots and calibrations.

Each check is a join or an aggregate whose rows are what is wrong, so sessions
of any number are judged in one job and a sound journal gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.levels import is_finite


def _named(rows: DataFrame, key: str, what: Column | str, issue: str) -> DataFrame:
    what = F.col(what) if isinstance(what, str) else what
    return rows.select(F.col(key).alias("session"), F.lit(issue).alias("issue"), what.cast("string").alias("what"))


def take_issues(takes: DataFrame, microphones: DataFrame, sources: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, issue, what) of takes: unknown parts, repeats beyond the plan, ids, cells and files that occur twice, cells without a take.

    ``takes`` has session, take_id, source_id, microphone_id, repeat_index and
    file; ``microphones`` and ``sources`` have session and their id;
    ``sessions`` has session and repeats.
    """
    cell = ["session", "source_id", "microphone_id", "repeat_index"]
    label = F.concat_ws("/", *cell[1:])
    twice = lambda keys, what, issue: _named(takes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "session", what, issue)
    far = takes.join(sessions, "session").where(~F.coalesce(F.col("repeat_index").between(0, F.col("repeats") - 1), F.lit(False)))
    want = sources.join(microphones, "session").join(sessions, "session").withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    found = [
        _named(takes.join(microphones, ["session", "microphone_id"], "left_anti"), "session", "take_id", "unknown_microphone"),
        _named(takes.join(sources, ["session", "source_id"], "left_anti"), "session", "take_id", "unknown_source"),
        _named(far, "session", "take_id", "repeat_range"),
        _named(takes.where(F.coalesce(F.trim("take_id") == "", F.lit(True))), "session", F.lit(None), "empty_take_id"),
        twice(["session", "take_id"], "take_id", "duplicate_take_id"),
        twice(cell, label, "duplicate_cell"),
        twice(["session", F.lower("file").alias("file")], "file", "duplicate_file"),
        _named(want.join(takes, cell, "left_anti"), "session", label, "missing_cell"),
    ]
    return reduce(DataFrame.unionByName, found)


def selection_issues(selected: DataFrame, takes: DataFrame) -> DataFrame:
    """(session, issue, what) of the takes chosen for processing: one known take for each source and microphone."""
    known = selected.join(takes.select("session", "take_id", "source_id", "microphone_id"), ["session", "take_id"])
    pair = F.concat_ws("/", "source_id", "microphone_id")
    cells = takes.select("session", "source_id", "microphone_id").distinct()
    found = [
        _named(selected.groupBy("session", "take_id").agg(F.count("*").alias("n")).where("n > 1"), "session", "take_id", "selected_twice"),
        _named(selected.join(takes, ["session", "take_id"], "left_anti"), "session", "take_id", "unknown_take"),
        _named(known.groupBy("session", "source_id", "microphone_id").agg(F.countDistinct("take_id").alias("n")).where("n > 1"), "session", pair, "several_takes"),
        _named(cells.join(known, ["session", "source_id", "microphone_id"], "left_anti"), "session", pair, "no_take"),
    ]
    return reduce(DataFrame.unionByName, found)


def checkpoint_issues(checkpoints: DataFrame, takes: DataFrame) -> DataFrame:
    """(session, issue) of checkpoints that do not name the takes there are, or whose phase and status disagree."""
    held = takes.groupBy("session").agg(F.array_sort(F.collect_set("take_id")).alias("_held"))
    both = checkpoints.join(held, "session", "left")
    none = F.array().cast("array<string>")
    issue = F.when(~F.array_sort("committed").eqNullSafe(F.coalesce("_held", none)), "committed_takes").when((F.col("phase") == "complete") != (F.col("status") == "raw_complete"), "phase")
    return both.select("session", issue.alias("issue")).where("issue is not null")


def snapshot_issues(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(path, issue) of inputs that were frozen with a hash and are gone, new or other now; a null hash is no input."""
    a = frozen.where("sha256 is not null").select("path", F.col("sha256").alias("then"))
    b = now.where("sha256 is not null").select("path", F.col("sha256").alias("here"))
    issue = F.when(F.col("here").isNull(), "gone").when(F.col("then").isNull(), "new").when(F.col("then") != F.col("here"), "changed")
    return a.join(b, "path", "full").select("path", issue.alias("issue")).where("issue is not null")


def bench_lags(benches: DataFrame, key: str, lags: str) -> DataFrame:
    """(key, rate_hz, lag_samples, issue) of bench calibrations, whose lags come by rates that are texts."""
    rows = benches.select(key, F.explode(lags).alias("_k", "lag_samples")).withColumn("rate_hz", F.trim("_k").try_cast("int"))
    issue = F.when(F.col("rate_hz").isNull() | (F.col("rate_hz") <= 0), "rate").when(~is_finite(F.col("lag_samples")) | (F.col("lag_samples") < 0), "lag")
    return rows.select(key, "rate_hz", "lag_samples", issue.alias("issue"))


def event_levels(channels: DataFrame, keys: list[str], order: str, direct: str, event: str) -> DataFrame:
    """(keys, levels_db): an event's energy against the direct sound's on every microphone, in order; empty unless all are known."""
    db = F.when((F.col(event) > 0) & (F.col(direct) > 0), 10 * F.log10(F.col(event) / F.when(F.col(direct) > 0, F.col(direct))))
    lists = channels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), db.alias("db")))).alias("l"), F.every(is_finite(db)).alias("ok"))
    return lists.select(*keys, F.when(F.col("ok"), F.col("l.db")).otherwise(F.array().cast("array<double>")).alias("levels_db"))


def gathered(links: DataFrame, keys: list[str], microphones: int) -> DataFrame:
    """(keys, low_hz, high_hz, bound_us) of sources that all microphones have: the band they share, and the two worst clock bounds added."""
    both = links.groupBy(*keys).agg(
        F.countDistinct("microphone_id").alias("n"), F.max("low_hz").alias("low_hz"), F.min("high_hz").alias("high_hz"), F.slice(F.sort_array(F.collect_list("bound_us"), asc=False), 1, 2).alias("b")
    )
    whole = both.where((F.col("n") == microphones) & (F.col("low_hz") < F.col("high_hz")))
    return whole.select(*keys, "low_hz", "high_hz", F.aggregate("b", F.lit(0.0), lambda s, x: s + x).alias("bound_us"))


def restored(rows: DataFrame, sidecar: DataFrame, keys: list[str], columns: list[str], file_hash: Column, version: int = 1) -> DataFrame:
    """Rows with columns from a sidecar that was written for this very file; one of another version or hash counts for nothing, nor does a key with several different entries."""
    valid = sidecar.where((F.col("version") == version) & (F.col("sha256") == file_hash)).groupBy(*[F.col(k).alias(f"_{k}") for k in keys])
    entry = F.struct(*[F.col(c).alias(f"_v_{c}") for c in columns])
    valid = valid.agg(F.min(entry).alias("_v"), F.max(entry).alias("_w")).where(F.col("_v").eqNullSafe(F.col("_w"))).select(*[f"_{k}" for k in keys], "_v.*")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = rows.join(valid, same, "left")
    return both.withColumns({c: F.coalesce(c, f"_v_{c}") for c in columns}).drop(*[f"_{k}" for k in keys], *[f"_v_{c}" for c in columns])
