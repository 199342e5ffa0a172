"""Keys, completeness and lookups over a session's catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of two key tables of a plan, which has 64 sources and 32 microphones at most."""
    return left.crossJoin(right)


def missing_cells(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys of which there is no row."""
    return expected.select(*keys).join(found.select(*keys).distinct(), keys, "left_anti")


def repeated_keys(rows: DataFrame, keys: list[Column | str]) -> DataFrame:
    """(keys, rows) of keys with more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key no parent has; rows without a key are orphans, too."""
    known = parents.select(F.col(parent_key).alias("_k")).distinct()
    return rows.join(known, F.col(key) == F.col("_k"), "left_anti")


def with_fallback(rows: DataFrame, own: str, channel: DataFrame, key: str, value: str, default: Column, to: str) -> DataFrame:
    """``to``: a row's own value, else its channel's, else the default; empty texts are none, and of a channel that has several values, none counts."""
    named = channel.select(key, F.nullif(F.col(value), F.lit("")).alias("_v"))
    given = named.groupBy(key).agg(F.min("_v").alias("_v"), F.max("_v").alias("_w")).select(key, F.when(F.col("_v") == F.col("_w"), F.col("_v")).alias("_v"))
    return rows.join(given, key, "left").withColumn(to, F.coalesce(F.nullif(F.col(own), F.lit("")), F.col("_v"), F.nullif(default, F.lit("")))).drop("_v")


def calibrated(takes: DataFrame, calibrations: DataFrame, microphone: str) -> DataFrame:
    """``takes`` with their microphone's calibration as a struct, and an issue where there is none, or more than one."""
    rest = [c for c in calibrations.columns if c != microphone]
    one = calibrations.groupBy(microphone).agg(F.count("*").alias("_n"), F.min(F.struct(*rest)).alias("calibration"))
    both = takes.join(one, microphone, "left")
    issue = F.when(F.col("_n").isNull(), "calibration_missing").when(F.col("_n") > 1, "calibration_repeated")
    return both.withColumns({"calibration": F.when(issue.isNull(), F.col("calibration")), "issue": issue}).drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` that no row of ``new`` replaces; null keys are keys."""
    fresh = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return old.join(fresh, same, "left_anti").unionByName(new)


def routed(frames: DataFrame, idx: str, regions: DataFrame, default: Column) -> DataFrame:
    """Each frame with the channel of the region [start_frame, end_frame) it is in, else the default.

    Regions are a bounded table (a plan has 16 at most), so they are broadcast.
    """
    inside = (F.col(idx) >= F.col("start_frame")) & (F.col(idx) < F.col("end_frame"))
    r = regions.select("start_frame", "end_frame", F.col("channel").alias("_c"))
    return frames.join(F.broadcast(r), inside, "left").withColumn("channel", F.coalesce("_c", default)).drop("_c", "start_frame", "end_frame")


def overlapping_regions(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Regions that are empty, or begin before an earlier one of their key has ended."""
    reach = Window.partitionBy(*keys).orderBy("start_frame", "end_frame").rowsBetween(Window.unboundedPreceding, -1)
    late = F.max("end_frame").over(reach)
    return regions.withColumn("_e", late).where((F.col("start_frame") >= F.col("end_frame")) | (F.col("start_frame") < F.col("_e"))).drop("_e")


def within_bounds(candidates: DataFrame, value: str, bounds: DataFrame, most: int = 1024) -> DataFrame:
    """Candidates inside any of the [lo, hi] that a device advertises, each once; more than ``most`` bounds are an error, as every task gets them all."""
    if bounds.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} bounds")
    return candidates.join(F.broadcast(bounds.select("lo", "hi")), (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")), "left_semi")


def unique_or_named(wanted: DataFrame, devices: DataFrame) -> DataFrame:
    """(selector, device_id, error): the one device with that id, else the one with that name."""
    named = devices.groupBy(F.lower("name").alias("_n")).agg(F.count("*").alias("_many"), F.min("device_id").alias("_by_name"))
    exact = devices.groupBy(F.col("device_id").alias("_id")).agg(F.count("*").alias("_ids"))
    both = wanted.join(exact, F.col("selector") == F.col("_id"), "left").join(named, F.lower("selector") == F.col("_n"), "left")
    found = F.when(F.col("_ids") == 1, F.col("_id")).when(F.col("_many") == 1, F.col("_by_name"))
    error = F.when(found.isNotNull(), None).when((F.col("_many") > 1) | (F.col("_ids") > 1), "ambiguous").otherwise("not_found")
    return both.select("selector", found.alias("device_id"), error.alias("error"))


def identities(rows: DataFrame, channel: str, order: list[str], name: Column) -> DataFrame:
    """Rows with a speaker name and a number from 0 within their channel, in the given order."""
    nth = F.row_number().over(Window.partitionBy(channel).orderBy(*order)) - 1
    return rows.withColumns({"speaker": F.trim(F.split(name, r" \(").getItem(0)), "measurement_index": nth})


def first_by_priority(rows: DataFrame, keys: list[str], priority: str, order: list[str]) -> DataFrame:
    """The row of each key with the least priority, and of those the first."""
    w = Window.partitionBy(*keys).orderBy(priority, *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def inventory(files: DataFrame, name: str, content: str) -> DataFrame:
    """(name, bytes, sha256, copies) of each name, with ``conflict`` where one name has several contents."""
    rows = files.select(F.lower(name).alias("name"), F.octet_length(content).alias("bytes"), F.sha2(F.col(content), 256).alias("sha256"))
    return rows.groupBy("name").agg(
        F.count("*").alias("copies"), F.countDistinct("sha256").alias("contents"), F.min("bytes").alias("bytes"), F.min("sha256").alias("sha256"),
        (F.countDistinct("sha256") > 1).alias("conflict"),
    )


def merged_devices(devices: DataFrame, key: str) -> DataFrame:
    """One row for each card: its best name (default first, then channels), all rates, and whether any is default."""
    rank = (F.col("is_default").cast("int") * 1000 + F.col("channels")).alias("rank")
    return devices.groupBy(key).agg(
        F.max(F.struct(rank, F.col("name"))).getField("name").alias("name"),
        F.max("channels").alias("channels"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("rates")))).alias("rates"),
        F.bool_or("is_default").alias("is_default"),
    )


def without_shared_prefix(devices: DataFrame, name: str) -> DataFrame:
    """Names of the form "prefix (own)" become "own" where several share the prefix."""
    prefix = F.upper(F.trim(F.split(F.col(name), r"\(").getItem(0)))
    own = F.regexp_extract(name, r"\((.*)\)", 1)
    n = F.count("*").over(Window.partitionBy("_p"))
    return devices.withColumn("_p", prefix).withColumn("short_name", F.when((n > 1) & (own != ""), own).otherwise(F.col(name))).drop("_p")


def name_listing(rows: DataFrame, keys: list[str], name: str, most: int = 12) -> DataFrame:
    """(keys, listing): the first names in order, and how many more there are."""
    names = rows.select(*keys, F.trim(name).alias("n")).where("n <> ''").distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("n"))
    kept = names.withColumn("i", nth).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("i") <= most, F.col("n")))).alias("l"), F.greatest(F.max("i") - most, F.lit(0)).alias("more")
    )
    line = F.array_join("l", ", ")
    return kept.select(*keys, F.when(F.col("more") > 0, F.concat(line, F.lit(" ... and "), F.col("more"), F.lit(" more"))).otherwise(line).alias("listing"))


def rate_candidates(requested: Column, default: Column) -> Column:
    """The rates to try: the requested one, the usual ones, the device's own; each once."""
    return F.filter(F.array_distinct(F.array(requested, F.lit(48000), F.lit(44100), F.lit(96000), F.lit(192000), default)), lambda r: r.isNotNull())


def recording_grid(positions: DataFrame, speakers: DataFrame, microphones: DataFrame) -> DataFrame:
    """All channels to record: position, then speaker, then microphone, with names and sweep bands.

    The three tables are a plan's: 64 speakers, 32 microphones and the positions of one session.
    """
    n = lambda t: t.count()
    many_p, many_m = n(positions) > 1, n(microphones) > 1
    rows = positions.crossJoin(speakers).crossJoin(microphones)
    inner = [*([F.concat(F.lit("Pos "), F.col("position") + 1)] if many_p else []), *([F.concat(F.lit("Mic "), F.col("microphone") + 1)] if many_m else [])]
    name = F.concat(F.col("speaker"), F.lit(" ("), F.concat_ws(" / ", *inner), F.lit(")")) if inner else F.col("speaker")
    bass = F.lower("speaker").isin("lfe", "sub")
    return rows.select(
        "position", "speaker_index", "microphone", name.alias("name"),
        F.when(bass, 10.0).otherwise(20.0).alias("start_hz"), F.when(bass, 500.0).otherwise(20000.0).alias("end_hz"),
    )
