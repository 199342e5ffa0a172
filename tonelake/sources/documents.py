"""Curves in loose text, and JSON documents with a fixed set of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tonelake.functions.levels import is_finite


def curve_rows(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, frequency_hz, spl_db) of lines of a calibration text.

    Comments, headings and anything that does not begin with a frequency up to
    100 kHz and a level are passed over; commas, tabs and spaces separate.
    """
    text = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    plain = lines.withColumn("_t", text).where((F.col("_t") != "") & ~F.col("_t").rlike(r"^(#|//)") & ~F.lower("_t").rlike("frequency|spl|hz"))
    parts = F.filter(F.split("_t", "[,\t ]+"), lambda p: p != "")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    rows = plain.select(*keys, number(0).alias("frequency_hz"), number(1).alias("spl_db"))
    return rows.where((F.col("frequency_hz") > 0) & (F.col("frequency_hz") <= 100_000) & is_finite(F.col("spl_db")))


def calibration_curves(spark: SparkSession, path: str) -> DataFrame:
    """(file, frequency_hz, spl_db) of all calibration texts under a path."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return curve_rows(lines, ["file"], "value")


def _unknown(path: Column, kind: DataType, value: Column) -> Column:
    """The places of keys that a parsed value has, in any of its objects, and its schema has not."""
    if isinstance(kind, ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.flatten(F.transform(items, lambda item, i: _unknown(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), kind.elementType, item)))
    if not isinstance(kind, StructType):
        return F.array().cast("array<string>")
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    odd = F.array_except(keys, F.array(*[F.lit(f.name) for f in kind.fields]))
    parts = [F.transform(odd, lambda k: F.concat(path, F.lit("."), k))]
    for f in kind.fields:
        if isinstance(f.dataType, (ArrayType, StructType)):
            parts.append(_unknown(F.concat(path, F.lit(f".{f.name}")), f.dataType, F.try_variant_get(value, f"$.{f.name}", "variant")))
    return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])


def strict_json(rows: DataFrame, text: str, schema: StructType, to: str = "document") -> DataFrame:
    """``rows`` with the parsed document, and ``unknown_keys``: where it has keys that its schema has not.

    All objects are looked at, in every element of every array. A text that is
    no JSON, or repeats a key in one object, has a null document and no keys.
    """
    parsed = "_".join(["parsed", *rows.columns])
    unknown = F.coalesce(_unknown(F.lit(""), schema, F.col(parsed)), F.array().cast("array<string>"))
    document = F.when(F.col(parsed).isNotNull(), F.from_json(F.col(text), schema))
    return rows.withColumn(parsed, F.try_parse_json(F.col(text))).withColumns({to: document, "unknown_keys": unknown}).drop(parsed)


LOSS_REPORT = (
    "version int, error string, inputs array<struct<device_id: string, routes: array<struct<input_index: bigint, hardware_channel: int>>, continuity: "
    "struct<observed_frames: bigint, missing_frames_per_channel: bigint, omitted_intervals: bigint, intervals: array<struct<start_frame: bigint, end_frame: bigint>>>>>"
)


def loss_report_schema() -> StructType:
    """The schema, which a running session reads from its text."""
    return StructType.fromDDL(LOSS_REPORT)


def loss_report_issue(report: Column) -> Column:
    """What is wrong with a report of lost frames, or null: header, device, order of gaps, or their sum."""

    def clock_issue(i: Column) -> Column:
        c = i["continuity"]
        gaps = c["intervals"]
        before = F.transform(gaps, lambda g, k: F.when(k > 0, F.get(gaps, k - 1)["end_frame"]).otherwise(0))
        ordered = F.forall(F.arrays_zip(gaps.alias("g"), before.alias("b")), lambda z: (z["g"]["start_frame"] >= z["b"]) & (z["g"]["end_frame"] > z["g"]["start_frame"]) & (z["g"]["end_frame"] <= c["observed_frames"]))
        total = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g["end_frame"] - g["start_frame"])
        missing, omitted = c["missing_frames_per_channel"], c["omitted_intervals"]
        return (
            F.when((i["device_id"] == "") | (F.size(i["routes"]) < 1) | (F.size(i["routes"]) > 64) | (F.size(gaps) > 128) | ((omitted > 0) & (F.size(gaps) != 128)), "device_or_count")
            .when(~ordered, "interval_order")
            .when((total > missing) | (missing > c["observed_frames"]) | (omitted > missing - total) | ((omitted == 0) & (total != missing)), "interval_sum")
        )

    issues = F.filter(F.transform(report["inputs"], clock_issue), lambda x: x.isNotNull())
    header = (report["version"] == 1) & (report["error"] != "") & F.size(report["inputs"]).between(1, 64)
    return F.when(~F.coalesce(header, F.lit(False)), "header").otherwise(F.get(issues, F.lit(0)))


def verified_files(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, issue) of declared files that are missing or other than declared, and of files never declared."""
    a, b = files.select("name", F.col("sha256").alias("found")), declared.select("name", F.col("sha256").alias("wanted"))
    issue = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "undeclared").when(F.col("found") != F.col("wanted"), "changed")
    return a.join(b, "name", "full").select("name", issue.alias("issue")).where("issue is not null")


def sparse_series(x: Column) -> Column:
    """A series for JSON: elements that are not finite are null."""
    return F.transform(x, lambda e: F.when(is_finite(e), e))


def dense_series(x: Column) -> Column:
    """A series from JSON: nulls are NaN."""
    return F.transform(x, lambda e: F.coalesce(e, F.lit(float("nan")).cast("float")))


def latest_generation(rows: DataFrame, key: str, generation: str) -> DataFrame:
    """Rows of each key's newest generation; results of earlier ones came too late."""
    newest = F.max(generation).over(Window.partitionBy(key))
    return rows.withColumn("_g", newest).where(F.col(generation) == F.col("_g")).drop("_g")
