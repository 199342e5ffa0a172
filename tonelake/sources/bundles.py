"""Writers: curves as CSV, recordings, and bundles that appear as a whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of an analysis curve and their decimals.
CURVE_COLUMNS = {"frequency_hz": 6, "spl_db": 3, "phase_deg": 6, "thd_percent": 6, "rt60_ms": 3, "c50_db": 3, "c80_db": 3, "group_delay_ms": 6}
OPTIONAL_COLUMNS = {"coherence": 4, "noise_floor_db": 3}


def curve_lines(curves: DataFrame, keys: list[str], compensation: Column | None = None) -> DataFrame:
    """(keys, frequency_hz, line) of analysis curves; missing distortion is NaN, other missing values are 0."""
    spl = F.col("spl_db") if compensation is None else F.col("spl_db") - F.coalesce(compensation, F.lit(0.0))
    fields = []
    for c, digits in (CURVE_COLUMNS | {k: v for k, v in OPTIONAL_COLUMNS.items() if k in curves.columns}).items():
        value = spl if c == "spl_db" else F.col(c)
        text = F.format_string(f"%.{digits}f", F.coalesce(value.cast("double"), F.lit(0.0)))
        fields.append(F.when(value.isNull() | F.isnan(value.cast("double")), "NaN").otherwise(text) if c == "thd_percent" else text)
    return curves.select(*keys, "frequency_hz", F.concat_ws(",", *fields).alias("line"))


def write_curves(curves: DataFrame, keys: list[str], path: str) -> None:
    """A folder of text for each key, its lines in order of frequency."""
    lines = curve_lines(curves, keys)
    lines.repartition(*keys).sortWithinPartitions(*keys, "frequency_hz").select(*keys, "line").write.partitionBy(*keys).text(path)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Lets ``write`` fill a folder beside ``path`` and then gives it that name.

    Readers see all of it or nothing, and a name that is taken stays as it is.
    The name is claimed first, by a file that only one writer can create, so
    that of two there is one winner. A driver that dies meanwhile leaves its
    claim, which is to be removed by hand.
    """
    fs, target, at = _file_system(spark, path)
    staged, claim = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}", at(f"{path.rstrip('/')}.claim")
    try:
        fs.create(claim, False).close()
    except Py4JJavaError as e:
        raise FileExistsError(f"{path} is being written") from e
    try:
        if fs.exists(target):
            raise FileExistsError(path)
        write(staged)
        if not fs.rename(at(staged), target):
            raise FileExistsError(path)
    finally:
        fs.delete(at(staged), True)
        fs.delete(claim, False)


def bundle_inventory(files: DataFrame, roles: DataFrame) -> DataFrame:
    """(name, role, bytes, sha256) of a bundle's files; of several roles the one of least rank."""
    first = roles.groupBy("name").agg(F.min_by("role", "rank").alias("role"))
    return files.join(first, "name", "left").select("name", F.coalesce("role", F.lit("supporting")).alias("role"), "bytes", "sha256")
