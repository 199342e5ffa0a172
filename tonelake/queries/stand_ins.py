"""The given tables in the roles of a session's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(take_id, source_id, samples): a take for each embedding."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("take_id"), F.col("label").alias("source_id"), F.col("embedding").alias("samples"))


def long_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(take_id, idx, x): a row for each sample of a take."""
    return takes(spark, sf_dir).select("take_id", F.posexplode("samples").alias("idx", "x")).withColumn("x", F.col("x").cast("double"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, idx, x): all events as one stream of samples below full scale."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("idx"), (F.col("value") / 500).alias("x"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, source, microphone, repeat, distance_m, sigma_m, confidence_db, band, reason): order lines as range cells."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("session"), (F.col("l_partkey") % 7).alias("source"), (F.col("l_suppkey") % 10).alias("microphone"),
        F.col("l_linenumber").alias("repeat"), F.col("l_quantity").alias("distance_m"), F.col("l_discount").alias("sigma_m"),
        F.col("l_extendedprice").alias("confidence_db"), F.col("l_linestatus").alias("band"), F.col("l_returnflag").alias("reason"),
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def nearest(x: Column, digits: int) -> Column:
    """``x`` as SQL rounds it: the product with a power of ten, halves away from zero; what becomes zero keeps its sign."""
    return F.signum(x) * F.round(F.abs(x) * 10.0**digits) / 10.0**digits
