"""Speaker layouts, pairs of ears, and completeness across microphones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of the channels that each number of a layout adds, and the layouts there are.
_FLOOR = {5: ["L", "R", "C", "SL", "SR"], 7: ["BL", "BR"], 9: ["WL", "WR"]}
_HEIGHT = {2: ["TFL", "TFR"], 4: ["TFL", "TFR", "TBL", "TBR"], 6: ["TFL", "TFR", "TML", "TMR", "TBL", "TBR"]}
LAYOUTS = ["2.0", "2.1", "2.2", "5.0", "5.1", "7.1", "9.1", "5.1.2", "5.1.4", "7.1.2", "7.1.4", "9.1.2", "9.1.4", "9.1.6", "custom"]


def channel_names(layout: str) -> list[str]:
    if layout == "custom":
        return ["L", "R"]
    floor, bass, height = ([int(x) for x in layout.split(".")] + [0])[:3]
    if floor == 2:
        return ["L", "R", *{0: [], 1: ["LFE"], 2: ["Sub1", "Sub2"]}[bass]]
    front, side = _FLOOR[5][:3], _FLOOR[5][3:]
    return [*front, *["LFE"] * bass, *side, *[n for k in (7, 9) if floor >= k for n in _FLOOR[k]], *_HEIGHT.get(height, [])]


def layout_table(spark: SparkSession) -> DataFrame:
    """(layout, ordinal, channel, channels) of every layout."""
    rows = [(name, i, c, len(channel_names(name))) for name in LAYOUTS for i, c in enumerate(channel_names(name))]
    return spark.createDataFrame(rows, "layout string, ordinal int, channel string, channels int")


def ear_pairs(takes: DataFrame, keys: list[str], role: Column, same: list[str]) -> DataFrame:
    """(keys, left_take, right_take, issue): the takes of both ears of a head, and what keeps them from being one.

    A pair must be whole and agree in the columns ``same``, such as device and sample count.
    """
    sided = takes.withColumn("_role", role)
    pick = lambda side, c: F.max(F.when(F.col("_role") == side, F.col(c)))
    many = lambda side: F.count_if(F.col("_role") == side)
    both = sided.groupBy(*keys).agg(many("left").alias("_l"), many("right").alias("_r"), pick("left", "take_id").alias("left_take"), pick("right", "take_id").alias("right_take"), *[f(F.when(F.col("_role").isin("left", "right"), F.col(c))).alias(f"_{n}_{c}") for c in same for n, f in (("min", F.min), ("max", F.max))])
    issue = F.when((F.col("_l") == 0) | (F.col("_r") == 0), "missing_ear").when((F.col("_l") > 1) | (F.col("_r") > 1), "several_takes")
    for c in same:
        issue = F.coalesce(issue, F.when(F.col(f"_min_{c}") != F.col(f"_max_{c}"), f"different_{c}"))
    return both.select(*keys, "left_take", "right_take", issue.alias("issue"))


def complete_everywhere(links: DataFrame, keys: list[str], complete: str) -> DataFrame:
    """Links with ``usable``: a source's phase counts only if it is there on every microphone of it."""
    return links.withColumn("usable", F.coalesce(F.bool_and(F.coalesce(complete, F.lit(False))).over(Window.partitionBy(*keys)), F.lit(False)))


def ranked_config(configs: DataFrame, keys: list[str], channels: int, rate: int, formats: list[str]) -> DataFrame:
    """The configuration of each device that holds so many channels at a rate: best format first, then fewest channels."""
    rank = F.array_position(F.array(*[F.lit(f) for f in formats]), F.col("format"))
    fit = configs.where((F.col("channels") >= channels) & (F.col("min_rate") <= rate) & (F.col("max_rate") >= rate) & (rank > 0))
    return fit.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), "channels", "format")).alias("c")).select(*keys, "c.format", "c.channels")
