"""Values at exact ranks of streams of any length, in memory that does not grow with them.

A double's bits, turned so that they sort as the number does, are counted by
their first sixteen, then by the next sixteen of those that matter, and so on:
four rounds of at most 65536 counts for each key, all of them plain aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tonelake.sources.staging import checkpointed

_REST = np.int64(0x7FFFFFFFFFFFFFFF)


def sortable(x: Column) -> Column:
    """A long that sorts as the double does; null for null and NaN. Both zeros are one."""

    @arrow_udf("long")
    def bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            v = batch.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            b = v.view(np.int64)
            yield pa.array(b ^ ((b >> np.int64(63)) & _REST), mask=np.isnan(v))

    return bits(x.cast("double"))


def unsorted(b: Column) -> Column:
    """The double of a long that ``sortable`` made."""

    @arrow_udf("double")
    def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            b = batch.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = (b ^ ((b >> np.int64(63)) & _REST)).view(np.float64)
            yield pa.array(v, mask=batch.is_null().to_numpy(zero_copy_only=False))

    return value(b)


def order_statistics(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, n, names): of each key the values at ranks from 0, each of which is a function of how many values there are.

    Nulls and NaN are no values; a key without any has no row. A rank that does
    not exist is null. Values are counted before they are shuffled and the
    counts kept in the checkpoint folder, as each round reads them.
    """
    counted = rows.select(*keys, sortable(F.col(value)).alias("_b")).where("_b is not null").groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    counted = checkpointed(counted)
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()]))
    targets = sizes.select(*keys, "n", wanted.alias("_t")).select(*keys, "n", "_t.name", "_t.rank", F.lit(0).cast("long").alias("_hi"))
    for shift in (48, 32, 16, 0):
        hi = F.lit(0).cast("long") if shift == 48 else F.shiftright("_b", shift + 16)
        level = counted.withColumns({"_hi": hi, "_p": F.shiftright("_b", shift) if shift else F.col("_b")})
        near = level.join(targets.select(*keys, "_hi").distinct(), [*keys, "_hi"], "left_semi") if shift < 48 else level
        counts = near.groupBy(*keys, "_hi", "_p").agg(F.sum("_n").alias("_m"))
        before = F.sum("_m").over(Window.partitionBy(*keys, "_hi").orderBy("_p")) - F.col("_m")
        counts = counts.withColumn("_before", before)
        met = targets.join(counts, [*keys, "_hi"]).where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_m")))
        targets = met.select(*keys, "n", "name", (F.col("rank") - F.col("_before")).alias("rank"), F.col("_p").alias("_hi"))
    found = targets.select(*keys, "name", unsorted(F.col("_hi")).alias("v")).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return sizes.join(found, keys, "left")


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, median): the middle value, or the midpoint of the two middle ones."""
    two = order_statistics(rows, keys, value, {"_lo": lambda n: F.floor((n - 1) / 2), "_up": lambda n: F.floor(n / 2)})
    return two.select(*keys, "n", ((F.col("_lo") + F.col("_up")) / 2).alias("median"))
