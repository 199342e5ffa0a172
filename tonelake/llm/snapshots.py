"""Collapse of conversations that were logged again and again as they grew.

A conversation's turns are numbered by their order, and every turn has a prefix
hash over it and all turns before: the sums, up to there, of four 32-bit parts
of the turns' hashes, each of which binds number, role and text. Turns lie in
ranges of their order, each in one task, with counts and sums carried over from
the ranges before, so a conversation of any length is spread over tasks,
whether or not its turn numbers differ.
A conversation whose last prefix hash is also that of a turn inside a longer
one is a snapshot of that and goes; of equal conversations the least id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turn numbers in a block: what one rendered row holds.
BLOCK = 512
#: A block of more bytes than this (repeated or null numbers) is rendered in several rows.
PART_BYTES = 64 << 20

_PARTS = [f"p{k}" for k in range(4)]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, turn, nth, role, text, block, at, size, upto, p0..p3) of each turn.

    at is the range it is in, p its prefix hash, size its bytes, and upto those of its conversation up to its end.
    """
    rows = turns.select(
        F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text",
        F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK)), F.lit(-(1 << 40))).alias("block"),
        F.spark_partition_id().alias("origin"),
    )
    # equal turns may stand in any order, so their origin spreads them
    ranged = rows.repartitionByRange("conv", "turn", "role", "text", "origin").drop("origin")
    rows = cut(ranged.withColumn("at", F.spark_partition_id()))
    inside = Window.partitionBy("conv", "at").orderBy("turn", "role", "text")
    nth = F.row_number().over(inside).cast("long").alias("nth")
    held = rows.groupBy("conv", "at").agg(F.count("*").alias("held"))
    ahead = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.select("conv", "at", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("offset"))
    rows = rows.select("*", nth).join(offset, ["conv", "at"]).withColumn("nth", F.col("nth") + F.col("offset")).drop("offset")
    mark = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))
    own = F.sha2(F.concat_ws("\x1f", F.col("nth").cast("string"), mark("role"), mark("text")), 256)
    size = F.lit(len("<|im_start|>\n<|im_end|>\n")) + F.coalesce(F.octet_length("role"), F.lit(0)).cast("long") + F.coalesce(F.octet_length("text"), F.lit(0))
    rows = rows.withColumns({"own": own, "size": size})
    part = [F.conv(F.substring("own", 8 * k + 1, 8), 16, 10).cast("long").alias(p) for k, p in enumerate(_PARTS)]
    rows = cut(rows.select("conv", "turn", "nth", "role", "text", "block", "at", "size", *part))
    summed = [*_PARTS, "size"]
    sums = rows.groupBy("conv", "at").agg(*[F.sum(p).alias(p) for p in summed])
    before = sums.select("conv", "at", *[F.coalesce(F.sum(p).over(ahead), F.lit(0)).alias(f"b{p}") for p in summed])
    upto = Window.partitionBy("conv", "at").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("*", *[F.sum(p).over(upto).alias(f"r{p}") for p in summed]).join(before, ["conv", "at"])
    whole = [F.pmod(F.col(f"r{p}") + F.col(f"b{p}"), F.lit(1 << 32)).alias(p) for p in _PARTS]
    return running.select("conv", "turn", "nth", "role", "text", "block", "at", "size", (F.col("rsize") + F.col("bsize")).alias("upto"), *whole)


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All turns with their prefixes, and (conv, n_turns, n_copies) of the conversations that stay."""
    rows = cut(prefixes(turns))
    last = rows.groupBy("conv").agg(F.max(F.struct("nth", *_PARTS)).alias("e")).select("conv", "e.*")
    ends = last.groupBy("nth", *_PARTS).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    inner = _with(rows, last.select("conv", F.col("nth").alias("n"))).where("nth < n").select("nth", *_PARTS).distinct()
    return rows, ends.join(inner, ["nth", *_PARTS], "left_anti").select("conv", F.col("nth").alias("n_turns"), "n_copies")


def _with(rows: DataFrame, of: DataFrame) -> DataFrame:
    """``rows`` joined with what is said ``of`` their conversations, range by range, so that no conversation is in one task."""
    ranges = rows.groupBy("conv", "at").agg(F.count("*").alias("held")).select("conv", "at").join(of, "conv")
    return rows.join(ranges, ["conv", "at"])


def collapse(turns: DataFrame) -> DataFrame:
    """The conversations that are no prefix of another, rendered.

    ``turns`` has conv_id, turn, role, text. One row for each block of turn
    numbers of a conversation, or several if it has more than ``PART_BYTES``
    bytes: conv_id, part (from 0), n_turns and n_copies of the whole
    conversation, rendered. Turns of one number are ordered by role
    and text, null numbers come first; a null conv_id is a conversation like
    any other; null role or text differs from an empty one and is rendered
    empty. An empty table gives an empty one; other columns are not read.
    """
    rows, kept = maximal(turns)
    said = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    # at most one of these for each PART_BYTES of turns
    large = rows.groupBy("conv", "block").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > PART_BYTES).select("conv", "block", F.lit(True).alias("large"))
    # what is said of conversations and blocks is joined range by range, so that none of them is in one task
    ranges = rows.groupBy("conv", "at", "block").agg(F.count("*").alias("held")).select("conv", "at", "block").join(kept, "conv").join(large, ["conv", "block"], "left")
    mine = rows.join(ranges, ["conv", "at", "block"])
    piece = F.when(F.col("large"), F.floor((F.col("upto") - F.col("size")) / PART_BYTES)).otherwise(0).alias("piece")
    # blocks of one conversation part here, else the join leaves them all in one task
    mine = mine.select("conv", "n_turns", "n_copies", "block", piece, F.struct("nth", said.alias("said")).alias("t")).repartition("conv", "block", "piece")
    parts = mine.groupBy("conv", "block", "piece").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list("t")).alias("t"))
    number = F.row_number().over(Window.partitionBy("conv").orderBy("block", "piece")) - 1
    return parts.select(
        F.col("conv.conv_id").alias("conv_id"), number.alias("part"), "n_turns", "n_copies", F.array_join(F.col("t.said"), "").alias("rendered")
    )
