"""What filters do in every order: removed, redundant and lost rows, and Shapley shares.

A document fails some of the filters; what any order of them does depends only
on how many documents fail which. So one pass makes a mask of each document,
and the counts per part and mask (its cells, 32 for five filters) say it all.

All orders are visited by swaps of neighbours. A swap at step k changes which
documents steps k and k + 1 remove, and no other step, so each order costs two
sums over cells. The removals summed along the walk are the Shapley shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
#: Parts whose orders are in memory at a time.
PARTS = 128

_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> list[Column]:
    """Filters A to D, true where a text fails: few words, repeated words, capitals, odd characters. No text may be null."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [
        n < 100,
        100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"),
        100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Documents by part and mask of the filters they fail: n, good and toxic.

    Filter E is failed by a text that also stands under a lesser key; a null
    key is neither lesser nor greater than another. The SHA-256 stands for the
    text. Null texts are empty texts, a null part is the empty string. Labels
    may repeat a key: it is good, or toxic, if one of its rows says so.

    Rows are counted by key, text and mask before any shuffle, texts by their
    digest before they meet, so that copies of a text or a key, however many,
    are one row of each task; only counts per digest meet in one window.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures(said))), F.lit(0))
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(said, 256)).alias("digest")
    )
    once = rows.groupBy("key", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col(key).alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = once.join(marks, "key", "left").na.fill(False, ["good", "toxic"])
    known = F.col("key").isNotNull()
    texts = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min(F.when(known, F.struct("key", "n"))).alias("least"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unknown"),
    )
    # of one digest there are as many rows as parts and labels tell apart
    each = texts.withColumn("first", F.min("least.key").over(Window.partitionBy("digest")))
    first = F.when(F.col("least.key") == F.col("first"), F.col("least.n")).otherwise(0) + F.col("unknown")
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - first).alias("n"))))
    each = each.select("part", "good", "toxic", split.alias("cell"))
    count = F.col("cell.n")
    return (
        each.groupBy("part", F.col("cell.mask").alias("mask"))
        .agg(F.sum(count).alias("n"), F.sum(F.when(F.col("good"), count).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), count).otherwise(0)).alias("toxic"))
        .where("n > 0")
    )


def swaps(n: int) -> list[int]:
    """Places k, one after the other: swapping what stands at k and k + 1 each time meets every order of n things once."""
    if n < 2:
        return []
    found, down = [], True
    for inner in [*swaps(n - 1), None]:
        # the last thing walks through the others from end to end, then the others take their next swap
        found += range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            found.append(inner + down)
        down = not down
    return found


def walk(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All orders of n filters over cells.

    ``counts`` is part x mask x kind. Gives the orders (order x step, as filter
    numbers), what each step removes (part x order x step x kind), and the
    removals of the first kind summed over all orders (part x filter).
    """
    masks = np.arange(1 << n)
    parts, _, kinds = counts.shape

    def removes(f: int, before: int) -> np.ndarray:
        return counts[:, (masks >> f & 1 == 1) & (masks & before == 0)].sum(1)

    order, before, now = list(range(n)), 0, np.zeros((parts, n, kinds), np.int64)
    for k in order:
        now[:, k] = removes(k, before)
        before |= 1 << k
    orders = np.zeros((factorial(n), n), np.int64)
    removed = np.zeros((parts, factorial(n), n, kinds), np.int64)
    shares = np.zeros((parts, n), np.int64)
    for at, k in enumerate([None, *swaps(n)]):
        if k is not None:
            order[k], order[k + 1] = order[k + 1], order[k]
            before = sum(1 << f for f in order[:k])
            now[:, k] = removes(order[k], before)
            now[:, k + 1] = removes(order[k + 1], before | 1 << order[k])
        orders[at], removed[:, at] = order, now
        shares[:, order] += now[:, :, 0]
    return orders, removed, shares


def _walked(batches: Iterator[pa.RecordBatch], letters: str) -> Iterator[pa.RecordBatch]:
    n = len(letters)
    masks = np.arange(1 << n)
    for whole in batches:
        for at in range(0, whole.num_rows, PARTS):
            batch = whole.slice(at, PARTS)
            counts = np.zeros((batch.num_rows, 1 << n, 3), np.int64)
            for i, row in enumerate(batch.column("cells").to_pylist()):
                for c in row:
                    counts[i, c["mask"]] = c["n"], c["good"], c["toxic"]
            orders, removed, shares = walk(counts, n)
            fails = np.stack([counts[:, masks >> f & 1 == 1, 0].sum(1) for f in range(n)], 1)
            alone = counts[:, 1 << np.arange(n), 0]
            kept = counts[:, :, 0].sum(1)[:, None, None] - removed[..., 0].cumsum(2)
            names = ["".join(letters[f] for f in o) for o in orders]
            every = len(orders) * n
            columns = [
                pa.array([p for p in batch.column("part").to_pylist() for _ in range(every)], pa.string()),
                pa.array(np.tile(np.repeat(names, n), batch.num_rows), pa.string()),
                pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), batch.num_rows * len(orders))),
            ]
            for x in (kept, removed[..., 0], fails[:, orders] - removed[..., 0], alone[:, orders], removed[..., 1], removed[..., 2], shares[:, orders]):
                columns.append(pa.array(np.ascontiguousarray(x, np.int64).ravel()))
            yield pa.record_batch(columns, [x.split()[0] for x in _RESULT.split(", ")])


def interactions(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every order and step of the filters for each part of ``cells``.

    ``letters`` names the filters by their bits. Steps that remove nothing have
    their row too; no documents give no parts and so no rows.
    """
    whole = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # a part has 2 ** len(letters) cells at most
    return whole.mapInArrow(lambda batches: _walked(batches, letters), _RESULT)
