"""Benchmark decontamination by winnowed fingerprints.

Of every six neighbouring hashes of five words the least one is kept. Any ten
words that a document shares with a test item hold six such hashes, so both
sides keep the same one. Kept fingerprints of documents are first looked up in
a bit table of fixed size, then joined with those of the items; each pair of a
distinct text and an item that the join finds is then compared word by word,
which extends the hits to all words that lie in a shared window.

Items of fewer words than a window are one window. Their whole hash is the
fingerprint, and it is looked up at every place of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, slices

SPAN, K = 10, 5
#: Bits that address the table in which documents look fingerprints up: 2**24 bits are 2 MB, and 2**28, for items of many, 32 MB.
ADDRESS, MOST = 24, 28
#: Contaminated texts whose keys are broadcast to the rows; of more, rows and keys are joined by a shuffle.
BROADCAST = 200_000


def winnowed(words: Words, span: int = SPAN, k: int = K) -> np.ndarray:
    """Places of the k-word hashes kept: the last least one of each run that ``span`` words hold."""
    wide = span - k + 1
    starts = np.flatnonzero(words.left() >= span)
    if not len(starts):
        return starts
    seen = np.lib.stride_tricks.sliding_window_view(words.grams(k), wide)
    last = wide - 1 - np.argmin(seen[:, ::-1][starts], axis=1)
    return np.unique(starts + last)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _item_prints(span: int, k: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            at = winnowed(words, span, k)
            own, hashes, lengths = [words.owners()[at]], [words.grams(k)[at]], [np.zeros(len(at), np.int32)]
            counts = words.counts
            for n in range(1, span):
                short = np.flatnonzero(counts == n)
                own.append(short)
                hashes.append(words.grams(n)[words.first[short]])
                lengths.append(np.full(len(short), n, np.int32))
            yield pa.record_batch(
                [
                    batch.column("item").take(pa.array(np.concatenate(own))),
                    pa.array(_signed(np.concatenate(hashes))),
                    pa.array(np.concatenate(lengths)),
                ],
                ["item", "print", "short"],
            )

    return prints


def _doc_prints(bits: np.ndarray, address: int, shorts: list[int], span: int, k: int):
    """Each row's words, and of rows with a fingerprint in the table these and the text."""

    def there(hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - address)
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            owners, left = words.owners(), words.left()
            at = winnowed(words, span, k)
            hashes = words.grams(k)[at]
            kept = there(hashes)
            own, found = [owners[at[kept]]], [hashes[kept]]
            for n in shorts:
                at = np.flatnonzero(left >= n)
                hashes = words.grams(n)[at]
                kept = there(hashes)
                own.append(owners[at[kept]])
                found.append(hashes[kept])
            pairs = np.unique(np.stack([np.concatenate(own).astype(np.uint64), np.concatenate(found)], axis=1), axis=0)
            own, found = pairs[:, 0].astype(np.int64), pairs[:, 1]
            ends = np.searchsorted(own, np.arange(batch.num_rows + 1)).astype(np.int32)
            kept = pa.array(np.arange(batch.num_rows), mask=np.diff(ends) == 0)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(found)))
            text = batch.column("text").take(kept)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(words.counts), text, lists], ["doc_id", "n_words", "text", "prints"]
            )

    return prints


def _spans(span: int):
    """Word ranges of a text that lie in windows of an item, told by the words themselves."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text"), "item_text"):
            keys, items, ranges = [], [], []
            for i in range(batch.num_rows):
                doc, item = Words(batch.column("text").slice(i, 1)), Words(batch.column("item_text").slice(i, 1))
                n = min(span, len(item.start))
                if not n:
                    continue
                whole = lambda w, at: tuple(bytes(w.data[a:b]) for a, b in zip(w.start[at : at + n], w.end[at : at + n], strict=True))  # noqa: B023, E731
                windows = {whole(item, at) for at in range(len(item.start) - n + 1)}
                likely = np.flatnonzero((doc.left() >= n) & np.isin(doc.grams(n), item.grams(n)[: len(item.start) - n + 1]))
                at = np.array([x for x in likely if whole(doc, x) in windows], np.int64)
                if not len(at):
                    continue
                first = np.flatnonzero(np.diff(at, prepend=at[0] - n - 1) > n)
                last = np.append(first[1:] - 1, len(at) - 1)
                keys.append(batch.column("key")[i].as_py())
                items.append(batch.column("item")[i].as_py())
                ranges.append([{"a": int(a), "b": int(b) + n} for a, b in zip(at[first], at[last], strict=True)])
            yield pa.record_batch(
                [
                    pa.array(keys, pa.string()),
                    pa.array(items, pa.string()),
                    pa.array(ranges, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                ],
                ["key", "item", "ranges"],
            )

    return spans


def _covered(ranges: Column) -> Column:
    """How many places lie in any of the ranges (a, b)."""
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(ranges),
        start,
        lambda s, r: F.struct(
            F.greatest(s["to"], r["b"]).alias("to"), (s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["to"]))).alias("n")
        ),
        lambda s: s["n"],
    )


def _found(docs: DataFrame, items: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words, key) of every row, and (key, n_hit, ids) of distinct texts that have hits."""
    spark = docs.sparkSession
    items = (
        items.where(F.col("text").isNotNull())
        .groupBy(F.sha2("text", 256).alias("item"))
        .agg(F.first("text").alias("text"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    )
    prints = cut(items.select("item", "text").mapInArrow(_item_prints(span, k), "item string, print long, short int").distinct())
    # at least 32 bits for each fingerprint, and at most 2**MOST / 64 rows, however many items there are
    address = min(MOST, max(ADDRESS, 5 + prints.count().bit_length()))
    slot = F.shiftrightunsigned("print", 64 - address)
    filled = prints.groupBy((F.shiftright(slot, 6)).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - address}) & 63 as int))")).alias("b")
    )
    table = np.zeros(1 << (address - 6), np.int64)
    for row in filled.toLocalIterator():
        table[row.w] = row.b
    shorts = sorted(r.short for r in prints.select("short").where("short > 0").distinct().collect())
    bits = table.astype("<i8").view(np.uint8)

    key = docs.schema["doc_id"].dataType.simpleString()
    seen = docs.select("doc_id", "text").mapInArrow(
        _doc_prints(bits, address, shorts, span, k), f"doc_id {key}, n_words long, text string, prints array<long>"
    )
    seen = cut(seen.withColumn("key", F.sha2("text", 256)))
    texts = seen.where(F.col("key").isNotNull()).select("key", "text", "prints").dropDuplicates(["key"])
    pairs = texts.select("key", F.explode("prints").alias("print")).join(prints.select("print", "item"), "print").select("key", "item").distinct()
    sided = pairs.join(items.select("item", F.col("text").alias("item_text")), "item").join(texts.select("key", "text"), "key")
    ranges = sided.select("key", "item", "text", "item_text").mapInArrow(
        _spans(span), "key string, item string, ranges array<struct<a: long, b: long>>"
    )
    hits = (
        ranges.join(items.select("item", "ids"), "item")
        .groupBy("key")
        .agg(_covered(F.flatten(F.collect_list("ranges"))).alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    )
    return seen.select("doc_id", "n_words", "key"), hits


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """How much of each row of ``docs`` (doc_id, text) lies in windows of ``items`` (item_id, text).

    One row a row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
    A window is ``span`` neighbouring words of an item, or all of a shorter
    one. Null and empty texts have no words and hit nothing, on either side;
    repeated rows are reported each; items of one text count by their ids, an
    item without an id counts only in n_hit. Other columns are not read.
    """
    rows, hits = _found(docs, items, span, k)
    none = F.array().cast("array<string>")
    # rows without a fingerprint in common need no join, and share no key in it
    clean = rows.where(F.col("key").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("ids"))
    rest = rows.where(F.col("key").isNotNull()).join(hits, "key", "left")
    both = clean.unionByName(
        rest.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("ids", none).alias("ids"))
    )
    return both.select(
        "doc_id", "n_words", "n_hit",
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The rows of ``docs`` whose text shares no window with an item, with all their columns.

    Null and empty texts, and texts without words, share none and stay;
    repeated rows are decided alike; without items or documents nothing goes.
    """
    _, hits = _found(docs, items, span, k)
    bad = cut(hits.select("key"))
    if bad.count() <= BROADCAST:  # then the texts of the others are not shuffled
        bad = F.broadcast(bad)
    return docs.join(bad, F.sha2(docs["text"], 256) == bad["key"], "left_anti")
