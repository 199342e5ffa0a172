"""Exact top-k by inner product over norm-sorted blocks of rotated vectors.

Vectors are dealt into blocks by descending length. A rotation to the singular
vectors of the whole table, whose second moments Spark sums up, moves most of
every inner product into the first coordinates. Queries meet the blocks in
passes, each sixteen times as long as all before it, and after a pass every
query has a score that it must beat, and with it a length below which no
candidate can. Query blocks are sent only to lanes of blocks that are longer,
and a task meets a bounded number of blocks of either kind. There each pair is
bounded by the partial product over the first coordinates plus, by Cauchy and
Schwarz, the product of what the rest can add; only what may still win is
scored, in integers, and a task yields a query's k best at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tasks

#: Rows of a candidate block and of a query block; at 64 components these are 1 MB and 256 KB.
BLOCK, QUERIES = 2048, 512
#: Blocks of either kind that a task meets, and lanes of a pass at most (longer ones beyond).
TOGETHER, LANES = 8, 4096
#: How many times the blocks of all passes before it a pass has.
GROWTH = 16
#: Share of the squared length that the first, rotated coordinates hold.
HEAD = 0.7

VECTORS = "id long, v array<long>, length double"


def quantised(table: DataFrame, key: str, vector: str, scale: int = 64) -> DataFrame:
    """(id, v, length): each component x as floor(scale * x); rows with a null or non-finite component go."""
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    rows = table.where(fine).select(F.col(key).cast("long").alias("id"), whole.alias("v"))
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        x = _matrix(batch.column("v")).astype(np.float64)
        if len(x):
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.record_batch([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "m"])


def rotation(vectors: DataFrame) -> tuple[np.ndarray, int]:
    """Singular vectors of the table as columns, strongest first, and how many of them hold HEAD of it."""
    cells = vectors.select("v").mapInArrow(_moments, "i long, j long, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).collect()
    d = 1 + max(c.i for c in cells)
    moments = np.zeros((d, d))
    for c in cells:
        moments[c.i, c.j] = c.m
    u, s, _ = np.linalg.svd(moments)
    return u, min(d, 1 + int(np.searchsorted(np.cumsum(s) / max(s.sum(), 1e-300), HEAD)))


def _block(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column("id").to_numpy().astype("<i8"), _matrix(batch.column("v")).astype("<i8")]


def _row(names: list[str], *values: object) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x.tobytes()], pa.binary()) if isinstance(x, np.ndarray) else pa.array([x]) for x in values], names)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order they come as blocks: the partition, how many, the largest length, and columns as bytes."""
    part = TaskContext.get().partitionId()
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            yield _row(["part", "n", "longest", "ids", "v"], part, some.num_rows, float(some.column("length").to_numpy().max()), *_block(some))


def _queries(longest: np.ndarray):
    """Rows as blocks of queries: the length below which no candidate can win, and how many lanes of a pass are longer."""

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                reach = float(some.column("reach").to_numpy().min())
                lanes = int((longest >= reach).sum())
                if lanes:
                    more = [some.column("floor").to_numpy().astype("<f8"), some.column("floor_id").to_numpy().astype("<i8")]
                    yield _row(["q_part", "reach", "lanes", "q_ids", "q_v", "floor", "floor_id"], part, reach, lanes, *_block(some), *more)

    return queries


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of q and c, in floating point where that is exact."""
    most = np.sqrt(float((q.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) * float((c.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    if most < 2**24:  # every partial sum is an exact float
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row the ids and scores of its k highest, ties to smaller ids, its own id left out."""
    out = []
    for row, me in zip(scores, own, strict=True):
        keep = np.flatnonzero(ids != me)
        if len(keep) > k:
            floor = np.partition(row[keep], len(keep) - k)[len(keep) - k]
            keep = keep[row[keep] >= floor]
        order = keep[np.lexsort((ids[keep], -row[keep]))[:k]]
        out.append((ids[order], row[order]))
    return out


class _Asked:
    """A block of queries in a task, with the best candidates it has met there."""

    def __init__(self, row: dict, d: int, turn: np.ndarray, head: int, k: int) -> None:
        self.own, self.k, self.head, self.turn = np.frombuffer(row["q_ids"], "<i8"), k, head, turn
        self.q = np.frombuffer(row["q_v"], "<i8").reshape(-1, d)
        floor = np.frombuffer(row["floor"], "<f8")
        self.floor = np.where(np.abs(floor) >= 2**53, np.nextafter(floor, -np.inf), floor)  # it may have been rounded up
        self.floor_id = np.frombuffer(row["floor_id"], "<i8").copy()
        qf = self.q.astype(np.float64)
        self.length, self.turned = np.sqrt((qf**2).sum(axis=1)), qf @ turn
        self.rest = np.sqrt((self.turned[:, head:] ** 2).sum(axis=1))
        self.top: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def meet(self, row: dict) -> None:
        live = np.flatnonzero(self.length * row["longest"] * (1 + 1e-9) >= self.floor)
        if not len(live):
            return
        ids, head = np.frombuffer(row["ids"], "<i8"), self.head
        c = np.frombuffer(row["v"], "<i8").reshape(len(ids), -1)
        turned = c.astype(np.float64) @ self.turn
        rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        slack = 1e-6 * (1 + self.length[live, None] * row["longest"])
        bound = self.turned[live, :head] @ turned[:, :head].T + self.rest[live, None] * rest[None, :] + slack
        may = bound >= self.floor[live, None]
        live, cols = live[may.any(axis=1)], np.flatnonzero(may.any(axis=0))
        if not len(live):
            return
        for i, (vec, score) in zip(live, best(products(self.q[live], c[cols]), ids[cols], self.own[live], self.k), strict=True):
            wins = (score > self.floor[i]) | ((score == self.floor[i]) & (vec < self.floor_id[i]))
            vec, score = vec[wins], score[wins]
            if not len(vec):
                continue
            if i in self.top:
                vec, score = np.concatenate([vec, self.top[i][0]]), np.concatenate([score, self.top[i][1]])
                order = np.lexsort((vec, -score))[: self.k]
                vec, score = vec[order], score[order]
            self.top[i] = vec, score
            if len(vec) == self.k:
                last = float(score[-1])  # rounded down at most where that could matter
                last = np.nextafter(last, -np.inf) if abs(last) >= 2**53 else last
                if (last, -vec[-1]) > (self.floor[i], -self.floor_id[i]):
                    self.floor[i], self.floor_id[i] = last, vec[-1]

    def found(self) -> pa.RecordBatch:
        held = sorted(self.top)
        who = np.repeat(self.own[held], [len(self.top[i][0]) for i in held]) if held else np.zeros(0, np.int64)
        vec, score = (np.concatenate([np.zeros(0, np.int64), *[self.top[i][x] for i in held]]) for x in (0, 1))
        return pa.record_batch([pa.array(who), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])


def _meet(d: int, turn: np.ndarray, head: int, k: int):
    """The k best candidates of each query among the pairs of blocks of a task, as far as they can win."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[bytes, _Asked] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["q_ids"] not in asked:
                    asked[row["q_ids"]] = _Asked(row, d, turn, head, k)
                asked[row["q_ids"]].meet(row)
        for some in asked.values():
            yield some.found()

    return meet


def top_k(table: DataFrame, key: str, vector: str, asks: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """The k highest inner products of every row that ``asks``, over all other rows.

    (query_id, rank, vec_id, score), ties to the smaller vec_id; fewer where
    there are fewer rows. Vectors that are null or hold a null or non-finite
    component take no part, neither do rows without a key; vectors must have
    one dimension, and products that fit 64 bits. A key that repeats asks once,
    with the least of its vectors, and none of its rows is its candidate. An
    empty table gives no rows; other columns are not read.
    """
    nothing = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = cut(quantised(table.where(F.col(key).isNotNull()), key, vector, scale))
    asking = cut(rows.where(F.coalesce(asks, F.lit(False))).groupBy("id").agg(F.min(F.struct("v", "length")).alias("m")).select("id", "m.v", "m.length"))
    n, asked = rows.count(), asking.count()
    if not asked:
        return nothing
    turn, head = rotation(rows)
    # each partition is a range of lengths, the longest first
    held = rows.repartitionByRange(max(1, -(-n // BLOCK)), F.desc("length"), "id")
    blocks = cut(held.mapInArrow(_candidates, "part long, n long, longest double, ids binary, v binary"))
    parts = blocks.agg(F.max("part")).first()[0] + 1
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top, done, to = None, 0, 1
    while done < parts:
        # lanes of neighbouring blocks, so that a task meets a bounded number of them
        some = blocks.where((F.col("part") >= done) & (F.col("part") < to))
        lanes = min(LANES, -(-some.agg(F.sum("n")).first()[0] // (TOGETHER * BLOCK)), min(to, parts) - done)
        some = some.withColumn("lane", F.floor((F.col("part") - done) * lanes / (min(to, parts) - done)).cast("int"))
        longest = np.full(lanes, -np.inf)
        for lane in some.groupBy("lane").agg(F.max("longest").alias("longest")).collect():  # LANES rows at most
            longest[lane["lane"]] = lane["longest"] * (1 + 1e-9)
        salts = max(-(-asked // (TOGETHER * QUERIES)), min(-(-asked // 64), -(-2 * tasks(table.sparkSession) // lanes)))
        who = asking.withColumns({"floor": F.lit(float("-inf")), "floor_id": F.lit(0).cast("long")})
        if top is not None:
            last = top.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("s"), F.col("vec_id").alias("i"))
            who = asking.join(last, "id", "left").withColumns({"floor": F.coalesce(F.col("s").cast("double"), F.lit(float("-inf"))), "floor_id": F.coalesce("i", F.lit(0))})
        # by Cauchy and Schwarz no vector shorter than this can win; 0 where any may
        reach = F.when(F.col("floor") <= 0, 0.0).otherwise(F.when(F.col("length") > 0, F.col("floor") * (1 - 1e-9) / F.col("length")).otherwise(float("inf")))
        who = who.select("id", "v", "floor", "floor_id", reach.alias("reach")).repartitionByRange(max(salts, -(-asked // QUERIES)), "reach", "id")
        # written, as their numbers and reaches are asked for twice
        who = cut(who.mapInArrow(_queries(longest), "q_part long, reach double, lanes long, q_ids binary, q_v binary, floor binary, floor_id binary"))
        # a salt is a range of reaches: query blocks go to the lanes that are long enough for them, candidate blocks to the salts that reach as far
        last_part = who.agg(F.max("q_part")).first()[0]
        if last_part is None:
            done, to = to, to * (GROWTH + 1)
            continue
        salts = min(salts, last_part + 1)
        salted = who.withColumn("salt", F.floor(F.col("q_part") * salts / (last_part + 1)).cast("int"))
        nearest = np.full(salts, np.inf)
        for salt in salted.groupBy("salt").agg(F.min("reach").alias("reach")).collect():  # a row for each TOGETHER * QUERIES queries
            nearest[salt["salt"]] = salt["reach"]
        # a lane is sent to the salts up to the last one that it is long enough for
        nearest = np.minimum.accumulate(nearest[::-1])[::-1]
        met = [(lane, int(np.searchsorted(nearest, longest[lane], "right"))) for lane in range(lanes)]
        sides = table.sparkSession.createDataFrame([x for x in met if x[1]], "lane int, salts int")
        copies = salted.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes").cast("int") - 1))).drop("q_part", "lanes")
        sent = some.join(F.broadcast(sides), "lane").select("lane", "longest", "ids", "v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        pairs = sent.join(copies, ["lane", "salt"]).where(F.col("longest") * (1 + 1e-9) >= F.col("reach")).drop("lane", "salt", "reach")
        found = pairs.mapInArrow(_meet(d=len(turn), turn=turn, head=head, k=k), "query_id long, vec_id long, score long")
        if top is not None:
            found = found.unionByName(top.select("query_id", "vec_id", "score"))
        top = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        done, to = to, to * (GROWTH + 1)
    return top.select("query_id", "rank", "vec_id", "score")
