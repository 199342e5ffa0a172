"""What several of the operators share: cutting lineage, and words as arrays.

Words are found and hashed for a whole Arrow batch at once: the UTF-8 bytes of
all its texts form one array, so no Python string is made per word.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked on in slices of about this many bytes, which bounds memory.
SLICE_BYTES = 1 << 20

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so lost executors cost no recomputation."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """How many tasks can run at once, for sizing work that is not sized by its data."""
    return max(2, spark.sparkContext.defaultParallelism)


# ------------------------------------------------------------------ bytes


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about ``limit`` bytes, one row at least."""
    for batch in batches:
        _, ends = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Remembered(dict):
    """Values found before. Once ``size`` are held they turn old, and go if not asked for again."""

    def __init__(self, size: int, find: Callable[[list[str]], list]) -> None:
        super().__init__()
        self.size, self.find, self.old = size, find, {}

    def learn(self, parts: set[str]) -> None:
        """From here to the next call, all of ``parts`` are in the dictionary."""
        new = parts - self.keys()
        if len(self) + len(new) > self.size:
            self.old, new = dict(self), parts
            self.clear()
        unknown = []
        for part in new:
            if (value := self.old.get(part)) is None:
                unknown.append(part)
            else:
                self[part] = value
        self.update(zip(unknown, self.find(unknown), strict=True))


# ------------------------------------------------------------------ words


def _word_table() -> np.ndarray:
    """Each byte as it counts in a word, A-Z as a-z; 0 where a byte ends a word."""
    kept = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        kept[low : high + 1] = np.arange(low, high + 1)
    kept[0x41:0x5B] = np.arange(0x61, 0x7B)
    return kept


WORD_BYTES = _word_table()


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((int(_PRIME), pow(int(_PRIME), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of a batch of texts.

    A word is a run of ASCII letters, digits and bytes above 0x7F, A-Z taken
    as a-z. ``start`` and ``end`` are byte places in ``data``, ``hash`` a
    64-bit value of each word, ``first[i]:first[i+1]`` the words of text i.
    """

    def __init__(self, column: pa.Array) -> None:
        raw, ends = utf8(column)
        self.data = data = WORD_BYTES[raw]
        inside = data != 0
        edge = np.empty(len(data) + 1, bool)
        if len(data):
            edge[0], edge[-1] = inside[0], inside[-1]
            edge[1:-1] = inside[1:] != inside[:-1]
        else:
            edge[:] = False
        marks = np.flatnonzero(edge)
        start, end = marks[0::2], marks[1::2]
        # a run that goes over the end of a text is two words
        within = ends[1:-1]
        over = np.unique(within[(within > 0) & (within < len(data))])
        over = over[inside[over] & inside[over - 1]] if len(over) else over
        if len(over):
            start, end = np.sort(np.concatenate([start, over])), np.sort(np.concatenate([end, over]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, ends).astype(np.int64)
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=total[1:])
        self.hash = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """For each word, the text it is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words from each word on; only of use where ``left`` is k at least."""
        n = len(self.hash)
        out = np.zeros(n, np.uint64)
        for j in range(min(k, n)):
            out *= _PRIME
            out[: n - j] += self.hash[j:]
        return mix(out + _U(k))
