"""Language identification by a convolutional network over bytes.

Filters of several widths slide over fixed-length windows of UTF-8 bytes, each
filter keeps its largest response in a window, and a softmax turns these into
languages. Bytes are one-hot, so a filter is a table of one row per byte and
place, and a convolution is a sum of table rows. The network is trained on the
driver, in numpy, on a bounded sample; whole texts are predicted in tasks,
window by window, and a text's languages are the mean of its windows'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Labelled rows the network is fitted on, per language, and characters taken of each; of more languages, fewer rows each.
PER_LANGUAGE, CHARACTERS, LANGUAGES = 1000, 600, 100
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LIKELY = re.compile(r"[^\W\d_]").search


def has_letter(text: str | None) -> bool:
    """Whether a character of a Unicode letter category occurs; signs like ½ or ① are none."""
    return bool(text) and _LIKELY(text) is not None and any(map(str.isalpha, text))


def windows(data: np.ndarray, ends: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of every text in windows of ``size`` bytes, the last one filled with zeros.

    Also the text each window is of, and how many of its bytes are the text's.
    """
    lengths = np.diff(ends)
    many = np.maximum(1, -(-lengths // size))
    owner = np.repeat(np.arange(len(lengths)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    start = ends[owner] + nth * size
    held = np.clip(ends[owner + 1] - start, 0, size)
    padded = np.concatenate([_LOWER[data], np.zeros(size, np.uint8)])
    cut = padded[np.minimum(start, len(data))[:, None] + np.arange(size)]
    cut[np.arange(size) >= held[:, None]] = 0
    return cut, owner, held


@dataclass
class ByteNet:
    """Tables (width, place, byte, filter), their biases, the dense layer, and the languages."""

    tables: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray
    languages: list[str]

    def pairs(self) -> list[list[np.ndarray]]:
        """Rows for pairs of bytes, so a filter takes two steps at once; made in the task, not sent to it."""
        return [
            [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(t) - 1, 2)] for t in self.tables
        ]

    def probabilities(self, cut: np.ndarray, step: int = 64) -> np.ndarray:
        if not hasattr(self, "_pairs"):
            self._pairs = self.pairs()
        out = [np.zeros((0, len(self.languages)))]
        for i in range(0, len(cut), step):
            hidden = np.maximum(0, np.concatenate(self._responses(cut[i : i + step]), axis=1))
            out.append(_softmax(hidden @ self.dense + self.offset))
        return np.concatenate(out)

    def _responses(self, cut: np.ndarray) -> list[np.ndarray]:
        """The largest response of each filter in each window."""
        pair = cut[:, :-1].astype(np.int32) * 256 + cut[:, 1:]
        out = []
        for table, bias, pairs in zip(self.tables, self.bias, self._pairs, strict=True):
            n = cut.shape[1] - len(table) + 1
            z = np.take(pairs[0], pair[:, :n], axis=0)
            for k, rows in enumerate(pairs[1:], 1):
                z += np.take(rows, pair[:, 2 * k : 2 * k + n], axis=0)
            if len(table) % 2:
                z += np.take(table[-1], cut[:, len(table) - 1 : len(table) - 1 + n], axis=0)
            out.append(z.max(axis=1) + bias)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 7) -> ByteNet:
    """A network trained by stochastic gradients (Adagrad) on windows of ``texts``."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    raw, ends = utf8(pa.array(texts, pa.string()))
    cut, owner, held = windows(raw, ends)
    kept = held >= min(32, held.max(initial=1))
    number = {x: k for k, x in enumerate(names)}
    cut, y = cut[kept], np.array([number[x] for x in langs])[owner[kept]]
    net = ByteNet(
        [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
        names,
    )
    params = [*net.tables, *net.bias, net.dense, net.offset]
    past = [np.full_like(p, 1e-6) for p in params]
    share = np.bincount(y, minlength=len(names)) / max(1, len(y))
    weight = (1 / np.maximum(share, 1e-9) / len(names)).astype(np.float32)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(cut)), max(1, len(cut) // batch)):
            x, t = cut[rows], y[rows]
            found = _direct(net, x)
            pre = np.concatenate([f[0] for f in found], axis=1)
            hidden = np.maximum(0, pre)
            p = _softmax(hidden @ net.dense + net.offset)
            p[np.arange(len(t)), t] -= 1
            p *= weight[t][:, None] / len(t)
            back = (p @ net.dense.T) * (pre > 0)
            grads = []
            for k, table in enumerate(net.tables):
                g, at = np.zeros_like(table), found[k][1]
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(table)):
                    byte = np.take_along_axis(x, at + j, axis=1)
                    np.add.at(g[j], (byte, np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            grads += [hidden.T @ p, p.sum(axis=0)]
            for param, g, h in zip(params, grads, past, strict=True):
                h += g * g
                param -= rate * g / np.sqrt(h)
    return net


def _direct(net: ByteNet, cut: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Responses and their places from the tables as they are while they change."""
    out = []
    for table, bias in zip(net.tables, net.bias, strict=True):
        n = cut.shape[1] - len(table) + 1
        z = sum(np.take(t, cut[:, j : j + n], axis=0) for j, t in enumerate(table))
        at = z.argmax(axis=1)
        out.append((np.take_along_axis(z, at[:, None, :], 1)[:, 0] + bias, at))
    return out


def sample(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Pieces of labelled texts from all over ``docs``: about ``per_language`` rows of each language, one at least.

    Of more than ``LANGUAGES`` languages there are as many rows in all as of so many.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20))
    counts = rows.groupBy("lang").agg(F.count("*").alias("count"), F.min(draw).alias("least")).collect()
    if not counts:
        return [], []
    per_language = max(1, min(per_language, per_language * LANGUAGES // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"]), r["least"]) for r in counts], "lang string, share double, least long")
    # a share of 1/2**20 is one row of a million
    chosen = rows.join(F.broadcast(shares), "lang").where((draw < F.col("share") * (1 << 20)) | (draw == F.col("least")))
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - CHARACTERS)) + 1
    found = chosen.select("lang", F.substring(F.col("text"), at, F.lit(CHARACTERS)).alias("text"))
    pairs = sorted((r.lang, r.text) for r in found.limit(2 * per_language * len(counts)).collect())
    return [t for _, t in pairs], [lang for lang, _ in pairs]


def trained(docs: DataFrame, usable: Column, **how: int) -> ByteNet | None:
    texts, langs = sample(docs, usable)
    return fit(texts, langs, **how) if texts else None


def _predicted(net: ByteNet | None, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text of a batch."""
    texts = batch.column("text").to_pylist()
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if net is None or not texts:
        return names, scores
    if len(texts) > 1 and len(texts) * len(net.languages) > 1 << 22:  # many languages: fewer texts at once
        half = len(texts) // 2
        parts = [_predicted(net, batch.slice(0, half)), _predicted(net, batch.slice(half))]
        return parts[0][0] + parts[1][0], np.concatenate([parts[0][1], parts[1][1]])
    raw, ends = utf8(batch.column("text"))
    total = np.zeros((len(texts), len(net.languages)))
    cut, owner, held = windows(raw, ends)
    held = np.maximum(1, held)
    for i in range(0, len(cut), 1024):
        np.add.at(total, owner[i : i + 1024], net.probabilities(cut[i : i + 1024]) * held[i : i + 1024, None])
    total /= np.bincount(owner, held, len(texts))[:, None]
    best = total.argmax(axis=1)
    for i, text in enumerate(texts):
        if has_letter(text):
            names[i], scores[i] = net.languages[best[i]], min(1.0, total[i, best[i]])
    return names, scores


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs`` (doc_id, text), from the text alone.

    ``und`` with score 0 where the text is null or has no letter, and
    everywhere if there was nothing to learn from. Repeated rows are predicted
    each; an empty table gives an empty one; other columns are not read.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, scores = _predicted(net, batch)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(predicted, f"doc_id {key}, lang_pred string, score double")


def identified(docs: DataFrame, net: ByteNet | None, least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, with all columns, whose language is known with a score of ``least`` or more.

    If there was nothing to learn from, all that have a letter. Null texts and
    those without a letter go; repeated rows are decided alike, each by itself;
    an empty table gives an empty one; columns other than text are carried
    along unread.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if net is None:
                yield batch.filter(pa.array([has_letter(x) for x in batch.column("text").to_pylist()], pa.bool_()))
                continue
            names, scores = _predicted(net, batch)
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
