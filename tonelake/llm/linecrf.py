"""Document quality from a linear-chain conditional random field over lines.

Each line of a text is good or bad. A line's score is linear in features of
itself and of the lines before and after it, and neighbouring labels have
transition scores. Forward-backward gives each line's probability of being
good; their mean, weighted by the lines' lengths, is the document's, and a
logistic curve turns it into the score.

Only documents are labelled. Lines of good documents are good; those of bad
ones start as bad, and between rounds of training the ones that look like
lines of good documents are taken back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, utf8

#: Labelled documents the model is fitted on, of each label, and characters of the longest of them.
PER_LABEL, LONGEST = 1500, 20_000

_ROUND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b".,;:'\"-?()"), 1):
    _ROUND[list(_bytes)] = _k
_ROUND[0x80:] = 2
_ROUND[(_ROUND == 0) & (np.arange(256) > 32)] = 6
FEATURES = 14


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, the lines' lengths in bytes, and each text's first line (and the end)."""
    raw, ends = utf8(column)
    n = len(ends) - 1
    breaks = np.flatnonzero(raw == 10)
    # a text of k line feeds has k + 1 lines; an empty one has an empty line
    owner = np.searchsorted(ends, breaks, "right") - 1
    first = np.arange(n + 1) + np.searchsorted(breaks, ends)
    total = int(first[-1])
    start, end = np.zeros(total, np.int64), np.zeros(total, np.int64)
    inner = np.arange(len(breaks)) + owner  # the line that each feed ends
    end[inner], end[first[1:] - 1] = breaks, ends[1:]
    start[inner + 1], start[first[:-1]] = breaks + 1, ends[:-1]
    length = end - start
    kinds = _ROUND[raw]
    safe = np.maximum(length, 1).astype(np.float64)
    share, upto = [np.zeros(0)], np.zeros(len(raw) + 1, np.int64)
    for k in range(1, 7):
        np.cumsum(kinds == k, out=upto[1:])
        share.append((upto[end] - upto[start]) / safe)

    words = Words(column)
    line = np.searchsorted(start, words.start, "right") - 1
    many = np.bincount(line, minlength=total)[:total].astype(np.float64)
    again = np.zeros(total)
    if len(line):
        same = (line[1:] == line[:-1]) & (words.hash[1:] == words.hash[:-1])
        again += np.bincount(line[1:][same], minlength=total)
    order = np.lexsort((words.hash, line))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (line[order][1:] != line[order][:-1]) | (words.hash[order][1:] != words.hash[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=total)
    short = np.bincount(line[(words.end - words.start) <= 3], minlength=total)
    # lines that say the same in one text
    said = np.zeros(total, np.uint64)
    np.add.at(said, line, words.hash * (2 * (np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many.astype(int))) + 1).astype(np.uint64))
    text = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((said, text))
    twin = np.zeros(total, bool)
    pair = (text[order][1:] == text[order][:-1]) & (said[order][1:] == said[order][:-1]) & (many[order][1:] > 2)
    twin[order[1:][pair]] = True
    twin[order[:-1][pair]] = True
    w = np.maximum(many, 1)
    x = np.stack(
        [
            np.log1p(length) / 8, length == 0, np.minimum(many, 3) / 3,
            share[1] / np.maximum(share[1] + share[2], 1e-9), share[2], share[3], share[4], share[5], share[6],
            again / w, distinct / w, short / w, np.minimum((words_bytes(words, line, total) / w) / 12, 2), twin,
        ],
        axis=1,
    )
    return x, length, first


def words_bytes(words: Words, line: np.ndarray, total: int) -> np.ndarray:
    return np.bincount(line, words.end - words.start, total)[:total]


def neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line with those of the lines before and after it in its text, and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def forward_backward(odds: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each line, and the expected moves (from, to) over all texts.

    ``odds`` are the lines' scores for good, that for bad being 0. All texts
    take each step together, the longest first, so a step is a few array
    operations however many texts there are.
    """
    n = len(odds)
    emit = np.stack([np.zeros(n), odds], axis=1)
    emit = np.exp(emit - emit.max(axis=1, keepdims=True))
    go = np.exp(moves - moves.max())
    count = np.diff(first)
    rank = np.argsort(-count, kind="stable")
    begin, count = first[:-1][rank], count[rank]
    steps = int(count[0]) if len(count) else 0
    alive = np.searchsorted(-count, -np.arange(1, steps + 1), "right")  # texts with so many lines at least
    ahead, back = np.empty((n, 2)), np.ones((n, 2))
    for t in range(steps):
        at = begin[: alive[t]] + t
        a = emit[at] if t == 0 else (ahead[at - 1] @ go) * emit[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        b = (emit[at + 1] * back[at + 1]) @ go.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(axis=1)
    inner = np.ones(n, bool)
    inner[first[1:] - 1] = False
    at = np.flatnonzero(inner)
    pair = ahead[at][:, :, None] * go[None] * (emit[at + 1] * back[at + 1])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return good, pair.sum(axis=0)


@dataclass
class LineField:
    """Weights of the features, of the moves, and the curve from mean marginal to score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]

    def marginals(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, length, first = lines(column)
        good, _ = forward_backward(neighbours((x - self.mean) / self.scale, first) @ self.weights, self.moves, first)
        return good, length, first

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        return _curve(document(*self.marginals(column)), *self.curve)


def document(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean of the lines' marginals by their lengths; the empty line of an empty text has a length of 1."""
    weight = np.maximum(length, 1)
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _curve(g: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * g + offset, -30, 30)))


def fit(texts: list[str], good: list[int], weight: dict[int, float], rounds: int = 3, steps: int = 80, rate: float = 0.15, decay: float = 1e-3) -> LineField:
    """A field fitted by gradient ascent (Adam) on the lines' conditional likelihood; ``weight`` is of each label's documents."""
    parts = [lines(x.column(0)) for x in slices([pa.record_batch([pa.array(texts, pa.string())], ["text"])], "text")]
    x, length = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    first = np.append(0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts])))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = neighbours((x - mean) / scale, first)
    label = np.array(good)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    y = label[text].astype(np.float64)
    inner = np.ones(len(x), bool)
    inner[first[1:] - 1] = False
    at = np.flatnonzero(inner)
    w, moves = np.zeros(z.shape[1]), np.zeros((2, 2))
    for turn in range(rounds):
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at].astype(int), y[at + 1].astype(int)), 1)
        m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
        for step in range(1, steps + 1):
            p, pairs = forward_backward(z @ w, moves, first)
            g = np.concatenate([z.T @ (y - p), (seen - pairs).ravel()]) / len(x) - decay * np.concatenate([w, moves.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, moves = w + move[:-4], moves + move[-4:].reshape(2, 2)
        p, _ = forward_backward(z @ w, moves, first)
        if turn < rounds - 1:  # the surest half of what looks good in bad documents goes back, but never all of one
            y = label[text].astype(np.float64)
            worst = np.minimum.reduceat(p, first[:-1])
            y[(y == 0) & (p > 0.6) & (p > worst[text])] = 1
    g = document(p, length, first)
    own = np.array([weight[int(k)] for k in label])
    a, b = 0.0, 0.0
    d = np.stack([g, np.ones(len(g))], axis=1)
    for _ in range(50):  # Newton's steps for the curve, with a weak pull to 0
        q = _curve(g, a, b)
        grad = d.T @ (own * (label - q)) - 1e-2 * np.array([a, b])
        hess = (d * (own * q * (1 - q))[:, None]).T @ d + 1e-2 * np.eye(2)
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(hess, grad), -5, 5)
    return LineField(mean, scale, w, moves, (float(a), float(b)))


def sample(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = PER_LABEL) -> tuple[list[str], list[int], dict[int, float]]:
    """Texts of about ``per_label`` labelled documents of each quality, and what each stands for."""
    known = labels.where(usable & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return [], [], {}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    share = {k: min(1.0, per_label / n) for k, n in counts.items()}
    chosen = known.where(draw < F.when(F.col("quality") == 1, share[1]).otherwise(share[0])).limit(4 * per_label)
    short = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= LONGEST))
    # at most 4 * per_label ids and labels
    rows = short.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").limit(8 * per_label).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.text))
    return [r.text for r in rows], [r.quality for r in rows], {k: 1 / share[k] for k in share}


def trained(docs: DataFrame, labels: DataFrame, usable: Column, **how: int) -> LineField | None:
    """A field, or None where there are no documents of both labels to learn from."""
    texts, good, weight = sample(docs, labels, usable)
    return fit(texts, good, weight, **how) if len(set(good)) == 2 else None


def _scored(field: LineField | None, batch: pa.RecordBatch) -> np.ndarray:
    return np.full(batch.num_rows, 0.5) if field is None else field.scores(batch.column("text"))


def score_quality(docs: DataFrame, field: LineField | None) -> DataFrame:
    """(doc_id, score, predicted) of each row of ``docs`` (doc_id, text), from the text alone.

    Null texts count as empty, and empty ones are scored as one empty line.
    Without anything learnt every score is 0.5. Repeated rows are scored each;
    an empty table gives an empty one; other columns are not read.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = _scored(field, batch)
            yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {key}, score double, predicted int")


def good_quality(docs: DataFrame, field: LineField | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is ``least`` or more.

    Null and empty texts are scored as one empty line and stay or go by that;
    without anything learnt every row scores 0.5. Repeated rows are decided
    alike; an empty table gives an empty one; other columns are not read.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(_scored(field, batch) >= least))

    return docs.mapInArrow(kept, docs.schema)
