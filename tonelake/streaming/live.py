"""Operators over unbounded streams of (channel, idx, x).

Positions are sample numbers, not times, so nothing is late: a sample that is
missing is a gap for good. State is bounded: a meter is five numbers, a list of
gaps ends at ``MOST_GAPS`` entries and a count of the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonelake.functions.levels import is_finite

MOST_GAPS = 128
CLIP = 0.999


FRAME_COLUMNS = ["channel", "frame", "samples", "peak", "rms", "clipped", "late"]


def frames(samples: DataFrame, size: int, least: int | None = None) -> DataFrame:
    """Peak, RMS and full-scale count of each frame of ``size`` sample numbers, once it is past; append mode.

    A channel's samples come in order between batches, so its state is the one
    frame that is open; what a batch brings is summed up part by part. ``late``
    counts the samples so far whose frame was past already, which change
    nothing. A frame that holds fewer than ``least`` samples (all of them,
    unless said otherwise) is none, and neither is one that never closes.
    """
    least = size if least is None else least

    def framed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, late, held = None, 0, {}
        if state.exists:
            first, late, *open_sums = state.get
            held[first] = open_sums
        for rows in batches:
            x, frame = rows["x"].to_numpy(np.float64), rows["idx"].to_numpy(np.int64) // size
            if first is not None:
                late += int((frame < first).sum())
                x, frame = x[frame >= first], frame[frame >= first]
            order = np.argsort(frame, kind="stable")
            x, frame = x[order], frame[order]
            at = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]]) if len(frame) else np.zeros(0, int)
            for lo, hi in zip(at, np.r_[at[1:], len(frame)], strict=True):
                n, peak, power, clipped = held.get(int(frame[lo]), (0, 0.0, 0.0, 0))
                part = np.abs(x[lo:hi])
                held[int(frame[lo])] = [n + len(part), max(peak, float(part.max())), power + float((part * part).sum()), clipped + int((part >= 1).sum())]
        if not held:
            return
        last = max(held)
        state.update((last, late, *held[last]))
        past = [(key[0], f, n, peak, float(np.sqrt(power / n)), clipped, late) for f, (n, peak, power, clipped) in sorted(held.items()) if f < last and n >= least]
        yield pd.DataFrame(past, columns=FRAME_COLUMNS)

    return samples.groupBy("channel").applyInPandasWithState(
        framed, "channel string, frame long, samples long, peak double, rms double, clipped long, late long",
        "frame long, late long, n long, peak double, power double, clipped long", "append", GroupStateTimeout.NoTimeout,
    )


def event_windows(events: DataFrame, time: str, key: str, length: str, late: str) -> DataFrame:
    """Rows of each key in windows of event time, final once the watermark has passed them."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counted = timed.groupBy(F.window("_t", length), key).agg(F.count("*").alias("rows"))
    return counted.select(F.col("window.start").alias("start"), key, "rows")


def _meter(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, peak, power, clipped, last = state.get if state.exists else (0, 0.0, 0.0, 0, -1)
    for rows in batches:
        x = rows["x"].to_numpy(np.float64)
        ok = np.isfinite(x)
        size = np.abs(x[ok])
        seen += len(x)
        peak = max(peak, float(size.max(initial=0.0)))
        power += float((size * size).sum())
        clipped += int((~ok).sum() + (size >= CLIP).sum())
        last = max(last, int(rows["idx"].max()))
    state.update((seen, peak, power, clipped, last))
    yield pd.DataFrame([(key[0], seen, peak, float(np.sqrt(power / seen)) if seen else None, clipped, last)], columns=METER_COLUMNS)


METER_COLUMNS = ["channel", "samples", "peak_hold", "rms", "clipped", "last_idx"]


def meters(samples: DataFrame) -> DataFrame:
    """The state of each channel's meter after every batch in which it had samples."""
    return samples.groupBy("channel").applyInPandasWithState(
        _meter, "channel string, samples long, peak_hold double, rms double, clipped long, last_idx long",
        "seen long, peak double, power double, clipped long, last long", "update", GroupStateTimeout.NoTimeout,
    )


def _gaps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, listed, omitted, missing = state.get if state.exists else (None, 0, 0, 0)
    runs = np.zeros((0, 2), np.int64) if last is None else np.array([[last, last + 1]])
    for rows in batches:  # kept as runs of numbers, half open, of which there are as few as gaps
        idx = np.unique(rows["idx"].to_numpy(np.int64))
        cut = np.flatnonzero(np.diff(idx) > 1)
        own = np.stack([idx[np.r_[0, cut + 1]], idx[np.r_[cut, len(idx) - 1]] + 1], axis=1) if len(idx) else runs[:0]
        runs = np.concatenate([runs, own if last is None else np.maximum(own, last)[own[:, 1] > last]])
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        reach = np.maximum.accumulate(runs[:, 1]) if len(runs) else runs[:, 1]
        new = np.r_[True, runs[1:, 0] > reach[:-1]] if len(runs) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        runs = np.stack([runs[at, 0], reach[np.r_[at[1:] - 1, len(runs) - 1]]], axis=1) if len(at) else runs
    if not len(runs):
        return
    start, end = runs[:-1, 1], runs[1:, 0]
    room = max(0, MOST_GAPS - listed)
    listed, omitted = listed + min(room, len(start)), omitted + max(0, len(start) - room)
    missing += int((end - start).sum())
    state.update((int(runs[-1, 1]) - 1, listed, omitted, missing))
    yield pd.DataFrame({"channel": key[0], "start_frame": start[:room], "end_frame": end[:room], "omitted": omitted})


def gaps(samples: DataFrame) -> DataFrame:
    """The gaps of each channel as they come, the first MOST_GAPS of them, with the number left out so far.

    Samples of one channel come in order between batches.
    """
    return samples.groupBy("channel").applyInPandasWithState(
        _gaps, "channel string, start_frame long, end_frame long, omitted long",
        "last long, listed int, omitted long, missing long", "append", GroupStateTimeout.NoTimeout,
    )


def sound(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples that are whole, and those to be put aside: no channel, no number, or not finite."""
    ok = F.col("channel").isNotNull() & (F.col("idx") >= 0) & is_finite(F.col("x"))
    return samples.where(F.coalesce(ok, F.lit(False))), samples.where(~F.coalesce(ok, F.lit(False)))


def quarantining(kept: Callable[[DataFrame, int], None], aside: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: whole samples go one way and the others another, from one reading of the batch."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            good, bad = sound(batch)
            kept(good, number)
            aside(bad, number)
        finally:
            batch.unpersist()

    return each


def ready(samples: DataFrame, rate: int) -> DataFrame:
    """(channel, frames, ready): whether each clock has come a quarter of a second far."""
    return samples.groupBy("channel").agg(F.count("*").alias("frames")).withColumn("ready", F.col("frames") >= rate // 4)
