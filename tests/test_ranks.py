"""Values at exact ranks, against sorting."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tonelake.operators import ranks, sequences


def test_ranks_are_those_of_sorting(spark):
    rng = np.random.default_rng(6)
    streams = {
        "wide": np.concatenate([rng.normal(0, 10.0 ** rng.integers(-300, 300, 900)), [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7e308]]),
        "tied": rng.choice([1.0, 1.0, 1.0 + 2**-52, -2.0, 0.0], 1001), "one": np.array([7.5]), "same": np.full(50, -3.25), "near": 1 + np.arange(3000) * 2**-52,
    }
    rows = [(k, float(v)) for k, x in streams.items() for v in x] + [("tied", None), ("tied", float("nan")), ("none", None), (None, 4.0)]
    at = {"least": lambda n: F.lit(0), "third": lambda n: F.floor(n / 3), "mid": lambda n: F.floor(n / 2), "most": lambda n: n - 1, "beyond": lambda n: n}
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in ranks.order_statistics(df.where("k is not null"), ["k"], "v", at).collect()}
    assert set(got) == set(streams)
    for k, x in streams.items():
        s, n = np.sort(x), len(x)
        assert (got[k].n, got[k].least, got[k].third, got[k].mid, got[k].most, got[k].beyond) == (n, s[0], s[n // 3], s[n // 2], s[-1], None), k
    for r in ranks.exact_median(df.where("k in ('wide', 'tied', 'one', 'near')"), ["k"], "v").collect():
        assert r.median == np.median(streams[r.k])
    assert ranks.order_statistics(df.limit(0), ["k"], "v", at).count() == 0


def picked(e, ahead):
    """One step after another, as the rule reads."""
    half = max(3, len(e) // 2)
    s = e[:half]
    if not s.max() > 1e-10:
        return None
    o = np.sort(s)
    floor = max(12 * max(o[len(o) // 2], 1e-10), 2 * o[min(int(len(o) * 0.9), len(o) - 1)], 0.08 * s.max())
    for i in range(1, half - 1):
        if s[i] >= floor:
            end = min(i + ahead, half - 1)
            p = i + int(np.argmax(s[i : end + 1]))
            if 0 < p < half - 1 and abs(d := 2 * (s[p - 1] - 2 * s[p] + s[p + 1])) > 1e-12:
                return i, p, p + (s[p - 1] - s[p + 1]) / d
            return i, p, float(p)
    return None


def test_first_peaks_step_by_step(spark):
    rng = np.random.default_rng(2)
    takes = {}
    for k in range(60):
        x = rng.normal(0, 0.01, int(rng.integers(8, 400)))
        for _ in range(int(rng.integers(0, 4))):
            x[int(rng.integers(len(x)))] += rng.uniform(0.2, 1.5)
        takes[k] = x
    takes[100], takes[101] = np.zeros(50), np.concatenate([[5.0], np.zeros(40)])
    df = spark.createDataFrame([(k, i, float(v)) for k, x in takes.items() for i, v in enumerate(x)], "k int, i int, x double")
    got = {r.k: (r.onset, r.peak, r.refined) for r in sequences.first_peak(df, ["k"], "i", "x", 12).collect()}
    want = {k: w for k, x in takes.items() if (w := picked(np.abs(x), 12))}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and len(want) > 20
    assert all(abs(got[k][2] - want[k][2]) < 1e-9 for k in want)
