"""Places from ranges: ranks, wild ranges, mirrors, and whole sessions at once, with places that are known."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.plans import positions
from tonelake.plans.positions import Net

SAMPLE = 343.0 / 48000
# A rich geometry of five sources and six microphones.
SOURCES = np.array([[3.5, 1.0, 1.4], [3.5, 2.0, 1.0], [1.0, -1.0, 1.6], [1.0, 4.0, 0.9], [1.0, 1.5, 2.4]])
MICS = np.array([[0.0, 0.0, 1.0], [2.0, 0.0, 1.2], [0.0, 2.0, 0.9], [2.0, 2.0, 1.5], [1.0, 1.0, 0.8], [1.0, 3.0, 1.1]])


def one(at, d, s=0.002):
    at, d = np.asarray(at, float).reshape(-1, 3), np.asarray(d, float)
    n = max(3, len(d))
    block, used = np.zeros((1, n, 3)), np.zeros((1, n), bool)
    block[0, : len(d)], used[0, : len(d)] = at, True
    found = positions.placed(block, np.pad(d, (0, n - len(d)))[None], np.full((1, n), s), used, SAMPLE)
    return {k: v[0] for k, v in found.items()}


def ranges(at, x):
    return np.linalg.norm(np.asarray(at) - np.asarray(x), axis=1)


BOX = [(x, y, z) for x in (0, 1.0) for y in (0, 1.2) for z in (0.4, 1.6)]


def test_rank_is_told_at_a_millimetre():
    line = lambda off: np.array([[0.3 * k, off * (k % 2), 1.0] for k in range(6)])
    plane = lambda off: np.array([[k % 3, k // 3 % 3, off * (k % 2)] for k in range(8)], float)
    every = np.ones((1, 8), bool)
    for off in (0.0, 1e-5, 2e-4):
        assert positions.ranks(line(off)[None], every[:, :6])[0] == 1 and positions.ranks(plane(off)[None], every)[0] == 2
    assert positions.ranks(line(2e-3)[None], every[:, :6])[0] == 2 and positions.ranks(plane(2e-3)[None], every)[0] == 3
    x = np.array([0.4, 2.0, 1.7])
    for off in (0.0, 1e-5, 2e-4):
        assert one(line(off), ranges(line(off), x))["verdict"] == "degenerate_geometry"
    for off in (0.0, 1e-4, 3e-4):
        r = one(plane(off), ranges(plane(off), x))
        assert r["verdict"] == "solved" and r["flat"] and np.allclose(r["xyz"], x, atol=1e-3) and np.allclose(r["mirror"], x * [1, 1, -1], atol=5e-3)
    assert not one(BOX, ranges(BOX, x))["flat"]


def test_too_few_ranges():
    x = np.array([2.0, 0.5, 1.0])
    for n, verdict in ((0, "insufficient_ranges"), (1, "insufficient_ranges"), (2, "insufficient_ranges"), (3, "mirror_ambiguous"), (5, "solved")):
        r = one(BOX[:n], ranges(BOX[:n], x) if n else [])
        assert r["verdict"] == verdict and r["links"] == n and (np.isnan(r["xyz"]).all() or n == 5)
    assert one([(0.1 * k, 0, 1) for k in range(3)], [1, 1, 1])["verdict"] == "degenerate_geometry"


def test_a_wild_range_is_left_out_and_the_place_solved_again():
    rng = np.random.default_rng(4)
    for _ in range(40):
        x = rng.uniform(-1.5, 2.5, 3)
        d = ranges(BOX, x)
        wild = int(rng.integers(8))
        d[wild] += 0.5
        r = one(BOX, d)
        assert r["verdict"] == "solved" and np.allclose(r["xyz"], x, atol=1e-6) and (~r["kept"]).nonzero()[0].tolist() == [wild]
    d = ranges(BOX, [0.2, 3.0, 1.0]) + np.array([0.2, -0.2, 0.3, 0.1, -0.3, 0.2, -0.1, 0.4])
    assert one(BOX, d)["verdict"] in ("solve_residual_high", "solve_failed")
    four = [BOX[0], BOX[3], BOX[5], BOX[6]]
    r = one(four, ranges(four, [0.4, 0.6, 1.0]) + [0, 0, 0, 3.0])
    assert r["verdict"] in ("solve_failed", "solve_residual_high") and np.isnan(r["xyz"]).all()


def test_figures_of_a_place():
    rng = np.random.default_rng(5)
    x, s = np.array([1.5, 2.5, 0.3]), 0.003
    found = [one(BOX, ranges(BOX, x) + rng.normal(0, s, 8), s) for _ in range(400)]
    xyz = np.array([r["xyz"] for r in found])
    assert np.allclose(xyz.std(0), np.mean([r["sigma"] for r in found], axis=0), rtol=0.15)
    r = found[0]
    unit = (r["xyz"] - BOX) / ranges(BOX, r["xyz"])[:, None]
    assert abs(r["gdop"] - np.sqrt(np.trace(np.linalg.inv(unit.T @ unit)))) < 1e-9
    # left out in turn, by solving anew from scratch
    d = ranges(BOX, x) + rng.normal(0, s, 8)
    d[2] += 0.008
    r = one(BOX, d, s)
    away = []
    for k in range(8):
        rest = [i for i in range(8) if i != k]
        y = one(np.array(BOX)[rest], d[rest], s)["xyz"]
        away.append((np.linalg.norm(y - r["xyz"]), abs(d[k] - np.linalg.norm(y - BOX[k]))))
    assert abs(r["loo_shift"] - max(a for a, _ in away)) < 1e-6 and abs(r["loo_residual"] - max(b for _, b in away)) < 1e-6


def cells(spark, known_sources, known_mics, wild=(), lost=(), noise=0.0, session="s"):
    rng, rows = np.random.default_rng(9), []
    for i, p in enumerate(SOURCES):
        for j, q in enumerate(MICS):
            d = float(np.linalg.norm(p - q)) + dict(wild).get((i, j), 0.0) + rng.normal(0, noise)
            src = p.tolist() if i in known_sources else [None] * 3
            mic = q.tolist() if j in known_mics else [None] * 3
            rows.append((session, f"src-{i}", f"mic-{j}", *src, *mic, None if (i, j) in lost else d, 0.001))
    return spark.createDataFrame(rows, "session string, source_id string, microphone_id string, src_x double, src_y double, src_z double, mic_x double, mic_y double, mic_z double, distance_m double, sigma_m double")


def off(r):
    k = int(r.id[-1])
    return float(np.linalg.norm(np.subtract((r.x, r.y, r.z), (SOURCES if r.side == "source" else MICS)[k])))


@pytest.mark.parametrize(("sources", "mics"), [((0, 1, 2), (0, 1, 2, 4)), ((0, 1), (0, 1, 2, 4)), ((0,), (0, 2, 4)), ((), (0, 1, 2, 4)), ((3, 4), (1, 5))])
def test_all_points_of_a_session_at_once(spark, sources, mics):
    got = positions.joint_positions(cells(spark, sources, mics, noise=0.0005), ["session"], SAMPLE).collect()
    assert len(got) == 11 - len(sources) - len(mics)
    for r in got:
        assert r.verdict == "solved" and off(r) < 0.02 and 0 < r.sigma_x < 0.05 and not r.mirror_ambiguous


def test_half_of_the_microphones_unsurveyed(spark):
    """Three anchors are a plane: the session is found, or its mirror image."""
    got = positions.joint_positions(cells(spark, (), (0, 1, 2)), ["session"], SAMPLE).collect()
    a, b, c = MICS[:3]
    n = np.cross(b - a, c - a)
    n /= np.linalg.norm(n)
    at = np.array([(r.x, r.y, r.z) for r in got])
    true = np.array([(SOURCES if r.side == "source" else MICS)[int(r.id[-1])] for r in got])
    other = at - 2 * ((at - a) @ n)[:, None] * n
    assert len(got) == 8 and {(r.verdict, r.mirror_ambiguous) for r in got} == {("solved", True)}
    assert min(np.abs(at - true).max(), np.abs(other - true).max()) < 0.02


def test_wild_links_and_depleted_sessions(spark):
    got = positions.joint_positions(cells(spark, (0, 1), (0, 1, 2, 4), wild={(2, 3): 0.15, (4, 5): -0.4}.items()), ["session"], SAMPLE).collect()
    assert all(r.verdict == "solved" and off(r) < 1e-4 for r in got)
    assert {(r.id, n) for r in got for n in r.excluded} == {("src-2", "mic-3"), ("mic-3", "src-2"), ("src-4", "mic-5"), ("mic-5", "src-4")}
    # a source of four links, of which one is wild, takes the whole session with it
    spoilt = positions.joint_positions(cells(spark, (0, 1), (0, 1, 2, 4), wild={(2, 3): 0.15}.items(), lost=[(2, 4), (2, 5)]), ["session"], SAMPLE).collect()
    assert len(spoilt) == 5 and {(r.verdict, r.x) for r in spoilt} == {("solve_failed", None)}


def test_eligibility(spark):
    def issue(*a, **k):
        return positions.joint_eligibility(cells(spark, *a, **k), ["session"]).first().issue

    assert issue((0, 1), (0, 1, 2, 4)) is None
    assert issue((0, 1, 2, 3, 4), (0, 1)) == "one_sided" and issue((0,), range(6)) == "one_sided"
    assert issue((0,), (1,)) == "few_anchors" and issue((), (0, 1, 3)) is None
    assert issue((0, 1), (0, 1, 2, 4), lost=[(2, 3), (2, 4), (2, 5)]) == "few_links"
    assert issue((), (0, 1, 2), lost=[(i, j) for i in range(5) for j in (4, 5)][:8]) == "few_ranges"
    bent = cells(spark, (0, 1), (0, 1)).withColumn("src_z", F.when(F.col("source_id") == "src-0", float("nan")).otherwise(F.col("src_z")))
    assert positions.joint_eligibility(bent, ["session"]).first().issue == "anchor_not_finite"
    line = cells(spark, (), (0, 1, 2)).withColumns({a: F.when(F.col("mic_x").isNotNull(), v) for a, v in (("mic_x", F.substring("microphone_id", 5, 1).cast("double")), ("mic_y", F.lit(0.0)), ("mic_z", F.lit(1.0)))})
    assert positions.joint_eligibility(line, ["session"]).first().issue == "collinear_anchors"


def test_places_of_mixed_sessions(spark):
    both = cells(spark, (0, 1), (0, 1, 2, 4)).unionByName(cells(spark, range(5), (0, 1, 2, 4), session="t")).unionByName(cells(spark, (), (0, 1), session="u"))
    both = both.unionByName(both)
    got = {(r.session, r.side, r.id): r for r in positions.session_places(both, ["session"], SAMPLE).collect()}
    assert len(got) == 33 and {r.method for k, r in got.items() if k[0] == "s"} == {"joint", "direct", "survey"}
    assert all(off(r) < 1e-4 for k, r in got.items() if k[0] != "u")
    assert got["s", "source", "src-0"].method == "direct" and got["s", "microphone", "mic-3"].method == "joint" and got["t", "microphone", "mic-3"].method == "direct"
    assert {r.verdict for k, r in got.items() if k[0] == "u"} == {"insufficient_ranges", "surveyed_anchor"}
    assert positions.session_places(both.limit(0), ["session"], SAMPLE).count() == 0


def test_large_sessions_settle_soon():
    rng = np.random.default_rng(3)
    p, q = rng.uniform(0, 6, (32, 3)), rng.uniform(0, 6, (32, 3))
    i, j = (a.ravel() for a in np.meshgrid(range(32), range(32), indexing="ij"))
    at = np.concatenate([p, q])
    fixed = np.zeros(64, bool)
    fixed[[0, 1, 2, 3, 40]] = True
    d = np.linalg.norm(p[i] - q[j], axis=1) + rng.normal(0, 0.001, len(i))
    d[rng.choice(len(d), 20, replace=False)] += 0.5
    net = Net(32, np.where(fixed[:, None], at, 0), fixed, i, j, d, np.full(len(d), 0.001))
    began = time.time()
    assert net.solve() is None and time.time() - began < 60
    assert np.abs(net.at - at).max() < 0.02 and (~net.kept).sum() >= 20
