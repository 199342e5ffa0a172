"""From ranges to places: single points from surveyed ones, and all unsurveyed points of a session at once.

A point has as many ranges as there are points on the other side of its
session, a few dozen at most by its plan. So the ranges of a point are one
array, and a task solves a batch of points together; a session whose points
depend on one another is one group. What an array of surveyed points can tell
is one rule everywhere: singular values of its centred places over 1 mm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType

from tonelake.functions.levels import is_finite

# Fixed values.
FLAT_M, LEAST_RANGES, LEAST_ANCHORS = 1e-3, 4, 3
HUBER, BEYOND, TUKEY = 3.0, 3.5, (30.0, 10.0, 4.685)
ROUNDS, STEP_M, DAMPING = 100, 1e-9, 1e-9
#: What the rounding of doubles may add to a range, as a part of the largest number it is worked out from.
ROUNDING = 1e-14
#: Points that are solved together.
BATCH = 256
#: Up to so many ranges, a wild one may well pass for a sound one, and each is left out in turn.
SPARSE = 12
#: Steps towards a place that is only begun from.
SEED_ROUNDS = 16


# ------------------------------------------------------------------ what an array can tell


def _axes(at: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each array of points: its middle, the points about it, and their singular vectors and values."""
    mid = (at * used[..., None]).sum(1) / np.maximum(used.sum(1), 1)[:, None]
    about = np.where(used[..., None], at - mid[:, None], 0.0)
    return mid, about, *np.linalg.svd(about, full_matrices=False)


def ranks(at: np.ndarray, used: np.ndarray) -> np.ndarray:
    """In how many dimensions each array of points spreads by more than 1 mm: 1 on a line, 2 in a plane. ``at`` has three rows at least."""
    return (_axes(at, used)[3] > FLAT_M).sum(1)


def _padded(rows: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of different lengths as one block, and which of it is used; three long at least."""
    most = max([3, *map(len, rows)])
    block, used = np.zeros((len(rows), most, width)), np.zeros((len(rows), most), bool)
    for i, r in enumerate(rows):
        block[i, : len(r)], used[i, : len(r)] = r, True
    return block, used


def geometry_rank(points: Column) -> Column:
    """``ranks`` of an array of [x, y, z]; points that are null or not finite are passed over, and without any it is 0."""

    @arrow_udf("int")
    def ranked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [np.array([p for p in r or [] if p is not None and len(p) == 3 and None not in p and np.isfinite(p).all()], float).reshape(-1, 3) for r in batch.to_pylist()]
            yield pa.array(ranks(*_padded(rows, 3)) if rows else [], pa.int32())

    return ranked(points)


def usable(distance: Column, sigma: Column) -> Column:
    return is_finite(distance) & (distance >= 0) & is_finite(sigma) & (sigma > 0)


def solvable(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source_id, links, verdict) of each source: whether its ranges to surveyed microphones can place it."""
    good = usable(F.col("distance_m"), F.col("sigma_m")) & F.col("mic_x").isNotNull()
    places = F.collect_set(F.when(good, F.array("mic_x", "mic_y", "mic_z")))  # as many as microphones
    found = cells.groupBy(*keys, "source_id").agg(F.size(places).cast("long").alias("links"), places.alias("_at"))
    line = geometry_rank(F.col("_at")) < 2
    verdict = F.when(F.col("links") < 3, "insufficient_ranges").when(line, "degenerate_geometry").when(F.col("links") == 3, "mirror_ambiguous").otherwise("solvable")
    return found.select(*keys, "source_id", "links", verdict.alias("verdict"))


# ------------------------------------------------------------------ single points


def _gaps(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances from each place to its anchors, and the unit vectors along them."""
    gap = x[:, None] - at
    r = np.maximum(np.sqrt((gap**2).sum(2)), 1e-12)
    return r, gap / r[..., None]


def _starts(at: np.ndarray, d: np.ndarray, s: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Four places per point to begin from.

    The place that the linear equations of squared ranges give; the two places
    above and below the anchors' widest plane; and the anchors' weighted middle,
    pulled away from the first of them. In a plane the first is the upper one,
    on the side where the normal's largest part is positive.
    """
    mid, about, u, wide, axes = _axes(at, used)
    n = np.maximum(used.sum(1), 1)
    b = np.where(used, (about**2).sum(2) - d * d, 0.0) / 2
    b = np.where(used, b - (b.sum(1) / n)[:, None], 0.0)
    y = np.einsum("bmk,bm->bk", u, b) * np.where(wide > FLAT_M, 1 / np.maximum(wide, FLAT_M), 0.0)
    along = np.einsum("bmj,bkj->bmk", about, axes)[..., :2]
    high = np.sqrt(np.maximum(0.0, (np.where(used, d * d - ((along - y[:, None, :2]) ** 2).sum(2), 0.0)).sum(1) / n))
    normal = axes[:, 2] * np.sign(np.take_along_axis(axes[:, 2], np.abs(axes[:, 2]).argmax(1)[:, None], 1))
    foot = mid + np.einsum("bk,bkj->bj", y[:, :2], axes[:, :2])
    up, down = foot + high[:, None] * normal, foot - high[:, None] * normal
    linear = np.where((wide > FLAT_M).all(1)[:, None], mid + np.einsum("bk,bkj->bj", y, axes), up)
    w = np.where(used, 1 / (s * s), 0.0)
    heavy = (at * w[..., None]).sum(1) / np.maximum(w.sum(1), 1e-300)[:, None]
    first = used.argmax(1)
    out = heavy - np.take_along_axis(at, first[:, None, None], 1)[:, 0]
    long = np.sqrt((out**2).sum(1))[:, None]
    out = np.where(long > 1e-9, out / np.maximum(long, 1e-9), normal)
    return np.stack([linear, up, down, heavy + out * np.take_along_axis(d, first[:, None], 1)], 1)


def _descended(at: np.ndarray, d: np.ndarray, s: np.ndarray, used: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Each place moved to where its ranges fit best, those off by over three of their sigmas counting less."""
    x, live, longest = x.copy(), np.arange(len(x)), np.where(used, d, 0.0).max(1, initial=1e-3)
    for _ in range(rounds):
        r, unit = _gaps(at[live], x[live])
        e = d[live] - r
        w = np.where(used[live], np.minimum(1.0, HUBER * s[live] / np.maximum(np.abs(e), 1e-300)) / s[live] ** 2, 0.0)
        m = np.einsum("bmi,bm,bmj->bij", unit, w, unit)
        m += DAMPING * np.maximum(np.trace(m, axis1=1, axis2=2), 1e-300)[:, None, None] * np.eye(3)
        step = np.linalg.solve(m, np.einsum("bmi,bm->bi", unit, w * e)[..., None])[..., 0]
        size = np.sqrt((step**2).sum(1))
        step *= np.minimum(1.0, longest[live] / np.maximum(size, 1e-300))[:, None]
        x[live] += step
        live = live[size > STEP_M]
        if not len(live):
            break
    return x


def _fitted(at: np.ndarray, d: np.ndarray, s: np.ndarray, used: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The best of the places that the starts lead to; the earlier one where they tie.

    Of anchors that are all but in a plane, the mirror place may fit to less than
    a micrometre and still be the wrong one. So places tie where nothing but
    rounding tells them apart, or where their costs are within a millionth.
    """
    starts = _starts(at, d, s, used)
    many = starts.shape[1]
    again = lambda a: np.repeat(a, many, axis=0)
    x = _descended(again(at), again(d), again(s), again(used), starts.reshape(-1, 3), rounds)
    z = np.abs(again(d) - _gaps(again(at), x)[0]) / again(s)
    cost = np.where(again(used), np.where(z <= HUBER, z * z / 2, HUBER * z - HUBER * HUBER / 2), 0.0).sum(1).reshape(-1, many)
    largest = np.maximum(np.abs(at).max((1, 2)), np.where(used, d, 0.0).max(1, initial=1e-3))
    slack = ROUNDING * largest * np.sqrt(np.where(used, 1 / (s * s), 0.0).sum(1))
    tied = np.sqrt(cost) <= (np.sqrt(cost.min(1)) * (1 + 5e-7) + slack)[:, None]
    return x.reshape(-1, many, 3)[np.arange(len(at)), tied.argmax(1)]


def placed(at: np.ndarray, d: np.ndarray, s: np.ndarray, used: np.ndarray, sample_m: float) -> dict[str, np.ndarray]:
    """Places of points, with what shows how good they are; ``at`` is point x anchor x 3.

    A range that is off by over 3.5 of its sigmas is left out, once, and the
    place is solved again. A residual over ``sample_m`` and three median sigmas
    is refused. With a range to spare, each is left out in turn: how far it then
    is from its own measure, and how far the place moves.
    """
    links, rank = used.sum(1), ranks(at, used)
    few, line = links < LEAST_RANGES, rank < 2
    n = len(at)
    verdict = np.where(links < 3, "insufficient_ranges", np.where(line, "degenerate_geometry", np.where(few, "mirror_ambiguous", "solved"))).astype(object)
    nan = lambda *shape: np.full((n, *shape), np.nan)
    out = {"xyz": nan(3), "mirror": nan(3), "sigma": nan(3), "gdop": nan(), "rms": nan(), "gate": nan(), "loo_residual": nan(), "loo_shift": nan(), "loo_worst": np.full(n, -1), "kept": used.copy()}
    out |= {"links": links, "flat": (rank == 2) & (links >= 3), "verdict": verdict}
    go = np.flatnonzero(verdict == "solved")
    if not len(go):
        return out
    a, dd, ss, kept = at[go], d[go], s[go], used[go]
    x = _fitted(a, dd, ss, kept)
    off = kept & (np.abs(dd - _gaps(a, x)[0]) > BEYOND * ss)
    again = np.flatnonzero(off.any(1))
    kept &= ~off
    failed = np.zeros(len(go), bool)
    if len(again):
        failed[again] = (kept[again].sum(1) < LEAST_RANGES) | (ranks(a[again], kept[again]) < 2)
        x[again] = _fitted(a[again], dd[again], ss[again], kept[again])
    r, unit = _gaps(a, x)
    e, m = np.where(kept, dd - r, 0.0), np.maximum(kept.sum(1), 1)
    rms = np.sqrt((e * e).sum(1) / m)
    typical = np.nanmedian(np.where(kept | ~kept.any(1)[:, None], ss, np.nan), axis=1)
    gate = np.maximum(sample_m, 3 * typical)
    cov = np.linalg.pinv(np.einsum("bmi,bm,bmj->bij", unit, np.where(kept, 1 / ss**2, 0.0), unit), hermitian=True)
    spread = np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0.0)
    failed |= ~np.isfinite(x).all(1) | ~np.isfinite(rms)
    high = ~failed & (rms > gate)
    out["verdict"][go] = np.where(failed, "solve_failed", np.where(high, "solve_residual_high", "solved"))
    told, good = ~failed, ~failed & ~high
    out["rms"][go[told]], out["gate"][go[told]], out["gdop"][go[told]] = rms[told], gate[told], (np.sqrt(spread.sum(1)) / typical)[told]
    out["xyz"][go[good]], out["sigma"][go[good]], out["kept"][go] = x[good], np.sqrt(spread)[good], kept
    out["flat"][go] = (ranks(a, kept) == 2) & told
    mid, _, _, _, axes = _axes(a, kept)
    over = x - 2 * np.einsum("bj,bj->b", x - mid, axes[:, 2])[:, None] * axes[:, 2]
    mirrored = good & out["flat"][go]
    out["mirror"][go[mirrored]] = over[mirrored]
    # one range left out in turn, for all points that have one to spare
    spare = good & (kept.sum(1) > LEAST_RANGES)
    i, k = np.nonzero(kept & spare[:, None])
    without = kept[i]
    without[np.arange(len(i)), k] = False
    fine = ranks(a[i], without) > 1 if len(i) else np.zeros(0, bool)
    i, k, without = i[fine], k[fine], without[fine]
    if len(i):
        y = _descended(a[i], dd[i], ss[i], without, x[i])
        shift, miss = np.full(kept.shape, -1.0), np.full(kept.shape, -1.0)
        shift[i, k] = np.sqrt(((y - x[i]) ** 2).sum(1))
        miss[i, k] = np.abs(dd[i, k] - np.sqrt(((y - a[i, k]) ** 2).sum(1)))
        some = np.unique(i)
        out["loo_shift"][go[some]], out["loo_residual"][go[some]], out["loo_worst"][go[some]] = shift[some].max(1), miss[some].max(1), miss[some].argmax(1)
    return out


_PLACED = (
    "x double, y double, z double, sigma_x double, sigma_y double, sigma_z double, links long, excluded array<string>, mirror_ambiguous boolean, mirror array<double>, "
    "gdop double, rms_m double, gate_m double, loo_residual_m double, loo_anchor string, loo_m double, verdict string"
)


def _placed_rows(found: dict[str, np.ndarray], names: list[list[str]]) -> list[dict]:
    none = lambda v: None if v != v else float(v)
    return [
        {**{c: none(v) for c, v in zip(("x", "y", "z", "sigma_x", "sigma_y", "sigma_z"), [*found["xyz"][i], *found["sigma"][i]], strict=True)},
         "links": int(found["links"][i]), "excluded": [n for n, k in zip(ids, found["kept"][i], strict=False) if not k], "mirror_ambiguous": bool(found["flat"][i]),
         "mirror": None if np.isnan(found["mirror"][i]).any() else found["mirror"][i].tolist(), "gdop": none(found["gdop"][i]), "rms_m": none(found["rms"][i]), "gate_m": none(found["gate"][i]),
         "loo_residual_m": none(found["loo_residual"][i]), "loo_anchor": ids[found["loo_worst"][i]] if found["loo_worst"][i] >= 0 else None, "loo_m": none(found["loo_shift"][i]), "verdict": found["verdict"][i]}
        for i, ids in enumerate(names)
    ]


def _solved(cells: DataFrame, by: list[str], anchor: str, at: str, sample_m: float) -> DataFrame:
    """(by, place and verdict) of points from their ranges to surveyed anchors; of repeats of a range the one of least sigma counts."""
    good = usable(F.col("distance_m"), F.col("sigma_m")) & F.col(f"{at}_x").isNotNull() & F.col(f"{at}_y").isNotNull() & F.col(f"{at}_z").isNotNull()
    place = F.array(*[F.col(f"{at}_{a}").cast("double") for a in "xyz"])
    best = cells.groupBy(*by, anchor).agg(F.min(F.when(good, F.struct(F.col("sigma_m").cast("double").alias("s"), F.col("distance_m").cast("double").alias("d"), place.alias("at")))).alias("m"))
    link = F.struct(F.col(anchor).alias("order"), F.col(anchor).cast("string").alias("id"), "m.s", "m.d", "m.at")
    points = best.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), link))).alias("links"))
    schema = StructType([*[f for f in points.schema if f.name in by], *StructType.fromDDL(_PLACED)])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                links = batch.column("links").to_pylist()
                block, used = _padded([np.array([[*p["at"], p["d"], p["s"]] for p in row], float).reshape(-1, 5) for row in links], 5)
                found = placed(block[..., :3], block[..., 3], np.where(used, block[..., 4], 1.0), used, sample_m)
                rows = _placed_rows(found, [[p["id"] for p in row] for row in links])
                more = {f: [r[f] for r in rows] for f in rows[0]} if rows else {}
                yield pa.RecordBatch.from_arrays([*[batch.column(b) for b in by], *[pa.array(v, _ARROW.field(f).type) for f, v in more.items()]], [*by, *more])

    return points.mapInArrow(solve, schema)


_ARROW = pa.schema(
    [(c, pa.float64()) for c in ("x", "y", "z", "sigma_x", "sigma_y", "sigma_z", "gdop", "rms_m", "gate_m", "loo_residual_m", "loo_m")]
    + [("links", pa.int64()), ("excluded", pa.list_(pa.string())), ("mirror_ambiguous", pa.bool_()), ("mirror", pa.list_(pa.float64())), ("loo_anchor", pa.string()), ("verdict", pa.string())]
)


def solved_positions(cells: DataFrame, keys: list[str], sample_m: float) -> DataFrame:
    """(keys, source_id, x, y, z, sigmas, links, excluded, mirror, gdop, rms_m, gate_m, loo, verdict) of each source.

    ``cells`` has microphone_id and its mic_x, mic_y, mic_z, null where it is not
    surveyed. A source has a range per microphone, of which a plan has 32 at
    most. Under four ranges there is no place: ``mirror_ambiguous`` with three,
    ``insufficient_ranges`` with fewer; nor on a line (``degenerate_geometry``).
    Anchors in a plane give a place and its ``mirror``. ``solve_failed`` is said
    where too few ranges are left, ``solve_residual_high`` with rms, gate and gdop.
    """
    return _solved(cells, [*keys, "source_id"], "microphone_id", "mic", sample_m)


def solved_microphones(cells: DataFrame, keys: list[str], sample_m: float) -> DataFrame:
    """As ``solved_positions``, of microphones from surveyed sources (src_x, src_y, src_z); one that is surveyed keeps its place as ``surveyed_anchor``."""
    by = [*keys, "microphone_id"]
    found = _solved(cells, by, "source_id", "src", sample_m)
    known = cells.where(F.col("mic_x").isNotNull()).groupBy(*by).agg(*[F.min(f"mic_{a}").alias(f"_k{a}") for a in "xyz"])
    both = found.join(known, by, "left")
    anchored = F.col("_kx").isNotNull()
    place = {a: F.coalesce(f"_k{a}", a) for a in "xyz"} | {"verdict": F.when(anchored, "surveyed_anchor").otherwise(F.col("verdict"))}
    return both.withColumns(place).drop("_kx", "_ky", "_kz")


# ------------------------------------------------------------------ whole sessions


def points_of(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, id, at, finite, links) of all sources and microphones: where they are surveyed, and usable ranges."""
    good = usable(F.col("distance_m"), F.col("sigma_m")).cast("int")
    pairs = cells.groupBy(*keys, "source_id", "microphone_id").agg(F.max(good).alias("good"), *[F.max(f"{p}_{a}").alias(f"{p}_{a}") for p in ("src", "mic") for a in "xyz"])
    side = lambda name, i, p: pairs.select(*keys, F.lit(name).alias("side"), F.col(i).cast("string").alias("id"), *[F.col(f"{p}_{a}").cast("double").alias(a) for a in "xyz"], "good")
    rows = side("source", "source_id", "src").unionByName(side("microphone", "microphone_id", "mic"))
    found = rows.groupBy(*keys, "side", "id").agg(*[F.max(a).alias(a) for a in "xyz"], F.sum("good").alias("links"))
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    finite = is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z"))
    return found.select(*keys, "side", "id", F.when(known, F.array("x", "y", "z")).alias("at"), F.when(known, finite).alias("finite"), "links")


def joint_eligibility(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unknown_sources, unknown_microphones, anchors, ranges, least_links, issue): whether all unsurveyed points of a session can be solved at once.

    Null if they can; else the first of: only one side has any (direct solves
    are exact there), a surveyed place is not finite, under three anchors,
    anchors on a line, under three ranges per unknown, an unknown under four links.
    """
    unknown = F.col("at").isNull()
    s = points_of(cells, keys).groupBy(*keys).agg(
        F.count_if(unknown & (F.col("side") == "source")).alias("unknown_sources"), F.count_if(unknown & (F.col("side") == "microphone")).alias("unknown_microphones"),
        F.count_if(~unknown).alias("anchors"), F.sum(F.when(F.col("side") == "source", F.col("links"))).alias("ranges"), F.min(F.when(unknown, F.col("links"))).alias("least_links"),
        F.every(F.coalesce("finite", F.lit(True))).alias("_finite"), F.collect_list("at").alias("_at"),
    )
    rank = geometry_rank(F.col("_at"))
    unknowns = F.col("unknown_sources") + F.col("unknown_microphones")
    issue = (
        F.when((F.col("unknown_sources") == 0) | (F.col("unknown_microphones") == 0), "one_sided").when(~F.col("_finite"), "anchor_not_finite").when(F.col("anchors") < LEAST_ANCHORS, "few_anchors")
        .when(rank < 2, "collinear_anchors").when(F.col("ranges") < 3 * unknowns, "few_ranges").when(F.col("least_links") < LEAST_RANGES, "few_links")
    )
    return s.select(*keys, "unknown_sources", "unknown_microphones", "anchors", "ranges", "least_links", issue.alias("issue"))


class Net:
    """Sources and microphones that only meet through ranges: ``i`` is the source, ``j`` the microphone of each range.

    ``at`` has the sources' places, then the microphones'; ``fixed`` says which are surveyed.
    """

    def __init__(self, sources: int, at: np.ndarray, fixed: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray, s: np.ndarray) -> None:
        self.fixed, self.i, self.j, self.d, self.s = fixed, i, j + sources, d, s
        self.at = at.copy()
        self.kept = np.ones(len(d), bool)
        free = np.flatnonzero(~fixed)
        self.left, self.right = free[free < sources], free[free >= sources]
        self.slot = np.full(len(at), -1)
        self.slot[self.left], self.slot[self.right] = np.arange(len(self.left)), np.arange(len(self.right))

    def residuals(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = at[self.i] - at[self.j]
        r = np.maximum(np.sqrt((gap**2).sum(1)), 1e-12)
        return self.d - r, gap / r[:, None]

    def cost(self, at: np.ndarray, tukey: float | None) -> float:
        z = np.abs(self.residuals(at)[0][self.kept]) / self.s[self.kept]
        if tukey is None:
            return float(np.where(z <= HUBER, z * z / 2, HUBER * z - HUBER * HUBER / 2).sum())
        return float((tukey * tukey / 6 * (1 - np.maximum(0.0, 1 - (z / tukey) ** 2) ** 3)).sum())

    def normal(self, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Blocks of the normal equations: one per free source, one per free microphone, and what couples them."""
        e, u = self.residuals(at)
        w = np.where(self.kept, w, 0.0)
        outer, pull = w[:, None, None] * u[:, :, None] * u[:, None, :], (w * e)[:, None] * u
        a, b = np.zeros((len(self.left), 3, 3)), np.zeros((len(self.right), 3, 3))
        c = np.zeros((len(self.left), len(self.right), 3, 3))
        ga, gb = np.zeros((len(self.left), 3)), np.zeros((len(self.right), 3))
        li, rj = self.slot[self.i], self.slot[self.j]
        p, q = ~self.fixed[self.i], ~self.fixed[self.j]
        np.add.at(a, li[p], outer[p])
        np.add.at(ga, li[p], pull[p])
        np.add.at(b, rj[q], outer[q])
        np.add.at(gb, rj[q], -pull[q])
        np.add.at(c, (li[p & q], rj[p & q]), -outer[p & q])
        return a, b, c.transpose(0, 2, 1, 3).reshape(len(self.left), 3, -1), ga, gb

    @staticmethod
    def reduced(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sources' inverse blocks, what they carry over, and the system that is left for the microphones (the Schur complement)."""
        inverse = np.linalg.inv(a)
        carried = inverse @ c
        rest = np.zeros((3 * len(b), 3 * len(b)))
        for k, block in enumerate(b):
            rest[3 * k : 3 * k + 3, 3 * k : 3 * k + 3] = block
        return inverse, carried, rest - np.einsum("iak,ial->kl", c, carried)

    def settle(self, at: np.ndarray, tukey: float | None = None) -> tuple[np.ndarray, float]:
        """Levenberg-Marquardt over all free points from ``at``; without ``tukey`` ranges far off count less, with it not at all."""
        at, damping = at.copy(), 1e-3
        cost = self.cost(at, tukey)
        for _ in range(2 * ROUNDS):
            z = np.abs(self.residuals(at)[0]) / self.s
            w = (np.minimum(1.0, HUBER / np.maximum(z, 1e-300)) if tukey is None else np.maximum(0.0, 1 - (z / tukey) ** 2) ** 2) / self.s**2
            a, b, c, ga, gb = self.normal(at, w)
            scale = max(1e-12, float(np.trace(a.sum(0)) + np.trace(b.sum(0))) / max(1, 3 * (len(a) + len(b))))
            moved = False
            while damping < 1e12:
                more = damping * scale * np.eye(3)
                inverse, carried, rest = self.reduced(a + more, b + more, c)
                right = np.linalg.solve(rest, gb.ravel() - np.einsum("iak,ia->k", carried, ga))
                left = np.einsum("iab,ib->ia", inverse, ga) - np.einsum("iak,k->ia", carried, right)
                new = at.copy()
                new[self.left] += left
                new[self.right] += right.reshape(-1, 3)
                less = self.cost(new, tukey)
                if less <= cost:
                    moved = True
                    break
                damping *= 4
            if not moved:
                break
            step = max(np.abs(left).max(initial=0.0), np.abs(right).max(initial=0.0))
            at, cost, damping = new, less, max(damping / 5, 1e-12)
            if step < STEP_M:
                break
        return at, cost

    def agreed(self, p: int, at: np.ndarray, known: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """Places for a point from its ranges to known ones, that most of them agree on first: of all, and with each left out in turn."""
        mine = np.flatnonzero((self.i == p) | (self.j == p))
        other = np.where(self.i[mine] == p, self.j[mine], self.i[mine])
        mine, other = mine[known[other]], other[known[other]]
        n = len(mine)
        every = np.ones((1, n), bool)
        used = np.concatenate([every, ~np.eye(n, dtype=bool)]) if LEAST_RANGES < n <= SPARSE else every
        again = lambda a: np.repeat(a[None], len(used), axis=0)
        a, d, s = again(at[other]), again(self.d[mine]), again(self.s[mine])
        x = _fitted(a, d, s, used, SEED_ROUNDS)
        z = np.abs(d - _gaps(a, x)[0]) / s
        cost = (1 - np.maximum(0.0, 1 - (z / TUKEY[-1]) ** 2) ** 3).sum(1)
        return [(float(cost[k]), x[k]) for k in np.argsort(cost, kind="stable")]

    def seeds(self) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Places to begin from, each free point from those that have one, the best linked first; and mirror places of those seen from a plane."""
        at, known, sides = self.at.copy(), self.fixed.copy(), []
        at[~known] = at[known].mean(0)
        waiting = list(np.flatnonzero(~known))
        while waiting:
            seen = []
            for p in waiting:
                other = np.where(self.i == p, self.j, np.where(self.j == p, self.i, -1))
                seen.append(other[(other >= 0) & known[other]])
            block, used = _padded([at[o] for o in seen], 3)
            rank = ranks(block, used)
            best = max(range(len(waiting)), key=lambda k: (rank[k] >= 3, used[k].sum(), -k))
            p = waiting.pop(best)
            if used[best].sum() >= 3 and rank[best] >= 2:
                at[p] = self.agreed(p, at, known)[0][1]
                if rank[best] == 2:
                    mid, _, _, _, axes = _axes(block[best : best + 1], used[best : best + 1])
                    sides.append((p, at[p] - 2 * ((at[p] - mid[0]) @ axes[0, 2]) * axes[0, 2]))
            else:
                at[p] = at[p] + 0.1 * np.array([1.0, 0.7, 0.4])
            known[p] = True
        return at, sides

    def narrowed(self, at: np.ndarray) -> tuple[np.ndarray, float]:
        """Settled with wild ranges counting less and less, to nothing."""
        for width in TUKEY:
            at, cost = self.settle(at, width)
        return at, cost

    def solve(self) -> str | None:
        """Moves the free points to their places; what keeps them from it, or None.

        From the seeds, and with mirror places from each combination of the
        first few of them. Points that keep a wild range then try the other
        places that most of their ranges agree on, for as long as that helps.
        What is still wild at last is left out, after which every point must
        have its links.
        """
        first, sides = self.seeds()
        ways = [first]
        for pattern in range(1, 1 << min(len(sides), 5)):
            ways.append(first.copy())
            for k, (p, mirror) in enumerate(sides[:5]):
                if pattern >> k & 1:
                    ways[-1][p] = mirror
        best, least = None, np.inf
        for way in ways:
            for start in (way, self.settle(way)[0]):
                at, cost = self.narrowed(start)
                if cost < least * (1 - 1e-6) - 1e-9:
                    best, least = at, cost
                if (np.abs(self.residuals(at)[0]) <= BEYOND * self.s).all():
                    break  # nothing is wild, so no other weights lead elsewhere
        free = np.flatnonzero(~self.fixed)
        helped = True
        while helped:
            helped = False
            wild = np.abs(self.residuals(best)[0]) > BEYOND * self.s
            for p in free:
                mine = (self.i == p) | (self.j == p)
                if not (mine & wild).any() or mine.sum() > SPARSE:
                    continue
                for _, place in self.agreed(p, best, np.ones(len(best), bool)):
                    if np.abs(place - best[p]).max() > FLAT_M:
                        start = best.copy()
                        start[p] = place
                        at, cost = self.settle(start, TUKEY[-1])
                        if cost < least * (1 - 1e-6) - 1e-9:
                            best, least, helped = at, cost, True
                            wild = np.abs(self.residuals(best)[0]) > BEYOND * self.s
        self.kept = np.abs(self.residuals(best)[0]) <= BEYOND * self.s
        links = np.bincount(np.concatenate([self.i[self.kept], self.j[self.kept]]), minlength=len(self.at))
        unknowns = len(self.left) + len(self.right)
        if (links[~self.fixed] < LEAST_RANGES).any() or self.kept.sum() < 3 * unknowns:
            return "depleted"
        self.at, _ = self.settle(best)
        return None if np.isfinite(self.at).all() else "diverged"

    def covariance(self) -> np.ndarray:
        """The 3 x 3 block of each free point of the inverse of all normal equations; NaN where these are singular."""
        out = np.full((len(self.at), 3, 3), np.nan)
        a, b, c, _, _ = self.normal(self.at, 1 / self.s**2)
        try:
            inverse, carried, rest = self.reduced(a, b, c)
            if not np.linalg.cond(rest) < 1e12:
                return out
            whole = np.linalg.inv(rest)
        except np.linalg.LinAlgError:
            return out
        for k, p in enumerate(self.right):
            out[p] = whole[3 * k : 3 * k + 3, 3 * k : 3 * k + 3]
        out[self.left] = inverse + np.einsum("iak,kl,ibl->iab", carried, whole, carried)
        return out


_JOINT = (
    "side string, id string, x double, y double, z double, sigma_x double, sigma_y double, sigma_z double, links long, excluded array<string>, rms_m double, "
    "mirror_ambiguous boolean, absorb_risk boolean, session_rms_m double, verdict string"
)


def joint_positions(cells: DataFrame, keys: list[str], sample_m: float) -> DataFrame:
    """(keys, side, id, place, sigmas, links, excluded, rms_m, mirror_ambiguous, absorb_risk, session_rms_m, verdict) of all unsurveyed points of eligible sessions.

    A session is one group, of 1024 ranges at most by its plan. Sigmas are those
    of the whole session's covariance. ``mirror_ambiguous``: all anchors are in a
    plane, so the session's mirror image fits as well. ``absorb_risk``: a point
    has no link to spare, so that a wild one might not show. A session that is
    depleted, singular, or whose residual is over ``sample_m`` and three median
    sigmas is refused as a whole: every unsurveyed point is ``solve_failed``.
    """
    fit = joint_eligibility(cells, keys).where("issue is null").select(*keys)
    good = usable(F.col("distance_m"), F.col("sigma_m"))
    place = [F.col(f"{p}_{a}").cast("double").alias(f"{p}_{a}") for p in ("src", "mic") for a in "xyz"]
    rows = cells.join(fit, keys, "left_semi").select(*keys, F.col("source_id").cast("string").alias("source_id"), F.col("microphone_id").cast("string").alias("microphone_id"), *place, F.when(good, F.col("distance_m")).cast("double").alias("d"), F.when(good, F.col("sigma_m")).cast("double").alias("s"))
    schema = StructType([*[f for f in rows.schema if f.name in keys], *StructType.fromDDL(_JOINT)])

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sides = [group.groupby(i, sort=True)[[f"{p}_{a}" for a in "xyz"]].max() for i, p in (("source_id", "src"), ("microphone_id", "mic"))]
        names = [*sides[0].index, *sides[1].index]
        at = np.concatenate([x.to_numpy(float) for x in sides])
        fixed = ~np.isnan(at).any(1)
        best = group.dropna(subset=["d"]).sort_values(["source_id", "microphone_id", "s", "d"]).drop_duplicates(["source_id", "microphone_id"])
        i, j = sides[0].index.get_indexer(best["source_id"]), sides[1].index.get_indexer(best["microphone_id"])
        net = Net(len(sides[0]), np.where(fixed[:, None], at, 0.0), fixed, i, j, best["d"].to_numpy(float), best["s"].to_numpy(float))
        try:
            refused = net.solve()
        except np.linalg.LinAlgError:
            refused = "singular"
        cov = net.covariance()
        e, kept = net.residuals(net.at)[0], net.kept
        rms = float(np.sqrt((e[kept] ** 2).mean())) if kept.any() else np.inf
        gate = max(sample_m, 3 * float(np.median(net.s)))
        if not refused and (np.isnan(cov[~fixed]).any() or rms > gate):
            refused = "solve_failed"
        flat = int(ranks(at[fixed][None], np.ones((1, int(fixed.sum())), bool))[0]) == 2
        links = np.bincount(np.concatenate([net.i[kept], net.j[kept]]), minlength=len(at))
        risk = bool((links[~fixed] <= LEAST_RANGES).any())
        out = []
        for p in np.flatnonzero(~fixed):
            mine = (net.i == p) | (net.j == p)
            other = np.where(net.i == p, net.j, net.i)
            row = {"side": "source" if p < len(sides[0]) else "microphone", "id": names[p], "links": int(mine.sum()), "mirror_ambiguous": flat, "excluded": [], "absorb_risk": risk, "verdict": "solve_failed"}
            if not refused:
                sigma = np.sqrt(np.maximum(np.diagonal(cov[p]), 0.0))
                row |= dict(zip(("x", "y", "z", "sigma_x", "sigma_y", "sigma_z"), [*net.at[p], *sigma], strict=True))
                row |= {"excluded": [names[q] for q in other[mine & ~kept]], "rms_m": float(np.sqrt((e[mine & kept] ** 2).mean())), "session_rms_m": rms, "verdict": "solved"}
            out.append(dict(zip(keys, key, strict=True)) | row)
        return pd.DataFrame(out, columns=schema.names)

    # solving costs much more than its rows show, so they are not packed into few tasks by their size
    spread = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(spread, *keys).groupBy(*keys).applyInPandas(solve, schema)


def session_places(cells: DataFrame, keys: list[str], sample_m: float) -> DataFrame:
    """(keys, side, id, method, x, y, z, verdict) of every point of every session.

    Unsurveyed points of sessions that can be solved at once come from that;
    all others, and surveyed sources as an audit, from direct solves; surveyed
    microphones are anchors.
    """
    joint = joint_positions(cells, keys, sample_m).select(*keys, "side", "id", "x", "y", "z", "verdict")
    source = solved_positions(cells, keys, sample_m).select(*keys, F.lit("source").alias("side"), F.col("source_id").cast("string").alias("id"), "x", "y", "z", "verdict")
    microphone = solved_microphones(cells, keys, sample_m).select(*keys, F.lit("microphone").alias("side"), F.col("microphone_id").cast("string").alias("id"), "x", "y", "z", "verdict")
    point = [*keys, "side", "id"]
    marked = joint.select(*point, F.struct("x", "y", "z", "verdict").alias("_j"))
    both = source.unionByName(microphone).join(marked, point, "left")
    at_once = F.col("_j").isNotNull()
    pick = lambda c: F.when(at_once, F.col(f"_j.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*point, F.when(at_once, "joint").when(F.col("verdict") == "surveyed_anchor", "survey").otherwise("direct").alias("method"), *[pick(c) for c in ("x", "y", "z", "verdict")])
