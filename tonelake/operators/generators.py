"""Test signals as rows (idx, x), in closed form wherever there is one.

Rows come from ``range``, so a signal of any length is made in as many tasks as
wanted and nothing passes through the driver.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators.curves import interpolated

_T = 2 * math.pi
#: Exponents, beside the order and 0, of polynomials whose sequence takes all states, for orders 2 to 24.
PRIMITIVE = {
    2: (1,), 3: (1,), 4: (1,), 5: (2,), 6: (1,), 7: (1,), 8: (4, 3, 2), 9: (4,), 10: (3,), 11: (2,), 12: (6, 4, 1), 13: (4, 3, 1), 14: (10, 6, 1), 15: (1,), 16: (12, 3, 1),
    17: (3,), 18: (7,), 19: (5, 2, 1), 20: (3,), 21: (2,), 22: (1,), 23: (5,), 24: (7, 2, 1),
}
#: Fixed values of IEC 60268-16: octave bands, the level of male speech in them, and the two modulations of each.
STIPA_BANDS = ((125, 2.9, 1.6, 8.0), (250, 2.9, 1.0, 5.0), (500, -0.8, 0.63, 3.15), (1000, -6.8, 2.0, 10.0), (2000, -12.8, 1.25, 6.25), (4000, -18.8, 0.8, 4.0), (8000, -24.8, 2.5, 12.5))


def frames(spark: SparkSession, seconds: float, rate: int) -> DataFrame:
    return spark.range(round(seconds * rate)).withColumnRenamed("id", "idx")


def tone(hz: Column | float, amplitude: Column | float, rate: int) -> Column:
    return F.lit(amplitude) * F.sin(_T * F.lit(hz) * F.col("idx") / rate)


def two_tone(hz: tuple[float, float], amplitude: tuple[float, float], rate: int) -> Column:
    return tone(hz[0], amplitude[0], rate) + tone(hz[1], amplitude[1], rate)


def log_sweep(lo: Column | float, hi: Column | float, amplitude: Column | float, seconds: float, rate: int) -> Column:
    """An exponential sine sweep: every octave takes the same time."""
    k = F.lit(seconds) / F.ln(F.lit(hi) / F.lit(lo))
    return F.lit(amplitude) * F.sin(_T * F.lit(lo) * k * (F.exp(F.col("idx") / (rate * k)) - 1))


def linear_chirp(lo: Column | float, hi: Column | float, seconds: float, rate: int) -> Column:
    t = F.col("idx") / rate
    return F.sin(_T * (F.lit(lo) * t + (F.lit(hi) - F.lit(lo)) / (2 * seconds) * t * t))


def pre_compensated(sweeps: DataFrame, points: DataFrame, keys: list[str], lo: float, hi: float, seconds: float, rate: int) -> DataFrame:
    """(keys, idx, x): log sweeps of ``sweeps`` (keys, idx, x) by the inverse of a response that is to flatten them.

    ``points`` is (keys, hz, db). A log sweep passes every frequency at one
    instant, so each sample is divided by the response at its own frequency,
    between points by the logarithm of frequency and beyond them as at the end.
    A sweep without points stays as it is.
    """
    k = seconds / math.log(hi / lo)
    at = sweeps.withColumn("hz", F.lit(lo) * F.exp(F.col("idx") / (rate * k)))
    gain = interpolated(points.select(*keys, "hz", "db"), at.select(*keys, "hz", "idx", "x"), keys, "hz", "db", ("idx", "x"))
    return gain.select(*keys, "idx", (F.col("x") * F.pow(F.lit(10.0), -F.col("db") / 20)).alias("x"))


def octave_zones(lo: float, hi: float, bass: float) -> list[tuple[float, float, float]]:
    """(lo, hi, seconds) of each zone of a sweep that gives the bass more time: up to 100 Hz, to 1 kHz, and above."""
    edges = [(lo, min(hi, 100.0), 1.0), (max(lo, 100.0), min(hi, 1000.0), 0.5), (max(lo, 1000.0), hi, 0.25)]
    return [(a, b, bass * share * math.log2(b / a)) for a, b, share in edges if b > a]


def octave_sweep(spark: SparkSession, lo: float, hi: float, amplitude: float, bass: float, rate: int, silence: float = 0.0) -> DataFrame:
    """(idx, x): zones one after another, each going on in the phase where the one before ended, with silence around."""
    x, at, phase = F.lit(0.0), round(silence * rate), 0.0
    for a, b, seconds in octave_zones(lo, hi, bass):
        n, k = round(seconds * rate), seconds / math.log(b / a)
        turn = phase + _T * a * k * (F.exp((F.col("idx") - at) / (rate * k)) - 1)
        x = F.when((F.col("idx") >= at) & (F.col("idx") < at + n), amplitude * F.sin(turn)).otherwise(x)
        phase += _T * a * k * (math.exp(n / (rate * k)) - 1)
        at += n
    return spark.range(at + round(silence * rate)).select(F.col("id").alias("idx"), x.alias("x"))


def faded(x: Column, n: int, fade: int) -> Column:
    """Raised-cosine ends of ``fade`` samples in a signal of n."""
    edge = F.least(F.col("idx"), F.lit(n - 1) - F.col("idx"))
    return x * F.when(edge < fade, 0.5 - 0.5 * F.cos(math.pi * edge / fade)).otherwise(1.0)


def dirac(amplitude: float) -> Column:
    return F.when(F.col("idx") == 0, amplitude).otherwise(0.0)


def multitone(spark: SparkSession, n: int, rate: int, amplitude: float, lo: float, hi: float) -> DataFrame:
    """(idx, x): all bins of an n-point transform in a band at one level, in phases that keep the peak low.

    Fewer than 16 tones are refused.
    """
    first, last = math.ceil(lo * n / rate), min(math.floor(hi * n / rate), n // 2 - 1)
    if last - first + 1 < 16:
        raise ValueError("the band holds fewer than 16 tones")
    many = last - first + 1
    bins = F.sequence(F.lit(first), F.lit(last))
    phase = lambda k: -math.pi * (k - first) * (k - first + 1) / many
    total = F.aggregate(F.transform(bins, lambda k: F.cos(_T * k * F.col("idx") / n + phase(k))), F.lit(0.0), lambda s, e: s + e)
    rows = spark.range(n).select(F.col("id").alias("idx")).withColumn("x", total)
    top = rows.agg(F.max(F.abs("x")).alias("top"))
    return rows.join(F.broadcast(top)).select("idx", (F.lit(amplitude) * F.col("x") / F.col("top")).alias("x"))


def noise(seed: int, amplitude: float) -> Column:
    """Uniform noise that depends on the seed and the sample's number alone, whatever the partitions."""
    return amplitude * (F.pmod(F.xxhash64(F.lit(seed), "idx"), F.lit(1 << 32)) / F.lit(1 << 31) - 1)


def pink_noise(seed: int, amplitude: float, octaves: int = 16) -> Column:
    """Noise that falls by 3 dB an octave: the mean of uniform values of which each is held twice as long as the one before."""
    held = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.shiftright(F.col("idx"), k)), F.lit(1 << 32)) / F.lit(1 << 31) - 1
    total = held(0)
    for k in range(1, octaves):
        total = total + held(k)
    return amplitude * total / octaves


def _jump(order: int, steps: int) -> int:
    """x to a power modulo the order's polynomial, as bits of coefficients."""
    modulus = 1 << order | 1 | sum(1 << e for e in PRIMITIVE[order])

    def product(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a, b = a << 1, b >> 1
            a ^= modulus if a >> order else 0
        return out

    out, base = 1, 2
    while steps:
        out = product(out, base) if steps & 1 else out
        base, steps = product(base, base), steps >> 1
    return out


def mls(spark: SparkSession, order: int, amplitude: float, block: int = 1 << 12) -> DataFrame:
    """(idx, x): a maximum-length sequence of 2**order - 1 samples of plus and minus one amplitude.

    Sample n is the lowest bit of x**n modulo a primitive polynomial, so each
    block starts where its power says, in whatever task.
    """
    if order not in PRIMITIVE:
        raise ValueError("orders 2 to 24")
    n, modulus = (1 << order) - 1, 1 << order | 1 | sum(1 << e for e in PRIMITIVE[order])

    def made(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for b in batch["id"]:
                state, out = _jump(order, int(b) * block), []
                for _ in range(min(block, n - int(b) * block)):
                    out.append(amplitude if state & 1 else -amplitude)
                    state <<= 1
                    state ^= modulus if state >> order else 0
                yield pd.DataFrame({"idx": range(int(b) * block, int(b) * block + len(out)), "x": out})

    return spark.range(-(-n // block)).mapInPandas(made, "idx long, x double")


def stipa(rate: int, amplitude: float, tones: int = 24, seed: int = 7) -> Column:
    """A test signal of speech intelligibility: seven half octaves of tones in hashed phases, each band's intensity modulated twice.

    Bands beyond the Nyquist frequency are left out.
    """
    t, total, power = F.col("idx") / rate, F.lit(0.0), 0.0
    for band, db, slow, fast in STIPA_BANDS:
        if band * 2**0.25 >= rate / 2:
            continue
        hz = [band * 2 ** (-0.25 + 0.5 * (i + 0.5) / tones) for i in range(tones)]
        level = 10 ** (db / 20) / math.sqrt(tones)
        sound = F.lit(0.0)
        for i, f in enumerate(hz):
            sound = sound + F.sin(_T * f * t + _T * ((seed * (i + 1) * band * 0.6180339887498949) % 1))
        total = total + level * sound * F.sqrt(0.5 * (1 + 0.55 * (F.sin(_T * slow * t) - F.sin(_T * fast * t))))
        power += 10 ** (db / 10) / 4
    return amplitude * total / (math.sqrt(power) * 4) if power else total


def wake_burst(spark: SparkSession, rate: int, amplitude: float, seed: int = 1) -> DataFrame:
    """(idx, x): a quarter second of faded noise at half scale at most; nothing for no amplitude."""
    n = round(rate / 4) if amplitude > 0 else 0
    return spark.range(n).select(F.col("id").alias("idx")).withColumn("x", faded(noise(seed, min(amplitude, 0.5)), max(n, 1), rate // 200))
