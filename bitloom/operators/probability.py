"""Probabilities of bits from counts, runs and order, and the code lengths that follow.

The adaptive estimate moves by (y - p) / (n + 1.5) after n observations. In real arithmetic it is the mean of a
Beta(1/4, 1/4) prior, (n1 + 1/4) / (n + 1/2): a column of counts, and the whole code length of a context follows from
its final counts alone. With a cap on n it depends on order and is a fold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import squash, stretch


def adaptive_p(n0: Column, n1: Column) -> Column:
    """Probability of a 1 after n0 zeros and n1 ones."""
    return (n1 + 0.25) / (n0 + n1 + 0.5)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of positive numbers, to some 12 digits, from built-in columns: Stirling's series at
    x + 8, and the logarithm of the eight factors between."""
    z = x + 8
    factors = x
    for k in range(1, 8):
        factors = factors * (x + k)
    w = 1 / (z * z)
    series = (1 / 12.0 - w * (1 / 360.0 - w * (1 / 1260.0 - w / 1680.0))) / z
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(factors)


def total_bits(n0: Column, n1: Column) -> Column:
    """Bits that the adaptive estimate spends on n0 zeros and n1 ones, in whatever order they come."""
    at = lambda c, a: log_gamma(c.cast("double") + a)
    quarter, half = math.lgamma(0.25), math.lgamma(0.5)
    return (at(n0 + n1, 0.5) - half - at(n0, 0.25) - at(n1, 0.25) + 2 * quarter) / math.log(2)


def prequential(bits: DataFrame, keys: tuple[str, ...], order_cols: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """Bit rows with p1, the estimate before each bit from the earlier bits of its key."""
    before = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    n1 = F.coalesce(F.sum("y").over(before), F.lit(0))
    n = F.count("y").over(before)
    return bits.withColumn("p1", adaptive_p(n - n1, n1))


def cost(y: Column, p1: Column) -> Column:
    """Ideal code length of a bit."""
    return -F.log2(F.when(y == 1, p1).otherwise(1 - p1))


def capped_fold(bits: Column, limit: int) -> Column:
    """struct(p, n) after an ordered array of bits, on a scale of 2^22, with n at most ``limit``: one step moves p by
    the shifted distance to the bit times the rate after n observations."""
    if limit > 1023:
        raise ValueError("the count has to fit ten bits")
    rates = F.array(*[F.lit(16384 // (2 * n + 3)).cast("long") for n in range(limit + 1)])

    def step(s: Column, y: Column) -> Column:  # s: p in the higher bits, n in the lowest ten
        p, n = F.call_function("shiftright", s, F.lit(10)), s.bitwiseAND(F.lit(1023).cast("long"))
        gap = F.call_function("shiftright", y.cast("long") * (1 << 22) - p, F.lit(3)) * F.get(rates, n.cast("int"))
        moved = p + F.call_function("shiftright", gap, F.lit(10))
        return moved * 1024 + F.least(n + 1, F.lit(limit).cast("long"))

    state = F.aggregate(bits, F.lit(1 << 31).cast("long"), step)
    return F.struct(F.call_function("shiftright", state, F.lit(10)).alias("p"), state.bitwiseAND(F.lit(1023).cast("long")).alias("n"))


def direct_inputs(p: Column) -> list[Column]:
    """Mixer inputs of a 12-bit probability: its distance from a half and its log odds."""
    return [F.call_function("shiftright", p - 2048, F.lit(2)), F.call_function("shiftright", stretch(p), F.lit(1))]


def run_probability(run: Column, uncertain: Column, expected: Column) -> Column:
    """12-bit probability of a 1 when a run of a byte expects ``expected``: grows with the run, less when the byte
    before it differed."""
    trust = F.log2(run + 2.0) * F.when(uncertain == 1, 128).otherwise(256)
    return squash(F.round(trust).cast("int") * F.when(expected == 1, 1).otherwise(-1))


def run_input(run: Column, byte1: Column, byte2: Column, byte3: Column, c0: Column, bpos: Column) -> Column:
    """Mixer input from the last byte that agrees with the bits already known; 0 when neither does."""
    agrees = lambda byte: F.call_function("shiftright", byte + 256, 8 - bpos) == c0
    bit = lambda byte: F.call_function("shiftright", byte, 7 - bpos).bitwiseAND(F.lit(1))
    unsure = (byte2 != byte1).cast("int")
    first = F.call_function("shiftright", stretch(run_probability(run, unsure, bit(byte1))), unsure)
    older = F.lit(1) + (byte3 != byte2).cast("int")
    second = F.call_function("shiftright", stretch(run_probability(F.lit(0), F.lit(1), bit(byte2))), older)
    return F.when(agrees(byte1), first).when(agrees(byte2), second).otherwise(0)


def structure_input(left: Column, bpos: Column, b0: Column) -> Column:
    """Certainty about the first two bits of a byte: inside a character they are 1 and 0."""
    inside = F.when(bpos == 0, 2047).when(bpos == 1, -2047).otherwise(0)
    lead = F.when((bpos == 1) & (b0 == 1), 2047).otherwise(0)
    return F.when(left > 0, inside).otherwise(lead)


def persistence_input(c1: Column, bpos: Column) -> Column:
    """Text tends to stay ASCII or not: an input at the first bit of a byte."""
    return F.when(bpos == 0, F.when(c1 >= 128, 512).otherwise(-512)).otherwise(0)


def history_prior(n0: Column, n1: Column) -> Column:
    """Initial probability of a 1 for a history that stands for n0 zeros and n1 ones, each count weighed three times."""
    return (3 * n1 + 1) / (3 * (n0 + n1) + 2)


def history_inputs(p12: Column, seen: Column, young: Column) -> list[Column]:
    """Mixer inputs of a history's 12-bit probability: log odds, halved and halved again while the history is young, and
    the distance from a half; both 0 for an unseen context."""
    odds = F.call_function("shiftright", stretch(p12), F.when(young, 2).otherwise(1))
    return [F.when(seen, odds).otherwise(0), F.when(seen, F.call_function("shiftright", p12 - 2048, F.lit(2))).otherwise(0)]


def miss_register(rows: DataFrame, keys: tuple[str, ...], order_cols: tuple[str, ...], miss: str, width: int = 16) -> DataFrame:
    """Rows with misses: the last ``width`` values of the 0/1 column ``miss`` before this row as bits, the latest lowest."""
    ordered = Window.partitionBy(*keys).orderBy(*order_cols)
    total = F.lit(0)
    for k in range(width):
        total = total + F.coalesce(F.lag(miss, k + 1).over(ordered), F.lit(0)) * (1 << k)
    return rows.withColumn("misses", total)
