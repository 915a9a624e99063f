"""Gated logistic mixing with integer weights: as expressions over arrays of any length, and over lists of columns, which
Spark compiles without building arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import squash

LOW, HIGH = -32768, 32767


def dot_product(inputs: Column, weights: Column) -> Column:
    """Sum over neighbouring pairs of (t w + t' w') >> 8; an odd end counts alone."""
    products = F.zip_with(inputs, weights, lambda t, w: (F.coalesce(t, F.lit(0)) * F.coalesce(w, F.lit(0))).cast("long"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(inputs) - 1) / 2), F.lit(0)).cast("int")),
        lambda i: F.call_function(
            "shiftright", F.coalesce(F.get(products, 2 * i), F.lit(0)) + F.coalesce(F.get(products, 2 * i + 1), F.lit(0)), F.lit(8)
        ),
    )
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)


def dot_of(inputs: list[Column], weights: list[Column]) -> Column:
    """:func:`dot_product` of as many columns as there are."""
    products = [(t * w).cast("long") for t, w in zip(inputs, weights)]
    pairs = [sum(products[i + 1 : i + 2], products[i]) for i in range(0, len(products), 2)]
    return sum((F.call_function("shiftright", p, F.lit(8)) for p in pairs[1:]), F.call_function("shiftright", pairs[0], F.lit(8)))


def train_of(inputs: list[Column], weights: list[Column], error: Column) -> list[Column]:
    """:func:`train` of as many columns as there are."""
    half = lambda t: F.call_function("shiftright", (t.cast("long") * error * 2).cast("long"), F.lit(16)) + 1
    moved = [w + F.call_function("shiftright", half(t), F.lit(1)) for t, w in zip(inputs, weights)]
    return [F.greatest(F.lit(LOW), F.least(F.lit(HIGH), m)).cast("int") for m in moved]


def mix_of(inputs: list[Column], weight_rows: list[list[Column]], final_weights: list[Column], scale: int = 1150, final_scale: int = 240) -> Column:
    """:func:`mix` of as many columns as there are."""
    opinion = lambda row: F.call_function("shiftright", dot_of(inputs, row) * scale, F.lit(16))
    opinions = [F.greatest(F.lit(-2047), F.least(F.lit(2047), opinion(r))).cast("int") for r in weight_rows]
    return squash(F.call_function("shiftright", dot_of(opinions, final_weights) * final_scale, F.lit(16)))


def train(inputs: Column, weights: Column, error: Column) -> Column:
    """New weights: each moves by its input times the error over 2^16, rounded to nearest, and stays a 16-bit number."""

    def move(t: Column, w: Column) -> Column:
        step = F.call_function("shiftright", F.call_function("shiftright", (t * error * 2).cast("long"), F.lit(16)) + 1, F.lit(1))
        return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), w + step)).cast("int")

    return F.zip_with(inputs, weights, move)


def mix(inputs: Column, weight_rows: list[Column], final_weights: Column, scale: int = 1150, final_scale: int = 240) -> Column:
    """12-bit probability: each selected row gives one opinion, a last row weighs the opinions."""
    opinion = lambda row, s: F.call_function("shiftright", dot_product(inputs, row) * s, F.lit(16))
    opinions = F.array(*[F.greatest(F.lit(-2047), F.least(F.lit(2047), opinion(r, scale))).cast("int") for r in weight_rows])
    last = F.call_function("shiftright", dot_product(opinions, final_weights) * final_scale, F.lit(16))
    return squash(last)


def error_of(y: Column, p: Column, rate: Column) -> Column:
    """Error of a 12-bit probability times a 16-bit fixed-point rate."""
    return F.call_function("shiftright", (y * 4096 - p).cast("long") * rate, F.lit(16))


#: ``probability.direct_inputs`` of a 12-bit probability, and ``scalars.squash`` from -2047 on, as tables.
_ODDS = np.array([max(-2047, min(2047, round(256 * math.log(p / (4096 - p))))) for p in [1, *range(1, 4096)]], np.int32) >> 1
_DISTANCE = np.arange(-2048, 2048, dtype=np.int32) >> 2
_SQUASHED = np.array([max(1, min(4095, round(4096 / (1 + math.exp(-d / 256))))) for d in range(-2047, 2048)], np.int32)


def equal_step(probabilities: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p, error and the trained weights' sum of one step for many bits at once: 12-bit probabilities give two inputs each, a
    constant 256 is the last, all weights are 16384; as ``mix_of``, ``error_of`` (rate 6) and ``train_of`` give them."""
    weight, dots = 16384, np.full(len(y), 16384, np.int32)
    for p in probabilities:
        dots += ((_DISTANCE + _ODDS) * weight >> 8)[p]
    opinion = np.clip(dots.astype(np.int64) * 1150 >> 16, -2047, 2047)
    mixed = _SQUASHED[((np.arange(-2047, 2048) * weight >> 8) * 240 >> 16) + 2047][opinion + 2047]
    error = (y * 4096 - mixed) * 6
    sums = np.zeros(len(y), np.int32)
    for x in [t[p] for p in probabilities for t in (_DISTANCE, _ODDS)] + [np.int32(256)]:
        moved = x * error  # below 2^25, and doubled below 2^26
        moved <<= 1
        moved >>= 16
        moved += 1
        moved >>= 1  # at most 384 from the weight: no clipping
        sums += moved
    return mixed, error, sums + np.int32((2 * len(probabilities) + 1) * weight)
