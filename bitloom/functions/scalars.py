"""Scalar columns over bits, bytes and integers. All are built-in expressions and stay in whole-stage code.

Nulls give null throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2^64 divided by the golden ratio, the usual multiplier of multiplicative hashing.
GOLDEN = 0x9E3779B97F4A7C15


def ilog2(x: Column) -> Column:
    """Floor of the binary logarithm; 0 for 0."""
    return F.greatest(F.length(F.bin(x)) - 1, F.lit(0))


def is_power_of_two(x: Column) -> Column:
    """True for 0 too."""
    return F.bit_count(x) <= 1


def partial_byte(b: Column, bpos: Column) -> Column:
    """The ``bpos`` bits already known of byte ``b`` behind a leading 1: 1 to 255."""
    return F.call_function("shiftright", b + 256, 8 - bpos)


def bit_at(b: Column, bpos: Column) -> Column:
    """Bit ``bpos`` of a byte, the most significant first."""
    return F.call_function("shiftright", b, 7 - bpos).bitwiseAND(F.lit(1))


def squash(d: Column) -> Column:
    """Logistic of d / 256 on a scale of 4096, from 1 to 4095."""
    inside = F.greatest(F.lit(1), F.least(F.lit(4095), F.rint(4096 / (1 + F.exp(-d / 256.0))).cast("int")))
    return F.when(d > 2047, 4095).when(d < -2047, 1).otherwise(inside)


def stretch(p: Column) -> Column:
    """Inverse of :func:`squash`: 256 times the log odds of p / 4096, between -2047 and 2047."""
    q = F.greatest(p, F.lit(1)) / 4096.0
    return F.greatest(F.lit(-2047), F.least(F.lit(2047), F.rint(256 * F.log(q / (1 - q))).cast("int")))


def update_rate(i: Column) -> Column:
    """Adaptation rate after i observations, 16384 / (2 i + 3)."""
    return F.floor(F.lit(16384) / (2 * i + 3)).cast("int")


def state_offset(bpos: Column, c0: Column) -> Column:
    """Place of a partial byte's state among the 7 of its slot. A slot begins at bits 0, 2 and 5 and holds a binary tree
    in level order: 2^j - 1 nodes above level j, then the node that the last j bits name."""
    level = bpos - F.when(bpos >= 5, 5).when(bpos >= 2, 2).otherwise(0)
    above = F.when(level == 0, 0).when(level == 1, 1).otherwise(3)
    return above + c0.bitwiseAND(above)


def multiply_wrapped(x: Column, factor: int) -> Column:
    """x times factor modulo 2^64 as a signed long; 16-bit limbs keep every product in range under ANSI mode."""
    a = [F.call_function("shiftrightunsigned", x.cast("long"), F.lit(16 * i)).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    b = [factor >> 16 * i & 0xFFFF for i in range(4)]
    carry, out = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(4):
        total = carry
        for i in range(k + 1):
            total = total + a[i] * F.lit(b[k - i]).cast("long")
        out = out.bitwiseOR(F.call_function("shiftleft", total.bitwiseAND(F.lit(0xFFFF)), F.lit(16 * k)))
        carry = F.call_function("shiftright", total, F.lit(16))
    return out


def hash_of(*parts: Column) -> Column:
    """Multiplicative hash of small non-negative integers; each position has its own odd multiplier."""
    total = F.lit(0).cast("long")
    for n, part in enumerate(parts):
        mixed = multiply_wrapped(part + 1, (GOLDEN * (2 * n + 1)) % (1 << 64) | 1)
        total = total.bitwiseXOR(mixed)
    return total


def top_bits(h: Column, bits: int) -> Column:
    """The highest ``bits`` bits of a hash, for a table index."""
    return F.call_function("shiftrightunsigned", h, F.lit(64 - bits))


def check_bits(h: Column, bits: int, width: int = 16) -> Column:
    """The ``width`` bits below the index bits, for a checksum."""
    return F.call_function("shiftrightunsigned", h, F.lit(64 - bits - width)).bitwiseAND(F.lit((1 << width) - 1))


def vli_encode(n: Column) -> Column:
    """Little-endian base-128 digits of a non-negative long; all but the last have 128 added. array<int>."""
    digits = F.ceil(F.length(F.bin(n)) / F.lit(7.0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), digits - 1),
        lambda i: (
            F.call_function("shiftright", n.cast("long"), 7 * i).bitwiseAND(F.lit(127)) + F.when(i < digits - 1, 128).otherwise(0)
        ).cast("int"),
    )


def vli_decode(digits: Column) -> Column:
    """The number whose digits :func:`vli_encode` made; digits after the last one are ignored."""
    last = F.array_position(F.transform(digits, lambda d: d < 128), True)
    used = F.slice(digits, F.lit(1), last.cast("int"))
    indexed = F.transform(used, lambda d, i: F.call_function("shiftleft", d.cast("long").bitwiseAND(F.lit(127)), 7 * i))
    return F.aggregate(indexed, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def vli_length(n: Column) -> Column:
    return F.ceil(F.length(F.bin(n)) / F.lit(7.0)).cast("int")
