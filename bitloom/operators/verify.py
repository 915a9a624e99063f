"""Comparison of two versions of a content: identical, different at a byte, or one longer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_difference(left: Column, right: Column) -> Column:
    """Position (from 0) of the first byte that differs, the shorter one's length if it is a prefix of the other, null
    if they are equal. Nulls count as empty. The longest common prefix is found by halving: each step compares half as many
    bytes as the one before, so all of them read a text some two times."""
    a, b = (F.coalesce(c.cast("binary"), F.lit(b"")) for c in (left, right))
    shorter = F.least(F.octet_length(a), F.octet_length(b))

    def halve(s: Column, _: Column) -> Column:  # the first s.low bytes are equal, and at most s.high are
        gap = F.call_function("shiftright", s["high"] - s["low"] + 1, F.lit(1))
        equal = F.substring(a, s["low"] + 1, gap) == F.substring(b, s["low"] + 1, gap)
        low, high = F.when(equal, s["low"] + gap).otherwise(s["low"]), F.when(equal, s["high"]).otherwise(s["low"] + gap - 1)
        return F.struct(low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0).alias("low"), shorter.alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(shorter))), start, halve, lambda s: s["low"])
    return F.when(a != b, found)


def verdict(original: Column, decoded: Column, at: Column | None = None) -> Column:
    """What a comparison reports when ``decoded`` is checked against ``original``; ``at``: their first difference, if known."""
    at = first_difference(original, decoded) if at is None else at
    n, m = (F.octet_length(F.coalesce(c, F.lit(""))) for c in (original, decoded))
    return (
        F.when(at.isNull(), F.lit("identical"))
        .when((at == m) & (n > m), F.lit("original is longer"))
        .otherwise(F.concat(F.lit("differ at "), at.cast("string")))
    )


def verify(archive: DataFrame, originals: DataFrame, key: str = "doc_id", decoded_col: str = "content", original_col: str = "content") -> DataFrame:
    """``key``, verdict, first_diff for every row of either side; a row that only one side has is compared with nothing."""
    a = archive.select(key, F.col(decoded_col).alias("__decoded"), F.lit(True).alias("__in_a"))
    b = originals.select(key, F.col(original_col).alias("__original"), F.lit(True).alias("__in_b"))
    both = a.join(b, key, "full_outer")
    absent = F.when(F.col("__in_a").isNull(), "no archive").when(F.col("__in_b").isNull(), "no original")
    found = both.withColumn("__at", first_difference(F.col("__original"), F.col("__decoded")))
    reported = F.coalesce(absent, verdict(F.col("__original"), F.col("__decoded"), F.col("__at")))
    return found.select(key, reported.alias("verdict"), F.col("__at").cast("long").alias("first_diff"))
