import math

import pytest
from pyspark.sql import functions as F

from bitloom.functions import paths, scalars

GOLDEN = scalars.GOLDEN


def values(spark, numbers, **columns):
    return spark.createDataFrame([(n,) for n in numbers], "x long").select("x", *[c.alias(k) for k, c in columns.items()]).collect()


def test_integer_functions(spark):
    x = F.col("x")
    for r in values(spark, [0, 1, 2, 3, 4, 255, 256, 2**62], log=scalars.ilog2(x), power=scalars.is_power_of_two(x), rate=scalars.update_rate(x % 1024)):
        assert r.log == (r.x.bit_length() - 1 if r.x else 0)
        assert r.power == (r.x & (r.x - 1) == 0)
        assert r.rate == 16384 // (2 * (r.x % 1024) + 3)


def test_logistic_pair(spark):
    x = F.col("x")
    for r in values(spark, range(-2100, 2101, 7), s=scalars.squash(x)):
        expected = 1 if r.x < -2047 else 4095 if r.x > 2047 else min(4095, max(1, round(4096 / (1 + math.exp(-r.x / 256)))))
        assert r.s == expected
    for r in values(spark, range(0, 4096, 5), s=scalars.stretch(x), back=scalars.squash(scalars.stretch(x))):
        p = max(r.x, 1) / 4096
        assert abs(r.s - max(-2047, min(2047, 256 * math.log(p / (1 - p))))) <= 0.5 + 1e-9
        assert abs(r.back - r.x) <= 3


def test_state_offsets_tile_a_slot(spark):
    rows = spark.sql("select explode(sequence(0, 255)) b").crossJoin(spark.sql("select explode(sequence(0, 7)) k"))
    c0 = F.call_function("shiftright", F.col("b") + 256, 8 - F.col("k"))
    seen = rows.select("k", c0.alias("c0")).distinct().select("k", "c0", scalars.state_offset(F.col("k"), F.col("c0")).alias("o")).collect()
    for begin, end in ((0, 2), (2, 5), (5, 8)):
        places = {}
        for r in seen:
            if begin <= r.k < end:
                places.setdefault(r.c0 >> (r.k - begin), {})[(r.k, r.c0)] = r.o
        assert all(sorted(p.values()) == list(range(2 ** (end - begin) - 1)) for p in places.values())


def test_wrapped_multiplication(spark):
    numbers = [0, 1, 3, 65535, 2**31, 2**53 + 7, 2**63 - 1, -1, -(2**63)]
    for r in values(spark, numbers, m=scalars.multiply_wrapped(F.col("x"), GOLDEN), t=scalars.top_bits(scalars.multiply_wrapped(F.col("x"), GOLDEN), 24)):
        product = r.x * GOLDEN % 2**64
        assert r.m % 2**64 == product and r.t == product >> 40


def test_length_codes(spark):
    numbers = [0, 1, 127, 128, 16383, 16384, 2**32, 2**63 - 1]
    for r in values(spark, numbers, d=scalars.vli_encode(F.col("x")), back=scalars.vli_decode(scalars.vli_encode(F.col("x"))), n=scalars.vli_length(F.col("x"))):
        assert r.back == r.x and len(r.d) == r.n == max(1, -(-r.x.bit_length() // 7))
        assert sum((d & 127) << 7 * i for i, d in enumerate(r.d)) == r.x and all(d > 127 for d in r.d[:-1]) and r.d[-1] < 128


@pytest.mark.parametrize(
    ("path", "file", "folder", "kind"),
    [("a/b/c.txt", "c.txt", "a/b/", "file"), ("c", "c", "", "file"), ("a\\b", "b", "a\\", "file"), ("a/b\\c", "b\\c", "a/", "file"), ("a/", "", "a/", "folder"), ("", "", "", "invalid")],
)
def test_paths(spark, path, file, folder, kind):
    p = F.lit(path)
    r = spark.range(1).select(paths.file_part(p).alias("a"), paths.folder_part(p).alias("b"), paths.path_kind(p).alias("c"), paths.original_name(paths.archive_name(p)).alias("d"), paths.original_name(p).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (file, folder, kind, file.split("\\")[-1], None)
