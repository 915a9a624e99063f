import random

from pyspark.sql import functions as F

from bitloom.operators import verify


def test_first_difference_of_bytes(spark):
    rng = random.Random(9)
    pairs = [(b"", b""), (None, b"a"), (b"a", None), (b"ab", b"abc"), (b"abc", b"ab"), (b"\xff", b"\xfe"), (b"\x00" * 9, b"\x00" * 8 + b"\x01")]
    for _ in range(200):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randrange(40)))
        b = a[: rng.randrange(len(a) + 1)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(4)))
        pairs.append((a, rng.choice([a, b])))
    frame = spark.createDataFrame(pairs, "a binary, b binary")
    for r in frame.withColumn("at", verify.first_difference(F.col("a"), F.col("b"))).collect():
        a, b = bytes(r.a or b""), bytes(r.b or b"")
        expected = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert r.at == (None if a == b else expected)


def test_no_array_of_bytes_is_made(spark):
    """An array of a text's bytes takes many times its size, a step of an expression for each."""
    frame = spark.createDataFrame([(1, b"x")], "doc_id long, content binary")
    plan = verify.verify(frame, frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "zip_with(" not in plan
