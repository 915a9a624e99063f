import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitloom.operators import folds, probability, statistics
from bitloom.operators.bytestream import bit_positions, bit_streams
from bitloom.plans import queries


@pytest.fixture()
def texts(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice("ab é€😀,") for _ in range(rng.randrange(0, 300))) for _ in range(40)]
    rows = list(enumerate([*made, None, "", "a", "zz" * 900]))
    return spark.createDataFrame(rows, "doc_id int, text string").repartition(2)


@pytest.mark.parametrize("context,limit", [("none", 4), ("byte", 32), ("character", 1023), ("raw", 7)])
@pytest.mark.parametrize("span", [1 << 10, 1 << 22])
def test_bit_folds_equal_the_folds_of_each_stream(texts, monkeypatch, context, limit, span):
    monkeypatch.setattr(folds, "_SPAN", span)
    m, s = probability.capped_fold(F.col("ys"), limit), statistics.history_fold(F.col("ys"))
    streams = bit_streams(texts, context).select("c0", F.size("ys").alias("n"), m.alias("m"), s.alias("s"))
    sums = [F.sum(c).cast("long") for c in ("n", "m.p", "m.n", "s.n0", "s.n1")]
    expected = streams.groupBy("c0").agg(F.count(F.lit(1)), *sums)
    found = folds.bit_folds(texts, [(context, limit)], history_limit=40).drop("fold")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_mixed_steps_count_what_bit_positions_count(texts):
    rows = bit_positions(texts, ("none", "raw")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()
    found = {r.doc_id: (r.n_bits, r.n_ones) for r in folds.mixed_steps(texts, ("none", "raw")).collect()}
    assert found == {r.doc_id: (r.n, r.y) for r in rows}


def test_spans_hold_every_text_once():
    texts = [bytes([65 + i % 26]) * (i * 7 % 50) for i in range(100)]
    seen = {}
    for values, starts, rows in folds.spans(pa.array(texts, pa.binary())):
        for row, text in zip(rows.tolist(), (values[s:e].tobytes() for s, e in zip(starts, [*starts[1:], len(values)]))):
            seen[row] = text
    assert seen == {i: t for i, t in enumerate(texts) if t}


def test_estimates_of_no_texts(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.capped_estimates(spark, str(tmp_path)).orderBy("context_order").collect()
    assert [tuple(r) for r in out] == [(k, 0, None, None, None) for k in range(3)]


def test_bits_leave_tasks_as_sums(spark, texts, tmp_path):
    """No row or array of bits reaches the JVM: nothing is folded by expressions."""
    texts.withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    for query in (queries.capped_estimates, queries.bit_histories, queries.mixed_predictions):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan and " ys#" not in plan and plan.count("MapInArrow") == 1


def test_distinct_contexts_by_hand(texts):
    n, d = 0, [0, 0, 0]
    for r in texts.collect():
        data = b"\0\0\0" + (r.text or "").encode()
        n += len(data) - 3
        for k in (1, 2, 3):
            d[k - 1] += len({data[i - k : i] for i in range(3, len(data))})
    assert tuple(folds.distinct_contexts(texts).first()) == (n, *d)


def test_active_orders_shuffle_no_contexts(spark, texts, tmp_path):
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.active_orders(spark, str(tmp_path))
    assert "Aggregate [doc_id" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.n_positions for r in out.collect()) == sum(len((r.text or "").encode()) for r in texts.collect())
