from collections import Counter

from bitloom.operators.bytestream import byte_counts
from bitloom.streaming import incremental


def test_counts_over_two_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    (tmp_path / "src").mkdir()
    schema = "doc_id long, text string"
    texts = ["abca", "bé", "", None]
    results = {}
    stream = spark.readStream.schema(schema).parquet(src)
    for n in range(2):
        spark.createDataFrame([(n * 10 + i, t) for i, t in enumerate(texts)], schema).coalesce(1).write.mode("append").parquet(src)
        writer = incremental.streaming_byte_counts(stream, order=1).writeStream.outputMode("complete").trigger(availableNow=True)
        query = writer.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: results.update(last=b.collect())).start()
        query.awaitTermination()
    batch = byte_counts(spark.read.schema(schema).parquet(src), 1).collect()
    assert {(r.b, r.c1): r.n for r in results["last"]} == {(r.b, r.c1): r.n for r in batch}


def test_runs_keep_state(spark, tmp_path):
    src = str(tmp_path / "src")
    (tmp_path / "src").mkdir()
    schema = "k string, o long, v string"
    seen = {}
    stream = spark.readStream.schema(schema).parquet(src)
    for rows in ([("x", 1, "a"), ("x", 2, "a"), ("y", 1, "b")], [("x", 4, "c"), ("x", 3, "a"), ("y", 2, "b")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        runs = incremental.streaming_runs(stream, "k", "o", "v").writeStream.outputMode("update").trigger(availableNow=True)
        keep = lambda b, _: seen.update({r.key: (r.value, r.run, r.at) for r in b.collect()})
        runs.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).start().awaitTermination()
        if len(rows) and rows[0][2] == "a":
            assert seen == {"x": ("a", 2, 2), "y": ("b", 1, 1)}
    assert seen == {"x": ("c", 1, 4), "y": ("b", 2, 2)}


def test_windowed_counts_on_a_batch(spark):
    rows = spark.sql("select timestamp '2024-01-01 00:10:00' t, 'a' k union all select timestamp '2024-01-01 00:50:00', 'a'")
    assert Counter({(r.k, r.n) for r in incremental.windowed_counts(rows, "t", "k").collect()}) == {("a", 2): 1}
