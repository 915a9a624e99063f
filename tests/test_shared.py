import os

from bitloom import shared


def test_written_tables_are_deleted_since_a_mark(spark):
    first = shared.shared_path(spark, "a")
    spark.range(3).write.parquet(first)
    mark = shared.written()
    paths = [shared.shared_path(spark, "b") for _ in range(3)]
    for path in paths:
        spark.range(3).write.parquet(path)
    there = lambda path: os.path.isdir(path.removeprefix("file:"))
    shared.delete_written(spark, mark, keep=(paths[1],))
    assert [there(p) for p in [first, *paths]] == [True, False, True, False] and shared.written() == mark + 1


def test_release_leaves_nothing_and_work_goes_on(spark):
    held = shared.cut(spark.range(5))
    assert held.count() == 5
    path, root = shared.shared_path(spark, "c"), shared.shared_root(spark)
    spark.range(3).write.parquet(path)
    shared.release(spark)
    assert not os.path.isdir(root.removeprefix("file:")) and shared.written() == 0
    assert shared.cut(spark.range(5)).count() == 5 and shared.shared_root(spark) != root
