"""The folder that driver and executors share, and what this application leaves there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one is made only where that is unset and Spark is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new name for a written table in the shared folder."""
    path = f"{shared_root(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(frame: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, from files in the shared folder: a lost executor costs no recomputation."""
    shared_root(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written() -> int:
    """How many tables were written so far; a mark for :func:`delete_written`."""
    return len(_written)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def delete_written(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables written since a mark, but for those to keep. For a caller whose result no longer reads them."""
    gone = [path for path in _written[since:] if path not in keep]
    for path in gone:
        _delete(spark, path)
        _written.remove(path)


def release(spark: SparkSession) -> None:
    """Deletes the checkpoints and written tables of this application. For callers that have read or stored their results;
    frames that still depend on them can't be computed afterwards."""
    root = spark.sparkContext.getCheckpointDir()
    for path in [*_written, *([root] if root else [])]:
        _delete(spark, path)
    _written.clear()
    if root:  # Spark's own folder under the one that was named: a new one takes its place
        spark.sparkContext.setCheckpointDir(root.rstrip("/").rsplit("/", 1)[0])
