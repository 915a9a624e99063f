"""What the operators of this subpackage share: reading tables, cutting lineage, public tokenizer files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..shared import cut, shared_path

__all__ = ["cut", "shared_path"]

#: ASCII white space as the contracts state it; valid in Java, Python and DuckDB patterns.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Row numbers (8 bytes) are broadcast up to the first number, wider rows up to the second.
BROADCAST_ROWS, BROADCAST_KEYS = 1 << 20, 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; read by Spark only, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_keys(docs: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """The table written to the shared folder with a unique number for each row, and the name of that column. Decisions
    taken on such numbers hold for rows, whatever ids they have, and stay the same when a task runs again."""
    name = "__row"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    path = shared_path(docs.sparkSession, kind)
    docs.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    fields = [*docs.schema.fields, StructField(name, LongType())]
    return docs.sparkSession.read.schema(StructType(fields)).parquet(path), name


def without_rows(stored: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """``stored`` without the rows that ``gone`` (one column, ``row``) names, and without that column."""
    kept = stored.join(small(gone), row, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in stored.columns if c != row])


def small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """For narrow rows that are already written: marked for broadcast when there are at most ``limit`` of them; beyond it
    Spark joins as it sees fit."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def running_offsets(sizes: DataFrame, by: str, at: str, n: str, group: int = 1024) -> DataFrame:
    """``sizes``: one row for each ``at``, a number, and ``by``. Result: ``by``, ``at`` and offset, the sum of ``n`` at
    smaller places. A prefix scan of two levels: inside groups of ``group`` places, and over the groups' sums."""
    grouped = sizes.withColumn("__group", F.floor(F.col(at) / group))
    inside = Window.partitionBy(by, "__group").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(by).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy(by, "__group").agg(F.sum(n).alias("__sum"))
    before = sums.select(by, "__group", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    own = grouped.withColumn("__inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return own.join(before, [by, "__group"]).select(by, at, (F.col("__inside") + F.col("__before")).cast("long").alias("offset"))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
