"""Archives as binary columns and files: header, length, body.

Layout: 11 bytes of magic, 1 byte level (1 to 12), the content's length as a base-128 number, the coded body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import vli_encode

MAGIC = "bitloom-arc"


def _binary(digits: Column) -> Column:
    return F.unhex(F.array_join(F.transform(digits, lambda d: F.lpad(F.hex(d), 2, "0")), ""))


def header(level: Column, n_bytes: Column) -> Column:
    """The header as BINARY."""
    return F.concat(F.lit(MAGIC).cast("binary"), _binary(F.array(level)), _binary(vli_encode(n_bytes)))


def with_archive(df: DataFrame, body: str, n_bytes: str, level: int, out: str = "archive") -> DataFrame:
    return df.withColumn(out, F.concat(header(F.lit(level), F.col(n_bytes)), F.col(body)))


def read_header(archive: Column) -> Column:
    """struct(level, n_bytes, body_at, error) of a BINARY archive; error names what is wrong, null if nothing is."""
    digit = lambda i: F.conv(F.hex(F.substring(archive, i, 1)), 16, 10).cast("long")
    level = digit(F.lit(12)).cast("int")
    digits = F.transform(F.sequence(F.lit(13), F.lit(22)), lambda i: F.coalesce(digit(i), F.lit(0)))
    count = F.array_position(F.transform(digits, lambda d: d < 128), True).cast("int")
    parts = F.transform(F.slice(digits, F.lit(1), count), lambda d, i: F.call_function("shiftleft", d.bitwiseAND(F.lit(127)), 7 * i))
    size = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    error = (
        F.when(F.substring(archive, 1, len(MAGIC)) != F.lit(MAGIC).cast("binary"), "not an archive")
        .when(F.coalesce(level, F.lit(0)).between(1, 12) == F.lit(False), "bad level")
        .when((F.octet_length(archive) < 13) | (count == 0), "no length")
    )
    return F.struct(level.alias("level"), size.alias("n_bytes"), (count + 13).alias("body_at"), error.alias("error"))


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Opaque files: path, n_bytes, content."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("n_bytes"), "content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parquet documents with their texts as BINARY content; only the two columns are read."""
    return spark.read.parquet(path).select("doc_id", F.col("text").cast("binary").alias("content"))
