"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Every level works on narrow rows (about 100 bytes each, whatever the text's length) and hands on only the
rows whose key another row shares; a text leaves its task never. The narrow rows are written once to the shared
folder, so the text column is scanned and normalised a single time.

``exact_groups`` reports the SHA-256 of each text, so its scan computes it for all rows. ``drop_exact_copies`` reads the
content a second time, and hashes it, only for rows that share length and prefix hash with another row.

Defined results: a null text is the empty text. Equal texts are equal after runs of ASCII white space became one
space. Of equal texts the smallest id stays, a null id counting as largest; of repeated rows (equal id and text)
one stays. An empty table gives an empty result. Other columns are never read, so their names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, SPACE_RUN, cut, small, text_or_empty, with_row_keys, without_rows

KEYS = ["n_bytes", "head_hash", "text_sha256"]


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), SPACE_RUN, " ")


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key occurs more than once. Counts are combined before the shuffle and written, so the rows either
    meet a broadcast list or are joined in a stage of their own, which Spark splits where a key is hot."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(small(cut(counts.where("n_rows > 1").select(*keys)), BROADCAST_KEYS), keys, "left_semi")


def _survivors(rows: DataFrame) -> DataFrame:
    """Rows that share length and prefix hash with another."""
    return _shared(_shared(rows, ["n_bytes"]), ["n_bytes", "head_hash"])


def _groups(hashed: DataFrame) -> DataFrame:
    """n_bytes, head_hash, text_sha256, first (no_id, doc_id, row_uid of the row that stays) and n_rows of all groups of two
    and more."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_uid"))
    groups = hashed.groupBy(*KEYS).agg(first.alias("first"), F.count(F.lit(1)).alias("n_rows"))
    return cut(groups.where("n_rows > 1"))


def _narrow(head_chars: int) -> list[Column]:
    return [F.octet_length("norm").alias("n_bytes"), F.xxhash64(F.substring("norm", 1, head_chars)).alias("head_hash")]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and text_sha256. Since every row's digest is part of the
    result, the one scan computes it for all rows."""
    source = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    digest = F.sha2("norm", 256).alias("text_sha256")
    rows = cut(source.select("doc_id", F.monotonically_increasing_id().alias("row_uid"), *_narrow(head_chars), digest))
    groups = small(_groups(_survivors(rows)), BROADCAST_KEYS)
    return rows.join(groups, KEYS, "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n_rows", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first.row_uid") == F.col("row_uid"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = 64) -> DataFrame:
    """The input's rows and columns, one row of each set of equal texts: that of the smallest id (null ids last), and of
    rows equal in id and text the first. Content is read again and hashed only for rows that share length and prefix hash;
    what moves is narrow, and the rows that go are named by a number written with each row."""
    stored, row = with_row_keys(docs, "exact-dedup")
    source = stored.select(F.col(row).alias("row_uid"), F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    rows = cut(source.select("doc_id", "row_uid", *_narrow(head_chars)))
    survivors = cut(_survivors(rows))
    read = source.select("row_uid", "norm").join(small(survivors.select("row_uid")), "row_uid", "left_semi")
    digests = cut(read.select("row_uid", F.sha2("norm", 256).alias("text_sha256")))
    hashed = cut(survivors.join(digests, "row_uid"))
    members = hashed.join(small(_groups(hashed), BROADCAST_KEYS), KEYS)
    gone = cut(members.where(F.col("first.row_uid") != F.col("row_uid")).select(F.col("row_uid").alias(row)))
    return without_rows(stored, row, gone)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
