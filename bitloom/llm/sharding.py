"""Sharding by a two-pass external shuffle.

One scan counts the rows and bytes of ``SLOTS`` ranges of a seeded hash over id and text. Pass 1 scatters the rows: a
partition takes consecutive slots, and inside it a second hash deals the rows into buckets of about ``bucket_bytes``, which
Spark's sort, that spills, brings together in a canonical order. Pass 2 takes one bucket at a time into memory, applies a
seeded Fisher-Yates shuffle and writes it. Since the rows of each partition are counted beforehand, a row's place in the
whole shuffled order is known when it is written: shards are equal ranges of that order, their row counts differ by one
at most (the law ``rows``).

What the driver learns and tasks are given is one number for each partition, ``SLOTS`` at most and as many again for hot
slots, whatever the table's size.

Rows equal in id and text share a slot. A slot that holds more than four times a partition's share is split by a number
that is then written with each row, so no task takes it whole; a bucket that outgrows ``HELD`` times its size is shuffled in pieces.
Otherwise the order depends on the seed, the rows and the number of partitions alone, not on timing, and a recomputed
task writes the same rows again.

Defined results: null texts have size 1 and the crc32 of the empty text. Null and repeated ids spread by their texts. An
empty table gives no shards. A row is carried whole in the struct column ``row``, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import text_or_empty, with_row_keys

SLOTS = 1 << 16
BUCKET_BYTES = 16 << 20
PARTITION_BYTES = 256 << 20
HELD = 4


def _fisher_yates(count: int, rng: np.random.Generator) -> np.ndarray:
    order = np.arange(count)
    picks = rng.integers(0, np.arange(count, 0, -1)) if count else order
    for i, pick in zip(range(count - 1, 0, -1), picks.tolist()):
        order[i], order[pick] = order[pick], order[i]
    return order


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_or_empty(text_col)))


def size_of(text_col: str) -> Column:
    return (F.octet_length(text_or_empty(text_col)) + 1).cast("long")


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = 8,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    partition_bytes: int = PARTITION_BYTES,
) -> None:
    """Writes ``path``/shard=N with the columns row (the input's row as a struct) and slot (gapless from 0 in each shard)."""
    slot = F.pmod(_hash(id_col, text_col, seed), F.lit(SLOTS)).cast("int").alias("slot")
    sized = docs.select(slot, size_of(text_col).alias("size"))
    counts = sized.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()  # SLOTS rows at most
    rows, total = sum(r["n"] for r in counts), sum(r["size"] for r in counts)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(SLOTS, max(least, -(-total // partition_bytes)))
    share = max(total // parts, bucket_bytes)
    chunks = {r["slot"]: -(-r["size"] // share) for r in counts if r["size"] > 4 * share}
    first_chunk, after = {}, parts
    for s in sorted(chunks):
        first_chunk[s], after = after, after + chunks[s]
    per_part = np.zeros(after, np.int64)
    for r in counts:
        if r["slot"] not in chunks:
            per_part[r["slot"] * parts // SLOTS] += r["n"]
    columns, place = docs.columns, F.lit(0).alias("place")
    target = F.floor(F.col("slot") * parts / SLOTS).cast("int")
    if chunks:  # a number written with each row is the same in every job
        docs, name = with_row_keys(docs, "sharding")
        place = F.col(name).alias("place")
        hot = F.create_map(*[F.lit(x) for s in chunks for x in (s, chunks[s])])
        begin = F.create_map(*[F.lit(x) for s in chunks for x in (s, first_chunk[s])])
        split = F.pmod(F.col("place"), hot[F.col("slot")]) + begin[F.col("slot")]
        target = F.coalesce(split.cast("int"), target)
        dealt = docs.select(slot, place).where(F.col("slot").isin(*chunks)).groupBy(target.alias("part")).agg(F.count(F.lit(1)).alias("n"))
        for r in dealt.collect():
            per_part[r["part"]] = r["n"]
    offsets = np.cumsum(per_part) - per_part

    fine = max(1, -(-share // bucket_bytes))
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    keyed = docs.select(
        whole.alias("row"), slot, place, F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"),
        F.pmod(F.xxhash64(_hash(id_col, text_col, seed), F.lit(1)), F.lit(fine)).cast("int").alias("bucket"),
    )
    placed = keyed.select("row", "id", "text", "bucket", target.alias("part")).repartitionById(after, F.col("part"))
    ordered = placed.sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "text").select("row", "part", "bucket")

    def shuffle(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        pieces = done = size = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, pieces, done
            table = pa.Table.from_batches(held)
            order = _fisher_yates(table.num_rows, np.random.default_rng([seed, *at, pieces]))
            here = np.int64(offsets[at[0]]) + done
            for i in range(0, len(order), 2000):
                taken = table.select(["row"]).take(pa.array(order[i : i + 2000]))
                spot = here + np.arange(i, i + taken.num_rows)
                shard = np.array([int(x) * shards // rows for x in spot.tolist()], np.int32)
                begins = np.array([-(-s * rows // shards) for s in range(shards)], np.int64)
                numbered = taken.append_column("shard", pa.array(shard)).append_column("slot", pa.array(spot - begins[shard]))
                yield from numbered.combine_chunks().to_batches()
            held, size, pieces, done = [], 0, pieces + 1, done + len(order)

        for batch in source:
            if not batch.num_rows:
                continue
            part, bucket = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1])) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                name = (int(part[s]), int(bucket[s]))
                if held and (name != at or size > HELD * bucket_bytes):
                    yield from out()
                if at is None or name[0] != at[0]:
                    done = 0
                if name != at:
                    pieces = 0
                at = name
                held.append(batch.slice(s, e - s))
                size += held[-1].get_total_buffer_size() * (e - s) // batch.num_rows
        if held:
            yield from out()

    schema = StructType([ordered.schema["row"], StructField("shard", IntegerType()), StructField("slot", LongType())])
    ordered.mapInArrow(shuffle, schema).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, row: StructType) -> DataFrame:
    """row, slot, shard; ``row``: the schema of the table that was written."""
    fields = [StructField("row", row), StructField("slot", LongType()), StructField("shard", IntegerType())]
    return spark.read.schema(StructType(fields)).parquet(path)
