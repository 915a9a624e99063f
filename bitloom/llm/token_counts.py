"""Token counts by scanning flat token files for the end-of-document id.

A flat file is a run of unsigned 16-bit little-endian ids and nothing else: no index, no lengths, cut into blocks of
equal size anywhere, in the middle of documents too. Each block is searched for the separator with one vectorised
comparison; a document's count is the distance between successive separators. Blocks are stitched by a prefix scan:
documents ended before the block and the place of the last separator before it. The scan has two levels, inside
groups of ``GROUP_BLOCKS`` blocks and over the groups' totals, so no task sees more than one group's blocks or one
file's groups.

``write_flat`` makes such files from texts without moving them: one file per task. The ids of the documents lie beside
them, unread by the scan, to name its results.

Defined results: null and empty texts count 0 tokens (the separator isn't counted). Separator strings inside texts are
ordinary text and can't end a document. Ids after a file's last separator are an unfinished document and aren't
reported. Null and repeated ids are carried as they are. An empty table gives an empty result; other columns are never
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running_offsets, text_or_empty, tokenizer_path
from .token_files import word_encoder

SEPARATOR = 49407
BLOCK_IDS = 1 << 19
GROUP_BLOCKS = 1024
FLAT_SCHEMA = "file int, block int, payload binary, doc_ids array<long>, kind string"


def write_flat(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    separator: int = SEPARATOR,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Writes ``path``/kind=tokens (file, block, payload) and ``path``/kind=ids (file, block, doc_ids)."""
    with open(tokenizer or tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()

    def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = word_encoder(model, special_as_text=True), TaskContext.get().partitionId()
        end = np.array([separator], np.uint32)
        parts: list[np.ndarray] = []
        held = block = lists = 0

        def row(kind: str, number: int, payload: bytes | None, ids: list | None) -> pa.RecordBatch:
            columns = [[file], [number], [payload], [ids], [kind]]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string())
            names = ["file", "block", "payload", "doc_ids", "kind"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for ids in encoder.encode(part.column(1).to_pylist()):
                    parts += [ids, end]
                    held += len(ids) + 1
                yield row("ids", lists, None, part.column(0).to_pylist())
                lists += 1
                if held >= block_ids:
                    flat, whole = np.concatenate(parts).astype("<u2"), held // block_ids
                    for i in range(whole):
                        yield row("tokens", block + i, flat[i * block_ids : (i + 1) * block_ids].tobytes(), None)
                    block, parts = block + whole, [flat[whole * block_ids :].astype(np.uint32)]
                    held = len(parts[0])
        if held:
            yield row("tokens", block, np.concatenate(parts).astype("<u2").tobytes(), None)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    flat = rows.mapInArrow(blocks, FLAT_SCHEMA)
    flat.write.option("compression", "zstd").partitionBy("kind").parquet(path)


def scan(tokens: DataFrame, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """``tokens``: file, block, payload. Result: file, ordinal (of the document in its file, from 0), n_tokens."""

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                file, block, payload = (batch.column(k)[i] for k in range(3))
                found = np.flatnonzero(np.frombuffer(payload.as_buffer(), "<u2") == separator) + block.as_py() * block_ids
                columns = [[file.as_py()], [block.as_py()], [found]]
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "ends"])

    blocks = tokens.select("file", "block", "payload").mapInArrow(search, "file int, block int, ends array<long>")
    stats = blocks.select(
        "file", "block", F.floor(F.col("block") / group_blocks).alias("grp"), F.size("ends").cast("long").alias("n"),
        F.try_element_at("ends", F.lit(-1)).alias("last"), "ends",
    )
    earlier = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = stats.withColumn("n_in", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("last_in", F.max("last").over(earlier))
    groups = stats.groupBy("file", "grp").agg(F.sum("n").alias("g_n"), F.max("last").alias("g_last"))
    before = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    carried = groups.select(
        "file", "grp", F.coalesce(F.sum("g_n").over(before), F.lit(0)).alias("n_before"), F.max("g_last").over(before).alias("last_before")
    )
    stitched = inside.join(carried, ["file", "grp"]).select(
        "file",
        (F.col("n_in") + F.col("n_before")).alias("first"),
        "ends",
        F.concat(F.array(F.coalesce("last_in", "last_before", F.lit(-1).cast("long"))), F.col("ends")).alias("begins"),
    )
    spread = stitched.select("file", "first", F.posexplode(F.arrays_zip("ends", "begins")).alias("k", "z"))
    return spread.where(F.col("z.ends").isNotNull()).select(
        "file", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("z.ends") - F.col("z.begins") - 1).alias("n_tokens")
    )


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the flat files to ``path``, scans them and names the counts: doc_id, n_tokens."""
    spark: SparkSession = docs.sparkSession
    write_flat(docs, path, id_col, text_col)
    stored = spark.read.schema(FLAT_SCHEMA).parquet(path)
    counts = scan(stored.where("kind = 'tokens'"))
    # every list but a file's last has 500 ids or ends a batch; its place follows from the sizes of those before it
    ids = stored.where("kind = 'ids'")
    sizes = ids.select("file", "block", F.size("doc_ids").cast("long").alias("n"))
    lists = ids.select("file", "block", F.posexplode("doc_ids").alias("k", "doc_id"))
    named = lists.join(running_offsets(sizes, "file", "block", "n"), ["file", "block"])
    named = named.select("file", (F.col("offset") + F.col("k")).alias("ordinal"), "doc_id")
    return named.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
