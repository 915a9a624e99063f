"""Statistics of contexts: entropies, runs, last bytes, confidence, bit histories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conditional_entropy(counts: DataFrame, context: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, n_bytes, n_contexts, bits_per_byte, from byte counts. Totals of a context come from a grouped sum."""
    per = counts.groupBy(*by, *context).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    bits = F.col("total") * F.log2("total") - F.col("nlogn")
    return per.groupBy(*by).agg(
        F.sum("total").alias("n_bytes"), F.count(F.lit(1)).alias("n_contexts"), (F.sum(bits) / F.sum("total")).alias("bits_per_byte")
    )


def run_rows(rows: DataFrame, context: tuple[str, ...], cap: int = 255) -> DataFrame:
    """Byte rows with run (length so far of the same byte in this context, at most ``cap``), byte1, byte2 and byte3 (the
    bytes of this run and the two before it; the first byte seen where there is none)."""
    ordered = Window.partitionBy("doc_id", *context).orderBy("pos")
    whole = ordered.rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce((F.lag("b").over(ordered) != F.col("b")).cast("int"), F.lit(1))
    marked = rows.withColumn("__before", F.lag("b").over(ordered)).withColumn("__new", new)
    marked = marked.withColumn("__run", F.sum("__new").over(whole)).withColumn("__first", F.first("b").over(whole))
    island = Window.partitionBy("doc_id", *context, "__run").orderBy("pos")
    marked = marked.withColumn("run", F.least(F.row_number().over(island), F.lit(cap)))
    marked = marked.withColumn("byte2", F.coalesce(F.first("__before").over(island), F.col("__first")))
    marked = marked.withColumn("__older", F.lag("byte2").over(ordered))
    marked = marked.withColumn("byte3", F.coalesce(F.first("__older").over(island), F.col("__first")))
    return marked.select(*rows.columns, "run", F.col("b").alias("byte1"), "byte2", "byte3")


def run_histogram(df: DataFrame, content: str = "text", cap: int = 255) -> DataFrame:
    """run, n: final lengths of the runs of equal bytes that follow each byte of a text. A text's runs are found where
    it is read, by one stable sort of its positions by the byte before, so nothing but the histogram is shuffled."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            total = np.zeros(cap + 1, np.int64)
            for value in batch.column(0):
                b = np.frombuffer(value.as_buffer(), np.uint8)
                if len(b):
                    before = np.concatenate([[0], b[:-1]])
                    order = np.argsort(before, kind="stable")
                    heads = np.flatnonzero((np.diff(before[order], prepend=-1) != 0) | (np.diff(b[order].astype(int), prepend=-1) != 0))
                    total += np.bincount(np.minimum(np.diff(heads, append=len(b)), cap), minlength=cap + 1)
            runs = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(runs.astype(np.int32)), pa.array(total[runs])], names=["run", "n"])

    found = df.select(F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("c")).mapInArrow(batches, "run int, n long")
    return found.groupBy("run").agg(F.sum("n").alias("n"))


def last_runs(df: DataFrame, content: str = "text", keep: str = "doc_id", cap: int = 255) -> DataFrame:
    """``keep``, c1, run, byte1, byte2, byte3: for each text and byte before, the state of :func:`run_rows` after its last
    position. Found where a text is read, as in :func:`run_histogram`."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                b = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8).astype(np.int32)
                if not len(b):
                    continue
                before = np.concatenate([[0], b[:-1]])
                order = np.argsort(before, kind="stable")
                context, byte = before[order], b[order]
                heads = np.flatnonzero((np.diff(context, prepend=-1) != 0) | (np.diff(byte, prepend=-1) != 0))
                run, context, byte = np.minimum(np.diff(heads, append=len(b)), cap), context[heads], byte[heads]
                last = np.flatnonzero(np.diff(context, append=-1))
                first = np.concatenate([[0], last[:-1] + 1])
                older = [byte[np.where(last - k >= first, last - k, first)] for k in (1, 2)]
                own = pa.repeat(batch.column(0)[i], len(last))
                columns = [context[last], run[last], byte[last], *older]
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c.astype(np.int32)) for c in columns)], names=[keep, "c1", "run", "byte1", "byte2", "byte3"])

    kind = df.schema[keep].dataType.simpleString()
    rows = df.select(keep, F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("c"))
    return rows.mapInArrow(batches, f"`{keep}` {kind}, c1 int, run int, byte1 int, byte2 int, byte3 int")


def confidence_digit(distinct: Column) -> Column:
    """0 unseen, 1 deterministic, 2 mixed, by the number of different successors."""
    return F.when(F.coalesce(distinct, F.lit(0)) == 0, 0).when(distinct == 1, 1).otherwise(2)


def confidence_code(digits: list[Column]) -> Column:
    """The digits of several orders as one base-3 number, the first order the most significant."""
    return F.aggregate(F.array(*digits), F.lit(0), lambda a, d: a * 3 + d)


def history_table(limit: int = 40) -> list[int]:
    """The next state for (state, bit) at 2 * state + bit; a state is n0 * (limit + 1) + n1. A bit raises its own count up to
    ``limit``; when the other count is above 2, part of it is forgotten: it falls to 2 plus a third of the rest."""
    faded = [n if n <= 2 else (n - 2) // 3 + 2 for n in range(limit + 1)]
    raised = [min(n + 1, limit) for n in range(limit + 1)]
    pairs = [(n0, n1) for n0 in range(limit + 1) for n1 in range(limit + 1)]
    return [s for n0, n1 in pairs for s in (raised[n0] * (limit + 1) + faded[n1], faded[n0] * (limit + 1) + raised[n1])]


def history_fold(ys: Column, limit: int = 40) -> Column:
    """struct(n0, n1): the bounded counts a history state stands for after an ordered array of bits."""
    table = F.array(*[F.lit(s) for s in history_table(limit)])
    state = F.aggregate(ys, F.lit(0), lambda s, y: F.get(table, s * 2 + y))
    return F.struct(F.floor(state / (limit + 1)).cast("int").alias("n0"), (state % (limit + 1)).cast("int").alias("n1"))


def bit_history(bits: DataFrame, keys: tuple[str, ...], order_col: str = "pos", limit: int = 40) -> DataFrame:
    """``keys``, n0, n1 after all bits of a key in order: one ordered fold per key, whose bits are gathered in one row
    (texts use ``bytestream.bit_streams``, which needs no shuffle)."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col("y").alias("y"))))
    grouped = bits.groupBy(*keys).agg(F.transform(ordered, lambda e: e["y"]).alias("__bits"))
    return grouped.select(*keys, history_fold(F.col("__bits"), limit).alias("s")).select(*keys, "s.n0", "s.n1")


def active_orders(seen: list[Column]) -> Column:
    """How many orders have met their context before."""
    return F.aggregate(F.array(*[F.coalesce(s.cast("int"), F.lit(0)) for s in seen]), F.lit(0), lambda a, x: a + x)
