"""Texts as relations of bytes and bits.

As rows, a text's UTF-8 bytes are read as Latin-1 characters, one per byte, which Spark splits and explodes in generated
code; history columns come from the same array shifted, so no window, sort or shuffle is needed to know the bytes before.
Counts don't need rows: whole batches of texts become arrays of keys and leave their task as counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a task counts at once.
_SPAN = 1 << 22


def byte_chars(content: Column) -> Column:
    """array<string>: one Latin-1 character per byte; empty for null and empty content."""
    latin = F.decode(F.coalesce(content.cast("binary"), F.lit(b"")), "ISO-8859-1")
    return F.when(F.length(latin) == 0, F.array().cast("array<string>")).otherwise(F.split(latin, ""))


def byte_rows(df: DataFrame, content: str = "text", keep: tuple[str, ...] = ("doc_id",), history: int = 0) -> DataFrame:
    """``keep``, pos (from 0), b and c1 .. c``history`` as characters; null where a text has no such byte yet."""
    split = df.select(*keep, byte_chars(F.col(content)).alias("__a"))
    none = F.lit(None).cast("string")
    arrays = [F.col("__a").alias("b")]
    for k in range(1, history + 1):
        arrays.append(F.concat(F.array(*[none] * k), F.col("__a")).alias(f"c{k}"))
    spread = split.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "z")).where(F.col("z.b").isNotNull())
    return spread.select(*keep, "pos", *[F.col(f"z.{c}").alias(c) for c in ["b", *(f"c{k}" for k in range(1, history + 1))]])


def code(char: Column) -> Column:
    """A byte's value; 0 where there is none, as in a history that begins empty."""
    return F.coalesce(F.ascii(char), F.lit(0))


def to_bytes(df: DataFrame, content: str = "text", keep: tuple[str, ...] = ("doc_id",), history: int = 0) -> DataFrame:
    """As :func:`byte_rows`, with integers 0 to 255."""
    rows = byte_rows(df, content, keep, history)
    return rows.select(*keep, "pos", *[code(F.col(c)).alias(c) for c in rows.columns if c not in (*keep, "pos")])


def to_bits(rows: DataFrame) -> DataFrame:
    """Eight rows for each byte row, most significant bit first: its columns, bpos, y and c0 (bits before, after a 1)."""
    bits = rows.withColumn("bpos", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return bits.withColumn("y", F.call_function("shiftright", F.col("b"), 7 - F.col("bpos")).bitwiseAND(F.lit(1))).withColumn(
        "c0", F.call_function("shiftright", F.col("b") + 256, 8 - F.col("bpos"))
    )


def _keys(values: np.ndarray, starts: np.ndarray, order: int, at: int, end: int) -> np.ndarray:
    """For positions ``at`` to before ``end`` of texts laid end to end: the byte in the lowest 8 bits, the ``order`` bytes
    before it in those above, 0 where a text has none. ``starts``: where each position's text begins."""
    key = values[at:end].astype(np.uint64)
    for k in range(1, order + 1):
        earlier = values[np.maximum(np.arange(at, end) - k, 0)].astype(np.uint64)
        key |= np.where(np.arange(at, end) - k >= starts, earlier, 0) << np.uint64(8 * k)
    return key


def byte_counts(df: DataFrame, order: int = 0, content: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, b, c1 .. c``order`` (up to 4) and n: how often each byte follows each context. Texts are counted where they
    are read, a batch of them at a time and ``_SPAN`` bytes at once; only counts of distinct contexts are shuffled."""
    names = ["b", *(f"c{k}" for k in range(1, order + 1))]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            *groups, texts = batch.columns
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.frombuffer(b"".join(x.as_buffer() for x in texts), np.uint8) if batch.num_rows else np.empty(0, np.uint8)
            seen: dict[tuple, int] = {}
            rows = list(zip(*(g.to_pylist() for g in groups))) if groups else [()] * batch.num_rows
            code = np.fromiter((seen.setdefault(r, len(seen)) for r in rows), np.int64, len(rows))
            ends = np.cumsum(lengths)
            for at in range(0, len(values), _SPAN):
                end = min(at + _SPAN, len(values))
                first, last = np.searchsorted(ends, at, "right"), np.searchsorted(ends, end - 1, "right")
                spans = np.minimum(ends[first : last + 1], end) - np.maximum(ends[first : last + 1] - lengths[first : last + 1], at)
                begins = np.repeat(ends[first : last + 1] - lengths[first : last + 1], spans)
                key = _keys(values, begins, order, at, end)
                if by:
                    key |= np.repeat(code[first : last + 1], spans).astype(np.uint64) << np.uint64(8 * order + 8)
                if order < 2 and len(seen) << 8 * order + 8 <= 1 << 22:
                    total = np.bincount(key.astype(np.int64))
                    found = np.flatnonzero(total).astype(np.uint64)
                    total = total[found.astype(np.int64)]
                else:
                    found, total = np.unique(key, return_counts=True)
                named = (found >> np.uint64(8 * order + 8)).astype(np.int64)
                kinds = list(seen)
                columns = [pa.array([kinds[i][g] for i in named.tolist()], groups[g].type) for g in range(len(by))]
                columns += [pa.array((found >> np.uint64(8 * k) & np.uint64(255)).astype(np.int32)) for k in range(order + 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total.astype(np.int64))], names=[*by, *names, "n"])

    if order > 4:
        raise ValueError("at most four bytes of history fit a key")
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by] + [f"{c} int" for c in names] + ["n long"]
    bytes_of = F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("__content")
    return df.select(*by, bytes_of).mapInArrow(batches, ", ".join(kinds)).groupBy(*by, *names).agg(F.sum("n").alias("n"))


def bit_counts(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by``, c0, n0, n1 from byte counts: bytes are summed first and expanded to their eight nodes after."""
    nodes = to_bits(counts)
    return nodes.groupBy(*by, "c0").agg(
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1")
    )


def _bit_contexts(values: np.ndarray, context: str) -> np.ndarray:
    """A number for what precedes each byte of a text: nothing ("none"), the byte before ("raw"), the same but within a
    character its state ("byte"), or the character that the byte before belongs to as far as it goes ("character")."""
    if context == "none":
        return np.zeros(len(values), np.int64)
    padded = np.concatenate([np.zeros(4, np.int64), values.astype(np.int64)])
    return context_of(*(padded[4 - k : 4 - k + len(values)] for k in (1, 2, 3, 4)), context)


def context_of(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, c4: np.ndarray, context: str) -> np.ndarray:
    """The context that follows from the four bytes before; it is the byte before unless that continues a character."""
    inside = lambda c: (c >= 128) & (c < 192)
    if context == "raw":
        return c1
    if context == "byte":
        left = np.select([c2 >= 240, c2 >= 224, c2 >= 192, c3 >= 240], [2, 1, 0, 1], 0)
        return np.where(inside(c1), 128 + left, c1)
    two, three = c2 << 8 | c1, c3 << 16 | c2 << 8 | c1
    return np.select([~inside(c1), ~inside(c2), ~inside(c3)], [c1, two, three], c4 << 24 | three)


def bit_streams(df: DataFrame, context: str = "none", content: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep``, ctx, c0 and ys: for each text, context (see ``_bit_contexts``) and partial byte the bits in their order. A text's bits are dealt out where it is read, one level of the
    byte at a time, by a stable sort of its positions; nothing is shuffled."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                values = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                before = _bit_contexts(values, context)
                for level in range(8 if len(values) else 0):
                    key = before << 8 | (values.astype(np.int64) + 256) >> (8 - level)
                    order = np.argsort(key, kind="stable")
                    edges = np.flatnonzero(np.diff(key[order], prepend=-1))
                    bits = (values[order] >> (7 - level) & 1).astype(np.int8)
                    ys = pa.ListArray.from_arrays(pa.array(np.append(edges, len(key)).astype(np.int32)), pa.array(bits))
                    first = key[order[edges]]
                    own = pa.repeat(batch.column(0)[i], len(edges))
                    columns = [own, pa.array(first >> 8), pa.array((first & 255).astype(np.int32)), ys]
                    yield pa.RecordBatch.from_arrays(columns, names=[keep, "ctx", "c0", "ys"])

    kind = df.schema[keep].dataType.simpleString()
    rows = df.select(keep, F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("__content"))
    return rows.mapInArrow(batches, f"`{keep}` {kind}, ctx long, c0 int, ys array<tinyint>")


def bit_positions(df: DataFrame, contexts: tuple[str, ...], content: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep``, y and, for each context in turn, n_0, ones_0, n_1, ones_1 ..: one row for each bit with the number of earlier bits
    of its text that had the same context and partial byte, and of ones among them."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                values = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                for level in range(8 if len(values) else 0):
                    y = (values >> (7 - level) & 1).astype(np.int32)
                    columns = [pa.repeat(batch.column(0)[i], len(y)), pa.array(y)]
                    for context in contexts:
                        key = _bit_contexts(values, context) << 8 | (values.astype(np.int64) + 256) >> (8 - level)
                        order = np.argsort(key, kind="stable")
                        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                        first = np.repeat(starts, np.diff(np.append(starts, len(y))))
                        ones = np.cumsum(y[order]) - y[order]
                        n, seen = np.empty(len(y), np.int32), np.empty(len(y), np.int32)
                        n[order] = np.arange(len(y)) - first
                        seen[order] = ones - ones[first]
                        columns += [pa.array(n), pa.array(seen)]
                    yield pa.RecordBatch.from_arrays(columns, names=[keep, "y", *names])

    names = [f"{kind}_{i}" for i in range(len(contexts)) for kind in ("n", "ones")]
    kind = df.schema[keep].dataType.simpleString()
    rows = df.select(keep, F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("__content"))
    return rows.mapInArrow(batches, ", ".join([f"`{keep}` {kind}", "y int", *(f"{n} int" for n in names)]))
