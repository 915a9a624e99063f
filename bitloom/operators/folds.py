"""Folds over the bits of whole texts, made where the texts are read: what ``statistics.history_fold``,
``probability.capped_fold`` and the mixing step give for each text, context and partial byte, without a row for each bit.

Texts of a batch are taken in order of length and laid end to end in spans of some ``_SPAN`` bytes (a longer text is a span of
its own). A span's positions are sorted by context once and then split stably by one bit of the byte after the other, so the
bits of each partial byte lie together in their order; then all groups of bits are folded side by side, a bit of each at a
time. What leaves a task are sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestream import context_of
from .mixing import equal_step
from .statistics import history_table

#: Bytes of texts that a task folds side by side.
_SPAN = 1 << 22
#: Bits whose mixing steps are computed at once, so that they stay in the processor's cache.
_BLOCK = 1 << 15
#: Fewer groups than this are folded one by one.
_FEW = 24


def spans(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The non-empty texts of a binary array as (values, starts, rows): bytes end to end, where each text begins, its row."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.argsort(lengths, kind="stable")
    rows = rows[np.searchsorted(lengths[rows], 1) :]
    at = 0
    while at < len(rows):
        ends = np.cumsum(lengths[rows[at:]])
        take = max(int(np.searchsorted(ends, _SPAN, "right")), 1)
        own, ends = rows[at : at + take], ends[:take]
        yield np.frombuffer(b"".join(texts[int(i)].as_buffer() for i in own), np.uint8), ends - lengths[own], own
        at += take


def _codes(values: np.ndarray, starts: np.ndarray, text: np.ndarray, context: str) -> np.ndarray | None:
    """Small numbers that tell contexts (see ``bytestream.context_of``) apart, of the narrowest type that holds them; None for
    "none"."""
    if context == "none":
        return None
    codes = np.empty_like(values)
    codes[1:] = values[:-1]
    codes[starts] = 0
    if context == "raw":
        return codes
    at = np.flatnonzero((codes & 0xC0) == 0x80)
    first = starts[text[at]]
    found = context_of(*(np.where(at - k >= first, values[at - k], 0).astype(np.int64) for k in (1, 2, 3, 4)), context)
    if context == "byte":
        codes[at] = found
        return codes
    kinds, place = np.unique(found, return_inverse=True)
    codes = codes.astype(np.uint16 if len(kinds) <= 0xFF00 else np.int64)
    codes[at] = place + 256
    return codes


def _levels(values: np.ndarray, text: np.ndarray, codes: np.ndarray | None, places: bool = False):
    """For each of a byte's eight bits: the positions (None without ``places``) with equal partial byte, context and text side
    by side, in the order of the text; their bits; where each such group begins; its partial byte. Splitting by each bit in turn
    sorts by the bits known so far, the last one first."""
    if codes is None:
        held, v, group = np.arange(len(values), dtype=np.int32) if places else None, values, text.astype(np.int32)
    else:
        order = np.argsort(codes, kind="stable")
        v, own, kind = values[order], text[order], codes[order]
        new = np.flatnonzero((own[1:] != own[:-1]) | (kind[1:] != kind[:-1])) + 1
        group = np.repeat(np.arange(len(new) + 1, dtype=np.int32), np.diff(np.concatenate([[0], new, [len(v)]])))
        held = order.astype(np.int32) if places else None
    for level in range(8):
        y = v >> np.uint8(7 - level) & np.uint8(1)
        starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
        yield held, y, starts, v[starts].astype(np.int32) + 256 >> 8 - level
        if level == 7:
            return
        zero, one = np.flatnonzero(y == 0), np.flatnonzero(y)
        split = np.concatenate([zero, one])
        group <<= 1
        group |= y
        v, group, held = v[split], group[split], held[split] if places else None
        # numbered anew, so that they don't outgrow their type
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]), dtype=np.int32)


def _capped(ys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """``probability.capped_fold``'s p of each group of bits; groups come in descending size. Every step fits 32 bits: the first
    moves from a half, later rates are at most 3276."""
    p = np.full(len(sizes), 1 << 21, np.int32)
    rates = [16384 // (2 * n + 3) for n in range(limit + 1)]
    at, gap = starts.astype(np.int64), np.empty(len(sizes), np.int32)
    active, t, longest = len(sizes), 0, int(sizes[0])
    held = np.cumsum(np.bincount(sizes)[::-1])[::-1]  # groups of at least t bits
    while t < longest and (active := int(held[t + 1])) >= _FEW:
        y, own, g = ys[at[:active]].astype(np.int32), p[:active], gap[:active]
        np.left_shift(y, 22, out=y)
        np.subtract(y, own, out=g)
        np.right_shift(g, 3, out=g)
        np.multiply(g, rates[min(t, limit)], out=g)
        np.right_shift(g, 10, out=g)
        np.add(own, g, out=own)
        at[:active] += 1
        t += 1
    for i in range(int(held[t + 1]) if t < longest else 0):
        value, begin = int(p[i]), int(starts[i])
        for n, y in enumerate(ys[begin + t : begin + int(sizes[i])].tolist(), t):
            value += (((y << 22) - value >> 3) * rates[n if n < limit else limit]) >> 10
        p[i] = value
    return p


def _histories(ys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """``statistics.history_fold``'s state of each group of bits; groups come in descending size."""
    listed = history_table(limit)
    table, state = np.array(listed, np.int32), np.zeros(len(sizes), np.int32)
    at, t, longest = starts.astype(np.int64), 0, int(sizes[0])
    held = np.cumsum(np.bincount(sizes)[::-1])[::-1]
    while t < longest and (active := int(held[t + 1])) >= _FEW:
        own = state[:active]
        np.add(own, own, out=own)
        np.add(own, ys[at[:active]], out=own)
        own[:] = table[own]
        at[:active] += 1
        t += 1
    for i in range(int(held[t + 1]) if t < longest else 0):
        value, begin = int(state[i]), int(starts[i])
        for y in ys[begin + t : begin + int(sizes[i])].tolist():
            value = listed[2 * value + y]
        state[i] = value
    return state


def bit_folds(df: DataFrame, folds: list[tuple[str, int]], history_limit: int | None = None, content: str = "text") -> DataFrame:
    """fold, c0, n_groups, n_bits, p22, seen, n0, n1: for each (context, limit) of ``folds`` and each partial byte the number of
    (text, context) groups of bits, their bits, and the sums of the groups' last capped estimates and counts, and of their
    bounded history counts (null without ``history_limit``). For contexts see ``bytestream.context_of``. A row is a text."""
    names = ["n_groups", "n_bits", "p22", "seen", "n0", "n1"]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(folds), len(names), 256), np.int64)
        for batch in source:
            for values, begins, _ in spans(batch.column(0)):
                text = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(values))))
                for own, (context, limit) in zip(total, folds):
                    bits, edges, kinds, counts = [], [], [], []
                    for level, (_, y, starts, c0) in enumerate(_levels(values, text, _codes(values, begins, text, context))):
                        bits.append(y)
                        edges.append(starts + level * len(y))
                        kinds.append(c0)
                        counts.append(np.diff(np.append(starts, len(y))))
                    ys, starts, kind, sizes = (np.concatenate(x) for x in (bits, edges, kinds, counts))
                    descending = np.argsort(-sizes, kind="stable")
                    starts, kind, sizes = starts[descending], kind[descending], sizes[descending]
                    sums = [np.ones(len(sizes), np.int64), sizes, _capped(ys, starts, sizes, limit), np.minimum(sizes, limit)]
                    if history_limit is not None:
                        sums += np.divmod(_histories(ys, starts, sizes, history_limit), history_limit + 1)
                    for k, x in enumerate(sums):  # below 2^53, exact as doubles
                        own[k] += np.bincount(kind, x, 256).astype(np.int64)
        for n, own in enumerate(total):
            met = np.flatnonzero(own[0])
            shown = [pa.array(x[met]) if k < 4 or history_limit is not None else pa.nulls(len(met), pa.int64()) for k, x in enumerate(own)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), n, np.int32)), pa.array(met.astype(np.int32)), *shown], names=["fold", "c0", *names])

    texts = df.select(F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("__content"))
    found = texts.mapInArrow(batches, ", ".join(["fold int", "c0 int", *(f"{n} long" for n in names)]))
    return found.groupBy("fold", "c0").agg(*[F.sum(n).alias(n) for n in names])


def mixed_steps(df: DataFrame, contexts: tuple[str, ...], content: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep``, n_bits, n_ones, p_sum, error_sum, distance_sum, weight_sum: one mixing step for each bit of a text (see
    ``mixing.equal_step``) from the adaptive estimates in the given contexts, summed. A row for each text that isn't empty."""
    names = ["n_bits", "n_ones", "p_sum", "error_sum", "distance_sum", "weight_sum"]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for values, begins, rows in spans(batch.column(1)):
                lengths = np.diff(np.append(begins, len(values)))
                text = np.repeat(np.arange(len(begins)), lengths)
                total = np.zeros((len(names), len(begins)), np.int64)
                total[0] = 8 * lengths
                for level, dealt in enumerate(zip(*(_levels(values, text, _codes(values, begins, text, c), True) for c in contexts))):
                    found = []
                    for order, y, starts, _ in dealt:
                        sizes = np.diff(np.append(starts, len(order)))
                        ones = np.cumsum(y, dtype=np.int32) - y
                        ones -= np.repeat(ones[starts], sizes)
                        n = np.arange(len(order), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
                        p = np.empty(len(order), np.int16)
                        for at in range(0, len(order), _BLOCK):
                            own = slice(at, at + _BLOCK)
                            p[order[own]] = np.clip(np.rint((ones[own] + 0.25) / (n[own] + 0.5) * 4096), 1, 4095)
                        found.append(p)
                    y = values >> np.uint8(7 - level) & np.uint8(1)
                    stepped = np.empty((5, len(y)), np.int32)
                    for at in range(0, len(y), _BLOCK):
                        own = slice(at, at + _BLOCK)
                        bit = y[own].astype(np.int32)
                        p, error, weights = equal_step([x[own] for x in found], bit)
                        stepped[:, own] = bit, p, error, np.abs(error), weights
                    for k, x in enumerate(stepped, 1):
                        total[k] += np.add.reduceat(x, begins, dtype=np.int64)
                columns = [batch.column(0).take(pa.array(rows)), *map(pa.array, total)]
                yield pa.RecordBatch.from_arrays(columns, names=[keep, *names])

    kind = df.schema[keep].dataType.simpleString()
    texts = df.select(keep, F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("__content"))
    found = texts.mapInArrow(batches, ", ".join([f"`{keep}` {kind}", *(f"{n} long" for n in names)]))
    return found.groupBy(keep).agg(*[F.sum(n).alias(n) for n in names])


def distinct_contexts(df: DataFrame, order: int = 3, content: str = "text") -> DataFrame:
    """One row: n, the positions of all texts, and d1 .. d``order`` (up to 3), the sum over texts of the distinct contexts of so many
    bytes (0 where a text has none yet). A row is a text, whatever its id. A text's contexts are sorted where it is read."""
    names = ["n", *(f"d{k}" for k in range(1, order + 1))]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(order + 1, np.int64)
        for batch in source:
            for values, begins, _ in spans(batch.column(0)):
                key = np.repeat(np.arange(len(begins), dtype=np.uint64), np.diff(np.append(begins, len(values))))
                for k in range(1, order + 1):
                    before = np.zeros_like(values)
                    before[k:] = values[:-k]
                    first = (begins[:, None] + np.arange(k)).ravel()
                    before[first[first < len(values)]] = 0
                    key <<= np.uint64(8)
                    key |= before
                key.sort()
                total[0] += len(key)
                for k in range(order, 0, -1):
                    total[k] += 1 + np.count_nonzero(key[1:] != key[:-1])
                    key >>= np.uint64(8)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], names=names)

    if not 1 <= order <= 3:
        raise ValueError("one to three bytes of history")
    texts = df.select(F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("__content"))
    found = texts.mapInArrow(batches, ", ".join(f"{n} long" for n in names))
    return found.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
