"""A predictive codec: each row's content is one stream, coded by an adaptive model and a binary range coder.

Prediction, coding and update depend on all earlier bits of a stream, so inside a stream there is no parallelism. Rows
are dealt out by length and coded in lockstep: one NumPy step serves the same bit of all streams of a batch.

The model keeps adaptive estimates for eleven contexts (partial byte; with the byte before; with the character before, and
the last one to seven characters and the token so far) and for the last eight of these the byte that last followed and its
run. Their inputs go through two layers of online logistic mixing, whose first has four weight rows selected by (contexts
met, class, bit), (misses of late, partial byte), the byte before and the confidence of the first five contexts. All
arithmetic is on integers, so a stream decodes alike in whatever batch it lies. ``level`` sets the size of the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.archives import read_header, with_archive

DIRECT, HASHED = 3, 8
CONTEXTS = DIRECT + HASHED
INPUTS = 2 * CONTEXTS + HASHED + 3
#: Rows of the four weight sets: their first rows, and all of them.
_SETS = np.cumsum([0, 9 * 7 * 8, 8 * 256, 2 * 256])
_ROWS = int(_SETS[-1]) + 3**5
#: Bytes of tables and of padded texts that one batch may take up.
TABLE_BYTES, TEXT_BYTES = 192 << 20, 32 << 20
#: Largest numbers of observations that the direct estimates and the others count to.
_CAPS = np.array([30, 60, 255] + [127] * HASHED)
_RATES = (65536 / (np.arange(256) + 1.5)).astype(np.int64)
_SQUASH = np.clip(np.round(65536 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 16, 65520).astype(np.int64)
_ODDS = np.maximum(np.arange(4096), 1) / 4096
_STRETCH = np.clip(np.round(256 * np.log(_ODDS / (1 - _ODDS))), -2047, 2047).astype(np.int64)
_RUN = np.round(160 * np.log2(np.arange(256) + 1)).astype(np.int64)
_GOLDEN = 0x9E3779B1
#: Weights that streams start with: odds by context, distances from a half, runs, structure, persistence, bias.
_FIRST = [0.15, 0.12, 0.12, 0.12, 0.3, 0.25, 0.2, 0.1, 0.1, 0.1, 0.2] + [0.02] * CONTEXTS + [0.1] * HASHED + [0.15, 0.15, 0.0]
_WEIGHTS = (65536 * np.array(_FIRST)).astype(np.int32)


def table_bits(level: int) -> int:
    """Binary logarithm of a context's table size."""
    return 10 + level


def streams_at_once(level: int) -> int:
    one = CONTEXTS * 5 + HASHED * 2
    return max(1, min(256, TABLE_BYTES // ((one << table_bits(level)) + 4 * _ROWS * INPUTS)))


class Model:
    """Adaptive estimates and weights of many streams at once, bit by bit."""

    def __init__(self, streams: int, level: int = 1) -> None:
        self.rows, self.bits = np.arange(streams)[:, None], table_bits(level)
        self.p = np.full((streams, CONTEXTS << self.bits), 32768, np.int32)
        self.n = np.zeros((streams, CONTEXTS << self.bits), np.uint8)
        self.run_byte = np.zeros((streams, HASHED << self.bits), np.uint8)
        self.run = np.zeros((streams, HASHED << self.bits), np.uint8)
        self.w = np.broadcast_to(_WEIGHTS, (streams, _ROWS, INPUTS)).copy()
        self.last_w = np.full((streams, 4), 16384, np.int64)
        zero = lambda *shape: np.zeros((streams, *shape), np.int64)
        self.c0, self.c1, self.bpos = np.ones(streams, np.int64), zero(), 0
        self.character, self.left, self.kind, self.token_type = zero(), zero(), zero() + 2, zero()
        self.hashes, self.misses, self.seen = zero(HASHED), zero(), 0
        self._enter()

    def _enter(self) -> None:
        """Places of the contexts at the beginning of a byte."""
        inside = (self.c1 >= 128) & (self.c1 < 192)
        direct = np.stack([np.zeros_like(self.c1), np.where(inside, 128 + self.left, self.c1), self.character & 0xFFFFFF], axis=1)
        self.base = np.concatenate([direct, self.hashes], axis=1) + 1
        self.run_at = self._place(self.hashes + 1, 0, HASHED)
        byte, length = self.run_byte[self.rows, self.run_at].astype(np.int64), self.run[self.rows, self.run_at]
        self.expected, self.strength = byte, _RUN[length]
        self.met = (length[:, :7] > 0).sum(axis=1)

    def _place(self, hashed: np.ndarray, c0: np.ndarray | int, count: int) -> np.ndarray:
        mixed = (hashed * _GOLDEN + c0 * 0x85EBCA6B & 0xFFFFFFFF) * 0xC2B2AE35 & 0xFFFFFFFF
        return (mixed >> (32 - self.bits)) + (np.arange(count) << self.bits)

    def predict(self) -> np.ndarray:
        """16-bit probability of a 1 for each stream."""
        c0 = self.c0[:, None]
        self.at = self._place(self.base, c0, CONTEXTS)
        p12, n = self.p[self.rows, self.at] >> 4, self.n[self.rows, self.at]
        young = (n < 3).astype(np.int64)
        odds = np.where(n > 0, _STRETCH[p12] >> young, 0)
        self.x = x = np.empty((len(c0), INPUTS), np.int64)
        x[:, :CONTEXTS] = odds
        x[:, CONTEXTS : 2 * CONTEXTS] = np.where(n > 0, (p12 - 2048) >> 2, 0)
        agrees = (self.expected + 256 >> (8 - self.bpos)) == c0
        bit = self.expected >> (7 - self.bpos) & 1
        x[:, 2 * CONTEXTS : -3] = np.where(agrees, np.where(bit == 1, self.strength, -self.strength), 0)
        inside = self.left > 0
        first, second = self.bpos == 0, self.bpos == 1
        x[:, -3] = np.where(inside, 2047 * first - 2047 * second, np.where((self.c0 & 1 == 1) & second, 2047, 0))
        x[:, -2] = np.where(self.c1 >= 128, 512, -512) * first
        x[:, -1] = 256
        sure = np.where(n == 0, 0, np.where((p12 < 64) | (p12 > 4032), 1, 2))[:, DIRECT : DIRECT + 5]
        late = (self.misses & 1) | (self.misses & 0xFE != 0) << 1 | (self.misses & 0xFF00 != 0) << 2
        self.rows_of = np.stack(
            [
                (self.met * 7 + self.kind) * 8 + self.bpos,
                _SETS[1] + late * 256 + self.c0,
                _SETS[2] + (self.misses & 0xFFFF != 0) * 256 + self.c1,
                _SETS[3] + sure @ (3 ** np.arange(5)),
            ],
            axis=1,
        )
        w = self.w[self.rows, self.rows_of].astype(np.int64)
        self.opinions = np.clip((w * x[:, None, :]).sum(axis=2) >> 16, -2047, 2047)
        self.mixed = _SQUASH[np.clip((self.last_w * self.opinions).sum(axis=1) >> 16, -2047, 2047) + 2047]
        return self.mixed

    def update(self, y: np.ndarray, live: np.ndarray) -> None:
        self.seen += 1
        rate = max(3 * 65536, 8 * 65536 - self.seen) >> 13  # decays as streams go on
        wanted = np.where(live, y, 0) << 16
        error = np.where(live[:, None], wanted[:, None] - _SQUASH[self.opinions + 2047], 0) * rate
        old = self.w[self.rows, self.rows_of]
        self.w[self.rows, self.rows_of] = np.clip(old + (self.x[:, None, :] * error[:, :, None] >> 19), -(1 << 24), 1 << 24)
        off = np.where(live, wanted - self.mixed, 0)
        self.last_w += self.opinions * off[:, None] >> 18
        p, n = self.p[self.rows, self.at].astype(np.int64), self.n[self.rows, self.at]
        moved = p + (((y << 16)[:, None] - p) * _RATES[n] >> 16)
        self.p[self.rows, self.at] = np.where(live[:, None], np.clip(moved, 32, 65503), p)
        self.n[self.rows, self.at] = np.where(live[:, None], np.minimum(n + 1, _CAPS), n)
        missed = (self.mixed >= 32768) != (y == 1)
        self.misses = np.where(live, (self.misses << 1 | missed) & 0xFFFF, self.misses)
        self.c0 = np.where(live, self.c0 << 1 | y, self.c0)
        self.bpos += 1
        if self.bpos == 8:
            self._byte(live)

    def _byte(self, live: np.ndarray) -> None:
        """What a whole byte changes: runs, characters, token, class."""
        c = self.c0 & 0xFF
        byte, length = self.run_byte[self.rows, self.run_at], self.run[self.rows, self.run_at]
        same = (byte == c[:, None]) & (length > 0)
        grown = np.where(same, np.minimum(length, 254) + 1, 1)
        self.run[self.rows, self.run_at] = np.where(live[:, None], grown, length)
        self.run_byte[self.rows, self.run_at] = np.where(live[:, None], c[:, None], byte)
        inside = self.left > 0
        lead = np.select([c >= 248, c >= 240, c >= 224, c >= 192], [0, 3, 2, 1], 0)
        self.left = np.where(inside, np.where((c >= 128) & (c < 192), self.left - 1, 0), lead)
        self.character = np.where(inside, self.character << 8 | c, c)
        chars = self.hashes[:, :7]
        begun = np.concatenate([np.zeros((len(c), 1), np.int64), chars[:, :6]], axis=1)
        chars = (np.where(inside[:, None], chars, begun) + c[:, None] + 1) * _GOLDEN & 0x3FFFFFFF
        letter = (c >= 65) & (c <= 90) | (c >= 97) & (c <= 122)
        digit = (c >= 48) & (c <= 57)
        kind = np.select([digit, letter, c < 128], [0, 1, 2], 3) + np.where(c >= 128, self.left, 0)
        token_type = np.select([kind <= 1, kind == 2], [0, 1], 2)
        token = (np.where(token_type == self.token_type, self.hashes[:, 7], 1) + c + 1) * 0x01000193 & 0x3FFFFFFF
        self.hashes = np.concatenate([chars, token[:, None]], axis=1)
        self.kind, self.token_type, self.c1 = kind, token_type, c
        self.c0, self.bpos = np.ones_like(c), 0
        self._enter()


def _split(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    return low + ((high - low) * p >> 16)


def encode_batch(contents: list[bytes], level: int = 1) -> list[bytes]:
    """Bodies of a batch of streams. A 1 takes the low part of the range; equal leading bytes leave at once."""
    k = len(contents)
    lengths = np.array([len(c) for c in contents])
    model, out = Model(k, level), [bytearray() for _ in contents]
    low, high = np.zeros(k, np.int64), np.full(k, 0xFFFFFFFF, np.int64)
    data = np.zeros((k, int(lengths.max(initial=0))), np.uint8)
    for i, c in enumerate(contents):
        data[i, : len(c)] = np.frombuffer(c, np.uint8)
    for pos in range(data.shape[1]):
        live, byte = pos < lengths, data[:, pos].astype(np.int64)
        for shift in range(7, -1, -1):
            y = byte >> shift & 1
            mid = _split(low, high, model.predict())
            high, low = np.where(live & (y == 1), mid, high), np.where(live & (y == 0), mid + 1, low)
            model.update(y, live)
            while (same := live & ((low ^ high) >> 24 == 0)).any():
                for i in np.flatnonzero(same).tolist():
                    out[i].append(int(high[i] >> 24))
                low = np.where(same, low << 8 & 0xFFFFFFFF, low)
                high = np.where(same, high << 8 & 0xFFFFFFFF | 0xFF, high)
    for i in range(k):
        if lengths[i]:
            out[i] += int(low[i] + 1 if low[i] else 0).to_bytes(5, "big")[1:]
    return [bytes(o) for o in out]


def decode_batch(bodies: list[bytes], sizes: list[int], level: int = 1) -> list[bytes]:
    """Inverse of :func:`encode_batch`; past its end a body reads as 255."""
    k, lengths = len(bodies), np.array(sizes, np.int64)
    model, out = Model(k, level), np.zeros((k, int(lengths.max(initial=0))), np.uint8)
    width = max(map(len, bodies), default=0) + 8
    data = np.full((k, width), 255, np.uint8)
    for i, b in enumerate(bodies):
        data[i, : len(b)] = np.frombuffer(b, np.uint8)
    low, high = np.zeros(k, np.int64), np.full(k, 0xFFFFFFFF, np.int64)
    value = data[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
    at = np.full(k, 4)
    for pos in range(out.shape[1]):
        live, byte = pos < lengths, np.zeros(k, np.int64)
        for _ in range(8):
            mid = _split(low, high, model.predict())
            y = (value <= mid).astype(np.int64)
            byte = byte << 1 | y
            high, low = np.where(live & (y == 1), mid, high), np.where(live & (y == 0), mid + 1, low)
            model.update(y, live)
            while (same := live & ((low ^ high) >> 24 == 0)).any():
                fresh = data[np.arange(k), np.minimum(at, width - 1)].astype(np.int64)
                low = np.where(same, low << 8 & 0xFFFFFFFF, low)
                high = np.where(same, high << 8 & 0xFFFFFFFF | 0xFF, high)
                value = np.where(same, value << 8 & 0xFFFFFFFF | fresh, value)
                at = at + same
        out[:, pos] = np.where(live, byte, 0)
    return [out[i, :n].tobytes() for i, n in enumerate(sizes)]


def _slices(sizes: list[int], levels: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of one level that fit a batch: its tables and its longest text times its rows are bounded."""
    start = 0
    for end in range(1, len(sizes) + 1):
        full = end - start >= streams_at_once(levels[start])
        if end == len(sizes) or full or levels[end] != levels[start] or max(sizes[start : end + 1]) * (end + 1 - start) > TEXT_BYTES:
            yield start, end
            start = end


def _by_length(df: DataFrame, *keys: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def compress(df: DataFrame, key: str = "doc_id", content: str = "content", level: int = 1) -> DataFrame:
    """``key``, n_bytes, archive. Null contents are empty; an empty content has an empty body."""
    if not 1 <= level <= 12:
        raise ValueError("level has to be from 1 to 12")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sizes = batch.column(1).to_pylist()
            for s, e in _slices(sizes, [level] * len(sizes)):
                part = batch.slice(s, e - s)
                bodies = encode_batch(part.column(2).to_pylist(), level)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bodies, pa.binary())], names=[key, "n_bytes", "body"])

    kind = df.schema[key].dataType.simpleString()
    whole = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    rows = _by_length(df.select(key, F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("content")), "n_bytes")
    coded = rows.mapInArrow(batches, f"{key} {kind}, n_bytes long, body binary")
    return with_archive(coded, "body", "n_bytes", level).drop("body")


def extract(df: DataFrame, key: str = "doc_id", archive: str = "archive") -> DataFrame:
    """``key``, content, error. A row whose header is wrong has no content and says why."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            errors, levels = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            sizes = [0 if e else n for n, e in zip(batch.column(1).to_pylist(), errors)]
            for s, e in _slices(sizes, levels):
                part = batch.slice(s, e - s)
                contents = decode_batch(part.column(2).to_pylist(), sizes[s:e], levels[s])
                kept = pa.array([None if x else c for c, x in zip(contents, errors[s:e])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), kept, part.column(3)], names=[key, "content", "error"])

    kind = df.schema[key].dataType.simpleString()
    head = df.select(key, F.col(archive).alias("__archive"), read_header(F.col(archive)).alias("h"))
    body = F.coalesce(F.expr("substring(__archive, h.body_at, octet_length(__archive))"), F.lit(b""))
    level = F.when(F.col("h.error").isNull(), F.col("h.level")).otherwise(1).alias("level")
    rows = head.select(key, F.coalesce("h.n_bytes", F.lit(0)).alias("n_bytes"), body.alias("body"), F.col("h.error").alias("error"), level)
    return _by_length(rows, "level", "n_bytes").mapInArrow(batches, f"{key} {kind}, content binary, error string")
