"""Token files with random access: directly addressable codes.

Ids are cut into 8-bit chunks. Level 0 holds the lowest chunk of every id and a bitmap of the ids that continue; level 1
holds the next chunk of those, with its own bitmap, and so on. A rank directory (ones before every 512th bit) leads from
a position in one level to its position in the next, so any token or range is read without decoding what precedes it.

A file is one task's run of blocks; a block holds whole documents and is closed at ``BLOCK_IDS`` ids. Blocks are
written by Spark's Parquet writer as (file, block, start_in_file, n_ids, doc_ids, payload), so any store that Spark writes
will do and a task that is run again replaces its output. A payload holds the ids' levels and those of the documents'
lengths, uncompressed and in a page of its own, so a reader that wants one token fetches one payload by the page index and
decodes nothing else in it. ``path``/offsets holds the number of ids before each file.

Defined results: null and empty texts have the end id only. Documents are written in ascending id, null ids first,
repeated ids in the order of their texts. An empty table gives no blocks. Other columns are never read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, running_offsets, small, text_or_empty, tokenizer_path

BLOCK_IDS = 1 << 18
RANK_BITS = 512
BLOCK_SCHEMA = "file int, block int, start_in_file long, n_ids long, doc_ids array<long>, payload binary"
#: Words and ids that a worker remembers, in bytes; then the words not in use are forgotten.
REMEMBERED_BYTES = 48 << 20
_WORD_BYTES = 160
_CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_LETTERS = frozenset(map(chr, [9, 10, 11, 12, 13, *range(32, 127), *range(0xA1, 0x250)]))
#: Texts of other characters, or with the beginning of special tokens, are left to the library. Not among these: letters
#: whose lower case is longer or isn't among them, control characters and odd white space.
_LATIN = frozenset(c for c in _LETTERS if c.lower() in _LETTERS)
#: The public tokenizer's words among Latin letters in lower case.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ɏ0-9²³¹¼-¾]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write the other bytes as characters from 256 on.
_BYTE_LEVEL = [chr(b if b in _KEPT else 256 + b - sum(k < b for k in _KEPT)) for b in range(256)]


def _is_public(config: dict) -> bool:
    steps = config.get("pre_tokenizer", {}).get("pretokenizers", [])
    normal = [n.get("type") for n in config.get("normalizer", {}).get("normalizers", [])]
    pattern = steps[0].get("pattern", {}).get("Regex") if steps else None
    return normal == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and pattern == _PATTERN


class WordEncoder:
    """Encodes texts with a tokenizer of the tokenizers library that drops white space and splits at it.

    Each distinct word goes to the library once; what is remembered is a flat array of ids, and a batch of texts is put
    together by one vectorised gather. Where the tokenizer is the public one (lower case, byte level, the word pattern
    below) and a text has Latin letters only, it is cut into the tokenizer's own words first and these go straight to
    its merge model; all other texts are cut at white space and go through the whole library.
    """

    def __init__(self, model: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.library.encode_special_tokens = special_as_text
        self.merges = self.library.model if _is_public(json.loads(model)) else None
        self.old: tuple[dict[str, int], array, array, array] = ({}, array("Q"), array("Q"), array("I"))
        self.now = ({}, array("Q"), array("Q"), array("I"))
        self.held = 0

    def _plain(self, text: str) -> bool:
        return self.merges is not None and _LATIN.issuperset(text) and "<|" not in text

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        known, starts, sizes, flat = self.now
        known.update(zip(words, range(len(starts), len(starts) + len(words))))
        lengths = list(map(len, ids))
        starts.extend(accumulate(lengths[:-1], initial=len(flat)) if ids else ())
        sizes.extend(lengths)
        flat.extend(chain.from_iterable(ids))
        self.held += _WORD_BYTES * len(words) + sum(map(len, words)) + 4 * sum(lengths)

    def _learn(self, plain: set[str], other: set[str]) -> None:
        """``plain``: the tokenizer's own words; ``other``: runs between white space."""
        if self.held > REMEMBERED_BYTES:  # words in use move on from the old generation, the rest is forgotten
            self.held = 0
            self.old, self.now = self.now, ({}, array("Q"), array("Q"), array("I"))
        new = [plain.difference(self.now[0]), other.difference(self.now[0])]
        old, starts, sizes, flat = self.old
        kept = [w for part in new for w in part if w in old]
        self._add(kept, [flat[starts[i] : starts[i] + sizes[i]] for i in map(old.__getitem__, kept)])
        words = list(new[0].difference(kept))
        mapped = (w if w.isascii() else "".join(map(_BYTE_LEVEL.__getitem__, w.encode())) for w in words)
        self._add(words, [[t.id for t in found] for found in map(self.merges.tokenize, mapped)] if words else [])
        words = list(new[1].difference(kept, words))
        self._add(words, [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        collecting = gc.isenabled()
        gc.disable()  # a batch makes very many lists and no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = list(map(self._plain, texts))
        split = [_PIECE.findall(t.lower()) if p else _CHUNK.findall(t) for t, p in zip(texts, plain)]
        self._learn(set().union(*compress(split, plain)), set().union(*(w for w, p in zip(split, plain) if not p)))
        known, starts, sizes, flat = self.now
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        lengths = np.frombuffer(sizes, np.uint64)[at].astype(np.int64) if len(at) else np.empty(0, np.int64)
        ends = np.cumsum(lengths)
        if len(at):
            first = np.frombuffer(starts, np.uint64)[at].astype(np.int64) - (ends - lengths)
            ids = np.frombuffer(flat, np.uint32)[np.repeat(first, lengths) + np.arange(ends[-1])]
        else:
            ids = np.empty(0, np.uint32)
        borders = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.split(ids, borders[:-1]) if len(split) else []


@lru_cache(maxsize=2)
def word_encoder(model: str, special_as_text: bool = False) -> WordEncoder:
    return WordEncoder(model, special_as_text)


def pack(values: np.ndarray) -> bytes:
    """The levels of an array of unsigned 32-bit integers."""
    levels, rest = [], np.asarray(values, np.uint32)
    while True:
        more = rest > 0xFF
        ones = np.packbits(more, bitorder="little")
        per = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.empty(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per)[:-1]]).astype("<u4") if len(per) else per.astype("<u4")
        levels.append(struct.pack("<I", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + ones.tobytes() + ranks.tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    return struct.pack("<I", len(levels)) + b"".join(levels)


class Packed:
    """Reads levels written by :func:`pack`: single values and ranges by position."""

    def __init__(self, data: bytes | memoryview) -> None:
        data = memoryview(data)
        (count,), at = struct.unpack_from("<I", data), 4
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(count):
            (n,), at = struct.unpack_from("<I", data, at), at + 4
            sizes = (n, -(-n // 8), 4 * -(-n // RANK_BITS))
            a, b, c = (data[at + sum(sizes[:i]) : at + sum(sizes[: i + 1])] for i in range(3))
            self.levels.append((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), np.frombuffer(c, "<u4")))
            at += sum(sizes)
        self.n_bytes = at

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, at: int) -> int:
        """Ones before bit ``at``."""
        _, bits, ranks = self.levels[level]
        if at == 0:
            return 0
        directory = min(at // RANK_BITS, len(ranks) - 1)
        first = directory * RANK_BITS
        rest = bits[first // 8 : -(-at // 8)]
        ones = np.unpackbits(rest, bitorder="little")[: at - first]
        return int(ranks[directory]) + int(ones.sum())

    def __getitem__(self, at: int) -> int:
        value, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[at]) << shift
            if not bits[at // 8] >> (at % 8) & 1:
                break
            at, shift = self._rank(level, at), shift + 8
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Values from ``start`` to before ``end``; each level is entered by its rank directory."""
        out = self.levels[0][0][start:end].astype(np.uint32)
        where, level, shift = np.arange(len(out)), 0, 8
        while level + 1 < len(self.levels) and len(where):
            bits = self.levels[level][1]
            ones = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start].astype(bool)
            where = where[ones]
            start = self._rank(level, start)
            end = start + len(where)
            level += 1
            out[where] |= self.levels[level][0][start:end].astype(np.uint32) << np.uint32(shift)
            shift += 8
        return out


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    files: int | None = None,
) -> None:
    """Encodes whole texts, ends each with ``end_id`` and writes the ids in ascending id of the documents."""
    with open(tokenizer or tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()

    def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = word_encoder(model), TaskContext.get().partitionId()
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = start = block = 0

        def close() -> pa.RecordBatch:
            lengths = pack(np.array([len(p) for p in parts], np.uint32))
            payload = pack(np.concatenate(parts)) + lengths
            columns = [[file], [block], [start], [held], [ids], [payload]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "start_in_file", "n_ids", "doc_ids", "payload"]
            )

        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, found in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    ids.append(doc_id)
                    parts.append(np.append(found, np.uint32(end_id)))
                    held += len(parts[-1])
                    if held >= BLOCK_IDS:
                        yield close()
                        start, block, held, ids, parts = start + held, block + 1, 0, [], []
        if parts:
            yield close()

    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "uncompressed")
    written.option("parquet.enable.dictionary", "false").option("parquet.page.row.count.limit", "1").parquet(f"{path}/blocks")
    stored = docs.sparkSession.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    files_of = stored.groupBy(F.lit(0).alias("all"), "file").agg(F.sum("n_ids").alias("n"))
    offsets = running_offsets(files_of, "all", "file", "n").select("file", "offset")
    offsets.write.parquet(f"{path}/offsets")


def _offsets(spark: SparkSession, path: str) -> DataFrame:
    """file and offset (ids of all files before it): one short row for each file."""
    return small(spark.read.schema("file int, offset long").parquet(f"{path}/offsets"))


def read_tokens(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """position and token of the ids from ``start`` to before ``end``. The places of blocks are found in their narrow
    columns; of the payloads only those of blocks in range are read, and in these only the parts that the levels' rank
    directories lead to."""
    rows = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    placed = rows.select("file", "block", "start_in_file", "n_ids").join(_offsets(spark, path), "file")
    first = F.col("offset") + F.col("start_in_file")
    hit = cut(placed.where((first < end) & (first + F.col("n_ids") > start)).select("file", "block", first.alias("first")))
    ends = hit.agg(F.min("file"), F.max("file"), F.min(F.struct("file", "block")), F.max(F.struct("file", "block"))).first()
    wanted = rows.where(F.col("file").between(ends[0], ends[1])) if ends[0] is not None else rows.limit(0)
    if ends[0] is not None and ends[0] == ends[1]:
        wanted = wanted.where(F.col("block").between(ends[2]["block"], ends[3]["block"]))
    found = wanted.select("file", "block", "payload").join(small(hit), ["file", "block"]).select("first", "payload")

    def values(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                at = batch.column(0)[i].as_py()
                tokens = Packed(batch.column(1)[i].as_buffer())
                low, high = max(start - at, 0), min(end - at, len(tokens))
                ids = [tokens[low]] if high - low == 1 else tokens.slice(low, high)
                columns = [pa.array(np.arange(at + low, at + high)), pa.array(np.asarray(ids, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["position", "token"])

    return found.mapInArrow(values, "position long, token long")


def read_token(spark: SparkSession, path: str, position: int) -> int | None:
    """The id at one position of the whole sequence, none beyond its ends."""
    row = read_tokens(spark, path, position, position + 1).first()
    return row["token"] if row else None


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (little-endian unsigned
    32-bit ids)."""
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    ordered = stored.join(_offsets(spark, path), "file").select(F.col("offset") + F.col("start_in_file"), "doc_ids", "payload")

    def documents(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in range(batch.num_rows):
                start, ids, payload = (batch.column(i)[row] for i in range(3))
                data = payload.as_buffer()
                tokens = Packed(data)
                lengths = Packed(memoryview(data)[tokens.n_bytes :])
                sizes = lengths.slice(0, len(lengths)).astype(np.int64)
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(tokens.slice(e - n, e).astype("<u4").tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
                columns = [pa.array(ids.as_py(), pa.int64()), pa.array(start.as_py() + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return ordered.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
