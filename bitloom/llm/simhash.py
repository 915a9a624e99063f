"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, connected components.

A fingerprint's 64 bits are cut into ``k`` blocks. Two fingerprints that differ in at most ``d`` bits agree in some
``k - d`` blocks, so each choice of ``k - d`` blocks is a key to join on and no link is lost. ``k`` follows from the
number of distinct fingerprints (see ``block_count``): keys are long enough that unrelated fingerprints seldom meet.

Copies collapse first: only distinct fingerprints are joined. Rows with one key lie together in a sorted partition;
each set is searched there by visiting unvisited neighbours, so a dense set costs few passes and gives one link per
row, never all its pairs. A set of more than ``set_rows`` rows is dealt out into all pairs of its chunks, each pair a
set of its own: exact, spread over tasks, bounded memory.

Defined results: a null or blank text has fingerprint zero and is linked like any other. component_id is the smallest
id of the component; null ids get a component of the ids they are linked with, null when there are none. Repeated rows
give repeated results. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import BROADCAST_KEYS, cut, small, text_or_empty
from .components import components

SEED = 42
_CHUNK = 1 << 16


def fingerprint(data: bytes, shingle_words: int = 4) -> int:
    """Majority bits of the XXH64 hashes of all word shingles of an UTF-8 text, A-Z in lower case."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = len(words) - width + 1
    first, last, of = starts[:count].tolist(), ends[width - 1 :].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _CHUNK):
        spans = zip(first[at : at + _CHUNK], last[at : at + _CHUNK])
        hashes = np.array([of(joined[s:e], SEED) for s, e in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > count))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            prints = np.array([fingerprint(x.as_py(), shingle_words) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("data"))
    return texts.mapInArrow(batches, f"doc_id {kind}, fp long")


def block_count(distinct: int, distance: int) -> int:
    """Fewest blocks whose keys have at least as many values as a quarter of the distinct fingerprints."""
    for blocks in range(distance + 2, 17):
        if 4 << ((blocks - distance) * (64 // blocks)) >= distinct:
            return blocks
    return 16


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """One hash for each choice of ``blocks - distance`` blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(itertools.combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(signed).cast("long"))))
    assert len(keys) == comb(blocks, distance)
    return F.array(*keys)


def _stars(fps: np.ndarray, reps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of one set: each row of a component to the component's smallest representative."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    rest = np.arange(len(fps))
    while len(rest):
        members, queue, rest = [rest[:1]], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[queue.pop()]) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                members.append(found)
                queue.extend(found.tolist())
        group = reps[np.concatenate(members)]
        if len(group) > 1:
            left.append(group)
            right.append(np.full(len(group), group.min()))
    return left, right


def _links(keys: np.ndarray, fps: np.ndarray, reps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key: small sets by comparing rows at equal lags, larger ones by ``_stars``."""
    edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
    sizes = ends - starts
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for s, e in zip(starts[sizes > 12].tolist(), ends[sizes > 12].tolist()):
        a, b = _stars(fps[s:e], reps[s:e], distance)
        left += a
        right += b
    last = np.repeat(np.where(sizes > 12, 0, ends), sizes)
    at = np.arange(len(keys))
    for lag in range(1, 12):
        i = at[at + lag < last]
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= distance]
        left.append(reps[i])
        right.append(reps[i + lag])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_links(prints: DataFrame, distance: int = 4, set_rows: int = 1 << 15) -> DataFrame:
    """``prints``: fp (distinct), rep (distinct long). Result: links a, b that connect all reps within ``distance``."""
    spark = prints.sparkSession
    blocks = block_count(prints.count(), distance)
    keyed = prints.select("fp", "rep", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("key"))
    large = (
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > set_rows)
        .select("key", F.ceil(F.col("n") / set_rows).cast("int").alias("chunks"))
    )
    dealt = keyed.join(large, "key", "left").withColumn(
        "mine", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("other")
    sets = dealt.select("key", "mine", other, "fp", "rep").select(
        "key", (F.least("mine", "other").cast("long") * (1 << 31) + F.greatest("mine", "other")).alias("part"), "fp", "rep"
    )

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def out(t: pa.Table) -> pa.RecordBatch:
            key, part, fp, rep = (t.column(i).to_numpy() for i in range(4))
            a, b = _links(np.stack([key, part], axis=1), fp.view(np.uint64), rep, distance)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)[a != b], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in source:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < _CHUNK:
                continue
            t = pa.concat_tables(held)
            key, part = t.column(0).to_numpy(), t.column(1).to_numpy()
            tail = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if (key[0], part[0]) != (key[-1], part[-1]) else 0
            if tail:
                yield out(t.slice(0, tail))
            held, rows = [t.slice(tail)], t.num_rows - tail
        if held and rows:
            yield out(pa.concat_tables(held))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_sets = sets.repartition(parts, "key", "part").sortWithinPartitions("key", "part")
    return sorted_sets.mapInArrow(search, "a long, b long").distinct()


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle_words: int = 4
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle_words))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    # a fingerprint that only null ids have keeps its own place: it is named by itself in the links
    named = distinct.select("fp", F.col("fp").alias("rep"))
    member = components(near_links(named, distance))
    joined = cut(distinct.join(member, distinct.fp == member.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root")))
    # sums are written before the joins: a broadcast, or a stage of its own that Spark splits where a root is hot
    roots = cut(joined.groupBy("root").agg(F.min("least_id").alias("component_id")))
    ids = cut(joined.join(small(roots, BROADCAST_KEYS), "root").select("fp", "component_id"))
    return prints.join(small(ids, BROADCAST_KEYS), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, one row of each group of near copies. Fingerprints four bits apart miss most of
    these, so links are pairs of five-word Jaccard similarity 0.8 or more (see ``near_copies``)."""
    return near_copies.drop_near_copies(docs, id_col, text_col)
