"""Benchmark decontamination by spaced-seed hashing.

A mask such as 110111 selects some of the tokens of a span and ignores the rest. Each mask is laid at every token of
every text and the selected tokens are hashed; equal hashes of a benchmark item and a document are hits. A hit fixes a
diagonal (document position minus item position), and along each diagonal the tokens are compared: the item is found
when some window of ``window`` tokens (the whole item when it is shorter) has at least ``similarity`` equal tokens.
The default masks leave no such window of 13 tokens without a hit: every way to change up to 2 of 13 tokens
keeps one of them whole (checked in the tests), and an unchanged item of 5 to 12 tokens holds 11111.

Tokens are runs of letters, marks and digits in lower case; punctuation and white space don't count.

Defined results: null and blank texts are clean. Items of fewer than 5 tokens are too short as evidence and never match.
Items of 5 to 12 tokens match whole and unchanged only. In reports, rows with one id are judged together; rows are dropped
each by its own text. Repeated items count
once for each item id. No benchmark: all documents are clean. No documents: an empty result. Other columns are never
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty, with_row_keys, without_rows

MASKS = ("11111", "110111")
WINDOW = 13
SIMILARITY = 0.8
#: The benchmark's seeds are broadcast up to this many bytes of benchmark text (a seed for each word and mask, some 20
#: times the text); beyond it Spark joins as it sees fit, by shuffling both sides.
BROADCAST_BYTES = 2 << 20


def tokens(text_col: str) -> Column:
    spaced = F.regexp_replace(F.lower(text_or_empty(text_col)), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.array_remove(F.split(F.trim(spaced), " "), "")


def _seeds(texts: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """``texts``: columns ``keep`` and toks. One row for each mask and position: keep, pos (from 0), seed."""
    span = max(map(len, masks))
    hashed = texts.select(*keep, F.transform("toks", lambda t: F.xxhash64(t)).alias("h"))
    shifted = [F.slice("h", i + 1, F.greatest(F.size("h") - i, F.lit(0))).alias(f"h{i}") for i in range(span)]
    spread = hashed.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "z"))
    seeds = [
        F.when(F.col(f"z.h{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(m), *[F.col(f"z.h{i}") for i, c in enumerate(m) if c == "1"]))
        for m in masks
    ]
    return spread.select(*keep, "pos", F.explode(F.array(*seeds)).alias("seed")).where(F.col("seed").isNotNull())


def _best(equal: Column, size: Column) -> Column:
    """Most ones in any run of ``size`` entries."""
    starts = F.sequence(F.lit(1), F.size(equal) - size + 1)
    sums = F.transform(starts, lambda i: F.aggregate(F.slice(equal, i, size), F.lit(0), lambda a, x: a + x))
    return F.array_max(sums)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS,
    window: int = WINDOW,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row for each document id and item found in it: doc_id, item_id, n_equal (of the best window), window."""
    shortest = min(map(len, masks))
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(item_text_col).alias("toks"))
    items = items.where(F.size("toks") >= shortest).select("item_id", "toks", F.xxhash64("toks").alias("item_key")).distinct()
    bytes_of = benchmark.agg(F.sum(F.octet_length(text_or_empty(item_text_col)))).first()[0] or 0
    small = F.broadcast if bytes_of <= BROADCAST_BYTES else lambda frame: frame

    item_seeds = _seeds(items.dropDuplicates(["item_key"]), masks, "item_key").withColumnRenamed("pos", "item_pos")
    texts = docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("toks"))
    hits = _seeds(texts, masks, "doc_id").join(small(item_seeds), "seed")
    diagonals = cut(hits.select("doc_id", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())

    lengths = items.select("item_key", F.size("toks").alias("n")).distinct()
    spans = diagonals.join(small(lengths), "item_key")
    found_in = spans.groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_list(F.struct("item_key", "shift", "n")).alias("spans"))
    joined = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).join(
        found_in, F.col("doc_id").eqNullSafe(F.col("hit_id"))
    )
    sliced = joined.select("doc_id", tokens("text").alias("toks"), "spans").select(
        "doc_id",
        F.explode(
            F.transform(
                "spans",
                lambda s: F.struct(
                    s["item_key"].alias("item_key"),
                    s["shift"].alias("shift"),
                    F.slice(
                        "toks",
                        F.greatest(s["shift"], F.lit(0)) + 1,
                        F.greatest(F.least(s["shift"] + s["n"], F.size("toks")) - F.greatest(s["shift"], F.lit(0)), F.lit(0)),
                    ).alias("part"),
                ),
            )
        ).alias("s"),
    ).select("doc_id", "s.*")
    whole = items.select("item_key", F.col("toks").alias("item_toks")).dropDuplicates(["item_key"])
    aligned = sliced.join(small(whole), "item_key").withColumn(
        "other", F.slice("item_toks", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.greatest(F.size("part"), F.lit(1)))
    )
    size = F.least(F.lit(window), F.size("item_toks"))
    needed = F.when(F.size("item_toks") < window, size).otherwise(F.lit(int(-(-window * similarity // 1))))
    equal = F.zip_with("part", "other", lambda a, b: F.when(a == b, 1).otherwise(0))
    scored = (
        aligned.where(F.size("part") >= size)
        .select("doc_id", "item_key", size.alias("window"), needed.alias("needed"), equal.alias("equal"))
        .select("doc_id", "item_key", "window", "needed", _best(F.col("equal"), F.col("window")).alias("n_equal"))
        .where(F.col("n_equal") >= F.col("needed"))
    )
    best = scored.groupBy("doc_id", "item_key").agg(F.max("n_equal").cast("long").alias("n_equal"), F.max("window").cast("long").alias("window"))
    return best.join(small(items.select("item_key", "item_id")), "item_key").select("doc_id", "item_id", "n_equal", "window")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, contaminated, n_items, item_ids (ascending)."""
    pairs = contaminated(docs, benchmark, id_col, text_col)
    per_doc = pairs.groupBy(F.col("doc_id").alias("hit_id")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = docs.select(F.col(id_col).alias("doc_id")).join(per_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    none = F.array().cast("array<long>")
    return rows.select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without those whose text holds a benchmark passage; each row is judged by its own
    text, so rows that share an id, or have none, don't answer for one another."""
    stored, row = with_row_keys(docs, "decontaminate")
    gone = cut(contaminated(stored, benchmark, row, text_col).select(F.col("doc_id").alias(row)).distinct())
    return without_rows(stored, row, gone)
