"""Context keys of each position: byte classes, UTF-8 state, characters, tokens, selectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from .bytestream import byte_chars, code

#: Characters whose grams a task sorts at once, distinct grams that it remembers, and rows that it sends at once.
_CHARACTERS, _REMEMBERED, _SENT = 1 << 23, 1 << 24, 1 << 17
#: Bits of a character's number: its code point plus 1, 0 where a text has none yet.
_WIDTH = 21


def continuation_left(b: Column, c1: Column, c2: Column, c3: Column) -> Column:
    """Continuation bytes still to come after ``b`` in valid UTF-8."""
    lead = lambda x: F.when(x >= 240, 3).when(x >= 224, 2).when(x >= 192, 1).otherwise(0)
    inside = b.between(128, 191)
    left = F.when(c1 >= 192, lead(c1) - 1).when(c2 >= 192, lead(c2) - 2).when(c3 >= 192, lead(c3) - 3).otherwise(0)
    return F.when(inside, F.greatest(left, F.lit(0))).otherwise(lead(b))


def byte_class(b: Column, left: Column) -> Column:
    """0 digit, 1 letter, 2 other ASCII, 3 + bytes to come otherwise."""
    letter = b.between(65, 90) | b.between(97, 122)
    return F.when(b.between(48, 57), 0).when(letter, 1).when(b < 128, 2).otherwise(3 + left)


def token_type(b: Column) -> Column:
    """0 letters and digits, 1 other ASCII, 2 other."""
    alnum = b.between(48, 57) | b.between(65, 90) | b.between(97, 122)
    return F.when(alnum, 0).when(b < 128, 1).otherwise(2)


_AFTER = r"[\x80-\xBF]"
#: A lead byte with what it takes up: as many continuation bytes as it asks for, or fewer and the byte that breaks off.
_SEQUENCE = (
    r"[\xC0-\xDF][\s\S]?"
    rf"|[\xE0-\xEF](?:{_AFTER}[\s\S]?|[\s\S])?"
    rf"|[\xF0-\xF7](?:{_AFTER}{{2}}[\s\S]?|{_AFTER}[\s\S]?|[\s\S])?"
    r"|[\s\S]"
)


def utf8_states(df: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, pos, b, left for any bytes, broken sequences included: a byte that should continue a sequence and
    doesn't ends it and starts none itself. The bytes are cut into sequences by a pattern, in one pass; intended for
    binary columns whose validity is unknown (texts use :func:`continuation_left`)."""
    latin = F.decode(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), "ISO-8859-1")
    found = F.regexp_extract_all(latin, F.lit(f"({_SEQUENCE})"), F.lit(1))

    def states(sequence: Column) -> Column:
        lead = code(F.substring(sequence, 1, 1))
        wanted = F.when(lead >= 248, 0).when(lead >= 240, 3).when(lead >= 224, 2).when(lead >= 192, 1).otherwise(0)

        def state(char: Column, i: Column) -> Column:
            b = code(char)
            left = F.when(i == 0, wanted).when(b.between(128, 191), wanted - i).otherwise(0)
            return F.struct(b.cast("int").alias("b"), left.cast("int").alias("left"))

        return F.transform(F.split(sequence, ""), state)

    return df.select(*keep, F.posexplode(F.flatten(F.transform(found, states))).alias("pos", "z")).select(*keep, "pos", "z.b", "z.left")


def character_grams(df: DataFrame, order: int, content: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, next, c1 .. c``order`` and n: how often each character follows the ones before it, null where a text has none
    yet."""
    chars = F.split(F.coalesce(F.col(content), F.lit("")), "")
    split = df.where(F.length(content) > 0).select(*by, chars.alias("__a"))
    none, names = F.lit(None).cast("string"), [f"c{k}" for k in range(1, order + 1)]
    arrays = [F.col("__a").alias("next"), *[F.concat(F.array(*[none] * k), F.col("__a")).alias(f"c{k}") for k in range(1, order + 1)]]
    rows = split.select(*by, F.explode(F.arrays_zip(*arrays)).alias("z")).where(F.col("z.next").isNotNull())
    return rows.groupBy(*by, *[F.col(f"z.{c}").alias(c) for c in ["next", *names]]).agg(F.count(F.lit(1)).alias("n"))


def character_contexts(df: DataFrame, order: int, content: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, context (the ``order`` characters before; shorter at the beginning of a text), next character, n."""
    context = F.concat_ws("", *[F.col(f"c{k}") for k in range(order, 0, -1)])
    return character_grams(df, order, content, by).select(*by, context.alias("context"), "next", "n")


def distinct_grams(df: DataFrame, content: str = "text") -> DataFrame:
    """a, b, c: the character itself and the seven before it, as numbers of ``_WIDTH`` bits: c1 c2 c3, c4 c5 c6 and c7 next.
    Distinct within what a task remembers; while a task has met at most 255 different characters, a gram is one long there."""

    def packed(v: np.ndarray, starts: np.ndarray, at: tuple[int, ...], width: int) -> np.ndarray:
        key = np.zeros(len(v), np.uint64)
        for k in at:
            before = v.astype(np.uint64)
            if k:
                before[k:] = before[:-k].copy()
                first = (starts[:, None] + np.arange(k)).ravel()
                before[first[first < len(v)]] = 0
            key <<= np.uint64(width)
            key |= before
        return key

    def distinct(keys: np.ndarray) -> np.ndarray:
        keys.sort()
        return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys

    def rows(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(columns[0]), _SENT):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + _SENT].view(np.int64)) for x in columns], names=["a", "b", "c"])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kinds = np.zeros(0x110001, np.uint8), np.zeros(256, np.uint64)
        known, held = 0, [np.empty(0, np.uint64)]

        def unpacked(keys: np.ndarray) -> list[np.ndarray]:
            part = lambda k: kinds[keys >> np.uint64(8 * k) & np.uint64(255)]
            out = []
            for group in ((7, 6, 5), (4, 3, 2), (1, 0)):
                word = np.zeros(len(keys), np.uint64)
                for k in group:
                    word <<= np.uint64(_WIDTH)
                    word |= part(k)
                out.append(word)
            return out

        for batch in source:
            texts = [x.as_buffer().to_pybytes().decode("utf-8", "replace") for x in batch.column(0)]
            lengths, first = np.fromiter(map(len, texts), np.int64, len(texts)), 0
            ends = np.cumsum(lengths)
            while first < len(texts):
                last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _CHARACTERS, "right")), first + 1)
                v = np.frombuffer("".join(texts[first:last]).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
                starts = (ends - lengths)[first:last][lengths[first:last] > 0] - (ends - lengths)[first]
                first = last
                if not len(v):
                    continue
                new = np.flatnonzero(np.bincount(v))
                new = new[number[new] == 0]
                if known + len(new) <= 255:
                    number[new] = np.arange(known + 1, known + 1 + len(new))
                    kinds[known + 1 : known + 1 + len(new)] = new
                    known += len(new)
                    held.append(distinct(packed(number[v], starts, (1, 2, 3, 4, 5, 6, 7, 0), 8)))
                else:  # too many different characters for a byte each
                    words = [packed(v, starts, at, _WIDTH) for at in ((1, 2, 3), (4, 5, 6), (7, 0))]
                    order = np.lexsort(words[::-1])
                    words = [w[order] for w in words]
                    changed = np.concatenate([[True], np.any([w[1:] != w[:-1] for w in words], axis=0)])
                    yield from rows([w[changed] for w in words])
                if sum(map(len, held)) > _REMEMBERED:
                    held = [distinct(np.concatenate(held))]
                    if len(held[0]) > _REMEMBERED // 2:
                        yield from rows(unpacked(held.pop()))
                        held = [np.empty(0, np.uint64)]
        yield from rows(unpacked(distinct(np.concatenate(held))))

    texts = df.select(F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("__content"))
    return texts.mapInArrow(batches, "a long, b long, c long")


def context_spread(df: DataFrame, content: str = "text") -> DataFrame:
    """k (1 to 7), n_contexts, n_deterministic: distinct contexts of the last k characters (fewer at a text's beginning), and
    those with one successor only. Grams are dealt out by their nearest four characters, so contexts of four and more lie in one
    task in order, and are counted there in one pass; shorter ones are brought together from what is left of those."""
    depths = (3, 4, 5, 6, 7)

    def runs(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, opened = None, {}  # the row before; least and greatest successor of the context that each depth ends with
        counted = {k: [0, 0] for k in depths[1:]}

        def closed(k: int, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
            if k == 3:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), 3, np.int32)), *map(pa.array, (a, low, high))], names=["k", "a", "x", "y"])
            else:
                counted[k][0] += len(low)
                counted[k][1] += int(np.count_nonzero(low == high))

        for batch in source:
            if not batch.num_rows:
                continue
            a, b, c = (x.to_numpy() for x in batch.columns)
            following = c & ((1 << _WIDTH) - 1)
            for k in depths:
                parts = [a, *([b >> _WIDTH * max(6 - k, 0)] if k > 3 else []), *([c >> _WIDTH] if k == 7 else [])]
                edge = [a[0], *([before[1] >> _WIDTH * max(6 - k, 0)] if before and k > 3 else []), *([before[2] >> _WIDTH] if before and k == 7 else [])]
                same = before is not None and before[0] == a[0] and all(p[0] == e for p, e in zip(parts, edge))
                starts = np.concatenate([[0], np.flatnonzero(np.any([p[1:] != p[:-1] for p in parts], axis=0)) + 1])
                low, high, own = np.minimum.reduceat(following, starts), np.maximum.reduceat(following, starts), a[starts]
                if same:
                    low[0], high[0] = min(low[0], opened[k][1]), max(high[0], opened[k][2])
                elif before is not None:
                    yield from closed(k, *(np.array([x], np.int64) for x in opened[k]))
                yield from closed(k, own[:-1], low[:-1], high[:-1])
                opened[k] = int(own[-1]), int(low[-1]), int(high[-1])
            before = int(a[-1]), int(b[-1]), int(c[-1])
        if before is not None:
            for k in depths:
                yield from closed(k, *(np.array([x], np.int64) for x in opened[k]))
            columns = [[k for k in counted], [0] * len(counted), [x for x, _ in counted.values()], [y for _, y in counted.values()]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["k", "a", "x", "y"])

    dealt = distinct_grams(df, content).repartition("a", F.call_function("shiftright", F.col("b"), F.lit(2 * _WIDTH)))
    found = cut(dealt.sortWithinPartitions("a", "b", "c").mapInArrow(runs, "k int, a long, x long, y long"))
    out = found.where("k > 3").groupBy("k").agg(F.sum("x").alias("n_contexts"), F.sum("y").alias("n_deterministic"))
    shorter = found.where("k = 3").select("a", "x", "y")
    for k in (3, 2, 1):
        key = F.call_function("shiftright", F.col("a"), F.lit(0 if k == 3 else _WIDTH)).alias("a")
        shorter = shorter.groupBy(key).agg(F.min("x").alias("x"), F.max("y").alias("y"))
        one = F.coalesce(F.sum((F.col("x") == F.col("y")).cast("long")), F.lit(0))
        out = out.unionByName(shorter.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n_contexts"), one.alias("n_deterministic")))
    orders = df.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("k"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_contexts", "n_deterministic")]
    return orders.join(out, "k", "left").select("k", *zero)


#: Runs of one token type: letters and digits, other ASCII, other characters.
TOKEN_PATTERN = r"[A-Za-z0-9]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x7F]+"


#: Characters and particles that begin a new segment in Chinese text, as UTF-8 in hexadecimal.
SEGMENT_MARKERS = tuple(
    bytes.fromhex(x).decode()
    for x in (
        "EFBC8C E79A84 E38082 E38081 EFBC88 EFBC89 E59CA8 E698AF E69C89 E5928C EFBC9A E782BA E4BBA5 E3808A E4BA86 E696BC E4B8BA "
        "E794A8 E3808C E58F8A E8808C E588B0 E4BA8E E794B1 E8A2AB E88887 E4BBBB E59091 E5808B E2809C E887B3 E88085 E6ADA4 E585A5 "
        "E4BD86 EFBC9B E4B88E E68896 E5A682 E5B087 E68BAC E4BA9B E4B894"
    ).split()
)


def tokens(df: DataFrame, content: str = "text", keep: tuple[str, ...] = ("doc_id",), markers: tuple[str, ...] = SEGMENT_MARKERS) -> DataFrame:
    """``keep``, ord, token, type: maximal runs of one type, cut before and after segment markers as well. Runs are found
    inside each row, so segmentation needs no window. A marker is a token of its own, of type 3."""
    pattern = TOKEN_PATTERN
    if markers:
        listed = "|".join(markers)
        pattern = f"{listed}|[A-Za-z0-9]+|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|(?:(?!{listed})[^\\x00-\\x7F])+"
    found = F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(f"({pattern})"), F.lit(1))
    rows = df.select(*keep, F.posexplode(found).alias("ord", "token"))
    kind = token_type(F.ascii("token"))
    return rows.withColumn("type", F.when(F.col("token").isin(*markers), 3).otherwise(kind) if markers else kind)


def token_prefixes(rows: DataFrame, keep: tuple[str, ...] = ("doc_id", "ord")) -> DataFrame:
    """Every position's token so far: one row per byte of each token with the prefix that precedes it."""
    chars = byte_chars(F.col("token"))
    spread = rows.select(*keep, "type", F.posexplode(chars).alias("k", "char"), chars.alias("__all"))
    return spread.select(*keep, "type", "k", code(F.col("char")).alias("b"), F.array_join(F.slice("__all", F.lit(1), F.col("k")), "").alias("prefix"))


def direct_keys(b: Column, c1: Column, left: Column, bpos: Column, character: Column) -> list[Column]:
    """Keys of the directly addressed orders 0, 1 and 2. In order 1 the byte before is replaced by its state within a
    character; order 2 is the character that the byte before belongs to (see :func:`character_prefix`)."""
    c0 = F.call_function("shiftright", b + 256, 8 - bpos).cast("long")
    before = F.when(c1.between(128, 191), 128 + left).otherwise(c1)
    return [c0 - 1, (c0 - 1) * 256 + before, character * 256 + c0]


def character_prefix(c1: Column, c2: Column, c3: Column, c4: Column) -> Column:
    """The bytes of the character that the byte before belongs to, from its first to that byte, as a number."""
    at = lambda c, k: c.cast("long") * (1 << 8 * k)
    two, three = at(c2, 1) + c1, at(c3, 2) + at(c2, 1) + c1
    inside = lambda c: c.between(128, 191)
    return F.when(~inside(c1), c1.cast("long")).when(~inside(c2), two).when(~inside(c3), three).otherwise(at(c4, 3) + three)


def miss_flags(misses: Column, bpos: Column) -> Column:
    """Three flags of a miss register (the latest bit lowest): whether there is a miss in the bit just before a byte's
    border, in the seven before that, in the eight before those; ``misses`` is read from the border of the last byte."""
    shift = F.pmod(8 - bpos, F.lit(8)).cast("int")
    aligned = F.call_function("shiftleft", misses, shift)
    byte = F.call_function("shiftright", aligned.bitwiseAND(F.lit(255)), shift)
    register = aligned.bitwiseAND(F.lit(~255)).bitwiseOR(byte)
    flag = lambda mask, value: F.when(register.bitwiseAND(F.lit(mask)) != 0, value).otherwise(0)
    return flag(0x1, 1) + flag(0xFE, 2) + flag(0xFF00, 4)


def selectors(order: Column, kind: Column, bpos: Column, misses: Column, c0: Column, c1: Column, boundary: Column, confidence: Column) -> list[Column]:
    """Weight rows by (active orders, class, bit), (misses of late, class, partial byte), (orders, any miss, boundary, byte)
    and confidence. ``misses``: a register of at least 16 bits."""
    return [
        (order * 7 + kind) * 8 + bpos,
        (miss_flags(misses, bpos) * 7 + kind) * 255 + c0 - 1,
        order * 1024 + F.when(misses != 0, 512).otherwise(0) + boundary * 256 + c1,
        confidence,
    ]
