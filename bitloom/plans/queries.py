"""The registered queries: each applies operators to whole tables. The SQL that DuckDB checks them with is beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, scalars
from ..operators import codec, contexts, probability, statistics, verify
from ..operators.bytestream import bit_counts, byte_counts
from ..operators.folds import bit_folds, distinct_contexts, mixed_steps
from ..shared import cut, shared_path
from ..streaming import incremental


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_BYTES = """
WITH h AS (SELECT doc_id, lang, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents),
raw AS (SELECT doc_id, lang, unnest(h) AS hx, generate_subscripts(h, 1) - 1 AS pos FROM h),
val AS (SELECT doc_id, lang, pos, CAST('0x' || hx AS INTEGER) AS b FROM raw),
bytes AS (
  SELECT *, coalesce(lag(b, 1) OVER w, 0) AS c1, coalesce(lag(b, 2) OVER w, 0) AS c2, coalesce(lag(b, 3) OVER w, 0) AS c3,
         coalesce(lag(b, 4) OVER w, 0) AS c4
  FROM val WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
)
"""
_NODES = """, nodes AS (
  SELECT ({b} + 256) >> (8 - k) AS c0, ({b} >> (7 - k)) & 1 AS y{more}, n FROM {src}, (SELECT unnest(range(8)) AS k)
)"""


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_counts(_documents(spark, sf_dir))


BYTE_HISTOGRAM = _BYTES + "SELECT b, count(*) AS n FROM bytes GROUP BY b"


def bit_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_counts(byte_counts(_documents(spark, sf_dir), by=("lang",)), by=("lang",))


_BY_LANG = ", cnt AS (SELECT lang, b, count(*) AS n FROM bytes GROUP BY ALL)" + _NODES.format(b="b", src="cnt", more=", lang")
BIT_NODE_COUNTS = _BYTES + _BY_LANG + """
SELECT lang, CAST(c0 AS INTEGER) AS c0, CAST(sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS BIGINT) AS n0,
       CAST(sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS BIGINT) AS n1 FROM nodes GROUP BY lang, nodes.c0
"""


def bit_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node probabilities on the mixer's scales."""
    nodes = bit_counts(byte_counts(_documents(spark, sf_dir)), by=())
    p = F.greatest(F.lit(1), F.least(F.lit(4095), F.floor(F.col("n1") * 4096 / (F.col("n0") + F.col("n1"))))).cast("int")
    with_p = nodes.select("c0", p.alias("p12"), scalars.update_rate(F.col("n0") % 1024).alias("rate"))
    with_s = with_p.withColumn("stretched", scalars.stretch(F.col("p12")))
    return with_s.withColumn("squashed", scalars.squash(F.col("stretched")))


BIT_STRETCH = _BYTES + ", cnt AS (SELECT b, count(*) AS n FROM bytes GROUP BY b)" + _NODES.format(b="b", src="cnt", more="") + """,
q AS (SELECT CAST(c0 AS INTEGER) AS c0, sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS n0, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS n1 FROM nodes GROUP BY nodes.c0),
p AS (SELECT c0, CAST(greatest(1, least(4095, floor(n1 * 4096 / (n0 + n1)))) AS INTEGER) AS p12,
             CAST(16384 // (2 * (n0 % 1024) + 3) AS INTEGER) AS rate FROM q),
s AS (SELECT *, CAST(greatest(-2047, least(2047, round(256 * ln((p12 / 4096.0) / (1 - p12 / 4096.0))))) AS INTEGER) AS stretched FROM p)
SELECT *, CAST(greatest(1, least(4095, round(4096 / (1 + exp(-stretched / 256.0))))) AS INTEGER) AS squashed FROM s
"""


def byte_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted by distinct bytes with their history first, classified after."""
    counts = byte_counts(_documents(spark, sf_dir), order=3, by=("lang",))
    left = contexts.continuation_left(F.col("b"), F.col("c1"), F.col("c2"), F.col("c3"))
    kinds = counts.select("lang", contexts.byte_class(F.col("b"), left).alias("class"), contexts.token_type(F.col("b")).alias("type"), "n")
    return kinds.groupBy("lang", "class", "type").agg(F.sum("n").alias("n"))


BYTE_CLASS_COUNTS = _BYTES + """, l AS (
  SELECT *, CASE WHEN b BETWEEN 128 AND 191 THEN
      greatest(0, CASE WHEN c1 >= 240 THEN 2 WHEN c1 >= 224 THEN 1 WHEN c1 >= 192 THEN 0 WHEN c2 >= 240 THEN 1 WHEN c2 >= 192 THEN 0 ELSE 0 END)
    WHEN b >= 240 THEN 3 WHEN b >= 224 THEN 2 WHEN b >= 192 THEN 1 ELSE 0 END AS l FROM bytes
)
SELECT lang, CASE WHEN b BETWEEN 48 AND 57 THEN 0 WHEN b BETWEEN 65 AND 90 OR b BETWEEN 97 AND 122 THEN 1 WHEN b < 128 THEN 2
            ELSE 3 + l END AS class,
       CASE WHEN b BETWEEN 48 AND 57 OR b BETWEEN 65 AND 90 OR b BETWEEN 97 AND 122 THEN 0 WHEN b < 128 THEN 1 ELSE 2 END AS type,
       count(*) AS n FROM l GROUP BY ALL
"""


def _entropy(order: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = byte_counts(_documents(spark, sf_dir), order, by=("lang",))
        context = tuple(f"c{k}" for k in range(1, order + 1))
        out = statistics.conditional_entropy(counts, context, by=("lang",))
        return out.withColumn("bits_per_byte", F.round("bits_per_byte", 4))

    return query


def _entropy_sql(order: int) -> str:
    keys = ", ".join(["lang", *(f"c{k}" for k in range(1, order + 1))])
    return _BYTES + f""", cnt AS (SELECT {keys}, b, count(*) AS n FROM bytes GROUP BY ALL),
per AS (SELECT {keys}, sum(n) AS total, sum(n * log2(n)) AS nlogn FROM cnt GROUP BY {keys})
SELECT lang, CAST(sum(total) AS BIGINT) AS n_bytes, count(*) AS n_contexts,
       round(sum(total * log2(total) - nlogn) / sum(total), 4) AS bits_per_byte FROM per GROUP BY lang"""


order0_entropy, order1_entropy, order2_entropy = _entropy(0), _entropy(1), _entropy(2)


def character_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contexts of the last 1 to 7 characters, and how many have one successor only. The texts are read for the
    longest contexts; those of each order follow from the next one's."""
    docs = _documents(spark, sf_dir)
    positions = docs.agg(F.coalesce(F.sum(F.char_length("text").cast("long")), F.lit(0)).alias("n_positions"))
    return contexts.context_spread(docs).crossJoin(F.broadcast(positions))


CHARACTER_CONTEXTS = """
WITH s AS (SELECT doc_id, string_split(text, '') AS a FROM documents WHERE length(text) > 0),
t AS (SELECT doc_id, unnest(a) AS c, generate_subscripts(a, 1) AS i FROM s),
w AS (SELECT c, {lags} FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
u AS ({orders}),
c AS (SELECT k, context, c, count(*) AS n FROM u GROUP BY ALL),
p AS (SELECT k, context, count(*) AS successors, sum(n) AS n FROM c GROUP BY k, context)
SELECT CAST(k AS INTEGER) AS k, count(*) AS n_contexts, count(*) FILTER (successors = 1) AS n_deterministic,
       CAST(sum(n) AS BIGINT) AS n_positions FROM p GROUP BY k
""".format(
    lags=", ".join(f"coalesce(lag(c, {k}) OVER w, '') AS l{k}" for k in range(1, 8)),
    orders=" UNION ALL ".join(
        f"SELECT {k} AS k, {' || '.join(f'l{j}' for j in range(k, 0, -1))} AS context, c FROM w" for k in range(1, 8)
    ),
)


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contexts.tokens(_documents(spark, sf_dir), keep=())
    return found.groupBy("type", F.octet_length("token").alias("n_bytes")).agg(F.count(F.lit(1)).alias("n"))


_MARKERS = "|".join(contexts.SEGMENT_MARKERS)
_TOKENS = f"""
WITH t AS (
  SELECT unnest(regexp_extract_all(replace(regexp_replace(text, '({_MARKERS})', chr(1) || '\\1' || chr(1), 'g'), chr(1) || chr(1), chr(1)),
    '[A-Za-z0-9]+|[\\x00\\x02-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|[^\\x00-\\x7F]+')) AS token FROM documents
), k AS (
  SELECT token, CASE WHEN regexp_full_match(token, '{_MARKERS}') THEN 3 WHEN regexp_matches(token, '^[A-Za-z0-9]') THEN 0
    WHEN regexp_matches(token, '^[\\x00-\\x7F]') THEN 1 ELSE 2 END AS type
  FROM t
)
"""
TOKEN_LENGTHS = _TOKENS + "SELECT type, CAST(strlen(token) AS INTEGER) AS n_bytes, count(*) AS n FROM k GROUP BY ALL"


def token_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts made of the current token so far. Equal tokens are counted before they are expanded to prefixes."""
    found = contexts.tokens(_documents(spark, sf_dir), keep=()).groupBy("token", "type").agg(F.count(F.lit(1)).alias("n"))
    prefixes = contexts.token_prefixes(found, keep=("n",)).groupBy("type", "prefix").agg(F.sum("n").alias("n"))
    return prefixes.groupBy("type").agg(F.count(F.lit(1)).alias("n_prefixes"), F.sum("n").alias("n_positions"))


TOKEN_PREFIXES = _TOKENS + """, d AS (SELECT token, type, count(*) AS n FROM k GROUP BY ALL),
p AS (SELECT type, n, hex(encode(token)) AS h, unnest(range(strlen(token))) AS i FROM d),
q AS (SELECT type, substr(h, 1, 2 * i) AS prefix, sum(n) AS n FROM p GROUP BY ALL)
SELECT type, count(*) AS n_prefixes, CAST(sum(n) AS BIGINT) AS n_positions FROM q GROUP BY type
"""


def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.run_histogram(_documents(spark, sf_dir))


RUN_LENGTHS = _BYTES + """, r AS (
  SELECT doc_id, c1, b, pos, row_number() OVER (PARTITION BY doc_id, c1 ORDER BY pos)
         - row_number() OVER (PARTITION BY doc_id, c1, b ORDER BY pos) AS island FROM bytes
), g AS (SELECT least(count(*), 255) AS run FROM r GROUP BY doc_id, c1, b, island)
SELECT CAST(run AS INTEGER) AS run, count(*) AS n FROM g GROUP BY 1
"""


def adaptive_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that the adaptive estimate spends on the corpus as one stream, by order of its byte contexts. The counts of
    order 2 are the only ones that the texts are read for; those of lower orders are sums of them."""
    counts, none = byte_counts(_documents(spark, sf_dir), 2), F.lit(0)
    orders = [F.struct(F.lit(k).alias("context_order"), *[(F.col(f"c{j}") if j <= k else none).alias(f"k{j}") for j in (1, 2)]) for k in range(3)]
    spread = counts.select("b", "n", F.explode(F.array(*orders)).alias("o")).groupBy("o.context_order", "o.k1", "o.k2", "b").agg(F.sum("n").alias("n"))
    nodes = bit_counts(spread, by=("context_order", "k1", "k2"))
    spent = nodes.select("context_order", probability.total_bits(F.col("n0"), F.col("n1")).alias("bits"), (F.col("n0") + F.col("n1")).alias("n"))
    return spent.groupBy("context_order").agg(F.round(F.sum("bits"), 1).alias("bits"), F.sum("n").alias("n_bits"))


def _code_length_sql() -> str:
    parts = []
    for order in range(3):
        keys = "".join(f", c{k}" for k in range(1, order + 1))
        parts.append(f"""SELECT {order} AS context_order, round(sum((lgamma(n0 + n1 + 0.5) - lgamma(0.5) - lgamma(n0 + 0.25) - lgamma(n1 + 0.25)
  + 2 * lgamma(0.25)) / ln(2)), 1) AS bits, CAST(sum(n0 + n1) AS BIGINT) AS n_bits FROM (
  SELECT (b + 256) >> (8 - k) AS c0{keys}, CAST(sum(CASE WHEN (b >> (7 - k)) & 1 = 0 THEN n ELSE 0 END) AS DOUBLE) AS n0,
         CAST(sum(CASE WHEN (b >> (7 - k)) & 1 = 1 THEN n ELSE 0 END) AS DOUBLE) AS n1
  FROM cnt, (SELECT unnest(range(8)) AS k) GROUP BY ALL)""")
    return _BYTES + ", cnt AS (SELECT c1, c2, b, count(*) AS n FROM bytes GROUP BY ALL)\n" + "\nUNION ALL\n".join(parts)


def context_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contexts of one to three bytes take up: how many there are, how many were met once, in how many the next
    byte was always the same, and the positions that they share."""
    counts, none = byte_counts(_documents(spark, sf_dir), 3), F.lit(0)
    orders = [F.struct(F.lit(k).alias("context_order"), *[(F.col(f"c{j}") if j <= k else none).alias(f"k{j}") for j in (1, 2, 3)]) for k in (1, 2, 3)]
    spread = counts.select("b", "n", F.explode(F.array(*orders)).alias("o")).groupBy("o.context_order", "o.k1", "o.k2", "o.k3", "b").agg(F.sum("n").alias("n"))
    per = spread.groupBy("context_order", "k1", "k2", "k3").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("successors"))
    met = lambda c: F.sum(c.cast("long"))
    return per.groupBy("context_order").agg(
        F.count(F.lit(1)).alias("n_contexts"), met(F.col("n") == 1).alias("n_once"), met(F.col("successors") == 1).alias("n_deterministic"),
        F.sum("n").alias("n_positions"),
    )


CONTEXT_OCCUPANCY = _BYTES + ", cnt AS (SELECT c1, c2, c3, b, count(*) AS n FROM bytes GROUP BY ALL)\n" + "\nUNION ALL\n".join(
    f"""SELECT {k} AS context_order, count(*) AS n_contexts, count(*) FILTER (n = 1) AS n_once,
       count(*) FILTER (successors = 1) AS n_deterministic, CAST(sum(n) AS BIGINT) AS n_positions
FROM (SELECT {keys}, sum(n) AS n, count(DISTINCT b) AS successors FROM cnt GROUP BY {keys})"""
    for k, keys in ((1, "c1"), (2, "c1, c2"), (3, "c1, c2, c3"))
)


def confidence_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each distinct context of three bytes: is the next byte certain from one, two or three of them?"""
    distinct, seen = byte_counts(_documents(spark, sf_dir), 3).select("c1", "c2", "c3", "b"), {}
    for order in (3, 2, 1):  # each order's pairs are made of the next one's
        keys = [f"c{k}" for k in range(1, order + 1)]
        distinct = distinct.select(*keys, "b").distinct() if order < 3 else distinct
        seen[order] = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"s{order}"))
    joined = seen[3].join(seen[2], ["c1", "c2"]).join(seen[1], ["c1"])
    code = statistics.confidence_code([statistics.confidence_digit(F.col(f"s{k}")) for k in (1, 2, 3)])
    return joined.groupBy(code.alias("confidence")).agg(F.count(F.lit(1)).alias("n_contexts"))


CONFIDENCE_CODES = _BYTES + """,
s1 AS (SELECT c1, count(DISTINCT b) AS s FROM bytes GROUP BY c1),
s2 AS (SELECT c1, c2, count(DISTINCT b) AS s FROM bytes GROUP BY c1, c2),
s3 AS (SELECT c1, c2, c3, count(DISTINCT b) AS s FROM bytes GROUP BY c1, c2, c3)
SELECT (CASE WHEN s1.s = 1 THEN 1 ELSE 2 END) * 9 + (CASE WHEN s2.s = 1 THEN 1 ELSE 2 END) * 3
       + CASE WHEN s3.s = 1 THEN 1 ELSE 2 END AS confidence, count(*) AS n_contexts
FROM s3 JOIN s2 USING (c1, c2) JOIN s1 USING (c1) GROUP BY 1
"""


def direct_context_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of the directly addressed tables of orders 0, 1 and 2: distinct keys and bits."""
    counts = byte_counts(_documents(spark, sf_dir), 4)
    left = contexts.continuation_left(F.col("c1"), F.col("c2"), F.col("c3"), F.lit(0))
    character = contexts.character_prefix(*[F.col(f"c{k}") for k in (1, 2, 3, 4)])
    known = counts.select("b", "c1", left.alias("left"), character.alias("chr"), "n").groupBy("b", "c1", "left", "chr").agg(F.sum("n").alias("n"))
    nodes = known.withColumn("bpos", F.explode(F.sequence(F.lit(0), F.lit(7))))
    keys = contexts.direct_keys(F.col("b"), F.col("c1"), F.col("left"), F.col("bpos"), F.col("chr"))
    rows = nodes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("context_order"), x.alias("key")) for k, x in enumerate(keys)])).alias("k"), "n")
    per = rows.groupBy("k.context_order", "k.key").agg(F.sum("n").alias("n"))
    return per.groupBy("context_order").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_bits"))


_STATE = """CASE WHEN c1 BETWEEN 128 AND 191 THEN 128 + greatest(0, CASE WHEN c2 >= 240 THEN 2 WHEN c2 >= 224 THEN 1 WHEN c2 >= 192 THEN 0
         WHEN c3 >= 240 THEN 1 ELSE 0 END) ELSE c1 END"""
_CHARACTER = """CASE WHEN c1 NOT BETWEEN 128 AND 191 THEN CAST(c1 AS BIGINT) WHEN c2 NOT BETWEEN 128 AND 191 THEN c2 * 256::BIGINT + c1
         WHEN c3 NOT BETWEEN 128 AND 191 THEN c3 * 65536::BIGINT + c2 * 256 + c1
         ELSE c4 * 16777216::BIGINT + c3 * 65536 + c2 * 256 + c1 END"""
DIRECT_CONTEXT_KEYS = _BYTES + f""", l AS (SELECT b, {_STATE} AS before, {_CHARACTER} AS chr, count(*) AS n FROM bytes GROUP BY ALL),
k AS (SELECT ((b + 256) >> (8 - k)) - 1 AS key0, before, chr, n FROM l, (SELECT unnest(range(8)) AS k)),
u AS (SELECT 0 AS context_order, CAST(key0 AS BIGINT) AS key, n FROM k UNION ALL SELECT 1, key0 * 256 + before, n FROM k
      UNION ALL SELECT 2, chr * 256 + key0 + 1, n FROM k)
SELECT context_order, count(DISTINCT key) AS n_keys, CAST(sum(n) AS BIGINT) AS n_bits FROM u GROUP BY context_order
"""


def length_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    digits = docs.withColumn("digits", scalars.vli_encode(F.col("n_bytes")))
    return digits.select(
        "doc_id", F.size("digits").alias("n_digits"), scalars.vli_decode(F.col("digits")).alias("decoded"),
        scalars.ilog2(F.col("n_bytes")).alias("log"), scalars.is_power_of_two(F.col("n_bytes")).alias("power"),
    )


LENGTH_CODES = """
WITH n AS (SELECT doc_id, strlen(text) AS n FROM documents)
SELECT doc_id, CAST(CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END AS INTEGER) AS n_digits,
       n AS decoded, CAST(CASE WHEN n = 0 THEN 0 ELSE length(bin(n)) - 1 END AS INTEGER) AS log, bit_count(n) <= 1 AS power FROM n
"""


def version_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document compared with the one before it as if that were its decoded archive."""
    docs = _documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    decoded = docs.select((F.col("doc_id") + 1).alias("doc_id"), "content")
    return verify.verify(decoded, docs)


VERSION_DIFFERENCES = """
WITH h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents),
j AS (SELECT coalesce(a.doc_id + 1, b.doc_id) AS doc_id, a.h AS decoded, b.h AS original FROM h a FULL JOIN h b ON a.doc_id + 1 = b.doc_id),
d AS (SELECT *, list_position(list_transform(range(1, greatest(coalesce(len(decoded), 0), coalesce(len(original), 0)) + 1),
        lambda i: decoded[i] IS DISTINCT FROM original[i]), true) - 1 AS place FROM j)
SELECT doc_id, CASE WHEN decoded IS NULL THEN 'no archive' WHEN original IS NULL THEN 'no original' WHEN place IS NULL THEN 'identical'
       WHEN place = len(decoded) AND len(original) > len(decoded) THEN 'original is longer' ELSE 'differ at ' || place END AS verdict,
       CAST(place AS BIGINT) AS first_diff FROM d
"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, url = table(spark, sf_dir, "pages"), F.col("url")
    return pages.select(
        "page_id", paths.file_part(url).alias("file"), paths.folder_part(url).alias("folder"), paths.path_kind(url).alias("kind"),
        paths.original_name(paths.archive_name(url)).alias("restored"),
    )


PAGE_PATHS = r"""
SELECT page_id, regexp_extract(url, '[^/]*$') AS file, regexp_extract(url, '^.*/') AS folder,
       CASE WHEN url = '' THEN 'invalid' WHEN regexp_matches(url, '[/\\]$') THEN 'folder' ELSE 'file' END AS kind,
       regexp_extract(url, '[^/]*$') AS restored
FROM pages
"""


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return docs.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("text")).alias("n_bytes"), F.sum("n_chars").alias("n_chars"),
        F.max(F.octet_length("text")).cast("long").alias("longest"),
    )


CORPUS_TOTALS = """
SELECT lang, source, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum(n_chars) AS BIGINT) AS n_chars,
       max(strlen(text)) AS longest FROM documents GROUP BY lang, source
"""


def stream_property_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte counts of the events' properties, kept up to date while files arrive; at most 256 rows of result."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _finish(spark, incremental.streaming_byte_counts(stream, "props"), "complete")


STREAM_PROPERTY_BYTES = """
WITH h AS (SELECT unnest(regexp_extract_all(hex(encode(props)), '..')) AS hx FROM events)
SELECT CAST('0x' || hx AS INTEGER) AS b, count(*) AS n FROM h GROUP BY 1
"""


def stream_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = _finish(spark, incremental.windowed_counts(stream, "ts", "event_type", "1 day"), "complete")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


STREAM_DAILY_EVENTS = """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL
"""


def _finish(spark: SparkSession, counts: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what has arrived and gives the last state of its result."""
    out = shared_path(spark, "stream-result")
    sink = counts.writeStream.outputMode(mode).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True)
    query = sink.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text compressed, extracted and compared."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("content"))
    archives = cut(codec.compress(items, key="item_id"))
    checked = verify.verify(codec.extract(archives, key="item_id"), items, key="item_id")
    return checked.join(archives.select("item_id", "n_bytes"), "item_id")


CODEC_ROUNDTRIP = """
SELECT item_id, 'identical' AS verdict, CAST(NULL AS BIGINT) AS first_diff, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM benchmark
"""

_BITS = _BYTES + """, bits AS (
  SELECT doc_id, pos, k AS bpos, c1, c2, c3, c4, (b + 256) >> (8 - k) AS c0, (b >> (7 - k)) & 1 AS y FROM bytes, (SELECT unnest(range(8)) AS k)
)"""


def bit_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded history counts and capped estimates of each document's partial bytes, summed over documents by partial
    byte."""
    found = bit_folds(_documents(spark, sf_dir), [("none", 4)], history_limit=40)
    return found.select("c0", F.col("n_groups").alias("n_docs"), "n_bits", "n0", "n1", "p22", "seen")


_FADED = "CASE WHEN s.{0} > 2 THEN (s.{0} - 2) // 3 + 2 ELSE s.{0} END"
_HISTORY = f"""list_reduce(list_transform(ys, lambda y: {{'n0': 0, 'n1': 0, 'y': y}}), lambda s, e: CASE WHEN e.y = 0
    THEN {{'n0': least(s.n0 + 1, 40), 'n1': {_FADED.format('n1')}, 'y': 0}} ELSE {{'n0': {_FADED.format('n0')}, 'n1': least(s.n1 + 1, 40), 'y': 1}} END,
    {{'n0': 0, 'n1': 0, 'y': 0}})"""


def _capped_sql(limit: int) -> str:
    return f"""list_reduce(list_transform(ys, lambda y: {{'p': 0::BIGINT, 'n': 0::BIGINT, 'y': y::BIGINT}}), lambda s, e:
    {{'p': s.p + ((((e.y * 4194304 - s.p) >> 3) * (16384 // (2 * s.n + 3))) >> 10), 'n': least(s.n + 1, {limit}), 'y': e.y}},
    {{'p': 2097152::BIGINT, 'n': 0::BIGINT, 'y': 0::BIGINT}})"""


BIT_HISTORIES = _BITS + f""", s AS (SELECT doc_id, c0, list(y ORDER BY pos) AS ys FROM bits GROUP BY ALL),
f AS (SELECT c0, len(ys) AS n, {_HISTORY} AS s, {_capped_sql(4)} AS m FROM s)
SELECT CAST(c0 AS INTEGER) AS c0, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_bits, CAST(sum(s.n0) AS BIGINT) AS n0, CAST(sum(s.n1) AS BIGINT) AS n1,
       CAST(sum(m.p) AS BIGINT) AS p22, CAST(sum(m.n) AS BIGINT) AS seen FROM f GROUP BY f.c0
"""

_ESTIMATES = (("none", 4, "0"), ("byte", 32, _STATE), ("character", 1023, _CHARACTER))


def capped_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three direct estimates with their caps, in each document: order 0 (4), the byte before (32), the character before
    (1023). Keys, bits and the sums of last estimates and counts."""
    found = bit_folds(_documents(spark, sf_dir), [(context, limit) for context, limit, _ in _ESTIMATES])
    orders = spark.range(len(_ESTIMATES)).select(F.col("id").cast("int").alias("fold"))
    return orders.join(found, "fold", "left").groupBy(F.col("fold").alias("context_order")).agg(
        F.coalesce(F.sum("n_groups"), F.lit(0)).alias("n_keys"), *[F.sum(c).alias(c) for c in ("n_bits", "p22", "seen")]
    )


CAPPED_ESTIMATES = _BITS + "\nUNION ALL\n".join(
    f"""{'' if order else ' '}SELECT {order} AS context_order, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_bits, CAST(sum(m.p) AS BIGINT) AS p22,
       CAST(sum(m.n) AS BIGINT) AS seen FROM (SELECT len(ys) AS n, {_capped_sql(limit)} AS m FROM (
       SELECT doc_id, {context} AS ctx, c0, list(y ORDER BY pos) AS ys FROM bits GROUP BY ALL))"""
    for order, (_, limit, context) in enumerate(_ESTIMATES)
)


def mixed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mixing step for each bit of the documents: two orders' estimates, equal weights, the error and the trained
    weights' sum; sums for each document."""
    return mixed_steps(_documents(spark, sf_dir), ("none", "raw"))


_STRETCH = "CAST(greatest(-2047, least(2047, round(256 * ln((p_{0} / 4096.0) / (1 - p_{0} / 4096.0))))) AS INTEGER)"
_WEIGHT = "greatest(-32768, least(32767, 16384 + ((((x{0} * error * 2) >> 16) + 1) >> 1)))"
MIXED_PREDICTIONS = _BITS + """, w AS (
  SELECT doc_id, y, count(*) OVER a AS n_0, coalesce(sum(y) OVER a, 0) AS ones_0, count(*) OVER b AS n_1, coalesce(sum(y) OVER b, 0) AS ones_1 FROM bits
  WINDOW a AS (PARTITION BY doc_id, c0 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         b AS (PARTITION BY doc_id, c1, c0 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), p AS (
  SELECT doc_id, y, CAST(greatest(1, least(4095, round((ones_0 + 0.25::DOUBLE) / (n_0 + 0.5::DOUBLE) * 4096))) AS INTEGER) AS p_0,
         CAST(greatest(1, least(4095, round((ones_1 + 0.25::DOUBLE) / (n_1 + 0.5::DOUBLE) * 4096))) AS INTEGER) AS p_1 FROM w
), x AS (
  SELECT doc_id, y, ((p_0 - 2048) >> 2)::BIGINT AS x1, (%s >> 1)::BIGINT AS x2, ((p_1 - 2048) >> 2)::BIGINT AS x3, (%s >> 1)::BIGINT AS x4, 256::BIGINT AS x5 FROM p
), o AS (
  SELECT *, greatest(-2047, least(2047, ((((x1 + x2) * 16384) >> 8) + (((x3 + x4) * 16384) >> 8) + ((x5 * 16384) >> 8)) * 1150 >> 16)) AS opinion FROM x
), l AS (
  SELECT *, (((opinion * 16384) >> 8) * 240) >> 16 AS d FROM o
), e AS (
  SELECT *, CASE WHEN d > 2047 THEN 4095 WHEN d < -2047 THEN 1 ELSE CAST(greatest(1, least(4095, round(4096 / (1 + exp(-d / 256.0))))) AS INTEGER) END AS p FROM l
), r AS (SELECT *, ((y * 4096 - p)::BIGINT * 393216) >> 16 AS error FROM e)
SELECT doc_id, count(*) AS n_bits, CAST(sum(y) AS BIGINT) AS n_ones, CAST(sum(p) AS BIGINT) AS p_sum, CAST(sum(error) AS BIGINT) AS error_sum,
       CAST(sum(abs(error)) AS BIGINT) AS distance_sum, CAST(sum(%s) AS BIGINT) AS weight_sum FROM r GROUP BY doc_id
""" % (_STRETCH.format(0), _STRETCH.format(1), " + ".join(_WEIGHT.format(k) for k in range(1, 6)))


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's contexts of one byte end with: the run of the last byte, and the last three different bytes;
    counts and sums by the run's length."""
    last = statistics.last_runs(_documents(spark, sf_dir))
    total = lambda c: F.sum(c).cast("long")
    return last.groupBy("run").agg(F.count(F.lit(1)).alias("n_contexts"), *[total(f"byte{k}").alias(f"sum_byte{k}") for k in (1, 2, 3)])


RUN_STATES = _BYTES + """, r AS (
  SELECT doc_id, c1, b, pos, row_number() OVER (PARTITION BY doc_id, c1 ORDER BY pos)
         - row_number() OVER (PARTITION BY doc_id, c1, b ORDER BY pos) AS island FROM bytes
), g AS (SELECT doc_id, c1, b, least(count(*), 255) AS run, min(pos) AS begins FROM r GROUP BY doc_id, c1, b, island),
n AS (
  SELECT doc_id, c1, run, b AS byte1, lag(b, 1, first) OVER v AS byte2, lag(b, 2, first) OVER v AS byte3,
         row_number() OVER (PARTITION BY doc_id, c1 ORDER BY begins DESC) AS back
  FROM (SELECT *, first_value(b) OVER (PARTITION BY doc_id, c1 ORDER BY begins) AS first FROM g) WINDOW v AS (PARTITION BY doc_id, c1 ORDER BY begins)
)
SELECT CAST(run AS INTEGER) AS run, count(*) AS n_contexts, CAST(sum(byte1) AS BIGINT) AS sum_byte1, CAST(sum(byte2) AS BIGINT) AS sum_byte2,
       CAST(sum(byte3) AS BIGINT) AS sum_byte3 FROM n WHERE back = 1 GROUP BY 1
"""


def active_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many positions of the documents how many of the contexts of one, two and three bytes were met before in the
    same document (row). A context that was met before was met with every shorter one, so the counts follow from the
    numbers of distinct contexts, which are found where a text is read."""
    one = distinct_contexts(_documents(spark, sf_dir), 3)
    met = [F.col("n"), *[F.col("n") - F.col(f"d{k}") for k in (1, 2, 3)]]
    exactly = [met[0] - met[1], met[1] - met[2], met[2] - met[3], met[3]]
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("active"), x.alias("n_positions")) for k, x in enumerate(exactly)])).alias("r"))
    return rows.select("r.active", "r.n_positions")


ACTIVE_ORDERS = _BYTES + """, f AS (
  SELECT CASE WHEN row_number() OVER (PARTITION BY doc_id, c1 ORDER BY pos) > 1 THEN 1 ELSE 0 END
       + CASE WHEN row_number() OVER (PARTITION BY doc_id, c1, c2 ORDER BY pos) > 1 THEN 1 ELSE 0 END
       + CASE WHEN row_number() OVER (PARTITION BY doc_id, c1, c2, c3 ORDER BY pos) > 1 THEN 1 ELSE 0 END AS active FROM bytes
)
SELECT k.active, count(f.active) AS n_positions FROM (SELECT CAST(unnest(range(4)) AS INTEGER) AS active) k LEFT JOIN f ON f.active = k.active GROUP BY k.active
"""


def token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, their bytes and distinct tokens by type, segment markers among them."""
    found = contexts.tokens(_documents(spark, sf_dir), keep=()).groupBy("token", "type").agg(F.count(F.lit(1)).alias("n"))
    size = F.sum(F.octet_length("token") * F.col("n"))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_tokens"), size.alias("n_bytes"))


TOKEN_TYPES = _TOKENS + """
SELECT type, count(DISTINCT token) AS n_distinct, count(*) AS n_tokens, CAST(sum(strlen(token)) AS BIGINT) AS n_bytes FROM k GROUP BY type
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        byte_histogram, bit_node_counts, bit_stretch, byte_class_counts, character_contexts, token_lengths, token_prefixes, run_lengths,
        adaptive_code_length, context_occupancy, confidence_codes, direct_context_keys, length_codes, version_differences, page_paths,
        corpus_totals, stream_property_bytes, stream_daily_events, codec_roundtrip, bit_histories, mixed_predictions,
        capped_estimates, run_states, active_orders, token_types,
    )
} | {"order0_entropy": order0_entropy, "order1_entropy": order1_entropy, "order2_entropy": order2_entropy}

ORACLES: dict[str, str] = {
    "byte_histogram": BYTE_HISTOGRAM,
    "bit_node_counts": BIT_NODE_COUNTS,
    "bit_stretch": BIT_STRETCH,
    "byte_class_counts": BYTE_CLASS_COUNTS,
    "character_contexts": CHARACTER_CONTEXTS,
    "token_lengths": TOKEN_LENGTHS,
    "token_prefixes": TOKEN_PREFIXES,
    "run_lengths": RUN_LENGTHS,
    "adaptive_code_length": _code_length_sql(),
    "context_occupancy": CONTEXT_OCCUPANCY,
    "confidence_codes": CONFIDENCE_CODES,
    "direct_context_keys": DIRECT_CONTEXT_KEYS,
    "length_codes": LENGTH_CODES,
    "version_differences": VERSION_DIFFERENCES,
    "page_paths": PAGE_PATHS,
    "corpus_totals": CORPUS_TOTALS,
    "stream_property_bytes": STREAM_PROPERTY_BYTES,
    "stream_daily_events": STREAM_DAILY_EVENTS,
    "codec_roundtrip": CODEC_ROUNDTRIP,
    "bit_histories": BIT_HISTORIES,
    "mixed_predictions": MIXED_PREDICTIONS,
    "capped_estimates": CAPPED_ESTIMATES,
    "run_states": RUN_STATES,
    "active_orders": ACTIVE_ORDERS,
    "token_types": TOKEN_TYPES,
} | {f"order{k}_entropy": _entropy_sql(k) for k in range(3)}
