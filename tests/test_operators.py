import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bitloom.operators import codec, contexts, mixing, probability, statistics, verify
from bitloom.operators.bytestream import bit_counts, bit_positions, bit_streams, byte_counts, to_bits, to_bytes
from bitloom.sources import archives

TEXTS = {1: "", 2: None, 3: "a", 4: "aab abc", 5: "zero\x00 é漢😀é", 6: "12ab,,  漢字x", 7: "q" * 300}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 9) for i, t in TEXTS.items()], "doc_id long, text string, b int")


def data(text):
    return (text or "").encode()


def test_bytes_and_history(docs):
    rows = to_bytes(docs, history=2).collect()
    expected = {(i, p): (d[p], *(d[p - k] if p >= k else 0 for k in (1, 2))) for i, t in TEXTS.items() for d in [data(t)] for p in range(len(d))}
    assert {(r.doc_id, r.pos): (r.b, r.c1, r.c2) for r in rows} == expected and len(rows) == len(expected)


def test_bit_rows_and_counts_agree(docs):
    bits = to_bits(to_bytes(docs)).collect()
    whole = Counter((r.c0, r.y) for r in bits)
    nodes = {r.c0: (r.n0, r.n1) for r in bit_counts(byte_counts(docs), by=()).collect()}
    assert nodes == {c: (whole[c, 0], whole[c, 1]) for c in {c for c, _ in whole}}
    for c, (n0, n1) in nodes.items():  # counts telescope down the tree
        if c < 128:
            assert n0 == sum(nodes.get(2 * c, (0, 0))) and n1 == sum(nodes.get(2 * c + 1, (0, 0)))


def test_counts_in_spans_agree_with_rows(docs, monkeypatch):
    from bitloom.operators import bytestream

    for order in range(5):
        for by in ((), ("doc_id",)):
            keys = [*by, "b", *(f"c{k}" for k in range(1, order + 1))]
            expected = Counter()
            for i, t in TEXTS.items():
                d = data(t)
                expected.update((*((i,) if by else ()), d[p], *(d[p - k] if p >= k else 0 for k in range(1, order + 1))) for p in range(len(d)))
            for span in (1 << 22, 7):
                monkeypatch.setattr(bytestream, "_SPAN", span)
                rows = byte_counts(docs, order, by=by).collect()
                assert {tuple(r[k] for k in keys): r.n for r in rows} == expected and len(rows) == len(expected)
    assert byte_counts(docs.limit(0), 2).count() == 0


def test_bit_streams_and_positions_follow_the_text(docs):
    streams = {(r.doc_id, r.ctx, r.c0): r.ys for r in bit_streams(docs, "raw").collect()}
    expected = defaultdict(list)
    before = []
    for i, t in TEXTS.items():
        d, seen = data(t), defaultdict(list)
        for p, b in enumerate(d):
            for k in range(8):
                key = (i, d[p - 1] if p else 0, (b | 256) >> (8 - k))
                y = b >> (7 - k) & 1
                before.append((i, y, len(seen[key]), sum(seen[key])))
                seen[key].append(y)
                expected[key].append(y)
    assert streams == expected
    rows = bit_positions(docs, ("raw",)).collect()
    assert Counter((r.doc_id, r.y, r.n_0, r.ones_0) for r in rows) == Counter(before)


def test_character_prefixes(spark):
    text = "aé漢😀z"
    d = text.encode()
    found = {r.ctx for r in bit_streams(spark.createDataFrame([(1, text)], "doc_id int, text string"), "character").collect()}
    ends, parts = [], []
    for char in text:
        parts += [char.encode()[: n + 1] for n in range(len(char.encode()))]
        ends.append(char)
    assert found == {0} | {int.from_bytes(x, "big") for x in parts[:-1]} and len(parts) == len(d)


def left_of(d):
    left, out = 0, []
    for b in d:
        if left:
            left = left - 1 if 128 <= b < 192 else 0
        else:
            left = 3 if 240 <= b < 248 else 2 if 224 <= b < 240 else 1 if 192 <= b < 224 else 0
        out.append(left)
    return out


def test_utf8_states(spark, docs):
    rows = to_bytes(docs, history=3).withColumn("left", contexts.continuation_left(*[F.col(c) for c in ("b", "c1", "c2", "c3")])).collect()
    assert {(r.doc_id, r.pos): r.left for r in rows} == {(i, p): x for i, t in TEXTS.items() for p, x in enumerate(left_of(data(t)))}
    broken = [b"", b"\xe6\xbc", b"\xc3\xc3\xa9a", b"\x80\x80", b"\xf0\x9f\x98\x80\xff", bytes(range(256))]
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(broken)], "doc_id int, content binary")
    broken.append(bytes(random.Random(5).choices([0x41, 0x80, 0xBF, 0xC3, 0xE6, 0xF0, 0xF8, 0xFF], k=3000)))
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(broken)], "doc_id int, content binary")
    states = {(r.doc_id, r.pos): r.left for r in contexts.utf8_states(frame).collect()}
    assert states == {(i, p): x for i, c in enumerate(broken) for p, x in enumerate(left_of(c))}


def test_tokens_and_markers(spark, docs):
    rows = contexts.tokens(docs).collect()
    for i, t in TEXTS.items():
        own = sorted((r.ord, r.token, r.type) for r in rows if r.doc_id == i)
        assert "".join(x[1] for x in own) == (t or "") and all(a[2] != b[2] for a, b in zip(own, own[1:]))
    text = spark.createDataFrame([(1, "漢字。中文、x1")], "doc_id int, text string")
    cut = contexts.tokens(text, markers=("。", "、")).orderBy("ord").collect()
    assert [(r.token, r.type) for r in cut] == [("漢字", 2), ("。", 3), ("中文", 2), ("、", 3), ("x1", 0)]
    assert len(contexts.SEGMENT_MARKERS) == 43 and [r.token for r in contexts.tokens(text).orderBy("ord").collect()] == [r.token for r in cut]
    prefixes = contexts.token_prefixes(contexts.tokens(text, markers=())).collect()
    assert len(prefixes) == len("漢字。中文、x1".encode()) and sum(r.prefix == "" for r in prefixes) == 2


def test_character_contexts(docs):
    for order in (1, 3):
        expected = Counter((t[max(0, i - order) : i], t[i]) for t in TEXTS.values() if t for i in range(len(t)))
        got = {(r.context, r.next): r.n for r in contexts.character_contexts(docs, order).collect()}
        assert got == expected


def test_runs(spark):
    sequence = b"AAAB" + b"C" * 4 + b"ABA"
    frame = spark.createDataFrame([(1, i, b, 0) for i, b in enumerate(sequence)], "doc_id int, pos int, b int, c1 int")
    rows = statistics.run_rows(frame, ("c1",), cap=3).orderBy("pos").collect()
    run = [1, 2, 3, 1, 1, 2, 3, 3, 1, 1, 1]
    second = "AAAABBBBCAB"
    third = "AAAAAAAABCA"
    assert [r.run for r in rows] == run
    assert [(chr(r.byte2), chr(r.byte3)) for r in rows] == list(zip(second, third))
    texts = spark.createDataFrame([("aaab",), ("xaxaxb",), (None,), ("",), ("q" * 400,)], "text string")
    # after a: aa b | after x: aa b, after a: xx | after nothing one byte each, after q: 399
    histogram = {r.run: r.n for r in statistics.run_histogram(texts, cap=255).collect()}
    assert histogram == {1: 5, 2: 3, 255: 1}


def test_last_runs_are_the_last_run_rows(docs):
    rows = statistics.run_rows(to_bytes(docs, history=1), ("c1",)).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.pos):
        last[r.doc_id, r.c1] = (r.run, r.byte1, r.byte2, r.byte3)
    found = statistics.last_runs(docs).collect()
    assert {(r.doc_id, r.c1): (r.run, r.byte1, r.byte2, r.byte3) for r in found} == last and len(found) == len(last)


def test_log_gamma(spark):
    xs = [0.25, 0.5, 1.0, 1.25, 7.5, 8.0, 1000.25, 1e9 + 0.5]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", probability.log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-11) for r in rows)


def test_selectors(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(9), rng.randrange(7), rng.randrange(8), rng.randrange(1 << 16) & rng.choice([0, 1, 0xFF, 0xFF00, 0xFFFF]), rng.randrange(1, 256), rng.randrange(256), rng.randrange(2), rng.randrange(6561)) for _ in range(300)]
    names = ["order", "kind", "bpos", "misses", "c0", "c1", "boundary", "confidence"]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    out = frame.select(*names, *[c.alias(f"s{i}") for i, c in enumerate(contexts.selectors(*[F.col(n) for n in names]))]).collect()
    for r in out:
        # misses of the current byte stand in the lowest bpos bits; the flags look from the byte's border
        current, older = r.misses & (1 << r.bpos) - 1 if r.bpos else r.misses & 255, r.misses >> (r.bpos or 8)
        flags = (current & 1 != 0) | (current & 0xFE != 0) << 1 | (older & 255 != 0) << 2
        assert r.s0 == (r.order * 7 + r.kind) * 8 + r.bpos and r.s3 == r.confidence
        assert r.s1 == (flags * 7 + r.kind) * 255 + r.c0 - 1, r
        assert r.s2 == r.order << 10 | (r.misses != 0) << 9 | r.boundary << 8 | r.c1


def test_closed_form_equals_window(docs):
    bits = to_bits(to_bytes(docs, history=1))
    for keys in (("c0",), ("c1", "c0")):
        window = probability.prequential(bits, keys).agg(F.sum(probability.cost(F.col("y"), F.col("p1")))).first()[0]
        nodes = bits.groupBy(*keys).agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
        closed = nodes.agg(F.sum(probability.total_bits(F.col("n0"), F.col("n1")))).first()[0]
        assert closed == pytest.approx(window, abs=1e-6)


def test_capped_fold_follows_the_ideal(spark):
    rng = random.Random(1)
    ys = [int(rng.random() < 0.3) for _ in range(800)]
    frame = spark.createDataFrame([(ys,)], "ys array<int>")
    r = frame.select(probability.capped_fold(F.col("ys"), 1023).alias("m")).first().m
    ideal = (sum(ys) + 0.25) / (len(ys) + 0.5)
    assert r.n == 800 and r.p / 2**22 == pytest.approx(ideal, abs=2e-3)
    assert frame.select(probability.capped_fold(F.col("ys"), 4).alias("m")).first().m.n == 4


def test_entropy_and_confidence(docs):
    counts = defaultdict(Counter)
    for t in TEXTS.values():
        for p, b in enumerate(data(t)):
            counts[data(t)[p - 1] if p else 0][b] += 1
    total = sum(sum(c.values()) for c in counts.values())
    bits = sum(n * math.log2(sum(c.values()) / n) for c in counts.values() for n in c.values())
    r = statistics.conditional_entropy(byte_counts(docs, 1), ("c1",)).first()
    assert (r.n_bytes, r.n_contexts) == (total, len(counts)) and r.bits_per_byte == pytest.approx(bits / total)
    digits = docs.sparkSession.range(1).select(statistics.confidence_code([statistics.confidence_digit(F.lit(n)) for n in (0, 1, 7)]).alias("c"))
    assert digits.first().c == 5
    assert docs.limit(1).select(statistics.active_orders([F.lit(True), F.lit(None), F.lit(False), F.lit(True)]).alias("n")).first().n == 2


def test_bit_history(spark):
    ys = [0] * 10 + [1, 1, 0]
    frame = spark.createDataFrame([(1, i, y) for i, y in enumerate(ys)], "k int, pos int, y int").repartition(4)
    n0 = n1 = 0
    for y in ys:
        fade = lambda n: (n - 2) // 3 + 2 if n > 2 else n
        n0, n1 = (min(n0 + 1, 40), fade(n1)) if y == 0 else (fade(n0), min(n1 + 1, 40))
    r = statistics.bit_history(frame, ("k",)).first()
    assert (r.n0, r.n1) == (n0, n1)


def test_mixing(spark):
    rng = random.Random(2)
    for size in (1, 4, 5):
        t = [rng.randrange(-2047, 2048) for _ in range(size)]
        w = [rng.randrange(-32768, 32768) for _ in range(size)]
        err = rng.randrange(-30000, 30000)
        frame = spark.createDataFrame([(t, w)], "t array<int>, w array<int>")
        r = frame.select(mixing.dot_product(F.col("t"), F.col("w")).alias("d"), mixing.train(F.col("t"), F.col("w"), F.lit(err)).alias("n")).first()
        lists = frame.select(*[F.col("t")[i].alias(f"t{i}") for i in range(size)], *[F.col("w")[i].alias(f"w{i}") for i in range(size)])
        ts, ws = [F.col(f"t{i}") for i in range(size)], [F.col(f"w{i}") for i in range(size)]
        same = lists.select(mixing.dot_of(ts, ws).alias("d"), F.array(*mixing.train_of(ts, ws, F.lit(err))).alias("n"), mixing.mix_of(ts, [ws, ws], [F.lit(9000)] * 2).alias("p")).first()
        mixed = frame.select(mixing.mix(F.col("t"), [F.col("w")] * 2, F.array(F.lit(9000), F.lit(9000))).alias("p")).first()
        assert (same.d, same.n, same.p) == (r.d, r.n, mixed.p)
        pad = [a * b for a, b in zip(t, w)] + [0]
        assert r.d == sum((pad[i] + pad[i + 1]) >> 8 for i in range(0, size, 2))
        assert r.n == [max(-32768, min(32767, b + (((2 * a * err >> 16) + 1) >> 1))) for a, b in zip(t, w)]
    zero = spark.range(1).select(mixing.mix(F.array(F.lit(5), F.lit(7)), [F.array(F.lit(0), F.lit(0))], F.array(F.lit(0))).alias("p")).first()
    assert zero.p == 2048


def test_run_and_structure_inputs(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    one = spark.range(1).select(
        probability.run_input(*lit(9, 65, 66, 66, 1, 0)).alias("first"), probability.run_input(*lit(9, 65, 200, 66, 3, 1)).alias("second"),
        probability.run_input(*lit(9, 65, 66, 66, 3, 1)).alias("none"), probability.structure_input(*lit(1, 0, 0)).alias("s"),
        probability.persistence_input(*lit(200, 0)).alias("p"),
    ).first()
    assert one.first < 0 and one.second > 0 and (one.none, one.s, one.p) == (0, 2047, 512)


def test_verdicts(spark):
    rows = [("abc", "abc", "identical", None), ("abc", "abd", "differ at 2", 2), ("abcd", "abc", "original is longer", 3), ("ab", "abc", "differ at 2", 2), ("", None, "identical", None), ("é", "è", "differ at 1", 1)]
    a = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)] + [(50, "x")], "doc_id int, content string")
    b = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)] + [(60, "x")], "doc_id int, content string")
    out = {r.doc_id: (r.verdict, r.first_diff) for r in verify.verify(a, b).collect()}
    assert out == {i: (r[2], r[3]) for i, r in enumerate(rows)} | {50: ("no original", 0), 60: ("no archive", 0)}


def test_codec_round_trip(spark):
    rng = random.Random(3)
    contents = [b"", b"\0", b"\xff", bytes(range(256)), b"a" * 300, "ab é漢😀".encode() * 5, bytes(rng.randrange(256) for _ in range(200)), b"the cat the cat the cat sat" * 8]
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)] + [(99, None)], "doc_id int, content binary")
    packed = codec.compress(frame, level=7)
    back = {r.doc_id: r.content for r in codec.extract(packed).collect()}
    assert {i: bytes(back[i]) for i in range(len(contents))} == dict(enumerate(contents)) and back[99] == b""
    sizes = {r.doc_id: len(r.archive) for r in packed.collect()}
    assert sizes[4] < 80 and sizes[7] < 120
    assert {r.verdict for r in verify.verify(codec.extract(packed), frame).collect()} == {"identical"}
    with pytest.raises(ValueError):
        codec.compress(frame, level=13)


def test_headers(spark):
    frame = spark.range(1).select(archives.header(F.lit(3), F.lit(16384).cast("long")).alias("a"))
    h = frame.select(archives.read_header(F.col("a")).alias("h")).first().h
    assert (h.level, h.n_bytes, h.body_at, h.error) == (3, 16384, 16, None)
    bad = spark.createDataFrame([(bytearray(b"nothing here at all"),), (bytearray(b"bitloom-arc\x0d\x01"),), (bytearray(b"bitloom-arc\x01"),)], "a binary")
    assert [r.h.error for r in bad.select(archives.read_header(F.col("a")).alias("h")).collect()] == ["not an archive", "bad level", "no length"]
    assert codec.extract(bad.withColumn("doc_id", F.lit(1)).withColumnRenamed("a", "archive")).where("content is null").count() == 3


def test_files_and_parquet_sources(spark, tmp_path, docs):
    (tmp_path / "one.bin").write_bytes(b"\x00\xffabc")
    r = archives.read_files(spark, str(tmp_path / "one.bin")).first()
    assert r.n_bytes == 5 and bytes(r.content) == b"\x00\xffabc"
    docs.write.parquet(str(tmp_path / "d"))
    read = archives.read_documents(spark, str(tmp_path / "d"))
    assert read.count() == len(TEXTS) and read.columns == ["doc_id", "content"]


def test_priors_and_misses(spark):
    frame = spark.createDataFrame([(1, i, m) for i, m in enumerate([1, 0, 1, 1])], "k int, pos int, miss int").repartition(3)
    rows = probability.miss_register(frame, ("k",), ("pos",), "miss").orderBy("pos").collect()
    assert [r.misses for r in rows] == [0, 1, 2, 5]
    one = spark.range(1).select(
        probability.history_prior(F.lit(0), F.lit(0)).alias("p"), *[c.alias(f"x{i}") for i, c in enumerate(probability.history_inputs(F.lit(3000), F.lit(True), F.lit(False)))]
    ).first()
    assert one.p == 0.5 and one.x1 == (3000 - 2048) >> 2 and one.x0 > 0


def test_command_line(spark, tmp_path, capsys):
    from bitloom.__main__ import main

    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.txt").write_bytes(b"some text " * n)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert main(["compress", src, out, "--level", "3"]) == 0
    assert main(["compare", out, src]) == 0
    (tmp_path / "in" / "1.txt").write_bytes(b"some test ")
    assert main(["compare", out, src]) == 1
    assert "differ at 7" in capsys.readouterr().out
    assert main(["extract", out, str(tmp_path / "back")]) == 0
