import hashlib
import html
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bitloom.llm import chat_format as chat
from bitloom.llm import html_extract as h
from bitloom.llm import sharding, toxicity
from bitloom.llm.common import shared_path

PAGE = (
    '<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="x">'
    '<header>Site name</header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies</div>'
    "<article><h1>Big &amp; <i>bold</i></h1><p>First\n  para&eacute; here with some words.<p>Second <b>one</b><br>after break"
    '<div class="ad">Buy now</div><p>Last words.</p><section id="comments"><p>I disagree a lot</p></section></article>'
    '<aside>Related stuff</aside><form>Sign <input name="q">up</form><footer>&copy; us</footer><!-- end'
)
TEXT = "Big & bold\nFirst paraé here with some words.\nSecond one\nafter break\nLast words."


def test_page_text():
    inside, outside = h.learn_counts(PAGE)
    assert inside["p"] == 1 and outside["nav"] == 1 and "li" not in outside and "a" not in outside
    assert h.extract(PAGE, h.PageModel()) == TEXT
    layout = '<div class="has-sidebar wide"><p>kept</p><div class="sidebar">gone</div></div>'
    assert h.extract(layout, h.PageModel()) == "kept"
    assert h.extract("plain &lt;words&gt;", h.PageModel()) == "plain <words>"
    assert h.extract("", h.PageModel()) == h.extract("<p></p>", h.PageModel()) == ""


def test_article_parts_stay():
    parts = ["The title", "word " * 19 + "word", *["three words each"] * 5, "1", "2", "see this", "six words in the last one"]
    page = (
        f"<nav><a>menu</a></nav><article><h1>{parts[0]}</h1><p>{parts[1]}</p><ul>" + "<li>three words each</li>" * 5
        + "</ul><table><tr><td>1<td>2</tr></table><p>see <a href='x'>this</a></p><div class='legal search tags form alert share copyright'></div>"
        f"<p>{parts[-1]}</p></article><footer>foot</footer>"
    )
    assert h.extract(page, h.PageModel()).split("\n") == parts
    long = "<div class='legal'><p>" + "word " * 50 + "</p></div>"
    assert h.extract(f"<article><p>one</p>{long}<p>two</p></article>", h.PageModel()).split("\n") == ["one", ("word " * 50).strip(), "two"]


def test_tags_as_html_reads_them():
    text = lambda page: h.extract(page, h.PageModel())
    assert text("<p title=it's>Hello there</p><p>don't stop now</p>") == "Hello there\ndon't stop now"
    assert text("<div><p class=a'b>Hello there</p></div>") == "Hello there"
    assert text("<p title=\"a > b\">Hello</p>") == "Hello" and text("<p>&am<b>p;</b>") == "&amp;"


def test_region_is_the_best_run():
    rng = random.Random(4)
    for _ in range(200):
        value = [rng.choice([1, 2, 5, -0.05, -3, -20]) for _ in range(12)]
        s, e = h.region(value)
        assert sum(value[s:e]) >= max(sum(value[i:j]) for i in range(12) for j in range(i, 13)) - 1e-9


def made_page(rng, prose):
    """A page of random parts and the text that should come of it."""
    blocks = [" ".join(prose(rng.randrange(4, 30))) for _ in range(rng.randrange(2, 9))]
    body, shown = f"<h1>{blocks[0]}</h1>", [blocks[0]]
    for b in blocks[1:]:
        kind = rng.choice(["p", "ul", "quote", "ad", "open"])
        if kind == "ad":
            body += f"<div class='ad box'>{' '.join(prose(8))}</div>"
        shown.append(b)
        body += {"ul": f"<ul><li>{b}</li></ul>", "quote": f"<blockquote><p>{b}</p></blockquote>", "open": f"<p>{b}"}.get(kind, f"<p>{b}</p>")
    junk = lambda n: " ".join(prose(n))
    menu = "".join(f"<li><a href='/{i}'>{junk(2)}</a></li>" for i in range(rng.randrange(3, 9)))
    around = rng.choice(["<nav><ul>%s</ul></nav>", "<div class='main-menu'><ul>%s</ul></div>", "<header>%s</header>"]) % menu
    tail = rng.choice([f"<aside>{junk(15)}</aside>", f"<div id=comments><div class=comment><p>{junk(40)}</p></div></div>", f"<form>{junk(5)}</form>", ""])
    return f"<html><body>{around}<article>{body}</article>{tail}<footer>{junk(9)}</footer></body></html>", "\n".join(shown)


def test_pages_by_the_scan_against_what_they_were_made_of(spark, prose, monkeypatch):
    rng = random.Random(8)
    made = [made_page(rng, prose) for _ in range(120)]
    pages = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")
    model = h.fit(pages)
    assert model.of("nav") < -20 < -0.5 <= model.of("a") and model.of("li") > -1
    out = {r.page_id: r.text for r in h.main_text(pages, model).collect()}
    assert out == {i: t for i, (_, t) in enumerate(made)}
    monkeypatch.setattr(h, "region", lambda scores: (0, len(scores)))  # without the scan menus and footers come along
    assert sum(h.extract(p, model) != t for p, t in made) > 110


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (2, "u", "", "x"), (None, "u", "a " * 100_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = h.main_text(pages, h.fit(pages)).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in out) == [("1", len(TEXT)), ("2", 0), ("2", 0), ("None", 199_999)]
    assert h.main_text(pages.limit(0), h.fit(pages.limit(0))).count() == 0


def test_chat_digests(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\p\\b\\n <\\| <|", "", None, "ü😀\nline", "<<|im_end|>\n"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb"]), rng.choice(nasty), 1) for c in range(20) for t in range(rng.randrange(1, 9))]
    rows += [(50, t, "assistant", f"long {t}", 1) for t in range(300)] + [(None, 0, "user", "x", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(5)
    out = {r.conv_id: r for r in chat.digests(chat.read_back(chat.render(chat.fold(chat.as_events(frame))))).collect()}
    groups = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert set(out) == set(groups)
    for c, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (out[c].n_turns, out[c].loss_chars) == (len(turns), len(loss))
        assert out[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty_chat_log(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.read_back(chat.render(chat.fold(chat.as_events(frame))))).count() == 0


def test_chat_events(spark):
    rows = [
        (1, 1, 0, 0, "delta", "user", "He"), (1, 1, 0, 1, "delta", "user", "llo"), (1, 2, 1, 2, "delta", "assistant", "bad"),
        (1, 2, 1, 3, "regenerate", "assistant", None), (1, 2, 1, 5, "delta", "assistant", "od"), (1, 2, 1, 4, "delta", "assistant", "go"),
        (1, 1, 0, 6, "edit", "user", "Hi"), (1, 1, 0, 7, "delta", None, "!"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, message_id long, position long, seq long, kind string, role string, text string")
    out = chat.read_back(chat.render(chat.fold(events))).first()
    assert [(t.role, t.text) for t in out.turns] == [("user", "Hi!"), ("assistant", "good")] and out.loss_texts == ["good"]


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, "t" * rng.randrange(3000)) for i in range(203)] + [(7, "again"), (7, "again"), (None, None), (None, "x" * 400_000)]
    frame = spark.createDataFrame([(i, t, 5, 9, 1) for i, t in rows], "doc_id long, text string, shard int, slot long, row int")
    seen = []
    for parts in (1, 5):
        path = shared_path(spark, "s")
        sharding.write_shards(frame.repartition(parts), path, bucket_bytes=20_000)
        out = sharding.read_shards(spark, path, frame.schema).collect()
        assert sorted((str(r.row.doc_id), r.row.text or "") for r in out) == sorted((str(i), t or "") for i, t in rows)
        assert {(r.row.shard, r.row.slot, r.row.row) for r in out} == {(5, 9, 1)}
        sizes = Counter(r.shard for r in out)
        assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
        assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())
        seen.append(sorted((r.shard, r.slot, str(r.row.doc_id)) for r in out))
    assert seen[0] == seen[1]
    assert [x[2] for x in seen[0]] != sorted(x[2] for x in seen[0])
    order = sharding._fisher_yates(1000, np.random.default_rng(1))
    assert sorted(order.tolist()) == list(range(1000)) and order.tolist() != sorted(order.tolist())


def test_shards_against_the_two_passes_by_hand(spark):
    rng = random.Random(12)
    rows = [(i, "t" * rng.randrange(3000)) for i in range(300)] + [(None, "z"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    path, size, seed, bucket_bytes = shared_path(spark, "s"), sum(len(t or "") + 1 for _, t in rows), 7, 20_000
    sharding.write_shards(frame, path, bucket_bytes=bucket_bytes, partition_bytes=1 << 20)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = -(-max(size // parts, bucket_bytes) // bucket_bytes)
    h = sharding._hash("doc_id", "text", seed)
    dealt = frame.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.pmod(h, F.lit(sharding.SLOTS)).alias("slot"), F.pmod(F.xxhash64(h, F.lit(1)), F.lit(fine)).alias("bucket"))
    buckets = {}
    for r in dealt.collect():
        buckets.setdefault((r.slot * parts // sharding.SLOTS, r.bucket), []).append((r.doc_id is not None, r.doc_id or 0, r.t))
    order = []
    for part, bucket in sorted(buckets):
        held = sorted(buckets[part, bucket])
        order += [held[i] for i in sharding._fisher_yates(len(held), np.random.default_rng([seed, part, bucket, 0]))]
    shards = {}
    expected = []
    for at, (known, i, t) in enumerate(order):
        shard = at * 8 // len(rows)
        expected.append((str(i if known else None), t, shard, shards.setdefault(shard, 0)))
        shards[shard] += 1
    out = sharding.read_shards(spark, path, frame.schema).collect()
    assert sorted((str(r.row.doc_id), r.row.text or "", r.shard, r.slot) for r in out) == sorted(expected)


def test_repeated_rows_are_split_over_tasks(spark, docs):
    rows = [(1, "same text")] * 3000 + [(i, "other") for i in range(500)]
    path = shared_path(spark, "s")
    sharding.write_shards(docs(rows).repartition(3), path, bucket_bytes=1000, partition_bytes=4000)
    out = sharding.read_shards(spark, path, docs([]).schema)
    sizes = {r.shard: (r.n, r.top, r.d) for r in out.groupBy("shard").agg(F.count("slot").alias("n"), F.max("slot").alias("top"), F.count_distinct("slot").alias("d")).collect()}
    assert set(sizes) == set(range(8)) and all(n in (437, 438) and top == n - 1 and d == n for n, top, d in sizes.values())
    assert sorted(r[0] for r in out.groupBy("row.doc_id", "row.text").count().select("count").collect()) == [1] * 500 + [3000]
    assert spark.read.parquet(path).inputFiles().__len__() > 8 * 3


def test_empty_shards(spark, docs):
    path = shared_path(spark, "s")
    sharding.write_shards(docs([]), path)
    assert sharding.read_shards(spark, path, docs([]).schema).count() == 0


EVENT = {name: i for i, name in enumerate(toxicity.EVENTS)}


def test_grammar():
    g = toxicity.Grammar({"idiot": 4.0, "scum$": 2.0})

    def events(text):
        f = g.features(text)
        return {k for k, i in EVENT.items() if f[i] > 0}

    assert events("what an idiotic thing") == {"plain"} and events("scummy") == set()
    assert events("you are an idiot") == {"aimed"} and events("idiot, you") == {"aimed"}
    assert events("that is not an idiot") == {"negated"} and events("he said they were scum") == {"reported"}
    assert events("I will kill you") == {"threat"} and events("you I kill") == {"threat"}
    assert events("i will hurt them badly") == {"threat"} and events("they kill the lights") == {"threat"}
    assert events("kill the lights") == set() and events("i will not kill you") == {"negated"}
    assert events("she said i will kill you") == {"reported"} and events("not here. idiot") == {"plain"}


def test_composed_machine_equals_the_five_in_turn():
    rng = random.Random(6)
    follow, weights = toxicity.composed()
    for _ in range(2000):
        symbols = rng.choices(toxicity.ALPHABET, k=rng.randrange(0, 14))
        written = symbols
        for machine in toxicity.grammar_machines():
            written = machine.run(written)
        expected = [toxicity.event_weights(w).tolist() for w in written]
        state, got = 0, []
        for s in symbols:
            k = toxicity.ALPHABET.index(s)
            got.append(list(weights[state][k] or [0.0] * 5))
            state = follow[state][k]
        assert got == expected, symbols


def test_negated_and_reported_events_never_raise_a_score(spark, docs, prose):
    rng = random.Random(2)
    rows = [(i, " ".join([*prose(20), *(["not", "zoquete"] if i % 3 == 0 else []), *(["zoquete"] if i % 9 == 0 else [])])) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs(rows), labels)
    assert all(w * s >= 0 for w, s in zip(model.weights, toxicity.SIGNS))
    g = toxicity.Grammar({"zoquete": 5.0})
    base = " ".join(prose(10))
    for text in ("not a zoquete", "he said zoquete", "i will not kill you"):
        assert model.score(g, f"{base}. {text}") <= model.score(g, f"{base}. {' '.join(prose(len(text.split())))}") + 1e-9
    assert model.score(g, "i will kill you") > model.score(g, "it was fine now")


def test_held_out_accuracy(spark, docs, prose):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        words, toxic = prose(60), rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            words[rng.randrange(60)] = rng.choice(["zoquete", "zoquetes", "gulmir"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 0))
    rows += [(900, None), (901, ""), (None, "zoquete"), (902, "zoquete " * 50_000)]
    marks = spark.createDataFrame(labels + [(900, None, 0), (None, 1, 0), (5, labels[5][1], 0)], "doc_id long, toxic int, score int")
    model = toxicity.fit(docs(rows), marks)
    out = toxicity.score(docs(rows), model).withColumn("held_out", toxicity.held_out()).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {i: y for i, y, _ in labels}
    held = [(truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.95 * len(held)
    kept = toxicity.drop_toxic(docs(rows), model)
    assert kept.columns == docs([]).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.predicted}


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs([(1, "a")]), none)
    assert toxicity.score(docs([(1, "a")]), model).first().predicted == 0
    assert toxicity.score(docs([]), model).count() == 0


def test_character_references_match_the_standard_library():
    assert h.extract("<p>&amp &quo &#65; &eacute;</p>", h.PageModel()) == html.unescape("&amp &quo &#65; &eacute;")
