import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bitloom.llm import sentencepiece_codec as sp
from bitloom.llm import token_counts, token_files
from bitloom.llm.common import shared_path, tokenizer_path

TEXTS = ["", None, "Hello  world", " lead and trail ", "tab\tand\nline", "é ① 😀 \x00 ſ ▁ <s> don't", "a" * 300, "one-two ... ===", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(library):
    codec = sp.Codec(open(tokenizer_path("piece_bpe_32k.model"), "rb").read())
    rng = random.Random(2)
    units = ["the", "of ", " ", "  ", "\n", "é", "①", "aa", "ing", "▁", "\x00", "😀", "...", "-=", "Ünder", "1234", "ion"]
    texts = ["".join(rng.choice(units) for _ in range(rng.randrange(30))) for _ in range(500)] + [t or "" for t in TEXTS]
    for text, ids in zip(texts, codec.encode(texts)):
        assert list(ids) == library.encode(text)
        assert codec.decode(ids) == library.decode(library.encode(text))


def test_viterbi_against_all_paths():
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "ba": -3.0, "▁a": -3.5, "aba": -5.0, "bb": -4.0}
    vocabulary = sp.Vocabulary({p: i for i, p in enumerate(pieces)}, pieces, unigram=True)
    words = ["▁" + "".join(w) for n in range(1, 7) for w in itertools.product("ab", repeat=n)]

    def best(word):
        if not word:
            return 0.0
        return max(pieces[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in pieces)

    for word, found in vocabulary.segment(words):
        assert "".join(found) == word
        assert sum(pieces[p] for p in found) == pytest.approx(best(word))


def test_round_trip_rows(docs, library):
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (3, "again")]
    out = sp.round_trip(docs(rows)).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.ids_crc32): r for r in out}
    for i, t in rows:
        ids = np.array(library.encode(t or ""), "<u4")
        r = by[i, zlib.crc32(ids.tobytes())]
        assert r.n_pieces == len(ids)
        assert r.exact == ("▁" not in (t or ""))
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids.tolist()).encode()).hexdigest()
    back = sp.decode(sp.encode(docs(rows)))
    assert sorted(r.text.replace("▁", " ") for r in back.collect()) == sorted((t or "").replace("▁", " ") for _, t in rows)
    assert sp.round_trip(docs([])).count() == 0


def test_packed_levels():
    rng = np.random.default_rng(0)
    for n in (0, 1, 8, 9, 511, 512, 513, 3000):
        values = rng.integers(0, 1 << rng.integers(1, 32), n).astype(np.uint32)
        packed = token_files.Packed(token_files.pack(values))
        assert len(packed) == n
        for start, end in np.sort(rng.integers(0, n + 1, (40, 2)), axis=1):
            assert (packed.slice(start, end) == values[start:end]).all()
        assert all(packed[i] == values[i] for i in (rng.integers(0, n, 40) if n else ()))


def whole(texts):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files(spark, docs, monkeypatch):
    texts = TEXTS + ["It's we'll 'S Ünïcode é a b  x", "<|endoftext|> inside"]
    rows = [(10 - i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "again")]
    path = shared_path(spark, "t")
    token_files.write_tokens(docs(rows), path, files=3)
    out = token_files.read_documents(spark, path).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected = 0, []
    for (i, _), ids in zip(ordered, whole([t for _, t in ordered])):
        ids = [*ids, 1]
        expected.append((str(i), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in out) == sorted(expected)
    flat = [x for _, t in ordered for x in [*whole([t])[0], 1]]
    for at in (0, 1, len(flat) // 2, len(flat) - 1):
        assert token_files.read_token(spark, path, at) == flat[at]
    assert token_files.read_token(spark, path, len(flat)) is None
    part = token_files.read_tokens(spark, path, 5, 3000).orderBy("position").collect()
    assert [(r.position, r.token) for r in part] == list(enumerate(flat[5:3000], 5))
    empty = shared_path(spark, "t")
    token_files.write_tokens(docs([]), empty)
    assert token_files.read_documents(spark, empty).count() == 0 and token_files.read_token(spark, empty, 0) is None


def same_ids(texts):
    model = open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read()
    found = [x.tolist() for x in token_files.WordEncoder(model).encode(texts)]
    return [t for t, a, b in zip(texts, found, whole(texts)) if a != b]


def test_every_character_has_the_library_s_ids():
    assert same_ids([f"ab{chr(c)}cd {chr(c)} x{chr(c)}" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]) == []


def test_mixed_strings_have_the_library_s_ids():
    rng = random.Random(3)
    pool = [chr(c) for c in range(32, 0x250)] + [" "] * 80 + list("abcdefghijklmnopqrstuvwxyz'") * 6
    pool += ["'s", "'LL", "\n", "<|", "Ɓ", "ẞ", "\u212a", "\u212b", "ı", "İ", "\u0301", "中", "😀", "\u200b", "\x85", "\xa0"]
    assert same_ids(["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(20_000)]) == []


def test_remembered_words_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED_BYTES", 50_000)
    encoder = token_files.WordEncoder(open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read())
    for n in range(12):
        texts = ["".join(chr(0x4E00 + (i * 37 + n * 911) % 9000) for i in range(5000)), f"word{n} the"]
        assert [x.tolist() for x in encoder.encode(texts)] == whole(texts)
        assert len(encoder.now[3]) < 60_000 and len(encoder.old[3]) < 60_000


def test_counts_across_blocks(spark):
    rng = np.random.default_rng(1)
    rows, expected = [], {}
    for file in range(3):
        lengths = rng.choice([0, 0, 1, 3, 9, 50], 40).tolist()
        ids = np.concatenate([[*([5] * n), 9] for n in lengths] + [[7, 7]]).astype("<u2")
        expected |= {(file, k): n for k, n in enumerate(lengths)}
        rows += [(file, b, ids[s : s + 8].tobytes()) for b, s in enumerate(range(0, len(ids), 8))]
    tokens = spark.createDataFrame([(f, b, bytearray(p)) for f, b, p in rows], "file int, block int, payload binary")
    for group in (2, 1000):
        out = token_counts.scan(tokens, separator=9, block_ids=8, group_blocks=group).collect()
        assert {(r.file, r.ordinal): r.n_tokens for r in out} == expected and len(out) == len(expected)


def test_count_tokens(spark, docs):
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (3, "again")]
    out = token_counts.count_tokens(docs(rows), shared_path(spark, "f")).collect()
    expected = sorted((str(i), len(ids)) for (i, _), ids in zip(rows, whole([t for _, t in rows])))
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == expected
