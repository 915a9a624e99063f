import pytest

from bitloom.plans import queries

TEXTS = {1: "ab ab ab", 2: "É" * 6, 3: "", 4: "zz" * 40}


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_bit_histories_cover_every_document(spark, folder):
    partial = {}
    for i, text in TEXTS.items():
        for byte in text.encode():
            for k in range(8):
                partial.setdefault((byte | 256) >> (8 - k), []).append(i)
    out = {r.c0: r for r in queries.bit_histories(spark, folder).collect()}
    assert {c: (r.n_docs, r.n_bits, r.seen) for c, r in out.items()} == {
        c: (len(set(v)), len(v), sum(min(4, v.count(i)) for i in set(v))) for c, v in partial.items()
    }


def test_mixed_predictions_cover_every_document(spark, folder):
    out = {r.doc_id: (r.n_bits, r.n_ones) for r in queries.mixed_predictions(spark, folder).collect()}
    expected = {i: (8 * len(b), sum(x.bit_count() for x in b)) for i, t in TEXTS.items() if (b := t.encode())}
    assert out == expected
