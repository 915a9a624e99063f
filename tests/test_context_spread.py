import random
from collections import defaultdict

import pytest

from bitloom.operators import contexts
from bitloom.plans import queries


def by_hand(texts):
    out = []
    for k in range(1, 8):
        found = defaultdict(set)
        for t in texts:
            for i, c in enumerate(t or ""):
                found[t[max(i - k, 0) : i]].add(c)
        out.append((k, len(found), sum(len(x) == 1 for x in found.values())))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abé€😀\0 ", "".join(map(chr, range(300, 700)))])
@pytest.mark.parametrize("small", [False, True])
def test_context_spread_by_hand(spark, monkeypatch, alphabet, small):
    if small:
        for name, value in (("_CHARACTERS", 50), ("_REMEMBERED", 40), ("_SENT", 7)):
            monkeypatch.setattr(contexts, name, value)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    rng = random.Random(3)
    texts = [None, "", "a", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(40))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    try:
        found = contexts.context_spread(frame).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == by_hand(texts)


def test_character_contexts_shuffle_no_strings(spark, tmp_path):
    spark.createDataFrame([(1, "abcab"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.character_contexts(spark, str(tmp_path))
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(*r, 5) for r in by_hand(["abcab"])]
