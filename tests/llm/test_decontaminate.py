import itertools
import random
import re

from bitloom.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(doc, item):
    """Whether some aligned window of 13 words has 11 equal ones."""
    a, b = words(doc), words(item)
    if len(b) < 5:
        return False
    size = min(13, len(b))
    need = 11 if len(b) >= 13 else len(b)
    for shift in range(-len(b), len(a)):
        equal = [0 <= i + shift < len(a) and a[i + shift] == w for i, w in enumerate(b)]
        inside = [i for i in range(len(b)) if 0 <= i + shift < len(a)]
        for s in range(len(b) - size + 1):
            if s in inside and s + size - 1 in inside and sum(equal[s : s + size]) >= need:
                return True
    return False


def test_masks_miss_no_window():
    for k in range(3):
        for changed in itertools.combinations(range(d.WINDOW), k):
            assert any(
                all(at + i not in changed for i, c in enumerate(m) if c == "1")
                for m in d.MASKS
                for at in range(d.WINDOW - len(m) + 1)
            )


def test_against_brute_force(spark, docs, prose):
    rng = random.Random(1)
    items = [(i, " ".join(prose(rng.randrange(13, 40)))) for i in range(12)] + [(20, "five short words make this"), (21, "too short"), (22, None), (23, "five short words make this")]
    rows = []
    for n in range(60):
        body = prose(40)
        item = words(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 5)):
            if item:
                item[rng.randrange(len(item))] = "other"
        at = rng.randrange(40)
        cut = item[: rng.randrange(5, 40)] if rng.random() < 0.4 else item
        rows.append((n, " ".join(body[:at] + [w.upper() + rng.choice(["", ".", "%%%"]) for w in cut] + body[at:])))
    rows += [(100, None), (101, ""), (102, "Five short, words; make this!"), (103, "x " * 30_000 + items[3][1])]
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    out = {r.doc_id: r for r in d.decontamination_report(docs(rows), bench).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        assert out[i].item_ids == sorted(k for k, b in items if brute(t, b)), (i, t)
        assert out[i].contaminated == bool(out[i].item_ids) and out[i].n_items == len(out[i].item_ids)
    assert out[102].item_ids == [20, 23] and out[103].contaminated
    kept = d.drop_contaminated(docs(rows), bench)
    assert kept.columns == docs([]).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.contaminated}


def test_edges(spark, docs, prose):
    none = spark.createDataFrame([], "item_id long, text string")
    text = " ".join(prose(20))
    assert d.decontamination_report(docs([]), none).count() == 0
    assert not d.decontamination_report(docs([(1, text)]), none).first().contaminated
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    out = d.decontamination_report(docs([(None, text), (2, text), (2, text), (3, "clean")]), bench).collect()
    assert sorted((str(r.doc_id), r.contaminated) for r in out) == [("2", True), ("2", True), ("3", False), ("None", True)]


def test_dropped_rows_are_rows_not_ids(spark, docs, prose):
    text, own = " ".join(prose(20)), " ".join(prose(20))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    rows = [(None, text), (None, own), (1, text), (1, own), (2, None)]
    assert sorted((str(r.doc_id), r.text) for r in d.drop_contaminated(docs(rows), bench).where("text is not null").collect()) == [("1", own), ("None", own)]
    assert d.drop_contaminated(docs(rows), bench).count() == 3
