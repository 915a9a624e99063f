import hashlib
import re

import numpy as np
import xxhash

from bitloom.llm import components, exact_dedup, simhash


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


ROWS = [(5, "a  b"), (2, "a b"), (9, "a\n\tb"), (1, None), (3, ""), (4, " "), (7, "x" * 200_000), (8, "x" * 200_000 + "y"), (2, "a b"), (None, "a b"), (None, "solo")]


def test_exact_groups_against_brute_force(docs):
    out = exact_dedup.exact_groups(docs(ROWS)).collect()
    assert len(out) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(norm(t), []).append(i)
    expected = sorted((str(i), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)])) for i, t in ROWS)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out) == expected
    assert sum(r.kept for r in out) == len(groups)
    full = exact_dedup.exact_groups(docs(ROWS)).collect()
    texts = {hashlib.sha256(norm(t).encode()).hexdigest() for _, t in ROWS}
    assert {r.text_sha256 for r in full} == texts


def test_exact_empty_table_and_columns(docs):
    assert exact_dedup.exact_groups(docs([])).count() == 0
    kept = exact_dedup.drop_exact_copies(docs(ROWS))
    assert kept.columns == docs([]).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "1", "4", "7", "8", "None"])


def test_dropped_copies_are_rows_not_ids(docs):
    rows = [(1, "a b"), (1, "a  b"), (1, "own"), (None, "x"), (None, "x "), (None, "y"), (None, "A b"), (4, "y"), (4, "z"), (4, None), (4, "")]
    kept = sorted((str(r.doc_id), norm(r.text)) for r in exact_dedup.drop_exact_copies(docs(rows)).collect())
    texts = {}
    for i, t in rows:
        texts.setdefault(norm(t), []).append(i)
    # of each text the smallest id, a null one only where there is no other
    assert kept == sorted((str(min((i for i in ids if i is not None), default=None)), t) for t, ids in texts.items())


def test_near_copies_are_rows_not_ids(docs):
    rows = [(3, "a b"), (None, "a b"), (None, "A b"), (5, "unlike anything at all here"), (5, "a  b"), (None, "alone"), (None, None), (7, " ")]
    kept = simhash.drop_near_copies(docs(rows)).collect()
    assert sorted((str(r.doc_id), (r.text or "").strip()) for r in kept) == [("3", "a b"), ("5", "unlike anything at all here"), ("7", ""), ("None", "alone")]


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(prose):
    base = prose(300)
    rows = [(i, " ".join(prose(60))) for i in range(30)]
    for i in range(30, 70):
        words = list(base)
        words[i * 7 % 300] = "changed"
        rows.append((i, " ".join(words)))
    return rows + [(80, "One Two"), (81, "one two"), (82, None), (83, " \n"), (84, "ÀB c"), (85, "w " * 70_000)]


def test_simhash_against_brute_force(docs, prose):
    rows = near_copies(prose)
    out = {r.doc_id: r for r in simhash.simhash_components(docs(rows)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in out.items()} == prints
    assert {i: r.component_id for i, r in out.items()} == brute_components(prints)


def test_simhash_edges(docs):
    assert simhash.simhash_components(docs([])).count() == 0
    out = simhash.simhash_components(docs([(3, "a b"), (3, "a b"), (None, "a b"), (None, "c d e f g")])).collect()
    assert sorted(str(r.component_id) for r in out) == ["3", "3", "3", "None"]
    kept = simhash.drop_near_copies(docs([(3, "a b"), (4, "A B"), (5, "q r s t u v w")])).collect()
    assert sorted(r.doc_id for r in kept) == [3, 5]


def test_links_split_large_sets(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 12)
    fps = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (25, 2))}
    frame = spark.createDataFrame([(f, f) for f in fps], "fp long, rep long")
    expected = brute_components({f: f & (1 << 64) - 1 for f in fps})
    for rows in (8, 1 << 15):
        found = {r.node: r.component for r in components.components(simhash.near_links(frame, set_rows=rows)).collect()}
        assert {f: found.get(f, f) for f in fps} == expected


def test_every_close_pair_shares_a_key():
    for distance in (1, 4):
        blocks = simhash.block_count(1000, distance)
        assert blocks > distance
    assert simhash.block_count(1 << 28, 4) > simhash.block_count(1000, 4)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 500), (300, 301)], "a long, b long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert found == {i: 0 for i in range(101)} | {300: 300, 301: 300}
