import random
import re

import numpy as np

from replenish.llm import near_dup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width):
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows, width, percent):
    """(size, component) of each row by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def check(spark, rows, width, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.cluster(df, width=width, percent=percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_documents_against_all_pairs(spark, sf0001):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf0001}/documents.parquet").collect()]
    check(spark, rows, 3, 85)
    check(spark, rows, 5, 80)


def test_chains_and_large_groups(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (6, 40, 150):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(14):  # edits of edits: chains whose ends are unlike
                rows.append((n * 7 % 1009, " ".join(base)))
                n += 1
                if rng.random() < 0.7:
                    for _ in range(max(1, size // 45)):
                        base[rng.randrange(size)] = rng.choice(vocabulary)
    rows += [(5000 + i, t) for i, t in enumerate(["", "  \n", None, "a", "A", "a b", "b a", "a b c", "a  b\tC"])]
    check(spark, rows, 3, 85)
    monkeypatch.setattr(near_dup, "PAIRED", 1)  # all unlike texts meet by their rarest shingles
    check(spark, rows, 3, 85)
    check(spark, rows, 5, 80)


def test_templated_bucket_of_unlike_texts(spark):
    """1,300 texts with a clause in common meet in the same buckets, little like their centres; a few are linked."""
    rng = random.Random(11)
    clause = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(1100):
        w = clause + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(14, 34))]
        rows.append((i, " ".join(w)))
        if i % 11 == 0:
            for k in (2000, 4000):  # copies with a few changed words, some beyond the threshold
                for _ in range(rng.randrange(1, 4)):
                    w[rng.randrange(60, len(w))] = f"x{rng.randrange(10**6)}"
                rows.append((k + i, " ".join(w)))
    pool = []
    real = near_dup.candidates

    def watched(*args):
        out = real(*args)
        pool.append(out[2].count())
        return out

    near_dup.candidates = watched
    try:
        check(spark, rows, 3, 85)
    finally:
        near_dup.candidates = real
    assert pool[0] > 1000  # the exact search was needed


def test_hot_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(9)):  # some far from the base, some of those near to each other
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
        if i % 9 == 0:
            w[rng.randrange(120)] = "twin"
            rows.append((1000 + i, " ".join(w)))
    check(spark, rows, 3, 85)


def test_densified_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    for size in (20, 90, 3000):
        got = []
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(pool[:size]), np.unique(pool[size // 10 : size + size // 10])
            x = near_dup.signatures([a, b])
            got.append((x[0] == x[1]).mean())
        assert abs(np.mean(got) - 0.9 / 1.1) < 0.04
    one = near_dup.signatures([np.array([5], np.uint64), np.array([5], np.uint64), np.zeros(0, np.uint64)])
    assert (one[0] == 5).all() and (one[0] == one[1]).all()


def test_edges(spark):
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (2, "A b c d e f", "y", 2), (None, "a b c d e f", "z", 3), (3, None, None, None), (4, "", "n", 4), (5, "q " * 80000, "n", 1), (6, "Q " * 70000, "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dup.cluster(df, width=3, percent=85).collect())
    assert got == [(0, 4, 0, True), (1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)]
    out = near_dup.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 1, 3, 4, 5]
    assert near_dup.cluster(df.limit(0)).count() == 0
