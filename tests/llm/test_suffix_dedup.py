import random
import re
from collections import defaultdict

import numpy as np

from replenish.llm import suffix_dedup as sd


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least=50):
    """Words of each document in some window of ``least`` words that another document has too."""
    where = defaultdict(set)
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(d)
    out = {}
    for d, t in rows:
        w = words(t)
        cover = set()
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                cover.update(range(i, i + least))
        if cover:
            out[d] = cover
    return out


def found(df):
    out = defaultdict(set)
    for r in sd.find(df).collect():
        assert r.n_words == r.end_word - r.first_word >= 50 and r.other_doc != r.doc_id
        assert not out[r.doc_id] & set(range(r.first_word, r.end_word))
        out[r.doc_id].update(range(r.first_word, r.end_word))
    return out


def test_minimisers_cover_all_windows():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 40, 400).astype(np.uint64)  # many ties
    first = np.array([0, 30, 30, 130, 260, 310, 400])
    at, g = sd.retained(h, first)
    _, inside = sd.grams(h, first, sd.GRAM)
    full, _ = sd.grams(h, first, sd.GRAM)
    want = set()
    for a, b in zip(first[:-1], first[1:]):
        for i in range(a, b - sd.MIN_WORDS + 1):
            window = full[i : i + sd.MIN_WORDS - sd.GRAM + 1]
            want |= {i + int(k) for k in np.flatnonzero(window == window.min())}
    assert set(at.tolist()) == want and (full[at] == g).all()


def test_documents_against_all_windows(spark, sf0001):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf0001}/documents.parquet").collect()]
    want = brute(rows)
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(got) == set(want)
    assert all(got[d] <= want[d] for d in got)
    assert sum(map(len, got.values())) >= 0.995 * sum(map(len, want.values()))


def test_planted_passages(spark):
    rng = random.Random(2)
    new = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passages = [new(n) for n in (49, 50, 51, 60, 200)]
    rows, n = [], 0
    for p in passages:
        for _ in range(40 if len(p) == 60 else 3):
            rows.append((n, " ".join(new(rng.randrange(80)) + p + new(rng.randrange(80)))))
            n += 1
    own = new(70)
    rows.append((n, " ".join(own + new(20) + own)))  # repeats itself only
    rows += [(n + 1 + i, " ".join(new(300))) for i in range(5)]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want
    assert len(want) == 49


def test_edges(spark):
    p = " ".join(f"p{i}" for i in range(55))
    rows = [(1, p, "x", 1), (1, p, "x", 1), (2, "a b " + p.upper() + " c", "x", 2), (3, None, None, None), (4, "", "", 4), (None, "q " + p, "n", 5), (5, "z " * 60000, "", 6), (6, "z " * 61000, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, place int")
    got = sorted(((r.doc_id or 0), r.first_word, r.end_word) for r in sd.find(df).collect())
    assert got == [(0, 1, 56), (1, 0, 55), (2, 2, 57), (5, 0, 60000), (6, 0, 61000)]
    lone = spark.createDataFrame([(1, p), (1, p)], "doc_id long, text string")
    assert sd.find(lone).count() == 0
    assert sd.find(df.limit(0)).count() == 0


def test_batches_of_many_slices_equal_small_ones(spark):
    """Texts of over SLICE_BYTES in one batch give the same spans as the same texts apart."""
    rng = random.Random(8)
    shared = [[f"p{k}x{i}" for i in range(60)] for k in range(40)]
    rows = []
    for i in range(300):
        w = [f"w{rng.randrange(10**7)}" for _ in range(900)]
        for k in rng.sample(range(40), 2):
            at = rng.randrange(900)
            w[at:at] = shared[k]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df.coalesce(1)) == brute(rows) == found(df.repartition(40))


def test_partners_that_are_no_neighbours_in_a_large_templated_group(spark):
    """One clause in all texts; pairs share five words on each side, others eight words on one side alone."""
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    clause, texts = new(40), []
    for _ in range(100):
        left, right = new(5), new(5)
        for _ in range(2):
            x, y = new(3), new(3)
            texts.append(new(20) + x + left + clause + right + y + new(20))
            texts += [new(28) + clause + right + y + new(20) for _ in range(3)]
            texts += [new(20) + x + left + clause + new(28) for _ in range(3)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute(rows)
    assert len(want) == 200
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want
