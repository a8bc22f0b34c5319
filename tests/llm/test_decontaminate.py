import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from replenish.llm import decontaminate as dc


def brute(item, run):
    """Least word edits of ``item`` to any part of ``run``."""
    prev = [0] * (len(run) + 1)
    for i, x in enumerate(item, 1):
        cur = [i] + [0] * len(run)
        for j, y in enumerate(run, 1):
            cur[j] = min(prev[j - 1] + (x != y), prev[j] + 1, cur[j - 1] + 1)
        prev = cur
    return min(prev)


def toks(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), max_size=30), st.integers(0, 5))
def test_bit_parallel_distance(item, run, limit):
    got = dc.least_edits(np.array(item, np.uint64), np.array(run, np.uint64), limit)
    want = brute(item, run)
    if want > limit:
        assert got is None
    elif want < len(item):
        assert got[0] == want
        assert brute(item, run[got[1] : got[2]]) == want


def test_recall_on_documents_against_brute_force(spark, sf0001):
    bench = spark.read.parquet(f"{sf0001}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    items = {r.item_id: toks(r.text) for r in bench.collect()}
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = [" ".join(toks(t)[:150]) for _, t in rows[:60]]
    for n, (k, it) in enumerate(list(items.items()) * 2):  # planted with up to the allowed edits
        run = list(it)
        for _ in range(rng.randint(0, dc.allowed_edits(len(it), 0.8))):
            at, what = rng.randrange(len(run)), rng.randrange(3)
            run[at : at + (what != 1)] = [] if what == 0 else [f"zz{rng.randrange(999)}"]
        host = base[n % 60].split()
        cut = rng.randrange(len(host) + 1)
        rows.append((10_000 + n, " ".join(host[:cut] + run + host[cut:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.find(df, bench).collect()}
    want = {}
    for d, t in rows:
        w = toks(t)
        have = set(w)
        for k, it in items.items():
            if len(have & set(it)) * 2 >= len(set(it)):  # fewer common words: over 20 % edits
                e = brute(it, w)
                if e <= dc.allowed_edits(len(it), 0.8):
                    want[d, k] = e
    assert set(got) <= set(want)
    assert len(got) >= 0.99 * len(want) and len(want) >= 80
    assert sum(got[x].edits == want[x] for x in got) >= 0.98 * len(got)


def test_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "Just so"), (None, "one two"), (5, "one two three four five six seven eight nine ten")], "item_id long, text string")
    rows = [(1, None, 0), (2, "", 0), (3, "x ONE two three four\nfive six seven eight nine ten y", 0), (4, "one two three zz five six seven eight nine ten", 0), (5, "one two three zz five zz seven zz nine ten", 0), (6, "just  so it goes", 0), (7, "just, so", 0), (8, "lorem " * 70000 + " one two three four five six seven eight nine ten", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits int")
    got = sorted((r.doc_id, r.item_id, r.edits, r.first_word, r.end_word) for r in dc.find(docs, bench).collect())
    assert got == [(3, 1, 0, 1, 11), (3, 5, 0, 1, 11), (4, 1, 1, 0, 10), (4, 5, 1, 0, 10), (6, 4, 0, 0, 2), (8, 1, 0, 70000, 70010), (8, 5, 0, 70000, 70010)]
    assert dc.find(docs.limit(0), bench).count() == 0
    assert dc.find(docs, bench.limit(0)).count() == 0


def test_recall_holds_for_every_length(spark):
    """Many short items and some long ones: tables are fitted a length class, so long ones are found as well."""
    import numpy as np

    from replenish.llm import decontaminate

    rng = np.random.default_rng(6)
    word = lambda: f"w{rng.integers(1, 10**9)}"
    items = [(i, " ".join(word() for _ in range(6))) for i in range(200)] + [(1000 + i, " ".join(word() for _ in range(200))) for i in range(60)]
    rows, want = [], set()
    for n, (i, text) in enumerate(items):
        words = text.split()
        for copy in range(3 if i >= 1000 else 1):
            run = list(words)
            for _ in range(decontaminate.allowed_edits(len(words), decontaminate.SIMILARITY)):
                at, what = int(rng.integers(0, len(run))), int(rng.integers(0, 3))
                run[at : at + (what != 1)] = [] if what == 0 else [word()]
            doc = 10 * n + copy
            rows.append((doc, " ".join([word() for _ in range(30)] + run + [word() for _ in range(30)])))
            want.add((doc, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    long = {x for x in want if x[1] >= 1000}
    assert len(long & got) >= 0.99 * len(long) and len(want & got) >= 0.99 * len(want)


def test_a_class_beyond_the_tables_is_verified_directly(monkeypatch):
    from replenish.llm import decontaminate

    monkeypatch.setattr(decontaminate, "MAX_TABLES", 1)
    text = " ".join(f"w{i}" for i in range(100))
    block = decontaminate.build([(1, text), (2, "a b c d")])
    assert block.direct.tolist() == [True, False]
