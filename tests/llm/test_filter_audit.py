"""Filter interactions against a walk through every order, document by document."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import pytest

from replenish.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(docs):
    """The failed filters of each (id, text, source) row."""
    out = []
    for i, text, _ in docs:
        t = text or ""
        words = WORD.findall(t)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            fails.add("E")
        out.append(fails)
    return out


def brute(docs, good, toxic):
    fails = failing(docs)
    out, shapley = {}, Counter()
    for part in {s or "" for _, _, s in docs}:
        mine = [(i, f) for (i, _, s), f in zip(docs, fails) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                redundant = sum(x in f for _, f in mine) - len(gone)
                unique = sum(f == {x} for _, f in mine)
                out[part, order, step] = [len(left), len(gone), redundant, unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    long = " ".join(f"w{i}" for i in range(220))
    texts = [long, long + " A$", "x " * 250, "short", "SHOUT " * 230, None, "", long.upper(), "é" * 40 + "X", "a b\x0bc\x85d # e", "x " * 250 + "$"]
    docs = [(int(i), texts[rng.integers(len(texts))], [None, "", "web", "books"][rng.integers(4)]) for i in rng.permutation(150)]
    docs += [docs[0], docs[0], (None, long, "web"), (None, long, None), (3, "other text of a known id", "books")]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in range(100)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1), (7, None, None), (9_999, 1, 1)]
    return docs, labels


def test_counts_equal_a_walk_through_all_orders(spark, corpus):
    docs, labels = corpus
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    table = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, source string, mask int, part string")
    got = filter_audit.audit(filter_audit.cells(table.repartition(7), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    want = brute(docs, good, toxic)
    assert len(got) == len(want) == 120 * 5 * 3
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


def test_a_text_that_most_documents_share(spark):
    docs = spark.range(4_000).selectExpr("id as doc_id", "case when id % 4 < 3 then 'one hot text' else concat('text ', id) end as text", "cast(id % 2 as string) as source")
    cells = filter_audit.cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r["mask"]): r.docs for r in cells if r.docs}
    # id 0 is the first of 3,000 copies; short texts all fail A.
    assert got == {("0", 1): 1 + 0, ("0", 17): 1_999, ("1", 1): 1_000, ("1", 17): 1_000}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.cells(docs, labels)).count() == 0


def test_other_numbers_of_filters():
    cells = pd.DataFrame({"mask": [0, 1, 2, 3], "docs": [10, 5, 3, 2], "good": [1, 1, 0, 1], "toxic": [0, 0, 2, 1]})
    got = filter_audit.interactions(cells, "XY").set_index(["filter_order", "step"])
    assert got.loc[("XY", 1), ["kept", "removed", "redundant", "unique_fails"]].tolist() == [13, 7, 0, 5]
    assert got.loc[("XY", 2), ["kept", "removed", "redundant", "good_lost", "toxic_lost", "shapley"]].tolist() == [10, 3, 2, 0, 2, 8]
