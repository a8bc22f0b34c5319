import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from replenish.llm import ann


def test_hilbert_curve_visits_every_cell_in_unit_steps():
    for axes, bits in ((2, 3), (3, 2), (4, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(ids, x, k):
    out = {}
    for i, q in zip(ids, x):
        if i % 100 == 0:
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            out[i] = sorted((float(dd), int(j)) for dd, j in zip(d, ids) if j != i)[:k]
    return out


def hits(spark, folder):
    """Checks a whole search's form; (true neighbours found, true neighbours)."""
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    pdf = df.toPandas()
    want = brute(pdf.vec_id.tolist(), np.array([np.asarray(v, np.float64) for v in pdf.embedding]), 10)
    got = {}
    for r in ann.search(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(got) == set(want)
    hit = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)
        true = dict((j, d) for d, j in want[q])
        hit += sum(j in true for _, _, j in rows)
        assert all(abs(s - true[j]) < 1e-12 for _, s, j in rows if j in true)
    return hit, 10 * len(want)


def test_one_block_finds_all(spark, sf0001):
    found, there = hits(spark, sf0001)
    assert found == there


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)  # many blocks, of which a query sees some
    found, there = hits(spark, "/root/testdata/sf0.1")
    assert 0.9 * there <= found


def test_repeated_blocks_and_slices_change_nothing(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    monkeypatch.setattr(ann, "BLOCK", 64)
    search = lambda: sorted(map(tuple, ann.search(df, F.col("id") % 20 == 0).collect()))
    whole = search()
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "DISTANCES", 100)
    assert search() == whole and len(whole) == 10 * len({r[0] for r in whole})


def test_equal_vectors_and_edges(spark):
    a, b = [1.0, 0.0, 0.5], [0.0, 1.0, 0.25]
    rows = [(i, a) for i in range(1, 60)] + [(100, a), (200, a), (200, a), (300, b), (None, a), (400, None), (500, [0.0, 0.0, 0.0]), (600, [1.0, None, 0.0]), (700, [float("nan"), 1.0, 1.0]), (800, [float("inf"), 1.0, 1.0]), (900, [1.0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in ann.search(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {100, 200, 300}
    assert got[100] == got[200] == [(i, 0.0) for i in range(1, 11)]
    assert [i for i, _ in got[300]] == list(range(1, 11)) and got[300][0][1] == pytest.approx(math.sqrt(2 + 0.0625))
    few = df.where("vec_id in (100, 300, 1)")
    assert ann.search(few, F.col("id") % 100 == 0).count() == 4
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id = 5"), F.col("id") % 100 == 0).count() == 0
