import re

import corpus_pipeline as cp
import pytest

from replenish.llm import decontaminate as dc
from replenish.llm import near_dup


@pytest.fixture(scope="module")
def stages(spark, sf0001):
    """Input and output of each stage on the small documents."""
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    out = [docs.toPandas()]
    for name, f in cp.STAGES:
        docs = cp.written(spark, f(spark, docs, sf0001), name)
        out.append(docs.toPandas())
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t.lower())


def brute_edits(item, run):
    prev = [0] * (len(run) + 1)
    for i, x in enumerate(item, 1):
        cur = [i] + [0] * len(run)
        for j, y in enumerate(run, 1):
            cur[j] = min(prev[j - 1] + (x != y), prev[j] + 1, cur[j - 1] + 1)
        prev = cur
    return min(prev)


def test_language_stage_keeps_readable_documents(stages):
    before, after = stages[0], stages[1]
    assert list(before.columns) == list(after.columns)
    assert len(after) >= 0.97 * len(before)
    assert set(after.doc_id) <= set(before.doc_id)


def test_near_dedup_against_all_pairs(stages):
    before, after = stages[1], stages[2]
    sets = {}
    for r in before.itertuples():
        w = words(r.text)
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and (both := len(sets[a] & sets[b])) * 100 >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(after.doc_id) == sorted({find(d) for d in ids})


def test_decontamination_against_brute_force(stages, spark, sf0001):
    before, after = stages[2], stages[3]
    items = [words(r.text) for r in spark.read.parquet(f"{sf0001}/benchmark.parquet").collect()]
    gone = set()
    for r in before.itertuples():
        w = words(r.text)
        have = set(w)
        if any(len(have & set(i)) * 2 >= len(set(i)) and brute_edits(i, w) <= dc.allowed_edits(len(i), 0.8) for i in items):
            gone.add(r.doc_id)
    assert gone and set(before.doc_id) - set(after.doc_id) == gone


def test_secrets_are_gone_and_documents_stay(stages):
    before, after = stages[3], stages[4]
    assert sorted(before.doc_id) == sorted(after.doc_id) and list(before.columns) == list(after.columns)
    sure = re.compile(r'token = "[0-9a-f]{20,}|password=[0-9a-f]{12,}|AKIA[A-Z0-9]{16}')
    assert not after.text.str.contains(sure).any()
    plain = before[~before.text.str.contains(r"[0-9]{3}")]
    assert (after.set_index("doc_id").loc[plain.doc_id].text.values == plain.text.values).all()
    assert (after.n_chars == after.text.str.len()).all()


def test_mix_takes_words_near_targets(stages):
    before, after = stages[4], stages[5]
    assert set(after.doc_id) <= set(before.doc_id) and (after.taken > 0).all()
    assert (after["size"] == after.text.map(lambda t: len(words(t)))).all()
    got = after.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"))
    assert ((got.taken - got.target).abs() <= 0.05 * got.target + 40).all()


def test_run_equals_stages(stages, spark, sf0001):
    got = cp.run(spark, sf0001).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(stages[5].doc_id, stages[5].taken))


def test_edges(spark, sf0001):
    rows = [(None, "the cat and the house", "en", "a", 1, 0.5), (1, None, None, None, None, None), (2, "the cat and the dog run", "en", None, 9, 0.1), (2, "the cat and the dog run", "en", None, 9, 0.1), (3, "la maison et le chat " * 9000, "fr", "b", 9, None), (4, "", "fr", "b", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for part in (docs, docs.limit(0)):
        for _, f in cp.STAGES:
            columns = part.columns
            part = cp.written(spark, f(spark, part, sf0001), "edge")
            assert part.columns[: len(columns)] == columns
    assert near_dup.cluster(docs).count() == 6
