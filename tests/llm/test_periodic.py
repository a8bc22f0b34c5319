"""Periodic runs against a scan of every period."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from replenish.llm import periodic
from replenish.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(words):
    back = [0] * len(words)
    k = 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = back[k - 1]
        k += words[i] == words[k]
        back[i] = k
    return len(words) - back[-1]


def brute(words):
    """(start, length, period) of every run, from one scan a period."""
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        same = [words[i] == words[i + p] for i in range(n - p)] + [False]
        i = 0
        while i < n - p:
            if not same[i]:
                i += 1
                continue
            j = i
            while same[j]:
                j += 1
            length = j + p - i
            if length >= max(6, 4 * p) and smallest_period(words[i : i + length]) == p:
                out.append((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(texts):
    """Runs of each list of words, all in one slice."""
    flat = [w for t in texts for w in t]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    sizes = np.array([len(t) for t in texts])
    bound = np.append(0, np.cumsum(sizes))
    text = np.repeat(np.arange(len(texts)), sizes)
    found = periodic.find_runs(np.array([number[w] for w in flat], np.int64), text, bound[1:][text])
    out = [[] for _ in texts]
    for s, length, p in zip(*map(np.ndarray.tolist, found)):
        out[text[s]].append((s - int(bound[text[s]]), length, p))
    return out


def collapsed(words):
    gone = {i for s, n, p in brute(words) for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70), min_size=1, max_size=4))
def test_few_letters(texts):
    if sum(map(len, texts)):
        assert runs_of(texts) == [brute(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=14), st.integers(1, 9), st.text("abcd", max_size=6)), min_size=1, max_size=5))
def test_repeated_patterns(parts):
    words = [c for w, k, tail in parts for c in w * k + tail]
    assert runs_of([words, words]) == [brute(words)] * 2


def test_nested_and_long_runs():
    inner = ["a"] * 7 + ["b"]
    words = inner * 9 + ["x"] + (["a"] * 30 + ["c"] + ["a"] * 31 + ["d"]) * 5 + list("abcdefghij") * 40
    assert runs_of([words]) == [brute(words)]
    assert runs_of([["z"] * 5000]) == [[(0, 5000, 1)]]
    base = [f"w{i}" for i in range(700)]
    assert runs_of([base * 4 + base[:123]]) == [[(0, 4 * 700 + 123, 700)]]


def test_operator_on_odd_rows(spark):
    rows = [(1, None, 0, "a"), (1, "", 1, "b"), (None, " \t\r\n", 2, "c"), (2, "ha ha\tha\nha  ha ha", 3, "d"), (2, "ha ha\tha\nha  ha ha", 3, "d"), (3, "Ha ha Ha ha ha é", 4, "e"), (4, "x " * 20_000, 5, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    got = periodic.find(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_words): r for r in got}
    assert [tuple(x) for x in by[2, 6].runs] == [(0, 6, 1)] and by[2, 6].collapsed == "ha"
    assert [tuple(x) for x in by[4, 20_000].runs] == [(0, 20_000, 1)] and by[4, 20_000].collapsed == "x"
    assert by[3, 6].runs == [] and by[3, 6].collapsed == "Ha ha Ha ha ha é"
    assert by[1, 0].collapsed == "" and by[None, 0].runs == []
    assert periodic.find(docs.limit(0)).count() == 0
    named = docs.select("text", docs.doc_id.cast("string").alias("n_words"))
    assert periodic.digest(periodic.find(named.toDF("text", "key"), "key"), "key").count() == len(rows)


def test_a_slice_of_its_own_for_a_long_text(monkeypatch):
    texts = [b"a b " * 40, b"", b"c " * 7, b"a b c d " * 5, b"x y"]
    whole = periodic._batch(texts, 6, 4)
    monkeypatch.setattr(periodic, "SLICE_WORDS", 9)
    assert all(a.equals(b) for a, b in zip(whole, periodic._batch(texts, 6, 4)))


def test_runs_of_fewer_periods_are_refused():
    with pytest.raises(ValueError, match="four periods"):
        periodic.find_runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), min_periods=3)


def test_query_equals_brute_force(spark, sf0001):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf0001}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf0001).collect()}
    assert set(got) == set(docs)
    with_runs = 0
    for doc_id, text in docs.items():
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        if n > 3000:  # the scan is quadratic
            continue
        runs, r = brute(words), got[doc_id]
        with_runs += bool(runs)
        best = None
        for x in runs:
            if best is None or x[1] * best[2] > best[1] * x[2]:
                best = x
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words).encode()).hexdigest()
    assert with_runs > 10
