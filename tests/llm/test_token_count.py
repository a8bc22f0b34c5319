import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from replenish.llm.token_count import count_texts, load, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def expected(texts):
    return [len(e.ids) for e in LIB.encode_batch(texts, add_special_tokens=False)]


CASES = ["", " ", "  \n\n  x", "a  b\n c\t\td ", "it's 'sore we'll  'll I'd've ''s 's", "<|endoftext|>a<|endoftext|><|endoftext|> b", "é à x　y 12٣ ½ 日本語テキスト 😀😀", "a" * 5000, "ab " * 400, "\r\n\r\n x", "x  y", "1'st2'm", "'", "' s", "'re'", " '", "\x1cabc\x85 d"]


def test_cases():
    assert count_texts(CASES, load(PATH)).tolist() == expected(CASES)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FFF), st.sampled_from(list(" '\n\tstrevmld019.,!")))), max_size=6))
def test_random(texts):
    import unicodedata

    texts = [x for x in texts if all(unicodedata.category(c) != "Cn" for c in x)]  # unassigned: Unicode versions differ
    assert count_texts(texts, load(PATH)).tolist() == expected(texts)


def test_documents(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    got = {r.doc_id: r for r in token_counts(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], expected([r.text or "" for r in rows])))
    assert {k: v.n_tokens for k, v in got.items()} == want
    assert all(got[r.doc_id].n_bytes == len((r.text or "").encode()) for r in rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 9), (1, "a b", 9), (None, "x", 1)], "doc_id long, text string, n_tokens long")
    got = sorted((r.doc_id or 0, r.n_tokens, r.over_limit) for r in token_counts(df, PATH).collect())
    assert got == [(0, 1, False), (1, 0, False), (1, 2, False)]
    assert token_counts(df.limit(0), PATH).count() == 0


def test_every_character_is_of_the_librarys_kind():
    """Each code point after a letter, a digit and a sign: joined to it or a piece of its own, as in the library."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from replenish.llm.token_count import piece_starts

    cut = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for before in "a1":
        for lo in range(0, len(points), 50_000):
            text = "".join(f"{before}{chr(c)}'s\n" for c in points[lo : lo + 50_000])
            want = {a for _, (a, _) in cut(text)}
            cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            got = set(np.flatnonzero(piece_starts(cp, np.array([0]))).tolist())
            assert got == want, [hex(points[lo + i // 5]) for i in sorted(got ^ want)[:5]]
