import numpy as np
import pyarrow as pa

from replenish.llm import lang_id
from replenish.llm.textops import text_slices


def brute_subwords(text):
    """Buckets by the definition: 3- and 4-byte runs whose inner bytes are word bytes."""
    low = bytearray(b" ")
    raw = text.encode()
    for i, x in enumerate(raw):
        y = int(lang_id.BYTES[x])
        if i and raw[i - 1] == 0xC3 and 0x80 <= x <= 0x9E and x != 0x97:
            y += 32
        low.append(y)
    low += b" "
    out = []
    for n in lang_id.GRAMS:
        for i in range(len(low) - n + 1):
            if 32 not in low[i + 1 : i + n - 1]:
                code = n
                for j in range(n):
                    code = (code * 0x01000193 & 0xFFFFFFFF) ^ low[i + j]
                code ^= code >> 15
                code = code * 0x2C1B3C6D & 0xFFFFFFFF
                code ^= code >> 13
                out.append(code & (lang_id.BUCKETS - 1))
    return sorted(out)


def test_subwords_match_definition():
    texts = ["", "a", "Été à la ÉCOLE 12!!", None, "x y", "日本 go", "  ", "word" * 30]
    got = {}
    for lo, _, raw, at in text_slices(pa.array(texts)):
        b, row = lang_id.subwords(raw, at)
        for r in range(len(at) - 1):
            got[lo + r] = sorted(b[row == r].tolist())
    assert [got[i] for i in range(len(texts))] == [brute_subwords(t or "") for t in texts]


def test_held_out_accuracy_and_rules(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    import zlib

    assert len(got) == docs.count()
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) == h for d, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert got[(got.lang == got.lang_pred)].rejected.mean() < 0.02


def test_score_is_the_mean_embedding_softmax(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").limit(40)
    model = lang_id.fit(docs)
    rows = {r.doc_id: r for r in lang_id.predict(docs, model).collect()}
    for r in docs.collect():
        b = brute_subwords(r.text)
        z = np.array([model.table[k][b].astype(float).mean() for k in range(len(model.langs))]) + model.bias
        p = lang_id.softmax(z[None] / model.temperature)[0]
        assert rows[r.doc_id].lang_pred == model.langs[int(p.argmax())]
        assert abs(rows[r.doc_id].score - p.max()) < 1e-9


def test_labels_are_no_input(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    model = lang_id.fit(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(docs, model).collect()}
    from pyspark.sql import functions as F

    b = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(docs.withColumn("lang", F.lit("zz")), model).collect()}
    assert a == b


def test_edges(spark):
    rows = [(1, None, "en", "s"), (2, "", None, "s"), (3, "12 ?!", "en", None), (4, "the house and the cat", "en", "s"), (5, "la maison et le chat", "fr", "s"), (5, "la maison et le chat", "fr", "s"), (None, "the cat", "en", "s"), (6, "É", None, "s"), (7, "x " * 60000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = lang_id.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "fr")
    assert lang_id.identify(docs.limit(0)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in lang_id.identify(unlabelled).collect()} == {"und"}
