"""Language identification: averaged hashed subword embeddings, linear softmax.

Subwords are the byte 3- and 4-grams inside words (a word edge counts as a
blank), hashed into a fixed number of buckets. A text is the mean of its
subword embeddings; a linear softmax scores the languages. Embeddings and
weights are trained by stochastic gradient descent in numpy on a bounded,
hash-chosen sample of labelled rows; a temperature and a rejection threshold are
then fitted on rows of the sample that were not trained on. Prediction reads
whole texts inside Spark tasks.

Defined results: a null text, an empty one or one without a letter is ``und``
with score 0 and is rejected; so is every text if nothing could be learned.
Repeated rows get the same answer; ties in the score go to the language that is first in code
point order; other columns of the input are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_ids, map_batches, written
from .textops import text_slices

UNKNOWN = "und"
BUCKETS = 1 << 17
GRAMS = (3, 4)
DIM = 16
#: Labelled rows used for training and calibration, shared evenly by the languages.
SAMPLE_ROWS = 2_000
EPOCHS = 8
#: Share of right answers on the calibration rows that rejection may cost.
REJECT_RIGHT = 0.002


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # buckets x languages: embedding times weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _byte_map() -> np.ndarray:
    """Small letters and bytes of multi-byte characters stay, the rest is a blank."""
    m = np.full(256, 32, np.uint8)
    m[97:123] = np.arange(97, 123)
    m[65:91] = np.arange(97, 123)
    m[128:] = np.arange(128, 256)
    return m


BYTES = _byte_map()


def padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mapped bytes with a blank around each text, and the text of each byte."""
    low = BYTES[raw]
    # Two-byte Latin capitals (C3 80..9E) get their small form.
    up = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    low[up] += 32
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    out = np.full(len(raw) + len(at), 32, np.uint8)
    out[np.arange(len(raw)) + row + 1] = low
    owner = np.zeros(len(out), np.int64)
    owner[np.arange(len(raw)) + row + 1] = row
    return out, owner


def subwords(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every subword of a slice; the order is by length, then place."""
    b, owner = padded(raw, at)
    inner = b != 32
    wide = b.astype(np.uint32)
    buckets, rows = [], []
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        ok = inner[1 : 1 + m].copy()
        for j in range(2, n - 1):
            ok &= inner[j : j + m]
        i = np.flatnonzero(ok)
        code = np.full(len(i), n, np.uint32)
        for j in range(n):
            code = code * np.uint32(0x01000193) ^ wide[i + j]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        code ^= code >> np.uint32(13)
        buckets.append((code & np.uint32(BUCKETS - 1)).astype(np.int32))
        rows.append(owner[i + 1])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(rows)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def logits(model: Model, column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), len(model.langs)), np.float64)
    for lo, hi, raw, at in text_slices(column):
        b, row = subwords(raw, at)
        count = np.bincount(row, minlength=hi - lo)
        for k in range(len(model.langs)):
            total = np.bincount(row, weights=model.table[k][b], minlength=hi - lo)
            out[lo:hi, k] = total / np.maximum(count, 1)
    return out + model.bias


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """Fit on (language, buckets, counts); every fifth sample of a language calibrates."""
    langs = sorted({s[0] for s in samples}, key=lambda x: x.encode())
    if not langs:
        return None
    index = {x: i for i, x in enumerate(langs)}
    seen = [0] * len(langs)
    fit, held = [], []
    for lang, b, c in samples:
        if not len(b):
            continue
        k = index[lang]
        (held if seen[k] % 5 == 4 else fit).append((k, b, (c / c.sum()).astype(np.float32)))
        seen[k] += 1
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weight = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    # Each language weighs the same whatever its share of the sample.
    share = np.maximum(np.bincount([f[0] for f in fit], minlength=len(langs)), 1)
    gain = (share.sum() / len(langs) / share).clip(0.2, 5).astype(np.float32)
    step, steps = 0, max(1, EPOCHS * len(fit))
    for _ in range(EPOCHS):
        for f in rng.permutation(len(fit)):
            k, b, c = fit[f]
            rate = np.float32(1.0 * (1 - step / steps))
            step += 1
            x = c @ emb[b]
            z = x @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[k] -= 1
            p *= rate * gain[k]
            grad = weight @ p
            weight -= np.outer(x, p)
            bias -= np.float32(0.1) * p
            emb[b] -= np.outer(c * np.float32(len(b) ** 0.5), grad)
    table = np.ascontiguousarray((emb @ weight).T.astype(np.float32))
    model = Model(langs, table, bias.astype(np.float64), 1.0, 0.0)
    rows = held or fit
    if not rows:
        return model
    z = np.array([[(table[k][b] * c).sum() for k in range(len(langs))] for _, b, c in rows]) + model.bias
    truth = np.array([k for k, _, _ in rows])
    return calibrated(model, z, truth)


def calibrated(model: Model, z: np.ndarray, truth: np.ndarray) -> Model:
    """Temperature of least log loss on a fixed grid; threshold that costs few right answers."""
    grid = [2.0 ** (e / 4) for e in range(-12, 9)]
    loss = [-np.log(softmax(z / t)[np.arange(len(truth)), truth].clip(1e-12)).mean() for t in grid]
    t = grid[int(np.argmin(loss))]
    p = softmax(z / t)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    threshold = min(0.5, float(np.quantile(right, REJECT_RIGHT))) if len(right) else 0.0
    return model._replace(temperature=t, threshold=threshold)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, may_learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(i, lang, b, c): subword counts of at most ``rows`` labelled texts, the same number a language at most.

    Rows are chosen by a hash of their id from all labelled rows; ids first, the
    texts of the chosen ids then.
    """
    labelled = docs.where(may_learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = written(docs.sparkSession, labelled.groupBy(label_col).agg(F.count("*").alias("_n")), "languages")
    each = max(2, rows // max(1, sizes.count()))
    # Thinned to a few times the wanted rows before they meet by language; one row a language is broadcast.
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 20))
    thinned = labelled.select(id_col, label_col).join(F.broadcast(sizes), label_col).withColumn("_p", place).where(F.col("_p") * F.col("_n") < F.lit(4 * each * (1 << 20)))
    order = Window.partitionBy(label_col).orderBy("_p", id_col)
    ids = thinned.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each).select(id_col).distinct()
    chosen = keep_ids(labelled.select(id_col, label_col, text_col), ids, id_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, bs, cs = [], [], []
        for lo, hi, raw, at in text_slices(batch.column(2)):
            b, row = subwords(raw, at)
            order = np.argsort(row, kind="stable")
            parts = np.split(b[order], np.cumsum(np.bincount(row, minlength=hi - lo))[:-1])
            for r, part in enumerate(parts):
                u, c = np.unique(part, return_counts=True)
                key.append(lo + r)
                bs.append(u.astype(np.int32))
                cs.append(c.astype(np.int32))
        take = pa.array(key, pa.int64())
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(bs, kind), pa.array(cs, kind)], names=["i", "lang", "b", "c"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(chosen.select(id_col, label_col, text_col), run, f"i {id_kind}, lang string, b array<int>, c array<int>")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", may_learn: Column | None = None) -> Model | None:
    """The model of the bounded sample, trained in one task; the driver gets the finished one only."""
    ok = ~held_out(id_col) if may_learn is None else may_learn
    sample = training_sample(docs, id_col, text_col, label_col, ok)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for x in batches:
            rows += zip(x["i"].to_pylist(), x["lang"].to_pylist(), x["b"], x["c"])
        rows.sort(key=lambda r: (str(r[0]), r[1]))
        # The rows are bounded by the sample size; repeated ids are cut to it here.
        model = train([(lang, b.values.to_numpy(), c.values.to_numpy()) for _, lang, b, c in rows[: 2 * SAMPLE_ROWS]])
        if model is not None:
            yield pa.RecordBatch.from_pydict(
                {"langs": [model.langs], "table": [model.table.tobytes()], "bias": [model.bias.tolist()], "temperature": [model.temperature], "threshold": [model.threshold]}
            )

    made = sample.repartition(1).mapInArrow(run, "langs array<string>, table binary, bias array<double>, temperature double, threshold double").collect()
    if not made:
        return None
    m = made[0]
    return Model(list(m.langs), np.frombuffer(bytes(m.table), np.float32).reshape(len(m.langs), BUCKETS), np.array(m.bias), m.temperature, m.threshold)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score, rejected, *carry); only the text is read for a prediction."""
    carry = carry or []
    others = [c for c in carry if c != text_col]  # the text itself travels once
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        text = batch.column(1)
        n = len(text)
        plain = np.zeros(n, bool)
        for lo, hi, raw, at in text_slices(text):
            ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
            count = np.concatenate([[0], np.cumsum(ascii_letter)])
            plain[lo:hi] = count[at[1:]] > count[at[:-1]]
        for i in np.flatnonzero(~plain):
            plain[i] = has_letter(text[int(i)].as_py())
        if model is None:
            lang, score, reject = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
        else:
            p = softmax(logits(model, text) / model.temperature)
            best = p.argmax(axis=1)
            lang = np.where(plain, np.array(model.langs, object)[best], UNKNOWN)
            score = np.where(plain, p[np.arange(n), best], 0.0)
            reject = ~plain | (score < model.threshold)
        kept = [text if c == text_col else batch.column(2 + others.index(c)) for c in carry]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(reject), *kept],
            names=[id_col, "lang_pred", "score", "rejected", *carry],
        )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    extra = "".join(f", `{c}` {kinds[c]}" for c in carry)
    return map_batches(docs.select(id_col, text_col, *others), run, f"{id_col} {kinds[id_col]}, lang_pred string, score double, rejected boolean{extra}")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected), learned from the rows that are not held out."""
    model = fit(docs, id_col, text_col, label_col)
    out = predict(docs, model, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")
