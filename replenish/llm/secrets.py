"""Secret scan: candidates from whole texts, false positives removed by a random forest.

A candidate is a run of at least 12 characters of ``[A-Za-z0-9+/_-]`` with a
digit in it (up to two ``=`` may end it), a published format inside such a run, a
whole private key (head line to end line; without an end line, the key lines after the
head), any value that a secret word is assigned or that stands quoted after one,
whatever its length and signs, or the password of a connection string. A run
inside a longer candidate is not one of its own.
Features of a candidate: its length and character mix, how often its
characters change class, its entropy, the share of it that words of its own
document cover, path signs, and the words and signs next to it. The forest is trained on
labelled findings: random keys, tokens and chosen passwords, and things that look
like them (digests, ids, paths, placeholders, names), are set into real passages of a bounded,
hash-chosen sample of the documents and go through the same candidate code; a
bounded sample of the corpus's own candidates in a published format joins them.

Defined results: null or empty texts have no findings; a repeated row
repeats its findings; spans are in code points, end exclusive; other columns are
ignored (a clash with a feature name does no harm, only id and text are read);
empty tables, or candidates among which nothing can be labelled, give no findings.
"""

from __future__ import annotations

import base64
import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
HEAD = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
#: Lines of a key whose end line is missing: headers, base64 lines (the last may be short), a blank line.
KEY_LINES = re.compile(r"(?:(?:\\r)?(?:\\n)|[ \t]*\r?\n[ \t]*|[ \t]+)(?:(?:[A-Za-z0-9-]+: [^\n]*\n\s*)*)(?:[A-Za-z0-9+/]{40,}={0,2}(?:(?:\\r)?\\n|\s+|$))*(?:[A-Za-z0-9+/]+={1,2}|[A-Za-z0-9+/]{16,})?")
#: A value after a secret word; group "q" is quoted, "v" is not, its closing punctuation left out.
VALUE = re.compile(
    r"""(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_ .-]?key|access[_ .-]?key|private[_ .-]?key|auth|credentials?)[A-Za-z0-9_]{0,20}["']?\s{0,3}"""
    r"""(?:(?:=>|:=|[=:]|\bis\b)\s{0,3})?(?:(?P<s>["'`])(?P<q>(?:\\.|(?!(?P=s))[^\\\n])+)(?P=s)|(?<=[=:>\s])(?<![^=:>]\s)(?P<v>[^\s"'`<>,;]+))"""
)
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@\"'<>]*:(?P<v>[^\s/\"'<>]+)@")
LOGIN = re.compile(r"://[^\s/:@\"'<>]*:$")
#: Three dotted base64 parts, as one candidate.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])(?P<v>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*)")
BEARER = re.compile(r"(?i)\bbearer\s+(?P<v>[A-Za-z0-9._~+/=-]{6,})")
#: Values that say where a secret would stand.
EMPTY = re.compile(r"(?i)none|null|nil|true|false|undefined|required|optional|changeme|your[_ -].*|\$\{.*|\{\{.*|%\(.*|<.*|\*+|x+|\.+|[A-Za-z_.]+\(.*")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
#: Formats that providers publish; fixed values.
KNOWN = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9\-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|-----BEGIN (?s:.*)")
SECRET_WORDS = re.compile(r"(?i)pass(?:word|wd|phrase)?\b|pwd|secret|token|api.?key|access.?key|private.?key|auth|bearer|credential")
OTHER_WORDS = re.compile(r"(?i)commit|sha-?\d*\b|md5|checksum|hash|digest|uuid|guid|revision|build|isbn|order|invoice|https?:|www\.")
ASSIGN = re.compile(r"""[=:]\s*["']?$""")
#: Passages that findings are set into, findings a passage, and the corpus's own findings used for training.
PASSAGES, EACH, SAMPLE_ROWS = 250, 16, 2_000
TREES, DEPTH = 24, 7
THRESHOLD = 0.5
FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_hex", "f_entropy", "f_changes", "f_letter_run", "f_digit_run", "f_covered", "f_path", "f_known", "f_secret_word", "f_other_word", "f_assigned", "f_quoted", "f_at", "f_signs", "f_empty"]
SPAN = "id {id}, `start` long, `end` long, kind string, "


def _longest(pattern: str, text: str) -> int:
    return max((len(x) for x in re.findall(pattern, text)), default=0)


def features(text: str, start: int, end: int, own_words: set[str]) -> list[float]:
    s = text[start:end]
    n = len(s)
    before, after = text[max(0, start - 48) : start], text[end : end + 16]
    near = " ".join(before.split()[-3:])
    login = after[:1] == "@" and LOGIN.search(before) is not None
    classes = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s)
    covered = sum(len(w) for w in WORD.findall(s) if w.lower() in own_words)
    return [
        float(n),
        classes.count("d") / n,
        classes.count("u") / n,
        classes.count("l") / n,
        sum(c in "0123456789abcdef" for c in s) / n,
        -sum(k / n * math.log2(k / n) for k in Counter(s).values()),
        sum(a != b for a, b in zip(classes, classes[1:])) / n,
        float(_longest(r"[A-Za-z]+", s)),
        float(_longest(r"[0-9]+", s)),
        covered / n,
        float(s.count("/") + before.endswith(("/", "\\", "./")) + bool(re.match(r"\.[a-z]{2,4}\b", after))),
        float(KNOWN.fullmatch(s) is not None),
        float(login or SECRET_WORDS.search(near) is not None),
        float(not login and OTHER_WORDS.search(near) is not None),
        float(ASSIGN.search(before) is not None),
        float(before[-1:] in "\"'" and before[-1:] == after[:1] != ""),
        float("@" in before[-1:] + after[:1]),
        sum(not c.isalnum() and c not in "+/_-=" for c in s) / n,
        float(EMPTY.fullmatch(s) is not None),
    ]


def spans(text: str) -> list[tuple[int, int]]:
    """Candidates of a text in order; those that overlap are a run and a published format inside it."""
    wide = []
    at = 0
    while m := HEAD.search(text, at):
        following = HEAD.search(text, m.end())
        end = END.search(text, m.end(), following.start() if following else len(text))
        lines = None if end else KEY_LINES.match(text, m.end())
        at = end.end() if end else m.end() + len(lines[0].rstrip()) if lines else m.end()
        wide.append((m.start(), at))
    for pattern in (URL, DOTTED, VALUE, BEARER):
        for m in pattern.finditer(text):
            name = "q" if m.groupdict().get("q") else "v"
            a, b = m.span(name)
            if name == "v" and pattern is VALUE:
                b = a + len(text[a:b].rstrip(".,;:!?)]}"))
            if b > a:
                wide.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(wide), key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    starts = [a for a, _ in out]
    more = []
    for m in CANDIDATE.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        if DIGIT.search(m[0]) and not (k >= 0 and m.end() <= out[k][1]):
            more.append(m.span())
        for f in KNOWN.finditer(text, m.start(), m.end()):
            if not (k >= 0 and f.end() <= out[k][1]):
                more.append(f.span())
    return sorted(set(out + more))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, kind, features) of every candidate of the whole texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, where, kinds, feats = [], [], [], []
        for i, text in enumerate(batch.column(1)):
            text = text.as_py()
            if not text:
                continue
            own_words = None
            for a, b in spans(text):
                s = text[a:b]
                if own_words is None:
                    own_words = {x.lower() for x in WORD.findall(CANDIDATE.sub(" ", text))}
                rows.append(i)
                where.append((a, b))
                kinds.append("known_format" if KNOWN.fullmatch(s) else "hex" if re.fullmatch(r"[0-9a-fA-F]+", s) else "mixed")
                feats.append(features(text, a, b, own_words))
        if not rows:
            return None
        cols = [batch.column(0).take(pa.array(rows)), pa.array([x[0] for x in where], pa.int64()), pa.array([x[1] for x in where], pa.int64()), pa.array(kinds)]
        cols += [pa.array([f[k] for f in feats], pa.float64()) for k in range(len(FEATURES))]
        return pa.RecordBatch.from_arrays(cols, names=["id", "start", "end", "kind", *FEATURES])

    schema = SPAN.format(id=docs.schema[id_col].dataType.simpleString()) + ", ".join(f"{f} double" for f in FEATURES)
    return map_batches(docs.select(id_col, text_col), run, schema)


def _key(rng: random.Random) -> str:
    """A random secret as a machine makes it."""
    letters = string.ascii_letters + string.digits
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    kinds = (
        lambda: pick("0123456789abcdef", rng.choice((32, 40, 48, 64))),
        lambda: pick(letters, rng.randint(16, 44)),
        lambda: base64.b64encode(rng.randbytes(rng.randint(12, 40))).decode(),
        lambda: base64.urlsafe_b64encode(rng.randbytes(rng.randint(12, 40))).decode().rstrip("="),
        lambda: pick(string.ascii_lowercase, 2) + "_" + pick(letters, rng.randint(18, 36)),
        lambda: "eyJ" + ".".join(pick(letters + "-_", rng.randint(12, 60)) for _ in range(3)),
    )
    return rng.choice(kinds)()


def _password(rng: random.Random, words: list[str]) -> str:
    """A secret as a person chooses it: words, digits and signs."""
    parts = [rng.choice(words) for _ in range(rng.randint(1, 3))]
    parts = [p.capitalize() if rng.random() < 0.4 else p for p in parts]
    tail = "".join(rng.choices(string.digits, k=rng.choice((0, 1, 2, 4)))) + "".join(rng.choices("!$%#?@*&", k=rng.choice((0, 0, 1, 2))))
    return rng.choice(("", "", "-", "_", ".")).join(parts)[:40] + tail


def _finding(rng: random.Random, words: list[str]) -> tuple[str, str, str, float]:
    """(before, value, after, label) of one finding."""
    name = rng.choice(("password", "passwd", "PASSWORD", "db_password", "secret", "client_secret", "token", "auth_token", "api_key", "API-KEY", "access_key", "private_key", "credential"))
    quote = rng.choice(('"', "'"))
    value = _password(rng, words) if rng.random() < 0.5 else _key(rng)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    plain = rng.choice(words)
    join = "_".join(rng.choices(words, k=3)).lower()
    secret = (
        lambda: (f"{name} = {quote}", value, quote),
        lambda: (f"{name}={quote}", value, quote + ")"),
        lambda: (f'"{name}": "', value.replace('"', "x"), '",'),
        lambda: (f"{name}: ", value, ""),
        lambda: (f"export {name.upper().replace('-', '_')}=", value, ""),
        lambda: ("Authorization: Bearer ", _key(rng), ""),
        lambda: (f"postgres://{plain.lower()}:", re.sub(r"[@/:\s]", "", value) or "x1", "@db.example.com/main"),
        lambda: (f"the {name} is ", _key(rng), " now"),
        lambda: (f"{name} => {quote}", value, quote),
    )
    other = (
        lambda: ("commit ", hexes(40), " by"),
        lambda: (rng.choice(("sha256: ", "md5 ", "checksum=", "digest: ", "hash ")), hexes(rng.choice((32, 40, 64))), ""),
        lambda: (rng.choice(("uuid ", "id: ", "guid=", "revision ")), f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", ""),
        lambda: ("https://www.example.com/", f"{join}/{hexes(10)}", "/index.html"),
        lambda: ("see /usr/lib/", f"{join}/{plain.lower()}{rng.randint(1, 99)}", ".so for"),
        lambda: (f"{name} = {quote}", rng.choice(("*" * rng.randint(3, 12), "x" * rng.randint(3, 12), "changeme", "<your key>", "${SECRET}", "{{ secret }}", "None", "your_token_here", "....")), quote),
        lambda: (f"{name} = ", rng.choice(("None", "null", "true", "get_secret()", "os.environ.get(", "undefined", "required", "****")), ""),
        lambda: (f"the {name} ", plain.lower(), " is kept elsewhere"),
        lambda: (f"{name} is ", rng.choice(("required", "optional", "missing", "wrong", plain.lower())), ""),
        lambda: ("order ", "".join(rng.choices(string.digits, k=rng.randint(12, 18))), " of"),
        lambda: ("call ", f"{join}_v{rng.randint(1, 30)}", "(x)"),
        lambda: ("build ", f"{plain.lower()}-{rng.randint(1, 9)}.{rng.randint(0, 20)}-20{rng.randint(10, 24)}{rng.randint(1000, 1231)}", ""),
        lambda: ("data:image/png;base64,", base64.b64encode(rng.randbytes(rng.randint(30, 90))).decode(), ""),
        lambda: ("", f"{hexes(16)}", f" {plain.lower()}"),
    )
    yes = rng.random() < 0.5
    return (*rng.choice(secret if yes else other)(), float(yes))


def made_findings(docs: DataFrame, id_col: str, text_col: str, seed: int = 5) -> DataFrame:
    """(key, text): findings of known label in passages of at most PASSAGES documents; the key ends in label, start and end."""
    usable = docs.where(F.length(text_col) > 0).select(F.col(text_col).alias("t"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    chosen = usable.orderBy("h", "t").limit(PASSAGES)
    at = F.pmod("h", F.greatest(F.length("t") - 160, F.lit(1))) + 1
    chosen = chosen.select("h", F.substring("t", at.cast("int"), F.lit(160)).alias("t")).repartition(1).sortWithinPartitions("h", "t")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, texts = [], []
        for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rng = random.Random(h ^ seed)
            words = WORD.findall(t) or ["word"]
            for n in range(EACH):
                before, value, after, label = _finding(rng, words)
                cut = rng.randint(0, len(t))
                left = t[:cut] + rng.choice((" ", "\n", "  ")) + before
                keys.append(f"{h}:{n}:{label}:{len(left)}:{len(left) + len(value)}")
                texts.append(left + value + after + rng.choice((" ", "\n")) + t[cut:])
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(texts)], names=["key", "text"])

    return map_batches(chosen, run, "key string, text string")


def labelled(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, seed: int = 5) -> DataFrame:
    """(id, start, end, kind, FEATURES, label) of the made findings and of the corpus's own in a published format."""
    made = written(docs.sparkSession, made_findings(docs, id_col, text_col, seed), "made")
    parts = F.split("id", ":")
    rows = candidates(made, "key", "text").where((F.col("start") == parts[3].cast("long")) & (F.col("end") == parts[4].cast("long"))).withColumn("label", parts[2].cast("double"))
    own = found.where("f_known = 1").orderBy(F.xxhash64("id", "start", "end"), "id", "start", "end").limit(SAMPLE_ROWS)
    return rows.unionByName(own.withColumn("id", F.col("id").cast("string")).withColumn("label", F.lit(1.0)))


def train(rows: DataFrame, seed: int = 5) -> PipelineModel | None:
    """A forest on a bounded table of labelled findings."""
    sample = written(rows.sparkSession, rows.repartition(1).sortWithinPartitions("id", "start", "end"), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt", labelCol="label")
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return PipelineModel([ready, forest.fit(ready.transform(sample))])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, kind, score) of the candidates that the forest takes for secrets."""
    spark = docs.sparkSession
    found = written(spark, candidates(docs, id_col, text_col), "candidates")
    model = train(labelled(docs, found, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"{id_col} {kind}, start long, end long, kind string, score double")
    scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.where(F.col("score") >= threshold).select(F.col("id").alias(id_col), "start", "end", "kind", "score")


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every found span of its text replaced by ``mark``; all rows and columns stay."""
    spark = docs.sparkSession
    spans = written(spark, findings.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans")), "spans")
    few = spans.count()
    small = F.broadcast(spans) if few <= 100_000 else spans
    joined = docs.join(small, docs[id_col] == F.col("_id"), "left")
    text = F.col(text_col)
    cut = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        # A span that starts inside the one before lengthens it.
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return joined.withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(cut)).select(*docs.columns)
