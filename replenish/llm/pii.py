"""Personal data: base patterns, and boosted trees over further candidates.

All of it is DataFrame expressions on the rows: no Python code sees a text.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches
of four patterns, of which those that fail their number check are dropped.
Generators with high recall then propose further spans: numbers in
any grouping (each as a phone, a card and an address) and addresses with
written-out signs. Gradient-boosted trees (Spark ML) score them by format and
context; per kind, a threshold calibrated to precision on held-out rows selects. The
trees are fitted on the candidates of all documents, with the base spans as the
labelled findings and ``contrasts`` of them. What the trees see of a candidate
is a few small numbers, so candidates that look alike are counted and learned from once,
with their number as weight. The trees are then written as one expression, which scores
the candidates as the patterns left them: texts are read once.

Positions are code points, end exclusive. Defined results: a null text counts as
empty; repeated rows get the same answer; ties do not arise (spans are ordered
by kind, start and end); other columns are ignored; an empty table gives an
empty table, and if nothing can be learned only base spans are returned.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
# The same matches as the plain patterns, in forms that Java matches in linear time and
# without recursion: possessive repeats, and starts only where a run of the class starts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators; every match is a candidate, also of several kinds.
NUMBER = r"(?<![A-Za-z0-9])[+(]?[0-9][0-9().\x20/-]{6,28}[0-9](?![A-Za-z0-9])"
WRITTEN = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{2,63}){1,6}"
#: Numbers in one usual grouping, also inside a longer run of numbers (a date before them, say).
NATIONAL = r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])"
FOURS = r"(?<![0-9])[0-9]{4}(?:[-.\x20][0-9]{4}){3}(?![0-9])"
#: Words that name a kind, tested just before a candidate.
CONTEXT = {"email": r"(?i)e-?mail|mail|contact|write", "ip": r"(?i)\bip\b|address|host|server|login", "card": r"(?i)card|visa|master|amex|pay|credit", "phone": r"(?i)phone|\btel|call|fax|mobil|cell|whatsapp"}
OTHER = r"(?i)version|\bv\b|isbn|order|invoice|page|chapter|id\b|no\.|date|year|token|sha|hash"

#: What the findings of a table weigh together in the training at most, and as much what is none.
CLASS_WEIGHT = 2_000
#: Of so many folds, one is held out for the thresholds.
FOLDS = 5
#: Different candidates that one training task holds, about.
TASK_ROWS = 50_000
ROUNDS, DEPTH = 16, 4
PRECISION = 0.99
FEATURES = ["kind_email", "kind_ip", "kind_card", "kind_phone", "digits", "groups", "longest", "last", "plus", "paren", "dots", "dashes", "blanks", "letters", "luhn", "octets", "named", "other", "glued"]


def located(text: Column, hits: Column, pattern: str) -> Column:
    """Array of (start, end, s) of ``hits``, the matches of ``pattern`` in ``text``."""
    kind = "array<struct<start:long,end:long,s:string>>"
    none = F.expr("array()").cast(kind)
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
        F.when(x["hit"].isNull(), acc["out"])
        .otherwise(F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("s"))))
        .alias("out"),
    )
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    found = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, found).otherwise(none)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    each = F.filter(F.split(digits, ""), lambda c: c != "")
    n = F.length(digits)

    def value(c: Column, i: Column) -> Column:
        v = c.cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when((n - 1 - i) % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, v: a + v) % 10 == 0


def octets(s: Column) -> Column:
    """Whether all dotted parts are at most 255."""

    def small(p: Column) -> Column:
        p = F.regexp_replace(p, r"^0+(?=.)", "")
        return (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)

    return F.forall(F.split(s, r"\."), small)


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``body`` and the base spans of each kind as arrays of (start, end, s)."""
    body = F.col("body")
    empty = F.expr("array()").cast("array<string>")
    some = {
        "email": (EMAIL, F.contains(body, F.lit("@"))),
        "ip": (IP, body.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        "card": (CARD, body.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        "phone": (PHONE, F.contains(body, F.lit("+"))),
    }
    out = docs.withColumn("body", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns({f"m_{k}": F.when(guard, F.regexp_extract_all(body, F.lit(p), F.lit(0))).otherwise(empty) for k, (p, guard) in some.items()})
    out = out.withColumns({f"b_{k}": located(body, F.col(f"m_{k}"), p) for k, (p, _) in some.items()})
    checks = {
        "ip": lambda x: octets(x["s"]),
        "card": lambda x: F.length(digits_of(x["s"])).between(13, 19) & luhn(digits_of(x["s"])),
        "phone": lambda x: F.length(digits_of(x["s"])).between(9, 15),
    }
    return out.withColumns({f"b_{k}": F.filter(f"b_{k}", check) for k, check in checks.items()})


def with_candidates(based: DataFrame) -> DataFrame:
    """... and ``cands``: arrays of (start, end, kind, f), f the features, of what the generators propose."""
    body = F.col("body")
    empty = F.expr("array()").cast("array<string>")
    out = based.withColumns(
        {
            "g_number": F.regexp_extract_all(body, F.lit(NUMBER), F.lit(0)),
            "g_national": F.when(body.rlike(r"[0-9][-.\x20][0-9]{4}(?![0-9])"), F.regexp_extract_all(body, F.lit(NATIONAL), F.lit(0))).otherwise(empty),
            "g_fours": F.when(body.rlike(r"[0-9]{4}[-.\x20][0-9]{4}[-.\x20]"), F.regexp_extract_all(body, F.lit(FOURS), F.lit(0))).otherwise(empty),
            "g_written": F.when(F.contains(body, F.lit("@")) | body.rlike(r"(?i)[(\[]at[)\]]"), F.regexp_extract_all(body, F.lit(WRITTEN), F.lit(0))).otherwise(empty),
        }
    )
    generators = {"g_number": NUMBER, "g_national": NATIONAL, "g_fours": FOURS, "g_written": WRITTEN}
    out = out.withColumns({g: located(body, F.col(g), pattern) for g, pattern in generators.items()})

    def candidates(spans: str, kind: str) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), features(body, x, kind).alias("f")))

    return out.withColumn("cands", F.concat(candidates("g_written", "email"), *(candidates("g_number", k) for k in KINDS[1:]), candidates("g_national", "phone"), candidates("g_fours", "card")))


def features(body: Column, x: Column, kind: str) -> Column:
    s = x["s"]
    before = F.substring(body, F.greatest(x["start"] - 23, F.lit(1)).cast("int"), F.least(x["start"], F.lit(24)).cast("int"))
    after = F.substring(body, (x["end"] + 1).cast("int"), F.lit(2))
    d = digits_of(s)
    groups = F.filter(F.split(s, r"[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    count = lambda chars: F.length(s) - F.length(F.translate(s, chars, ""))
    card = kind == "card"
    values = [F.lit(float(kind == k)) for k in KINDS] + [
        F.length(d),
        F.size(groups),
        F.coalesce(F.array_max(sizes), F.lit(0)),
        F.coalesce(F.try_element_at(sizes, F.lit(-1)), F.lit(0)),
        count("+"),
        count("()"),
        count("."),
        count("-/"),
        count(" "),
        F.length(F.regexp_replace(s, r"[^A-Za-z]", "")),
        (F.length(d).between(13, 19) & luhn(d)) if card else F.lit(False),
        octets(s) if kind == "ip" else F.lit(False),
        before.rlike(CONTEXT[kind]),
        before.rlike(OTHER),
        before.rlike(r"[A-Za-z0-9_=\"/]$") | after.rlike(r"^[A-Za-z0-9_\"/%]"),
    ]
    return F.array(*(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values))


def labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(FEATURES, kind, label, fold, n_good, n_none, weight): ``findings`` of all documents."""
    return findings(with_candidates(with_base(docs.select(id_col, text_col), text_col)), id_col)


def findings(found: DataFrame, id_col: str) -> DataFrame:
    """The labelled candidates of all rows of ``with_candidates`` and their contrasts, a row for those that look alike.

    n_good and n_none count the base spans and the others that a row stands for.
    """
    is_base = F.lit(False)
    for k in KINDS:
        is_base = is_base | ((F.col("c.kind") == k) & F.exists(f"b_{k}", lambda b: (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end"))))
    flat = found.select(id_col, F.explode("cands").alias("c"), *(f"b_{k}" for k in KINDS))
    flat = flat.withColumn("label", F.when(is_base, 1.0).when(_none(lambda f: F.col("c.f")[FEATURES.index(f)], F.col("c.kind")), 0.0)).where("label is not null")
    fold = F.pmod(F.xxhash64(F.col(id_col).cast("string"), "c.start", "c.kind"), F.lit(FOLDS)).cast("int")
    flat = flat.select(F.col("c.kind").alias("kind"), "label", fold.alias("fold"), *(F.col("c.f")[i].alias(f) for i, f in enumerate(FEATURES)))
    alike = ["kind", "label", "fold", *FEATURES]
    counted = flat.groupBy(*alike).agg(F.count_if(F.col("label") == 1).alias("n_good"), F.count_if(F.col("label") == 0).alias("n_none"))
    counted = written(found.sparkSession, counted, "pii-candidates")
    sums = counted.agg(F.sum("n_good"), F.sum("n_none")).first()
    share = [min(1.0, CLASS_WEIGHT / n) if n else 1.0 for n in sums]
    out = contrasts(counted).groupBy(*alike).agg(F.sum("n_good").alias("n_good"), F.sum("n_none").alias("n_none"))
    return out.withColumn("weight", F.col("n_good") * share[0] + F.col("n_none") * share[1])


def _none(f, kind: Column) -> Column:
    """Candidates that format or context rule out, whatever else they look like.

    The others that are no base span stay unlabelled: among them is what the
    trees are to find, and taking it for wrong would teach them to pass it over.
    """
    digits, groups = f("digits"), f("groups")
    other = (f("other") == 1) & (f("named") == 0)
    number = (f("letters") == 0) & (other | (f("glued") == 1) & (f("named") == 0))
    dated = (digits == 8) & (groups == 3) & (f("longest") == 4)
    phone = (kind == "phone") & (number | (digits < 7) | (digits > 15) | dated | (groups == 1) & (f("plus") == 0) & (f("named") == 0) | (f("dots") == 3) & (groups == 4))
    card = (kind == "card") & ((f("luhn") == 0) | number)
    ip = (kind == "ip") & ((f("octets") == 0) | (groups != 4) | (f("dots") != 3) | number)
    return phone | card | ip


def contrasts(found: DataFrame) -> DataFrame:
    """The labelled candidates, and the base spans among them as they look in other formats and contexts."""
    blank = {c: F.lit(0.0) for c in ("plus", "paren", "dots", "dashes", "blanks", "letters", "other", "glued")}
    of = lambda **values: {c: F.lit(v) if isinstance(v, float) else v for c, v in values.items()}
    grouped = blank | of(digits=10.0, groups=3.0, longest=4.0, last=4.0)
    # National numbers: area code in parentheses, or groups parted by dashes, dots or blanks; with or without a word that names them.
    forms = [{"paren": 2.0, "blanks": 1.0, "dashes": 1.0}, {"dashes": 2.0}, {"dots": 2.0}, {"blanks": 2.0}, {"paren": 2.0, "dashes": 1.0}]
    national = [grouped | of(**form) | of(named=named) for form in forms for named in (0.0, 1.0)]
    spaced = [blank | of(digits=16.0, groups=4.0, longest=4.0, last=4.0, luhn=1.0, **{c: 3.0}) for c in ("dots", "dashes", "blanks")]
    # Addresses with written-out signs.
    written_out = [blank | of(letters=F.col("letters") + 5, paren=p, dots=d, blanks=b) for p, d, b in ((4.0, 0.0, 4.0), (0.0, 0.0, 4.0), (2.0, 1.0, 2.0), (2.0, 1.0, 0.0), (4.0, 0.0, 0.0))]
    plain = of(plus=0.0, paren=0.0, blanks=0.0, named=0.0, label=0.0)
    bare = plain | of(dashes=0.0, groups=1.0, longest=F.col("digits"), last=F.col("digits"))
    dated = plain | of(digits=8.0, groups=3.0, longest=4.0, last=2.0, dashes=2.0)
    unfit, wide = of(luhn=0.0, label=0.0), of(octets=0.0, label=0.0)
    version = of(other=1.0, named=0.0, longest=1.0, last=1.0, digits=4.0, label=0.0)
    glued = of(glued=1.0, named=0.0, label=0.0)
    # The same spans taken for another kind are none.
    as_kind = lambda x, kind: x | of(luhn=0.0, octets=0.0, label=0.0, kind=F.lit(kind), **{f"kind_{k}": float(k == kind) for k in KINDS})
    seen = {
        "email": written_out,
        "ip": [wide, version, glued],
        "card": [*spaced, *(as_kind(x, k) for x in spaced for k in ("phone", "ip")), unfit, glued],
        "phone": [*national, *(as_kind(x, k) for x in national for k in ("card", "ip")), bare, dated, glued],
    }
    columns = ["kind", "label", *FEATURES]
    row = lambda values: F.struct(*(values.get(c, F.col(c)).alias(c) for c in columns))
    rows = F.array(row({}))
    for kind, forms in seen.items():
        rows = F.when((F.col("label") == 1) & (F.col("kind") == kind), F.array(row({}), *(row(x) for x in forms))).otherwise(rows)
    out = found.select("fold", "n_good", "n_none", F.posexplode(rows).alias("place", "x"))
    # A row made from another one is held out or learned from by itself.
    return out.select(F.pmod(F.col("fold") + F.col("place"), F.lit(FOLDS)).cast("int").alias("fold"), "n_good", "n_none", "x.*")


def _tree(node, features: Column) -> Column:
    """A fitted tree as nested conditions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(features[int(split.featureIndex())] <= float(split.threshold()), _tree(node.leftChild(), features)).otherwise(_tree(node.rightChild(), features))


class Scorer:
    """Margins of the boosted trees as an expression, and a threshold a kind."""

    def __init__(self, model, thresholds: dict[str, float]):
        self.trees = [(float(w), t._java_obj.rootNode()) for w, t in zip(model.treeWeights, model.trees)]
        self.thresholds = thresholds

    def margin(self, features: Column) -> Column:
        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + F.lit(weight) * _tree(root, features)
        return total


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> Scorer | None:
    return fitted(labelled(docs, id_col, text_col), seed)


def fitted(found: DataFrame, seed: int = 3) -> Scorer | None:
    """Trees and thresholds from all ``findings``."""
    table = written(found.sparkSession, found, "pii-findings")
    tasks = max(1, -(-table.count() // TASK_ROWS))
    table = table.repartition(tasks, *FEATURES).sortWithinPartitions("kind", "label", "fold", *FEATURES)
    learn = table.where("fold <> 0")
    if learn.select("label").distinct().count() < 2:
        return None
    boosted = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=seed, labelCol="label", weightCol="weight")
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), boosted]).fit(learn).stages[-1]
    scorer = Scorer(model, {})
    held = table.where("fold = 0").withColumn("m", scorer.margin(F.array(*FEATURES))).where("m > 0")
    scored = held.groupBy("kind", "m").agg(F.sum(F.col("weight") * F.col("label")).alias("good"), F.sum("weight").alias("n")).collect()  # a row a value that the trees give
    for kind in KINDS:
        own = [(r.m, r.good, r.n) for r in scored if r.kind == kind]
        least = threshold(own)
        # If all that the trees take is precise enough, their own bound at 0 is, not just the lowest margin seen.
        scorer.thresholds[kind] = math.ulp(0.0) if own and least == min(own)[0] else least
    return scorer


def threshold(scored: list[tuple]) -> float:
    """The smallest positive margin at and above which at least PRECISION of the weight is of findings; rows: margin, findings, weight (1 if none)."""
    best, good, n = math.inf, 0.0, 0.0
    ordered = sorted(scored, reverse=True)
    for i, (margin, label, *weight) in enumerate(ordered):
        good, n = good + label, n + (weight[0] if weight else 1)
        last = i + 1 == len(ordered) or ordered[i + 1][0] < margin
        if last and margin > 0 and good >= PRECISION * n:
            best = margin
    return best


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scorer: Scorer | None = None, learn: bool = True) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts are of the base spans."""
    based = with_base(docs.select(F.col(id_col), F.col(text_col)), text_col)
    spans = [id_col, *(f"b_{k}" for k in KINDS)]
    if scorer is None and learn:
        found = written(docs.sparkSession, with_candidates(based).select(*spans, "cands"), "pii-spans")
        scorer = fitted(findings(found, id_col))
    elif scorer is not None:
        found = with_candidates(based)
    else:
        found = based

    def plain(kind: str) -> Column:
        return F.transform(f"b_{kind}", lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["start"].alias("start"), x["end"].alias("end")))

    base = F.concat(*(plain(k) for k in KINDS))
    if scorer is None:
        out = found.withColumn("base", base).withColumn("all", F.col("base"))
    else:
        out = found.withColumn("base", base)
        known = list(scorer.thresholds.items())

        def selected(c: Column) -> Column:
            least = F.lit(math.inf)
            for kind, value in known:
                least = F.when(c["kind"] == kind, F.lit(value)).otherwise(least)
            free = ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
            return free & (scorer.margin(c["f"]) >= least)

        order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
        more = F.transform(F.filter("cands", selected), lambda c: F.struct(order[c["kind"]].alias("k"), c["start"].alias("start"), c["end"].alias("end")))
        out = out.withColumn("all", F.array_sort(F.array_distinct(F.concat("base", more))))
    names = F.array(*(F.lit(k) for k in KINDS))

    def joined(column: str) -> Column:
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(id_col, *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("all").alias("spans"))
